"""Small source trees written for the tests."""

PYTHON = {
    "app/orders.py": 'def total_for(order):\n    """Sum of an order."""\n    return sum(order)\n',
    "app/api.py": "from app.orders import total_for\n\n\ndef show(order):\n    return total_for(order)\n",
    "tests/test_orders.py": "from app.api import show\n\n\ndef test_show():\n    assert show([1]) == 1\n",
    "app/models.py": "class User:\n    def save(self):\n        pass\n\n\nclass Order:\n    def save(self):\n        pass\n",
    "app/user_service.py": "from app.models import User\n\n\ndef register():\n    u = User()\n    u.save()\n",
    "app/order_service.py": "from app.models import Order\n\n\ndef place():\n    o = Order()\n    o.save()\n",
}
JAVASCRIPT = {
    "src/services/pricing.js": "function rateFor(item) {\n  return item.price * 2;\n}\nmodule.exports = { rateFor };\n",
    "src/controllers/api.js": "const pricing = require('../services/pricing');\nfunction quote(req) {\n  return pricing.rateFor(req.item);\n}\nmodule.exports = { quote };\n",
    "tests/api.test.js": "const api = require('../src/controllers/api');\nfunction checkQuote() {\n  return api.quote({ item: { price: 1 } });\n}\n",
}
GO = {
    "internal/pricing/service.go": "package pricing\n\n// RateFor gives a rate.\nfunc RateFor(x int) int {\n\treturn x * 2\n}\n",
    "internal/api/handler.go": 'package api\n\nimport (\n\t"shop/internal/pricing"\n)\n\nfunc Quote(x int) int {\n\treturn pricing.RateFor(x)\n}\n',
    "internal/api/handler_test.go": "package api\n\nfunc TestQuote(t *testing.T) {\n\tQuote(1)\n}\n",
}
DART = {
    "lib/services/pricing_service.dart": "class PricingService {\n  double rateFor(int x) {\n    return x * 2.0;\n  }\n}\n",
    "lib/screens/checkout_screen.dart": "import '../services/pricing_service.dart';\n\nclass CheckoutScreen {\n  double quote() {\n    final s = PricingService();\n    return s.rateFor(3);\n  }\n}\n",
    "test/checkout_screen_test.dart": "void main() {\n  CheckoutScreen().quote();\n}\n",
}
JAVA = {
    "src/main/java/PricingService.java": "package shop;\n\npublic class PricingService {\n  public int rateFor(int x) {\n    return x * 2;\n  }\n}\n",
    "src/main/java/CheckoutController.java": "package shop;\n\npublic class CheckoutController {\n  private PricingService pricing;\n  public CheckoutController(PricingService p) { this.pricing = p; }\n  public int quote(int x) {\n    return pricing.rateFor(x);\n  }\n}\n",
}
TYPESCRIPT = {
    "src/users.service.ts": "@Injectable()\nexport class UsersService {\n  constructor(private readonly prisma: PrismaService) {}\n\n  async findById(id: string): Promise<User> {\n    return this.prisma.query(id);\n  }\n}\n",
    "src/users.controller.ts": "import { UsersService } from './users.service';\n\n@Controller('users')\nexport class UsersController {\n  constructor(private readonly users: UsersService) {}\n\n  async show(id: string) {\n    return this.users.findById(id);\n  }\n\n  other(x: Thing) {\n    return this.unknown.get(x);\n  }\n}\n",
    "src/prisma.service.ts": "export class PrismaService {\n  query(id: string) {\n    return id;\n  }\n\n  get(id: string) {\n    return id;\n  }\n}\n",
    "src/classic.ts": "import { UsersService } from './users.service';\n\nexport class Classic {\n  private users: UsersService;\n\n  constructor(users: UsersService) {\n    this.users = users;\n  }\n\n  run() {\n    const made = new UsersService(null);\n    made.findById('1');\n    return this.users.findById('2');\n  }\n}\n",
}
PHP = {
    "src/SessionService.php": "<?php\nnamespace App;\n\nclass SessionService {\n    public static function getInstance(): self {\n        return new self();\n    }\n\n    public function refresh(int $id) {\n        return $id;\n    }\n}\n",
    "src/PaymentService.php": "<?php\nclass PaymentService {\n    public function charge(int $x) {\n        return $x;\n    }\n}\n",
    "bootstrap.php": "<?php\nrequire 'vendor/autoload.php';\n$session = SessionService::getInstance();\n$session->refresh(42);\n",
    "src/CheckoutController.php": "<?php\nclass CheckoutController {\n    public function __construct(private PaymentService $payments) {}\n\n    public function pay() {\n        return $this->payments->charge(5);\n    }\n}\n",
    "src/LegacyController.php": "<?php\nclass LegacyController {\n    private $payments;\n\n    public function __construct(PaymentService $p) {\n        $this->payments = $p;\n    }\n\n    public function pay() {\n        return $this->payments->charge(1);\n    }\n}\n",
}
KOTLIN = {
    "src/Pricing.kt": "package shop.pricing\n\nclass Pricing {\n    fun rateFor(x: Int): Int {\n        return x * 2\n    }\n}\n",
    "src/Checkout.kt": "package shop.api\n\nimport shop.pricing.Pricing\n\nclass Checkout(private val pricing: Pricing) {\n    fun quote(x: Int) = pricing.rateFor(x)\n}\n",
}
CSHARP = {
    "src/Pricing.cs": "namespace Shop\n{\n    public class Pricing\n    {\n        public Pricing() { }\n        public int RateFor(int x) { return x * 2; }\n    }\n}\n",
    "src/Checkout.cs": "using System;\nnamespace Shop\n{\n    public class Checkout\n    {\n        public int Quote(int x)\n        {\n            var p = new Pricing();\n            return p.RateFor(x);\n        }\n    }\n}\n",
}
ALL = PYTHON | JAVASCRIPT | GO | DART | JAVA | TYPESCRIPT | PHP | KOTLIN | CSHARP
