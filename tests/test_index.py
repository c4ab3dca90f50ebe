"""Golden facts about call edges, on trees of our own."""

import pytest
import trees

from repolens.plans import index
from repolens.sources import tree


def edges(spark, files):
    tables = index.build(tree.parse_files(tree.from_tree(spark, files)))
    return {(r["file"], r["caller"], r["origin"], r["symbol"]) for r in index.edges(tables).collect()}


def test_python_calls_cross_files(spark):
    found = edges(spark, trees.PYTHON)
    assert ("app/api.py", "show", "app/orders.py", "total_for") in found
    assert ("tests/test_orders.py", "test_show", "app/api.py", "show") in found


def test_receiver_types_keep_owners_apart(spark):
    found = edges(spark, trees.PYTHON)
    assert ("app/user_service.py", "register", "app/models.py", "User.save") in found
    assert not any(f == "app/order_service.py" and s == "User.save" for f, _, _, s in found)


def test_javascript_module_calls(spark):
    assert ("src/controllers/api.js", "quote", "src/services/pricing.js", "rateFor") in edges(spark, trees.JAVASCRIPT)


def test_go_and_dart_and_java(spark):
    assert ("internal/api/handler.go", "Quote", "internal/pricing/service.go", "RateFor") in edges(spark, trees.GO)
    assert ("lib/screens/checkout_screen.dart", "CheckoutScreen.quote", "lib/services/pricing_service.dart", "PricingService.rateFor") in edges(spark, trees.DART)
    assert ("src/main/java/CheckoutController.java", "CheckoutController.quote", "src/main/java/PricingService.java", "PricingService.rateFor") in edges(spark, trees.JAVA)


def test_typescript_injection(spark):
    found = edges(spark, trees.TYPESCRIPT)
    assert ("src/users.controller.ts", "UsersController.constructor", "src/users.service.ts", "UsersService") in found
    assert ("src/users.controller.ts", "UsersController.show", "src/users.service.ts", "UsersService.findById") in found
    assert ("src/classic.ts", "Classic.run", "src/users.service.ts", "UsersService.findById") in found
    assert not any(s == "PrismaService.get" for *_, s in found)  # the receiver's type is unknown


def test_php_file_scope_and_injection(spark):
    found = edges(spark, trees.PHP)
    assert ("bootstrap.php", "__file_scope__", "src/SessionService.php", "SessionService.getInstance") in found
    assert ("bootstrap.php", "__file_scope__", "src/SessionService.php", "SessionService.refresh") in found
    for controller in ("Checkout", "Legacy"):
        assert (f"src/{controller}Controller.php", f"{controller}Controller.pay", "src/PaymentService.php", "PaymentService.charge") in found


def test_kotlin_and_csharp(spark):
    assert ("src/Checkout.kt", "Checkout.quote", "src/Pricing.kt", "Pricing.rateFor") in edges(spark, trees.KOTLIN)
    assert ("src/Checkout.cs", "Shop.Checkout.Quote", "src/Pricing.cs", "Shop.Pricing.RateFor") in edges(spark, trees.CSHARP)


def test_syntax_errors_and_binaries(spark):
    files = tree.from_tree(spark, {"a.py": "def f(:\n", "b.py": "x = 1\n"}).union(spark.createDataFrame([("c.py", bytearray(b"a\0b"))], "path string, content binary"))
    rows = {r["path"]: r for r in tree.parse_files(files).collect()}
    assert set(rows) == {"a.py", "b.py"} and rows["a.py"]["symbols"] == []


def test_unique_only_drops_ambiguous_names(spark):
    files = {"a.py": "def f():\n    g()\n", "b.py": "def g():\n    pass\n", "c.py": "def g():\n    pass\n"}
    parsed = tree.parse_files(tree.from_tree(spark, files))
    assert index.refs(index.build(parsed)).count() == 2
    assert index.refs(index.build(parsed), unique_only=True).count() == 0


@pytest.mark.parametrize("text", ["", "\n", "class", "function f(", "def f():\n  return '''", "{" * 50, "x" * 5000])
def test_parsers_survive_fragments(text):
    from repolens.functions.parsing import parse

    for suffix in ("py", "js", "ts", "java", "kt", "cs", "go", "dart", "php", "zig", "m", "rs", "rb", "blade.php", "html", "txt"):
        assert parse(f"a.{suffix}", text).symbols is not None


BLADE = """@extends('layouts.app')
@props(['type' => 'info', 'title'])
@section('content')
  @include('partials.menu')
  <x-alert type="warning" :message="$msg"><x-slot name="icon">!</x-slot></x-alert>
  <div x-data="{ open: false, items: ['}'],
      toggle() { this.open = !this.open } }" @click.prevent="toggle()" x-on:keyup="go">
    <input x-model.debounce="q" x-ref="box"><a href="{{ route('home.show') }}">x</a>
    <span x-data="counter(1)" x-text="$store.cart.total"></span>
  </div>
  {{ $slot }} @yield('footer') @stack('scripts') @push('styles')
  <script>Alpine.data('counter', () => ({})); Alpine.store('cart', {}); $dispatch('saved')</script>
@endsection
"""


def test_blade_templates():
    from repolens.functions.parsing import parse

    p = parse("a/home.blade.php", BLADE)
    got = {n: (s.kind, s.line, s.end_line) for n, s in p.symbols.items()}
    assert got == {
        "section:content": ("section", 3, None), "component:alert": ("component", 5, None), "slot:icon": ("slot", 5, None), "alpine-inline:6": ("alpine_inline", 6, 7), "props": ("props", 2, 2),
        "alpine:counter": ("alpine_component", 9, None), "alpine-global:counter": ("alpine_global_component", 12, None), "alpine-store:cart": ("alpine_store", 12, None),
    }
    assert p.symbols["props"].signature == "@props([title, type])" and p.symbols["alpine-inline:6"].signature == 'x-data="{ open, items, toggle }"'
    assert p.imports == ["extends:layouts.app", "include:partials.menu", "push:styles"]
    assert set(p.exports) == {
        "yield:footer", "stack:scripts", "dispatch:saved", "event:click", "event:keyup", "model:q", "ref:box", "store:cart", "route:home.show", "attribute:alert.type", "attribute:alert.:message", "slot",
    }


def test_fields_of_a_class_are_its_edges():
    from repolens.functions.parsing import parse

    text = "import { B } from './b';\nexport class A {\n  x = new B();\n  private y: C;\n  n: string;\n  m() {\n    this.y.go();\n  }\n}\nconst z = new B();\n"
    assert sorted(parse("a.ts", text).pending) == [("A", "B"), ("A", "C"), ("A.m", "C.go")]
