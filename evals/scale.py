"""Latency and quality on a synthetic tree: ``python evals/scale.py [files] [callers]``. Prints one JSON line.

The tree has one function, a few callers, a function to be found by a question, and files of noise.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repolens.plans.engine import Engine
from repolens.session import get_spark

QUESTION = "payment refund ledger invoice reverse charge"


def write_tree(root: str, files: int, callers: int) -> None:
    for folder in ("app/needle", "callers", "noise"):
        os.makedirs(f"{root}/{folder}", exist_ok=True)
    put = lambda path, text: open(f"{root}/{path}", "w").write(text)  # noqa: E731, SIM115
    put("app/core.py", "def target_function(value):\n    return value + 1\n")
    put("app/needle/handler.py", 'def process_payment_refund(invoice):\n    """Reverse a charge in the ledger: refund the payment of an invoice."""\n    return invoice\n')
    for i in range(callers):
        put(f"callers/caller_{i}.py", f"from app.core import target_function\n\n\ndef caller_{i}():\n    return target_function({i})\n")
    for i in range(files - callers - 2):
        put(f"noise/noise_{i}.py", f"def helper_{i}(value):\n    return value * {i}\n\n\ndef local_{i}():\n    return helper_{i}({i})\n")


def main(files: int = 500, callers: int = 5) -> dict:
    spark = get_spark("scale", master=f"local[{os.environ.get('BENCH_CPUS', '8')}]", shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as root:
        write_tree(root, files, callers)
        engine = Engine(spark, tempfile.mkdtemp())
        engine.set_project_path(root)
        began = time.perf_counter()
        engine.build_deep_index()
        built = time.perf_counter() - began
        took = []
        for _ in range(3):  # the first answer also compiles plans and caches the edges
            began = time.perf_counter()
            context = engine.get_context("app/core.py", symbol="target_function", change_type="signature_change", max_related=callers + 5)
            took.append(time.perf_counter() - began)
        found = {c["file"] for c in context["direct_callers"]}
        true = {f"callers/caller_{i}.py" for i in range(callers)}
        began = time.perf_counter()
        hits = engine.search_symbols(QUESTION, 5)
        searched = time.perf_counter() - began
    return {
        "files": files, "index_s": round(built, 2), "context_s": [round(t, 2) for t in took], "search_s": round(searched, 2), "recall": len(found & true) / len(true),
        "precision": len(found & true) / max(1, len(found)), "recall_at_5": float("process_payment_refund" in [h["short_name"] for h in hits]), "confidence": context["confidence"],
    }


if __name__ == "__main__":
    print(json.dumps(main(*map(int, sys.argv[1:]))))
