"""Weights and risk levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and thresholds of the risk score.
CATEGORY_WEIGHTS = {"routes": 1.6, "migrations": 1.55, "middleware": 1.5, "controllers": 1.4, "models": 1.35, "services": 1.25, "views": 1.1, "tests": 0.7}
USAGE_WEIGHTS = {
    "extends_or_implements": 1.5, "instantiation": 1.3, "static_call": 1.25, "method_call": 1.2, "reference": 1.0, "type_hint": 0.95, "import": 0.85, "module_script": 0.55,
}
CHANGE_WEIGHTS = {"rename": 1.15, "delete": 1.35, "signature_change": 1.25, "contract_change": 1.25}
RISK_LEVELS = [(30.0, "critical"), (16.0, "high"), (7.0, "medium")]
BLAST_LEVELS = [(35.0, "critical"), (18.0, "high"), (8.0, "medium")]
FILE_LEVELS = [(3, "low"), (8, "medium"), (15, "high")]
HIGH_RISK = 6.0


def weight(value: Column, table: dict[str, float]) -> Column:
    """The table's weight of a lower-cased value, 1 if it has none."""
    out = F.lit(1.0)
    for name, w in reversed(table.items()):
        out = F.when(F.lower(value) == name, w).otherwise(out)
    return out


def level(score: Column, steps: list[tuple[float, str]]) -> Column:
    out = F.lit("low")
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def file_count_level(n: Column) -> Column:
    out = F.lit("critical")
    for most, name in reversed(FILE_LEVELS):
        out = F.when(n <= most, name).otherwise(out)
    return out


def _whole(table: dict[str, float]) -> dict[str, int]:
    return {k: round(100 * v) for k, v in table.items()}


def whole_weight(value: Column, table: dict[str, float]) -> Column:
    """The weight in hundredths, as long: sums and products of those are exact."""
    out = F.lit(100)
    for name, w in reversed(_whole(table).items()):
        out = F.when(F.lower(value) == name, w).otherwise(out)
    return out.cast("long")


def file_score(category: Column, usage_sum: Column, count: Column, path: Column, change: str = "modify") -> Column:
    """One file's weighted risk in thousandths, rounded half up. ``usage_sum`` is in hundredths.

    (1 + 0.35 * min(10, count) + 0.2 * usages) * category * change * 1.4 for sensitive paths, in whole numbers throughout.
    """
    base = 10_000 + F.least(F.lit(10), F.greatest(F.lit(0), count)) * 3500 + usage_sum * 20
    sensitive = F.when(F.lower(path).rlike("auth|payment|webhook"), 14).otherwise(10)
    product = base * whole_weight(category, CATEGORY_WEIGHTS) * F.lit(round(100 * CHANGE_WEIGHTS.get(change, 1.0))) * sensitive
    return F.floor((product + 500_000) / F.lit(1_000_000).cast("decimal(10,0)")).cast("long")


def case_sql(value: str, table: dict[str, float]) -> str:
    """``whole_weight`` in SQL."""
    return f"CASE lower({value}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _whole(table).items()) + " ELSE 100 END"


def level_sql(score: str, steps: list[tuple[float, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {v} THEN '{k}'" for v, k in steps) + " ELSE 'low' END"
