"""The threshold rules that decide clear transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecscore.functions.schema import RULES


def holds(conditions: list[tuple[int, str, float]]) -> Column:
    """Strict comparisons in single precision; a NaN feature satisfies none."""
    each = []
    for d, how, threshold in conditions:
        v, t = F.col(f"v{d}"), F.lit(threshold).cast("float")
        each.append(v < t if how == "<" else (v > t) & ~F.isnan(v))
    return reduce(lambda a, b: a & b, each)


def _first(value: int) -> Column:
    out = F.lit("Borderline")
    for rule in reversed(RULES):
        out = F.when(holds(rule[2]), F.lit(rule[value])).otherwise(out)
    return out


def with_rule(features: DataFrame) -> DataFrame:
    """features with rule_id and verdict."""
    by_rule = F.lit("Borderline")
    for rule, verdict, _ in RULES:
        by_rule = F.when(F.col("rule_id") == rule, F.lit(verdict)).otherwise(by_rule)
    return features.withColumn("rule_id", _first(0)).withColumn("verdict", by_rule)
