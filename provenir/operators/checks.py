"""Integrity between tables: full outer comparison by key, drift, and a pass or fail over named checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Per verdict: rows only left, only right, equal in all values within the tolerance, or different."""
    a = left.select(*keys, *(F.col(v).alias(f"_a{i}") for i, v in enumerate(values)), F.lit(1).alias("_l"))
    b = right.select(*keys, *(F.col(v).alias(f"_b{i}") for i, v in enumerate(values)), F.lit(1).alias("_r"))
    same = F.lit(True)
    for i in range(len(values)):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    verdict = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(same, "equal").otherwise("different")
    return a.join(b, keys, "full_outer").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows"))


def greatest_drift(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest absolute difference of a value over the common keys."""
    joined = left.select(*keys, F.col(value).alias("_a")).join(right.select(*keys, F.col(value).alias("_b")), keys)
    return joined.agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("greatest"), F.count("*").alias("keys"))


def vector_drift(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Per key: the greatest absolute difference of two arrays of numbers, place by place."""
    joined = left.select(key, F.col(vector).alias("_a")).join(right.select(key, F.col(vector).alias("_b")), key)
    apart = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return joined.select(key, F.array_max(apart).alias("drift"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: failed hard and soft checks, and FAIL if any hard one failed."""
    failed = F.col("passed") == 0
    return checks.agg(F.count("*").alias("checks"), F.count_if(failed & (F.col("severity") == "hard")).alias("hard_failed"), F.count_if(failed & (F.col("severity") == "soft")).alias("soft_failed")).withColumn("status", F.when(F.col("hard_failed") > 0, "FAIL").otherwise("PASS"))


def signature(rows: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """An order-free signature of each group's rows (their count and the sum of 32 bits of their hashes), so that equal supports compare equal without collecting them."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\u0001", *parts)), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(h).alias("signature"))
