"""Quantiles and running totals over values of any number, by range partitions, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.runtime import cut


def running_totals(rows: DataFrame, order: list[str], weight: str, out: str, desc: bool = False) -> DataFrame:
    """rows with the sum of weight over all rows before each in a total order (0 for the first): range partitions, their sums (a row a partition), and a running sum inside each."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
    placed = cut(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "totals")
    before, starts = 0, {}
    for r in placed.groupBy("_part").agg(F.sum(weight).alias("s")).orderBy("_part").collect():
        starts[r["_part"]], before = before, before + (r["s"] or 0)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) if starts else F.lit(0)
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(out, F.coalesce(inside, F.lit(0)) + start).drop("_part")


def running_maximum(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """rows with the greatest value of all rows that come before each in falling order (null for the first), by range partitions and their maxima."""
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    placed = cut(rows.repartitionByRange(parts, F.col(order).desc()).withColumn("_part", F.spark_partition_id()), "maxima")
    best, starts = None, {}
    for r in placed.groupBy("_part").agg(F.max(value).alias("m")).orderBy("_part").collect():
        starts[r["_part"]] = best
        best = r["m"] if best is None or r["m"] is not None and r["m"] > best else best
    kind = placed.schema[value].dataType
    start = F.element_at(F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v).cast(kind))]), F.col("_part")) if starts else F.lit(None).cast(kind)
    inside = F.max(value).over(Window.partitionBy("_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(out, F.greatest(inside, start)).drop("_part")


def exact_quantiles(rows: DataFrame, value: str, points: list[float]) -> list[float | None]:
    """The linear quantiles of a column's values that aren't null; None each where there are none.

    Values are counted first; what comes to the driver is two values a point.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_totals(counts, ["_v"], "_n", "_below")
    total = placed.agg(F.sum("_n")).first()[0] or 0
    if not total:
        return [None] * len(points)
    spots = [(total - 1) * p for p in points]
    wanted = sorted({k for s in spots for k in (int(s), min(total - 1, int(s) + 1))})
    hit = F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda k: (k >= F.col("_below")) & (k < F.col("_below") + F.col("_n"))))
    at = {r["k"]: r["_v"] for r in placed.select("_v", hit.alias("k")).collect()}
    return [at[int(s)] + (s - int(s)) * (at[min(total - 1, int(s) + 1)] - at[int(s)]) for s in spots]
