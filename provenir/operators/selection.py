"""Choosing among candidates: matrices, transfer means, ranks, regret, Pareto sets and bootstrap draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from provenir.operators.quantiles import running_maximum


def matrix(cells: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """Long cells as one row per row name and one column per name given."""
    return cells.groupBy(row).pivot(column, names).agg(F.first(value))


def off_diagonal(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Per row name: the diagonal cell and the mean of the others, nulls skipped."""
    same = F.col(row) == F.col(column)
    return cells.groupBy(row).agg(F.max(F.when(same, F.col(value))).alias("same"), F.avg(F.when(~same, F.col(value))).alias("transfer"))


def common_targets(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """For every two candidates: both means over the targets that are neither."""
    a = cells.select(F.col(row).alias("a"), F.col(column).alias("target"), F.col(value).alias("va"))
    b = cells.select(F.col(row).alias("b"), F.col(column).alias("target"), F.col(value).alias("vb"))
    both = a.join(b, "target").where("a < b and target <> a and target <> b")
    return both.groupBy("a", "b").agg(F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.count("*").alias("targets"))


def ranks(rows: DataFrame, by: list[str], value: str, out: str, descending: bool = True) -> DataFrame:
    """1 plus the number of strictly better rows of the group."""
    return rows.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value))))


def regret(rows: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """The greater of a row's distances from its group's best in two metrics."""
    w = Window.partitionBy(*by)
    return rows.withColumn("regret", F.greatest(F.max(first).over(w) - F.col(first), F.max(second).over(w) - F.col(second)))


def pareto(rows: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Rows that no other row beats or equals in both metrics and beats in one: a running maximum over range partitions, no join of all with all and no task that sees all."""
    by_first = rows.groupBy(first).agg(F.max(second).alias("_top"))
    above = running_maximum(by_first, first, "_top", "_above")
    good = above.where("_above is null or _top > _above").select(F.col(first).alias("_f"), "_top")
    return rows.join(good, (rows[first] == good["_f"]) & (rows[second] == good["_top"]), "left_semi")


def differences(rows: DataFrame, key: str, value: str) -> DataFrame:
    """value of every candidate less that of every later one; candidates are few."""
    a, b = rows.select(F.col(key).alias("a"), F.col(value).alias("va")), rows.select(F.col(key).alias("b"), F.col(value).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("va") - F.col("vb")).alias("difference"))


def bootstrap_weights(keys: np.ndarray, first: int, draws: int) -> np.ndarray:
    """Poisson(1) weights of the 64-bit keys (rows) in draws first to first + draws - 1, by SplitMix64 of key and draw; one key has one weight in a draw, whatever the condition."""
    z = keys.astype(np.uint64)[:, None] + np.arange(first, first + draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)  # Fixed values: the Poisson(1) distribution.
    out = np.zeros(u.shape, np.uint8)
    for s in steps:
        out += u >= np.uint32(s * 2**32)
    return out


def bootstrap_auroc(rows: DataFrame, by: list[str], cluster: str, draws: int, seed: str, block: int = 1000) -> DataFrame:
    """Weighted AUROC per group and draw; all rows of a cluster share its weight. null where a draw lacks a class.

    A task has one group and one block of draws. It goes over the rows in batches and
    keeps the weights summed per distinct score, so no draw of a row is ever shuffled.
    """
    shape = T.StructType([rows.schema[c] for c in by] + [T.StructField("draw", T.IntegerType()), T.StructField("auroc", T.DoubleType())])
    arrow = to_arrow_schema(shape)

    def drawn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key[-1].as_py() * block + 1
        n = min(block, draws - first + 1)
        place: dict[float, int] = {}
        sums = [np.zeros((64, n), np.int64), np.zeros((64, n), np.int64)]
        for batch in batches:
            keys, scores, truth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_key", "score", "truth"))
            order = np.lexsort((truth, scores))
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                x, t = scores[at], truth[at]
                starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (t[1:] != t[:-1])])
                for k, total in zip(starts, np.add.reduceat(bootstrap_weights(keys[at], first, n), starts, axis=0, dtype=np.int64)):
                    j = place.setdefault(float(x[k]), len(place))
                    if j >= len(sums[0]):
                        sums = [np.concatenate([m, np.zeros_like(m)]) for m in sums]
                    sums[int(t[k])][j] += total
        up = [place[x] for x in sorted(place)]
        neg, pos = (m[up] for m in sums)
        both = (pos.sum(0) * neg.sum(0)).astype(float)
        area = (pos * (np.cumsum(neg, 0) - neg / 2)).sum(0)
        found = pa.array(np.divide(area, both, out=np.zeros(n), where=both > 0), mask=both == 0)
        same = [pa.array([k.as_py()] * n, arrow.field(c).type) for c, k in zip(by, key)]
        yield pa.RecordBatch.from_arrays([*same, pa.array(range(first, first + n), pa.int32()), found], schema=arrow)

    kept = rows.where(F.col(cluster).isNotNull() & F.col("score").isNotNull() & F.col("truth").isNotNull())
    key = F.xxhash64(F.lit(seed), F.col(cluster).cast("string")).alias("_key")
    spread = kept.select(*by, key, F.col("score").cast("double").alias("score"), F.col("truth").cast("int").alias("truth"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // block))).alias("_block"))
    return spread.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by, "_block").groupBy(*by, "_block").applyInArrow(drawn, shape)


def intervals(draws: DataFrame, by: list[str], value: str, alpha: float = 0.05, centre: float = 0.5) -> DataFrame:
    """Mean, median and percentile interval over the draws, and the two-sided share of draws across the centre."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2)))
    a = draws.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("draws"), F.avg(value).alias("mean"), q.alias("q"), F.avg((F.col(value) >= centre).cast("double")).alias("up"), F.avg((F.col(value) <= centre).cast("double")).alias("down"))
    return a.select(*by, "draws", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), F.least(F.lit(1.0), 2 * F.least("up", "down")).alias("p_value"))


def draw_summary(draws: DataFrame, candidate: str, value: str) -> DataFrame:
    """Per candidate over the draws: mean, expected rank, and how often it is best and among the best two."""
    ranked = ranks(draws, ["draw"], value, "_r")
    return ranked.groupBy(candidate).agg(F.avg(value).alias("mean"), F.avg("_r").alias("expected_rank"), F.avg((F.col("_r") == 1).cast("double")).alias("p_best"), F.avg((F.col("_r") <= 2).cast("double")).alias("p_top2"))
