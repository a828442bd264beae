"""Matching inside a file: by position with a fallback by name, and by the smallest enclosing range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positional(blocks: DataFrame, truth: DataFrame) -> DataFrame:
    """blocks (file, block_idx, name) with the truth row (file, block_idx, name, label) of the same place and name.

    What has no such row takes, in order, the truth rows of its name that are
    left over: the n-th open block of a name gets the n-th open row. Blocks
    without either keep null.
    """
    t = truth.select("file", F.col("block_idx").alias("truth_idx"), F.col("name").alias("truth_name"), "label")
    same = blocks.join(t, (blocks["file"] == t["file"]) & (blocks["block_idx"] == t["truth_idx"]) & (blocks["name"].eqNullSafe(t["truth_name"]))).select(blocks["file"], "block_idx", "name", "truth_idx", "label", F.lit("position").alias("match"))
    open_blocks = blocks.join(same.select("file", "block_idx"), ["file", "block_idx"], "left_anti")
    open_truth = t.join(same.select("file", "truth_idx"), ["file", "truth_idx"], "left_anti")
    nth = lambda name, order: F.row_number().over(Window.partitionBy("file", name).orderBy(order))
    b = open_blocks.select("file", "block_idx", "name").withColumn("_n", nth("name", "block_idx"))
    u = open_truth.withColumn("_n", nth("truth_name", "truth_idx")).withColumnRenamed("truth_name", "name")
    rest = b.join(u, ["file", "name", "_n"], "left").select("file", "block_idx", "name", "truth_idx", "label", F.when(F.col("truth_idx").isNotNull(), "name").alias("match"))
    return same.unionByName(rest)


def enclosing(ranges: DataFrame, by: list[str], key: str) -> DataFrame:
    """For each range (key, start_line, end_line) the smallest other range of its file that contains it; ties are no match.

    A file's ranges are gone through in order with a stack of those still open, so the work is linear where ranges nest.
    """
    kinds = dict(ranges.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{key}` {kinds[key]}", f"outer {kinds[key]}"])

    def nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, open_ = None, []
        for batch in batches:
            found = []
            for *where, k, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if where != file:
                    file, open_ = where, []
                open_ = [x for x in open_ if x[2] >= s]
                around = [x for x in open_ if x[2] >= e and (x[1], x[2]) != (s, e)]
                if around:
                    least = min(x[2] - x[1] for x in around)
                    best = [x[0] for x in around if x[2] - x[1] == least]
                    if len(best) == 1:
                        found.append((*where, k, best[0]))
                open_.append((k, s, e))
            made = [pa.array([f[i] for f in found], batch.schema.field(min(i, len(by))).type) for i in range(len(by) + 2)]
            yield pa.RecordBatch.from_arrays(made, [*by, key, "outer"])

    kept = ranges.where("start_line is not null and end_line is not null").where(" and ".join(f"`{c}` is not null" for c in by)).select(*by, key, "start_line", "end_line")
    return kept.repartition(*by).sortWithinPartitions(*by, "start_line", F.desc("end_line"), key).mapInArrow(nested, shape)


def unused(rows: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of which no key occurs in the history: one anti-join per key, nulls excluding nothing."""
    for k in keys:
        rows = rows.join(history.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows
