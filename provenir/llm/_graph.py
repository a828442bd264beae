"""Connected components for edge tables of any size, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.runtime import cut


def components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reached.

    Alternates the large-star and small-star steps: each replaces a node's
    edges by edges to its least neighbour, so the edge count never grows, and
    the number of rounds is logarithmic in the longest path. Self-loops and
    repeated edges are allowed; edges with a null end are ignored.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = links.select(F.explode(F.array("u", "v")).alias("node"))
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    links = cut(links, f"{name}-edges")
    state = _state(links)
    while True:
        links = cut(_small_star(_large_star(links)), f"{name}-round")
        now = _state(links)
        if now == state:
            break
        state = now
    least = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    return nodes.distinct().join(least, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """For every node: its larger neighbours are linked to its least neighbour (or itself)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """For every node: it and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
