"""Problem 6: splits that keep tied records together, by largest-differencing balance.

Lines are tied where their checkpoints carry the same human function hash,
whatever its spelling; groups are the connected components. A group is never
torn. Groups are dealt into cells of about CELL groups; leading buckets with
that many groups have cells of their own, the others share cells. In a cell
the largest-differencing method merges, again and again, the two partial
partitions with the widest spread, heavy bins with light ones, until nearly
equal bins are left; whole bins then go to the splits in proportion to what
each still wants of the cell's bucket, and are moved or exchanged while that
brings the cell nearer to its share of all buckets.

Only a group that outweighs a bin of its cell, and holds more than
1 / GIANTS of all records, so that one cell couldn't make up for it, is placed
before, where its buckets are most wanted. There are at most GIANTS of them.

Rows without line_no or tag are no records; records delivered twice count
once. A line without a readable hash is a group of its own; a null bucket is
a bucket like any other. Splits with a null or negative share get nothing,
and shares are taken relative to their sum. Without a target no line has a split.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.llm._graph import components
from provenir.runtime import cut, table

#: Least and most bins of a cell, groups a cell is meant to hold, and the bound of the number of groups placed one by one.
FEWEST, BINS, CELL, GIANTS = 10, 40, 4000, 1000


def bin_count(groups: float) -> int:
    """Bins of a cell of so many groups: enough for the splits' shares, several groups to a bin where there are."""
    return int(min(BINS, max(FEWEST, groups // 2)))


def _hash(column: str) -> F.Column:
    """The 64 hex digits of a hash in any spelling, lower case; null where there are none."""
    found = F.regexp_extract(F.lower(column), "(?:^|[^0-9a-f])([0-9a-f]{64})(?:$|[^0-9a-f])", 1)
    return F.when(found != "", found)


def tied_lines(records: DataFrame) -> DataFrame:
    """(line_no, group_line_no) of every line that shares a hash with another, directly or over further lines."""
    carried = records.select("line_no", _hash("human_sha256").alias("hash")).where("line_no is not null and hash is not null").distinct()
    least = carried.groupBy("hash").agg(F.min("line_no").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = carried.join(least, "hash").where("line_no <> first")
    return components(edges, "line_no", "first", "p6").select(F.col("node").alias("line_no"), F.col("component").alias("group_line_no"))


def difference(weights: list[int], bins: int) -> list[list[int]]:
    """Numbers of the items in each of so many bins of nearly equal weight, by largest differencing."""
    heap: list[tuple] = []
    for i, w in enumerate(weights):
        heap.append((-w, i, [(0, ())] * (bins - 1) + [(w, (i,))]))
    heapq.heapify(heap)
    turn = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b))), key=lambda x: x[0])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], turn, merged))
        turn += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else [(0, ())] * bins:
        items, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, int):
                items.append(x)
            else:
                stack.extend(x)
        out.append(items)
    return out


def _deal(wanted: np.ndarray, bins: int, turn: float) -> np.ndarray:
    """A split for each bin in proportion to wanted; turn in [0, 1) moves the rounding from cell to cell."""
    edges = np.cumsum(wanted / wanted.sum()) if wanted.sum() > 0 else np.ones(len(wanted))
    spots = ((np.arange(bins) + turn) / bins) % 1.0
    order = np.random.default_rng(bins).permutation(bins)  # light and heavy bins alike to every split
    return np.searchsorted(edges[:-1], spots, side="right")[order]


def settle(parts: np.ndarray, splits: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Move or exchange whole bins while that brings the splits nearer to their share of every bucket.

    parts has a row for each bin with its records by bucket; the distance is
    the sum of squared differences over splits and buckets, and over all records.
    """
    parts = np.column_stack([parts, parts.sum(axis=1)]).astype(float)
    splits, k = splits.copy(), len(shares)
    off = np.stack([parts[splits == s].sum(axis=0) for s in range(k)]) - np.outer(shares, parts.sum(axis=0))
    norm = (parts**2).sum(axis=1)
    for _ in range(20 * len(parts)):
        reach = parts @ off.T  # bins x splits
        own = reach[np.arange(len(parts)), splits]
        move = 2 * (reach - own[:, None]) + 2 * norm[:, None]
        move[np.arange(len(parts)), splits] = 0
        dots = parts @ parts.T
        there = reach[:, splits]  # bin i against the split of bin j
        swap = 2 * (there - own[:, None] + there.T - own[None, :]) + 2 * (norm[:, None] + norm[None, :] - 2 * dots)
        swap[splits[:, None] == splits[None, :]] = 0
        if min(move.min(), swap.min()) > -1e-6:
            break
        if move.min() <= swap.min():
            i, s = np.unravel_index(move.argmin(), move.shape)
            steps = [(i, s)]
        else:
            i, j = np.unravel_index(swap.argmin(), swap.shape)
            steps = [(i, splits[j]), (j, splits[i])]
        for i, s in steps:
            off[splits[i]] -= parts[i]
            off[s] += parts[i]
            splits[i] = s
    return splits


def _place_giants(giants: list, totals: dict[str, int], shares: np.ndarray) -> tuple[dict, dict[str, np.ndarray]]:
    """The split of each giant, and what each split still wants of every bucket."""
    wants = {b: shares * n for b, n in totals.items()}
    place = {}
    for g in sorted(giants, key=lambda g: (-g["weight"], g["group_line_no"])):
        parts = {x["bucket"]: x["n"] for x in g["buckets"]}
        worth = [sum(min(0.0, wants[b][s] - n) for b, n in parts.items()) for s in range(len(shares))]
        best = max(range(len(shares)), key=lambda s: (worth[s], shares[s]))
        place[g["group_line_no"]] = best
        for b, n in parts.items():
            wants[b][best] -= n
    return place, {b: np.maximum(w, 0) for b, w in wants.items()}


def assign_splits(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(line_no, group_line_no, split) for every line of records (line_no, tag, human_sha256, bucket).

    targets has split and target_share, a few rows that fit the driver.
    """
    shares = sorted((r["split"], float(r["target_share"])) for r in targets.collect() if r["split"] is not None and (r["target_share"] or 0) > 0)
    rows = records.where("line_no is not null and tag is not null")
    rows = rows.groupBy("line_no", "tag").agg(F.min(F.coalesce("bucket", F.lit(""))).alias("bucket"))
    ties = tied_lines(records)
    lines = rows.join(ties, "line_no", "left").withColumn("group_line_no", F.coalesce("group_line_no", "line_no"))
    per_bucket = lines.groupBy("group_line_no", "bucket").agg(F.count("*").alias("n"))
    groups = per_bucket.groupBy("group_line_no").agg(F.sum("n").alias("weight"), F.max_by("bucket", F.struct("n", "bucket")).alias("lead"), F.collect_list(F.struct("bucket", "n")).alias("buckets"))
    groups = cut(groups, "p6-groups")
    totals = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    total = sum(totals.values())
    if not shares or not total:
        return lines.select("line_no", "group_line_no", F.lit(None).cast("string").alias("split")).distinct()
    names, share = [s for s, _ in shares], np.array([x for _, x in shares])
    share = share / share.sum()

    # (groups, records) by the leading bucket, a row a bucket; leads with few groups share cells
    sizes = {r["lead"]: (r["n"], r["w"]) for r in groups.groupBy("lead").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    pools: dict[str | None, tuple[int, int]] = {}
    for lead, (n, w) in sizes.items():
        own = lead if n >= CELL else None
        pools[own] = tuple(x + y for x, y in zip(pools.get(own, (0, 0)), (n, w)))
    cells = {lead: math.ceil(n / CELL) for lead, (n, _) in pools.items()}
    outweighs = {lead: max(total / GIANTS, w / cells[lead] / bin_count(n / cells[lead])) for lead, (n, w) in pools.items()}
    of_lead = lambda values: F.element_at(F.create_map(*[F.lit(x) for lead in sizes for x in (lead, values[lead if lead in pools else None])]), F.col("lead"))
    groups = groups.withColumn("giant", F.col("weight") > of_lead(outweighs))
    place, wants = _place_giants(groups.where("giant").collect(), totals, share)
    pool = F.when(F.col("lead").isin([x for x in pools if x is not None]), F.col("lead"))
    dealt = groups.where("not giant").select("*", pool.alias("pool"), F.pmod(F.xxhash64("group_line_no"), of_lead(cells)).alias("cell"))

    def balance(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weight", "group_line_no"], ascending=[False, True])
        count = bin_count(len(part))
        bins = difference(part["weight"].tolist(), count)
        turn = (key[1] * 0.6180339887498949 + sum(map(ord, key[0] or "")) * 0.3819660112501051) % 1.0
        column = {b: i for i, b in enumerate(sorted(totals))}
        held = np.zeros((count, len(column)))
        buckets = part["buckets"].tolist()
        for row, items in zip(held, bins):
            for x in (x for i in items for x in buckets[i]):
                row[column[x["bucket"]]] += x["n"]
        mix = held.sum(axis=0)
        wanted = sum((mix[i] * wants[b] / max(1.0, wants[b].sum()) for b, i in column.items()), np.zeros(len(share)))
        wanted = wanted if wanted.sum() > 0 else share
        splits = np.empty(len(part), np.int64)
        for items, s in zip(bins, settle(held, _deal(wanted, count, turn), wanted / wanted.sum())):
            splits[items] = s
        return pd.DataFrame({"group_line_no": part["group_line_no"].to_numpy(), "split": [names[s] for s in splits]})

    kind = dict(lines.dtypes)["group_line_no"]
    chosen = dealt.groupBy("pool", "cell").applyInPandas(balance, f"group_line_no {kind}, split string")
    if place:
        chosen = chosen.union(records.sparkSession.createDataFrame([(g, names[s]) for g, s in place.items()], f"group_line_no {kind}, split string"))
    return lines.select("line_no", "group_line_no").distinct().join(chosen, "group_line_no").select("line_no", "group_line_no", "split")


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "checkpoints").select("line_no", "tag", "human_sha256", "bucket")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the assignment keeps together with others."""
    assigned = p6_assignment(spark, sf_dir)
    return assigned.withColumn("lines", F.count("*").over(Window.partitionBy("group_line_no"))).where("lines > 1").select("line_no", "group_line_no")


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(_checkpoints(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every assignment must keep: each line once and with a split, no torn group, and shares within 3 % of all records.

    A split may miss its share by the heaviest group besides.
    """
    placed = cut(p6_assignment(spark, sf_dir), "p6-placed")
    rows = _checkpoints(spark, sf_dir).where("line_no is not null and tag is not null").select("line_no", "tag").distinct().join(placed, "line_no")
    heaviest = rows.groupBy("group_line_no").agg(F.count("*").alias("n")).agg(F.max("n").alias("heaviest"))
    parts = rows.groupBy("split").agg(F.count("*").alias("n"))
    targets = table(spark, sf_dir, "split_targets").select("split", "target_share")
    off = targets.join(parts, "split", "left").crossJoin(rows.agg(F.count("*").alias("total"))).agg(F.max(F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("total"))).alias("off"), F.max("total").alias("total"))
    torn = placed.groupBy("group_line_no").agg(F.count_distinct("split").alias("splits")).agg(F.count_if(F.col("splits") > 1).alias("torn"))
    whole = placed.agg(F.count("*").alias("lines"), F.count_distinct("line_no").alias("distinct_lines"), F.count_if(F.col("split").isNull()).alias("without_split"))
    return whole.crossJoin(torn).crossJoin(off).crossJoin(heaviest).select("lines", "distinct_lines", "without_split", "torn", (F.col("off") <= F.col("total") * 0.03 + F.col("heaviest")).cast("int").alias("shares_met"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bucket (null for all) and split: records, their share of the bucket, and the target."""
    records = _checkpoints(spark, sf_dir)
    targets = table(spark, sf_dir, "split_targets").select("split", "target_share")
    rows = records.where("line_no is not null and tag is not null").groupBy("line_no", "tag").agg(F.min(F.coalesce("bucket", F.lit("none"))).alias("bucket"))
    placed = rows.join(assign_splits(records, targets), "line_no")
    cube = placed.groupingSets([["split"], ["bucket", "split"]], "bucket", "split").agg(F.count("*").alias("records"))
    return cube.join(targets, "split").withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy("bucket"))).select("bucket", "split", "records", "share", "target_share")
