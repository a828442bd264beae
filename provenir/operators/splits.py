"""Seeded orders, samples and train, dev and test splits; a hash order stands in for a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.functions.hashing import rank_key, seeded
from provenir.operators.pairs import with_positions
from provenir.runtime import cut


def top_per_stratum(rows: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """The k rows of each stratum with the least seeded hash, and their rank."""
    order = Window.partitionBy(stratum).orderBy(rank_key(seed, key), key)
    return rows.withColumn("stratum_rank", F.row_number().over(order)).where(F.col("stratum_rank") <= k)


def sample(rows: DataFrame, key: str, k: int, seed: str) -> DataFrame:
    """The k rows with the least seeded hash; fewer rows than k is an error."""
    kept = rows.withColumn("_h", seeded(seed, key)).orderBy("_h", key).limit(k).drop("_h")
    found = kept.count()
    if found < k:
        raise ValueError(f"wanted {k} rows, there are {found}")
    return kept


def interleave(rows: DataFrame, stratum: str, rank: str) -> DataFrame:
    """Rows in turn from each stratum, as positions from 1."""
    return with_positions(rows, [rank, stratum], "position")


def even_positions(total: int, k: int) -> list[int]:
    """k positions from 1 to total, evenly spread, halves rounded to even."""
    return [1] if k == 1 else [1 + round(i * (total - 1) / (k - 1)) for i in range(k)]


def by_fraction(rows: DataFrame, group: str, key: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """A split per row: the seeded order of each group cut at the running shares."""
    # places inside a group come from places in all, so a group is never one task
    placed = with_positions(rows.withColumn("_h", seeded(seed, key)), [group, "_h", key], "_at")
    sizes = placed.groupBy(group).agg(F.min("_at").alias("_first"), F.count("*").alias("_size")).withColumnRenamed(group, "_group")
    placed = placed.join(sizes, placed[group].eqNullSafe(sizes["_group"]))
    place = (F.col("_at") - F.col("_first")) / F.col("_size")
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = (F if out is None else out).when(place < edge - 1e-12, name)
    return placed.withColumn("split", out.otherwise(list(shares)[-1])).select(*rows.columns, "split")


def by_pair(pairs: DataFrame, key: str, seed: str, shares: dict[str, float]) -> DataFrame:
    """A split per pair, so both halves stay together: the seeded hash as a number in [0, 1) against the running shares."""
    u = F.conv(F.substring(seeded(seed, key), 1, 12), 16, 10).cast("double") / float(16**12)
    out, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        out = (F if out is None else out).when(u < edge, name)
    return pairs.withColumn("split", out.otherwise(list(shares)[-1]))


def by_complexity(ranked: DataFrame, rank: str, key: str, seed: str, block: int = 10, dev: int = 1, test: int = 1, strict: bool = False) -> DataFrame:
    """Blocks of neighbours in rank; in each whole block the seeded order gives dev and test their rows, train the rest.

    Rows of a last block that isn't whole are left out, or with strict are an error.
    """
    if strict and (rest := ranked.count() % block):
        raise ValueError(f"{rest} rows beyond whole blocks of {block}")
    blocked = ranked.withColumn("block", F.floor((F.col(rank) - 1) / block).cast("int"))
    w = Window.partitionBy("block")
    placed = blocked.withColumn("_p", F.row_number().over(w.orderBy(seeded(seed, key), key))).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == block)
    return placed.withColumn("split", F.when(F.col("_p") <= dev, "dev").when(F.col("_p") <= dev + test, "test").otherwise("train")).drop("_p", "_n")


def nested_sizes(ranked: DataFrame, rank: str, sizes: tuple[int, ...]) -> DataFrame:
    """Each row once for every size whose prefix of the ranking holds it."""
    return ranked.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col(rank) <= F.col("size"))


def fixed_eval(ranked: DataFrame, key: str, rank: str, dev: int, test: int, sizes: tuple[int, ...], seed: str) -> DataFrame:
    """(size, key, role): for every size the same dev and test rows, set apart by seeded order, and the first size of the other rows by rank as train; too few rows is an error."""
    rows = cut(ranked.select(key, rank), "fixed")
    apart = cut(sample(rows, key, dev + test, seed), "apart")
    held = apart.select(key, F.when(F.row_number().over(Window.orderBy(seeded(seed, key), key)) <= dev, "dev").otherwise("test").alias("role"), F.lit(0).alias("_k"))
    rest = cut(rows.join(apart.select(key), key, "left_anti").orderBy(rank, key).limit(max(sizes)), "rest")
    if (found := rest.count()) < max(sizes):
        raise ValueError(f"wanted {max(sizes)} rows to train on, there are {found}")
    train = rest.select(key, F.lit("train").alias("role"), F.row_number().over(Window.orderBy(rank, key)).alias("_k"))
    return held.union(train).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("_k <= size").select("size", key, "role")


def stratified_pick(binned: DataFrame, bin_column: str, key: str, quality: str, total: int, seed: str) -> DataFrame:
    """total rows over the bins there are (the first get the remainder), picked by seeded order among each bin's best 2 x take by quality.

    What small bins leave short is filled up from all other rows in seeded order; fewer rows than total is an error.
    """
    rows = cut(binned, "binned")
    found = sorted(r[0] for r in rows.where(F.col(bin_column).isNotNull()).select(bin_column).distinct().collect())
    base, more = divmod(total, max(1, len(found)))
    take = F.lit(base) + F.col(bin_column).isin(found[:more]).cast("int")
    best = Window.partitionBy(bin_column).orderBy(quality, key)
    pool = rows.where(F.col(bin_column).isNotNull()).withColumn("_take", take).withColumn("_q", F.row_number().over(best)).where(F.col("_q") <= 2 * F.col("_take"))
    placed = pool.withColumn("_p", F.row_number().over(Window.partitionBy(bin_column).orderBy(seeded(seed, key), key)))
    picked = cut(placed.where(F.col("_p") <= F.col("_take")).drop("_take", "_q", "_p"), "picked")
    short = total - picked.count()
    return picked if not short else picked.union(sample(rows.join(picked.select(key), key, "left_anti").select(*rows.columns), key, short, seed))
