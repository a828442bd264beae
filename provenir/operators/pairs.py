"""Human and machine halves of pairs: validation, pivots, eligibility, ranks and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.functions.text import line_count, normal_label, pair_id, pair_label, space_weight
from provenir.operators.quantiles import exact_quantiles, running_totals


def halves(code_pairs: DataFrame) -> DataFrame:
    """pair_id, label and code of each half, once; the label from the column, else from idx, and the latest delivery."""
    rows = code_pairs.where("idx is not null").withColumn("side", F.coalesce(normal_label("label"), pair_label("idx")))
    last = F.struct("written_at", F.coalesce("code", F.lit("")), F.coalesce("split", F.lit("")), F.coalesce("model", F.lit("")))
    return rows.groupBy("idx").agg(F.max_by(F.struct("side", "code", "split", "model"), last).alias("r")).select("idx", pair_id("idx").alias("pair_id"), F.col("r.side").alias("side"), F.col("r.code").alias("code"), F.col("r.split").alias("split"), F.col("r.model").alias("model"))


def resolved_labels(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """rows with side: from the column label where there is one, else from idx where every suffix tells, else from the column actual_label as 1 or 0, else an error."""
    if "label" in rows.columns:
        return rows.withColumn("side", normal_label("label"))
    if rows.where(pair_label(idx).isNull()).limit(1).count() == 0:
        return rows.withColumn("side", pair_label(idx))
    if "actual_label" in rows.columns:
        known = F.expr("try_cast(actual_label as int)")
        return rows.withColumn("side", F.when(known == 1, "human").when(known == 0, "lm").otherwise(F.raise_error(F.concat(F.lit("label: "), F.col("actual_label").cast("string"))).cast("string")))
    raise ValueError("neither a label, nor a suffix in every idx, nor actual_label")


def pair_faults(rows: DataFrame) -> DataFrame:
    """Pairs that are not exactly one human and one lm half, with what is wrong."""
    g = rows.groupBy("pair_id").agg(F.count("*").alias("halves"), F.count_if(F.col("side") == "human").alias("humans"), F.count_if(F.col("side") == "lm").alias("machines"), F.count_distinct("split").alias("splits"))
    fault = F.array_compact(F.array(F.when(F.col("halves") != 2, "half_count"), F.when((F.col("humans") != 1) | (F.col("machines") != 1), "labels"), F.when(F.col("splits") > 1, "split")))
    return g.withColumn("faults", F.array_join(fault, ";")).where("faults <> ''")


def pair_table(rows: DataFrame) -> DataFrame:
    """One row per whole pair: both halves' lines and literal-space tokens, their maxima and ratio. Nothing is joined."""
    human, lm = F.col("side") == "human", F.col("side") == "lm"
    sized = rows.where("code is not null").withColumn("lines", line_count("code")).withColumn("tokens", space_weight("code"))
    pick = lambda c, side: F.max(F.when(side, F.col(c)))
    g = sized.groupBy("pair_id").agg(F.count("*").alias("halves"), pick("lines", human).alias("human_lines"), pick("lines", lm).alias("lm_lines"), pick("tokens", human).alias("human_tokens"), pick("tokens", lm).alias("lm_tokens"))
    g = g.where("halves = 2 and human_lines is not null and lm_lines is not null").drop("halves")
    return g.select("*", F.greatest("human_lines", "lm_lines").alias("max_lines"), F.greatest("human_tokens", "lm_tokens").alias("max_tokens"), F.try_divide(F.greatest("human_tokens", "lm_tokens"), F.greatest(F.least("human_tokens", "lm_tokens"), F.lit(1))).alias("ratio"))


def eligibility(pairs: DataFrame, least: int, most: int, max_lines: int, max_ratio: float) -> DataFrame:
    """Pairs with the reasons against them joined by semicolons ('' for none) and a quality (less is better)."""
    reasons = F.array_compact(F.array(
        F.when(F.least("human_tokens", "lm_tokens") < least, "too_short"), F.when(F.col("max_tokens") > most, "too_long"), F.when(F.col("max_lines") > max_lines, "too_many_lines"), F.when(F.col("ratio") > max_ratio, "imbalance")))
    target = min(650, most)
    quality = F.abs(F.col("max_tokens") - target) / max(target, 1) + 0.5 * F.abs(F.col("ratio") - 1) + 0.01 * F.col("max_lines")
    return pairs.withColumn("reasons", F.array_join(reasons, ";")).withColumn("quality", quality)


def average_percent_rank(value: str, by: list[str] | None = None) -> Column:
    """Rank over count, ties sharing the mean of their ranks, per group (or over one group)."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*(by or []), value)) - 1) / 2.0) / F.count("*").over(w)


def percent_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """average_percent_rank over all rows without a global sort of rows: ranks come from the counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    total = rows.where(F.col(value).isNotNull()).count()
    ranked = running_totals(counts, [value], "_n", "_below").select(F.col(value).alias("_v"), ((F.col("_below") + (F.col("_n") + 1) / 2.0) / F.lit(total)).alias(out))
    return rows.join(ranked, rows[value] == ranked["_v"], "left").drop("_v")


def complexity(pairs: DataFrame) -> DataFrame:
    """Mean of the average percent ranks of tokens and lines, and the rank by it (ties by size and id)."""
    ranked = percent_ranks(percent_ranks(pairs, "max_tokens", "token_pct"), "max_lines", "line_pct")
    scored = ranked.withColumn("complexity_score", (F.col("token_pct") + F.col("line_pct")) / 2)
    return with_positions(scored, ["complexity_score", "max_tokens", "max_lines", "pair_id"], "complexity_rank")


def with_positions(rows: DataFrame, order: list[str], out: str, desc: bool = False) -> DataFrame:
    """rows numbered from 1 in a total order, by a range partitioning and running counts, not by one global window."""
    from provenir.runtime import cut

    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
    placed = cut(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "positions")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p], before = before, before + sizes[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_part")) if offsets else F.lit(0)
    return placed.withColumn(out, F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + start).drop("_part")


def quantile_bins(rows: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """Bins between the distinct linear quantiles, closed on the right, the least value in bin 0."""
    edges = exact_quantiles(rows, value, [i / bins for i in range(bins + 1)])
    inner = sorted(set(edges) - {None})[1:-1]
    above = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in inner), F.lit(0))
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), above))


def equal_bins(rows: DataFrame, order: list[str], bins: int, out: str) -> DataFrame:
    """Bins of ranks in a total order at the linear quantiles of 1..n, as a cut of first ranks gives them."""
    placed = with_positions(rows, order, "_rank")
    n = placed.count()
    inner = [1 + (n - 1) * k / bins for k in range(1, bins)]
    return placed.withColumn(out, sum((F.when(F.col("_rank") > e, 1).otherwise(0) for e in inner), F.lit(0))).drop("_rank")


def referenced(rows: DataFrame, key: str, ids: DataFrame, one: str, other: str) -> DataFrame:
    """The rows that either side of a table of id pairs names, each once."""
    wanted = ids.select(F.col(one).alias(key)).union(ids.select(F.col(other).alias(key))).distinct()
    return rows.join(wanted, key, "left_semi")
