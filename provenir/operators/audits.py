"""Audits of tables: written results read again, contracts, pair shape, staged pre-checks and metrics held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.operators.pairs import with_positions
from provenir.runtime import cut


def first_fault(stages: dict[str, Column]) -> Column:
    """The name of the first stage whose condition holds, in the order given; '' for none."""
    out = None
    for name, failed in stages.items():
        out = (F if out is None else out).when(F.coalesce(failed, F.lit(False)), name)
    return out.otherwise("") if out is not None else F.lit("")


def verified(result: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """result written to the shared folder and read again: (check, observed, expected, passed) of its rows, keys and sums."""
    stored = cut(result, "verified")
    kinds = lambda df: df.select(F.count("*").cast("double").alias("rows"), F.count_distinct(F.struct(*keys)).cast("double").alias("distinct_keys"), *(F.sum(c).cast("double").alias(f"sum_{c}") for c in sums))
    seen, made = kinds(stored).withColumn("_k", F.lit("observed")), kinds(result).withColumn("_k", F.lit("expected"))
    names = ["rows", "distinct_keys", *(f"sum_{c}" for c in sums)]
    long = seen.union(made).select("_k", F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.round(F.coalesce(F.col(n), F.lit(0.0)), 4).alias("v")) for n in names))).alias("c"))
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col("c.v")))
    return long.groupBy("c.check").agg(pick("observed").alias("observed"), pick("expected").alias("expected")).withColumn("passed", (F.col("observed") == F.col("expected")).cast("int"))


def contract(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(column, wanted, found, nulls, passed) for every column a table must have and its type (nulls is -1 where it is missing); one pass over the table."""
    found = dict(df.dtypes)
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns if c in found))
    nulls = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("wanted"), F.lit(found.get(c)).alias("found"), (F.col(c) if c in found else F.lit(-1).cast("bigint")).alias("nulls")) for c, t in columns.items()))).alias("r")).select("r.*")
    return nulls.withColumn("passed", F.coalesce(F.col("wanted") == F.col("found"), F.lit(False)).cast("int"))


def same_metadata(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(column, values, groups, equal): whether every group has the same set of values; the sets of a column are compared by digests of their sorted values."""
    long = rows.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))).alias("v")).select(group, "v.*").distinct()
    sides = long.groupBy("column", group).agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("digest"))
    return sides.groupBy("column").agg(F.max("n").alias("values"), F.count("*").alias("groups"), (F.count_distinct("digest") == 1).cast("int").alias("equal"))


def alternation(rows: DataFrame, order: list[str], idx: str, label: str) -> DataFrame:
    """(pair_id, faults) of the pairs whose rows, in the order given, aren't a human row and right behind it its machine row."""
    placed = with_positions(rows, order, "_n").withColumn("_pair", F.floor((F.col("_n") + 1) / 2))
    human = F.col("_n") % 2 == 1
    g = placed.groupBy("_pair").agg(F.max(F.when(human, F.col(idx))).alias("h"), F.max(F.when(~human, F.col(idx))).alias("m"), F.max(F.when(human, F.col(label))).alias("hl"), F.max(F.when(~human, F.col(label))).alias("ml"))
    base = lambda c, end: F.regexp_replace(c, f"{end}$", "")
    fault = first_fault({
        "odd_count": F.col("m").isNull(), "not_human": ~F.col("h").endswith("_human"), "not_machine": ~F.col("m").endswith("_lm"),
        "label": (F.trim("hl") != "human") | (F.trim("ml") != "lm") | F.col("hl").isNull() | F.col("ml").isNull(), "pair": base(F.col("h"), "_human") != base(F.col("m"), "_lm"),
    })
    return g.select(base(F.col("h"), "_(human|lm|ai)").alias("pair_id"), fault.alias("fault")).where("fault <> ''")


def complete_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, kept): a column with any null or not-a-number is no feature. One pass; a plan picks its features from this."""
    bad = {c: F.count_if(F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False))) for c, t in df.dtypes if c in columns}
    one = df.agg(*(v.alias(c) for c, v in bad.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in bad))).alias("r")).select("r.*").withColumn("kept", (F.col("missing") == 0).cast("int"))


def chunk_fingerprints(rows: DataFrame, order: list[str], value: str, size: int) -> DataFrame:
    """(chunk, rows, fingerprint): the SHA-256 of the values of every size rows in a total order, joined by line feeds; a chunk is never larger."""
    placed = with_positions(rows, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v")))), lambda x: x["v"]), "\n")
    return placed.groupBy("chunk").agg(F.count("*").alias("rows"), F.sha2(said, 256).alias("fingerprint"))


def vocabulary(words: DataFrame, word: str, least: int) -> DataFrame:
    """(word, index) of the words that stand least times or more: the commonest first, ties by the word, from 0."""
    counts = words.where(F.col(word).isNotNull()).groupBy(word).agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("_up", -F.col("n"))
    return with_positions(counts, ["_up", word], "index").select(word, (F.col("index") - 1).cast("int").alias("index"))


def largest_key(keys: DataFrame, key: str, prefix: str) -> DataFrame:
    """The key with the prefix and the largest number behind an underscore, the last in order of equals."""
    size = F.expr(f"try_cast(nullif(regexp_extract(`{key}`, '_([0-9]+)(?:_|$)', 1), '') as bigint)")
    kept = keys.where(F.col(key).startswith(prefix)).withColumn("size", F.coalesce(size, F.lit(-1)))
    return kept.agg(F.max_by(key, F.struct("size", key)).alias("key"), F.max("size").alias("size")).where("key is not null")


def latest_per(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in a total order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")
