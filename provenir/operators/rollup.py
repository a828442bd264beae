"""Occurrences to file scores, threshold support, and scoring each distinct source once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import warned

FILE_KEY = ["snapshot_id", "relative_path", "file_key"]


def with_file_key(df: DataFrame) -> DataFrame:
    """The file hash in lower case as file_key."""
    return df.withColumn("file_key", F.lower("file_sha256"))


def distinct_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences without rows delivered twice: one per file and code unit, whatever the hash's case.

    Where the repeats differ, each column has its least value that isn't null.
    """
    keyed, key = with_file_key(occurrences), [*FILE_KEY, "code_unit_id"]
    return keyed.groupBy(*key).agg(*(F.min(c).alias(c) for c in keyed.columns if c not in key))


def distinct_files(files: DataFrame) -> DataFrame:
    """Files without rows delivered twice; a non-null status wins over null, then the least."""
    keyed = with_file_key(files)
    return keyed.groupBy(*FILE_KEY).agg(F.min("dataset_source").alias("dataset_source"), F.min("repo_name").alias("repo_name"), F.min("parse_status").alias("parse_status"), F.max("physical_line_count").alias("physical_line_count"))


def file_rollup(files: DataFrame, occurrences: DataFrame, threshold: float = 0.5, any_warning_text: bool = False) -> DataFrame:
    """One row per file: counts, shares by count and by weight, status and selection.

    Files without occurrences have zero counts. The weighted share is null
    where the weights sum to 0; a file is selected only if its share is
    strictly above the threshold, and selection is null unless it is scored.
    """
    agc = F.col("predicted_agc") == 1
    weight = F.coalesce("npr_body_space_by_token_count", F.lit(0))
    sums = distinct_occurrences(occurrences).groupBy(*FILE_KEY).agg(
        F.count("*").alias("units"), F.count_if(agc).alias("agc_units"), F.sum(weight).alias("tokens"), F.sum(F.when(agc, weight).otherwise(0)).alias("agc_tokens"),
        F.count_if(warned("a05_mapping_warning", any_warning_text)).alias("warnings"), F.avg("human_decision_score").alias("mean_score"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "agc_units", "tokens", "agc_tokens", "warnings")]
    rows = distinct_files(files).join(sums, FILE_KEY, "left").select(*FILE_KEY, "dataset_source", "repo_name", "parse_status", "physical_line_count", *zero, "mean_score")
    status = F.when(F.coalesce("parse_status", F.lit("")) != "prepared", "file_not_prepared").when(F.col("units") == 0, "no_units").otherwise("scored")
    share = F.try_divide("agc_tokens", F.nullif("tokens", F.lit(0)))
    return rows.withColumn("status", status).withColumn("count_share", F.try_divide("agc_units", F.nullif("units", F.lit(0)))).withColumn("weighted_share", share).withColumn(
        "selected", F.when(F.col("status") == "scored", F.coalesce((F.col("weighted_share") > threshold).cast("int"), F.lit(0))))


def threshold_support(files: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Per threshold, for all sources (null) and each: scored files, those above it, and ties."""
    scored = files.where("status = 'scored'").select("dataset_source", "weighted_share", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    above = F.col("weighted_share") > F.col("threshold")
    tie = F.abs(F.col("weighted_share") - F.col("threshold")) <= 1e-15
    return scored.groupingSets([["threshold"], ["threshold", "dataset_source"]], "threshold", "dataset_source").agg(
        F.count("*").alias("files"), F.count_if(above).alias("selected"), F.count_if(tie).alias("ties"), F.grouping("dataset_source").alias("all_sources"))


def orphans(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences whose file is in no row of files."""
    return distinct_occurrences(occurrences).join(distinct_files(files).select(*FILE_KEY), FILE_KEY, "left_anti")


def unique_sources(occurrences: DataFrame) -> DataFrame:
    """One row per distinct source hash: how often it occurs and its first occurrence's attributes."""
    keyed = occurrences.where("ml_source_sha256 is not null").withColumn("source_key", F.lower(F.trim("ml_source_sha256")))
    first = F.struct("snapshot_time", "snapshot_id", "relative_path", "code_unit_id")
    return keyed.groupBy("source_key").agg(F.count("*").alias("occurrences"), F.count_distinct("repo_name").alias("repositories"), F.min(first).alias("f")).select("source_key", "occurrences", "repositories", "f.snapshot_id", "f.relative_path", "f.code_unit_id")


def score_once(rows: DataFrame, text: str, score: Column) -> DataFrame:
    """rows with score computed once for each distinct text and joined back; null texts keep a null score."""
    keyed = rows.withColumn("text_sha256", F.sha2(text, 256))
    scored = keyed.where(F.col(text).isNotNull()).dropDuplicates(["text_sha256"]).select("text_sha256", score.alias("score"))
    return keyed.join(scored, "text_sha256", "left")


def conservation_checks(files: DataFrame, occurrences: DataFrame, rollup: DataFrame) -> DataFrame:
    """Named checks with observed and expected numbers: sums conserved, keys unique, no orphan, rules kept."""
    occ = distinct_occurrences(occurrences)
    a = rollup.agg(
        F.count("*").alias("rows"), F.sum("units").alias("units"), F.sum("tokens").alias("tokens"), F.count_if(F.col("agc_units") > F.col("units")).alias("agc_above"),
        F.count_if((F.col("status") == "scored") & (F.col("units") == 0)).alias("scored_empty"), F.count_if((F.col("status") != "scored") & F.col("selected").isNotNull()).alias("selected_unscored"),
        F.count_if((F.col("weighted_share") < 0) | (F.col("weighted_share") > 1)).alias("share_outside"))
    matched = occ.join(distinct_files(files).select(*FILE_KEY), FILE_KEY, "left_semi").agg(F.count("*").alias("m_units"), F.coalesce(F.sum("npr_body_space_by_token_count"), F.lit(0)).alias("m_tokens"))
    keys = distinct_files(files).agg(F.count("*").alias("k"))
    lost = orphans(occurrences, files).agg(F.count("*").alias("lost"))
    one = a.withColumn("j", F.lit(1)).join(matched.withColumn("j", F.lit(1)), "j").join(keys.withColumn("j", F.lit(1)), "j").join(lost.withColumn("j", F.lit(1)), "j")
    checks = F.array(*[
        F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(o).cast("bigint").alias("observed"), (F.col(e) if isinstance(e, str) else F.lit(e)).cast("bigint").alias("expected"))
        for n, s, o, e in (("files_conserved", "hard", "rows", "k"), ("units_conserved", "hard", "units", "m_units"), ("tokens_conserved", "hard", "tokens", "m_tokens"), ("agc_within_units", "hard", "agc_above", 0), ("scored_has_units", "hard", "scored_empty", 0), ("selection_only_scored", "hard", "selected_unscored", 0), ("share_in_range", "hard", "share_outside", 0), ("no_orphans", "soft", "lost", 0))
    ])
    return one.select(F.explode(checks).alias("c")).select("c.*", (F.col("c.observed") == F.col("c.expected")).cast("int").alias("passed"))
