"""Commit-function events: header aliases, canonical rows, rejects, order and roll-ups by commit and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.functions.hashing import seeded
from provenir.sources.readers import resolve_aliases

# Canonical names and the headers accepted for them, the first present winning; a trailing ? marks those that may be missing.
ALIASES = {
    "manifest_row_number?": ["manifest_row_number", "row_number"], "function_event_id?": ["function_event_id", "event_id"], "dataset_source": ["dataset_source", "source"], "repo_name": ["repo_name", "repository"],
    "time": ["time", "month", "year_month"], "commit": ["commit", "scan_current_commit", "current_commit", "commit_sha"], "parent_commit?": ["parent_commit", "scan_parent_commit"], "commit_order?": ["commit_order"], "relative_path": ["relative_path", "path", "file_path"],
    "qualified_function_name": ["qualified_function_name", "qualified_name"], "function_name?": ["function_name", "name"], "function_kind?": ["function_kind", "kind"], "occurrence_index?": ["occurrence_index"], "change_type": ["change_type", "change"], "start_line?": ["start_line"], "end_line?": ["end_line"],
    "function_source_path?": ["function_source_path", "source_path"], "content_sha256?": ["content_sha256", "sha256"],
}
# Spellings of the two kinds of change.
CHANGES = {"a": "added", "add": "added", "added": "added", "new": "added", "created": "added", "m": "modified", "mod": "modified", "modify": "modified", "modified": "modified", "changed": "modified", "update": "modified", "updated": "modified"}
#: Where a blank or unreadable commit_order sorts.
LAST = 1_000_000_000_000


def canonical(manifest: DataFrame, extra: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Manifest rows under canonical names, trimmed, changes in one spelling, numbers as numbers; unreadable values become null, or with strict an unknown change an error."""
    m = resolve_aliases(manifest, ALIASES, extra)
    clean = {c: F.nullif(F.trim(c), F.lit("")) for c, t in m.dtypes if t == "string"}
    m = m.withColumns(clean)
    said = F.translate(F.lower("change_type"), "- ", "__")
    change = F.element_at(F.create_map(*[F.lit(x) for kv in CHANGES.items() for x in kv]), F.when(said.isin(*CHANGES), said))
    if strict:
        change = F.when(change.isNull() & F.col("change_type").isNotNull(), F.raise_error(F.concat(F.lit("unsupported change_type: "), F.col("change_type"))).cast("string")).otherwise(change)
    number = {c: F.expr(f"try_cast(`{c}` as bigint)") for c in ("commit_order", "occurrence_index", "start_line", "end_line", "manifest_row_number") if c in m.columns}
    return m.withColumns({"change_type": change, "content_sha256": F.lower("content_sha256"), "commit": F.lower("commit"), **number})


def rejects(rows: DataFrame) -> DataFrame:
    """Canonical rows with the faults that keep them out, joined by semicolons ('' for none)."""
    path = F.col("relative_path")
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("time").rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.lit(False)), "month"), F.when(~F.coalesce(F.col("commit").rlike("^[0-9a-f]{7,40}$"), F.lit(False)), "commit"),
        F.when(path.isNull() | path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"), "path"), F.when(F.col("change_type").isNull(), "change_type"), F.when(F.col("content_sha256").isNotNull() & ~F.col("content_sha256").rlike("^[0-9a-f]{64}$"), "sha256"),
        F.when(F.col("repo_name").isNull() | F.col("qualified_function_name").isNull(), "missing")))
    return rows.withColumn("faults", F.array_join(faults, ";"))


def distinct_events(rows: DataFrame) -> DataFrame:
    """One row per event id, or per (repo, commit, path, name, occurrence) where it has none: the least row number."""
    key = F.coalesce("function_event_id", F.concat_ws("\u0001", "repo_name", "commit", "relative_path", "qualified_function_name", F.col("occurrence_index").cast("string")))
    w = Window.partitionBy("_key").orderBy(F.col("manifest_row_number").asc_nulls_last())
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def repeated_events(rows: DataFrame) -> DataFrame:
    return rows.where("function_event_id is not null").groupBy("function_event_id").agg(F.count("*").alias("rows")).where("rows > 1")


#: The order of events; a missing commit_order comes last.
ORDER = ["dataset_source", "repo_name", "time", "order_key", "commit", "relative_path", "qualified_function_name", "occurrence_index"]


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order of events within the repository."""
    keyed = rows.withColumn("order_key", F.coalesce("commit_order", F.lit(LAST)))
    w = Window.partitionBy("repo_name").orderBy(*[F.col(c).asc_nulls_first() for c in ORDER if c != "repo_name"], F.col("manifest_row_number").asc_nulls_first())
    return keyed.withColumn("place", F.row_number().over(w))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Events, kinds of change, distinct functions, files and commits per group, and whether all have a content hash."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_if(F.col("change_type") == "added").alias("added"), F.count_if(F.col("change_type") == "modified").alias("modified"),
        F.count_distinct(F.struct("relative_path", "qualified_function_name")).alias("functions"), F.count_distinct("relative_path").alias("files"), F.count_distinct("commit").alias("commits"),
        F.min((F.col("content_sha256").isNotNull()).cast("int")).alias("complete"), F.sum(F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(0))).alias("lines"))


def panel(months: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repository months with the summary of their latest snapshot; the last of repeated summaries counts; status tells the missing."""
    last = snapshots.groupBy("repo_name", "month").agg(F.max_by(F.struct("snapshot_id", "files", "lines"), F.struct("snapshot_time", "snapshot_id")).alias("s")).select("repo_name", "month", "s.*")
    return months.join(last, ["repo_name", "month"], "left").withColumn("status", F.when(F.col("snapshot_id").isNull(), "missing_snapshot").otherwise("ok"))


def mixed_pilot(rows: DataFrame, edges: dict[str, DataFrame], normals: int, seed: str) -> DataFrame:
    """Edge events by group (the first group of several counts) and, per source, the normal events with the least seeded hash."""
    named = None
    for n, (group, ids) in enumerate(edges.items()):
        part = ids.select("function_event_id").distinct().withColumn("group", F.lit(group)).withColumn("_o", F.lit(n))
        named = part if named is None else named.union(part)
    first = named.groupBy("function_event_id").agg(F.min_by("group", "_o").alias("group"))
    picked = rows.select("function_event_id", "dataset_source").join(first, "function_event_id")
    rest = rows.select("function_event_id", "dataset_source").join(first, "function_event_id", "left_anti")
    w = Window.partitionBy("dataset_source").orderBy(seeded(seed, "function_event_id"), "function_event_id")
    normal = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= normals).select("function_event_id", "dataset_source", F.concat(F.lit("normal_"), F.col("dataset_source")).alias("group"))
    return picked.select("function_event_id", "dataset_source", "group").union(normal)
