"""Queries of the audits, score rules, continuations and reports, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions import code, continuation, text, transforms
from provenir.operators import audits, checks, metrics, pairs, quantiles, rollup, search
from provenir.plans.registry import OCC, PAIRS, ROLLUP, SCORED, SWEEP, _halves, _latest, _rollup, _scored, _swept, query, rounded
from provenir.runtime import cut, table
from provenir.sources import sinks

# ---- rules on rows

@query("""SELECT line_no, sha256(prompt || ' </s> ' || solution) AS combined_sha256, length(prompt) + length(solution) + 6 AS chars FROM candidates WHERE prompt IS NOT NULL AND solution IS NOT NULL""")
def combined_text(spark: SparkSession, d: str) -> DataFrame:
    """Two texts as one, parted by an end mark; rows without either are left out."""
    rows = table(spark, d, "candidates").where("prompt is not null and solution is not null")
    both = F.concat("prompt", F.lit(" </s> "), "solution")
    return rows.select("line_no", F.sha2(both, 256).alias("combined_sha256"), F.length(both).cast("bigint").alias("chars"))


@query("""SELECT 'all' AS selection, lower(dataset_source) AS dataset_source, count(*) AS rows FROM function_manifest WHERE lower(dataset_source) IN ('treatment', 'control') GROUP BY 2
UNION ALL SELECT 'treatment', lower(dataset_source), count(*) FROM function_manifest WHERE lower(dataset_source) = 'treatment' GROUP BY 2""")
def source_selection(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the selection of their sources: all is treatment and control."""
    rows = table(spark, d, "function_manifest").withColumn("dataset_source", F.lower("dataset_source"))
    chosen = {"all": ("treatment", "control"), "treatment": ("treatment",)}
    wanted = F.array_compact(F.array(*(F.when(F.col("dataset_source").isin(*s), F.lit(n)) for n, s in chosen.items())))
    return rows.withColumn("selection", F.explode(wanted)).groupBy("selection", "dataset_source").agg(F.count("*").alias("rows"))


@query("""WITH s AS (SELECT score_mode, predicted_agc, CASE score_mode WHEN 'decision' THEN -human_decision_score WHEN 'proba' THEN 1 - human_decision_score END AS agc, CASE score_mode WHEN 'decision' THEN 0.0 WHEN 'proba' THEN 0.5 END AS threshold FROM occurrences WHERE human_decision_score IS NOT NULL)
SELECT score_mode, threshold::DOUBLE AS threshold, count(*) AS rows, round(avg(agc), 6) AS mean_agc, count(*) FILTER (agc > threshold) AS above, count(*) FILTER ((agc > threshold)::INT <> predicted_agc) AS other_verdict FROM s GROUP BY 1, 2""")
def agc_scores(spark: SparkSession, d: str) -> DataFrame:
    """The machine's score of every scored unit by its mode, held against the verdict at the mode's own threshold."""
    rows = table(spark, d, "occurrences").where("human_decision_score is not null")
    s = rows.select("score_mode", "predicted_agc", text.agc_score("human_decision_score", "score_mode").alias("agc"), text.mode_threshold("score_mode").alias("threshold"))
    up = F.col("agc") > F.col("threshold")
    return rounded(s.groupBy("score_mode", "threshold").agg(F.count("*").alias("rows"), F.avg("agc").alias("mean_agc"), F.count_if(up).alias("above"), F.count_if(up.cast("int") != F.col("predicted_agc")).alias("other_verdict")), "mean_agc")


@query("""SELECT parse_status, CASE parse_status WHEN 'excluded_symlink' THEN 'skipped_symlink' WHEN 'excluded_non_regular' THEN 'skipped_non_regular' ELSE 'file' END AS file_status, count(*) AS rows FROM source_files GROUP BY 1, 2""")
def file_type_status(spark: SparkSession, d: str) -> DataFrame:
    """What a file is by how its snapshot took it: a file, or skipped as a link or as no regular file."""
    s = F.col("parse_status")
    return table(spark, d, "source_files").groupBy("parse_status", F.when(s == "excluded_symlink", "skipped_symlink").when(s == "excluded_non_regular", "skipped_non_regular").otherwise("file").alias("file_status")).agg(F.count("*").alias("rows"))


@query("""SELECT 'npr_body_space_by_token_count' AS "column", count(*) FILTER (npr_body_space_by_token_count IS NULL) AS missing, (count(*) FILTER (npr_body_space_by_token_count IS NULL) = 0)::INT AS kept FROM occurrences
UNION ALL SELECT 'predicted_agc', count(*) FILTER (predicted_agc IS NULL), (count(*) FILTER (predicted_agc IS NULL) = 0)::INT FROM occurrences
UNION ALL SELECT 'human_decision_score', count(*) FILTER (human_decision_score IS NULL OR isnan(human_decision_score)), (count(*) FILTER (human_decision_score IS NULL OR isnan(human_decision_score)) = 0)::INT FROM occurrences
UNION ALL SELECT 'ml_agc_score', count(*) FILTER (ml_agc_score IS NULL OR isnan(ml_agc_score)), (count(*) FILTER (ml_agc_score IS NULL OR isnan(ml_agc_score)) = 0)::INT FROM occurrences""")
def complete_features(spark: SparkSession, d: str) -> DataFrame:
    return audits.complete_columns(table(spark, d, "occurrences"), ["npr_body_space_by_token_count", "predicted_agc", "human_decision_score", "ml_agc_score"])


@query(r"""SELECT doc_id, sha256(CASE WHEN t = '' THEN 'def _empty_block(): pass' || chr(10) ELSE t || chr(10) END) AS block_sha256 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '') AS t FROM documents)""")
def block_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.block_text("text"), 256).alias("block_sha256"))


# ---- rolled up

@query(f"""WITH {OCC}, {ROLLUP.split('base AS')[0].split('files AS', 1)[1].join(['files AS', '']).rstrip().rstrip(',')},
m AS (SELECT o.* FROM occ o SEMI JOIN files f ON f.snapshot_id = o.snapshot_id AND f.relative_path = o.relative_path AND f.file_key = o.file_key)
SELECT snapshot_id, relative_path, file_key, count(*) AS blocks_scored, count(*) FILTER (agc = 0) AS human_blocks, count(*) FILTER (agc = 1) AS agc_blocks, round(count(*) FILTER (agc = 1) / count(*), 6) AS agc_block_ratio, round(avg(score), 10) AS mean_human_score, round(avg(-score), 10) AS mean_agc_score, 'ok' AS analysis_status FROM m GROUP BY 1, 2, 3""")
def file_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Per file its scored blocks, those of either kind, their ratio and mean scores."""
    occ = rollup.distinct_occurrences(table(spark, d, "occurrences")).select(*rollup.FILE_KEY, F.col("predicted_agc").alias("agc"), F.col("human_decision_score").alias("score"))
    known = rollup.distinct_files(table(spark, d, "source_files")).select(*rollup.FILE_KEY)
    g = occ.join(known, rollup.FILE_KEY, "left_semi").groupBy(*rollup.FILE_KEY).agg(
        F.count("*").alias("blocks_scored"), F.count_if(F.col("agc") == 0).alias("human_blocks"), F.count_if(F.col("agc") == 1).alias("agc_blocks"), F.avg("score").alias("mean_human_score"), F.avg(-F.col("score")).alias("mean_agc_score"))
    g = rounded(g.withColumn("agc_block_ratio", F.col("agc_blocks") / F.col("blocks_scored")).withColumn("analysis_status", F.lit("ok")), "agc_block_ratio")
    return rounded(g, "mean_human_score", "mean_agc_score", digits=10)


@query("""SELECT class, count(*) AS cells, round(avg(CASE WHEN class = 'auroc' AND isnan(f1) THEN NULL ELSE f1 END), 6) AS mean, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall FROM combined_block_metrics GROUP BY 1""")
def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each metric's mean over all models; not-a-number counts as missing for the AUROC only."""
    rows = table(spark, d, "combined_block_metrics")
    value = F.when(~((F.col("class") == "auroc") & F.coalesce(F.isnan("f1"), F.lit(False))), F.col("f1"))
    return rounded(rows.groupBy("class").agg(F.count("*").alias("cells"), F.avg(value).alias("mean"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall")), "mean", "mean_precision", "mean_recall")


@query("""WITH m AS (SELECT split_part(model, '-', 1) AS source, model AS target, f1 FROM combined_block_metrics WHERE class = 'AGC'), c AS (SELECT a.source, b.target, a.f1 * b.f1 AS v, a.target = b.target AS own FROM m a CROSS JOIN m b)
SELECT source, round(avg(v), 6) AS mean_all, round(avg(v) FILTER (NOT own), 6) AS mean_off, count(*) FILTER (NOT own) AS targets, rank() OVER (ORDER BY round(avg(v) FILTER (NOT own), 6) DESC) AS place FROM c GROUP BY 1""")
def target_means(spark: SparkSession, d: str) -> DataFrame:
    """Per source the mean over all targets and over the others, missing ones left out, and its place; five models, so a cross join of 25."""
    m = table(spark, d, "combined_block_metrics").where("class = 'AGC'").select(F.split_part("model", F.lit("-"), F.lit(1)).alias("source"), F.col("model").alias("target"), "f1")
    cells = m.alias("a").crossJoin(F.broadcast(m.alias("b"))).select("a.source", (F.col("a.f1") * F.col("b.f1")).alias("v"), (F.col("a.target") == F.col("b.target")).alias("own"))
    g = rounded(cells.groupBy("source").agg(F.avg("v").alias("mean_all"), F.avg(F.when(~F.col("own"), F.col("v"))).alias("mean_off"), F.count_if(~F.col("own")).alias("targets")), "mean_all", "mean_off")
    from pyspark.sql.window import Window

    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("mean_off"))).cast("bigint"))


GAINS = f"""{SWEEP}, g AS (SELECT model_key, threshold, round((human_f1 + lm_f1) / 2, 12) AS f FROM swept), b AS (SELECT model_key, max(f) - max(f) FILTER (threshold = (SELECT median(threshold) FROM swept)) AS gain, max(f) AS tuned FROM g GROUP BY 1)"""


@query(f"""WITH {GAINS} SELECT count(*) AS models, round(avg(gain), 6) AS mean_gain, round(max(gain), 6) AS most_gain, min(model_key) FILTER (round(gain, 9) = (SELECT round(max(gain), 9) FROM b)) AS best_model FROM b""")
def gain_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the best threshold brings over the middle one: mean, greatest, and the first model that has it."""
    swept = cut(_swept(spark, d).select("model_key", "threshold", F.round("avg_f1", 12).alias("f")), "gains")
    middle = quantiles.exact_quantiles(swept, "threshold", [0.5])[0]
    b = swept.groupBy("model_key").agg((F.max("f") - F.max(F.when(F.col("threshold") == F.lit(middle), F.col("f")))).alias("gain"))
    best = F.max_by("model_key", F.struct(F.round("gain", 9), F.transform(F.split("model_key", ""), lambda c: -F.ascii(c))))
    return rounded(b.agg(F.count("*").alias("models"), F.avg("gain").alias("mean_gain"), F.max("gain").alias("most_gain"), best.alias("best_model")), "mean_gain", "most_gain")


@query(f"""WITH {SWEEP}, r AS (SELECT model_key, threshold, round((human_f1 + lm_f1) / 2, 12) AS a, round(lm_f1, 12) AS f, round(lm_precision, 12) AS p, round(lm_recall, 12) AS q FROM swept), k AS (SELECT *, max(p) OVER (PARTITION BY model_key) >= 0.6 AS reached,
row_number() OVER (PARTITION BY model_key ORDER BY a DESC, f DESC, p DESC, threshold) AS k1, row_number() OVER (PARTITION BY model_key ORDER BY p >= 0.6 DESC, q DESC, f DESC, p DESC, threshold) AS k2, row_number() OVER (PARTITION BY model_key ORDER BY p DESC, q DESC, f DESC, threshold) AS k3 FROM r)
SELECT model_key, 'avg_f1' AS objective, 'max_avg_f1' AS policy, round(threshold, 6) AS threshold FROM k WHERE k1 = 1
UNION ALL SELECT model_key, 'high_precision', CASE WHEN reached THEN 'precision_reached_max_recall' ELSE 'fallback_max_precision' END, round(threshold, 6) FROM k WHERE (reached AND k2 = 1) OR (NOT reached AND k3 = 1)""")
def threshold_policies(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each of three policies; the last is the fall-back where no threshold reaches the precision asked for."""
    r = _swept(spark, d).select("model_key", "threshold", *(F.round(c, 12).alias(n) for c, n in (("avg_f1", "a"), ("lm_f1", "f"), ("lm_precision", "p"), ("lm_recall", "q"))))
    first = -F.col("threshold")
    reached = F.col("p") >= 0.6
    g = r.groupBy("model_key").agg(
        F.max_by("threshold", F.struct("a", "f", "p", first)).alias("one"), F.max_by(F.when(reached, F.col("threshold")), F.when(reached, F.struct("q", "f", "p", first))).alias("two"), F.max_by("threshold", F.struct("p", "q", "f", first)).alias("three"))
    row = lambda objective, policy, t: F.struct(F.lit(objective).alias("objective"), policy.alias("policy"), t.alias("threshold"))
    high = row("high_precision", F.when(F.col("two").isNotNull(), "precision_reached_max_recall").otherwise("fallback_max_precision"), F.coalesce("two", "three"))
    return rounded(g.select("model_key", F.inline(F.array(row("avg_f1", F.lit("max_avg_f1"), F.col("one")), high))), "threshold")


@query("""WITH g AS (SELECT 0.30 + 0.02 * i AS t FROM range(21) r(i)), s AS (SELECT predicted_agc AS truth, ml_agc_score AS score FROM occurrences WHERE score_mode = 'proba' AND ml_agc_score IS NOT NULL AND predicted_agc IS NOT NULL)
SELECT round(t, 2)::DOUBLE AS threshold, count(*) FILTER (truth = 1 AND score >= round(t, 2)::DOUBLE) AS tp, count(*) FILTER (truth = 0 AND score >= round(t, 2)::DOUBLE) AS fp, count(*) FILTER (truth = 1 AND score < round(t, 2)::DOUBLE) AS fn FROM s CROSS JOIN g GROUP BY 1""")
def probability_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses at the 21 thresholds of the probability grid, from the counts of each score."""
    s = table(spark, d, "occurrences").where("score_mode = 'proba' and ml_agc_score is not null and predicted_agc is not null").groupBy(F.col("ml_agc_score").alias("score")).agg(F.count_if(F.col("predicted_agc") == 1).alias("p"), F.count_if(F.col("predicted_agc") == 0).alias("n"))
    cells = s.withColumn("threshold", F.explode(F.array(*map(F.lit, metrics.proba_grid()))))
    up = F.col("score") >= F.col("threshold")
    return cells.groupBy("threshold").agg(F.sum(F.when(up, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(~up, F.col("p")).otherwise(0)).alias("fn"))


# ---- audits

@query(f"""WITH {ROLLUP}, c AS (SELECT 'rows' AS "check", count(*)::DOUBLE AS v FROM rolled UNION ALL SELECT 'distinct_keys', count(DISTINCT (snapshot_id, relative_path, file_key))::DOUBLE FROM rolled UNION ALL SELECT 'sum_units', sum(units)::DOUBLE FROM rolled UNION ALL SELECT 'sum_tokens', sum(tokens)::DOUBLE FROM rolled UNION ALL SELECT 'sum_agc_tokens', sum(agc_tokens)::DOUBLE FROM rolled)
SELECT "check", v AS observed, v AS expected, 1 AS passed FROM c""")
def stored_rollup(spark: SparkSession, d: str) -> DataFrame:
    return audits.verified(_rollup(spark, d).select(*rollup.FILE_KEY, "units", "tokens", "agc_tokens"), rollup.FILE_KEY, ["units", "tokens", "agc_tokens"])


@query("""SELECT c."column", c.wanted, c.wanted AS found, c.nulls, 1 AS passed FROM (SELECT 'snapshot_order' AS "column", 'bigint' AS wanted, count(*) FILTER (snapshot_order IS NULL) AS nulls FROM source_files UNION ALL SELECT 'repo_name', 'string', count(*) FILTER (repo_name IS NULL) FROM source_files UNION ALL SELECT 'file_sha256', 'string', count(*) FILTER (file_sha256 IS NULL) FROM source_files UNION ALL SELECT 'physical_line_count', 'bigint', count(*) FILTER (physical_line_count IS NULL) FROM source_files) c
UNION ALL SELECT 'frozen_at', 'timestamp', NULL, -1, 0""")
def file_contract(spark: SparkSession, d: str) -> DataFrame:
    """The file table against the columns it must have; frozen_at is one it lacks."""
    return audits.contract(table(spark, d, "source_files"), {"snapshot_order": "bigint", "repo_name": "string", "file_sha256": "string", "physical_line_count": "bigint", "frozen_at": "timestamp"})


@query("""WITH v AS (SELECT DISTINCT lower(dataset_source) AS g, 'model_key' AS "column", coalesce(model_key, '') AS value FROM occurrences UNION SELECT DISTINCT lower(dataset_source), 'score_mode', coalesce(score_mode, '') FROM occurrences UNION SELECT DISTINCT lower(dataset_source), 'snapshot_time', coalesce(snapshot_time, '') FROM occurrences),
s AS (SELECT "column", g, count(*) AS n, string_agg(value, chr(10) ORDER BY value) AS l FROM v GROUP BY 1, 2) SELECT "column", max(n) AS "values", count(*) AS groups, (count(DISTINCT l) = 1)::INT AS equal FROM s GROUP BY 1""")
def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Whether treatment and control were made alike."""
    return audits.same_metadata(table(spark, d, "occurrences").withColumn("dataset_source", F.lower("dataset_source")), "dataset_source", ["model_key", "score_mode", "snapshot_time"])


@query("""WITH m AS (SELECT model, count(*) AS rows, count(*) FILTER (class IN ('HWC', 'AGC')) AS sides, max(support) FILTER (class = 'avg') AS s, sum(support) FILTER (class IN ('HWC', 'AGC')) AS t, max(support) FILTER (class = 'HWC') AS h, max(support) FILTER (class = 'AGC') AS a, bool_and(f1 BETWEEN 0 AND 1) AS inside,
max(f1) FILTER (class = 'avg') AS avg_f1, avg(f1) FILTER (class IN ('HWC', 'AGC')) AS mean_f1 FROM combined_block_metrics GROUP BY 1)
SELECT 'models' AS "check", count(*)::BIGINT AS observed, 5::BIGINT AS expected, (count(*) = 5)::INT AS passed FROM m UNION ALL SELECT 'rows_a_model', count(*) FILTER (rows <> 5), 0, (count(*) FILTER (rows <> 5) = 0)::INT FROM m
UNION ALL SELECT 'equal_support', count(*) FILTER (h <> a OR s <> t), 0, (count(*) FILTER (h <> a OR s <> t) = 0)::INT FROM m UNION ALL SELECT 'in_range', count(*) FILTER (NOT inside), 0, (count(*) FILTER (NOT inside) = 0)::INT FROM m
UNION ALL SELECT 'mean_f1', count(*) FILTER (abs(avg_f1 - mean_f1) > 0.0002), 0, (count(*) FILTER (abs(avg_f1 - mean_f1) > 0.0002) = 0)::INT FROM m""")
def matrix_audit(spark: SparkSession, d: str) -> DataFrame:
    """The block metrics of all models: whole, on equal support, in range, and means that are the means of their sides."""
    of = lambda f, c, k: f(F.when(F.col("class").isin(*k), F.col(c)))
    m = table(spark, d, "combined_block_metrics").groupBy("model").agg(
        F.count("*").alias("rows"), of(F.max, "support", ["avg"]).alias("s"), of(F.sum, "support", ["HWC", "AGC"]).alias("t"), of(F.max, "support", ["HWC"]).alias("h"), of(F.max, "support", ["AGC"]).alias("a"), F.min(F.col("f1").between(0, 1)).alias("inside"), of(F.max, "f1", ["avg"]).alias("avg_f1"), of(F.avg, "f1", ["HWC", "AGC"]).alias("mean_f1"))
    found = m.agg(F.count("*").alias("models"), F.count_if(F.col("rows") != 5).alias("rows_a_model"), F.count_if((F.col("h") != F.col("a")) | (F.col("s") != F.col("t"))).alias("equal_support"), F.count_if(~F.col("inside")).alias("in_range"), F.count_if(F.abs(F.col("avg_f1") - F.col("mean_f1")) > 0.0002).alias("mean_f1"))
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("observed"), F.lit(5 if c == "models" else 0).cast("bigint").alias("expected")) for c in ("models", "rows_a_model", "equal_support", "in_range", "mean_f1")))
    return found.select(F.inline(rows)).withColumn("passed", (F.col("observed") == F.col("expected")).cast("int"))


@query(r"""WITH one AS (SELECT idx, max(label) AS label FROM code_pairs WHERE idx IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY regexp_replace(idx, '_(human|lm|ai)$', ''), idx) AS n FROM one),
g AS (SELECT (n + 1) // 2 AS p, max(idx) FILTER (n % 2 = 1) AS h, max(idx) FILTER (n % 2 = 0) AS m, max(label) FILTER (n % 2 = 1) AS hl, max(label) FILTER (n % 2 = 0) AS ml FROM o GROUP BY 1),
f AS (SELECT regexp_replace(h, '_(human|lm|ai)$', '') AS pair_id, CASE WHEN m IS NULL THEN 'odd_count' WHEN NOT h LIKE '%\_human' ESCAPE '\' THEN 'not_human' WHEN NOT m LIKE '%\_lm' ESCAPE '\' THEN 'not_machine' WHEN coalesce(trim(hl) <> 'human', true) OR coalesce(trim(ml) <> 'lm', true) THEN 'label' WHEN regexp_replace(h, '_human$', '') <> regexp_replace(m, '_lm$', '') THEN 'pair' ELSE '' END AS fault FROM g)
SELECT pair_id, fault FROM f WHERE fault <> ''""")
def pair_shape(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the table, each idx once, that aren't a human row with its machine row behind it."""
    one = table(spark, d, "code_pairs").where("idx is not null").groupBy("idx").agg(F.max("label").alias("label")).withColumn("pair", text.pair_id("idx"))
    return audits.alternation(one, ["pair", "idx"], "idx", "label")


@query("""WITH f AS (SELECT repo_name, relative_path, max(file_text IS NOT NULL) AS has_text FROM source_files WHERE repo_name IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1, 2), n AS (SELECT function_event_id AS id, count(*) AS n FROM function_manifest WHERE function_event_id IS NOT NULL GROUP BY 1),
s AS (SELECT m.manifest_row_number, CASE WHEN coalesce(n.n, 1) > 1 THEN 'duplicate_event_id' WHEN f.repo_name IS NULL THEN 'source_resolution' WHEN NOT coalesce(regexp_full_match(lower(m.content_sha256), '[0-9a-f]{64}'), false) THEN 'source_hash' WHEN NOT f.has_text THEN 'source_read' WHEN coalesce(end_line < start_line, true) THEN 'range' ELSE '' END AS stage FROM function_manifest m LEFT JOIN n ON n.id = m.function_event_id LEFT JOIN f ON f.repo_name = m.repo_name AND f.relative_path = m.relative_path)
SELECT stage, count(*) AS rows, min(manifest_row_number) AS first_row FROM s GROUP BY 1""")
def input_precheck(spark: SparkSession, d: str) -> DataFrame:
    """The first failing stage of each event row, in order: repeated id, no such file, no hash, no text, no range."""
    files = table(spark, d, "source_files").where("repo_name is not null and relative_path is not null").groupBy("repo_name", "relative_path").agg(F.max(F.col("file_text").isNotNull()).alias("has_text"))
    m = table(spark, d, "function_manifest").select("manifest_row_number", "function_event_id", "repo_name", "relative_path", "content_sha256", "start_line", "end_line")
    repeated = m.where("function_event_id is not null").groupBy("function_event_id").agg(F.count("*").alias("_n"))
    rows = m.join(repeated, "function_event_id", "left").join(files, ["repo_name", "relative_path"], "left")
    stage = audits.first_fault({
        "duplicate_event_id": F.coalesce("_n", F.lit(1)) > 1, "source_resolution": F.col("has_text").isNull(), "source_hash": ~F.coalesce(F.lower("content_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "source_read": ~F.col("has_text"), "range": F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(True)),
    })
    return rows.groupBy(stage.alias("stage")).agg(F.count("*").alias("rows"), F.min("manifest_row_number").alias("first_row"))


@query(f"""WITH {SCORED}, c AS (SELECT model_key, avg((truth = pred)::INT) AS a, avg((pred = 1)::INT) FILTER (truth = 1) AS r1, avg((pred = 0)::INT) FILTER (truth = 0) AS r0, count(*) FILTER (truth = 1) AS n1, count(*) FILTER (truth = 0) AS n0 FROM scored WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1)
SELECT model_key, round(a, 4) AS accuracy, round((r1 * n1 + r0 * n0) / (n1 + n0), 4) AS from_sides, 1 AS passed FROM c""")
def detector_validation(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy straight from the rows against that from both sides' recalls, to four decimals."""
    rows = cut(_scored(spark, d).where("truth is not null and pred is not null"), "validated")
    cell = metrics.cell_metrics(rows, ["model_key"]).select("model_key", F.round("accuracy", 4).alias("accuracy"))
    sides = metrics.per_class(rows, ["model_key"]).groupBy("model_key").agg(F.round(F.sum(F.col("recall") * F.col("support")) / F.sum("support"), 4).alias("from_sides"))
    return cell.join(sides, "model_key").withColumn("passed", (F.abs(F.col("accuracy") - F.col("from_sides")) < 0.00005).cast("int"))


@query(r"""SELECT line_no, CASE WHEN prompt IS NULL THEN 'slice' WHEN coalesce(lower(prompt_sha256) <> sha256(prompt), true) THEN 'hash' WHEN coalesce(len(list_filter(regexp_split_to_array(prompt, '[\s\x0b\x1c-\x1f\x{85}]+'), lambda x: x <> '')) <> prompt_words, true) THEN 'count' ELSE '' END AS fault FROM candidates""")
def slice_identity(spark: SparkSession, d: str) -> DataFrame:
    """The prompt cut out of the human source by its offsets must have the hash and the word count that are stored; the first that fails is the fault."""
    rows = table(spark, d, "candidates").withColumn("source", F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("solution", F.lit("")))).withColumn("piece", F.when(F.col("prompt").isNotNull(), F.substring("source", F.lit(1), F.length("prompt"))))
    fault = audits.first_fault({"slice": F.col("piece").isNull(), "hash": F.coalesce(F.lower("prompt_sha256") != F.sha2("piece", 256), F.lit(True)), "count": F.coalesce(text.word_count("piece") != F.col("prompt_words"), F.lit(True))})
    return rows.select("line_no", fault.alias("fault"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY manifest_row_number) AS n FROM function_manifest)
SELECT (n - 1) // 100 AS chunk, count(*) AS rows, sha256(string_agg(coalesce(function_event_id, ''), chr(10) ORDER BY n)) AS fingerprint FROM o GROUP BY 1""")
def chunk_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return audits.chunk_fingerprints(table(spark, d, "function_manifest").select("manifest_row_number", "function_event_id"), ["manifest_row_number"], "function_event_id", 100)


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS word FROM documents WHERE text IS NOT NULL), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 3), v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS i FROM c), s AS (SELECT count(*) AS size FROM v)
SELECT doc_id, count(*) AS words, count(*) FILTER (i IS NULL) AS unknown, sum(coalesce(i, size))::BIGINT AS index_sum FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z_]+')) AS word FROM documents WHERE text IS NOT NULL) LEFT JOIN v USING (word), s GROUP BY 1""")
def vocabulary_ids(spark: SparkSession, d: str) -> DataFrame:
    """Words by their index in the vocabulary of words that stand three times, unknown ones by its size; counted per document before the join."""
    words = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z_]+"), F.lit(0))).alias("word"))
    each = cut(words.groupBy("doc_id", "word").agg(F.count("*").alias("n")), "words")
    listed = audits.vocabulary(words.select("word"), "word", 3)
    size = listed.count()
    return each.join(listed, "word", "left").groupBy("doc_id").agg(F.sum("n").alias("words"), F.coalesce(F.sum(F.when(F.col("index").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), F.sum(F.col("n") * F.coalesce("index", F.lit(size))).alias("index_sum"))


@query("""SELECT 'prov' AS prefix, max_by(experiment, (z, experiment)) AS key, max(z) AS size FROM (SELECT DISTINCT experiment || '_' || (length(experiment) * 100) AS experiment, length(experiment) * 100 AS z FROM checkpoints WHERE experiment LIKE 'prov%')""")
def estimator_key(spark: SparkSession, d: str) -> DataFrame:
    """Of the runs with a prefix the one of the largest size, as stored models are chosen; the last in order of equals."""
    keys = table(spark, d, "checkpoints").where("experiment is not null").select(F.concat("experiment", F.lit("_"), (F.length("experiment") * 100).cast("string")).alias("key")).distinct()
    return audits.largest_key(keys, "key", "prov").select(F.lit("prov").alias("prefix"), "key", "size")


# ---- for papers and readers

@query(r"""WITH m AS (SELECT model, max(f1) FILTER (class = 'HWC') AS h, max(f1) FILTER (class = 'AGC') AS a, max(f1) FILTER (class = 'auroc') AS u FROM combined_block_metrics GROUP BY 1), t AS (SELECT max(round(h, 4)) AS h, max(round(a, 4)) AS a, max(round(u, 4)) AS u FROM m),
c AS (SELECT model, CASE WHEN round(m.h, 4) = t.h THEN printf('\textbf{%.4f}', m.h) ELSE printf('%.4f', m.h) END AS h, CASE WHEN round(m.a, 4) = t.a THEN printf('\textbf{%.4f}', m.a) ELSE printf('%.4f', m.a) END AS a, CASE WHEN round(m.u, 4) = t.u THEN printf('\textbf{%.4f}', m.u) ELSE printf('%.4f', m.u) END AS u FROM m, t)
SELECT model, replace(model, '_', '\_') || ' & ' || h || ' & ' || a || ' & ' || u || ' \\' AS line FROM c""")
def tex_table(spark: SparkSession, d: str) -> DataFrame:
    of = lambda c: F.max(F.when(F.col("class") == c, F.col("f1")))
    m = table(spark, d, "combined_block_metrics").groupBy("model").agg(of("HWC").alias("h"), of("AGC").alias("a"), of("auroc").alias("u"))
    return sinks.tex_rows(m, "model", ["h", "a", "u"])


@query(r"""SELECT class, class || ' & ' || string_agg(CASE WHEN f1 IS NULL THEN '--' ELSE printf('%.4f', f1) END, ' & ' ORDER BY model) || ' \\' AS line FROM combined_block_metrics GROUP BY 1""")
def tex_matrix(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tex_matrix(table(spark, d, "combined_block_metrics"), "class", "model", "f1")


@query("""SELECT line_no, sha256('=== ' || line_no || ' ===' || chr(10) || '--- func_name ---' || chr(10) || coalesce(func_name, '') || chr(10) || '--- prompt ---' || chr(10) || coalesce(prompt, '') || chr(10) || '--- solution ---' || chr(10) || coalesce(solution, '') || chr(10)) AS text_sha256 FROM candidates""")
def readable_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as text to read; here by the texts' hashes."""
    return sinks.readable(table(spark, d, "candidates"), "line_no", ["func_name", "prompt", "solution"]).select("line_no", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH k AS (SELECT line_no, prompt FROM candidates WHERE prompt IS NOT NULL AND solution IS NOT NULL AND contains(prompt, '\"\"\"')) SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS filter_index FROM k""")
def filter_index(spark: SparkSession, d: str) -> DataFrame:
    """The running number of the candidates that are kept, from 0, by source line."""
    kept = table(spark, d, "candidates").where("prompt is not null and solution is not null and contains(prompt, '\\\"\\\"\\\"')").select("line_no")
    return pairs.with_positions(kept, ["line_no"], "n").select("line_no", (F.col("n") - 1).cast("bigint").alias("filter_index"))


# ---- continuations and sources, which SQL can't take apart

def _prompted(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "candidates").where("line_no is not null and endswith(relative_path, '.py')").groupBy("line_no").agg(F.min_by(F.struct("prompt", "solution"), F.struct("prompt", "solution")).alias("p")).select("line_no", "p.*")
    return _latest(spark, d).select("line_no", "tag", "raw_output").join(people, "line_no")


@query()
def continuations(spark: SparkSession, d: str) -> DataFrame:
    """Every answer to a Python prompt cleaned in both ways and as a body, and whether each parses behind its prompt."""
    def make(prompt: str | None, raw: str | None) -> tuple:
        one, two, body = continuation.cleaned(prompt, raw), continuation.cleaned_second(prompt, raw), continuation.extracted_body(prompt, raw)
        return one, two, body, *(continuation.parses(code.composed(continuation.plain(prompt), x)) for x in (one, two, body))

    return continuation.with_columns(_prompted(spark, d).drop("solution"), ["prompt", "raw_output"], make, "cleaned string, second string, body string, cleaned_ok boolean, second_ok boolean, body_ok boolean")


@query()
def continuation_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Where each answer is cut so that it is the human function's twin in head and docstring, or the last fault."""
    def make(prompt: str | None, solution: str | None, raw: str | None) -> tuple:
        found = continuation.cut_continuation(prompt, solution, raw)
        return found["cut"], found["cuts"], found["fault"]

    return continuation.with_columns(_prompted(spark, d), ["prompt", "solution", "raw_output"], make, "cut int, cuts int, fault string")


@query()
def shared_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that both halves of a pair begin with, by the human one's docstring, or why there is none."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("code")))
    both = _halves(spark, d).where("code is not null").groupBy("pair_id").agg(pick("human").alias("human"), pick("lm").alias("machine")).where("human is not null and machine is not null")
    return continuation.with_columns(both, ["human", "machine"], continuation.shared_prompt, "prompt string, fault string")


@query()
def header_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Where decorators and the def stand in every generated Python function."""
    def make(source: str | None) -> tuple:
        found = continuation.header_alignment(source, "@" in (source or "").split("def ")[0])
        return found["decorators"], found["decorators_aligned"], found["header_aligned"], found["fault"]

    rows = _latest(spark, d).where("agc_code is not null").select("line_no", "tag", "agc_code")
    return continuation.with_columns(rows, ["agc_code"], make, "decorators int, decorators_aligned boolean, header_aligned boolean, fault string")


@query()
def node_types(spark: SparkSession, d: str) -> DataFrame:
    """Node types of the generated sources that parse as Python, with their family, how many stand in all and in how many sources."""
    rows = _latest(spark, d).where("agc_code is not null").select("line_no", "tag", "agc_code")
    counted = rows.select(F.col("agc_code").alias("text")).mapInPandas(lambda parts: (_frame(_node_totals(p["text"])) for p in parts), "node string, n bigint, sources bigint")
    names = spark.createDataFrame(code.node_taxonomy(), "node string, family string")
    return counted.groupBy("node").agg(F.sum("n").alias("nodes"), F.sum("sources").alias("sources")).join(F.broadcast(names), "node")


def _node_totals(texts) -> dict[str, tuple[int, int]]:
    total: dict[str, tuple[int, int]] = {}
    for t in texts:
        for name, n in code.node_counts(t).items():
            a, b = total.get(name, (0, 0))
            total[name] = a + n, b + 1
    return total


def _frame(total: dict[str, tuple[int, int]]):
    import pandas as pd

    return pd.DataFrame({"node": list(total), "n": [a for a, _ in total.values()], "sources": [b for _, b in total.values()]})


# ---- whole forms beside queries whose SQL does less

@query("""SELECT doc_id, octet_length(encode(substr(text, 1, (n_chars // 2)::INT)))::INT AS bytes, replace(replace(text, '{', '{{'), '}', '}}') AS escaped FROM documents""")
def escaped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with their braces doubled, and the bytes of their first half."""
    return table(spark, d, "documents").select("doc_id", text.byte_offset("text", F.floor(F.col("n_chars") / 2)).alias("bytes"), text.escape_braces("text").alias("escaped"))


@query("""SELECT a.vec_id, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS drift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND len(a.embedding) = len(b.embedding)""")
def neighbour_drift(spark: SparkSession, d: str) -> DataFrame:
    """The greatest difference between each vector's figures and those of the vector numbered next."""
    e = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return rounded(checks.vector_drift(e, e.withColumn("vec_id", F.col("vec_id") - 1), "vec_id", "embedding"), "drift")


@query("""SELECT label, count(*) AS vectors, round(avg(v[1]), 6) AS first_mean, round(avg(v[len(v)]), 6) AS last_mean FROM (SELECT label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0) GROUP BY 1""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of each label, here by its first and last figure: figures are averaged by place, so no vector list is gathered."""
    e = table(spark, d, "embeddings").where("embedding is not null and size(embedding) > 0").select("label", F.size("embedding").alias("size"), F.posexplode("embedding").alias("place", "x"))
    m = e.groupBy("label", "size", "place").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    first, last = F.col("place") == 0, F.col("place") == F.col("size") - 1
    share = lambda at: F.sum(F.when(at, F.col("s"))) / F.sum(F.when(at, F.col("n")))
    return rounded(m.groupBy("label").agg(F.sum(F.when(first, F.col("n"))).alias("vectors"), share(first).alias("first_mean"), share(last).alias("last_mean")), "first_mean", "last_mean")


@query(r"""WITH p AS (SELECT *, (token_pct + line_pct) / 2 AS score FROM (SELECT pair_id, max_tokens, max_lines, ratio, CASE WHEN ok THEN (rank() OVER (PARTITION BY ok ORDER BY max_tokens) + (count(*) OVER (PARTITION BY ok, max_tokens) - 1) / 2.0) / count(*) OVER (PARTITION BY ok) END AS token_pct, CASE WHEN ok THEN (rank() OVER (PARTITION BY ok ORDER BY max_lines) + (count(*) OVER (PARTITION BY ok, max_lines) - 1) / 2.0) / count(*) OVER (PARTITION BY ok) END AS line_pct FROM (SELECT *, max_tokens <= 420 AS ok FROM PAIRS))) SELECT pair_id, round(score, 6) AS score FROM p""".replace("WITH p AS", f"WITH {PAIRS}, p AS").replace("FROM PAIRS)", "FROM pairs)"))
def eligible_scores(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with the score that only the eligible ones have, merged back from their own ranks."""
    every = cut(pairs.pair_table(_halves(spark, d)), "pairs")
    kept = every.where("max_tokens <= 420")
    scored = pairs.percent_ranks(pairs.percent_ranks(kept, "max_tokens", "token_pct"), "max_lines", "line_pct").select("pair_id", ((F.col("token_pct") + F.col("line_pct")) / 2).alias("score"))
    return rounded(every.select("pair_id").join(scored, "pair_id", "left"), "score")


@query()
def source_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and names of every human source by number, and the digests of its token sequence in all modes, for Python, Java and C++."""
    rows = table(spark, d, "candidates").where("line_no is not null").select("line_no", F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("solution", F.lit(""))).alias("source"), text.language_of_path("relative_path").alias("language"))
    return continuation.with_columns(rows.withColumn("lang", F.col("language")), ["source", "lang"], transforms.profile, transforms.PROFILE)


#: What no frozen unit may be, as conditions that both dialects read; RE stands for the function that finds a pattern.
FREEZE = {
    "null_unit": "code_unit_id IS NULL", "null_path": "relative_path IS NULL", "null_snapshot": "snapshot_id IS NULL", "bad_file_hash": "file_sha256 IS NOT NULL AND NOT RE(lower(file_sha256), '^[0-9a-f]{64}$')", "bad_source_hash": "ml_source_sha256 IS NOT NULL AND NOT RE(lower(ml_source_sha256), '^[0-9a-f]{64}$')",
    "bad_commit": "snapshot_commit IS NOT NULL AND NOT RE(lower(snapshot_commit), '^[0-9a-f]{7,40}$')", "unsafe_path": "RE(relative_path, '(^/)|((^|/)[.][.](/|$))')", "bad_repo": "repo_name IS NOT NULL AND NOT RE(repo_name, '^[^/]+/[^/]+$')", "unknown_source": "lower(dataset_source) NOT IN ('treatment', 'control')",
    "unknown_mode": "score_mode NOT IN ('decision', 'proba')", "null_mode": "score_mode IS NULL", "bad_class": "predicted_agc NOT IN (0, 1)", "null_class": "predicted_agc IS NULL", "one_score_only": "(human_decision_score IS NULL) <> (ml_agc_score IS NULL)",
    "decision_not_negative": "score_mode = 'decision' AND abs(human_decision_score + ml_agc_score) > 0.000002", "proba_not_complement": "score_mode = 'proba' AND abs(human_decision_score + ml_agc_score - 1) > 0.000002", "proba_out_of_range": "score_mode = 'proba' AND (ml_agc_score < 0 OR ml_agc_score > 1)",
    "verdict_off_score": "(score_mode = 'decision' AND predicted_agc <> CASE WHEN ml_agc_score > 0 THEN 1 ELSE 0 END) OR (score_mode = 'proba' AND predicted_agc <> CASE WHEN ml_agc_score > 0.5 THEN 1 ELSE 0 END)", "no_tokens": "npr_body_space_by_token_count IS NULL OR npr_body_space_by_token_count < 1",
    "unknown_role": "aggregation_role NOT IN ('primary', 'nested')", "unknown_type": "code_unit_type NOT IN ('method_body', 'function_body')", "null_model": "model_key IS NULL", "bad_key": "repo_key IS NOT NULL AND RE(repo_key, '[[:space:]]')",
}


@query("WITH c AS (" + " UNION ALL ".join(f"""SELECT '{n}' AS "check", count(*) FILTER ({x.replace("RE(", "regexp_matches(")}) AS observed FROM occurrences""" for n, x in FREEZE.items()) + """ UNION ALL SELECT 'repeated_unit', count(*) FROM (SELECT snapshot_id, relative_path, lower(file_sha256), code_unit_id FROM occurrences GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT (predicted_agc, ml_agc_score)) > 1)
UNION ALL SELECT 'models', count(DISTINCT model_key) FROM occurrences) SELECT "check", observed, CASE WHEN "check" = 'models' THEN 1 ELSE 0 END::BIGINT AS expected, (observed = CASE WHEN "check" = 'models' THEN 1 ELSE 0 END)::INT AS passed FROM c""")
def freeze_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all that scored units may not be, in one pass, units with two verdicts, and the models there are."""
    occ = table(spark, d, "occurrences")
    one = occ.agg(*(F.count_if(F.expr(x.replace("RE(", "regexp_like(").replace("[[:space:]]", "\\\\s"))).alias(n) for n, x in FREEZE.items()), F.count_distinct("model_key").alias("models"))
    unit = occ.groupBy("snapshot_id", "relative_path", F.lower("file_sha256").alias("f"), "code_unit_id").agg(F.count_distinct(F.struct(F.coalesce(F.col("predicted_agc").cast("string"), F.lit("")), F.coalesce(F.col("ml_agc_score").cast("string"), F.lit("")))).alias("n"))
    checks_ = [*FREEZE, "models"]
    found = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("observed")) for n in checks_)))).union(unit.agg(F.lit("repeated_unit").alias("check"), F.count_if(F.col("n") > 1).alias("observed")))
    return found.withColumn("expected", F.when(F.col("check") == "models", 1).otherwise(0).cast("bigint")).withColumn("passed", (F.col("observed") == F.col("expected")).cast("int"))


@query()
def complexity_full(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by the mean of three percent ranks (tree tokens, lines, decisions, each the greater of its halves), ties by decisions, tokens, lines and id; pairs of which a half doesn't parse have no place."""
    def make(source: str | None) -> tuple:
        found = code.analyse(source)
        return found["complexity"], found["nodes"]

    halves = _halves(spark, d).where("code is not null and side is not null").select("pair_id", "side", text.line_count("code").alias("lines"), "code")
    sized = continuation.with_columns(halves, ["code"], make, "cc int, nodes int").groupBy("pair_id").agg(F.count_distinct("side").alias("sides"), F.count("cc").alias("parsed"), F.max("cc").alias("max_cc"), F.max("nodes").alias("max_ast"), F.max("lines").alias("max_lines"))
    whole = cut(sized.where("sides = 2 and parsed = 2").drop("sides", "parsed"), "sized")
    for column in ("max_ast", "max_lines", "max_cc"):
        whole = pairs.percent_ranks(whole, column, f"{column}_pct")
    scored = whole.withColumn("score", F.round((F.col("max_ast_pct") + F.col("max_lines_pct") + F.col("max_cc_pct")) / 3, 12))
    return pairs.with_positions(scored, ["score", "max_cc", "max_ast", "max_lines", "pair_id"], "place").select("pair_id", "max_cc", "max_ast", "max_lines", "score", "place")


@query()
def model_search(spark: SparkSession, d: str) -> DataFrame:
    """Settings of four families by macro F1 on dev, human against machine by sizes of code, and the best one's macro F1 on test."""
    rows = _halves(spark, d).where("code is not null and side is not null").select(
        "split", (F.col("side") == "human").cast("double").alias("label"), *(c.cast("double").alias(n) for n, c in (("lines", text.line_count("code")), ("words", text.word_count("code")), ("spaces", text.space_weight("code")), ("chars", F.length("code")))))
    rows = cut(rows, "search")
    of = lambda name: rows.where(F.col("split") == name)
    found, best = search.random_search(of("train"), of("dev"), ["lines", "words", "spaces", "chars"], ["lr", "svm", "dt", "rf"], 2)
    on_test = search.macro_f1(best.transform(of("test"))) if best else None
    shape = "family string, setting string, f1_macro double, place int, test_f1_macro double"
    return rounded(spark.createDataFrame([(r["family"], r["setting"], r["f1_macro"], r["place"], on_test if r["place"] == 1 else None) for r in found], shape), "f1_macro", "test_f1_macro")


@query()
def located_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The function whose body a candidate's solution is, by its place behind the prompt, or the fault that keeps it from being told."""
    def make(prompt: str | None, solution: str | None) -> tuple:
        whole = (prompt or "") + (solution or "")
        found = code.located(whole, len(prompt or ""), len(whole))
        return found["name"], found["kind"], found["start_line"], found["end_line"], found["fault"]

    rows = table(spark, d, "candidates").where("endswith(relative_path, '.py')").select("line_no", "prompt", "solution")
    return continuation.with_columns(rows, ["prompt", "solution"], make, "name string, kind string, start_line int, end_line int, fault string")


@query(f"""WITH {OCC}, {ROLLUP.split('base AS')[0].split('files AS', 1)[1].join(['files AS', '']).rstrip().rstrip(',')}, a AS (SELECT snapshot_id, relative_path, file_key, count(*) AS units, sum(coalesce(w, 0))::BIGINT AS tokens FROM occ GROUP BY 1, 2, 3),
j AS (SELECT CASE WHEN f.snapshot_id IS NULL THEN 'only_units' WHEN a.snapshot_id IS NULL THEN 'only_file' WHEN f.physical_line_count < a.units THEN 'more_units_than_lines' WHEN f.physical_line_count IS NULL THEN 'no_lines' ELSE 'agrees' END AS state, a.units, a.tokens FROM a FULL JOIN files f ON f.snapshot_id = a.snapshot_id AND f.relative_path = a.relative_path AND f.file_key = a.file_key)
SELECT state, count(*) AS files, coalesce(sum(units), 0)::BIGINT AS units, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM j GROUP BY 1""")
def table_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Files and units held against each other by key, both ways: those on one side only, and those whose figures can't both be true."""
    occ = rollup.distinct_occurrences(table(spark, d, "occurrences")).groupBy(*rollup.FILE_KEY).agg(F.count("*").alias("units"), F.sum(F.coalesce("npr_body_space_by_token_count", F.lit(0))).alias("tokens"))
    files = rollup.distinct_files(table(spark, d, "source_files")).select(*(F.col(c).alias(f"f_{c}") for c in rollup.FILE_KEY), "physical_line_count")
    both = occ.join(files, [F.col(c) == F.col(f"f_{c}") for c in rollup.FILE_KEY], "full")
    state = (
        F.when(F.col("f_snapshot_id").isNull(), "only_units").when(F.col("snapshot_id").isNull(), "only_file").when(F.col("physical_line_count") < F.col("units"), "more_units_than_lines")
        .when(F.col("physical_line_count").isNull(), "no_lines").otherwise("agrees")
    )
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("files"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
