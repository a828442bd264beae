"""All queries of the core by name over the driver's tables, and SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.functions import cleaning, code, hashing, text
from provenir.operators import checks, events, matching, metrics, pairs, quantiles, retrieval, rollup, selection, splits
from provenir.runtime import cut, table
from provenir.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


# ---- files and occurrences

OCC = """occ AS (SELECT snapshot_id, relative_path, lower(file_sha256) AS file_key, code_unit_id, min(predicted_agc) AS agc, min(npr_body_space_by_token_count) AS w, min(a05_mapping_warning) AS warn, min(human_decision_score) AS score FROM occurrences GROUP BY ALL)"""
FILES = """files AS (SELECT snapshot_id, relative_path, lower(file_sha256) AS file_key, min(dataset_source) AS dataset_source, min(repo_name) AS repo_name, min(parse_status) AS parse_status, max(physical_line_count) AS physical_line_count FROM source_files GROUP BY 1, 2, 3)"""
ROLLUP = f"""{OCC}, {FILES},
sums AS (SELECT snapshot_id, relative_path, file_key, count(*) AS units, count(*) FILTER (agc = 1) AS agc_units, sum(coalesce(w, 0)) AS tokens, coalesce(sum(coalesce(w, 0)) FILTER (agc = 1), 0) AS agc_tokens,
  count(*) FILTER (lower(trim(coalesce(warn, ''))) NOT IN ('', '0', 'false', 'f', 'no', 'n')) AS warnings, avg(score) AS mean_score FROM occ GROUP BY 1, 2, 3),
base AS (SELECT f.*, coalesce(units, 0) AS units, coalesce(agc_units, 0) AS agc_units, coalesce(tokens, 0) AS tokens, coalesce(agc_tokens, 0) AS agc_tokens, coalesce(warnings, 0) AS warnings, mean_score,
  CASE WHEN coalesce(parse_status, '') <> 'prepared' THEN 'file_not_prepared' WHEN coalesce(units, 0) = 0 THEN 'no_units' ELSE 'scored' END AS status
  FROM files f LEFT JOIN sums s ON f.snapshot_id = s.snapshot_id AND f.relative_path = s.relative_path AND f.file_key = s.file_key),
rolled AS (SELECT *, agc_units / nullif(units, 0) AS count_share, agc_tokens / nullif(tokens, 0) AS weighted_share FROM base)"""


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollup.file_rollup(table(spark, d, "source_files"), table(spark, d, "occurrences"))


@query(f"""WITH {ROLLUP} SELECT snapshot_id, relative_path, file_key, dataset_source, repo_name, parse_status, physical_line_count, units, agc_units, tokens::BIGINT AS tokens, agc_tokens::BIGINT AS agc_tokens, warnings, round(mean_score, 10) AS mean_score, status,
round(count_share, 6) AS count_share, round(weighted_share, 6) AS weighted_share, CASE WHEN status = 'scored' THEN CASE WHEN weighted_share > 0.5 THEN 1 ELSE 0 END END AS selected FROM rolled""")
def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_rollup(spark, d), "count_share", "weighted_share"), "mean_score", digits=10)


@query(f"""WITH {ROLLUP}, s AS (SELECT dataset_source, weighted_share, threshold FROM rolled, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75)) t(threshold) WHERE status = 'scored')
SELECT threshold, dataset_source, count(*) AS files, count(*) FILTER (weighted_share > threshold) AS selected, count(*) FILTER (abs(weighted_share - threshold) <= 1e-15) AS ties, grouping(dataset_source)::TINYINT AS all_sources FROM s GROUP BY GROUPING SETS ((threshold), (threshold, dataset_source))""")
def threshold_support(spark: SparkSession, d: str) -> DataFrame:
    return rollup.threshold_support(_rollup(spark, d))


@query(f"""WITH {OCC}, {FILES} SELECT o.snapshot_id, o.relative_path, o.file_key, count(*) AS units FROM occ o WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot_id = o.snapshot_id AND f.relative_path = o.relative_path AND f.file_key = o.file_key) GROUP BY 1, 2, 3""")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    return rollup.orphans(table(spark, d, "occurrences"), table(spark, d, "source_files")).groupBy(*rollup.FILE_KEY).agg(F.count("*").alias("units"))


@query(f"""WITH {ROLLUP}, m AS (SELECT o.* FROM occ o SEMI JOIN files f ON f.snapshot_id = o.snapshot_id AND f.relative_path = o.relative_path AND f.file_key = o.file_key), n AS (SELECT count(*) c, coalesce(sum(w), 0) t FROM m),
a AS (SELECT count(*) AS r, sum(units) AS u, sum(tokens) AS t, count(*) FILTER (agc_units > units) AS x, count(*) FILTER (status = 'scored' AND units = 0) AS y, count(*) FILTER (weighted_share < 0 OR weighted_share > 1) AS z FROM rolled),
c AS (SELECT 'files_conserved' AS "check", 'hard' AS severity, (SELECT r FROM a) AS observed, (SELECT count(*) FROM files) AS expected UNION ALL SELECT 'units_conserved', 'hard', (SELECT u FROM a), (SELECT c FROM n) UNION ALL SELECT 'tokens_conserved', 'hard', (SELECT t FROM a), (SELECT t FROM n)
UNION ALL SELECT 'agc_within_units', 'hard', (SELECT x FROM a), 0 UNION ALL SELECT 'scored_has_units', 'hard', (SELECT y FROM a), 0 UNION ALL SELECT 'selection_only_scored', 'hard', 0, 0 UNION ALL SELECT 'share_in_range', 'hard', (SELECT z FROM a), 0 UNION ALL SELECT 'no_orphans', 'soft', (SELECT count(*) FROM occ) - (SELECT c FROM n), 0)
SELECT "check", severity, observed::BIGINT AS observed, expected::BIGINT AS expected, (observed = expected)::INT AS passed FROM c""")
def conservation_checks(spark: SparkSession, d: str) -> DataFrame:
    files, occ = table(spark, d, "source_files"), table(spark, d, "occurrences")
    return rollup.conservation_checks(files, occ, rollup.file_rollup(files, occ))


@query("""WITH o AS (SELECT lower(trim(ml_source_sha256)) AS source_key, * FROM occurrences WHERE ml_source_sha256 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY snapshot_time NULLS FIRST, snapshot_id NULLS FIRST, relative_path NULLS FIRST, code_unit_id NULLS FIRST) AS k FROM o)
SELECT source_key, count(*) AS occurrences, count(DISTINCT repo_name) AS repositories, min(snapshot_id) FILTER (k = 1) AS snapshot_id, min(relative_path) FILTER (k = 1) AS relative_path, min(code_unit_id) FILTER (k = 1) AS code_unit_id FROM r GROUP BY source_key""")
def unique_sources(spark: SparkSession, d: str) -> DataFrame:
    return rollup.unique_sources(table(spark, d, "occurrences"))


@query("""SELECT idx, sha256(code) AS text_sha256, (length(code) - length(replace(code, ' ', '')) + 1)::INT AS score FROM code_pairs""")
def dedup_score_expand(spark: SparkSession, d: str) -> DataFrame:
    return rollup.score_once(table(spark, d, "code_pairs").select("idx", "code"), "code", text.space_weight("code")).select("idx", "text_sha256", "score")


@query(f"""WITH {ROLLUP} SELECT repo_name, status, count(*) AS files, sum(units)::BIGINT AS units, round(avg(count_share), 6) AS mean_share, round(quantile_cont(count_share, 0.5), 6) AS median_share FROM rolled GROUP BY 1, 2""")
def snapshot_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _rollup(spark, d).groupBy("repo_name", "status").agg(F.count("*").alias("files"), F.sum("units").alias("units"), F.avg("count_share").alias("mean_share"), F.percentile("count_share", F.lit(0.5)).alias("median_share"))
    return rounded(a, "mean_share", "median_share")


# ---- scored halves of pairs

HALVES = r"""lab AS (SELECT *, lower(trim(label)) AS x, regexp_extract(idx, '_(human|lm|ai)$', 1) AS sfx FROM code_pairs WHERE idx IS NOT NULL),
ded AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY written_at DESC NULLS LAST, coalesce(code, '') DESC, coalesce(split, '') DESC, coalesce(model, '') DESC) AS k FROM lab),
halves AS (SELECT idx, regexp_replace(idx, '_(human|lm|ai)$', '') AS pair_id, coalesce(CASE WHEN x IN ('human', '1') THEN 'human' WHEN x IN ('lm', 'ai', 'machine', 'agc', 'mgc', '0') THEN 'lm' END, CASE WHEN sfx = 'human' THEN 'human' WHEN sfx IN ('lm', 'ai') THEN 'lm' END) AS side,
  code, split, model, regexp_replace(regexp_replace(lower(model), '_[0-9]+_.*$', ''), '[^a-z0-9]', '', 'g') AS model_key FROM ded WHERE k = 1)"""
SCORED = HALVES + r""", raw AS (SELECT idx, pair_id, model_key, CASE side WHEN 'human' THEN 1 WHEN 'lm' THEN 0 END AS truth, -(length(code) - length(replace(code, ' ', '')) + 1)::DOUBLE AS score FROM halves),
mid AS (SELECT quantile_cont(score, 0.5) AS m FROM raw), scored AS (SELECT raw.*, CASE WHEN score >= m THEN 1 WHEN score < m THEN 0 END AS pred FROM raw, mid)"""
AUC = r"""cnt AS (SELECT model_key, score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM scored WHERE score IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model_key ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt),
auc AS (SELECT model_key, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auroc, sum(p)::BIGINT AS pos, sum(n)::BIGINT AS neg FROM run GROUP BY 1)"""
CONF = r"""conf AS (SELECT model_key, count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn, count(*) FILTER (truth = 0 AND pred = 0) AS tn FROM scored WHERE truth IS NOT NULL AND pred IS NOT NULL GROUP BY 1)"""


def _halves(spark: SparkSession, d: str) -> DataFrame:
    h = pairs.halves(table(spark, d, "code_pairs"))
    return h.withColumn("model_key", F.regexp_replace(F.regexp_replace(F.lower("model"), "_[0-9]+_.*$", ""), "[^a-z0-9]", ""))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Halves with truth (1 human), a score that falls with the code's size, and the prediction at the median score."""
    rows = _halves(spark, d).select("idx", "pair_id", "model_key", "split", F.when(F.col("side") == "human", 1).when(F.col("side") == "lm", 0).alias("truth"), (-text.space_weight("code")).cast("double").alias("score"))
    rows = cut(rows, "scored")
    middle = quantiles.exact_quantiles(rows, "score", [0.5])[0]
    return rows.withColumn("pred", (F.col("score") >= F.lit(middle)).cast("int"))


@query(f"""WITH {SCORED}, {CONF}, s AS (SELECT model_key, 'human' AS class, tp AS hit, tp + fp AS said, tp + fn AS support FROM conf UNION ALL SELECT model_key, 'lm', tn, tn + fn, tn + fp FROM conf),
r AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS q FROM s) SELECT model_key, class, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1, support FROM r""")
def prf_per_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(_scored(spark, d), ["model_key"]), "precision", "recall", "f1")


@query(f"""WITH {SCORED}, {CONF}, {AUC}, r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM conf),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS hf, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS lf FROM r)
SELECT f.model_key, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / greatest(tp + fn, 1), 6) AS tpr, round(tn / greatest(tn + fp, 1), 6) AS tnr, round(hf, 6) AS human_f1, round(lf, 6) AS lm_f1, round((hf + lf) / 2, 6) AS avg_f1, round(auroc, 6) AS auroc FROM f LEFT JOIN auc ON f.model_key = auc.model_key""")
def cell_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.cell_metrics(_scored(spark, d), ["model_key"]), "accuracy", "tpr", "tnr", "human_f1", "lm_f1", "avg_f1", "auroc")


@query(f"WITH {SCORED}, {AUC} SELECT model_key, round(auroc, 9) AS auroc, pos, neg FROM auc")
def auroc_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(_scored(spark, d), ["model_key"]), "auroc", digits=9)


@query(f"""WITH {SCORED}, {AUC} SELECT model_key, score AS threshold, round(sum(n) OVER (PARTITION BY model_key ORDER BY score DESC) / nullif(sum(n) OVER (PARTITION BY model_key), 0), 6) AS fpr, round(sum(p) OVER (PARTITION BY model_key ORDER BY score DESC) / nullif(sum(p) OVER (PARTITION BY model_key), 0), 6) AS tpr FROM cnt""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.roc_curve(_scored(spark, d), ["model_key"]), "fpr", "tpr")


#: Draws of a bootstrap, the reference's default.
DRAWS = 20_000

SWEEP = f"""{SCORED}, st AS (SELECT quantile_cont(score, 0.5) AS m, stddev_pop(score) AS s FROM scored), grid AS (SELECT m - 1.5 * s + 2 * 1.5 * s * i / 40 AS threshold FROM st, range(41) t(i)),
cells AS (SELECT model_key, threshold, count(*) FILTER (truth = 1 AND score >= threshold) AS tp, count(*) FILTER (truth = 0 AND score >= threshold) AS fp, count(*) FILTER (truth = 1 AND score < threshold) AS fn, count(*) FILTER (truth = 0 AND score < threshold) AS tn FROM scored, grid WHERE score IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM cells),
swept AS (SELECT model_key, threshold, p0 AS lm_precision, r0 AS lm_recall, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS human_f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS lm_f1 FROM pr)"""


def _swept(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    return metrics.sweep(rows, ["model_key"], metrics.decision_grid(rows))


@query(f"WITH {SWEEP} SELECT model_key, round(threshold, 6) AS threshold, round(lm_precision, 6) AS lm_precision, round(lm_recall, 6) AS lm_recall, round(human_f1, 6) AS human_f1, round(lm_f1, 6) AS lm_f1, round((human_f1 + lm_f1) / 2, 6) AS avg_f1 FROM swept")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_swept(spark, d), "threshold", "lm_precision", "lm_recall", "human_f1", "lm_f1", "avg_f1")


@query(f"""WITH {SWEEP}, k AS (SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY round((human_f1 + lm_f1) / 2, 12) DESC, round(lm_f1, 12) DESC, round(lm_precision, 12) DESC, threshold) AS k FROM swept) SELECT model_key, round(threshold, 6) AS threshold, round((human_f1 + lm_f1) / 2, 6) AS avg_f1 FROM k WHERE k = 1""")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.best_threshold(_swept(spark, d), ["model_key"]), "threshold", "avg_f1")


@query(f"""WITH {HALVES}, v AS (SELECT model_key, side, (length(code) - length(replace(code, ' ', '')) + 1) AS t FROM halves WHERE code IS NOT NULL AND side IS NOT NULL)
SELECT model_key, round((avg(t) FILTER (side = 'human') - avg(t) FILTER (side = 'lm')) / nullif(sqrt((var_samp(t) FILTER (side = 'human') + var_samp(t) FILTER (side = 'lm')) / 2), 0), 6) AS d FROM v GROUP BY 1""")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    rows = _halves(spark, d).where("code is not null and side is not null").select("model_key", text.space_weight("code").alias("t"), (F.col("side") == "human").cast("int").alias("s"))
    return rounded(metrics.cohens_d(rows, ["model_key"], "t", "s"), "d")


@query(f"""WITH {SCORED}, one AS (SELECT DISTINCT pair_id FROM scored), draws AS (SELECT pair_id, draw, ('0x' || substr(sha256('boot' || chr(0) || draw || chr(0) || pair_id), 1, 8))::UBIGINT / 4294967296.0 AS u FROM one, range(1, 21) t(draw)),
w AS (SELECT pair_id, draw, (u >= 0.36787944)::INT + (u >= 0.73575888)::INT + (u >= 0.91969860)::INT + (u >= 0.98101184)::INT + (u >= 0.99634015)::INT + (u >= 0.99940582)::INT + (u >= 0.99991676)::INT AS weight FROM draws),
cnt AS (SELECT model_key, draw, score, coalesce(sum(weight) FILTER (truth = 1), 0) AS p, coalesce(sum(weight) FILTER (truth = 0), 0) AS n FROM scored JOIN w USING (pair_id) WHERE weight > 0 AND score IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2, 3),
run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model_key, draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt),
auc AS (SELECT model_key, draw, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auroc FROM run GROUP BY 1, 2)
SELECT model_key, count(*) AS draws, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.5), 6) AS median, round(quantile_cont(auroc, 0.975), 6) AS high, round(least(1.0, 2 * least(avg((auroc >= 0.5)::INT), avg((auroc <= 0.5)::INT))), 6) AS p_value FROM auc WHERE auroc IS NOT NULL GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    draws = selection.bootstrap_auroc(_scored(spark, d), ["model_key"], "pair_id", DRAWS, "boot")
    return rounded(selection.intervals(draws, ["model_key"], "auroc"), "mean", "low", "median", "high", "p_value")


@query(f"""WITH {HALVES} SELECT side, split, count(*) AS n, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std, min(t)::INT AS least, max(t)::INT AS most, round(quantile_cont(t, 0.1), 6) AS p10, round(quantile_cont(t, 0.25), 6) AS p25, round(quantile_cont(t, 0.5), 6) AS p50, round(quantile_cont(t, 0.75), 6) AS p75, round(quantile_cont(t, 0.9), 6) AS p90
FROM (SELECT side, split, (length(code) - length(replace(code, ' ', '')) + 1) AS t FROM halves WHERE code IS NOT NULL) GROUP BY 1, 2""")
def describe_by_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _halves(spark, d).where("code is not null").select("side", "split", text.space_weight("code").alias("t"))
    return rounded(metrics.describe(rows, ["side", "split"], "t"), "mean", "std", "p10", "p25", "p50", "p75", "p90")


@query("""WITH l AS (SELECT lower(trim(label)) AS x, label FROM code_pairs) SELECT label, CASE WHEN x IN ('human', '1') THEN 'human' WHEN x IN ('lm', 'ai', 'machine', 'agc', 'mgc', '0') THEN 'lm' END AS mapped, CASE WHEN x = 'human' THEN 'human' WHEN x IN ('lm', 'ai', 'machine', 'agc', 'mgc') THEN 'lm' END AS unmapped, count(*) AS rows FROM l GROUP BY 1, 2, 3""")
def label_spellings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_pairs").groupBy("label", text.normal_label("label").alias("mapped"), text.normal_label("label", digits=False).alias("unmapped")).agg(F.count("*").alias("rows"))


# ---- pairs, ranks, bins and splits

PAIRS = f"""{HALVES}, sized AS (SELECT pair_id, side, (length(code) - length(replace(code, ' ', '')) + 1) AS tokens, CASE WHEN code = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(code, '(\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}])\\z', ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) END AS lines FROM halves WHERE code IS NOT NULL),
pt AS (SELECT pair_id, max(lines) FILTER (side = 'human') AS human_lines, max(lines) FILTER (side = 'lm') AS lm_lines, max(tokens) FILTER (side = 'human') AS human_tokens, max(tokens) FILTER (side = 'lm') AS lm_tokens FROM sized GROUP BY 1 HAVING count(*) = 2 AND max(lines) FILTER (side = 'human') IS NOT NULL AND max(lines) FILTER (side = 'lm') IS NOT NULL),
pairs AS (SELECT *, greatest(human_lines, lm_lines) AS max_lines, greatest(human_tokens, lm_tokens) AS max_tokens, greatest(human_tokens, lm_tokens) / greatest(least(human_tokens, lm_tokens), 1) AS ratio FROM pt)"""
RANKED = f"""{PAIRS}, pc AS (SELECT *, (rank() OVER (ORDER BY max_tokens) + (count(*) OVER (PARTITION BY max_tokens) - 1) / 2.0) / count(*) OVER () AS token_pct, (rank() OVER (ORDER BY max_lines) + (count(*) OVER (PARTITION BY max_lines) - 1) / 2.0) / count(*) OVER () AS line_pct FROM pairs),
ranked AS (SELECT *, (token_pct + line_pct) / 2 AS complexity_score, row_number() OVER (ORDER BY (token_pct + line_pct) / 2, max_tokens, max_lines, pair_id) AS complexity_rank FROM pc)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_table(_halves(spark, d))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return pairs.complexity(cut(_pairs(spark, d), "pairs"))


@query(f"""WITH {HALVES}, g AS (SELECT pair_id, count(*) AS halves, count(*) FILTER (side = 'human') AS humans, count(*) FILTER (side = 'lm') AS machines, count(DISTINCT split) AS splits FROM halves GROUP BY 1)
SELECT *, concat_ws(';', CASE WHEN halves <> 2 THEN 'half_count' END, CASE WHEN humans <> 1 OR machines <> 1 THEN 'labels' END, CASE WHEN splits > 1 THEN 'split' END) AS faults FROM g WHERE halves <> 2 OR humans <> 1 OR machines <> 1 OR splits > 1""")
def pair_validation(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_faults(_halves(spark, d))


@query(f"WITH {PAIRS} SELECT pair_id, human_lines::INT AS human_lines, lm_lines::INT AS lm_lines, human_tokens::INT AS human_tokens, lm_tokens::INT AS lm_tokens, max_lines::INT AS max_lines, max_tokens::INT AS max_tokens, round(ratio, 6) AS ratio FROM pairs")
def pair_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pairs(spark, d), "ratio")


@query(f"""WITH {PAIRS} SELECT pair_id, concat_ws(';', CASE WHEN least(human_tokens, lm_tokens) < 60 THEN 'too_short' END, CASE WHEN max_tokens > 420 THEN 'too_long' END, CASE WHEN max_lines > 40 THEN 'too_many_lines' END, CASE WHEN ratio > 2 THEN 'imbalance' END) AS reasons,
round(abs(max_tokens - 420) / 420 + 0.5 * abs(ratio - 1) + 0.01 * max_lines, 6) AS quality FROM pairs""")
def pair_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.eligibility(_pairs(spark, d), 60, 420, 40, 2.0).select("pair_id", "reasons", "quality"), "quality")


@query(f"WITH {RANKED} SELECT pair_id, round(token_pct, 6) AS token_pct, round(line_pct, 6) AS line_pct, complexity_rank::INT AS complexity_rank FROM ranked")
def complexity_rank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_ranked(spark, d).select("pair_id", "token_pct", "line_pct", "complexity_rank"), "token_pct", "line_pct")


@query(f"""WITH {RANKED}, b AS (SELECT pair_id, complexity_rank, ((complexity_rank - 1) // 10)::INT AS block, sha256('split' || chr(0) || pair_id) AS h FROM ranked), p AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY h, pair_id) AS k, count(*) OVER (PARTITION BY block) AS n FROM b)
SELECT pair_id, block, CASE WHEN k = 1 THEN 'dev' WHEN k = 2 THEN 'test' ELSE 'train' END AS split FROM p WHERE n = 10""")
def complexity_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_complexity(_ranked(spark, d), "complexity_rank", "pair_id", "split").select("pair_id", "block", "split")


@query(f"""WITH {RANKED} SELECT pair_id, size, round(avg(max_tokens) OVER (PARTITION BY size), 6) AS mean_tokens FROM ranked, (VALUES (25), (50), (100)) s(size) WHERE complexity_rank <= size""")
def nested_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.nested_sizes(_ranked(spark, d), "complexity_rank", (25, 50, 100))
    return rounded(rows.select("pair_id", "size", F.avg("max_tokens").over(Window.partitionBy("size")).alias("mean_tokens")), "mean_tokens")


@query(f"""WITH {PAIRS}, u AS (SELECT pair_id, ('0x' || substr(sha256('grouped' || chr(0) || pair_id), 1, 12))::UBIGINT / 281474976710656.0 AS u FROM pairs) SELECT pair_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM u""")
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_pair(_pairs(spark, d), "pair_id", "grouped", {"train": 0.8, "dev": 0.1, "test": 0.1}).select("pair_id", "split")


@query(f"""WITH {HALVES}, p AS (SELECT idx, side, (row_number() OVER (PARTITION BY side ORDER BY sha256('rows' || chr(0) || idx), idx) - 1) / count(*) OVER (PARTITION BY side) AS q FROM halves) SELECT idx, side, CASE WHEN q < 0.8 - 1e-12 THEN 'train' WHEN q < 0.9 - 1e-12 THEN 'dev' ELSE 'test' END AS split FROM p""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.by_fraction(_halves(spark, d), "side", "idx", "rows", {"train": 0.8, "dev": 0.1, "test": 0.1}).select("idx", "side", "split")


@query(f"""WITH {PAIRS}, e AS (SELECT list_distinct(list_sort([quantile_cont(max_tokens, 0.0), quantile_cont(max_tokens, 0.2), quantile_cont(max_tokens, 0.4), quantile_cont(max_tokens, 0.6), quantile_cont(max_tokens, 0.8), quantile_cont(max_tokens, 1.0)])) AS raw FROM pairs), s AS (SELECT list_sort(raw) AS q FROM e)
SELECT pair_id, len(list_filter(q[2:-2], lambda x: max_tokens > x))::INT AS bin FROM pairs, s""")
def qcut_bins(spark: SparkSession, d: str) -> DataFrame:
    return pairs.quantile_bins(_pairs(spark, d), "max_tokens", 5, "bin").select("pair_id", "bin")


@query(f"""WITH {PAIRS}, r AS (SELECT pair_id, row_number() OVER (ORDER BY max_tokens, pair_id) AS k, count(*) OVER () AS n FROM pairs) SELECT pair_id, ((k > 1 + (n - 1) * 0.2)::INT + (k > 1 + (n - 1) * 0.4)::INT + (k > 1 + (n - 1) * 0.6)::INT + (k > 1 + (n - 1) * 0.8)::INT) AS quintile FROM r""")
def quintiles(spark: SparkSession, d: str) -> DataFrame:
    return pairs.equal_bins(cut(_pairs(spark, d), "pairs"), ["max_tokens", "pair_id"], 5, "quintile").select("pair_id", "quintile")


@query(f"""WITH {PAIRS}, e AS (SELECT list_sort([quantile_cont(max_tokens, 0.2), quantile_cont(max_tokens, 0.4), quantile_cont(max_tokens, 0.6), quantile_cont(max_tokens, 0.8)]) AS q FROM pairs), b AS (SELECT pair_id, abs(max_tokens - 420) AS quality, len(list_filter(list_distinct(q), lambda x: max_tokens > x)) AS bin FROM pairs, e),
p AS (SELECT *, CASE WHEN bin < 32 % 5 THEN 7 ELSE 6 END AS take, row_number() OVER (PARTITION BY bin ORDER BY quality, pair_id) AS k FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('pick' || chr(0) || pair_id), pair_id) AS j FROM p WHERE k <= 2 * take) SELECT pair_id, bin::INT AS bin FROM r WHERE j <= take""")
def stratified_select(spark: SparkSession, d: str) -> DataFrame:
    binned = pairs.quantile_bins(_pairs(spark, d).withColumn("quality", F.abs(F.col("max_tokens") - 420)), "max_tokens", 5, "bin")
    return splits.stratified_pick(binned, "bin", "pair_id", "quality", 32, "pick").select("pair_id", "bin")


# ---- candidates and checkpoints

LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_no, tag ORDER BY written_at DESC NULLS LAST) AS k FROM checkpoints WHERE line_no IS NOT NULL AND tag IS NOT NULL) WHERE k = 1)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each checkpoint; equal times go by the rows' digests, so the choice is no chance."""
    checkpoints = table(spark, d, "checkpoints")
    w = Window.partitionBy("line_no", "tag").orderBy(F.col("written_at").desc_nulls_last(), F.xxhash64(*checkpoints.columns))
    return checkpoints.where("line_no is not null and tag is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


@query("""SELECT line_no, tag, CASE WHEN n < 100 THEN 'under_100' WHEN n > 200 THEN 'over_200' WHEN n IS NOT NULL THEN 'type' || lpad((CASE WHEN n <= 110 THEN 1 ELSE (n - 101) // 10 + 1 END)::VARCHAR, 2, '0') || '_' || ((CASE WHEN n <= 110 THEN 1 ELSE (n - 101) // 10 + 1 END) * 10 + 100) END AS bin, count(*) AS rows
FROM (SELECT line_no, tag, length(s) - length(replace(s, ' ', '')) + 1 AS n FROM (SELECT line_no, tag, trim(clean_output, chr(10)) AS s FROM checkpoints)) GROUP BY 1, 2, 3""")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "checkpoints").select("line_no", "tag", text.length_bin(text.space_tokens("clean_output")).alias("bin")).groupBy("line_no", "tag", "bin").agg(F.count("*").alias("rows"))


@query(f"""WITH {LATEST} SELECT line_no, max(source_stratum) AS source_stratum FROM latest GROUP BY line_no HAVING count(*) = 3 AND count(*) FILTER (agc_valid) = 3""")
def common_valid(spark: SparkSession, d: str) -> DataFrame:
    g = _latest(spark, d).groupBy("line_no").agg(F.max("source_stratum").alias("source_stratum"), F.count("*").alias("n"), F.count_if(F.col("agc_valid")).alias("v"))
    return g.where("n = 3 and v = 3").select("line_no", "source_stratum")


@query(f"""WITH {LATEST}, g AS (SELECT line_no, max(source_stratum) AS source_stratum, (count(*) = 3 AND count(*) FILTER (agc_valid) = 3)::INT AS ok FROM latest GROUP BY 1) SELECT source_stratum, count(*) AS prompts, sum(ok)::BIGINT AS common_valid, round(avg(ok), 6) AS rate FROM g GROUP BY 1""")
def stratum_validity(spark: SparkSession, d: str) -> DataFrame:
    g = _latest(spark, d).groupBy("line_no").agg(F.max("source_stratum").alias("source_stratum"), ((F.count("*") == 3) & (F.count_if(F.col("agc_valid")) == 3)).cast("int").alias("ok"))
    return rounded(g.groupBy("source_stratum").agg(F.count("*").alias("prompts"), F.sum("ok").alias("common_valid"), F.avg("ok").alias("rate")), "rate")


@query(f"""WITH {LATEST} SELECT a.agc_valid AS low, b.agc_valid AS high, count(*) AS prompts FROM latest a JOIN latest b ON a.line_no = b.line_no AND a.tag = 't02' AND b.tag = 't06' GROUP BY 1, 2""")
def validity_crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest(spark, d)
    a, b = rows.where("tag = 't02'").select("line_no", F.col("agc_valid").alias("low")), rows.where("tag = 't06'").select("line_no", F.col("agc_valid").alias("high"))
    return a.join(b, "line_no").groupBy("low", "high").agg(F.count("*").alias("prompts"))


@query("""WITH u AS (SELECT DISTINCT lower(prompt_sha256) AS h FROM checkpoints WHERE prompt_sha256 IS NOT NULL AND tag = 't06'), c AS (SELECT line_no, lower(prompt_sha256) AS h FROM candidates WHERE prompt_sha256 IS NOT NULL), r AS (SELECT line_no, row_number() OVER (PARTITION BY h ORDER BY line_no) AS k FROM c WHERE h NOT IN (SELECT h FROM u)) SELECT line_no FROM r WHERE k = 1""")
def exclusion_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate of each prompt of which no checkpoint, at any tag, has the prompt, the human code or the line."""
    used = table(spark, d, "checkpoints").select(hashing.plain_hex("prompt_sha256").alias("h"), hashing.plain_hex("human_sha256").alias("code_hash"), "line_no")
    whole = F.udf(code.canonical, "string", useArrow=True)(F.concat("prompt", "solution"))
    rows = table(spark, d, "candidates").where("prompt_sha256 is not null").select("line_no", hashing.plain_hex("prompt_sha256").alias("h"), F.sha2(whole, 256).alias("code_hash"))
    return matching.unused(rows, used, ["h", "code_hash", "line_no"]).groupBy("h").agg(F.min("line_no").alias("line_no")).select("line_no")


@query("""SELECT line_no, source_stratum, k::INT AS stratum_rank FROM (SELECT line_no, source_stratum, row_number() OVER (PARTITION BY source_stratum ORDER BY substr(sha256('top' || chr(0) || line_no), 1, 16), line_no) AS k FROM candidates) WHERE k <= 5""")
def topk_per_stratum(spark: SparkSession, d: str) -> DataFrame:
    return splits.top_per_stratum(table(spark, d, "candidates"), "source_stratum", "line_no", 5, "top").select("line_no", "source_stratum", "stratum_rank")


@query("SELECT line_no FROM candidates ORDER BY sha256('sample' || chr(0) || line_no), line_no LIMIT 40")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample(table(spark, d, "candidates").select("line_no"), "line_no", 40, "sample")


@query("""WITH t AS (SELECT line_no, source_stratum, row_number() OVER (PARTITION BY source_stratum ORDER BY substr(sha256('top' || chr(0) || line_no), 1, 16), line_no) AS k FROM candidates) SELECT line_no, row_number() OVER (ORDER BY k, source_stratum NULLS FIRST)::INT AS position FROM t WHERE k <= 5""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    top = splits.top_per_stratum(table(spark, d, "candidates").select("line_no", "source_stratum"), "source_stratum", "line_no", 5, "top")
    return splits.interleave(top, "source_stratum", "stratum_rank").select("line_no", "position")


@query("""WITH n AS (SELECT count(*) AS n FROM candidates), r AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS k FROM candidates), w AS (SELECT 1 + round_even(i * (n - 1) / 6.0, 0) AS k FROM n, range(7) t(i)) SELECT line_no, k::INT AS position FROM r SEMI JOIN w USING (k)""")
def even_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("line_no")
    return pairs.with_positions(rows, ["line_no"], "position").where(F.col("position").isin(splits.even_positions(rows.count(), 7)))


@query("""SELECT idx, code, label FROM (SELECT line_no || '_human' AS idx, solution AS code, 'human' AS label FROM candidates UNION ALL SELECT line_no || '_lm', prompt, 'lm' FROM candidates)""")
def two_rows(spark: SparkSession, d: str) -> DataFrame:
    return readers.two_rows(table(spark, d, "candidates"), "line_no", "solution", "prompt")


@query("""SELECT CASE WHEN lower(relative_path) LIKE '%.py' THEN 'python' WHEN lower(relative_path) LIKE '%.java' THEN 'java' WHEN regexp_matches(lower(relative_path), '\\.(cpp|cc|cxx|hpp|h)$') THEN 'cpp' END AS language, count(*) AS candidates, round(100.0 * avg((human_body_tokens > 512)::INT), 6) AS over_512, round(100.0 * avg((human_body_tokens > 128)::INT), 6) AS over_128 FROM candidates GROUP BY 1""")
def token_limits(spark: SparkSession, d: str) -> DataFrame:
    over = lambda n: (100 * F.avg((F.col("human_body_tokens") > n).cast("int")))
    rows = table(spark, d, "candidates").groupBy(text.language_of_path("relative_path").alias("language")).agg(F.count("*").alias("candidates"), over(512).alias("over_512"), over(128).alias("over_128"))
    return rounded(rows, "over_512", "over_128")


@query("""SELECT line_no, CASE WHEN n = 3 THEN a || '\"\"\"' || b || '\"\"\"' END AS head, n FROM (SELECT line_no, len(p) AS n, p[1] AS a, p[2] AS b FROM (SELECT line_no, string_split(replace(prompt, '''''''', '\"\"\"'), '\"\"\"') AS p FROM candidates))""")
def docstring_split(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split(F.regexp_replace("prompt", "'''", '"""'), '"""', -1)
    head, _ = text.docstring_split("prompt")
    return table(spark, d, "candidates").select("line_no", F.when(F.size(parts) == 3, head).alias("head"), F.size(parts).alias("n"))


# ---- events

EVENTS = r"""ev AS (SELECT manifest_row_number, nullif(trim(function_event_id), '') AS function_event_id, nullif(trim(dataset_source), '') AS dataset_source, nullif(trim(repo_name), '') AS repo_name, nullif(trim(month), '') AS time, lower(nullif(trim(scan_current_commit), '')) AS "commit", commit_order::BIGINT AS commit_order, nullif(trim(relative_path), '') AS relative_path,
nullif(trim(qualified_function_name), '') AS qualified_function_name, occurrence_index, CASE WHEN lower(nullif(trim(change_type), '')) IN ('a', 'add', 'added', 'new', 'created') THEN 'added' WHEN lower(nullif(trim(change_type), '')) IN ('m', 'mod', 'modify', 'modified', 'changed', 'update', 'updated') THEN 'modified' END AS change_type, start_line, end_line, lower(nullif(trim(content_sha256), '')) AS content_sha256 FROM function_manifest),
ek AS (SELECT *, coalesce(function_event_id, concat_ws(chr(1), repo_name, "commit", relative_path, qualified_function_name, occurrence_index)) AS k FROM ev), de AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY manifest_row_number NULLS LAST) AS n FROM ek) WHERE n = 1)"""
SUMMARY = r"""count(*) AS events, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified, count(DISTINCT {'a': relative_path, 'b': qualified_function_name}) AS functions, count(DISTINCT relative_path) AS files, count(DISTINCT "commit") AS commits, min((content_sha256 IS NOT NULL)::INT) AS complete, sum(coalesce(end_line - start_line + 1, 0))::BIGINT AS lines"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return events.distinct_events(events.canonical(table(spark, d, "function_manifest"), ("ingested_at",)))


@query(f"""WITH {EVENTS} SELECT dataset_source, repo_name, time, {SUMMARY} FROM de GROUP BY 1, 2, 3""")
def repo_month_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.summary(_events(spark, d), ["dataset_source", "repo_name", "time"])


@query(f"""WITH {EVENTS} SELECT repo_name, "commit", {SUMMARY} FROM de GROUP BY 1, 2""")
def commit_summary(spark: SparkSession, d: str) -> DataFrame:
    return events.summary(_events(spark, d), ["repo_name", "commit"])


@query(r"""WITH v AS (SELECT function_event_id AS i FROM (SELECT nullif(trim(function_event_id), '') AS function_event_id FROM function_manifest)) SELECT i AS function_event_id, count(*) AS rows FROM v WHERE i IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def repeated_events(spark: SparkSession, d: str) -> DataFrame:
    return events.repeated_events(events.canonical(table(spark, d, "function_manifest")))


@query(f"""WITH {EVENTS} SELECT manifest_row_number::BIGINT AS manifest_row_number, row_number() OVER (PARTITION BY repo_name ORDER BY dataset_source NULLS FIRST, time NULLS FIRST, coalesce(commit_order, 1000000000000), "commit" NULLS FIRST, relative_path NULLS FIRST, qualified_function_name NULLS FIRST, occurrence_index NULLS FIRST, manifest_row_number)::INT AS place FROM de""")
def event_order(spark: SparkSession, d: str) -> DataFrame:
    return events.ordered(_events(spark, d)).select("manifest_row_number", "place")


@query(rf"""WITH {EVENTS} SELECT faults, count(*) AS rows FROM (SELECT concat_ws(';', CASE WHEN NOT coalesce(regexp_matches(time, '^\d{{4}}-(0[1-9]|1[0-2])$'), false) THEN 'month' END, CASE WHEN NOT coalesce(regexp_matches("commit", '^[0-9a-f]{{7,40}}$'), false) THEN 'commit' END,
CASE WHEN relative_path IS NULL OR relative_path LIKE '/%' OR regexp_matches(relative_path, '(^|/)\.\.(/|$)') THEN 'path' END, CASE WHEN change_type IS NULL THEN 'change_type' END, CASE WHEN content_sha256 IS NOT NULL AND NOT regexp_matches(content_sha256, '^[0-9a-f]{{64}}$') THEN 'sha256' END, CASE WHEN repo_name IS NULL OR qualified_function_name IS NULL THEN 'missing' END) AS faults FROM ev) GROUP BY 1""")
def event_rejects(spark: SparkSession, d: str) -> DataFrame:
    return events.rejects(events.canonical(table(spark, d, "function_manifest"))).groupBy("faults").agg(F.count("*").alias("rows"))


@query(f"""WITH {EVENTS}, m AS (SELECT repo_name, time AS month, count(*) AS events FROM de WHERE repo_name IS NOT NULL GROUP BY 1, 2), f AS (SELECT repo_name, substr(snapshot_time, 1, 7) AS month, snapshot_id, snapshot_time, count(DISTINCT relative_path) AS files, sum(physical_line_count)::BIGINT AS lines FROM source_files GROUP BY 1, 2, 3, 4),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_name, month ORDER BY snapshot_time DESC NULLS LAST, snapshot_id DESC NULLS LAST) AS k FROM f) WHERE k = 1)
SELECT m.repo_name, m.month, m.events, l.snapshot_id, l.files, l.lines, CASE WHEN l.snapshot_id IS NULL THEN 'missing_snapshot' ELSE 'ok' END AS status FROM m LEFT JOIN l ON m.repo_name = l.repo_name AND m.month = l.month""")
def panel_left_join(spark: SparkSession, d: str) -> DataFrame:
    months = _events(spark, d).where("repo_name is not null").groupBy("repo_name", F.col("time").alias("month")).agg(F.count("*").alias("events"))
    snaps = table(spark, d, "source_files").groupBy("repo_name", F.substring("snapshot_time", 1, 7).alias("month"), "snapshot_id", "snapshot_time").agg(F.count_distinct("relative_path").alias("files"), F.sum("physical_line_count").alias("lines"))
    return events.panel(months, snaps)


@query(f"""WITH {EVENTS}, i AS (SELECT function_event_id, dataset_source, content_sha256, change_type FROM de WHERE function_event_id IS NOT NULL), g AS (SELECT *, CASE WHEN content_sha256 IS NULL THEN 'no_hash' WHEN change_type IS NULL THEN 'no_change' END AS grp FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY sha256('pilot' || chr(0) || function_event_id), function_event_id) AS k FROM g WHERE grp IS NULL) SELECT function_event_id, dataset_source, grp AS "group" FROM g WHERE grp IS NOT NULL UNION ALL SELECT function_event_id, dataset_source, 'normal_' || dataset_source FROM n WHERE k <= 10""")
def mixed_pilot(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).where("function_event_id is not null")
    return events.mixed_pilot(rows, {"no_hash": rows.where("content_sha256 is null"), "no_change": rows.where("change_type is null")}, 10, "pilot")


@query("""SELECT verdict, count(*) AS rows FROM (SELECT CASE WHEN b.r IS NULL THEN 'left_only' WHEN a.r IS NULL THEN 'right_only' WHEN a.n = b.n THEN 'equal' ELSE 'different' END AS verdict FROM (SELECT repo_name, relative_path, count(*) AS n, 1 AS r FROM source_files GROUP BY 1, 2) a FULL JOIN (SELECT repo_name, relative_path, count(*) AS n, 1 AS r FROM function_manifest GROUP BY 1, 2) b ON a.repo_name = b.repo_name AND a.relative_path = b.relative_path) GROUP BY 1""")
def integrity_compare(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t: table(spark, d, t).groupBy("repo_name", "relative_path").agg(F.count("*").alias("n"))
    return checks.compare(count("source_files"), count("function_manifest"), ["repo_name", "relative_path"], ["n"])


# ---- candidate matrices

CELLS = """auc AS (SELECT model, max(precision) AS auroc FROM combined_block_metrics WHERE class = 'auroc' GROUP BY 1), f AS (SELECT model, max(f1) AS avg_f1 FROM combined_block_metrics WHERE class = 'avg' GROUP BY 1), c AS (SELECT f.model, coalesce(auroc, 0) AS auroc, avg_f1 FROM f LEFT JOIN auc ON f.model = auc.model)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "combined_block_metrics")
    auc = m.where("class = 'auroc'").groupBy("model").agg(F.max("precision").alias("auroc"))
    return m.where("class = 'avg'").groupBy("model").agg(F.max("f1").alias("avg_f1")).join(auc, "model", "left").select("model", F.coalesce("auroc", F.lit(0.0)).alias("auroc"), "avg_f1")


@query(f"WITH {CELLS} SELECT model, rank() OVER (ORDER BY avg_f1 DESC)::INT AS f1_rank, rank() OVER (ORDER BY auroc DESC)::INT AS auroc_rank, round(greatest(max(avg_f1) OVER () - avg_f1, max(auroc) OVER () - auroc), 6) AS regret FROM c")
def competition_ranks(spark: SparkSession, d: str) -> DataFrame:
    one = _cells(spark, d).withColumn("draw", F.lit(1))
    out = selection.regret(selection.ranks(selection.ranks(one, ["draw"], "avg_f1", "f1_rank"), ["draw"], "auroc", "auroc_rank"), ["draw"], "avg_f1", "auroc")
    return rounded(out.select("model", "f1_rank", "auroc_rank", "regret"), "regret")


@query(f"WITH {CELLS} SELECT a.model FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.avg_f1 >= a.avg_f1 AND b.auroc >= a.auroc AND (b.avg_f1 > a.avg_f1 OR b.auroc > a.auroc))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return selection.pareto(_cells(spark, d), "model", "avg_f1", "auroc").select("model")


@query(f"WITH {CELLS} SELECT a.model AS a, b.model AS b, round(a.avg_f1 - b.avg_f1, 6) AS difference FROM c a JOIN c b ON a.model < b.model")
def pairwise_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.differences(_cells(spark, d), "model", "avg_f1"), "difference")


TRANSFER = f"""{SCORED}, cut AS (SELECT model_key AS source, quantile_cont(score, 0.5) AS c FROM scored WHERE model_key IS NOT NULL AND score IS NOT NULL AND truth IS NOT NULL GROUP BY 1), cells AS (SELECT source, model_key AS target, avg(((score >= c)::INT = truth)::INT) AS accuracy FROM scored, cut WHERE model_key IS NOT NULL AND score IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2)"""


def _transfer(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each model's own median threshold on every model's rows; the models are few."""
    rows = _scored(spark, d).where("model_key is not null and score is not null and truth is not null")
    own = {r["model_key"]: r["c"] for r in rows.groupBy("model_key").agg(F.percentile("score", F.lit(0.5)).alias("c")).collect()}
    limits = F.array(*[F.struct(F.lit(m).alias("source"), F.lit(c).alias("c")) for m, c in sorted(own.items())])
    at = rows.groupBy(F.col("model_key").alias("target"), "score", "truth").agg(F.count("*").alias("n")).select("*", F.explode(limits).alias("l"))
    right = F.when((F.col("score") >= F.col("l.c")).cast("int") == F.col("truth"), F.col("n")).otherwise(0)
    return at.groupBy(F.col("l.source").alias("source"), "target").agg((F.sum(right) / F.sum("n")).alias("accuracy"))


@query(f"WITH {TRANSFER} SELECT source, target, round(accuracy, 6) AS accuracy FROM cells")
def transfer_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_transfer(spark, d), "accuracy")


@query(f"WITH {TRANSFER} SELECT source, round(max(accuracy) FILTER (source = target), 6) AS same, round(avg(accuracy) FILTER (source <> target), 6) AS transfer FROM cells GROUP BY 1")
def offdiag_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.off_diagonal(_transfer(spark, d), "source", "target", "accuracy"), "same", "transfer")


@query(f"WITH {TRANSFER} SELECT x.source AS a, y.source AS b, round(avg(x.accuracy), 6) AS mean_a, round(avg(y.accuracy), 6) AS mean_b, count(*) AS targets FROM cells x JOIN cells y ON x.target = y.target AND x.source < y.source AND x.target <> x.source AND x.target <> y.source GROUP BY 1, 2")
def common_targets(spark: SparkSession, d: str) -> DataFrame:
    return rounded(selection.common_targets(cut(_transfer(spark, d), "cells"), "source", "target", "accuracy"), "mean_a", "mean_b")


@query()
def transfer_matrix(spark: SparkSession, d: str) -> DataFrame:
    """One column per model, so its columns follow the data."""
    cells = cut(_transfer(spark, d), "cells")
    return selection.matrix(cells, "source", "target", "accuracy", sorted(r["source"] for r in cells.select("source").distinct().collect()))


@query()
def draw_summary(spark: SparkSession, d: str) -> DataFrame:
    draws = selection.bootstrap_auroc(_scored(spark, d), ["model_key"], "pair_id", DRAWS, "boot").where("auroc is not null")
    return selection.draw_summary(draws, "model_key", "auroc")


# ---- texts

@query("SELECT source, lang, count(*) AS rows FROM documents GROUP BY 1, 2 ORDER BY rows DESC, source, lang LIMIT 20")
def value_counts_top20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.col("source").asc_nulls_last(), F.col("lang").asc_nulls_last()).limit(20)


@query(r"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(t, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) END::INT AS lines, len(list_filter(regexp_split_to_array(t, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''))::INT AS words,
(length(s) - length(replace(s, ' ', '')) + 1)::INT AS space_tokens, (length(t) - length(replace(t, ' ', '')) + 1)::INT AS space_weight FROM (SELECT doc_id, text AS t, trim(text, chr(10)) AS s FROM documents)""")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", text.line_count("text").alias("lines"), text.word_count("text").alias("words"), text.space_tokens("text").alias("space_tokens"), text.space_weight("text").alias("space_weight"))


@query(r"""WITH q AS (SELECT item_id AS query_id, item_text AS query_text FROM heldout_items WHERE item_id % 50 = 0), qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query_text), '\s+')) AS term FROM q) WHERE term <> ''),
dt AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\s+')) AS term FROM documents) WHERE term <> ''), dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM dt GROUP BY 1),
ri AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM df, st), mi AS (SELECT avg(idf) AS m FROM ri), idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM ri, mi), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2), rk AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 9) DESC, doc_id) AS k FROM sc JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, round(score, 5) AS score, k::INT AS place FROM rk WHERE k <= 2""")
def bm25_top2(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "heldout_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("item_text").alias("query_text"))
    return rounded(retrieval.bm25(table(spark, d, "documents").select("doc_id", "text", "source"), asked, 2, "source").select("query_id", "doc_id", "source", "score", "place"), "score", digits=5)


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, unnest(range(len(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))))) AS n FROM documents),
h AS (SELECT *, CASE WHEN line LIKE '## %' THEN substr(line, 4) END AS heading, regexp_extract(line, 'took ([0-9.]+) minutes', 1) AS minutes FROM l), f AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h) SELECT doc_id, n::INT AS n, section, minutes::DOUBLE AS minutes FROM f WHERE minutes <> ''""")
def log_state_parse(spark: SparkSession, d: str) -> DataFrame:
    """The last heading carried forward to each line that tells how long a job took."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n", -1)).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    marked = lines.withColumn("section", F.last(F.when(F.col("line").startswith("## "), F.substring("line", 4, 10**6)), ignorenulls=True).over(w)).withColumn("minutes", F.regexp_extract("line", r"took ([0-9.]+) minutes", 1))
    return marked.where("minutes <> ''").select("doc_id", "n", "section", F.col("minutes").cast("double").alias("minutes"))


@query("""WITH c AS (SELECT repo_name, line_no, CASE WHEN solution = '' THEN 0 ELSE len(string_split(rtrim(solution, chr(10)), chr(10))) END AS n FROM candidates WHERE solution IS NOT NULL AND repo_name IS NOT NULL) SELECT line_no, repo_name, (4 + coalesce(sum(n + 1) OVER (PARTITION BY repo_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS start_line, (4 + coalesce(sum(n + 1) OVER (PARTITION BY repo_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n)::BIGINT AS end_line FROM c""")
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where each solution stands in a file of its repository that has four header lines and one blank line between blocks."""
    rows = table(spark, d, "candidates").where("solution is not null and repo_name is not null")
    n = F.when(F.col("solution") == "", 0).otherwise(F.size(F.split(F.regexp_replace("solution", r"\n+\z", ""), "\n", -1)))
    sized = rows.select("line_no", "repo_name", n.alias("n"))
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("repo_name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.select("line_no", "repo_name", (before + 5).alias("start_line"), (before + 4 + F.col("n")).alias("end_line"))


@query("""SELECT vec_id, 0.25::DOUBLE AS drift FROM embeddings WHERE embedding IS NOT NULL""")
def vector_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    moved = e.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.25)).alias("embedding"))
    return rounded(checks.vector_drift(e, moved, "vec_id", "embedding"), "drift")


# ---- analysis of source text, which SQL can't express

@query()
def code_analysis(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest(spark, d).where("agc_code is not null").select("line_no", "tag", "agc_code")
    paths = table(spark, d, "candidates").where("lower(relative_path) like '%.py'").select("line_no")
    return code.analysed(rows.join(paths, "line_no", "left_semi"), "agc_code")


@query()
def node_words(spark: SparkSession, d: str) -> DataFrame:
    """The keywords and operators that occur in valid Python answers, with how many have them."""
    found = cut(code_analysis(spark, d).where("ok").select("keywords", "operators"), "words")
    kinds = [found.select(F.lit(k).alias("kind"), F.explode(c).alias("word")) for k, c in (("keyword", "keywords"), ("operator", "operators"))]
    return kinds[0].union(kinds[1]).groupBy("kind", "word").agg(F.count("*").alias("sources"))


@query()
def cleaned_outputs(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "candidates").groupBy("line_no").agg(F.first("prompt", ignorenulls=True).alias("prompt"))
    return cleaning.with_cleaned(_latest(spark, d).select("line_no", "tag", "raw_output").join(prompts, "line_no"), "prompt", "raw_output")


@query()
def embedding_classifier(spark: SparkSession, d: str) -> DataFrame:
    """A logistic regression on half of the embeddings (label 0 against the rest), scored on the other half."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), (F.col("label") == 0).cast("double").alias("label"), hashing.bucket("half", 2, "vec_id").alias("half"))
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(rows.where("half = 0"))
    return model.transform(rows.where("half = 1")).select("vec_id", F.col("label").cast("int").alias("truth"), vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("pred"))
