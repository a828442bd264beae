"""Further queries of the core: text functions, matching, samples, checks and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.functions import code, hashing, text
from provenir.operators import checks, matching, metrics, pairs, quantiles, rollup, selection, splits, vectors
from provenir.plans.registry import DRAWS, EVENTS, HALVES, LATEST, OCC, RANKED, SCORED, _events, _halves, _latest, _ranked, _scored, query, rounded
from provenir.runtime import cut, table
from provenir.sources import readers


@query("""SELECT line_no, tag, CASE WHEN raw_output IS NOT NULL THEN string_split(raw_output, '<|endoftext|>')[1] END AS head FROM checkpoints""")
def marker_cut(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "checkpoints").select("line_no", "tag", text.until_marker("raw_output").alias("head"))


@query(r"""SELECT line_no, tag, CASE WHEN regexp_matches(raw_output, '```[\w+-]*\n') THEN regexp_extract(raw_output, '(?s)```[\w+-]*\n(.*?)(?:```|\z)', 1) ELSE raw_output END AS inside FROM checkpoints""")
def fenced_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "checkpoints").select("line_no", "tag", text.without_fences("raw_output").alias("inside"))


@query(r"""SELECT idx, coalesce(nullif(regexp_extract(code, '(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(', 1), ''), nullif(regexp_extract(code, '(?m)^\s*class\s+(\w+)', 1), ''), '<anon>') AS name FROM code_pairs""")
def function_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_pairs").select("idx", text.first_name("code").alias("name"))


@query("""SELECT manifest_row_number, string_split(qualified_function_name, '.')[-1] AS leaf, regexp_replace(repo_name, '[^A-Za-z0-9._-]+', '_', 'g') AS label, CASE WHEN lower(trim(change_type)) IN ('1', 'true', 't', 'yes', 'y') THEN true WHEN lower(trim(change_type)) IN ('0', 'false', 'f', 'no', 'n', '') THEN false END AS flag FROM function_manifest""")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_manifest").select("manifest_row_number", text.leaf_name("qualified_function_name").alias("leaf"), text.safe_label("repo_name").alias("label"), text.truthy("change_type").alias("flag"))


@query("""SELECT doc_id, octet_length(encode(substr(text, 1, (n_chars // 2)::INT)))::INT AS bytes, replace(replace(substr(text, 1, 40), '{', '{{'), '}', '}}') AS escaped FROM documents""")
def byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.byte_offset("text", F.floor(F.col("n_chars") / 2)).alias("bytes"), text.escape_braces("text").alias("escaped"))


@query("""SELECT line_no, (('0x' || substr(sha256('seed' || chr(0) || line_no), 1, 16))::UBIGINT % 9223372036854775807)::BIGINT AS seed FROM candidates""")
def row_seeds(spark: SparkSession, d: str) -> DataFrame:
    """A seed per row: the first eight bytes of its hash, below 2^63 - 1."""
    number = F.conv(F.substring(hashing.seeded("seed", "line_no"), 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, d, "candidates").select("line_no", F.pmod(number, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint").alias("seed"))


@query(f"""WITH {RANKED}, s AS (SELECT * FROM ranked, (VALUES (10), (50), (200)) t(size) WHERE complexity_rank <= size) SELECT size, count(*) AS pairs, round(avg(max_tokens), 6) AS mean_tokens, max(max_tokens)::INT AS most_tokens, max(max_lines)::INT AS most_lines FROM s GROUP BY 1""")
def size_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the smallest 10, 50 and 200 pairs hold."""
    rows = _ranked(spark, d).withColumn("size", F.explode(F.array(F.lit(10), F.lit(50), F.lit(200)))).where("complexity_rank <= size")
    return rounded(rows.groupBy("size").agg(F.count("*").alias("pairs"), F.avg("max_tokens").alias("mean_tokens"), F.max("max_tokens").alias("most_tokens"), F.max("max_lines").alias("most_lines")), "mean_tokens")


@query(f"""WITH {HALVES}, r AS (SELECT idx, side, row_number() OVER (PARTITION BY side ORDER BY sha256('mix' || chr(0) || idx), idx) AS k FROM halves WHERE side IS NOT NULL AND code IS NOT NULL) SELECT ((k - 1) // 3 + 1)::INT AS sample, idx, side FROM r WHERE k <= 30""")
def mixed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Ten samples of three human and three machine halves, none used twice: ranks of one seeded order per side."""
    order = Window.partitionBy("side").orderBy(hashing.seeded("mix", "idx"), "idx")
    ranked = _halves(spark, d).where("side is not null and code is not null").withColumn("k", F.row_number().over(order)).where("k <= 30")
    return ranked.select((F.floor((F.col("k") - 1) / 3) + 1).cast("int").alias("sample"), "idx", "side")


@query(f"""WITH {SCORED}, m AS (SELECT quantile_cont(score, 0.5) AS c FROM scored), s AS (SELECT 'all' AS subset, scored.* FROM scored, m UNION ALL SELECT 'large', scored.* FROM scored, m WHERE score < c UNION ALL SELECT 'small', scored.* FROM scored, m WHERE score >= c),
cnt AS (SELECT subset, score, count(*) FILTER (truth = 1) AS p, count(*) FILTER (truth = 0) AS n FROM s WHERE score IS NOT NULL AND truth IS NOT NULL GROUP BY 1, 2), run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY subset ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cnt)
SELECT subset, round(sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0), 9) AS auroc FROM run GROUP BY 1""")
def subset_auroc(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    middle = quantiles.exact_quantiles(rows, "score", [0.5])[0]
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("score") < F.lit(middle), "large"), F.when(F.col("score") >= F.lit(middle), "small")))
    return rounded(metrics.auroc(rows.withColumn("subset", F.explode(sets)), ["subset"]).select("subset", "auroc"), "auroc", digits=9)


@query(f"""WITH {OCC} SELECT count(*) AS units, count(*) FILTER (score IS NULL) AS unscored, round(max(abs(score)), 9) AS greatest, count(*) FILTER (agc NOT IN (0, 1)) AS bad_class FROM occ""")
def score_audit(spark: SparkSession, d: str) -> DataFrame:
    occ = rollup.distinct_occurrences(table(spark, d, "occurrences"))
    return rounded(occ.agg(F.count("*").alias("units"), F.count_if(F.col("human_decision_score").isNull()).alias("unscored"), F.max(F.abs("human_decision_score")).alias("greatest"), F.count_if(~F.col("predicted_agc").isin(0, 1)).alias("bad_class")), "greatest", digits=9)


@query(f"""WITH {HALVES} SELECT split, count(*) AS rows, sum(('0x' || substr(md5(concat_ws(chr(1), pair_id, side)), 1, 8))::UBIGINT)::BIGINT AS signature FROM halves GROUP BY 1""")
def support_signature(spark: SparkSession, d: str) -> DataFrame:
    return checks.signature(_halves(spark, d), ["split"], ["pair_id", "side"])


@query(f"""WITH {HALVES}, p AS (SELECT pair_id, min(idx) FILTER (side = 'human') AS id1, min(idx) FILTER (side = 'lm') AS id2 FROM halves GROUP BY 1) SELECT p.pair_id, length(a.code)::INT AS chars1, length(b.code)::INT AS chars2 FROM p JOIN halves a ON a.idx = p.id1 JOIN halves b ON b.idx = p.id2 WHERE a.code IS NOT NULL AND b.code IS NOT NULL""")
def clone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids with both texts looked up; pairs that lack one are left out."""
    h = cut(_halves(spark, d), "halves")
    ids = h.groupBy("pair_id").agg(F.min(F.when(F.col("side") == "human", F.col("idx"))).alias("id1"), F.min(F.when(F.col("side") == "lm", F.col("idx"))).alias("id2"))
    side = lambda n: h.select(F.col("idx").alias(f"id{n}"), F.length("code").alias(f"chars{n}"))
    return ids.join(side(1), "id1", "left").join(side(2), "id2", "left").na.drop(subset=["chars1", "chars2"]).select("pair_id", "chars1", "chars2")


@query(f"""WITH {EVENTS}, r AS (SELECT repo_name, relative_path, "commit", manifest_row_number AS k, start_line, end_line FROM de WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND repo_name IS NOT NULL AND relative_path IS NOT NULL AND "commit" IS NOT NULL),
i AS (SELECT a.repo_name, a.relative_path, a."commit", a.k, b.k AS o, b.end_line - b.start_line AS span FROM r a JOIN r b ON a.repo_name = b.repo_name AND a.relative_path = b.relative_path AND a."commit" = b."commit" AND b.start_line <= a.start_line AND a.end_line <= b.end_line AND (b.start_line < a.start_line OR a.end_line < b.end_line)),
m AS (SELECT *, min(span) OVER (PARTITION BY repo_name, relative_path, "commit", k) AS least FROM i) SELECT repo_name, relative_path, "commit", k::BIGINT AS manifest_row_number, min(o)::BIGINT AS "outer" FROM m WHERE span = least GROUP BY 1, 2, 3, 4 HAVING count(*) = 1""")
def enclosing_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).where("start_line is not null and end_line is not null and repo_name is not null and relative_path is not null and commit is not null")
    return matching.enclosing(cut(rows.select("repo_name", "relative_path", "commit", "manifest_row_number", "start_line", "end_line"), "ranges"), ["repo_name", "relative_path", "commit"], "manifest_row_number")


@query("""WITH d AS (SELECT repo_name, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files, sum(physical_line_count)::BIGINT AS lines FROM source_files GROUP BY 1, 2) SELECT * FROM d""")
def directory_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").groupBy("repo_name", F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("physical_line_count").alias("lines"))


@query(f"""WITH {LATEST}, m AS (SELECT max(line_no) AS m FROM candidates), f AS (SELECT line_no, tag FROM latest WHERE NOT coalesce(accepted_for_pool, false) AND agc_valid) SELECT line_no, tag, (m + row_number() OVER (PARTITION BY tag ORDER BY line_no))::INT AS new_id FROM f, m""")
def top_up_ids(spark: SparkSession, d: str) -> DataFrame:
    """Valid answers not yet in the pool, numbered per tag from the greatest id on."""
    most = table(spark, d, "candidates").agg(F.max("line_no")).first()[0]
    rows = _latest(spark, d).where("not coalesce(accepted_for_pool, false) and agc_valid")
    return rows.select("line_no", "tag", (F.lit(most) + F.row_number().over(Window.partitionBy("tag").orderBy("line_no"))).cast("int").alias("new_id"))


@query("""WITH r AS (SELECT bucket, line_no, tag, row_number() OVER (PARTITION BY bucket ORDER BY line_no, tag) - 1 AS k, count(*) OVER (PARTITION BY bucket) AS n FROM (SELECT DISTINCT bucket, line_no, tag FROM checkpoints WHERE bucket IS NOT NULL AND tag IS NOT NULL)),
g AS (SELECT *, least(4, floor(((k + 1) * 5 - 1) / n))::INT AS range FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY bucket, range ORDER BY sha256('range' || chr(0) || line_no || chr(0) || tag), line_no, tag) AS j FROM g) SELECT bucket, range, line_no, tag FROM p WHERE j = 1""")
def equal_ranges(spark: SparkSession, d: str) -> DataFrame:
    """One record, by seeded order, of each of five equal ranges of every bucket."""
    rows = table(spark, d, "checkpoints").where("bucket is not null and tag is not null").select("bucket", "line_no", "tag").distinct()
    w = Window.partitionBy("bucket")
    placed = rows.withColumn("k", F.row_number().over(w.orderBy("line_no", "tag")) - 1).withColumn("n", F.count("*").over(w))
    ranged = placed.withColumn("range", F.least(F.lit(4), F.floor(((F.col("k") + 1) * 5 - 1) / F.col("n"))).cast("int"))
    pick = Window.partitionBy("bucket", "range").orderBy(hashing.seeded("range", "line_no", "tag"), "line_no", "tag")
    return ranged.withColumn("j", F.row_number().over(pick)).where("j = 1").select("bucket", "range", "line_no", "tag")


@query(f"""WITH {RANKED}, o AS (SELECT pair_id, complexity_rank, row_number() OVER (ORDER BY sha256('fixed' || chr(0) || pair_id), pair_id) AS k FROM ranked), t AS (SELECT pair_id, row_number() OVER (ORDER BY complexity_rank) AS j FROM o WHERE k > 200)
SELECT size, pair_id, role FROM (SELECT pair_id, CASE WHEN k <= 100 THEN 'dev' ELSE 'test' END AS role, 0 AS j FROM o WHERE k <= 200 UNION ALL SELECT pair_id, 'train', j FROM t), (VALUES (25), (50), (100)) s(size) WHERE j <= size""")
def fixed_eval_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A hundred pairs each for dev and test, and growing prefixes of the other pairs by complexity."""
    return splits.fixed_eval(_ranked(spark, d), "pair_id", "complexity_rank", 100, 100, (25, 50, 100), "fixed")


# ---- what SQL can't express

@query()
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where("lower(relative_path) like '%.py' and file_text is not null").select("snapshot_id", "relative_path", "file_text").dropDuplicates(["snapshot_id", "relative_path"])
    return code.with_blocks(files, "file_text")


@query()
def docstring_only(spark: SparkSession, d: str) -> DataFrame:
    rows = _halves(spark, d).where("code is not null").select("side", "code")
    return code.analysed(rows, "code").groupBy("side").agg(F.count("*").alias("sources"), F.count_if(F.col("docstring_only")).alias("docstring_only"), F.count_if(~F.col("ok")).alias("invalid"), F.count_if(~F.col("returns")).alias("no_return"))


@query()
def event_digests(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("manifest_row_number", "repo_name", "commit", "relative_path", "qualified_function_name", "occurrence_index")
    return code.with_digest(rows, ["repo_name", "commit", "relative_path", "qualified_function_name", "occurrence_index"], "digest").select("manifest_row_number", "digest")


@query()
def chat_lines(spark: SparkSession, d: str) -> DataFrame:
    return readers.chat_lines(table(spark, d, "candidates").where("prompt is not null"), "prompt", "solution", "Complete the function.")


@query()
def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Skip-gram vectors of the words of the training rows, human and machine; 128 wide and five passes, as the reference's."""
    rows = _halves(spark, d).where("code is not null and side is not null and split = 'train'").select("idx", "code")
    return vectors.skip_gram(rows, "idx", "code", size=128, least=3, passes=5, parts=6, seed=1)


@query()
def size_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Eight standardised static metrics of code into a small neural network: human or machine."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _halves(spark, d).where("code is not null and side is not null").select("idx", "split", (F.col("side") == "human").cast("double").alias("label"), "code")
    rows = cut(code.with_metrics(rows, "code"), "metrics")
    stages = [VectorAssembler(inputCols=list(code.METRICS), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), MultilayerPerceptronClassifier(layers=[8, 100, 2], maxIter=200, seed=1)]
    model = Pipeline(stages=stages).fit(rows.where("split = 'train'"))
    return model.transform(rows.where("split = 'test'")).select("idx", F.col("label").cast("int").alias("truth"), vector_to_array("probability")[1].alias("score"))


@query()
def threshold_gains(spark: SparkSession, d: str) -> DataFrame:
    """What tuning the threshold on dev gains on test over the median, for three scores over the models, and the best cell."""
    sizes = {"tokens": text.space_weight("code"), "lines": text.line_count("code"), "words": text.word_count("code")}
    rows = cut(_halves(spark, d).where("code is not null and side is not null").select("split", "model_key", (F.col("side") == "human").cast("int").alias("truth"), *((-c).cast("double").alias(n) for n, c in sizes.items())), "sizes")
    cells = None
    for name in sizes:
        scored = rows.select("split", "model_key", "truth", F.col(name).alias("score"))
        dev, test = scored.where("split = 'dev'"), scored.where("split = 'test'")
        middle, grid = dev.agg(F.percentile("score", F.lit(0.5))).first()[0], metrics.decision_grid(dev)
        best = metrics.best_threshold(metrics.sweep(dev, ["model_key"], grid), ["model_key"]).select("model_key", "threshold")
        tuned = metrics.sweep(test, ["model_key"], grid).select("model_key", "threshold", F.col("avg_f1").alias("tuned")).join(best, ["model_key", "threshold"])
        default = metrics.sweep(test, ["model_key"], [middle]).select("model_key", F.col("avg_f1").alias("default"))
        part = tuned.join(default, "model_key").select(F.lit(name).alias("classifier"), F.col("model_key").alias("dataset"), "threshold", "default", "tuned")
        cells = part if cells is None else cells.union(part)
    return metrics.classifier_gains(cut(cells, "cells"))


@query()
def temperature_deltas(spark: SparkSession, d: str) -> DataFrame:
    """AUROC of human against machine code at t02 and t06 of the same prompts: all, changed answers and size quintiles; for all the interval and sign p of the difference over paired draws."""
    valid = _latest(spark, d).where("agc_valid and agc_code is not null")
    both = [valid.where(F.col("tag") == t).select("line_no", F.col("agc_code").alias(t)) for t in ("t02", "t06")]
    human = table(spark, d, "candidates").where("prompt is not null and solution is not null").groupBy("line_no").agg(F.min(F.concat("prompt", "solution")).alias("human"))
    size = lambda c: (-text.space_weight(c)).cast("double").alias(c)
    paired = cut(both[0].join(both[1], "line_no").join(human, "line_no").select("line_no", (F.col("t02") != F.col("t06")).alias("changed"), size("t02"), size("t06"), size("human")), "paired")
    binned = pairs.equal_bins(paired, ["human", "line_no"], 5, "quintile")
    long = binned.select("line_no", "changed", "quintile", F.explode(F.array(*(F.struct(F.lit(t).alias("condition"), F.lit(k).alias("truth"), F.col(c).alias("score")) for t in ("t02", "t06") for k, c in ((1, "human"), (0, t))))).alias("r")).select("line_no", "changed", "quintile", "r.*")
    long = cut(long, "conditions")
    sets = F.array_compact(F.array(F.lit("all"), F.when(F.col("changed"), "changed"), F.concat(F.lit("quintile_"), F.col("quintile") + 1)))
    table_ = metrics.paired_deltas(long.withColumn("subset", F.explode(sets)), "line_no", "t02", "t06")
    drawn = selection.bootstrap_auroc(long, ["condition"], "line_no", DRAWS, "temperature")
    at = lambda t: F.max(F.when(F.col("condition") == t, F.col("auroc")))
    deltas = drawn.groupBy("draw").agg((at("t06") - at("t02")).alias("delta")).withColumn("subset", F.lit("all"))
    spans = selection.intervals(deltas, ["subset"], "delta", centre=0.0).select("subset", "draws", "low", "high", "p_value")
    return rounded(table_.join(spans, "subset", "left"), "before", "after", "delta", "low", "high", "p_value")


@query(r"""SELECT idx, regexp_extract(model, '^(.*?)(?:_\d+_.*)?$', 1) AS short, CASE WHEN contains(lower(model), 'quill') THEN 'quill' WHEN contains(lower(model), 'moss') THEN 'moss' WHEN contains(lower(model), 'tarn') THEN 'tarn' END AS family, concat_ws('_', idx, split, label) AS sample_id FROM code_pairs""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "code_pairs")
    return p.select("idx", text.short_run("model").alias("short"), text.first_key("model", ["quill", "moss", "tarn"]).alias("family"), text.sample_id("idx", "split", "label").alias("sample_id"))


@query()
def code_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keywords and operators over the tokens of each valid Python answer."""
    from provenir.plans.registry import code_analysis

    rows = code_analysis(spark, d).where("ok and tokens > 0")
    return rows.select("line_no", "tag", (F.size("keywords") / F.col("tokens")).alias("keyword_ratio"), (F.size("operators") / F.col("tokens")).alias("operator_ratio"))
