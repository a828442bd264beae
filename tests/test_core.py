"""Golden cases, brute force and edge cases of the core operators."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from provenir.functions import cleaning, code, hashing, text
from provenir.operators import checks, events, metrics, pairs, retrieval, rollup, selection, splits
from provenir.sources import readers


def occurrences(spark, rows):
    """rows: (path, predicted_agc, tokens, score)."""
    shape = "snapshot_id string, relative_path string, file_sha256 string, code_unit_id string, a05_mapping_warning string, predicted_agc int, npr_body_space_by_token_count bigint, human_decision_score double"
    return spark.createDataFrame([("s", p, "AB", str(i), None, a, n, x) for i, (p, a, n, x) in enumerate(rows)], shape)


def files(spark, rows):
    shape = "snapshot_id string, relative_path string, file_sha256 string, dataset_source string, repo_name string, parse_status string, physical_line_count bigint"
    return spark.createDataFrame([("s", p, "ab", "control", "o/r", status, 1) for p, status in rows], shape)


def test_file_rollup_golden(spark):
    occ = occurrences(spark, [("main", 1, 100, -1.0), ("main", 1, 220, -2.0), ("main", 0, 10, 1.0), ("main", 0, 12, 2.0), ("main", 0, 20, 3.0), ("tie", 1, 50, -1.0), ("tie", 0, 50, 1.0), ("zero", 1, 0, 1.0)])
    out = {r["relative_path"]: r for r in rollup.file_rollup(files(spark, [("main", "prepared"), ("empty", "prepared"), ("link", "excluded_symlink"), ("tie", "prepared"), ("zero", "prepared"), ("none", None)]), occ).collect()}
    m = out["main"]
    assert (m["units"], m["agc_units"], m["count_share"], m["weighted_share"], m["selected"], m["status"]) == (5, 2, 0.4, 320 / 362, 1, "scored")
    assert (out["empty"]["status"], out["empty"]["selected"]) == ("no_units", None)
    assert (out["link"]["status"], out["link"]["selected"], out["none"]["status"]) == ("file_not_prepared", None, "file_not_prepared")
    assert (out["tie"]["weighted_share"], out["tie"]["selected"]) == (0.5, 0)
    assert (out["zero"]["weighted_share"], out["zero"]["selected"]) == (None, 0)
    assert rollup.orphans(occurrences(spark, [("lost", 1, 1, 1.0)]), files(spark, [("main", "prepared")])).count() == 1
    assert {r["check"]: r["passed"] for r in rollup.conservation_checks(files(spark, [("main", "prepared")]), occ, rollup.file_rollup(files(spark, [("main", "prepared")]), occ)).collect()}["no_orphans"] == 0


def test_length_bins_and_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (99, 100, 110, 111, 200, 201)], "n int")
    assert [r[0] for r in rows.orderBy("n").select(text.length_bin("n")).collect()] == ["under_100", "type01_110", "type01_110", "type02_120", "type10_200", "over_200"]
    samples = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb", "a\rb\n", "a\x0bb\x0c", "x y", " a  b ", " a　b", "a  b \n", "é ü\n"]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string").select("i", "t", text.line_count("t").alias("l"), text.word_count("t").alias("w"), text.space_tokens("t").alias("s"), text.space_weight("t").alias("f"), text.physical_line_count("t").alias("p"))
    for r in df.collect():
        t = r["t"]
        assert r["l"] == len(t.splitlines()) and r["w"] == len(t.split()) and r["s"] == len(t.strip("\n").split(" ")) and r["f"] == len(t.split(" ")), t
        assert r["p"] == (0 if t == "" else len(t.splitlines()) or 1)


def test_even_positions_and_hash():
    assert splits.even_positions(10, 1) == [1]
    assert splits.even_positions(10, 3) == [1, 5, 10]


def test_seeded_hash_matches_python(spark):
    import hashlib

    row = spark.createDataFrame([("x1",)], "id string").select(hashing.seeded("42", "id")).first()[0]
    assert row == hashlib.sha256(b"42\x00x1").hexdigest()


def test_auroc_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(2), rng.choice([None, *range(6)])) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, truth int, score double".replace("double", "int")).withColumn("score", F.col("score").cast("double"))
    for r in metrics.auroc(df, ["g"]).collect():
        pos = [s for g, t, s in data if g == r["g"] and t == 1 and s is not None]
        neg = [s for g, t, s in data if g == r["g"] and t == 0 and s is not None]
        brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(r["auroc"], brute)
    one = spark.createDataFrame([("a", 1, 1.0)], "g string, truth int, score double")
    assert metrics.auroc(one, ["g"]).first()["auroc"] is None


def test_best_threshold_takes_the_first_of_equals(spark):
    swept = spark.createDataFrame([("a", 0.3, 0.5, 0.5, 0.5), ("a", 0.2, 0.5, 0.5, 0.5), ("a", 0.9, 0.1, 0.5, 0.5)], "g string, threshold double, avg_f1 double, lm_f1 double, lm_precision double")
    assert metrics.best_threshold(swept, ["g"]).first()["threshold"] == 0.2
    assert len(metrics.proba_grid()) == 21 and metrics.proba_grid()[-1] == 0.7


def test_ranks_and_bins_against_pandas(spark):
    rng = random.Random(2)
    values = [(str(i), rng.randrange(40)) for i in range(200)]
    df = spark.createDataFrame(values, "id string, v int")
    series = pd.Series(dict(values))
    got = {r["id"]: r["p"] for r in pairs.percent_ranks(df, "v", "p").collect()}
    assert all(math.isclose(got[k], x) for k, x in series.rank(pct=True).items())
    bins = {r["id"]: r["b"] for r in pairs.quantile_bins(df, "v", 5, "b").collect()}
    assert bins == pd.qcut(series, 5, labels=False, duplicates="drop").to_dict()
    numbered = [r["id"] for r in pairs.with_positions(df, ["v", "id"], "k").orderBy("k").collect()]
    assert numbered == [k for _, k in sorted((v, k) for k, v in values)]


def test_splits_keep_pairs_and_proportions(spark):
    df = spark.createDataFrame([(f"p{i}", i + 1) for i in range(105)], "pair_id string, r int")
    out = splits.by_complexity(df, "r", "pair_id", "s").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 80, "dev": 10, "test": 10}
    shares = {r["split"]: r["count"] for r in splits.by_fraction(df.withColumn("g", F.lit(1)), "g", "pair_id", "s", {"train": 0.6, "dev": 0.2, "test": 0.2}).groupBy("split").count().collect()}
    assert shares == {"train": 63, "dev": 21, "test": 21}
    with pytest.raises(ValueError):
        splits.sample(df, "pair_id", 500, "s")


def test_pareto_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(str(i), rng.randrange(8), rng.randrange(8)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    best = {k for k, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}
    assert {r["k"] for r in selection.pareto(df, "k", "a", "b").collect()} == best


def test_event_selection_golden(spark):
    ids = [("r1", "control"), ("t1", "control"), ("c1", "control"), ("c2", "control"), ("c3", "control"), ("r2", "treatment"), ("x1", "treatment"), ("x2", "treatment"), ("x3", "treatment")]
    rows = spark.createDataFrame(ids, "function_event_id string, dataset_source string")
    edge = lambda *x: spark.createDataFrame([(i,) for i in x], "function_event_id string")
    run = lambda: sorted(map(tuple, events.mixed_pilot(rows, {"runtime_ast_edge": edge("r1", "r2"), "tree_sitter_edge": edge("t1")}, 2, "test-seed").collect()))
    out = run()
    groups = pd.Series([g for *_, g in out]).value_counts().to_dict()
    assert len(out) == 7 and groups == {"runtime_ast_edge": 2, "tree_sitter_edge": 1, "normal_control": 2, "normal_treatment": 2} and run() == out


def test_event_rejects(spark):
    rows = spark.createDataFrame([("2024-01", "abcdef1", "a.py", "added", "f", "o/r", None), ("2024-13", "zz", "../escape.py", None, "f", "o/r", "xx"), (None, None, None, None, None, None, None)], "time string, commit string, relative_path string, change_type string, qualified_function_name string, repo_name string, content_sha256 string")
    assert sorted(r["faults"] for r in events.rejects(rows).collect()) == ["", "month;commit;path;change_type;missing", "month;commit;path;change_type;sha256"]
    with pytest.raises(ValueError):
        readers.resolve_aliases(rows, {"nowhere": ["x"]})


def test_label_rules(spark):
    rows = spark.createDataFrame([(" Human ",), ("1",), ("0",), ("AI",), ("?",), (None,)], "l string").select(text.normal_label("l").alias("a"), text.normal_label("l", digits=False).alias("b")).collect()
    assert [r["a"] for r in rows] == ["human", "human", "lm", "lm", None, None]
    assert [r["b"] for r in rows] == ["human", None, None, "lm", None, None]
    warn = spark.createDataFrame([("",), ("0",), ("False",), ("moved",), (None,)], "w string").select(text.warned("w").alias("a"), text.warned("w", any_text=True).alias("b")).collect()
    assert [r["a"] for r in warn] == [False, False, False, True, False] and [r["b"] for r in warn] == [False, True, True, True, False]


def test_compare_and_verdict(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (5, 5.0)], "k int, v double")
    assert {r["verdict"]: r["rows"] for r in checks.compare(a, b, ["k"], ["v"]).collect()} == {"equal": 2, "different": 1, "left_only": 1, "right_only": 1}
    named = spark.createDataFrame([("x", "hard", 1), ("y", "soft", 0)], "check string, severity string, passed int")
    assert checks.verdict(named).first()["status"] == "PASS"


def test_bm25_prefers_the_rare_term(spark):
    docs = spark.createDataFrame([(i, "common words here", "s") for i in range(5)] + [(9, "common rareterm here", "s")], "doc_id int, text string, source string")
    q = spark.createDataFrame([(1, "rareterm common")], "query_id int, query_text string")
    assert retrieval.bm25(docs, q, 1, "source").first()["doc_id"] == 9


def test_code_analysis():
    a = code.analyse('def f(x):\n    """d"""\n    if x and x > 1:\n        return g(x)\n')
    assert a["ok"] and a["blocks"] == ["f"] and a["has_body"] and a["complexity"] == 3 and a["calls"] == ["g"] and a["returns"]
    assert code.analyse('def f():\n    """d"""\n    pass\n')["has_body"] is False
    assert code.analyse('def f():\n    """d"""\n')["docstring_only"]
    bad = code.analyse("def f(:\n")
    assert bad["ok"] is False and "line 1" in bad["error"] and code.analyse(None)["ok"] is None
    assert "".join(code.normalised_names("def f(a):\n    b = a  # c\n    return b\n").split()) == "deffunc_1(var_1):var_2=var_1returnvar_2"
    assert code.normalised_names("def (") is None
    assert code.dedented("    def f():\n        x = '''a\n  b'''\n        return x\n") == "def f():\n    x = '''a\n  b'''\n    return x\n"


def test_cleaning():
    prompt = 'def f(a):\n    """Do it."""\n'
    assert cleaning.cleaned(prompt, "    return a\n<file_sep>\nimport x\n") == "    return a\n"
    assert cleaning.cleaned(prompt, prompt + "    return a\n\n\ndef g():\n    pass\n") == "    return a\n"
    assert cleaning.cleaned(prompt, "return a") == "    return a\n"
    assert cleaning.cleaned(prompt, None) == "" and cleaning.body_indent(prompt) == 4 and cleaning.indent_width("\ta") == 4


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    path = tmp_path / "x.csv"
    path.write_text('idx,code,label,more\n1_human,"def f():\n    return ""a""\n",human,z\n2_lm,,lm,z\n')
    shape = T.StructType([T.StructField("idx", T.StringType()), T.StructField("code", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = readers.read_csv(spark, str(path), shape, ["idx", "code"]).orderBy("idx").collect()
    assert rows[0]["code"] == 'def f():\n    return "a"\n' and rows[0]["n"] is None
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(path), shape, ["nowhere"])
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"idx": "a"}\n\n{bad\n')
    got = readers.read_jsonl(spark, str(lines), shape).collect()
    assert len(got) == 2 and sum(r["_corrupt_record"] is not None for r in got) == 1
    ids = tmp_path / "ids.txt"
    ids.write_text("# c\na\n\nb\n")
    assert {r["id"] for r in readers.read_id_list(spark, str(ids)).collect()} == {"a", "b"}


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    from provenir.streaming import rollups

    rows = spark.createDataFrame([("e1", "added", "2024-01-01 00:00:00", "r"), ("e1", "added", "2024-01-01 00:00:00", "r"), ("e2", "modified", "2024-01-02 00:00:00", "r"), ("e3", "added", "2024-03-01 00:00:00", "r")], "function_event_id string, change_type string, at string, repo_name string").withColumn("at", F.to_timestamp("at"))
    rows.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = rollups.stream_table(spark, str(tmp_path / "in"), rows.schema)
    rollups.run_once(rollups.events_by_window(stream, "at", ["repo_name"]), "windows", "update")
    assert sorted((r["events"], r["added"]) for r in spark.table("windows").collect()) == [(1, 1), (2, 1)]


def test_positional_match_with_fallback(spark):
    from provenir.operators import matching

    blocks = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c"), ("f", 3, "c"), ("f", 4, "z")], "file string, block_idx int, name string")
    truth = spark.createDataFrame([("f", 0, "a", "human"), ("f", 1, "c", "lm"), ("f", 2, "b", "human"), ("f", 3, "c", "human")], "file string, block_idx int, name string, label string")
    got = {r["block_idx"]: (r["truth_idx"], r["match"]) for r in matching.positional(blocks, truth).collect()}
    assert got == {0: (0, "position"), 1: (2, "name"), 2: (1, "name"), 3: (3, "position"), 4: (None, None)}
    ranges = spark.createDataFrame([("f", 1, 1, 20), ("f", 2, 2, 10), ("f", 3, 3, 5)], "file string, k int, start_line int, end_line int")
    assert {r["k"]: r["outer"] for r in matching.enclosing(ranges, ["file"], "k").collect()} == {2: 1, 3: 2}


def test_blocks_and_canonical_json():
    found = code.blocks("import x\n@d\ndef f():\n    pass\n\nclass A:\n    def g(self): pass\n")
    assert [(b["name"], b["kind"], b["start_line"], b["end_line"]) for b in found] == [("f", "function", 2, 4), ("A", "class", 6, 7)] and code.blocks("def (") == []
    assert code.canonical_json({"b": None, "a": "é"}) == '{"a":"\\u00e9","b":null}'
    assert code.syntax_sequence("x = 1\n")[0] == "Module::left" and code.syntax_sequence("x = 1\n")[-1] == "Module::right" and "1" in code.syntax_sequence("x = 1\n")


def test_names_and_prompts(spark):
    row = spark.createDataFrame([("a__b__c", "m_4500_x", [("q", 1)], "z")], "v string, r string, e array<struct<input:string,output:int>>, q string")
    before, after = text.last_split("v")
    got = row.select(before.alias("a"), after.alias("b"), text.short_run("r").alias("s"), text.first_key("v", ["x", "B"]).alias("k"), text.sample_id("v", "r").alias("i"), text.few_shot_prompt("H", "e", "q").alias("p")).first()
    assert tuple(got) == ("a__b", "c", "m", "B", "a__b__c_m_4500_x", "H\n\nInput:\nq\nOutput: 1\n\nInput:\nz\nOutput:")


def test_block_results_prefer_the_summary(spark, tmp_path):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("truth_label", T.StringType()), T.StructField("pred_label", T.StringType()), T.StructField("score", T.DoubleType())])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.tsv").write_text("truth_label\tpred_label\tscore\nhuman\tlm\t0.5\n")
    (tmp_path / "t" / "b.tsv").write_text("other\nx\n")
    (tmp_path / "s.csv").write_text("dir,files\nx,1\n")
    (tmp_path / "t" / "k_manifest.csv").write_text("a\n1\n")
    (tmp_path / "t" / "k.csv").write_text("a\n1\n")
    rows = readers.read_blocks(spark, str(tmp_path / "s.csv"), str(tmp_path / "t"), shape, ["truth", "truth_label"], ["pred_label"])
    assert rows.count() == 1 and rows.first()["score"] == 0.5
    assert [f.rsplit("/", 1)[1] for f in readers.csv_files(spark, str(tmp_path / "t"))] == ["k.csv"]
    ids = spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")
    assert {r["k"] for r in pairs.referenced(spark.createDataFrame([("x",), ("w",), ("z",)], "k string"), "k", ids, "a", "b").collect()} == {"x", "z"}


def test_bootstrap_draws_against_brute_force(spark):
    import numpy as np

    from provenir.plans import registry

    assert registry.DRAWS == 20_000
    rng = random.Random(4)
    data = [(rng.choice(["a", None]), f"p{i // 2}", i % 2, float(rng.randrange(6))) for i in range(80)] + [("a", None, 1, 1.0), ("b", "p1", 1, 1.0)]
    df = spark.createDataFrame(data, "g string, pair_id string, truth int, score double")
    keys = {r["pair_id"]: r["k"] for r in df.select("pair_id", F.xxhash64(F.lit("s"), "pair_id").alias("k")).distinct().collect()}
    mass = 2**64

    def weight(pair, draw):
        z = (keys[pair] + draw * 0x9E3779B97F4A7C15) % mass
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % mass
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % mass
        u = ((z ^ (z >> 31)) >> 32) / 2**32
        return sum(u >= math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(7))

    got = {(r["g"], r["draw"]): r["auroc"] for r in selection.bootstrap_auroc(df, ["g"], "pair_id", 25, "s", block=10).collect()}
    assert len(got) == 75 and all(got["b", k] is None for k in range(1, 26))
    for (g, draw), value in got.items():
        pos, neg = ([(s, weight(p, draw)) for h, p, t, s in data if h == g and t == side and p] for side in (1, 0))
        total = sum(v for _, v in pos) * sum(v for _, v in neg)
        assert value is None if not total else math.isclose(value, sum(v * w * ((x > y) + 0.5 * (x == y)) for x, v in pos for y, w in neg) / total)
    w = selection.bootstrap_weights(np.arange(200) * 7919, 1, 2000)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_braces_of_whole_texts_are_escaped(spark, tmp_path):
    from provenir.plans import more

    texts = ["x" * 60 + "{a}" + "y" * 60, "{" * 50, "", None]
    spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["escaped"] for r in more.byte_offsets(spark, str(tmp_path)).collect()}
    assert got == {i: t and t.replace("{", "{{").replace("}", "}}") for i, t in enumerate(texts)}


@pytest.mark.parametrize("sizes", [[5] * 40 + list(range(10, 90)), [5] * 3 + [9] * 100, list(range(33)), [7] * 40])
def test_stratified_pick_gives_its_total(spark, sizes):
    df = spark.createDataFrame([(f"p{i}", v, abs(v - 30)) for i, v in enumerate(sizes)], "id string, v int, q int")
    binned = pairs.quantile_bins(df, "v", 5, "b")
    counts = {r["b"]: r["count"] for r in binned.groupBy("b").count().collect()}
    out = splits.stratified_pick(binned, "b", "id", "q", 32, seed="s").collect()
    assert len({r["id"] for r in out}) == len(out) == 32
    got = pd.Series([r["b"] for r in out]).value_counts()
    for i, b in enumerate(sorted(counts)):
        assert got[b] >= min(counts[b], 32 // len(counts) + (i < 32 % len(counts)))
    with pytest.raises(ValueError):
        splits.stratified_pick(binned, "b", "id", "q", len(sizes) + 1, seed="s")
    small = spark.createDataFrame([(f"a{i}", 0, i) for i in range(2)] + [(f"b{i}", 1, i) for i in range(50)], "id string, b int, q int")
    assert sorted(pd.Series([r["b"] for r in splits.stratified_pick(small, "b", "id", "q", 20, seed="s").collect()]).value_counts()) == [2, 18]


def test_fixed_dev_and_test_with_nested_train_prefixes(spark):
    ranked = spark.createDataFrame([(f"p{i}", i) for i in range(1, 41)], "pair_id string, r int")
    out = pd.DataFrame([r.asDict() for r in splits.fixed_eval(ranked, "pair_id", "r", 5, 6, (4, 10), "s").collect()])
    sets = {k: set(g) for k, g in out.groupby(["size", "role"])["pair_id"]}
    assert sets[4, "dev"] == sets[10, "dev"] and sets[4, "test"] == sets[10, "test"] and {k: len(v) for k, v in sets.items()} == {(4, "dev"): 5, (10, "dev"): 5, (4, "test"): 6, (10, "test"): 6, (4, "train"): 4, (10, "train"): 10}
    held = sets[4, "dev"] | sets[4, "test"]
    rest = [f"p{i}" for i in range(1, 41) if f"p{i}" not in held]
    assert len(held) == 11 and sets[4, "train"] == set(rest[:4]) and sets[10, "train"] == set(rest[:10])
    with pytest.raises(ValueError):
        splits.fixed_eval(ranked, "pair_id", "r", 5, 6, (30,), "s")


def test_classifier_gains_and_paired_deltas(spark):
    cells = spark.createDataFrame([("a", "x", 0.1, 0.5, 0.75), ("a", "y", 0.2, 0.25, 0.5), ("b", "x", 0.3, 0.5, 0.75)], "classifier string, dataset string, threshold double, default double, tuned double")
    out = {(r["level"], r["classifier"]): tuple(r)[2:] for r in metrics.classifier_gains(cells).collect()}
    assert out == {("classifier", "a"): (None, None, 2, 0.375, 0.625, 0.25), ("classifier", "b"): (None, None, 1, 0.5, 0.75, 0.25), ("best", "a"): ("x", 0.1, 1, 0.5, 0.75, 0.25)}
    rows = spark.createDataFrame([("s", 1, "t02", 1, 2.0), ("s", 1, "t02", 0, 1.0), ("s", 1, "t06", 1, 2.0), ("s", 1, "t06", 0, 2.0)], "subset string, id int, condition string, truth int, score double")
    assert tuple(metrics.paired_deltas(rows, "id", "t02", "t06").first()) == ("s", 1, 1.0, 0.5, -0.5)


def test_exclusions_by_prompt_code_and_line_at_any_tag(spark, tmp_path):
    import hashlib

    from provenir.plans import registry

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    spark.createDataFrame([(i, f"  p{i}\r\n", f"  s{i}\n", sha(f"p{i}")) for i in range(6)], "line_no int, prompt string, solution string, prompt_sha256 string").write.parquet(str(tmp_path / "candidates.parquet"))
    used = [(90, "t02", "SHA256:" + sha("p0").upper(), None), (91, "t04", None, sha("p1\ns1")), (2, "t06", None, None), (92, "t06", sha("p3"), None), (None, "t06", None, None)]
    spark.createDataFrame(used, "line_no int, tag string, prompt_sha256 string, human_sha256 string").write.parquet(str(tmp_path / "checkpoints.parquet"))
    assert {r["line_no"] for r in registry.exclusion_antijoin(spark, str(tmp_path)).collect()} == {4, 5}


def test_static_metrics():
    python = "import os\n\ndef f(x):\n    # if\n    if x and x > 1:\n        while x:\n            x -= 1\n    elif x:\n        return 'if'\n    return x\n"
    assert dict(zip(code.METRICS, code.static_metrics(python))) == {"avg_code_lines": 7, "cyclomatic": 5, "keywords": 8, "branch_words": 3, "nesting": 2, "blank_lines": 1, "functions": 1, "declaring_lines": 2}
    java = "int f(int x) {\n\n  // if\n  int y = 0;\n  if (x > 1 && x < 9) { while (x > 0) { x--; } }\n  return y;\n}\n"
    assert dict(zip(code.METRICS, code.static_metrics(java))) == {"avg_code_lines": 5, "cyclomatic": 4, "keywords": 6, "branch_words": 2, "nesting": 2, "blank_lines": 1, "functions": 1, "declaring_lines": 2}


def test_models_take_both_sides_of_the_training_rows(spark, tmp_path):
    from provenir.plans import more

    rows = [(f"p{i}_{s}", f"def {w}(x):\n    if x:\n        return x\n" * (1 + i % 3), s, "m", split, None) for split, n in (("train", 8), ("test", 4)) for i in range(n) for s, w in (("human", f"{split}h"), ("lm", f"{split}m"))]
    rows = [(f"{r[4]}{r[0]}", *r[1:]) for r in rows]
    spark.createDataFrame(rows, "idx string, code string, label string, model string, split string, written_at timestamp").write.parquet(str(tmp_path / "code_pairs.parquet"))
    got = {r["word"]: len(r["vector"]) for r in more.token_vectors(spark, str(tmp_path)).collect()}
    assert got["trainh"] == got["trainm"] == 128 and "testh" not in got and "testm" not in got
    scored = more.size_classifier(spark, str(tmp_path)).collect()
    assert len(scored) == 8 and all(0 <= r["score"] <= 1 for r in scored)
