"""Continuations, audits, quantiles, readers and sinks against plain rules on small rows."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions import code, continuation, text
from provenir.operators import audits, matching, pairs, quantiles, splits
from provenir.runtime import blocked_join, spread
from provenir.sources import readers, sinks, snapshots

PROMPT = 'def f(a):\n    """Doc."""\n'


def test_continuations_are_cleaned_by_the_rules():
    c = continuation.cleaned
    assert c(PROMPT, "    return a\n\n\ndef g():\n    pass\n") == "\n    return a\n"
    assert c(PROMPT, "return a\n<file_sep>x") == "\n    return a\n" and c(PROMPT, "    x = 1\n```\nprose") == "\n    x = 1\n"
    assert c(PROMPT, "def f(a):\n    return a\n") == "\n    return a\n"
    assert c("def g(\n    a,\n", "    b: int,\n) -> int:\n    return b\n") == "\n    return b\n"
    assert c(PROMPT, None) == "\n" and c(None, "x = 1") == "\n    x = 1\n" and c(PROMPT, "\r\n    y = 2\r\n    def ") == "\n    y = 2\n"
    second = continuation.cleaned_second
    assert second(PROMPT, "\treturn a\n<|endoftext|>junk") == "\n    return a\n" and second(PROMPT, "") == "\n" and second(PROMPT, "def f(a):\n    return 1") == "\n    return 1\n"


def test_bodies_are_taken_out_of_chat_answers():
    b = continuation.extracted_body
    assert b(PROMPT, "Sure:\n```python\ndef f(a):\n    '''Doc.'''\n    return a\n```\nDone.") == "\n    return a\n"
    assert b(PROMPT, "    return a\n\n\ndef g():\n    pass") == "\n    return a\n"
    assert b(PROMPT, "import os\n\n    return os.name\n### more") == "\n    import os\n\n    return os.name\n"
    assert b(None, None) == "\n"


def test_cuts_and_prompts_and_headers():
    found = continuation.cut_continuation(PROMPT, "    return a + 1\n", "    return a\n\nprint(f(1))\ndef h():\n    pass\n")
    assert found["fault"] == "" and found["code"].endswith("return a\n") and found["cuts"] == 3
    assert continuation.cut_continuation(PROMPT, "    return 1\n", "    pass\n")["fault"] == "structure" and continuation.cut_continuation(PROMPT, "((", "x")["fault"] == "human"
    human, machine = PROMPT + "    return a\n", PROMPT + "    return 2\n"
    assert continuation.shared_prompt(human, machine) == (PROMPT.rstrip("\n"), "") and continuation.shared_prompt(human, "x")[1] == "not_shared" and continuation.shared_prompt("x = 1\n", "")[1] == "not_one_definition" and continuation.shared_prompt(None, None)[1] == "not_one_definition"
    h = continuation.header_alignment
    assert h("@x\ndef f(): pass\n", True)["fault"] == "" and h("  def f(): pass\n", False)["fault"] == "header_indent" and h("x = 1", False)["fault"] == "no_header" and h(" @x\ndef f(): pass\n", True)["fault"] == "decorator_indent" and h("def f(): pass\n", True)["fault"] == "decorator_missing" and h("@x\ndef f(): pass\n", False)["fault"] == "decorator_unexpected"


def test_the_decision_set():
    count = lambda s: code.analyse(s)["complexity"]
    assert count("if a:\n    pass\nelif b:\n    pass\nelse:\n    if c:\n        pass\n") == 3
    assert count("x = [i for i in y if i]\nwith a:\n    assert b\n") == 1 and count("z = a and b and c or d\n") == 4
    assert count("match a:\n    case 1:\n        pass\n    case _:\n        pass\n") == 4 and count("try:\n    pass\nexcept E:\n    x = 1 if y else 2\n") == 3
    kinds = dict(code.node_taxonomy())
    assert kinds["If"] == "statement" and kinds["Call"] == "expression" and kinds["Add"] == "operator" and kinds["arguments"] == "part" and code.node_counts("a = 1\nb = (")  == {} and code.node_counts("a = 1\n")["Assign"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_and_totals_against_sorting(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.random() * 10, float(rng.randrange(5))]) for _ in range(rng.randrange(1, 300))]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    points = [0.0, 0.1, 0.5, 0.975, 1.0]
    values.sort()
    want = [values[int((len(values) - 1) * p)] + ((len(values) - 1) * p % 1) * (values[min(len(values) - 1, int((len(values) - 1) * p) + 1)] - values[int((len(values) - 1) * p)]) for p in points]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(quantiles.exact_quantiles(df, "v", points), want))
    ranked = {r["v"]: r["pct"] for r in pairs.percent_ranks(df, "v", "pct").where("v is not null").collect()}
    assert all(math.isclose(p, (sum(x < v for x in values) + (values.count(v) + 1) / 2) / len(values)) for v, p in ranked.items())
    assert quantiles.exact_quantiles(df.where("false"), "v", [0.5]) == [None] and quantiles.running_totals(df.where("false"), ["v"], "v", "t").count() == 0


def test_a_hot_key_is_joined_in_blocks(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(7)] + [("cold", 9), ("gone", 1), (None, 3)], "k string, b int")
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    assert sorted(map(tuple, blocked_join(left, right, ["k"], 50).select("k", "a", "b").collect())) == want
    assert blocked_join(left.where("false"), right, ["k"]).count() == 0


def test_spread_runs_nothing(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    done = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = spread(spark.read.parquet(str(tmp_path / "one")))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) <= len(done) + 1 and out.count() == 1000


def test_labels_resolve_as_a_whole(spark):
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "idx string")
    assert [r["side"] for r in pairs.resolved_labels(rows(["a_human", "a_lm"])).orderBy("idx").collect()] == ["human", "lm"]
    assert pairs.resolved_labels(rows(["a_human"]).withColumn("label", F.lit("LM "))).first()["side"] == "lm"
    assert pairs.resolved_labels(rows(["a_human", "b"]).withColumn("actual_label", F.lit(0))).first()["side"] == "lm"
    with pytest.raises(ValueError):
        pairs.resolved_labels(rows(["a_human", "b"]))
    with pytest.raises(ValueError):
        splits.by_complexity(spark.range(1, 12).withColumnRenamed("id", "r").withColumn("p", F.col("r").cast("string")), "r", "p", "s", strict=True)


def test_enclosing_ranges_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [("f" if i % 3 else "g", i, s, s + rng.randrange(0, 30)) for i in range(120) for s in [rng.randrange(60)]]
    got = {(r["file"], r["k"]): r["outer"] for r in matching.enclosing(spark.createDataFrame(rows, "file string, k int, start_line int, end_line int"), ["file"], "k").collect()}
    want = {}
    for f, k, s, e in rows:
        around = [(oe - os, o) for g, o, os, oe in rows if g == f and os <= s and e <= oe and (os, oe) != (s, e)]
        if around and sum(x[0] == min(around)[0] for x in around) == 1:
            want[f, k] = min(around)[1]
    assert got == want


def test_alternation_and_first_faults(spark):
    rows = [(1, "a_human", "human"), (2, "a_lm", "lm"), (3, "b_human", "human"), (4, "c_lm", "lm"), (5, "d_lm", "lm"), (6, "d_human", "human"), (7, "e_human", None)]
    got = {(r["pair_id"], r["fault"]) for r in audits.alternation(spark.createDataFrame(rows, "n int, idx string, label string"), ["n"], "idx", "label").collect()}
    assert got == {("b", "pair"), ("d", "not_human"), ("e", "odd_count")}
    kept = audits.complete_columns(spark.createDataFrame([(1.0, 1), (float("nan"), 2)], "a double, b int"), ["a", "b"])
    assert {r["column"]: r["kept"] for r in kept.collect()} == {"a": 0, "b": 1}
    assert audits.largest_key(spark.createDataFrame([("x_100",), ("x_2000",), ("x_2000_b",), ("y_9",)], "key string"), "key", "x").first()["key"] == "x_2000_b"


def test_unknown_modes_are_errors(spark):
    df = spark.createDataFrame([(0.25, "proba"), (-2.0, "decision"), (None, "odd")], "s double, m string")
    assert [r[0] for r in df.select(text.agc_score("s", "m")).collect()] == [0.75, 2.0, None]
    with pytest.raises(Exception, match="unsupported score mode"):
        spark.createDataFrame([(0.25, "odd")], "s double, m string").select(text.agc_score("s", "m")).collect()
    block = spark.createDataFrame([("a \n\n",), (" \t",), (None,)], "t string").select(text.block_text("t").alias("b")).collect()
    assert [r["b"] for r in block] == ["a\n", "def _empty_block(): pass\n", "def _empty_block(): pass\n"]
    p = spark.createDataFrame([([("q", 1)], "z{")], "e array<struct<input:string,output:int>>, q string").select(text.label_prompt("Java", "e", "q").alias("p")).first()["p"]
    assert p.startswith("You will be provided with a Java source code.") and p.endswith("\n\nInput: q -> Output: 1\n\nInput: z{{ -> Output:")


def test_sinks_and_readers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x",\ny', 1), ("b", "", None)], "split string, t string, n int").replace({"a": "train", "b": "dev"}, subset=["split"])
    sinks.write_named_splits(df, str(tmp_path), "set")
    shape = T.StructType([T.StructField("t", T.StringType()), T.StructField("n", T.IntegerType())])
    assert tuple(readers.read_csv(spark, str(tmp_path / "set" / "train_"), shape).first()) == ('say "x",\ny', 1) and (tmp_path / "set" / "test_").exists()
    with pytest.raises(ValueError):
        sinks.write_named_splits(df.withColumn("split", F.lit("odd")), str(tmp_path), "other")
    for _ in range(2):
        sinks.append_jsonl(df.select("t", "n"), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    sinks.write_draws(spark.createDataFrame([(1, 0.1 + 0.2)], "draw int, auroc double").coalesce(1), str(tmp_path / "draws"))
    (file,) = (tmp_path / "draws").glob("part*.gz")
    assert gzip.open(file, "rt").read().splitlines()[1] == "1,0.30000000000000004"
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    got = readers.read_numbered_jsonl(spark, str(tmp_path / "log.jsonl"), T.StructType([T.StructField("a", T.IntegerType())])).orderBy("line_no").collect()
    assert [(r["line_no"], r["a"], r["error"]) for r in got] == [(1, 1, None), (3, None, "invalid_json"), (4, 3, None)]
    for c in ("c1", "c2"):
        (tmp_path / "parts" / c).mkdir(parents=True)
        (tmp_path / "parts" / c / "blocks.csv").write_text("t,n\nx,1\n")
    assert {r["part"] for r in readers.read_parts(spark, str(tmp_path / "parts"), "blocks.csv", shape).collect()} == {"c1", "c2"}
    assert readers.latest_file(spark, str(tmp_path / "parts" / "*" / "*.csv")).endswith("c2/blocks.csv")
    (tmp_path / "ids.csv").write_text('function_event_id,other\n"e1",x\n# no\n\ne2,y\n')
    assert {r["id"] for r in readers.read_id_list(spark, str(tmp_path / "ids.csv")).collect()} == {"e1", "e2"}
    (tmp_path / "bad.txt").write_text("e 1\n")
    with pytest.raises(ValueError):
        readers.read_id_list(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.py").write_text("x")
    (tmp_path / "in" / "d" / "b.py").write_text("x")
    assert {(r["path"].rsplit("/", 1)[1], r["mode"]) for r in readers.input_files(spark, [str(tmp_path / "in")]).collect()} == {("a.py", "folder"), ("b.py", "grid")}


def test_snapshots_blobs_and_caches(spark, tmp_path):
    import subprocess

    for source, commit in (("treatment", "abcdef1"), ("control", "1234567"), ("other", "abcdef2"), ("treatment", "nothex")):
        (tmp_path / "snap" / source / "repo" / commit).mkdir(parents=True)
        (tmp_path / "snap" / source / "repo" / commit / "a.py").write_text("x")
    found = snapshots.discover_snapshots(spark, str(tmp_path / "snap")).collect()
    assert {(r["dataset_source"], r["commit"], r["files"]) for r in found} == {("treatment", "abcdef1", 1), ("control", "1234567", 1)}
    clone = tmp_path / "clone"
    clone.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(clone), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    (clone / "d").mkdir()
    (clone / "d" / "a.py").write_text("x = 1\n\ny = 2")
    (clone / "b.py").write_text("é")
    git("add", "."), git("commit", "-qm", "m")
    head = git("rev-parse", "HEAD")
    wanted = spark.createDataFrame([(str(clone), head, p) for p in ("d/a.py", "b.py", "d", "none.py", "d/a.py")] + [(None, head, "b.py")], "clone string, commit string, path string")
    assert {(r["path"], r["text"]) for r in snapshots.read_blobs(wanted).collect()} == {("d/a.py", "x = 1\n\ny = 2"), ("b.py", "é"), ("d", None), ("none.py", None)}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [snapshots.cached(make, str(tmp_path / "cache"), f, spark).count() for f in ("f1", "f1", "f2")] == [3, 3, 3] and len(made) == 2
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    assert [readers.write_content_addressed(x, "t", str(tmp_path / "store")).count() for x in (texts, texts, spark.createDataFrame([("c",)], "t string"))] == [2, 0, 1]


def test_rendered_samples_have_the_lines_of_the_rule(spark):
    sizes = [12, 36, 16, 31, 19, 16]
    rows = [(1, k, f"f{k}", "human", f"s{k}", "\n".join(["x"] * n) + "\n\n") for k, n in enumerate(sizes)]
    made, truth = readers.rendered_sample(spark.createDataFrame(rows, "sample int, k int, function_name string, label string, source_idx string, code string"), "sample", "k")
    spans = [(r["start_line"], r["end_line"]) for r in truth.orderBy("block_idx").collect()]
    assert spans == [(5, 16), (18, 53), (55, 70), (72, 102), (104, 122), (124, 139)]
    lines = made.first()["text"].split("\n")
    assert all(lines[s - 1 : e] == ["x"] * (e - s + 1) and lines[e] == "" for s, e in spans)


def test_the_largest_stored_model_is_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    for name in ("m_900", "m_4500", "n_9999"):
        Pipeline(stages=[SQLTransformer(statement=f"SELECT *, '{name}' AS model FROM __THIS__")]).fit(spark.range(1)).write().overwrite().save(str(tmp_path / name))
    model, key = snapshots.load_estimator(spark, str(tmp_path), "m_")
    assert key == "m_4500" and model.transform(spark.range(1)).first()["model"] == "m_4500"
    with pytest.raises(ValueError):
        snapshots.load_estimator(spark, str(tmp_path), "z")


def test_transforms_of_three_languages():
    from provenir.functions import transforms as t

    py = "def area(width, height=1):  # the area\n    # of a box\n    total = width * height\n    for i, j in pairs:\n        total += self.total\n    return '# no comment' + f(total)\n"
    java = 'class A {\n    /* sum */ static int sum(List<Integer> xs, int from) {\n        int total = 0; // start\n        for (int x : xs) { total += x; }\n        return this.total("// no");\n    }\n}\n'
    cpp = "#include <map>  // maps\nint count(const std::map<int, long>& m, int least) {\n    auto n = 0;\n    for (const auto& kv : m) n += kv.second;\n    return n; /* done */\n}\n"
    for code_, lang in ((py, "python"), (java, "java"), (cpp, "cpp")):
        assert "".join(x for _, x in t.scanned(code_, lang)) == code_
    assert t.names(py, "python")["functions"] == ["area"] and t.names(py, "python")["variables"] == ["width", "height", "total", "i", "j"]
    assert t.names(java, "java")["functions"] == ["sum"] and t.names(java, "java")["variables"] == ["xs", "from", "total", "x"]
    assert t.names(cpp, "cpp")["functions"] == ["count"] and t.names(cpp, "cpp")["variables"] == ["m", "least", "n", "kv"]
    assert t.without_comments(py, "python").count("#") == 1 and "of a box" not in t.without_comments(py, "python") and "# no comment" in t.without_comments(py, "python")
    assert "sum */" not in t.without_comments(java, "java") and '"// no"' in t.without_comments(java, "java") and "done" not in t.without_comments(cpp, "cpp")
    assert "var_3 += self.total" in t.renamed(py, "python", "variables") and "def func_1(width" in t.renamed(py, "python", "functions") and "var_3 += var_4" in t.renamed(java, "java", "variables") and "this.total" in t.renamed(java, "java", "variables")
    assert t.token_sequence("f(a[1])", "java") == ["f", "list::left", "a", "index::left", "1", "index::right", "list::right"] and t.token_sequence("f(", "cpp") == ["f", "list::left", "list::right"] and t.token_sequence(None, "python") == []
    assert t.transformed(py, "python", "comments") == t.transformed(py, "python", "plain") and t.profile("x", "ruby") == (None,) * 9
    for bad in (lambda: t.scanned("x", "ruby"), lambda: t.transformed("x", "java", "odd")):
        with pytest.raises(ValueError):
            bad()


def test_random_search_finds_what_separates(spark):
    from provenir.operators import search

    rng = random.Random(3)
    rows = [(float(y), rng.random() + y, rng.random()) for y in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    found, best = search.random_search(df, df, ["a", "b"], ["lr", "dt"], 2)
    assert len(found) == 4 and [r["place"] for r in found] == [1, 2, 3, 4] and found[0]["f1_macro"] > 0.9 and search.macro_f1(best.transform(df)) == found[0]["f1_macro"]
    assert search.random_search(df.where("label = 1"), df, ["a", "b"], ["lr"], 1) == ([], None)
    perfect = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)], "label double, prediction double")
    assert math.isclose(search.macro_f1(perfect), 2 / 3)
    assert search.draws("lr", 99, 1) == search.draws("lr", 99, 1) and len(search.draws("lr", 99, 1)) == 12


def test_running_maximum_and_pareto(spark):
    from provenir.operators import selection

    rng = random.Random(8)
    rows = [(f"c{i}", rng.randrange(20) / 10, rng.randrange(20) / 10) for i in range(80)]
    got = {r["k"] for r in selection.pareto(spark.createDataFrame(rows, "k string, a double, b double"), "k", "a", "b").collect()}
    assert got == {k for k, a, b in rows if not any(x >= a and y >= b and (x > a or y > b) for _, x, y in rows)}


def test_bodies_are_located():
    source = "class A:\n    @mark\n    def é(self):\n        '''doc'''\n        x = 'ä'\n        return x\n\ndef f():\n    def g():\n        return 1\n    return g\n"
    at = lambda body: (source.index(body), source.index(body) + len(body))
    whole = code.located(source, *at("        x = 'ä'\n        return x\n"))
    assert (whole["name"], whole["kind"], whole["start_line"], whole["end_line"], whole["fault"]) == ("A.é", "method", 2, 6, "")
    assert code.located(source, *at("'''doc'''\n        x = 'ä'\n        return x"))["name"] == "A.é"
    assert code.located(source, *at("        return 1\n"))["kind"] == "nested" and code.located(source, *at("def g():\n        return 1\n    return g"))["name"] == "f"
    assert code.located(source, *at("return g"))["fault"] == "no_function" and code.located("def (", 0, 3)["fault"] == "syntax" and code.located(None, 0, 1)["fault"] == "range"
