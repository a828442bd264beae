"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import ast
import itertools
import random

import numpy as np
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provenir.llm import _boosting, _graph, _grammars, _lexers, _lr, _pii_samples, _text, answers, file_origin, group_splits, leakage, mixing, near_duplicates, personal_data, split_overlap, syntax, truncation
from tests.llm.conftest import SMALL

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon".split()


def like_texts(seed, families=12, members=3, size=90):
    """Texts in families of small edits, some of them exact copies, and lone ones."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(rng.randrange(6, size))]
        for m in range(members):
            t = list(base)
            for _ in range(0 if m == 0 else rng.randrange(0, max(1, len(base) // 25) + 1)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(0, 2)] = [rng.choice(WORDS)]
            out.append((f"f{f}m{m}", " ".join(t)))
    return [*out, ("null", None), ("blank", " \n"), ("two", "a b"), ("two2", "a b"), (None, "no key at all"), out[0]]


def likes(rows):
    have = {(k, t) for k, t in rows if k is not None and t is not None and t.strip()}
    return {tuple(sorted((a, b))) for (a, s), (b, t) in itertools.combinations(have, 2) if a != b and (len(_text.TOKEN.findall(s)) > 2) and _text.likeness(s, t) >= 0.7}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = like_texts(seed)
    df = spark.createDataFrame([(k, "code", t) for k, t in rows], "key string, field string, text string")
    members, alike = near_duplicates.like_pairs(df)
    found = {(r["key_a"], r["key_b"]) for r in near_duplicates.member_pairs(members, alike).collect()}
    want = likes(rows)
    assert found <= want and len(found) >= 0.99 * len(want)
    groups = {r["key"]: r["group_key"] for r in near_duplicates.groups(members, alike).collect()}
    assert all(groups[a] == groups[b] for a, b in found)


def test_covering_code_meets_at_two_common_symbols():
    """Two words of the field's space that agree in two places lie on one line through them."""
    q = near_duplicates.PRIME
    rng = random.Random(4)
    for _ in range(50):
        x = [rng.randrange(q) for _ in range(near_duplicates.LENGTH)]
        y = [rng.randrange(q) for _ in x]
        i, j = sorted(rng.sample(range(len(x)), 2))
        y[i], y[j] = x[i], x[j]
        line = lambda w: ((w[j] - w[i]) * pow(j - i, -1, q) % q, (w[i] - (w[j] - w[i]) * pow(j - i, -1, q) * i) % q)
        assert line(x) == line(y)


def test_split_overlap_against_all_pairs(spark):
    rows = like_texts(3)
    rng = random.Random(5)
    side = {k: rng.choice(["train", "dev", " Train "]) for k, _ in rows if k}
    df = spark.createDataFrame([(k, t, side.get(k)) for k, t in rows], "idx string, code string, split string")
    pairs = split_overlap.record_pairs(*split_overlap.overlapping(df))
    found = {tuple(sorted((r["train_idx"], r["held_idx"]))) for r in pairs.collect()}
    want = {(a, b) for a, b in likes([(k, t) for k, t in rows if k]) if (side[a].strip().lower() == "train") != (side[b].strip().lower() == "train")}
    assert found <= want | {("two", "two2")} and len(want - found) <= 0.01 * len(want)


@pytest.mark.parametrize("kinds", [(6, 40), (41, 400)])
def test_split_overlap_finds_edited_texts_of_all_lengths(spark, kinds):
    rng = random.Random(kinds[0])
    rows, want = [], set()
    for f in range(700):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(*kinds))]
        edited = list(base)
        for _ in range(1 if kinds[1] <= 40 else rng.randrange(1, 2 + len(base) // 20)):
            k = rng.randrange(len(edited))
            edited[k : k + rng.randrange(0, 2)] = [rng.choice(WORDS)] * rng.randrange(0, 2)
        rows += [(f"t{f}", " ".join(base), "train"), (f"d{f}", " ".join(edited), "dev")]
        if _text.likeness(rows[-2][1], rows[-1][1]) >= 0.7 or rows[-2][1] == rows[-1][1]:
            want.add((f"t{f}", f"d{f}"))
    pairs = split_overlap.record_pairs(*split_overlap.overlapping(spark.createDataFrame(rows, "idx string, code string, split string")))
    found = {(r["train_idx"], r["held_idx"]) for r in pairs.collect()}
    assert len(want) > 200 and len(want - found) <= 0.002 * len(want)


def test_chunks_cover_the_text_and_survive_edits():
    text = " ".join(WORDS * 5)
    tokens, text_of, digests, lengths = split_overlap.chunk_batch([text, "", "x", text])
    assert lengths[text_of == 0].sum() == tokens[0] and tokens.tolist() == [100, 0, 1, 100]
    assert (digests[text_of == 0] == digests[text_of == 3]).all()
    a, b = split_overlap.overlap(text, text.replace("omicron", "changed", 1))
    assert 0.7 < a < 1 and 0.7 < b < 1


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (7, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: root(x) for x in parent}


def test_split_assignment_keeps_groups_and_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, t, f"{i // rng.choice((1, 1, 2)):064x}" if i > 600 else f"{0:064X}", rng.choice(["b1", "b2", None])) for i in range(2000) for t in ("t02", "t04")]
    df = spark.createDataFrame(rows, "line_no int, tag string, human_sha256 string, bucket string")
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1), ("none", None)], "split string, target_share double")
    out = group_splits.assign_splits(df, targets).collect()
    assert len(out) == 2000 and len({r["line_no"] for r in out}) == 2000
    by_group = {}
    for r in out:
        by_group.setdefault(r["group_line_no"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values()) and by_group[0] == {"train"}
    share = {s: sum(r["split"] == s for r in out) / len(out) for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.1) < 0.02


def test_few_groups_go_through_the_differencing_too(spark, monkeypatch):
    placed = []
    plain = group_splits._place_giants
    monkeypatch.setattr(group_splits, "_place_giants", lambda giants, *a: placed.extend(giants) or plain(giants, *a))
    rows = [(i, "t02", f"{i // 3:064x}", "b") for i in range(120)] + [(500 + i, "t02", "f" * 64, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "line_no int, tag string, human_sha256 string, bucket string")
    out = group_splits.assign_splits(df, spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, target_share double")).collect()
    assert len(out) == 180 and [g["weight"] for g in placed] == [60]
    share = {s: sum(r["split"] == s for r in out) / 180 for s in ("train", "dev", "test")}
    assert all(abs(share[s] - x) < 0.03 for s, x in (("train", 0.8), ("dev", 0.1), ("test", 0.1)))


def test_flight_keeps_each_chance_over_seeds():
    tokens, chance = np.arange(1.0, 31.0), np.linspace(0.1, 0.9, 30)
    ids = np.arange(30) * 7919
    mean = np.mean([np.round(mixing.flight(tokens, chance, ids, s)) for s in range(600)], axis=0)
    assert abs(mean - chance).max() < 0.1


def test_largest_differencing_is_nearly_even():
    rng = random.Random(7)
    weights = [rng.randrange(1, 30) for _ in range(500)]
    bins = group_splits.difference(weights, 20)
    sums = [sum(weights[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(sums) - min(sums) <= 2
    assert group_splits.difference([], 3) == [[], [], []]


def test_python_grammar_agrees_with_the_language():
    tables = syntax.tables()
    numbers = tables["python"].terminals
    own = lambda t: _lr.first_error(tables["python"], [*(numbers.get(s, -1) for s in _lexers.python_tokens(t)[0]), numbers[_lr.END]]) < 0
    rng = random.Random(8)
    sources = ["def f(a, *b, c=1, **d) -> int:\n    '''d'''\n    for i, j in x[1:2, ::3]:\n        if not i: continue\n        elif j in (1,): break\n        else: pass\n    return {**d, 'k': [*b]}, lambda q: (yield)\n",
               "class A(B, metaclass=M):\n    x: int = 3\n    @property\n    def g(self): return self._g\ntry:\n    import a.b as c\nexcept (E, F) as e:\n    raise X from e\nfinally:\n    with open(p) as f, g() as h: del f.x, h[0]\n",
               "async def m():\n    async with a as b: await c\n    return [i async for i in z if i if not j]\nx = y = 1; z += 2\nassert x, 'no'\nmatch x:\n    case [1, *r] if r: pass\n    case _: pass\n"]
    for _ in range(600):
        t = rng.choice(sources)
        k = rng.randrange(len(t))
        t = rng.choice([t[:k], t[:k] + t[k + 1 :], t[:k] + rng.choice("()[]{}:,=.\n 'x1") + t[k:], t])
        try:
            ast.parse(t)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        if valid:
            assert own(t), t  # what the language takes the table takes
    assert own("") and not own("def f(:\n") and not own("<<<<<<< HEAD\n")


def test_java_and_cpp_errors():
    tables = syntax.tables()
    java = "final class A {\n    static <T> int f(List<T> x) {\n        for (int i = 0; i < 3; i++) { x.add(i > 2 ? 1 : (int) y); }\n        return x.size();\n    }\n}\n"
    cpp = "#include <map>\nint f(const std::map<int, long>& m) {\n    for (const auto& [k, v] : m) { if (k < v && v > 2) return v; }\n    throw std::runtime_error(\"x\");\n}\n"
    assert syntax.syntax_error(java, "java", tables["java"]) is None and syntax.syntax_error(cpp, "cpp", tables["cpp"]) is None
    for kind, good in (("java", java), ("cpp", cpp)):
        t = tables[kind]
        assert syntax.syntax_error(good[:-3], kind, t) is not None
        assert syntax.syntax_error(good.replace("return", "<<<<<<< HEAD\n return"), kind, t)[0] == good[: good.index("return")].count("\n") + 1
        assert syntax.syntax_error("def f(a):\n    return a\n", kind, t) is not None
        assert syntax.syntax_error(good + "/* open", kind, t) is not None and syntax.syntax_error(good.replace(";", "", 1), kind, t) is not None


def test_later_forms_of_java_and_cpp_are_valid():
    tables = syntax.tables()
    cpp = ["template <typename T>\nconcept Small = sizeof(T) < 8 && requires(T t) { t.size(); { t.begin() } -> Same; typename T::value; };\nint f() { return 1; }\n", "template <typename T> requires Small<T> && (sizeof(T) > 1)\nT g(T x) { return x; }\n",
           "#include <a>\nEXPORT_API int f(int a) { return a; }\nMY_MACRO(3, x) void g();\nLIB_API std::string h(int b) { return {}; }\n", 'long double operator"" _km(long double x) { return x; }\nauto d = 10_km + 5ms + "a"s.size();\n', 'void f() { asm volatile("nop" : "=r"(x) : "r"(y) : "memory"); asm("hlt"); }\n', "HANDLE h = open_it();\nHANDLE g(int b) { return h; }\n"]
    java = ["import java.util.List;\n@Deprecated\nopen module a.b.c {\n  requires transitive java.sql;\n exports a.b to c.d, e;\n provides x.Y with z.W;\n}\n", "module m { requires java.base; }", "class A { int module = 3; void f() { module x = null; } }"]
    assert not [t for t in cpp if syntax.syntax_error(t, "cpp", tables["cpp"])] and not [t for t in java if syntax.syntax_error(t, "java", tables["java"])]
    assert syntax.syntax_error("EXPORT_API int f(int a) { return a; \n", "cpp", tables["cpp"]) and syntax.syntax_error("module m { requires java.base; ", "java", tables["java"])


def test_endings():
    whole = ["    return a\n", "    return a", "    for x in y:\n        z(x)\n    return z\n", "Sorry, I can't do that.", "", None, "        return a;\n    }\n}\n", "<|endoftext|>", "    ...\n"]
    cut = ["    return f(a, ", "    x = 'abc", "    for x in y:", "    return a.", "    if (a.b < c", "        int x = f(a", "    value = othe…", "    # note\n    x = [1,\n", '    """Doc that', "    return number + "]
    assert not any(truncation.ending(t)[2] for t in whole) and all(truncation.ending(t)[2] for t in cut)
    assert truncation.ending("    threshold = 1\n    return thres")[1] == "python name"


def test_field_limit_and_endings_decide(spark):
    rows = [(i, "t02", "e1", "    return value_" + "x" * (i % 50) + "\n" * (i % 2), "", "", None) for i in range(200)] + [(1000 + i, "t02", "e1", ("    total = 1\n" * 20)[:150], "", "", None) for i in range(20)]
    df = spark.createDataFrame(rows, "line_no int, tag string, experiment string, raw_output string, clean_output string, agc_code string, body_tokens int")
    out = {r["line_no"]: r["cut"] for r in truncation.cut_outputs(df).collect()}
    assert all(out[1000 + i] for i in range(20)) and not any(out[i] for i in range(200))


def test_a_source_without_line_ends_is_whole(spark):
    rng = random.Random(31)
    whole = lambda i: f"    total = {i}\n    for row in rows:\n        total += row.weight_{rng.randrange(9)}\n    return total"
    rows = [(i, "t02", "stripped", whole(i)) for i in range(200)] + [(300 + i, "t02", "plain", whole(i) + "\n" * (i % 2)) for i in range(200)]
    rows += [(600 + i, "t02", "plain", whole(i)[: rng.randrange(8, 60)]) for i in range(100)]
    df = spark.createDataFrame([(*r, "", "", None) for r in rows], "line_no int, tag string, experiment string, raw_output string, clean_output string, agc_code string, body_tokens int")
    out = {r["line_no"]: r["cut"] for r in truncation.cut_outputs(df).collect()}
    assert not any(out[i] for i in range(200)) and not any(out[300 + i] for i in range(200)) and sum(out[600 + i] for i in range(100)) > 75


def test_broken_signs_and_markup_are_seen():
    assert all(truncation.ending(t)[2] for t in ("He said it cost 5 \u00e2\u0082", "le caf\u00c3", "half a pair \ud83d", "lost \ufffd"))
    assert not any(truncation.ending(t)[2] for t in ("Das ist ein langer Gruß", "Il y avait un café", "Oui, il est là", "It ends well."))
    assert truncation.ending("See the long note at the end of this page (it says a lot more of the matter.")[1] == "sentence inside" and truncation.ending("The page of the project holds a link to it as <a href")[1] == "phrase inside"


def small(name, columns):
    return ds.dataset(f"{SMALL}/{name}.parquet").to_table(columns=columns).to_pylist()


def test_answer_classifier_on_held_out_defects():
    rows = {r["line_no"]: r["prompt"] or "" for r in small("candidates", ["line_no", "prompt"])}
    data = [(rows.get(r["line_no"], ""), r["raw_output"]) for r in small("checkpoints", ["line_no", "raw_output"])]
    _, _, quality = answers.fit(data)
    assert all(p > 0.9 and r > 0.85 for p, r in quality.values()), quality


def test_answer_facts():
    prompt = 'def f(a):\n    """Walk the rows and keep each that fits."""\n'
    facts = lambda t: answers.features(prompt, t, t, False, *truncation.ending(t, prompt))[1]
    assert answers.holds("empty", facts("    pass\n")) and answers.holds("empty", facts("")) and answers.holds("empty", facts(None))
    assert answers.holds("echo", facts(prompt)) and answers.holds("echo", facts(prompt.upper())) and not answers.holds("echo", facts(prompt + "    return a\n"))
    assert answers.holds("refusal", facts("I'm sorry, but I cannot write this function.")) and not answers.holds("refusal", facts("    return a  # sorry, I cannot do better\n"))
    assert answers.holds("other_language", facts("Die Funktion liest zuerst alle Zeilen und gibt sie dann zurück.")) and answers.holds("other_language", facts("    for (int i = 0; i < n; i++) {\n        run(i);\n    }\n    return n;\n}\n"))


def test_file_classes(spark):
    lib = "\n".join(f"def helper_{i}(argument):\n    return compute_value_number_{i}(argument)" for i in range(12))
    rows = [("a/x", "lib/thing.py", lib), ("b/y", "src/copy.py", lib.replace("compute_value_number_3", "edited")), ("c/z", "own.py", "import os\n\n\ndef main_entry_point():\n    print(os.getcwd())\n"), ("c/z", "node_modules/k/i.js", "var a = 1;"), ("c/z", "data.py", "X = [\n" + "    1.5, 2.5, 3.5,\n" * 30 + "]\n"),
            ("c/z", "g.py", "# Generated by tool. DO NOT EDIT\nx = f(1)\n"), ("c/z", "t.py", 'TEMPLATE = """# Generated. DO NOT EDIT"""\n\n\ndef write_it(path):\n    return TEMPLATE.format(path)\n'), ("c/z", "m.js", "function a(b){return b?c(b-1):d[b]};" * 30), ("c/z", "no_text_pb2.py", None), (None, "x.py", lib)]
    files = spark.createDataFrame([(r, p, t, "2024", 1) for r, p, t in rows] * 2, "repo_name string, relative_path string, file_text string, snapshot_time string, snapshot_order bigint")
    manifest = spark.createDataFrame([("d/w", "third_party/k.py"), ("d/w", "src/k.py")], "repo_name string, relative_path string")
    got = {(r["repo_name"], r["relative_path"]): r["file_class"] for r in file_origin.classified(files, manifest).collect()}
    assert got == {("a/x", "lib/thing.py"): "vendored", ("b/y", "src/copy.py"): "vendored", ("c/z", "own.py"): None, ("c/z", "node_modules/k/i.js"): "vendored", ("c/z", "data.py"): "data_blob", ("c/z", "g.py"): "generated", ("c/z", "t.py"): None, ("c/z", "m.js"): "minified", ("c/z", "no_text_pb2.py"): "generated", ("d/w", "third_party/k.py"): "vendored", ("d/w", "src/k.py"): None}


def test_containment_is_exact_where_lines_stand_in_many_repositories(spark, monkeypatch):
    rng = random.Random(21)
    upstream = [f"    upstream_step_{i}(argument_{i * 7 % 31}, limit={i})" for i in range(50)]
    files = [("up/stream", "lib.py", upstream)]
    for k in range(3):  # the same lines, scattered over larger files of other repositories
        files.append((f"mix/{k}", "m.py", rng.sample(upstream, 17) + [f"    mixed_{k}_{i}(value)  # own line of {k}" for i in range(90)]))
    for k in range(20):  # 0.6 of each copy is in the upstream and nowhere else as much
        files.append((f"user/{k}", f"c{k}.py", rng.sample(upstream, 30) + [f"    edited_{k}_{i}(argument_{i}, limit={i})" for i in range(20)]))
    files.append(("own/code", "o.py", upstream[:12] + [f"    handwritten_{i}(argument, other)" for i in range(30)]))
    want = {}
    for r, p, lines in files:
        mine = {x.strip(): len(x.replace(" ", "")) for x in lines}
        share = max(sum(n for x, n in mine.items() if x in {y.strip() for y in other}) / sum(mine.values()) for q, _, other in files if q != r)
        want[r] = "vendored" if share >= file_origin.CONTAINED else None
    df = spark.createDataFrame([(r, p, "\n".join(x), "2024", 1) for r, p, x in files], "repo_name string, relative_path string, file_text string, snapshot_time string, snapshot_order bigint")
    monkeypatch.setattr(file_origin, "composition", lambda text: None)
    none = spark.createDataFrame([], "repo_name string, relative_path string")
    for number in (4, 1):  # whatever the first look-up finds
        monkeypatch.setattr(file_origin, "REPRESENTATIVES", number)
        got = {r["repo_name"]: r["file_class"] for r in file_origin.classified(df, none).where("file_class is null or file_class = 'vendored'").collect()}
        assert all(got.get(r) == c for r, c in want.items() if r in got) and sum(got.get(f"user/{k}") == "vendored" for k in range(20)) == 20 and got.get("own/code") is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(text, phrase):
    index = leakage.FMIndex(np.array(text), 5, sample=4)
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(phrase)] == phrase]


def test_alignment_against_the_full_table():
    rng = random.Random(9)
    for _ in range(40):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(1, 25))] for _ in range(2)]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
        assert leakage.align(np.array(a), np.array(b))[0] == table.max()


def test_leaks(spark):
    rng = random.Random(10)
    item = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(60))
    words = item.split()
    docs = [(1, "Intro here.\n> " + item.upper().replace(" ", ",  ") + " and more"), (2, "x " + " ".join(words[:36])), (3, "y " + " ".join(words[:15])), (4, " ".join(w if k % 9 else "changed" for k, w in enumerate(words))), (5, " ".join(sorted(words))), (6, ""), (7, None)]
    found = leakage.leaks(spark.createDataFrame(docs * 2, "doc_id bigint, text string"), spark.createDataFrame([(9, item), (10, "a b"), (11, None), (None, item)], "item_id bigint, item_text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 9), (2, 9), (4, 9)}


def test_leaks_with_every_fourth_word_changed_and_short_items(spark, monkeypatch):
    rng = random.Random(14)
    items, docs, want = [], [], set()
    for i in range(30):
        words = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(60)]
        items.append((i, " ".join(words)))
        docs.append((i, "before " + " ".join("changed" if k % 4 == 3 else w for k, w in enumerate(words)) + " behind"))
        docs.append((100 + i, "a part: " + " ".join(words[10:34])))
        want.add((i, i))
    items += [(900, "sunlit harbour"), (901, "Vellichor"), (902, "...")]
    docs += [(700, "at the Sunlit, harbour wall"), (701, "a sunlit wall and harbour"), (702, "vellichor!"), (702, "vellichor!")]
    want |= {(700, 900), (702, 901)}
    d, t = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, t).collect()} == want
    assert {(100 + i, i) for i in range(30)} <= {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, t, leakage.PARTLY).collect()}
    monkeypatch.setattr(leakage, "BUNDLE", 4000)
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(d, t).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.01, 0.99)), max_size=60))
def test_flight_keeps_tokens_and_documents(units):
    tokens, chance = np.array([t for t, _ in units], float), np.array([c for _, c in units], float)
    after = mixing.flight(tokens, chance)
    assert ((after > 0) & (after < 1)).sum() <= 2 and np.isclose(after.sum(), chance.sum()) and np.isclose((after * tokens).sum(), (chance * tokens).sum())
    assert set(np.unique(mixing.landing(tokens, after))) <= {0.0, 1.0}


def test_mixture_meets_shares_and_limits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 50)
    rng = random.Random(11)
    docs = [(i, "big" if i % 3 else "small", "word " * rng.randrange(1, 60)) for i in range(900)] + [(5000, None, "x"), (5001, "other", "x"), (5002, "big", None), (5003, "big", "")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("gone", None, 2)], "source string, target_share double, max_repeats int")
    out = mixing.mixed(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets).collect()
    size = {s: sum(r["tokens"] * r["repeats"] for r in out if r["source"] == s) for s in ("big", "small")}
    assert abs(size["big"] / sum(size.values()) - 0.5) < 0.005 and len({r["doc_id"] for r in out}) == len(out)
    assert max(r["repeats"] for r in out if r["source"] == "big") <= 1 and max(r["repeats"] for r in out if r["source"] == "small") <= 3


def test_boosted_trees_learn():
    rng = np.random.default_rng(12)
    x = rng.random((1500, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = _boosting.fit(x[:1000], y[:1000])
    assert ((_boosting.predict(model, x[1000:]) > 0.5) == y[1000:]).mean() > 0.95


def test_personal_data_on_held_out_documents():
    model = personal_data.fit()
    docs = _pii_samples.documents(300, 99)
    found = personal_data.spans([t for t, _ in docs], model)
    real = {(i, *m) for i, (_, marks) in enumerate(docs) for m in marks}
    said = {(i, *m) for i, marks in enumerate(found) for m in marks}
    assert len(real & said) / len(said) > 0.95 and len(real & said) / len(real) > 0.93


def test_redaction_is_a_round_trip(spark):
    texts = ["Signed-off-by: Anna Bergqvist <anna.b@example.com>\nTel.: +44 1632 960571", "nothing here", "", "Pinned index-lib@2.0.1, see git@host.example:a/b.git", None]
    rows = personal_data.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(rows) == 4
    for r in rows:
        text, back, at = texts[r["doc_id"]], r["redacted"], 0
        for f in r["found"]:
            assert text[f["begin"] : f["end"]] == f["pii_text"]
            back = back.replace(f"[{f['pii_type'].upper()}]", f["pii_text"], 1)
        assert back == text
    first = next(r for r in rows if r["doc_id"] == 0)
    assert {(f["pii_type"], f["pii_text"]) for f in first["found"]} == {("name", "Anna Bergqvist"), ("email", "anna.b@example.com"), ("phone", "+44 1632 960571")}
    assert not next(r for r in rows if r["doc_id"] == 3)["found"]


def test_grammars_build():
    for g in (_grammars.PYTHON, _grammars.JAVA, _grammars.CPP):
        assert len(_lr.build(g).action) > 400


def test_near_duplicates_find_a_text_and_its_tenfold_repetition(spark):
    line = " ".join(f"word{i}" for i in range(30)) + "\n"
    df = spark.createDataFrame([("a", "code", line), ("b", "code", line * 10)], "key string, field string, text string")
    members, alike = near_duplicates.like_pairs(df)
    assert {(r["key_a"], r["key_b"]) for r in near_duplicates.member_pairs(members, alike).collect()} == {("a", "b")}
