"""Problem 2: outputs cut off by field limits or in transfer, by a stack automaton.

An automaton reads each output whole. It cuts it into the answer and what
follows (another file, prose behind a fence, further code), keeps a stack of
open brackets, strings, comments and fences in the unit that comes last, and
names the statement or sentence the text ends with. An output is cut if

* the unit is open: a string, bracket, comment or escape isn't closed, a
  broken character or a cut mark stands last, a statement lacks its rest or a
  block its body, or the last word is the beginning of a name used before;
* or its kind of ending is no terminator of its source: every text is cut once
  more at a place of its own, and the endings so made tell how cuts spread over
  the kinds. The open endings of a source then tell how many cuts it has, and
  so how many of each other kind are to be expected; what a kind has beyond
  them is whole. A kind without line end must besides fit the same kind with
  one, by the share of the source's sure terminators that go without. The
  baseline of a source leans on that of all by LEAN texts, whatever its size;
* or it fills its source's field (a length that stands out among those just
  below it, near the end of the source's lengths) and doesn't end in a
  terminator with a line end.

body_tokens decides where the baseline is in doubt. Null and empty outputs
are whole. Rows delivered twice count once; a null experiment is a source of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.llm._text import slices
from provenir.runtime import cut, spread, table

#: Texts of all sources that a source's own baseline is filled up with.
LEAN = 30
#: An ending whose whole share is below SURE_CUT is no terminator; up to SURE_WHOLE body_tokens decides.
SURE_CUT, SURE_WHOLE = 0.25, 0.6
#: A field limit is a length that at least this share of its source's rows have, so many times as many as a length in
#: the tenth below it has on average and so many deviations of that number more, with at most this share of the rows beyond.
#: Of the texts that fill a field at least LIMIT_OPEN are open, as texts of a usual length are not.
LIMIT_SHARE, LIMIT_RISE, LIMIT_SURE, LIMIT_BEYOND, LIMIT_OPEN = 0.002, 6.0, 6.0, 0.01, 0.3

_FENCE = re.compile(r"^[ \t]*```[\w+-]*[ \t]*\r?$", re.MULTILINE)
_CODE = re.compile(
    r"""(?P<triple>\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})
  | (?P<opentriple>\"{3}|'{3})
  | (?P<string>"(?:[^"\\\r\n]|\\.)*+"|'(?:[^'\\\r\n]|\\.)*+')
  | (?P<openstring>["'])
  | (?P<block>/\*(?:[^*]|\*(?!/))*+\*/)
  | (?P<openblock>/\*)
  | (?P<comment>(?:\#|//)[^\r\n]*)
  | (?P<line>\r\n|\r|\n)
  | (?P<blank>[ \t\f]+|\\(?:\r\n|\r|\n))
  | (?P<word>\w+)
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
  | (?P<sign>.)""",
    re.VERBOSE | re.DOTALL,
)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]`*_]*\Z")
_HEADER = re.compile(r"(?:if|elif|else|for|while|try|except|finally|with|def|class|async|match|case)\b")
_NEEDS_MORE = frozenset("return_ and or not in is if else lambda for import from as raise_ assert del with while elif except def class new throw case".split())
_CUT_MARK = re.compile(r"(?:…|�|\[truncated\]|\[cut\]|<truncated>)\s*\Z")
# The first bytes of a UTF-8 character without the rest: lone surrogates, or read as Latin-1 a lead sign with fewer signs after it than it asks for.
_BROKEN_SIGN = re.compile(r"(?:[\ud800-\udfff]|[\u00c2\u00c3]|[\u00e0-\u00ef][\u0080-\u00a0\u00a2-\u00aa\u00ac-\u00ba\u00bc-\u00be]|[\u00f0-\u00f4][\u0080-\u00be]{1,2})\Z")
_OPEN_MARKUP = re.compile(r"<[A-Za-z/!][^<>]*\Z|&#?\w{0,8}\Z|\\(?:x[0-9a-fA-F]?|u[0-9a-fA-F]{0,3})?\Z")


def is_prose(text: str) -> bool:
    """Whether a unit reads as sentences, not as code."""
    lead = text.lstrip()[:1]
    if not lead or lead in "#/\"'@":
        return False
    plain = re.sub(r"`[^`]*`", "", text) if "`" in text else text
    words = len(re.findall(r"[^\W\d_]{2,}", text))
    if words < 3 or sum(map(plain.count, "=(){};[]<>")) + plain.count(":\n") > 0.12 * words:
        return False
    return not re.search(r"^[ \t]*(?:def|class|return|import|from|#include|if|for|while|try|with)\b.*[:;{)][ \t]*\r?$", text, re.MULTILINE)


_OPENS = re.compile(r"(?:\)|\belse|\btry|\bdo|\b(?:class|struct|interface|enum|namespace)\b[^=]*|\bconst|\bnoexcept|\boverride)[ \t]*\{\Z")
_INDENTING = ("def ", "class ", "if ", "elif ", "else", "for ", "while ", "try", "except", "finally", "with ", "async ")


def braced(text: str) -> bool:
    """Whether code looks like a language of braces and semicolons."""
    balance = 0
    for line in text.splitlines():
        line = (line.split("//", 1)[0] if "//" in line else line).strip()
        if line.endswith(";"):
            balance += 1
        elif line.endswith("{"):
            balance += bool(_OPENS.search(line))
        elif line.endswith(":") and line.startswith(_INDENTING) or line.startswith("return") and ";" not in line:
            balance -= 1
    return balance > 0


def units(text: str) -> tuple[str, str, str]:
    """The unit that text ends in: "answer" or "after", its kind "code" or "prose", and its text."""
    unit, kind, begin = "answer", "", 0
    stripped = len(text) - len(text.lstrip())
    fences = list(_FENCE.finditer(text))
    inside = False
    for f in fences:
        if f.start() <= stripped:
            inside, begin = True, f.end()
        elif inside or begin == 0 and unit == "answer":
            inside, unit, kind, begin = False, "after", "prose", f.end()
        else:
            inside, unit, kind, begin = True, "after", "code", f.end()
    if (at := text.rfind("<file_sep>")) >= begin:
        unit, kind, begin = "after", "code", at + len("<file_sep>")
    rest = text[begin:]
    if not kind:
        kind = "prose" if is_prose(rest) else "code"
    return unit, kind, rest


def scan(text: str) -> dict:
    """What the automaton finds at the end of a code unit."""
    braces = braced(text)
    stack: list[str] = []
    net, lowest, wrapped = 0, 0, False
    statement: list[str] = []
    begin, last_begin, base, ended_at = 0, 0, None, -1
    last: list[str] = []
    last_indent, comment_last, line_start = 0, False, 0
    blocks: list[tuple[int, bool]] = []
    end = "whole"
    for m in _CODE.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            if not stack and statement and not braces:
                last, last_begin, statement = statement, begin, []
            line_start = m.end()
            continue
        if kind == "blank":
            continue
        if kind == "comment":
            if m.group()[0] == "/" and not braces and not m.group().startswith("//"):
                continue
            if m.group().startswith("//") and not braces:
                continue
            comment_last = True
            last_indent = m.start() - line_start
            continue
        if kind in ("opentriple", "openstring", "openblock"):
            if kind == "openstring":
                rest = text[m.end() :]
                if "\n" not in rest.rstrip("\n"):
                    end = "string"
                    break
                continue
            end = "string" if kind == "opentriple" else "comment"
            break
        if kind == "block":
            comment_last = True
            continue
        comment_last = False
        value = m.group()
        if not statement and not stack:
            begin = m.start()
            last_indent = begin - line_start
            if base is None:
                base = last_indent
        if kind == "open":
            if value != "{" or not braces:
                stack.append(value)
            else:
                net += 1
                wrapped = wrapped or net > 0
        elif kind == "close":
            if value == "}" and braces:
                net -= 1
                lowest = min(lowest, net)
                if net <= 0:
                    ended_at = m.end()
            elif stack:
                stack.pop()
        statement.append("S" if kind in ("string", "triple") else value)
        if braces and not stack and value in ";{}":
            last, last_begin, statement = statement, begin, []
    unfinished = bool(statement)
    final = statement or last
    return {"end": end, "stack": len(stack), "net": net, "braces": braces, "final": final, "open_statement": unfinished, "indent": last_indent, "base": base or 0, "comment": comment_last, "ended_at": ended_at, "blocks": blocks, "at": begin if statement else last_begin}


def _python_after(text: str) -> int:
    """Where code behind the first function of a Python answer begins, or -1."""
    lines = list(re.finditer(r"^([ \t]*)(\S[^\r\n]*)", text, re.MULTILINE))
    depth_seen = False
    for m in lines:
        deep, code = len(m.group(1)), m.group(2)
        if deep:
            depth_seen = True
        elif depth_seen and not code.startswith((")", "]", "}", '"""', "'''")):
            return m.start()
        elif not depth_seen and not re.match(r"(?:async\s+def|def|class|@|import|from|#|\"|')", code):
            depth_seen = True
    return -1


def ending(text: str | None, header: str = "") -> tuple[str, str, bool]:
    """Unit and class of a text's ending, and whether the end itself is open.

    header may hold further text whose names the output may use.
    """
    if text is None or not text.strip():
        return "answer", "nothing", False
    if text.rstrip().endswith(("<|endoftext|>", "</s>", "<|im_end|>")):
        return "answer", "marked", False
    unit, kind, rest = units(text)
    body = text.rstrip("\r\n")
    if _CUT_MARK.search(text) or _BROKEN_SIGN.search(text) or re.search(r"[^\s.]\.\.\.\s*\Z", text):
        if unit == "answer" and kind == "code" and not braced(rest) and _python_after(rest) >= 0:
            unit = "after"
        return unit, "mark", True
    if not rest.strip():
        return unit, "fence", False
    if kind == "prose":
        # an open bracket, quote or tag makes a kind of ending of its own, which the baseline judges
        inside = rest.count("(") > rest.count(")") or rest.count("`") % 2 or rest.count("“") > rest.count("”") or _OPEN_MARKUP.search(body)
        return unit, ("sentence" if _SENTENCE_END.search(body.rstrip()) else "phrase") + (" inside" if inside else ""), False
    if unit == "answer" and not braced(rest):
        after = _python_after(rest)
        if after >= 0:
            unit, rest = "after", rest[after:]
    s = scan(rest)
    language = "braces" if s["braces"] else "python"
    if s["braces"] and unit == "answer" and s["ended_at"] >= 0 and rest[s["ended_at"] :].strip(" \t\r\n}") and s["net"] <= 0:
        unit = "after"
    final = s["final"]
    if s["end"] != "whole":
        return unit, f"{language} {s['end']}", True
    if s["stack"]:
        return unit, f"{language} bracket", True
    if body.endswith("\\"):
        return unit, f"{language} escape", True
    if s["comment"]:
        return unit, f"{language} comment {'sentence' if _SENTENCE_END.search(body.rstrip().removesuffix('*/').rstrip()) else 'phrase'}", False
    if not final:
        return unit, f"{language} nothing", False
    lead, tail = final[0], final[-1]
    if s["braces"]:
        if s["open_statement"]:
            return unit, "braces statement", True
        return unit, f"braces {tail} {max(-3, min(3, s['net']))}{' deep' if s['indent'] else ''}", False
    deep = s["indent"] > s["base"] if unit == "answer" or lead in ("return", "raise") and s["base"] else s["indent"] > 4
    if tail == ":" and _HEADER.match(lead):
        return unit, "python header", True
    if final == [".", ".", "."]:
        return unit, "python ellipsis", False
    if tail in ("=", ".", ",", "+", "-", "*", "/", "%", "<", ">", "!", "|", "&", "@", "~", "^") or tail in _NEEDS_MORE or _HEADER.match(lead) and tail != ":" and lead not in ("match", "case"):
        return unit, "python statement", True
    if body == text and re.fullmatch(r"[^\W\d]\w*", tail) and _begun(tail, text[: len(text) - len(tail)], header):
        return unit, "python name", True
    shape = lead if lead in ("return", "raise", "pass", "continue", "break", "S", "yield") else "assign" if "=" in final else "call" if tail == ")" else "expression"
    return unit, f"python {shape}{' deep' if deep and shape != 'S' else ''}", False


def _begun(name: str, before: str, header: str) -> bool:
    """Whether name is new and begins a longer name that was used before."""
    words = set(re.findall(r"\w+", before)) | set(re.findall(r"\w+", header))
    return name not in words and any(w.startswith(name) for w in words)


def self_cut(text: str) -> str:
    """The text cut at a place that its own hash names."""
    return text[: 1 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(text) - 1)]


_SEEN = "line_no int, tag string, experiment string, chars int, line_end boolean, missing boolean, unit string, class string, open boolean, probe_unit string, probe_class string, probe_open boolean, probe_line_end boolean"


def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "raw_output"):
        found, probes = [], []
        for raw, clean, code in zip(*(batch.column(c).to_pylist() for c in ("raw_output", "clean_output", "agc_code"))):
            kept = (clean or "").strip()
            header = (code or "").replace(kept, "") if kept else code or ""
            found.append(ending(raw, header))
            piece = self_cut(raw) if raw and raw.strip() else None
            probes.append((*ending(piece, header), piece.endswith("\n")) if piece else (None, None, None, None))
        arrays = [batch.column(c) for c in ("line_no", "tag", "experiment", "chars", "line_end", "missing")]
        made = [pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])]
        made += [pa.array([x[0] for x in probes], pa.string()), pa.array([x[1] for x in probes], pa.string()), pa.array([x[2] for x in probes], pa.bool_()), pa.array([x[3] for x in probes], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*arrays, *made], [f.split()[0] for f in _SEEN.split(", ")])


def cut_outputs(checkpoints: DataFrame) -> DataFrame:
    """Every output with its ending's unit and class and whether it was cut.

    checkpoints has line_no, tag, experiment, raw_output, clean_output,
    agc_code and body_tokens.
    """
    rows = checkpoints.where("line_no is not null and tag is not null")
    spaces = F.length(F.regexp_replace(F.regexp_replace(F.coalesce("clean_output", F.lit("")), r"^\n+|\n+$", ""), "[^ ]", "")) + 1
    rows = rows.select(
        "line_no", "tag", F.coalesce("experiment", F.lit("")).alias("experiment"), "raw_output", "clean_output", "agc_code",
        F.length(F.regexp_replace("raw_output", r"\n+$", "")).alias("chars"), F.coalesce(F.col("raw_output").endswith("\n"), F.lit(False)).alias("line_end"),
        F.coalesce(F.col("body_tokens") > spaces, F.lit(False)).alias("missing"),
    )
    seen = spread(rows).mapInArrow(endings, _SEEN)
    seen = cut(seen.dropDuplicates(["line_no", "tag"]), "p2-endings")

    lengths = seen.where("chars is not null").groupBy("experiment", "chars").agg(F.count("*").alias("n"), F.count_if("open").alias("open_there"))
    # the tenth below a length, by running totals over the lengths (a source has few next to its rows)
    by_length = Window.partitionBy("experiment").orderBy("chars")
    lengths = lengths.withColumn("up_to", F.sum("n").over(by_length)).withColumn("all", F.sum("n").over(Window.partitionBy("experiment")))
    spots = lengths.where((F.col("n") >= F.lit(LIMIT_SHARE) * F.col("all")) & (F.col("open_there") >= LIMIT_OPEN * F.col("n"))).where(F.col("all") - F.col("up_to") <= F.lit(LIMIT_BEYOND) * F.col("all"))
    low = lengths.select(F.col("experiment").alias("e"), F.col("chars").alias("c"), F.col("n").alias("m"))
    spots = spots.join(low, (F.col("e") == F.col("experiment")) & (F.col("c") < F.col("chars")) & (F.col("c") >= F.col("chars") * 0.9), "left").groupBy("experiment", "chars", "n").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("below"))
    spots = spots.withColumn("mean", F.col("below") / F.greatest(F.lit(1.0), F.ceil(F.col("chars") * 0.1)))
    limits = spots.where((F.col("n") >= LIMIT_RISE * F.col("mean")) & (F.col("n") - F.col("mean") >= LIMIT_SURE * F.sqrt(F.col("mean"))) & (F.col("n") >= 4))
    limits = limits.groupBy("experiment").agg(F.max_by("chars", "n").alias("limit"))

    at_limit = seen.join(F.broadcast(limits), "experiment", "left").withColumn("full", F.coalesce(F.col("chars") == F.col("limit"), F.lit(False)))
    free = at_limit.where("not full and class not in ('nothing', 'marked')")
    ending_of = ["experiment", "unit", "class", "line_end"]
    has = free.where("not open").groupBy(*ending_of).agg(F.count("*").alias("n"))
    cuts = seen.where("probe_class is not null").groupBy("experiment", F.col("probe_unit").alias("unit"), F.col("probe_class").alias("class"), F.col("probe_line_end").alias("line_end")).agg(F.count("*").alias("probes"), F.count_if(F.col("probe_open")).alias("probes_open"))
    all_cuts = cuts.groupBy("unit", "class", "line_end").agg(F.sum("probes").alias("p"), F.sum("probes_open").alias("po"))
    total = all_cuts.groupBy("unit").agg(F.sum("p").alias("tp"), F.sum("po").alias("tpo"))
    own = cuts.groupBy("experiment", "unit").agg(F.sum("probes").alias("sp"), F.sum("probes_open").alias("spo"))
    opened = free.groupBy("experiment", "unit").agg(F.count_if("open").alias("opened"))
    # the tables below have a row for each unit or each kind of ending of a source
    sources = opened.join(own, ["experiment", "unit"], "left").join(total, "unit", "left")
    open_share = (F.coalesce("spo", F.lit(0)) + LEAN * F.coalesce(F.col("tpo") / F.col("tp"), F.lit(0.0))) / (F.coalesce("sp", F.lit(0)) + LEAN)
    sources = sources.withColumn("cuts", F.col("opened") / F.greatest(open_share, F.lit(0.01)))
    kinds = has.join(sources, ["experiment", "unit"]).join(cuts.select(*ending_of, "probes", "probes_open"), ending_of, "left").join(all_cuts, ["unit", "class", "line_end"], "left")
    share_cut = (F.coalesce(F.col("probes") - F.col("probes_open"), F.lit(0)) + LEAN * F.coalesce((F.col("p") - F.col("po")) / F.col("tp"), F.lit(0.0))) / (F.coalesce("sp", F.lit(0)) + LEAN)
    kinds = kinds.select(*ending_of, "n", F.greatest(F.lit(0.0), 1 - F.col("cuts") * share_cut / F.col("n")).alias("beyond_cuts"))
    # how often the source's whole texts go without a line end, from its sure terminators; what a kind has without one must fit what it has with one
    terminator = F.col("beyond_cuts") >= 0.9
    ends = kinds.groupBy("experiment").agg(*((F.coalesce(F.sum(F.when(terminator & (F.col("line_end") == x), F.col("n"))), F.lit(0)) + 1).alias(f"ends_{x}".lower()) for x in (True, False)))
    with_end = kinds.where("line_end").select("experiment", "unit", "class", F.col("n").alias("n_end"))
    kinds = kinds.join(ends, "experiment").join(with_end, ["experiment", "unit", "class"], "left")
    fits = F.when(~F.col("line_end"), (F.coalesce("n_end", F.lit(0)) + 1) * F.col("ends_false") / F.col("ends_true") / F.col("n")).otherwise(F.lit(1.0))
    kinds = kinds.select(*ending_of, F.least(F.lit(1.0), "beyond_cuts", fits).alias("whole_share"))
    judged = at_limit.join(kinds, ending_of, "left").withColumn("whole_share", F.coalesce("whole_share", F.lit(0.0)))
    ends = F.col("line_end") & (F.col("whole_share") >= SURE_WHOLE)
    verdict = (
        F.when(F.col("class").isin("nothing", "marked"), False)
        .when(F.col("open"), True)
        .when(F.col("full"), ~ends)
        .when(F.col("whole_share") < SURE_CUT, True)
        .when(F.col("whole_share") < SURE_WHOLE, F.col("missing"))
        .otherwise(False)
    )
    return judged.withColumn("cut", verdict)


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "checkpoints").select("line_no", "tag", "experiment", "raw_output", "clean_output", "agc_code", "body_tokens")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_outputs(_checkpoints(spark, sf_dir)).where("cut").select("line_no", "tag")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment: outputs, cut ones, their share, its field limit and how many of the cut fill it."""
    judged = cut_outputs(_checkpoints(spark, sf_dir))
    return judged.groupBy("experiment").agg(
        F.count("*").alias("outputs"), F.count_if(F.col("cut")).alias("cut_outputs"), F.avg(F.col("cut").cast("double")).alias("cut_share"), F.max("limit").alias("field_limit"),
        F.count_if(F.col("cut") & F.col("full")).alias("cut_at_limit"), F.count_if(F.col("cut") & (F.col("unit") == "answer")).alias("cut_in_answer"))
