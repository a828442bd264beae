"""Problem 5: generated, minified, vendored and data files, by an inverted index of lines and composition rules.

Every line of a file behind its opening comment (so licence texts don't count)
weighs as many signs as it has, blanks aside. An inverted index holds all lines
of all files; lines that stand in one repository only can't tell of a copy.
The containment of a file is the greatest share of its weight that stands in
one file of another repository. A file whose lines with others make up less
than CONTAINED of it is done. For the rest, a file that holds CONTAINED of it
must hold one of its rarest lines: with the commonest left out, up to less than
CONTAINED of the weight, none is lost. Those rare lines are looked up in the
index, first among the REPRESENTATIVES largest files that have the line, and
where none of those contains the file, among all. Each pair so found is compared
line by line, so containment is exact wherever it reaches CONTAINED, and a hot
group of copies meets its largest members only.

Files contained by CONTAINED or more, with at least LEAST_SIGNS signs in
common, in a directory for third-party code, or under a banner that names an
upstream are vendored. Which of the holders of a text wrote it can't be told
from texts, so all of them are called vendored. The remaining files are classed
by their path, their opening and closing comments and the composition of their tokens.

A file is (repo_name, relative_path) with both not null; it is judged by its
latest snapshot that has a text, and by its path alone where none has. Rows
delivered twice count once. Files without class are written by hand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.llm._text import slices
from provenir.runtime import blocked_join, cut, table

#: The least containment of a vendored file, and the least number of signs it has in common with its origin.
CONTAINED, LEAST_SIGNS = 0.5, 120
#: Files by which a line is looked up first, and files of a line that one task joins with all others of it.
REPRESENTATIVES, BLOCK = 4, 2000
#: Share of values among a file's tokens, share and number of like lines in a row, length and share of blanks of packed lines, from which the composition rules apply.
DATA_SHARE, REPEATED_SHARE, REPEATED_RUN, LONG_LINE, BLANK_SHARE = 0.85, 0.25, 5, 200, 0.2

# Directories that hold third-party code, and names that tools give to the files they write.
VENDOR_DIRECTORY = r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|site-packages|dist-packages|third[_-]?party|3rd[_-]?party|_?vendor|vendored|Godeps|Pods)/"
GENERATED_PATH = r"(?i)(?:_pb2(?:_grpc)?\.pyi?|\.pb\.(?:cc|h|go)|(?:^|/)parsetab\w*\.py|\.(?:g|generated|gen|designer)\.\w+|(?:^|/)migrations/\d{4}_\w+\.py|(?:^|/)(?:__?generated__?|_generated)/.*)$"
MINIFIED_PATH = r"(?i)[.\-](?:min|pack)\.(?:js|css|mjs)$"
_MARK = re.compile(
    r"auto-?\s?generated|automatically generated|machine[- ](?:generated|written|made)|@generated|\bgenerated (?:by|from|using|with|automatically|code|file)\b|\bcode generated\b|created automatically|do not (?:edit|modify|change)|changes will be (?:lost|overwritten)|\bdon't edit\b|\bsource of truth:|\bmaschinell\b.*\berzeugt|\bautomatisch (?:generiert|erzeugt)|\bgénérée? (?:par|automatiquement)|\bgenerad[oa] (?:por|automáticamente)|\bgerad[oa] (?:por|automaticamente)",
    re.IGNORECASE,
)
_UPSTREAM = re.compile(r"\bcopied from upstream\b|\bupstream:\s*\S|\btaken unchanged\b|\bvendored (?:from|copy)\b|\bcopied verbatim from\b|\bimported from upstream\b|\bthird[- ]party (?:code|library|copy)\b", re.IGNORECASE)
_GENERATED_TEXT = re.compile(r"^_tabversion\s*=|^_lr_action_items\s*=|\bclass Migration\(migrations\.Migration\)|_descriptor_pool\.Default\(\)|\bserializedATN\b|\byy_(?:action|table|check)\b", re.MULTILINE)

_TOKEN = re.compile(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|(?:#|//)[^\n]*|[A-Za-z_$][\w$]*|[-+]?(?:0[xX][0-9a-fA-F]+|(?:\d[\w.]*|\.\d\w*))|\S")
_COMMENT_LINE = re.compile(r"\s*(?:#(?!include|define|pragma|if|endif)|//|/\*|\*|--|<!--|;)")
_SHAPE = (re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\d[\d.]*"))


def leading_comment(text: str) -> str:
    """The comment lines that a file begins with, blank lines between them aside."""
    kept: list[str] = []
    inside = False
    for line in text.splitlines():
        if not line.strip():
            continue
        if not (inside or _COMMENT_LINE.match(line)):
            break
        kept.append(line)
        inside = (inside or "/*" in line) and "*/" not in line.rpartition("/*")[2]
    return "\n".join(kept)


def closing_comment(text: str) -> str:
    """The comment lines that a file ends with, blank lines between them aside."""
    kept: list[str] = []
    for line in reversed(text.splitlines()):
        if line.strip():
            if not _COMMENT_LINE.match(line):
                break
            kept.append(line)
    return "\n".join(reversed(kept))


def line_hashes(text: str) -> np.ndarray:
    """The distinct lines behind the opening comment, blanks at the ends aside: 52 bits of hash and 12 of weight each, in order."""
    rest = text.splitlines()
    head, inside = 0, False
    for line in rest:
        if line.strip():
            if not (inside or _COMMENT_LINE.match(line)):
                break
            inside = (inside or "/*" in line) and "*/" not in line.rpartition("/*")[2]
        head += 1
    found = set()
    for line in {x.strip() for x in rest[head:]}:
        if line:
            signs = len(line) - sum(map(line.count, " \t\u00a0\f\v"))
            found.add((xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) & ~0xFFF) | min(signs, 0xFFF))
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def composition(text: str) -> str | None:
    """generated, minified or data_blob by what the text is made of, or None."""
    if _MARK.search(leading_comment(text)) or _MARK.search(closing_comment(text)) or _GENERATED_TEXT.search(text):
        return "generated"
    body = text[1:] if text.startswith("﻿") else text
    names = literals = signs = squeezed = 0
    for m in _TOKEN.finditer(body):
        t = m.group()
        c = t[0]
        if t.startswith(("#", "//", "/*")):
            continue
        if c in "\"'" or c.isdigit() or len(t) > 1 and c in "+-.":
            literals += 1
            squeezed += 2 if c in "\"'" else len(t)
        elif c.isalpha() or c in "_$":
            if t not in ("true", "false", "null", "None", "True", "False"):
                names += 1
            squeezed += len(t)
        else:
            signs += 1
            squeezed += 1
    if literals + names == 0:
        return None
    csv = _delimited(body)
    if csv or literals >= 12 and literals / (literals + names) >= DATA_SHARE:
        return "data_blob"
    plain = _SHAPE[0].sub('""', re.sub(r"\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}", '""', body))
    lines = [x for x in plain.splitlines() if x.strip() and not _COMMENT_LINE.match(x)]
    if lines:
        packed = [x for x in lines if len(x) > LONG_LINE]
        blanks = sum(x.count(" ") + x.count("\t") for x in packed)
        size = sum(map(len, packed))
        if size > 0.5 * sum(map(len, lines)) and blanks <= BLANK_SHARE * size:
            return "minified"
    total, run, best, last = sum(1 for x in lines if re.search(r"\w", x)), 0, 0, None
    for x in lines:
        shape = _SHAPE[2].sub("0", _SHAPE[1].sub("a", x)).strip()
        shape = shape[: shape.find(",") if "," in shape else len(shape)]
        run = run + 1 if shape == last else 1
        last = shape
        if shape.count("a") >= 2 and ("(" in shape or "=" in shape):
            best = max(best, run)
    return "generated" if best >= REPEATED_RUN and best >= REPEATED_SHARE * total else None


def _delimited(text: str) -> bool:
    """Whether the text is a table: many lines of equally many fields, parted by a comma, semicolon or tab, most of them values."""
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 5:
        return False
    for d in ",;\t":
        n = Counter(x.count(d) for x in lines)
        count, rows = n.most_common(1)[0]
        if count >= 1 and rows >= 0.9 * len(lines) and sum(bool(re.search(r"[(){}=\[\]]", x)) for x in lines) <= 0.02 * len(lines):
            return True
    return False


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "file_text"):
        texts = [t or "" for t in batch.column("file_text").to_pylist()]
        made = [composition(t) if t.strip() else None for t in texts]
        banner = [bool(_UPSTREAM.search(leading_comment(t))) for t in texts]
        lines = [line_hashes(t) for t in texts]
        ends = pa.array(np.cumsum([0, *map(len, lines)]), pa.int32())
        weight = [int((x & 0xFFF).sum()) for x in lines]
        held = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *lines]), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("repo"), pa.array(made, pa.string()), pa.array(banner), held, pa.array(weight, pa.int64())], ["file", "repo", "made", "banner", "lines", "weight"])


def _compared(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(shape, contained) of the shapes that one of their origins in pairs (shape, origin) contains by CONTAINED or more."""
    a = shapes.select("shape", F.col("lines").alias("mine"), "weight")
    b = shapes.select(F.col("shape").alias("origin"), F.col("lines").alias("theirs"))
    common = F.aggregate(F.array_intersect("mine", "theirs"), F.lit(0).cast("bigint"), lambda n, x: n + x.bitwiseAND(F.lit(0xFFF)))
    held = pairs.join(a, "shape").join(b, "origin").select("shape", (common / F.col("weight")).alias("share"))
    return held.groupBy("shape").agg(F.max("share").alias("contained")).where(F.col("contained") >= CONTAINED)


def containment(files: DataFrame) -> DataFrame:
    """(file, contained) of the files (file, repo, lines, weight) that a file of another repository contains by CONTAINED or more."""
    some = files.where("weight > 0").withColumn("shape", F.xxhash64("lines", "weight"))
    # equal texts are one shape; a shape of two repositories is contained whole
    shapes = cut(some.groupBy("shape").agg(F.first("lines").alias("lines"), F.first("weight").alias("weight"), F.min("repo").alias("a"), F.max("repo").alias("b")), "p5-shapes")
    index = shapes.select("shape", "weight", "a", "b", F.explode("lines").alias("line"))
    shared = index.groupBy("line").agg(F.count("*").alias("df"), F.min("a").alias("first"), F.max("b").alias("last")).where("first <> last").select("line", "df")
    crossing = cut(index.join(shared, "line"), "p5-shared")
    probes = crossing.where("a = b").withColumn("signs", F.col("line").bitwiseAND(F.lit(0xFFF)))
    order = Window.partitionBy("shape").orderBy(F.desc("df"), "line").rowsBetween(Window.unboundedPreceding, 0)
    least = F.lit(CONTAINED) * F.col("weight")
    probes = probes.withColumn("so_far", F.sum("signs").over(order)).withColumn("in_all", F.sum("signs").over(Window.partitionBy("shape")))
    probes = cut(probes.where((F.col("in_all") >= least) & (F.col("so_far") >= least)).select("shape", F.col("a").alias("repo"), "line"), "p5-probes")

    elsewhere = (F.col("origin") != F.col("shape")) & ((F.col("a") != F.col("repo")) | (F.col("b") != F.col("repo")))
    largest = crossing.groupBy("line", F.pmod("shape", F.lit(REPRESENTATIVES)).alias("part")).agg(F.max(F.struct("weight", "shape", "a", "b")).alias("top")).select("line", F.col("top.shape").alias("origin"), "top.a", "top.b")
    first = cut(_compared(probes.join(largest, "line").where(elsewhere).select("shape", "origin").distinct(), shapes), "p5-first")
    rest = probes.join(first.select("shape"), "shape", "left_anti")
    everywhere = blocked_join(crossing.select("line", F.col("shape").alias("origin"), "a", "b"), rest, ["line"], BLOCK)
    second = _compared(everywhere.where(elsewhere).select("shape", "origin").distinct(), shapes)
    whole = shapes.where("a <> b").select("shape", F.lit(1.0).alias("contained"))
    return some.join(whole.union(first).union(second), "shape").select("file", "contained")


def classified(source_files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file of either table with file_class (null for hand-written) and contained (0 below CONTAINED)."""
    key = ["repo_name", "relative_path"]
    named = source_files.select(*key).union(manifest.select(*key)).where("repo_name is not null and relative_path is not null").distinct()
    texts = source_files.where("repo_name is not null and relative_path is not null and file_text is not null")
    texts = texts.select(*key, F.xxhash64(*key).alias("file"), F.xxhash64("repo_name").alias("repo"), F.struct(F.col("snapshot_time"), F.col("snapshot_order"), F.xxhash64("file_text")).alias("state"), "file_text")
    # the latest state by keys alone; only its text is fetched
    latest = texts.groupBy("file").agg(F.max("state").alias("best"))
    chosen = texts.join(latest, "file").where(F.col("state").eqNullSafe(F.col("best"))).select("file", "repo", "file_text").dropDuplicates(["file"])
    made = cut(chosen.mapInArrow(_compose, "file bigint, repo bigint, made string, banner boolean, lines array<bigint>, weight bigint"), "p5-files")
    held = containment(made)
    judged = named.withColumn("file", F.xxhash64(*key)).join(made.select("file", "made", "banner", "weight"), "file", "left").join(held, "file", "left")
    path = F.col("relative_path")
    file_class = (
        F.when(path.rlike(VENDOR_DIRECTORY) | F.coalesce("banner", F.lit(False)) | (F.coalesce(F.col("contained") * F.col("weight"), F.lit(0.0)) >= LEAST_SIGNS), "vendored")
        .when(path.rlike(GENERATED_PATH), "generated")
        .when(F.col("made").isNotNull(), F.col("made"))
        .when(path.rlike(MINIFIED_PATH), "minified")
    )
    return judged.select(*key, file_class.alias("file_class"), F.coalesce("contained", F.lit(0.0)).alias("contained"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["repo_name", "relative_path", "file_text", "snapshot_time", "snapshot_order"]
    return classified(table(spark, sf_dir, "source_files").select(*columns), table(spark, sf_dir, "function_manifest").select("repo_name", "relative_path"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("file_class is not null").select("repo_name", "relative_path", "file_class")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and class (handwritten included): files and their share of the repository."""
    files = cut(_files(spark, sf_dir), "p5-classes").select("repo_name", F.coalesce("file_class", F.lit("handwritten")).alias("file_class"))
    size = files.groupBy("repo_name").agg(F.count("*").alias("all_files"))
    return files.groupBy("repo_name", "file_class").agg(F.count("*").alias("files")).join(size, "repo_name").withColumn("share", F.col("files") / F.col("all_files"))
