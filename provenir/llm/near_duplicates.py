"""Problem 7: near-duplicate functions, by anchor points of a covering code.

Every distinct text gets a fingerprint of 12 symbols of GF(q), q = 2^31 - 1:
the least hashes, under 12 hash functions, of its token runs. The code is the
Reed-Solomon code of length 12 and dimension 2 over GF(q). Its words, the
lines through two points, are the anchors; the code covers the whole space
with radius 10. A fingerprint is copied to every anchor within that radius,
which are the lines through two of its symbols, so two fingerprints meet at
an anchor exactly if they have two symbols in common (or, by a chance of about
1 in q, two lines in common without). At the anchor the 128-bit signatures of
the two texts are compared, and each pair is put out only at the first anchor
they share. What is left is checked on whole texts.

Replication to radius plus threshold, as for a binary code, can't serve
here: likes at 0.7 differ in three tenths of their symbols, and beyond the
radius every anchor of the code would have to be taken (README has figures
for a binary code). With anchors this far apart meeting within the radius is
the same rule as banding the minimum hashes in all pairs of places.

Null and blank texts and null keys are no records. A text of fewer than three
tokens has no run of three and is like no other text. Rows delivered twice
count once; columns of the input other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import _text as X
from provenir.llm._graph import components
from provenir.runtime import blocked_join, cut, spread, table

#: The least likeness of a pair, on runs of three tokens.
THRESHOLD = 0.7
#: Length of the code, so symbols of a fingerprint.
LENGTH = 12
#: The field of the code has this prime number of elements.
PRIME = 2**31 - 1
#: Runs of this many tokens make the fingerprint of texts with more than SHORT distinct tokens' runs,
#: runs of three that of texts with up to LONG; a text between gets both, so likes always share a kind.
WIDE, SHORT, LONG = 8, 40, 60
#: Least number of equal signature bits of 128. Two texts differ in no more bits than they have different runs, so
#: texts of up to 130 runs lose nothing; beyond, likes at 0.7 have 109 with a standard deviation of 4, so 88 lies five
#: below. Unlike texts (likeness 0.05) have 67 with a standard deviation of 6.
AGREE = 88
#: Fingerprints of an anchor that one task compares with all others of it.
BLOCK = 2000

_SYMBOLS = np.random.default_rng(7).integers(1, 2**63, (2, LENGTH), dtype=np.uint64) | np.uint64(1)
_FINGERPRINTS = "key string, field string, doc binary, kind int, symbols array<bigint>, s1 bigint, s2 bigint"


def _symbols(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprints, a row for each text, as elements of the field."""
    columns = []
    for k in range(LENGTH):
        mixed = (values ^ _SYMBOLS[0, k]) * _SYMBOLS[1, k]
        columns.append(X.minima((mixed ^ (mixed >> np.uint64(33))) >> np.uint64(1), offsets, 0) % np.uint64(PRIME))
    return np.stack(columns, axis=1).astype(np.int64)


def _distinct(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct values of each text."""
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, texts))
    v, t = values[order], texts[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=len(offsets) - 1)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, "text"):
        hashes, offsets = X.token_hashes(batch.column("text").to_pylist())
        threes, at3 = X.runs(hashes, offsets, 3)
        wides, at8 = X.runs(hashes, offsets, WIDE)
        signs, n = X.signatures(threes, at3), _distinct(threes, at3)
        for kind, rows, symbols in ((3, np.flatnonzero((n > 0) & (n <= LONG)), _symbols(threes, at3)), (WIDE, np.flatnonzero(n >= SHORT), _symbols(wides, at8))):
            if len(rows):
                part = batch.take(pa.array(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * LENGTH + 1, LENGTH), pa.int32()), pa.array(symbols[rows].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("field"), part.column("doc"), pa.array(np.full(len(rows), kind), pa.int32()), lists, pa.array(signs[rows, 0]), pa.array(signs[rows, 1])],
                    ["key", "field", "doc", "kind", "symbols", "s1", "s2"],
                )


def fingerprints(records: DataFrame) -> DataFrame:
    """records (key, field, text) with their digest, fingerprint and signature; one or two rows each."""
    rows = records.where(F.col("key").isNotNull() & X.has_token(F.col("text")))
    rows = rows.select(F.col("key").cast("string"), F.col("field").cast("string"), "text", X.text_digest(F.col("field"), F.col("text")).alias("doc"))
    return rows.mapInArrow(_fingerprint, _FINGERPRINTS)


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs (field, doc_a, doc_b) of different texts that share an anchor and whose signatures agree.

    A symbol that no other fingerprint has at its place can't lead to a common
    anchor, so lines through such a symbol are left out before the replication.
    """
    docs = prints.select("doc", "field", "kind", "symbols", "s1", "s2").dropDuplicates(["doc", "kind"])
    places = docs.select("doc", "field", "kind", F.posexplode("symbols").alias("place", "symbol"))
    common = places.groupBy("field", "kind", "place", "symbol").count().where("count > 1").drop("count")
    live = places.join(common, ["field", "kind", "place", "symbol"], "left_semi")
    live = live.groupBy("doc", "kind").agg(F.sort_array(F.collect_list((F.col("place").cast("bigint") * (2**32) + F.col("symbol")))).alias("live"))
    live = live.where("size(live) > 1").join(docs.drop("symbols"), ["doc", "kind"])
    inverse = F.array(*(F.lit(pow(d, -1, PRIME)) for d in range(1, LENGTH)))
    lines = live.withColumn("line", F.explode(F.expr("""
        flatten(transform(live, (x, i) -> transform(slice(live, i + 2, size(live)), y -> struct(x, y))))"""))).select(
        "doc", "field", "kind", "s1", "s2", "live", F.col("line.x").alias("x"), F.col("line.y").alias("y"))
    i, j = F.expr("x div 4294967296"), F.expr("y div 4294967296")
    rise = F.expr("y % 4294967296") - F.expr("x % 4294967296")
    lines = lines.withColumn("i", i).withColumn("rise", F.pmod(rise, F.lit(PRIME))).withColumn("inv", F.element_at(inverse, (j - i).cast("int")))
    lines = lines.withColumn("slope", F.pmod(F.expr("rise * inv"), F.lit(PRIME))).withColumn("base", F.pmod(F.expr("x % 4294967296 - slope * i"), F.lit(PRIME)))
    lines = lines.select("doc", "field", "kind", "s1", "s2", "live", "x", "y", "slope", "base")
    anchor = ["field", "kind", "slope", "base"]
    # anchors with one fingerprint are done; hot ones are dealt into blocks, each compared with the whole anchor
    size = lines.groupBy(*anchor).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    lines = cut(lines.join(size, anchor), "p7-anchors")
    a = lines.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).alias("a")
    b = lines.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("b")
    met = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*anchor, "block"]] + [F.col("a.doc") < F.col("b.doc")])
    met = met.where(F.expr(f"bit_count(a.s1 ^ b.s1) + bit_count(a.s2 ^ b.s2) <= {X.SIGNATURE_BITS - AGREE}"))
    common = F.expr("slice(array_intersect(a.live, b.live), 1, 2)")
    met = met.where((F.size(common) < 2) | (common == F.array("a.x", "a.y")))
    return met.select(F.col("a.field").alias("field"), F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b")).distinct()


def like_pairs(records: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The members (key, field, doc) of records and the pairs (doc_a, doc_b, field, likeness) of different texts.

    A doc is a distinct text; its members are the keys that have it. Each pair
    of docs at least as like as threshold comes once, however many members the two have.
    """
    prints = cut(fingerprints(records), "p7-prints")
    pairs = cut(candidates(prints), "p7-candidates")
    needed = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
    texts = records.where(X.has_token(F.col("text"))).select(X.text_digest(F.col("field").cast("string"), F.col("text")).alias("doc"), "text")
    texts = cut(texts.join(needed, "doc", "left_semi").dropDuplicates(["doc"]), "p7-texts")
    both = pairs.join(texts.withColumnsRenamed({"doc": "doc_a", "text": "text_a"}), "doc_a").join(texts.withColumnsRenamed({"doc": "doc_b", "text": "text_b"}), "doc_b")
    alike = cut(X.with_likeness(both, "text_a", "text_b").where(F.col("likeness") >= threshold), "p7-alike")
    return prints.select("key", "field", "doc").distinct(), alike


def member_pairs(members: DataFrame, alike: DataFrame) -> DataFrame:
    """(field, key_a, key_b) for all members of like or equal texts with different keys, the smaller key first."""
    one, other = members.select(F.col("doc").alias("doc_a"), F.col("key").alias("k"), "field"), members.select(F.col("doc").alias("doc_b"), F.col("key").alias("l"))
    same = blocked_join(one, other.withColumnRenamed("doc_b", "doc_a"), ["doc_a"]).where("k < l")
    cross = blocked_join(other, blocked_join(one, alike.select("doc_a", "doc_b"), ["doc_a"]), ["doc_b"]).where("k <> l")
    found = same.select("field", "k", "l").union(cross.select("field", "k", "l"))
    return found.select("field", F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b")).distinct()


def groups(members: DataFrame, alike: DataFrame) -> DataFrame:
    """One row per record: (field, key, group_key, links, copies).

    group_key is the least key of all records tied to it over like or equal
    texts; links counts the other texts it is like, copies the records with
    its own text. Records without a like or equal text are their own group.
    """
    size = members.groupBy("field", "doc").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    links = alike.select("doc_a", "doc_b").union(alike.select("doc_b", "doc_a")).groupBy(F.col("doc_a").alias("doc")).agg(F.count("*").alias("links"))
    tied = components(alike, "doc_a", "doc_b", "p7-groups").withColumnRenamed("node", "doc")
    docs = size.join(tied, "doc", "left").join(links, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    first = docs.groupBy("component").agg(F.min("least").alias("group_key"))
    docs = docs.join(first, "component").select("doc", "group_key", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    return members.join(docs, "doc").select("field", "key", "group_key", "links", "copies")


def function_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, field, text) of code_pairs.code and checkpoints.agc_code."""
    pairs = table(spark, sf_dir, "code_pairs").select(F.col("idx").alias("key"), F.lit("code").alias("field"), F.col("code").alias("text"))
    made = table(spark, sf_dir, "checkpoints").select(F.concat_ws("_", F.when(F.col("tag").isNotNull(), F.col("line_no").cast("string")), "tag").alias("key"), F.lit("agc_code").alias("field"), F.col("agc_code").alias("text"))
    return spread(pairs).unionByName(spread(made.where(F.col("key") != "")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_pairs(*like_pairs(function_records(spark, sf_dir)))


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of like but different texts by their representatives, the least keys that have them; p7_groups has the membership."""
    members, alike = like_pairs(function_records(spark, sf_dir))
    least = members.groupBy("doc").agg(F.min("key").alias("key"))
    found = alike.join(least.withColumnsRenamed({"doc": "doc_a", "key": "k"}), "doc_a").join(least.withColumnsRenamed({"doc": "doc_b", "key": "l"}), "doc_b")
    return found.select("field", F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b"), F.round("likeness", 6).alias("likeness"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(*like_pairs(function_records(spark, sf_dir)))
