"""Problem 1: same or near-same records across splits, by content-defined chunks.

A record's tokens (words and single signs, so blanks and line ends don't
count) are cut where a rolling hash of the last three tokens hits a fixed
pattern, about every MEAN_CHUNK tokens. Chunks have 64-bit digests, which are
joined across splits; the token lengths of the chunks a pair shares, summed,
are its overlap fractions.

In a short text an edit or two can hit every chunk, so texts of up to LONG
distinct runs of three tokens are cut at every token: each run is a chunk of
its own. Two texts of likeness t share a run among all but the ceil(t n) - 1
commonest of the n runs of either, so with those left out of the join, in one
global order, no such pair is lost. Texts of more than SHORT runs have the longer
chunks, of which the commonest, up to DROP of the length, are left out; a pair
is lost there only if its edits leave no more than DROP of it in whole chunks
(tests hold this against all pairs). A text between has both kinds, and likes
always have one in common.

Pairs that share a chunk are compared by the number of their runs and by
signatures (AGREE) before their texts are fetched. Signatures of two texts
differ in no more bits than the texts have different runs, so this loses none
of up to 130 runs, and beyond them is over five standard deviations from the mean.

Null code, null idx and null split are no record. Rows delivered twice count
once; an idx with any row in train is in train. A text without three tokens
has likeness 0 to every other text; equal texts are like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.llm import _text as X
from provenir.runtime import blocked_join, cut, spread, table

#: Mean length of a chunk and length of the rolling window, in tokens.
MEAN_CHUNK, WINDOW = 6, 3
#: Least likeness of a pair, on runs of three tokens.
THRESHOLD = 0.7
#: Texts with more distinct runs than SHORT have chunks, those with up to LONG all their runs. LONG is SHORT over THRESHOLD.
SHORT, LONG = 120, 172
#: Share of a text with chunks whose commonest chunks are left out of the join.
DROP = 0.1
#: Least number of equal signature bits of 128. At likeness 0.7 the mean is 109 with a standard deviation of 4.0.
AGREE = 88

_CHUNKED = "doc binary, runs int, s1 bigint, s2 bigint, short_digests array<bigint>, digests array<bigint>, lengths array<int>, whole int"


def chunk_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and of all chunks in turn: number of the text, digest and length."""
    hashes, offsets = X.token_hashes(texts)
    return np.diff(offsets), *_cut_up(hashes, offsets)


def _cut_up(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = len(hashes)
    if total == 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rolling = np.zeros(total, np.uint64)
    for k in range(WINDOW):
        shifted = np.zeros(total, np.uint64)
        shifted[k:] = hashes[: total - k]
        if k:
            shifted[k:][text_of[k:] != text_of[:-k]] = 0
        rolling = rolling * X.MIX + shifted
    rolling = (rolling ^ (rolling >> np.uint64(29))) * X.MIX2
    last = (rolling >> np.uint64(33)) % np.uint64(MEAN_CHUNK) == 0
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(total) - np.repeat(starts, ends - starts)
    spice = (place.astype(np.uint64) + np.uint64(1)) * X.MIX
    mixed = (hashes ^ spice) * X.MIX2
    digests = np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * X.MIX, starts)
    return text_of[starts], digests.view(np.int64), ends - starts


def _distinct(text_of: np.ndarray, values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in order, with the sums of their weights."""
    order = np.lexsort((values, text_of))
    text_of, values, weights = text_of[order], values[order], weights[order]
    if not len(values):
        return text_of, values, weights
    at = np.flatnonzero(np.concatenate([[True], (text_of[1:] != text_of[:-1]) | (values[1:] != values[:-1])]))
    return text_of[at], values[at], np.add.reduceat(weights, at)


def _lists(text_of: np.ndarray, values: np.ndarray, texts: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(texts + 1)), pa.int32()), pa.array(values, kind))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, "text"):
        hashes, offsets = X.token_hashes(batch.column("text").to_pylist())
        n = len(offsets) - 1
        values, at = X.runs(hashes, offsets, 3)
        signs = X.signatures(values, at)
        run_of, run, _ = _distinct(np.repeat(np.arange(n), np.diff(at)), values.view(np.int64), np.ones(len(values), np.int64))
        runs = np.bincount(run_of, minlength=n)
        keep = runs[run_of] <= LONG
        run_of, run = run_of[keep], run[keep]
        text_of, digests, lengths = _distinct(*_cut_up(hashes, offsets))
        keep = runs[text_of] > SHORT
        text_of, digests, lengths = text_of[keep], digests[keep], lengths[keep]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(runs, pa.int32()), pa.array(signs[:, 0]), pa.array(signs[:, 1]), _lists(run_of, run, n, pa.int64()), _lists(text_of, digests, n, pa.int64()), _lists(text_of, lengths, n, pa.int32()), pa.array(np.diff(offsets), pa.int32())],
            ["doc", "runs", "s1", "s2", "short_digests", "digests", "lengths", "whole"],
        )


def _chunk_map(text: str) -> tuple[int, dict[int, int]]:
    tokens, _, digests, lengths = chunk_batch([text])
    mine: dict[int, int] = {}
    for d, n in zip(digests.tolist(), lengths.tolist()):
        mine[d] = mine.get(d, 0) + n
    return max(1, int(tokens[0])), mine


def _shares(a: tuple[int, dict[int, int]], b: tuple[int, dict[int, int]]) -> tuple[float, float]:
    shared = sum(min(n, b[1][d]) for d, n in a[1].items() if d in b[1])
    return shared / a[0], shared / b[0]


def overlap(a: str, b: str) -> tuple[float, float]:
    """The share of a, and the share of b, that lies in chunks of the other."""
    return _shares(_chunk_map(a), _chunk_map(b))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = X.Kept(lambda text: (X.run_hashes(text), _chunk_map(text)))
    for batch in X.slices(batches, "text_train", "text_held"):
        both, like = [], []
        for x, y in zip(batch.column("text_train").to_pylist(), batch.column("text_held").to_pylist()):
            a, b = kept[x], kept[y]
            like.append(X.shared_share(a[0], b[0]))
            both.append(_shares(a[1], b[1]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("train"), batch.column("held"), pa.array([x for x, _ in both], pa.float64()), pa.array([y for _, y in both], pa.float64()), pa.array(like, pa.float64())],
            ["train", "held", "train_overlap", "held_overlap", "likeness"],
        )


def overlapping(records: DataFrame, train: str = "train", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (idx, doc, in_train) and pairs of different texts, one in a train and one in a held-out record.

    records has idx, code and split. A pair has train and held (the texts'
    digests), train_overlap and held_overlap (shares of each text in shared
    chunks) and likeness, which is at least threshold (no lower than THRESHOLD).
    """
    rows = records.where(F.col("idx").isNotNull() & F.col("split").isNotNull() & X.has_token(F.col("code")))
    rows = rows.select("idx", F.col("code").alias("text"), X.text_digest(F.col("code")).alias("doc"), (F.lower(F.trim("split")) == train).alias("in_train"))
    members = rows.groupBy("idx", "doc").agg(F.max("in_train").alias("row_train"))
    members = cut(members.select("idx", "doc", F.max("row_train").over(Window.partitionBy("idx")).alias("in_train")), "p1-members")
    sides = members.groupBy("doc").agg(F.max("in_train").alias("train"), F.max(~F.col("in_train")).alias("held"))
    docs = cut(rows.select("doc", "text").mapInArrow(_chunks, _CHUNKED).dropDuplicates(["doc"]).join(sides, "doc"), "p1-chunks")

    # 8 bytes stand for a text in the index; texts that should share them are told apart when they are measured
    short = F.xxhash64("doc").alias("id")
    every_run = F.transform("short_digests", lambda x: F.struct(x.bitwiseXOR(F.lit(0x5DEECE66D)).alias("digest"), F.lit(1).alias("length")))
    long_chunks = F.zip_with("digests", "lengths", lambda d, n: F.struct(d.alias("digest"), n.alias("length")))
    left_out = [F.ceil(F.lit(THRESHOLD) * F.col("runs") - F.lit(1e-9)) - 1, F.lit(DROP) * F.col("whole")]
    chunks = None
    for kind, (lists, drop) in enumerate(zip((every_run, long_chunks), left_out)):
        part = docs.select(short, "train", "held", F.lit(kind).alias("kind"), drop.cast("int").alias("drop"), F.inline(lists))
        chunks = part if chunks is None else chunks.union(part)
    df = chunks.groupBy("digest").agg(F.count_if("train").alias("t"), F.count_if("held").alias("h"), F.count("*").alias("df")).where("t > 0 and h > 0 and df > 1")
    shared = chunks.select("id", "kind", "drop", "digest", "length").join(df, "digest")
    before = Window.partitionBy("id", "kind").orderBy(F.desc("df"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    kept = shared.withColumn("so_far", F.sum("length").over(before)).where("so_far > drop").select("id", "digest", "t", "h")
    # a hot digest's train texts are dealt into blocks, to each of which its held-out texts are copied
    kept = cut(kept.withColumn("blocks", F.ceil(F.col("t") * F.col("h") / F.lit(1_000_000)).cast("int")).join(docs.select(short, "train", "held", "runs", "s1", "s2"), "id"), "p1-kept")
    names = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("id", "runs", "s1", "s2")]
    t = kept.where("train").select("digest", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), *names("a"))
    h = kept.where("held").select("digest", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *names("b"))
    near = f"id_a <> id_b and runs_a >= {THRESHOLD} * runs_b - 1e-9 and runs_b >= {THRESHOLD} * runs_a - 1e-9 and bit_count(s1_a ^ s1_b) + bit_count(s2_a ^ s2_b) <= {X.SIGNATURE_BITS - AGREE}"
    pairs = cut(t.join(h, ["digest", "block"]).where(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "p1-pairs")

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut(rows.select(short, "doc", "text").join(needed, "id", "left_semi").dropDuplicates(["doc"]), "p1-texts")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "doc": "train", "text": "text_train"}), "a").join(texts.withColumnsRenamed({"id": "b", "doc": "held", "text": "text_held"}), "b").drop("a", "b")
    found = both.mapInArrow(_measure, "train binary, held binary, train_overlap double, held_overlap double, likeness double")
    return members, cut(found.where(F.col("likeness") >= max(threshold, THRESHOLD)), "p1-found")


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(train_idx, held_idx, train_overlap, held_overlap, likeness) of the records that have like or equal texts."""
    t = members.where("in_train").select(F.col("doc").alias("train"), F.col("idx").alias("train_idx"))
    h = members.where("not in_train").select(F.col("doc").alias("held"), F.col("idx").alias("held_idx"))
    near = blocked_join(h, blocked_join(t, pairs, ["train"]), ["held"])
    equal = blocked_join(t, h.withColumnRenamed("held", "train"), ["train"]).select(F.lit(1.0).alias("train_overlap"), F.lit(1.0).alias("held_overlap"), F.lit(1.0).alias("likeness"), "train_idx", "held_idx")
    columns = ["train_idx", "held_idx", "train_overlap", "held_overlap", "likeness"]
    return near.select(columns).union(equal.select(columns)).where("train_idx <> held_idx").groupBy("train_idx", "held_idx").agg(*(F.max(c).alias(c) for c in columns[2:]))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "code_pairs").select("idx", "code", "split"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = record_pairs(*overlapping(_records(spark, sf_dir)))
    return pairs.select(F.least("train_idx", "held_idx").alias("idx_a"), F.greatest("train_idx", "held_idx").alias("idx_b")).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out split and model: records, those found in train, and the mean of their greatest overlaps.

    Model names are matched with those of combined_block_metrics by the letters
    and digits before the run's size; names that match none are kept as they are spelled.
    """
    pairs = record_pairs(*overlapping(_records(spark, sf_dir)))
    worst = pairs.groupBy(F.col("held_idx").alias("idx")).agg(F.max("held_overlap").alias("overlap"), F.count("*").alias("partners"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"_\d+_.*$", ""), "[^a-z0-9]", "")
    names = table(spark, sf_dir, "combined_block_metrics").select(F.col("model").alias("known"), plain(F.col("model")).alias("plain")).where("plain is not null").groupBy("plain").agg(F.min("known").alias("known"))
    rows = table(spark, sf_dir, "code_pairs").where("idx is not null and code is not null and split is not null")
    rows = rows.groupBy("idx").agg(F.min(F.lower(F.trim("split"))).alias("split"), F.max(F.lower(F.trim("split")) == "train").alias("in_train"), F.min("model").alias("model")).where("not in_train")
    rows = rows.withColumn("plain", plain(F.col("model"))).join(names, "plain", "left").join(worst, "idx", "left")
    return rows.groupBy("split", F.coalesce("known", "model").alias("model")).agg(
        F.count("*").alias("records"), F.count("overlap").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.round(F.avg("overlap"), 4).alias("mean_overlap"))
