"""Problem 9: mixing sources to target weights, by cube-method balanced sampling.

Each source has a share of all tokens it should give. The total is the largest
that all sources can give their share of without a document being used more
than max_repeats times, or a smaller one where asked for. Each document of a
source is used as often as the whole part of the source's rate says; the rest
of the rate is its inclusion probability for one use more. The flight phase
moves the probabilities through the null space of the balancing constraints
(tokens and documents), in cells of about CELL documents at a time, until in
each cell at most two documents are open; the open ones are dealt into cells
again, round after round, until a source has one cell. The landing there
takes the rounding nearest to the tokens wanted, so a source misses its tokens
by less than its largest document. The coins of the flight are hashes of the
seed and the documents' ids: a run repeats exactly, and over seeds a
document's probability is kept.

Documents with null doc_id or source, without tokens, or of a source without
target are not used; a null or negative share or repeat limit counts as 0.
Shares are taken relative to their sum. Rows delivered twice count once.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.runtime import cut, spread, table

#: Where the public tokenizer's ranks are; read on the driver and broadcast (50,256 entries, about 1 MB).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the tokenizer's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents a cell of the flight phase is meant to hold.
CELL = 4000
_EPS = 1e-9

_encoders: dict[str, object] = {}


def _encoder(ranks: dict[bytes, int]) -> object:
    import tiktoken

    if "own" not in _encoders:
        _encoders["own"] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders["own"]


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source and tokens of the documents (doc_id, source, text); the text is not kept."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    bundle = documents.sparkSession.sparkContext.broadcast(ranks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(bundle.value)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    kept = documents.where("doc_id is not null and source is not null and text is not null").select("doc_id", "source", "text")
    return spread(kept).mapInArrow(work, "doc_id bigint, source string, tokens bigint")


def flight(tokens: np.ndarray, chance: np.ndarray, names: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """The chances after the flight phase: all 0 or 1 but for two at most, tokens and documents kept in sum.

    names are the documents' ids, from which with seed the coins are made; their numbers by default.
    """
    chance = chance.astype(float).copy()
    marks = (np.arange(len(chance)) if names is None else names).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (marks + np.uint64(seed % 2**32 + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    coins = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2**53
    load = (tokens / max(1.0, float(np.mean(tokens)) if len(tokens) else 1.0)).tolist()
    waiting = [k for k in np.flatnonzero((chance > _EPS) & (chance < 1 - _EPS)).tolist()[::-1]]
    p, coin = chance.tolist(), coins.tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            return np.array(p)
        a, b, c = active
        # orthogonal to (1, 1, 1) and to the loads: keeps the documents and the tokens
        u = (load[b] - load[c], load[c] - load[a], load[a] - load[b])
        if max(map(abs, u)) < _EPS:
            u = (1.0, -1.0, 0.0)
        up = down = math.inf
        for k, x in zip(active, u):
            if x > _EPS:
                up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
            elif x < -_EPS:
                up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
        # the martingale step of the cube; the newest document's coin decides
        step = up if coin[c] < down / (up + down) else -down
        for k, x in zip(active, u):
            v = p[k] + step * x
            p[k] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        active = [k for k in active if 0.0 < p[k] < 1.0]


def landing(tokens: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The rounding of the open chances (a few) that keeps the tokens best, then the documents."""
    chance = chance.copy()
    at = np.flatnonzero((chance > 0) & (chance < 1))
    if len(at):
        want, docs = float((tokens[at] * chance[at]).sum()), float(chance[at].sum())
        best = min(product((0.0, 1.0), repeat=len(at)), key=lambda x: (abs(float(np.dot(x, tokens[at])) - want), abs(sum(x) - docs)))
        chance[at] = best
    return chance


def balanced_choice(units: DataFrame, seed: int = 0) -> DataFrame:
    """source, doc_id, tokens and chosen (0 or 1) from units (source, doc_id, tokens, chance)."""
    schema = "source string, doc_id bigint, tokens bigint, chance double"

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        after = flight(part["tokens"].to_numpy(float), part["chance"].to_numpy(float), part["doc_id"].to_numpy(), seed)
        return part.assign(chance=after)[["source", "doc_id", "tokens", "chance"]]

    def last_cell(part: pd.DataFrame) -> pd.DataFrame:
        flown = cell(part)
        return flown.assign(chance=landing(flown["tokens"].to_numpy(float), flown["chance"].to_numpy(float)))

    done: list[DataFrame] = []
    turn = 0
    while True:
        counts = {r["source"]: r["n"] for r in units.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not counts:
            break
        last = all(n <= CELL for n in counts.values())
        sizes = {s: math.ceil(n / CELL) for s, n in counts.items()}
        cells = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, n)])
        dealt = units.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.element_at(cells, F.col("source"))))
        # a number of partitions is asked for, as few bytes would otherwise bring all cells into one task
        parts = min(sum(sizes.values()), 4 * units.sparkSession.sparkContext.defaultParallelism)
        moved = dealt.repartition(parts, "source", "cell").groupBy("source", "cell").applyInPandas(last_cell if last else cell, schema)
        if last:
            done.append(moved)
            break
        moved = cut(moved, "p9-flight")
        done.append(moved.where("chance = 0 or chance = 1"))
        units = moved.where("chance > 0 and chance < 1")
        turn += 1
    out = done[0] if done else units
    for d in done[1:]:
        out = out.union(d)
    return out.select("source", "doc_id", "tokens", F.col("chance").cast("int").alias("chosen"))


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, path: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """doc_id, source, tokens and repeats of every document used at least once.

    targets has source, target_share and max_repeats, a few rows that fit the driver.
    """
    wanted = {r["source"]: (max(0.0, r["target_share"] or 0.0), max(0, r["max_repeats"] or 0)) for r in targets.collect() if r["source"] is not None}
    whole = sum(s for s, _ in wanted.values())
    sized = cut(token_counts(documents.where(F.col("source").isin(list(wanted))), path).where("tokens > 0").dropDuplicates(["doc_id"]), "p9-tokens")
    there = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = {s: share / whole for s, (share, _) in wanted.items() if share > 0} if whole else {}
    most = min((wanted[s][1] * there.get(s, 0) / share for s, share in shares.items()), default=0.0)
    goal = min(most, total) if total is not None else most
    rates = {s: goal * share / there[s] for s, share in shares.items() if there.get(s)}
    if not rates or not goal:
        return sized.select("doc_id", "source", "tokens", F.lit(0).alias("repeats")).where("false")
    rate = F.element_at(F.create_map(*[F.lit(x) for s, r in rates.items() for x in (s, float(r))]), F.col("source"))
    units = sized.where(F.col("source").isin(list(rates))).withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + _EPS).cast("int"))
    units = units.withColumn("chance", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    chosen = balanced_choice(units.where(F.col("chance") > _EPS).select("source", "doc_id", "tokens", "chance"), seed)
    used = units.join(chosen.select("doc_id", "chosen"), "doc_id", "left").select("doc_id", "source", "tokens", (F.col("base") + F.coalesce("chosen", F.lit(0))).alias("repeats"))
    return used.where("repeats > 0")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target: documents and tokens used, the share reached, the target and the most uses of a document."""
    used = cut(_mixed(spark, sf_dir), "p9-used")
    by_source = used.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = by_source.agg(F.sum("tokens")).first()[0] or 0
    targets = table(spark, sf_dir, "mix_targets").where("source is not null").select("source", "target_share", "max_repeats")
    return targets.join(by_source, "source", "left").select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.lit(float(whole) or 1.0)).alias("share"), "target_share", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target: whether its share is met to 0.1 % and its largest document, no document is used too often, none comes twice and all are of the source."""
    used = cut(_mixed(spark, sf_dir), "p9-checked")
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own")).dropDuplicates(["doc_id"])
    by_source = used.join(own, "doc_id").groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"), F.max("repeats").alias("most"), F.max("tokens").alias("largest"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("own") != F.col("source")).alias("foreign"))
    whole = by_source.agg(F.sum("given").alias("whole"))
    targets = table(spark, sf_dir, "mix_targets").where("source is not null").crossJoin(table(spark, sf_dir, "mix_targets").agg(F.sum("target_share").alias("shares")))
    met = F.abs(F.col("given") - F.col("target_share") / F.col("shares") * F.col("whole")) <= 0.001 * F.col("whole") + F.col("largest")
    return targets.join(by_source, "source", "left").crossJoin(whole).select("source", met.cast("int").alias("share_met"), (F.col("most") <= F.col("max_repeats")).cast("int").alias("repeats_kept"), ((F.col("rows") == F.col("ids")) & (F.col("foreign") == 0)).cast("int").alias("ids_kept"))
