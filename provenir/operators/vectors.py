"""Skip-gram vectors of words with negative samples, trained in parts whose changes are averaged after each pass."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.runtime import cut, scratch

#: Words to either side at most, negative samples a pair, first and last rate, power of the noise: the reference's defaults.
WINDOW, NEGATIVE, RATE, LEAST_RATE, POWER = 5, 5, 0.025, 0.0001, 0.75
#: Positions whose products are one matrix, noise words drawn for them, such blocks a step, words added by a product, words of a slice of the vocabulary.
BLOCK, NOISE, BLOCKS, COMMON, SLICE = 16, 8, 64, 8, 4096
#: The most that a number may change in a step, else words that repeat would overshoot; good steps until a longer one is tried.
MOST, GOOD = 2.0, 16


def words_of(texts: pa.Array) -> pa.ListArray:
    """The texts at their runs of other signs than letters, digits and underscores."""
    return pc.split_pattern_regex(texts, r"\W+")


def _first(seed: int, size: int, at: int, rows: int) -> np.ndarray:
    """The untrained rows of a slice: input vectors at random, output vectors 0."""
    rng = np.random.default_rng([seed, at])
    return np.hstack([(rng.random((rows, size), dtype="f4") - 0.5) / size, np.zeros((rows, size), "f4")])


def _add(target: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """target[ids] += rows, where ids may repeat: the commonest words by a product, then the first row of each other word, the second and so on."""
    common = np.flatnonzero(ids < COMMON)
    if len(common):
        one = np.zeros((min(COMMON, len(target)), len(common)), "f4")
        one[ids[common], np.arange(len(common))] = 1
        target[:COMMON] += one @ rows.take(common, 0)
    order = np.flatnonzero(ids >= COMMON)
    order = order[np.argsort(ids[order], kind="stable")]
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else order
    left = np.diff(starts, append=len(ids))
    while len(starts):
        target[ids[starts]] += rows.take(order[starts], 0)
        more = left > 1
        starts, left = starts[more] + 1, left[more] - 1


class Trainer:
    """One part's vectors in training: a word's input vector and after it its output vector."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, seed: list[int]) -> None:
        self.vectors, self.size, self.rng = vectors, vectors.shape[1] // 2, np.random.default_rng(seed)
        noise = counts.astype("f8") ** POWER
        self.noise, self.blocks, self.good = np.cumsum(noise / noise.sum()), BLOCKS, 0
        offset = np.arange(BLOCK + 2 * WINDOW)[None, :] - WINDOW - np.arange(BLOCK)[:, None]
        self.far = np.where(offset == 0, 99, abs(offset)).astype("i1")

    def sentences(self, ids: np.ndarray, lengths: np.ndarray, rate: float) -> None:
        """Train on sentences laid end to end; windows don't reach over their ends."""
        n = -(-len(ids) // BLOCK)
        words, owner = np.zeros(n * BLOCK + 2 * WINDOW, "i4"), np.full(n * BLOCK + 2 * WINDOW, -1, "i4")
        words[WINDOW : WINDOW + len(ids)] = ids
        owner[WINDOW : WINDOW + len(ids)] = np.repeat(np.arange(len(lengths), dtype="i4"), lengths)
        noise = np.searchsorted(self.noise, self.rng.random((n, NOISE))).astype("i4")
        np.minimum(noise, len(self.noise) - 1, out=noise)
        reach = self.rng.integers(1, WINDOW + 1, (n, BLOCK, 1), dtype="i1")
        s = 0
        while s < n:
            e = min(s + self.blocks, n)
            here = slice(s * BLOCK, e * BLOCK + 2 * WINDOW)
            if self._step(args := (words[here], owner[here], noise[s:e].ravel(), reach[s:e]), rate):
                self.good += 1
                if self.good == GOOD:
                    self.blocks, self.good = min(2 * self.blocks, BLOCKS), 0
            elif e - s > 1:
                self.blocks, self.good = (e - s) // 2, 0
                continue
            else:
                self._halved(args, rate)
            s = e

    def _halved(self, args: tuple[np.ndarray, ...], rate: float) -> None:
        """A step in two of half the rate, and those again where need be."""
        for _ in range(2):
            if not self._step(args, rate / 2):
                self._halved(args, rate / 2)

    def _step(self, args: tuple[np.ndarray, ...], rate: float) -> bool:
        """Rows of a block are its positions as input words; columns the positions around as output words, then the noise. Nothing changes where a number would change too much."""
        words, owner, noise, reach = args
        n, width = len(words) - 2 * WINDOW, BLOCK + 2 * WINDOW
        m, size, view = n // BLOCK, self.size, np.lib.stride_tricks.as_strided
        held = self.vectors.take(words, 0)
        x = held[WINDOW:-WINDOW, :size].reshape(m, BLOCK, size)
        c = view(held[:, size:], (m, width, size), (BLOCK * held.strides[0], *held.strides))
        drawn = self.vectors[:, size:][noise].reshape(m, NOISE, size)
        owners = view(owner, (m, 1, width), (BLOCK * owner.strides[0], 0, owner.strides[0]))
        own = owner[WINDOW:-WINDOW].reshape(m, BLOCK, 1)
        pairs = (self.far <= reach) & (owners == own) & (own >= 0)
        near = self._likely(x @ c.transpose(0, 2, 1))
        np.subtract(1, near, out=near)
        near *= np.float32(rate)
        near *= pairs
        other = self._likely(x @ drawn.transpose(0, 2, 1))
        other *= np.float32(-rate * NEGATIVE / NOISE) * pairs.sum(2, keepdims=True, dtype="f4")
        change = np.zeros_like(held)
        dx = near @ c
        dx += other @ drawn
        change[WINDOW:-WINDOW, :size] = dx.reshape(n, size)
        dc = near.transpose(0, 2, 1) @ x
        change[:n, size:].reshape(m, BLOCK, size)[:] = dc[:, :BLOCK]
        view(change[BLOCK:, size:], (m - 1, 2 * WINDOW, size), (BLOCK * change.strides[0], *change.strides))[:] += dc[:-1, BLOCK:]
        change[n:, size:] += dc[-1, BLOCK:]
        _add(self.vectors, words, change)
        _add(self.vectors[:, size:], noise, (other.transpose(0, 2, 1) @ x).reshape(-1, size))
        if abs(self.vectors.take(words, 0) - held).max() <= MOST and abs(self.vectors[:, size:][noise] - drawn.reshape(-1, size)).max() <= MOST:
            return True
        self.vectors[noise, size:] = drawn.reshape(-1, size)
        self.vectors[words] = held
        return False

    @staticmethod
    def _likely(dots: np.ndarray) -> np.ndarray:
        """The logistic function, in place."""
        np.clip(dots, -30, 30, out=dots)
        np.negative(dots, out=dots)
        np.exp(dots, out=dots)
        dots += 1
        return np.reciprocal(dots, out=dots)


class Store:
    """The files of a training in a folder that all executors share. Every file is written under a name of its own and moved, so attempts don't meet."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.folder if ":/" in self.folder else f"file://{self.folder}")
        return system, f"{path}/{name}"

    def write(self, name: str, parts: Iterator[object]) -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0])
        with system.open_output_stream(taken := f"{path}.{uuid.uuid4().hex}") as out:
            for part in parts:
                out.write(part)
        system.move(taken, path)

    def read(self, name: str, start: int = 0, size: int | None = None) -> bytes:
        system, path = self._at(name)
        with system.open_input_file(path) as f:
            f.seek(start)
            return f.read(size)

    def write_table(self, name: str, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0])
        with system.open_output_stream(taken := f"{path}.{uuid.uuid4().hex}") as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for batch in batches:
                writer.write_batch(batch)
        system.move(taken, path)

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        system, path = self._at(name)
        if self.has(name):
            with system.open_input_stream(path) as f, pa.ipc.open_stream(f) as reader:
                yield from reader

    def has(self, name: str) -> bool:
        system, path = self._at(name)
        return system.get_file_info(path).type != fs.FileType.NotFound

    def drop(self, name: str) -> None:
        system, path = self._at(name)
        kind = system.get_file_info(path).type
        if kind == fs.FileType.Directory:
            system.delete_dir(path)
        elif kind == fs.FileType.File:
            system.delete_file(path)


def skip_gram(texts: DataFrame, key: str, text: str, size: int, least: int, passes: int, parts: int, seed: int) -> DataFrame:
    """word and vector of every word that stands in the texts at least that often; key is unique.

    As word2vec with negative samples: each position is paired with those up to a random reach
    beside it, each pair weighs as much as its negative samples, and the rate falls evenly over all
    passes. The noise words of a block of positions are drawn together and weigh what a draw for
    each pair would. Every part of the texts trains a copy of the vectors; after each pass a word
    gets the mean change of the parts it stands in, which are written as halves of floats.
    """
    spark = texts.sparkSession
    texts = cut(texts.where(f"`{text}` is not null").select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")), "texts")
    store = Store(scratch(spark, "vectors"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(words_of(batch.column(0)).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    vocabulary = texts.select("text").mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    count, total = len(vocabulary), pc.sum(vocabulary["n"]).as_py()
    if not count:
        return spark.createDataFrame([], "word string, vector array<double>")
    store.write_table("words", vocabulary.schema, iter(vocabulary.to_batches()))
    slices = -(-count // SLICE)
    rows = lambda at: min(SLICE, count - at * SLICE)
    line = pa.schema([("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.Table.from_batches(store.batches("words"))["word"].combine_chunks()
        for batch in batches:
            lists = words_of(batch.column("text"))
            ids = pc.index_in(lists.flatten(), value_set=known)
            kept = np.concatenate(([0], np.cumsum(ids.is_valid().to_numpy(zero_copy_only=False))))
            ends = pa.array(kept[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype("i4"))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("key"), pa.ListArray.from_arrays(ends, ids.drop_null())], ["part", "key", "ids"])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        held = next(batches, None)
        while held is not None:
            part = held.column("part")[0].as_py()

            def own(part: int = part) -> Iterator[pa.RecordBatch]:
                nonlocal held
                while held is not None:
                    n = pc.sum(pc.equal(held.column("part"), part)).as_py()
                    if n:
                        yield pa.RecordBatch.from_arrays([held.column("ids").slice(0, n).cast(line.field(0).type)], schema=line)
                    held = held.slice(n) if n < held.num_rows else next(batches, None)
                    if n == 0:
                        return

            store.write_table(f"texts/{part}", line, own())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    texts.mapInArrow(encoded, "part int, key string, ids array<int>").repartition(parts, "part").sortWithinPartitions("part", "key").mapInArrow(stored, "part int").collect()

    def model(turn: int, at: int) -> np.ndarray:
        return np.frombuffer(store.read(f"model{turn}/{at}"), "f4").reshape(-1, 2 * size) if turn else _first(seed, size, at, rows(at))

    def trained(turn: int, part: int) -> None:
        vectors = np.empty((count, 2 * size), "f4")
        for at in range(slices):
            vectors[at * SLICE : (at + 1) * SLICE] = model(turn, at)
        trainer = Trainer(vectors, pa.Table.from_batches(store.batches("words"))["n"].to_numpy(), [seed, turn, part])
        touched, done = np.zeros(count, bool), 0
        for batch in store.batches(f"texts/{part}"):
            lists = batch.column(0)
            ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            touched[ids] = True
            first = 0
            while first < len(ends) - 1:
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + 20_000)) - 1)
                rate = max(LEAST_RATE, RATE - (RATE - LEAST_RATE) * (turn + min(1, done * parts / total)) / passes)
                trainer.sentences(ids[ends[first] : ends[last]], np.diff(ends[first : last + 1]), rate)
                done += int(ends[last] - ends[first])
                first = last
        changed = np.flatnonzero(touched).astype("i4")

        def pieces() -> Iterator[bytes]:
            yield np.array([len(changed)], "i8").tobytes()
            yield changed.tobytes()
            for at in range(slices):
                here = changed[np.searchsorted(changed, at * SLICE) : np.searchsorted(changed, (at + 1) * SLICE)]
                if len(here):
                    yield (vectors[here] - model(turn, at)[here - at * SLICE]).astype("f2").tobytes()

        store.write(f"parts{turn}/{part}", pieces())

    def merged(turn: int, at: int) -> None:
        """A slice after its pass in place of the one before; an attempt that comes too late finds it there."""
        if store.has(f"model{turn + 1}/{at}"):
            return
        new, times = np.zeros((rows(at), 2 * size), "f4"), np.zeros((rows(at), 1), "f4")
        for part in range(parts):
            n = int(np.frombuffer(store.read(f"parts{turn}/{part}", 0, 8), "i8")[0])
            ids = np.frombuffer(store.read(f"parts{turn}/{part}", 8, 4 * n), "i4")
            a, b = np.searchsorted(ids, [at * SLICE, (at + 1) * SLICE])
            change = np.frombuffer(store.read(f"parts{turn}/{part}", 8 + 4 * n + int(a) * 4 * size, int(b - a) * 4 * size), "f2").reshape(-1, 2 * size)
            new[ids[a:b] - at * SLICE] += change
            times[ids[a:b] - at * SLICE] += 1
        store.write(f"model{turn + 1}/{at}", [(model(turn, at) + new / np.maximum(times, 1)).tobytes()])
        store.drop(f"model{turn}/{at}")

    def each(n: int, tasks: int, work: object) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    work(k)
                yield batch

        spark.range(0, n, 1, tasks).mapInArrow(run, "id long").collect()

    for turn in range(passes):
        each(parts, parts, lambda part, turn=turn: trained(turn, part))
        each(slices, min(slices, 2 * parts), lambda at, turn=turn: merged(turn, at))
        store.drop(f"parts{turn}")
        store.drop(f"model{turn}")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.Table.from_batches(store.batches("words"))["word"].combine_chunks()
        for batch in batches:
            for at in batch.column(0).to_pylist():
                x = np.ascontiguousarray(model(passes, at)[:, :size])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * size), pa.array(x.ravel().astype("f8")))
                yield pa.RecordBatch.from_arrays([known.slice(at * SLICE, SLICE).cast(pa.string()), vectors], ["word", "vector"])

    return spark.range(0, slices, 1, min(slices, 2 * parts)).mapInArrow(named, "word string, vector array<double>")
