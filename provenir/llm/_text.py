"""Batch tokenising, hashing and sketching of texts; all functions work on whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of word characters or one other character that is not blank.
TOKEN = re.compile(r"\w+|[^\w\s]")
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
#: Bits of the likeness signature.
SIGNATURE_BITS = 128
_MEMO_LIMIT = 200_000
#: Bytes of text that are worked on at once, whatever the rows of a batch; a longer text is worked on alone and whole.
SLICE = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, in pieces of up to limit bytes of the named text columns (at least a row each)."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64)
        ends, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


class _Memo(dict):
    """64-bit hash by token; emptied when a task has seen very many different tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > _MEMO_LIMIT:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return value


_memo = _Memo()


def token_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens one after another, and the offsets where each text begins (and the end)."""
    find = TOKEN.findall
    tokens: list[str] = []
    ends = [0]
    for text in texts:
        tokens += find(text)
        ends.append(len(tokens))
    return np.fromiter(map(_memo.__getitem__, tokens), np.uint64, len(tokens)), np.asarray(ends, np.int64)


def runs(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of width tokens inside one text, and the new offsets.

    A text of fewer tokens has no run.
    """
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    if ends[-1] == 0:
        return np.zeros(0, np.uint64), ends
    at = np.repeat(offsets[:-1] - ends[:-1], n) + np.arange(ends[-1])
    value = np.zeros(ends[-1], np.uint64)
    for k in range(width):
        value = (value ^ (value >> np.uint64(31))) * MIX + hashes[at + k]
    value ^= value >> np.uint64(29)
    value *= MIX2
    return value ^ (value >> np.uint64(32)), ends


def minima(values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """The least value of each text; texts without values get empty."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.minimum.reduceat(values, offsets[:-1][filled])
    return out


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two signed 64-bit words a text: the lowest bit of the least hash in each of 128 bins.

    Of two texts with likeness J about (1 + J) / 2 of the bits agree; bins
    that both leave empty agree too, which can only raise the share.
    """
    texts = len(offsets) - 1
    bins = (values >> np.uint64(57)).astype(np.int64)
    cell = np.repeat(np.arange(texts), np.diff(offsets)) * SIGNATURE_BITS + bins
    least = np.full(texts * SIGNATURE_BITS, np.uint64(0xFFFFFFFFFFFFFFFE), np.uint64)
    np.minimum.at(least, cell, values & np.uint64(0x01FFFFFFFFFFFFFF))
    bits = (least & np.uint64(1)).astype(np.uint8).reshape(texts, SIGNATURE_BITS)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(texts, 2)


def likeness(a: str, b: str, width: int = 3) -> float:
    """Shared runs of width tokens over all runs of either text; 0 where neither has a run."""
    x, y = (TOKEN.findall(t) for t in (a, b))
    s = set(zip(*(x[k:] for k in range(width))))
    t = set(zip(*(y[k:] for k in range(width))))
    both = len(s & t)
    return both / (len(s) + len(t) - both) if s or t else 0.0


def run_hashes(text: str, width: int = 3) -> np.ndarray:
    """The distinct runs of width tokens as sorted 64-bit hashes."""
    return np.unique(runs(*token_hashes([text]), width)[0])


def shared_share(s: np.ndarray, t: np.ndarray) -> float:
    """Shared values over all values of two sorted sets; 0 where both are empty."""
    if not len(s) or not len(t):
        return 0.0
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = int((t[at] == s).sum())
    return both / (len(s) + len(t) - both)


class Kept(dict):
    """What make gives for a text, kept for the next pair that has it; emptied when it holds KEPT texts."""

    KEPT = 8192

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str):
        if len(self) >= self.KEPT:
            self.clear()
        value = self[text] = self.make(text)
        return value


def with_likeness(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs without the text columns a and b, with their likeness as the column likeness."""
    keep = [f for f in pairs.schema.fields if f.name not in (a, b)]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "likeness double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(run_hashes)
        for batch in slices(batches, a, b):
            score = [shared_share(kept[x], kept[y]) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            arrays = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score, pa.float64())], [*(f.name for f in keep), "likeness"])

    return pairs.mapInArrow(work, out)


def text_digest(*columns: Column) -> Column:
    """16 bytes that name a text (with further columns): equal exactly for equal input."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *columns)))


def has_token(column: Column) -> Column:
    """Not null and not blank."""
    return column.isNotNull() & column.rlike(r"(?U)[^\s\x1c-\x1f]")
