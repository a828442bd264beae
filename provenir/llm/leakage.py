"""Problem 8: evaluation texts leaking into documents, by an FM-index per training shard.

Texts are read as words (runs of word characters, lower case), so case,
punctuation, spacing and line marks don't count. Each task indexes its
documents in shards of SHARD words, once for all items: suffix array,
Burrows-Wheeler transform in a wavelet matrix over the shard's own vocabulary,
and every SAMPLE-th suffix position. All phrases of PHRASE words of all items
are searched backwards, a block of items at a time, and their occurrences are
located over the sampled positions. Where the phrases of one item stand in one
document on nearly one diagonal and cover enough of it, item and document are
aligned there (a word in common +1, a changed, missing or added word -1). The
best local alignment's score over the item's words is the leak's score; the
aligned stretches are the removal spans.

Runs of words in common are parted by an error at least, so those of one or two
words bring a score of a third of the words they take up. With c words in g runs
of PHRASE = 3 and more, an item of n words scores c - g + 1 + (n - c) / 3 at the
most, and no more than its words that the stretch has at all. Only stretches that
could reach the score asked for by both bounds are aligned, so none is lost; below
a score of 0.5, c must be SEEDED of n too. An item of fewer than PHRASE words has no such phrase; it is searched as the one
phrase it is and leaks where all its words stand in a row, with score 1.

Items are a stated query set; what is sent to the tasks at a time is bounded
by BUNDLE bytes of text, and only beyond that the documents are indexed again.
Null ids, null texts and items without a word are no case. Rows delivered twice
count once; an empty table of either kind has no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenir.runtime import cut, spread, table

#: Words of a shard, distance of sampled suffix positions, words of a phrase, items searched at a time, bytes of items sent at a time.
SHARD, SAMPLE, PHRASE, ITEM_BLOCK, BUNDLE = 500_000, 8, 3, 2000, 64_000_000
#: Share of an item that found phrases must cover on diagonals SLACK words apart, least score of a leak over the item's
#: words, and least score of a part of an item that is taken out of documents and reported.
SEEDED, SLACK, LEAKED, PARTLY = 0.2, 12, 0.5, 0.3

_WORD = re.compile(r"\w+")
_BREAK = 1  # the symbol between documents


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text in order, by prefix doubling in which only undecided suffixes are sorted again."""
    n = len(text)
    base = int(text.max()) + 2
    packed, width = text.astype(np.int64) + 1, 1
    while base ** (2 * width) < 2**62 and width < 4:  # several symbols at once
        key = packed * base**width
        key[: n - width] += packed[width:]
        packed, width = key, 2 * width
    order = np.argsort(packed, kind="stable")
    ordered = packed[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)  # the first place of the suffix's group
    rank[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    while True:
        ends = np.concatenate([starts[1:], [True]])
        places = np.flatnonzero(~(starts & ends))  # groups of more than one
        if not len(places):
            return order
        spots = order[places]
        group = rank[spots]
        follow = np.full(len(spots), -1, np.int64)
        inside = spots + width < n
        follow[inside] = rank[spots[inside] + width]
        again = np.lexsort((follow, group))
        spots, group, follow = spots[again], group[again], follow[again]
        order[places] = spots
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        starts[places] = fresh
        rank[spots] = places[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        width *= 2


class FMIndex:
    """Full-text index of a sequence of symbols from 1 on."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        text = np.concatenate([text.astype(np.int64), [0]])
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.levels = max(1, int(symbols).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.sampled = order % sample == 0
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.spots = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first so many places of the transform."""
        begin, end = np.zeros_like(at), at
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            up = ((symbol >> level) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        return end - begin

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows, for each phrase (a row of symbols), whose suffixes begin with it."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, k]
            low, high = self.first[symbol] + self.rank(symbol, low), self.first[symbol] + self.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        rows, found, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            found[open_[done]] = self.spots[self.before[at[done]]] + steps
            open_ = open_[~done]
            at = rows[open_]
            symbol = self.bwt[at]
            rows[open_] = self.first[symbol] + self.rank(symbol, at)
            steps += 1
        return found


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment and where it begins and ends in words."""
    score, begin, end = align_all([item], [words])
    return int(score[0]), int(begin[0]), int(end[0])


def align_all(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, begin and end of the best local alignment of each item with its window, all pairs at once."""
    pairs, longest, width = len(items), max(map(len, items)), max(map(len, windows))
    rows = np.full((longest, pairs), -1, np.int32)
    cells = np.full((pairs, width), -2, np.int32)
    for k, (x, w) in enumerate(zip(items, windows)):
        rows[: len(x), k] = x
        cells[k, : len(w)] = w
    steps = np.arange(width + 1, dtype=np.int32)
    score, start = np.zeros((pairs, width + 1), np.int32), np.repeat(steps[None, :], pairs, axis=0)
    best, begin, end = (np.zeros(pairs, np.int64) for _ in range(3))
    alive = np.arange(pairs)
    for t in range(longest):
        symbol = rows[t]
        left = np.where(cells == symbol[:, None], 1, -1).astype(np.int32) + score[:, :-1]
        fresh, origin = score - 1, start.copy()
        better = left > fresh[:, 1:]
        fresh[:, 1:] = np.where(better, left, fresh[:, 1:])
        origin[:, 1:] = np.where(better, start[:, :-1], origin[:, 1:])
        reset = fresh <= 0
        fresh[reset] = 0
        origin[reset] = np.broadcast_to(steps, origin.shape)[reset]
        lifted = fresh + steps
        run = np.maximum.accumulate(lifted, axis=1)  # words added in a row
        moved = run > lifted
        if moved.any():
            source = np.maximum.accumulate(np.where(moved, 0, steps), axis=1)
            origin = np.where(moved, np.take_along_axis(origin, source, axis=1), origin)
            fresh = np.where(moved, run - steps, fresh)
        score, start = fresh, origin
        top = score.argmax(axis=1)
        value = score[alive, top]
        up = (value > best) & (symbol >= 0)
        best[up], begin[up], end[up] = value[up], start[alive, top][up], top[up]
    return best, begin, end


class _Items:
    """Items as words, with their phrases."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for i, text in items:
            found = _WORD.findall(text.lower())
            if found:
                self.ids.append(i)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found], np.int64))

    def blocks(self, symbols: np.ndarray) -> Iterator[tuple[list[int], list[np.ndarray]]]:
        """Numbers of the items and their words as the shard's symbols (0 for a word it doesn't have), a block at a time."""
        for b in range(0, len(self.ids), ITEM_BLOCK):
            part = range(b, min(len(self.ids), b + ITEM_BLOCK))
            yield list(part), [symbols[self.words[k]] for k in part]


def _phrases(items: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All phrases (rows of symbols of the shard), their items' numbers in the block and places, by length."""
    lengths = np.array([min(PHRASE, len(w)) for w in items])
    for size in np.unique(lengths):
        mine = np.flatnonzero(lengths == size)
        owner = np.repeat(mine, [len(items[k]) - size + 1 for k in mine])
        place = np.concatenate([np.arange(len(items[k]) - size + 1) for k in mine])
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(items[k], size) for k in mine])
        there = (rows > 0).all(axis=1)
        yield rows[there], owner[there], place[there]


def _seeds(index: FMIndex, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item number, place in the item and place in the shard of all occurrences of all phrases."""
    found = []
    for rows, owner, place in _phrases(items):
        if not len(rows):
            continue
        phrases, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.ravel()
        low, high = index.search(phrases)
        count = high - low
        spots = index.locate(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count))
        begin = np.cumsum(count) - count
        mine = count[which]  # occurrences of each item's phrase
        at = np.repeat(begin[which] - (np.cumsum(mine) - mine), mine) + np.arange(mine.sum())
        found.append((np.repeat(owner, mine), np.repeat(place, mine), spots[at]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _windows(owner: np.ndarray, place: np.ndarray, spot: np.ndarray, doc: np.ndarray, sizes: np.ndarray, score: float) -> list[tuple[int, int, int]]:
    """(item, document, diagonal) of the stretches whose seeds cover enough of the item."""
    order = np.lexsort((spot - place, owner, doc))
    owner, place, spot, doc = owner[order], place[order], spot[order], doc[order]
    pair = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])) if len(owner) else np.zeros(0, np.int64)
    stops = np.append(pair[1:], len(owner))
    size_of = sizes[owner[pair]]
    short = np.where(size_of < PHRASE, 0.0, np.maximum((score - 1 / 3) * 1.5, 0.0 if score >= LEAKED else SEEDED) * size_of)  # least words in runs
    enough = (stops - pair) * PHRASE >= short
    out = []
    for b, e in zip(pair[enough].tolist(), stops[enough].tolist()):
        size = int(sizes[owner[b]])
        phrase = min(PHRASE, size)
        least = 0.0 if size < PHRASE else max((score - 1 / 3) * 1.5, 0.0 if score >= LEAKED else SEEDED) * size
        slant, offset = (spot[b:e] - place[b:e]), place[b:e]
        tails = np.searchsorted(slant, slant - SLACK, side="left")
        last = np.append(tails[1:] != tails[:-1], True)  # the longest group with each beginning
        tried = None
        for head in np.flatnonzero(last).tolist():
            tail = int(tails[head])
            if (head + 1 - tail) * phrase < least:
                continue
            offsets = np.unique(offset[tail : head + 1])
            gaps = np.diff(offsets)
            covered = len(offsets) + int(np.minimum(gaps - 1, phrase - 1).sum()) + phrase - 1
            runs = 1 + int((gaps > phrase).sum())
            if size >= PHRASE and covered - runs + 1 + (size - covered) / 3 < score * size - 1e-9:
                continue
            diagonal = int(slant[(tail + head) // 2])
            if covered >= least and (tried is None or abs(diagonal - tried) > SLACK // 2):
                tried = diagonal
                out.append((int(owner[b]), int(doc[b]), diagonal))
    return out


class _Symbols(dict):
    """The shard's symbols by word; a word that is new gets the next."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self) + _BREAK + 1
        return value


def _shard(items: _Items, docs: list[tuple[int, str]], least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(doc_id, item_id, begin, end, score) of the leaks in a shard; begin and end are places in the text."""
    vocabulary = _Symbols()
    known = items.vocabulary
    words: list[int] = []
    begins = []
    first_of: dict[str, int] = {}  # a text that comes again in the shard is indexed once
    texts: list[str] = []
    holders: list[list[int]] = []
    for d, text in docs:
        k = first_of.setdefault(text, len(texts))
        if k < len(texts):
            holders[k].append(d)
            continue
        texts.append(text)
        holders.append([d])
        begins.append(len(words))
        words += map(vocabulary.__getitem__, _WORD.findall(text.lower()))
        words.append(_BREAK)
    symbols = np.array([vocabulary.get(w, 0) for w in known], np.int64)
    if not symbols.any():
        return
    text, starts = np.array(words, np.int64), np.array(begins, np.int64)
    index = FMIndex(text, len(vocabulary) + _BREAK + 1)
    for numbers, mine in items.blocks(symbols):
        owner, place, spot = _seeds(index, mine)
        doc = np.searchsorted(starts, spot, side="right") - 1
        sizes = np.array([len(w) for w in mine])
        lists = [w.tolist() for w in mine]
        tasks = []
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i, d, diagonal in _windows(owner, place, spot, doc, sizes, least):
            stop = int(starts[d + 1]) - 1 if d + 1 < len(starts) else len(text) - 1
            if sizes[i] < PHRASE:
                best.setdefault((i, d), (1.0, diagonal, diagonal + int(sizes[i])))
                continue
            b, e = max(int(starts[d]), diagonal - 2 * SLACK), min(stop, diagonal + int(sizes[i]) + 2 * SLACK)
            there = set(text[b:e].tolist())
            if sum(w in there for w in lists[i]) >= least * sizes[i]:
                tasks.append((i, d, b, e))
        tasks.sort(key=lambda x: (sizes[x[0]], x[3] - x[2]))
        for k in range(0, len(tasks), 64):  # of nearly one size
            part = tasks[k : k + 64]
            score, begin, end = align_all([mine[i] for i, *_ in part], [text[b:e] for _, _, b, e in part])
            for (i, d, b, _), n, x, y in zip(part, score.tolist(), begin.tolist(), end.tolist()):
                share = n / int(sizes[i])
                if share >= least and share > best.get((i, d), (0.0, 0, 0))[0]:
                    best[i, d] = (share, b + x, b + y)
        for (i, d), (share, x, y) in best.items():
            places = [m.span() for m in _WORD.finditer(texts[d])]
            first, last = x - int(starts[d]), y - int(starts[d]) - 1
            if last < len(places):
                for doc_id in holders[d]:
                    yield doc_id, items.ids[numbers[i]], places[first][0], places[last][1], share


def leaks(documents: DataFrame, items: DataFrame, least: float = LEAKED) -> DataFrame:
    """(doc_id, item_id, begin, end, score) for documents (doc_id, text) and items (item_id, item_text).

    begin and end are places in text, from 0, end not included; scores are at least least, from SEEDED on.
    """
    spark = documents.sparkSession
    kept = items.where("item_id is not null and item_text is not null").select("item_id", "item_text").distinct()
    size = kept.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    bundles = max(1, -(-size // BUNDLE))
    numbered = kept.withColumn("bundle", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(bundles)))
    docs = spread(documents.select("doc_id", "text")).where("doc_id is not null and text is not null")
    out = None
    for number in range(bundles):
        bundle = spark.sparkContext.broadcast(sorted((r["item_id"], r["item_text"]) for r in numbered.where(F.col("bundle") == number).collect()))

        def work(batches: Iterator[pa.RecordBatch], bundle=bundle) -> Iterator[pa.RecordBatch]:
            known = _Items(bundle.value)

            def flush(shard: list[tuple[int, str]]) -> pa.RecordBatch:
                found = list(_shard(known, shard, least)) if known.ids else []
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds)], ["doc_id", "item_id", "begin", "end", "score"])

            shard, size = [], 0
            for batch in batches:
                for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    shard.append((d, t))
                    size += 1 + len(t) // 6
                    if size >= SHARD:
                        yield flush(shard)
                        shard, size = [], 0
            if shard:
                yield flush(shard)

        part = docs.mapInArrow(work, "doc_id bigint, item_id bigint, begin int, end int, score double")
        if bundles > 1:  # done before the next is sent, so one bundle lives at a time
            part = cut(part, "p8-bundle")
            bundle.unpersist()
        out = part if out is None else out.union(part)
    return out


def _leaks(spark: SparkSession, sf_dir: str, least: float = LEAKED) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "heldout_items").select("item_id", "item_text"), least)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the merged stretches to remove, parts of items from PARTLY on, with the number of items each holds wholly or partly."""
    found = _leaks(spark, sf_dir, PARTLY).distinct()
    order = Window.partitionBy("doc_id").orderBy("begin", "end", "item_id")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("opens", (reach.isNull() | (F.col("begin") > reach)).cast("int"))
    marked = marked.withColumn("span", F.sum("opens").over(order))
    return marked.groupBy("doc_id", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count_distinct("item_id").alias("items")).drop("span")


def p8_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item word for word: the leaks of score 1."""
    return _leaks(spark, sf_dir).where("score >= 1").select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out item that leaked, wholly or from PARTLY on: documents that leak it, those that hold a lesser part, and the best score."""
    names = table(spark, sf_dir, "heldout_items").select("item_id", "suite", "item_kind").dropDuplicates(["item_id"])
    found = cut(_leaks(spark, sf_dir, PARTLY), "p8-leaks")
    leaked = F.col("score") >= LEAKED
    return found.groupBy("item_id").agg(F.count_distinct(F.when(leaked, F.col("doc_id"))).alias("documents"), F.count_distinct(F.when(~leaked, F.col("doc_id"))).alias("partly"), F.max("score").alias("best_score")).join(names, "item_id")
