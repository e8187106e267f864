"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

An alignment with a share s of the best score of an item of n words matches at least s n of the item's words within
(3 - 2 s) n words of the document, since every edit costs half a match. So of any r words of the item at least
r - (n - s n) are matched there. The item's rarest r words, by a count over all documents, are its seeds: documents
with so many of them near each other may hold it. Of an alignment with m matches in r runs, at least r - 1 edits stand between
the runs, so that matched words and matched pairs of neighbours are 2 s n - 1 or more together: stretches of the
document with fewer of the item's words and neighbours go, the rest are aligned word by word. The items are
taken in blocks of bounded size: a stated query set against all documents; each block is one more pass over them, and
nothing is shuffled but the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices
from .grams import WORD, GramIndex, plain_words, smith_waterman

SPARE = 8  # an item has an eighth of its words as seeds beyond those that an alignment can miss
ITEMS_A_BLOCK = 10_000
CHARS_A_BLOCK = 64 << 20


def _sums(x: np.ndarray) -> np.ndarray:
    """The sums of x's beginnings, the empty one first."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _shared(numbers: np.ndarray, times: np.ndarray, among: np.ndarray) -> int:
    """How many of the numbers, each so many times at most, stand in `among`."""
    if not len(numbers):
        return 0
    at = np.minimum(np.searchsorted(numbers, among), len(numbers) - 1)
    return int(np.minimum(np.bincount(at[numbers[at] == among], minlength=len(numbers)), times).sum())


class Seeds:
    def __init__(self, items: list[tuple], counts: dict[int, int] | None = None, least_score: float = 0.5):
        """items: (id, words). counts: documents that hold a word, by its number."""
        self.items = [i for i in items if i[1]]
        self.index = GramIndex([w for _, w in self.items], 1)
        counts = counts or {}
        need, span, seeds = [], [], []
        for k, ids in enumerate(self.index.ids):
            n = len(ids)
            missed = n - math.ceil(least_score * n - 1e-9)
            numbers, times = np.unique(ids, return_counts=True)
            order = sorted(range(len(numbers)), key=lambda i: (counts.get(int(numbers[i]), 0), int(numbers[i])))
            many = np.cumsum(times[order])
            last = int(np.searchsorted(many, min(n, missed + 1 + int(n // SPARE))))
            need.append(max(1, int(many[last]) - missed))
            span.append(max(n, math.floor((3 - 2 * least_score) * n + 1e-9)))
            seeds += [(int(numbers[i]), k) for i in order[: last + 1]]
        seeds.sort()
        self.need, self.span = np.array(need, np.int64), np.array(span, np.int64)
        self.least = least_score
        self.held = np.zeros(len(self.index.number) + 1, np.int64)
        self.words = [np.unique(ids, return_counts=True) for ids in self.index.ids]
        self.pairs = [np.unique(self.index.keys(ids, 2) if len(ids) > 1 else np.zeros(0, np.int64), return_counts=True) for ids in self.index.ids]
        self.items_of = np.array([k for _, k in seeds], np.int64)
        self.starts = np.searchsorted(np.array([w for w, _ in seeds], np.int64), np.arange(len(self.index.number) + 2))

    def regions(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, begin, end): the stretches of a document that hold every alignment with the item."""
        first, many = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        place = np.repeat(np.arange(len(ids)), many)
        if not len(place):
            return []
        within = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
        item = self.items_of[np.repeat(first, many) + within]
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        to = np.arange(len(item)) + self.need[item] - 1
        at = np.flatnonzero(to < len(item))
        to = to[at]
        near = (item[to] == item[at]) & (place[to] - place[at] < self.span[item[at]])
        out: list[tuple[int, int, int]] = []
        for k, low, high in zip(item[at[near]].tolist(), place[at[near]].tolist(), place[to[near]].tolist()):
            begin, end = max(0, low - int(self.span[k])), min(len(ids), high + int(self.span[k]) + 1)
            if out and out[-1][0] == k and begin <= out[-1][2]:
                out[-1] = (k, out[-1][1], max(end, out[-1][2]))
            else:
                out.append((k, begin, end))
        return out

    def narrowed(self, ids: np.ndarray, k: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """The parts of a region whose windows hold enough words and neighbours of the item."""
        item, part = self.index.ids[k], ids[begin:end]
        need, window = self.least * len(item) - 1e-9, min(int(self.span[k]), len(part))
        self.held[item] = 1
        sums = _sums(self.held[part])
        self.held[item] = 0
        words = sums[window:] - sums[:-window]
        if words.max(initial=0) < need:
            return
        both = part[:-1] * (len(self.index.number) + 1) + part[1:]
        pairs = self.pairs[k][0]
        there = pairs[np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)] == both if len(pairs) else np.zeros(len(both), bool)
        sums = _sums(there)
        at = np.flatnonzero((words >= need) & (words + sums[window - 1 :] - sums[: len(sums) - window + 1] >= 2 * need - 1))
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > window) + 1
            for run in np.split(at, cuts):
                low, high = int(run[0]), int(run[-1]) + window
                # What the item has fewer times than the stretch counts as often as the item has it.
                many = _shared(*self.words[k], part[low:high])
                if many >= need and many + _shared(*self.pairs[k], both[low : high - 1]) >= 2 * need - 1:
                    yield begin + low, begin + high

    def matches(self, text: str | None, least_score: float) -> list[tuple]:
        """(item id, score, begin, end) in code points of text, the best of each item."""
        words = plain_words(text)
        ids = self.index.numbers(words)
        found: dict = {}
        for k, begin, end in ((k, *part) for k, low, high in self.regions(ids) for part in self.narrowed(ids, k, low, high)):
            item = self.index.ids[k]
            score, b, e = smith_waterman(item, ids[begin:end])
            score = score / (2 * len(item))
            name = self.items[k][0]
            if score >= least_score and (name not in found or score > found[name][0]):
                found[name] = (score, begin + b, begin + e)
        if not found:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        return [(name, score, spans[b][0], spans[e - 1][1]) for name, (score, b, e) in sorted(found.items(), key=lambda x: str(x[0]))]


def gram_counts(docs: DataFrame, seeds: Seeds) -> dict[int, int]:
    """How many documents hold each word of the block: one row for each word that any holds."""
    index = seeds.index
    known = index.known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                total[np.unique(index.find(index.numbers(plain_words(text)), known)[1])] += 1
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(known[at]), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, size: int, least_score: float) -> Iterator[Seeds]:
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    held = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    many = max(-(-held["n"] // size), -(-held["chars"] // CHARS_A_BLOCK))
    for b in range(many):
        mine = items if many == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b)
        found = sorted(((r["item_id"], plain_words(r["text"])) for r in mine.collect()), key=lambda x: (str(x[0]), x[1]))
        seeds = Seeds(found, None, least_score)
        if seeds.items:
            yield Seeds(found, gram_counts(docs, seeds), least_score)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = 0.5, block: int = ITEMS_A_BLOCK) -> DataFrame:
    """(doc_id, item_id, score, begin, end): for each row of docs the items that it holds, copied or edited.

    score: the local alignment's score over that of the whole item, at least least_score. Null and empty texts and
    items hold nothing; rows that repeat are reported each; items that repeat count once.
    """
    src = id_and_text(docs, id_col, text_col)
    item_type = benchmark.schema[item_col].dataType
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, item_id {item_type.simpleString()}, score double, begin bigint, end bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(item_type)

    def scan(seeds: Seeds) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                rows, found = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    for f in seeds.matches(text, least_score):
                        rows.append(i)
                        found.append(f)
                if rows:
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(cols[0], arrow), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "item_id", "score", "begin", "end"])

        return src.mapInArrow(run, schema)

    parts = [scan(s) for s in blocks(src, benchmark, item_col, item_text_col, block, least_score)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = 0.5, block: int = ITEMS_A_BLOCK) -> DataFrame:
    """The rows of docs that hold no item, columns as given. Null and empty texts hold none; rows that repeat stay or go alike."""
    for seeds in blocks(docs.select(F.col(text_col).alias("text")), benchmark, item_col, item_text_col, block, least_score):

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array([not seeds.matches(t, least_score) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
