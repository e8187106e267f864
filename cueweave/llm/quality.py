"""Quality rules: gradient-boosted trees over document statistics, beside fixed rules.

The trees are trained here, on a bounded sample of labelled rows, with second-order logistic boosting over binned
features. Features in MONOTONE may move the score in one direction only: a split against it is refused, and
children's values are held on their side of the parent's middle. A trained model is a set of flat numpy node
arrays, walked level by level for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "pipe_share", "bang_share", "distinct_share", "words_a_line", "wide_share", "longest_word")
#: The sign that a feature may move the probability of good quality in.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BLANK = " \t\n\r\x0b\x0c"
_COUNTED = {name: np.array(sorted(map(ord, chars))) for name, chars in {"symbol": "#*$%&|<>", "blank": BLANK, "digit": "0123456789", "punct": ".,;:!?\"'()-", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}.items()}


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three numbers wouldn't fit into one
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The BASE counts and the FEATURES of a text; null has no words."""
    text = text or ""
    raw = text.encode()
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    points = len(text)
    symbols = int(bytes_of[_COUNTED["symbol"]].sum())
    chars = points - int(bytes_of[_COUNTED["blank"]].sum())
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = repeated_words(words)
    w, c = max(n, 1), max(chars, 1)
    share = lambda k: float(bytes_of[_COUNTED[k]].sum()) / c
    features = [np.log1p(n), chars / w, symbols / c, dup / max(lines, 1), repeat / w, share("upper"), share("digit"), share("punct"), bytes_of[ord("|")] / c, bytes_of[ord("!")] / c, len(set(words)) / w, n / max(lines, 1), (len(raw) - points) / c, float(max(map(len, words), default=0))]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class Trees:
    """Flat node arrays: [trees, nodes]. A leaf is its own child on either side."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for rows x of FEATURES."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                low = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(low, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return out


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least_rows: int = 5, ridge: float = 1.0, monotone: dict[int, int] | None = None) -> Trees:
    """Second-order boosting of the logistic loss. One class only, or no rows: no trees, the prior alone."""
    monotone = {FEATURES.index(k): v for k, v in MONOTONE.items()} if monotone is None else monotone
    n, f = x.shape if x.size else (0, len(FEATURES))
    good = float(np.sum(y))
    start = float(np.log((good + 1) / (n - good + 1)))
    nodes = (1 << depth + 1) - 1
    if n == 0 or good in (0.0, float(n)):
        z = np.zeros((0, nodes), np.int64)
        return Trees(z, z.astype(float), z, z, z.astype(float), start, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1)
    out = Trees(np.zeros((trees, nodes), np.int64), np.zeros((trees, nodes)), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros((trees, nodes)), start, depth)
    score = np.full(n, start)
    leaf = lambda g, h, lo, hi: float(np.clip(-g / (h + ridge), lo, hi))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        step = np.zeros(n)
        work = [(0, np.arange(n), -np.inf, np.inf)]
        while work:
            node, rows, lo, hi = work.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            mine = leaf(sg, sh, lo, hi)
            best = (1e-6, -1, -1, 0.0, 0.0)
            for j in range(f) if 2 * node + 2 < nodes and len(rows) >= 2 * least_rows else ():
                k = len(edges[j]) + 1
                b = binned[rows, j]
                cg, ch, cn = (np.cumsum(np.bincount(b, w, k))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                if not len(cg):
                    continue
                wl = np.clip(-cg / (ch + ridge), lo, hi)
                wr = np.clip(-(sg - cg) / (sh - ch + ridge), lo, hi)
                loss = lambda v, a, b: v * a + 0.5 * (b + ridge) * v * v
                gain = loss(mine, sg, sh) - loss(wl, cg, ch) - loss(wr, sg - cg, sh - ch)
                bad = (cn < least_rows) | (len(rows) - cn < least_rows)
                if sign := monotone.get(j, 0):
                    bad |= sign * (wr - wl) < 0
                gain = np.where(bad, -np.inf, gain)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), j, at, float(wl[at]), float(wr[at]))
            if best[1] < 0:
                out.value[t, node] = rate * mine
                step[rows] = rate * mine
                continue
            _, j, at, wl, wr = best
            low = binned[rows, j] <= at
            out.feature[t, node], out.threshold[t, node] = j, edges[j][at]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            sign, middle = monotone.get(j, 0), (wl + wr) / 2
            left = (lo, min(hi, middle)) if sign > 0 else (max(lo, middle), hi) if sign < 0 else (lo, hi)
            right = (max(lo, middle), hi) if sign > 0 else (lo, min(hi, middle)) if sign < 0 else (lo, hi)
            work += [(2 * node + 1, rows[low], *left), (2 * node + 2, rows[~low], *right)]
        score += step
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the BASE counts, features array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            base = np.array([r[0] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["doc_id", *BASE, "features"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{b} bigint' for b in BASE)}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", most_rows: int = 20_000) -> Trees:
    """Train on labelled rows, at most most_rows of them: all, or those of the least hashes of id and text.

    Only the rows in the sample are measured. Labels other than 0 and 1 are ignored; of several labels for one id the
    lowest holds.
    """
    known = labels.select(F.col(label_id_col).alias("of_id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("of_id").isNotNull()).groupBy("of_id").agg(F.min("y").alias("y"))
    there = known.count()
    if there > 0.95 * most_rows:  # filtered before anything is sent: no task sends more than its share
        known = known.where(F.pmod(F.xxhash64("of_id"), F.lit(1 << 30)) < int(0.95 * most_rows / there * (1 << 30)))
    src = id_and_text(docs, id_col, text_col).join(F.broadcast(known.limit(most_rows)), F.col("doc_id") == F.col("of_id"))
    hashed = F.xxhash64("doc_id", "text")
    labelled = src.select(F.struct(hashed.alias("hash"), "y").alias("doc_id"), "text")
    found = measured(labelled).select("doc_id.hash", "doc_id.y", "features").orderBy("hash", "y", "features").limit(most_rows).toPandas()
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(FEATURES))
    y = found["y"].to_numpy(float)
    order = np.lexsort([y, *x.T])  # rows come in any order; sums and so trees must not depend on it
    return train(x[order], y[order])


def judged(measures: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """Adds quality (probability), base_failed and kept to measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            p = 1 / (1 + np.exp(-model.score(x)))
            failed = base_failed(batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy())
            names = ["doc_id", *BASE, "quality", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:6]), pa.array(p), pa.array(failed), pa.array(~failed & (p >= least))], names=names)

    kind = measures.schema["doc_id"].dataType.simpleString()
    return measures.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{b} bigint' for b in BASE)}, quality double, base_failed boolean, kept boolean")


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: the BASE counts, quality, base_failed, kept. Null text has no words and fails.

    An empty table gives no rows; without labels the prior alone decides; other columns aren't read.
    """
    return judged(measured(docs, id_col, text_col), fit(docs, labels, id_col, text_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that pass, columns as given; null texts, without words, don't pass."""
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = [statistics(t) for t in batch.column(text_col).to_pylist()]
            base, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
            keep = ~base_failed(base[:, 0], base[:, 4]) & (1 / (1 + np.exp(-model.score(x))) >= least)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
