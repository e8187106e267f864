"""A hidden Markov language model.

Tokens are lower-cased words and one end a text. The `own` most frequent words have emissions of their own; every
other word belongs to one of `classes` hash classes, and a state emits the class, the class the word:
P(w | state) = B[state, symbol(w)] * (c(w) + 1) / (C + V + 1), with C tokens and V words of the class in training and one
unseen word's share left. So B is bounded whatever the vocabulary, and the probabilities of a state still sum to one.

Training: word counts over all training texts; a start from the counts of all their first symbols and pairs of adjacent
symbols; then Baum-Welch rounds over all training texts. Expected counts are summed on the executors and by key, so that
the driver gets one model's worth. For the last rounds only, texts of more than SEGMENT tokens are cut, which bounds the
memory of the backward pass and loses one transition in SEGMENT of such a text. Scoring runs the scaled forward recursion
over each whole text. Scores don't depend on how rows are dealt out, but for the rounding of sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices

END = "\n"  # no word holds white space
SEGMENT = 4096
BATCH = 2048
CELLS = 1 << 19  # tokens, with padding, whose states are held at a time
PAIRS = 1 << 21  # pairs of symbols that a task holds before it counts them
BLOCKS = 1024  # a pair's counts meet by its number's remainder


def tokens_of(text: str | None) -> list[str]:
    raw = (text or "").encode().lower()  # of bytes: A-Z only
    return [*(w.decode() for w in raw.split()), END]


def held_out(doc_id: Column) -> Column:
    """A null id counts as an empty string."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Hmm:
    first: np.ndarray  # [K]: state of a text's first token
    later: np.ndarray  # [K]: state of the first token of a later segment or of a pair; used in training only
    move: np.ndarray  # [K, K]
    emit: np.ndarray  # [symbols, K]: P(symbol | state), by symbol

    @property
    def sizes(self) -> tuple[int, int]:
        return self.emit.shape

    def zeros(self) -> "Hmm":
        return Hmm(*(np.zeros_like(x) for x in (self.first, self.later, self.move, self.emit)))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.first, self.later, self.move, self.emit)])

    def unflat(self, v: np.ndarray) -> "Hmm":
        out, at = [], 0
        for x in (self.first, self.later, self.move, self.emit):
            out.append(v[at : at + x.size].reshape(x.shape))
            at += x.size
        return Hmm(*out)

    def normalised(self, prior: np.ndarray, weight: float = 50.0) -> "Hmm":
        """Probabilities from expected counts, drawn a little to the prior of symbols, which is positive."""
        emit = self.emit + weight * prior[:, None]
        move = self.move + 0.1
        return Hmm((self.first + 0.1) / (self.first + 0.1).sum(), (self.later + 0.1) / (self.later + 0.1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def segments(docs: list[np.ndarray]) -> list[tuple[bool, np.ndarray]]:
    return [(at == 0, d[at : at + SEGMENT]) for d in docs for at in range(0, len(d), SEGMENT)]


def expected(model: Hmm, parts: list[tuple[bool, np.ndarray]], into: Hmm) -> None:
    """Add the expected counts of the segments: forward and backward passes over many segments at a time."""
    parts, b = sorted(parts, key=lambda p: -len(p[1])), 0
    while b < len(parts):
        part = parts[b : b + max(1, min(BATCH, CELLS // max(1, len(parts[b][1]))))]
        b += len(part)
        size = np.array([len(p[1]) for p in part])
        live = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]  # longer than t
        obs = np.zeros((len(live), len(part)), np.int64)
        for i, (_, o) in enumerate(part):
            obs[: len(o), i] = o
        begins = np.array([p[0] for p in part])
        k = len(model.first)
        alpha, scale = np.zeros((len(live), len(part), k)), np.ones((len(live), len(part)))
        a = np.where(begins[:, None], model.first, model.later)
        for t, n in enumerate(live):
            a = (a[:n] if t == 0 else a[:n] @ model.move) * model.emit[obs[t, :n]]
            c = a.sum(1)
            a = a / c[:, None]
            alpha[t, :n], scale[t, :n] = a, c
        beta = np.ones((len(part), k))
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            gamma = alpha[t, :n] * beta[:n]
            if t:
                ahead = model.emit[obs[t, :n]] * beta[:n] / scale[t, :n, None]
                into.move += model.move * (alpha[t - 1, :n].T @ ahead)
                beta[:n] = ahead @ model.move.T
            else:
                into.first += gamma[begins].sum(0)
                into.later += gamma[~begins].sum(0)
            alpha[t, :n] = gamma
        mask = np.arange(len(live))[:, None] < size[None]
        flat = obs[mask]
        for s in range(k):
            into.emit[:, s] += np.bincount(flat, alpha[:, :, s][mask], len(into.emit))


def expected_of_pairs(model: Hmm, at: np.ndarray, c: np.ndarray, into: Hmm) -> None:
    """Add the expected counts of pairs, the k-th of them c[k] times. at: see pair_counts."""
    n = model.sizes[0]
    a, b = at // n, at % n
    begins = a == n
    firsts, times = b[begins], c[begins]
    a, b, c = a[~begins], b[~begins], c[~begins]
    right = model.emit[b]
    ahead = right @ model.move.T
    left = model.later * model.emit[a]
    left *= (c / (left * ahead).sum(1))[:, None]
    into.move += model.move * (left.T @ right)
    right *= left @ model.move
    left *= ahead
    into.later += left.sum(0)
    alone = model.first * model.emit[firsts]
    alone *= (times / alone.sum(1))[:, None]
    into.first += alone.sum(0)
    for s in range(len(model.first)):
        into.emit[:, s] += np.bincount(a, left[:, s], n) + np.bincount(b, right[:, s], n) + np.bincount(firsts, alone[:, s], n)


def log10_likelihood(model: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 probability of each sequence of symbols, by the scaled forward recursion."""
    out = np.zeros(len(docs))
    order = np.argsort([-len(d) for d in docs], kind="stable")
    for b in range(0, len(docs), BATCH):
        mine = order[b : b + BATCH]
        part = [docs[i] for i in mine]
        size = np.array([len(d) for d in part])
        flat, start = np.concatenate(part), np.r_[0, np.cumsum(size)[:-1]]
        total = np.zeros(len(part))
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        a = np.tile(model.first, (len(part), 1))
        for t, n in enumerate(live.tolist()):
            a = (a[:n] @ model.move if t else a[:n]) * model.emit[flat[start[:n] + t]]
            c = a.sum(1)
            a /= c[:, None]
            total[:n] += np.log10(c)
        out[mine] = total
    return out


@dataclass
class Lexicon:
    """Bounded: the most frequent words, at most `listed`, of which the first `own` have symbols of their own."""

    rank: dict[str, int]
    count: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    own: int
    n: int
    v: int

    @property
    def symbols(self) -> int:
        return 1 + self.own + len(self.class_tokens)

    def prior(self) -> np.ndarray:
        """Of symbols: end, own words, classes; positive, sums to one."""
        p = np.zeros(self.symbols)
        p[1 + self.own :] = self.class_tokens + self.class_words
        for w, r in self.rank.items():
            if w == END:
                p[0] += self.count[r]
            elif r < self.own:
                p[1 + r] += self.count[r]
        p += 0.5
        return p / p.sum()


def class_of(word: str, classes: int) -> int:
    return xxhash.xxh64_intdigest(word, seed=42) % classes


def lexicon(counts: DataFrame, own: int, listed: int, classes: int) -> Lexicon:
    """counts: (token, c). classes must be a power of two, that signed and unsigned hashes agree."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Whole classes of counts, sixteen to a doubling, from the top as far as they fit: no task sends more than is kept.
    size = F.floor(F.log2(F.col("c")) * 16)
    room, least = listed, None
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["size"]
    top = sorted(counts.where(size >= least).collect(), key=lambda r: (-r["c"], r["token"])) if least is not None else []
    rank = {r["token"]: i for i, r in enumerate(top)}
    count = np.array([r["c"] for r in top] or [0], np.int64)
    tokens, words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in counts.groupBy(F.pmod(F.xxhash64("token"), F.lit(classes)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["k"]], words[r["k"]] = r["c"], r["v"]
    for w, r in rank.items():
        if r < own or w == END:
            k = class_of(w, classes)
            tokens[k] -= count[r]
            words[k] -= 1
    return Lexicon(rank, count, tokens, words, own, whole["n"], whole["v"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over docs (text), summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            names, n = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in names], pa.string()), pa.array(n, pa.int64())], names=["token", "c"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update((text or "").encode().lower().split())
                held[b"\n"] += 1
            if len(held) > 200_000:
                yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


def symbolised(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """For each row: its symbols, sums over listed words, and the words that aren't listed, space-joined."""
    own, classes = lex.own, len(lex.class_tokens)
    base_of = np.log10((lex.count + 1) / (lex.n + lex.v + 1))
    symbol_of, within_of = np.zeros(len(lex.count), np.int64), np.zeros(len(lex.count))
    for w, r in lex.rank.items():
        if w == END:
            symbol_of[r] = 0
        elif r < own:
            symbol_of[r] = 1 + r
        else:
            k = class_of(w, classes)
            symbol_of[r] = 1 + own + k
            within_of[r] = math.log10((lex.count[r] + 1) / (lex.class_tokens[k] + lex.class_words[k] + 1))
    rank = {w.encode(): r for w, r in lex.rank.items()}
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = rank.get
        for batch in slices(batches, "text"):
            n, known, base, within, symbols, rare = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                w = (text or "").encode().lower().split()
                w.append(b"\n")
                at = np.array([get(x, -1) for x in w], np.int64)
                miss = np.flatnonzero(at < 0)
                hit = at[at >= 0]
                s = symbol_of[at]
                out = [w[i] for i in miss.tolist()]
                # Without training texts the end isn't listed either; it keeps its symbol and is looked up like the rest.
                s[miss] = [0 if x == b"\n" else 1 + own + digest(x, seed=42) % classes for x in out]
                n.append(len(w))
                known.append(len(hit))
                base.append(float(base_of[hit].sum()))
                within.append(float(within_of[hit].sum()))
                symbols.append(s.astype(np.int32).tobytes() if lex.symbols > 1 << 15 else s.astype(np.int16).tobytes())
                rare.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(within, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, pa.string())],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "within", "symbols", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, within double, symbols binary, rare string")


def _arrays(column: pa.Array, wide: bool) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32 if wide else np.int16) for b in column.to_pylist()]


def one_round(rows: DataFrame, model: Hmm, prior: np.ndarray, add: Callable[[Hmm, pa.RecordBatch, Hmm], None]) -> Hmm:
    """The model after one round over all rows: the expected counts that add finds are summed in each task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = model.zeros(), False
        for batch in batches:
            if batch.num_rows:
                some = True
                add(model, batch, total)
        if some:
            flat = total.flat()
            at = np.flatnonzero(flat)
            for k in range(0, len(at), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(at[k : k + (1 << 14)]), pa.array(flat[at[k : k + (1 << 14)]])], names=["at", "x"])

    summed = rows.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(len(model.flat()))
    flat[summed["at"].to_numpy(np.int64)] = summed["x"].to_numpy(float)
    return model.unflat(flat).normalised(prior)


def baum_welch_round(training: DataFrame, model: Hmm, prior: np.ndarray) -> Hmm:
    """One round over all rows of training (symbols)."""
    wide = model.sizes[0] > 1 << 15
    return one_round(training.select("symbols"), model, prior, lambda model, batch, total: expected(model, segments(_arrays(batch.column("symbols"), wide)), total))


def pair_counts(training: DataFrame, symbols: int) -> DataFrame:
    """(at, c), packed arrays: how often b follows a in training, at a * symbols + b; a is `symbols` where b is a text's first.

    Whole counts over all rows, at most symbols * (symbols + 1) of them, however many rows. Those of a partition are
    held as a table, so that they fit in 8 * symbols^2 bytes over the number of shuffle partitions.
    """
    wide = symbols > 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            at, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            by = np.argsort(at % BLOCKS, kind="stable")
            at, c = at[by], c[by]
            blocks, begin = np.unique(at % BLOCKS, return_index=True)
            cells = [np.split(x.astype(np.int32), begin[1:]) for x in (at // BLOCKS, c)]
            return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32)), *(pa.array([y.tobytes() for y in x], pa.binary()) for x in cells)], names=["block", "cell", "c"])

        for batch in batches:
            for s in _arrays(batch.column("symbols"), wide):
                s = s.astype(np.int64)
                held.append(np.r_[symbols, s[:-1]] * symbols + s)
                size += len(s)
                if size >= PAIRS:
                    yield out()
                    size = 0
        if held:
            yield out()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cell, c in zip(*(batch.column(x).to_pylist() for x in ("block", "cell", "c"))):
                if block not in held:
                    held[block] = np.zeros(symbols * (symbols + 1) // BLOCKS + 1, np.int64)
                held[block][np.frombuffer(cell, np.int32)] += np.frombuffer(c, np.int32)
        for block, table in held.items():
            cell = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([(cell * BLOCKS + block).tobytes()], pa.binary()), pa.array([table[cell].tobytes()], pa.binary())], names=["at", "c"])

    found = training.select("symbols").mapInArrow(run, "block int, cell binary, c binary")
    return found.repartition("block").mapInArrow(total, "at binary, c binary")


def started(training: DataFrame, lex: Lexicon, states: int, rounds: int) -> Hmm:
    """A start for Baum-Welch: a sticky random model, fitted to the first symbols and the pairs of all training texts.

    That is, to segments of one and of two tokens. A round's work is bounded by the square of the number of symbols.
    """
    prior, draw = lex.prior(), np.random.default_rng(42)
    emit = prior[:, None] * draw.gamma(2.0, size=(lex.symbols, states))
    move = np.full((states, states), 0.2 / max(1, states - 1)) + 0.8 * np.eye(states)
    even = np.full(states, 1 / states)
    model = Hmm(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(0))
    few = max(1, training.sparkSession.sparkContext.defaultParallelism)
    pairs = cut(pair_counts(training, lex.symbols).coalesce(few))

    def add(model: Hmm, batch: pa.RecordBatch, total: Hmm) -> None:
        for at, c in zip(batch.column("at").to_pylist(), batch.column("c").to_pylist()):
            expected_of_pairs(model, np.frombuffer(at, np.int64), np.frombuffer(c, np.int64), total)

    for _ in range(0 if pairs.isEmpty() else rounds):
        model = one_round(pairs, model, prior, add)
    return model


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, own: int = 4096, listed: int = 1 << 17, classes: int = 1024, sample: int | None = None, start_rounds: int = 20, rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Texts whose crc32(id as text) mod 7 is 2 are held out of training. base_score: add-one unigram model; score: the
    hidden Markov model's log10 probability of the text. Null text counts as empty: the end alone. A null id is in
    training. Rows that repeat are scored each; an empty table gives no rows; other columns aren't read. Without training
    texts all words are unseen. sample isn't read, since the start takes all training texts; it is kept for callers.
    """
    if classes & (classes - 1):
        raise ValueError("classes must be a power of two")
    src = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    counts = cut(word_counts(src.where(~F.col("held_out")).select("text")))
    lex = lexicon(counts, own, listed, classes)
    texts = cut(symbolised(src, lex).withColumn("row", F.monotonically_increasing_id()))
    training = texts.where(~F.col("held_out"))
    prior = lex.prior()
    model = started(training, lex, states, start_rounds)
    for _ in range(rounds):
        model = baum_welch_round(training, model, prior)
    wide = lex.symbols > 1 << 15

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = log10_likelihood(model, _arrays(batch.column("symbols"), wide))
                names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "within"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found)], names=[*names, "path"])

    kind = src.schema["doc_id"].dataType.simpleString()
    scored = texts.drop("rare").mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, within double, path double")
    rare = texts.where("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    unlisted = counts.where(F.col("c") <= int(lex.count[-1]) if lex.rank else F.lit(True)).select(F.col("token").alias("of_word"), "c")
    totals = docs.sparkSession.createDataFrame([(k, int(t + v) + 1) for k, (t, v) in enumerate(zip(lex.class_tokens, lex.class_words))], "k long, total long")
    found = (
        rare.join(unlisted, F.col("word") == F.col("of_word"), "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .withColumn("k", F.pmod(F.xxhash64("word"), F.lit(classes)))
        .join(F.broadcast(totals), "k")  # `classes` rows
        .groupBy("row")
        .agg(
            F.count(F.when(F.col("c") > 0, 1)).alias("rare_known"),
            F.sum(F.log10((F.col("c") + 1) / F.lit(float(lex.n + lex.v + 1)))).alias("rare_base"),
            F.sum(F.when(F.col("word") == END, 0.0).otherwise(F.log10((F.col("c") + 1) / F.col("total")))).alias("rare_within"),
        )
        .withColumnRenamed("row", "of_row")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(found, F.col("row") == F.col("of_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(int(lex.n)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("path") + F.col("within") + zero("rare_within")).alias("score"),
    )
