"""Fuzzy scores of transcripts against script lines.

The kernels are plain Python over bit-parallel integers; the Arrow UDFs below score whole batches and each pair of
texts once a batch. Inputs are texts in `folded` form (functions.text), so that the UDFs do nothing but score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_LEAST = 78.0


def common_length(a, b) -> int:
    """Length of the longest common subsequence, by one big-integer addition for each element of b."""
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a, b) -> float:
    """100 for equal, 0 for nothing in common: twice the common length over both lengths."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def similarity(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


class Lines:
    """Texts laid end to end in integers of about BITS bits: one pass over a text gives its similarity to each of them.

    A bit that stays zero after each text takes up the carry of its addition.
    """

    BITS = 1 << 16

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.blocks, at, starts, where, full = [], 0, [], {}, 0
        for k, t in enumerate(texts):
            own: dict = {}
            for i, x in enumerate(t):
                own[x] = own.get(x, 0) | 1 << i
            for x, bits in own.items():
                where[x] = where.get(x, 0) | bits << at
            full |= (1 << len(t)) - 1 << at
            starts.append(at)
            at += len(t) + 1
            if at >= self.BITS or k == len(texts) - 1:
                self.blocks.append((where, full, np.array(starts), at))
                at, starts, where, full = 0, [], {}, 0

    def common_lengths(self, text: str) -> np.ndarray:
        left = []
        for where, full, starts, size in self.blocks:
            row = full
            for x in text:
                hit = where.get(x)
                if hit is not None:
                    hit &= row
                    row = (row + hit | row ^ hit) & full
            bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-size // 8), "little"), np.uint8), bitorder="little")
            left.append(np.add.reduceat(bits, starts, dtype=np.int64))
        return self.sizes - np.concatenate(left) if left else np.zeros(0, np.int64)

    def similarities(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(len(self.sizes))
        return np.where(self.sizes > 0, 200.0 * self.common_lengths(text) / (self.sizes + len(text)), 0.0)


def similarities(pairs: list[tuple[str, str]]) -> list[float]:
    """similarity() of pairs; those of one second text are scored in one pass over it."""
    out, of = [0.0] * len(pairs), {}
    for k, (_, b) in enumerate(pairs):
        of.setdefault(b, []).append(k)
    for b, at in of.items():
        found = Lines([pairs[k][0] for k in at]).similarities(b).tolist() if len(at) > 1 else [similarity(pairs[at[0]][0], b)]
        for k, score in zip(at, found):
            out[k] = score
    return out


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length, or a shorter one at either end, of the longer."""
    return partial_ratios([(a, b)])[0]


def partial_ratios(pairs: list[tuple[str, str]], cells: int = 1 << 14) -> list[float]:
    """partial_ratio() of pairs: the common lengths with all windows at once, from one table for each pair.

    Strands enter the table at its left side and its top and cross at most once, never where letters match. A window
    has as many letters that aren't common as strands run from its top to its bottom (semi-local subsequences).
    Pairs of like lengths go together, a diagonal at a time; padding matches nothing and changes no window.
    """
    out, todo = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if short and short in long:
            out[k] = 100.0
        elif short:
            todo.append((int(2 * math.log2(len(short))), len(long), k, short, long))
    todo.sort()
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and todo[end][0] == todo[at][0] and (end - at + 1) * len(todo[end][3]) <= cells and todo[end][1] <= 2 * todo[at][1]:
            end += 1
        batch, at = todo[at:end], end
        for (_, length, k, short, _), starts in zip(batch, _strands([x[3] for x in batch], [x[4] for x in batch])):
            out[k] = _best_window(len(short), length, starts)
    return out


def _letters(texts: list[str], other: int) -> np.ndarray:
    """Letters of texts as columns of numbers, padded by `other`."""
    out = np.full((len(texts), max(map(len, texts))), other, np.uint32)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out.T


def _strands(shorts: list[str], longs: list[str]) -> list[np.ndarray]:
    """For each pair, and each place of the long text, where at the top the strand that ends below it began; < 0: at the left."""
    a, b = _letters(shorts, 1 << 30)[::-1], _letters(longs, 1 << 31)
    names = np.unique(a)
    kind = np.uint16 if len(names) + 1 < 1 << 15 and len(a) + len(b) < 1 << 15 else np.uint32
    at = np.minimum(np.searchsorted(names, b), len(names) - 1)
    b = np.ascontiguousarray(np.where(names[at] == b, at, len(names)).astype(kind))
    a = np.ascontiguousarray(np.searchsorted(names, a).astype(kind))
    m, n = len(a), len(b)
    left = np.repeat(np.arange(m, dtype=kind)[:, None], a.shape[1], 1)
    top = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], a.shape[1], 1)
    one, high, free = kind(1), kind(1 << 8 * kind().itemsize - 1), np.empty_like(left)
    for d in range(m + n - 1):
        j, end = max(0, d - m + 1), min(d + 1, n)
        i = m - 1 - d + j
        h, v, x = left[i : i + end - j], top[j:end], free[: end - j]
        # The lesser of both strands goes on to the right, where letters match the upper one: equal letters set the highest bit of h.
        np.bitwise_xor(a[i : i + end - j], b[j:end], out=x)
        np.subtract(x, one, out=x)
        np.bitwise_and(x, high, out=x)
        np.bitwise_or(x, h, out=x)
        np.minimum(x, v, out=x)
        v ^= h
        v ^= x
        h[...] = x
    return list(top.T.astype(np.int64) - m)


def _best_window(n: int, length: int, starts: np.ndarray) -> float:
    starts = starts[:length]
    inner = starts >= 0
    ends = np.full(length, length)
    ends[starts[inner]] = np.flatnonzero(inner)
    i = np.arange(length - n)
    lost = int(inner[:n].sum()) + np.concatenate([[0], np.cumsum((starts[n:] > i).astype(np.int64) - (ends[: length - n] < i + n))])
    best = 200.0 * int(n - lost.min()) / (n + n)
    k = np.arange(1, n)
    for crossing in (inner, (ends < length)[::-1]):
        best = max(best, (200.0 * (k - np.cumsum(crossing[: n - 1])) / (n + k)).max(initial=0.0))
    return float(best)


def ratios(words: list[str], others: list[str]) -> np.ndarray:
    """ratio() of each word with each other word: bits of a word in a machine word, all pairs a letter at a time."""
    if not any(words) or not any(others):
        return np.array([[ratio(x, y) for y in others] for x in words]).reshape(len(words), len(others))
    rows, columns = (np.array(w).view(np.uint32).reshape(len(w), -1).T for w in (words, others))
    sizes, lengths = np.array([len(w) for w in words]), np.array([len(w) for w in others])
    names = np.unique(rows)
    where = np.zeros((len(names) + 1, len(words)), np.uint64)
    for i, row in enumerate(np.searchsorted(names, rows[:64])):
        here = np.flatnonzero(i < sizes)
        where[row[here], here] |= np.uint64(1 << i)
    at = np.minimum(np.searchsorted(names, columns), len(names) - 1)
    at = np.where((names[at] == columns) & (np.arange(len(columns))[:, None] < lengths), at, len(names))
    full = np.array([(1 << min(64, int(n))) - 1 for n in sizes], np.uint64)
    left = np.repeat(full[None, :], len(others), 0)
    for letter in at:
        hit = left & where[letter]
        left = left + hit | left ^ hit
    out = 200.0 * (sizes - np.bitwise_count(left & full)).T / np.maximum(1, sizes + lengths[:, None]).T
    out = out.T
    for k in np.flatnonzero(sizes > 64):
        out[:, k] = [ratio(words[k], y) for y in others]
    out[(sizes + lengths[:, None]) == 0] = 100.0
    return out.T


class TokenCosts:
    """What it costs to match each expected with each observed token; any stretch of either side can be aligned.

    Tokens of a ratio of `least` or more match at a quarter of what they lack to 100; deletions, insertions and
    substitutions cost one each. Ratios are worked out once for each pair of different tokens.
    """

    def __init__(self, expected: list[str], observed: list[str], least: float = TOKEN_LEAST):
        names, rows = np.unique(np.array(expected, object).astype(str), return_inverse=True) if expected else (np.zeros(0, str), np.zeros(0, np.int64))
        others, columns = np.unique(np.array(observed, object).astype(str), return_inverse=True) if observed else (np.zeros(0, str), np.zeros(0, np.int64))
        score = ratios(names.tolist(), others.tolist())
        self.match = np.where(score >= least, 0.25 * (100.0 - score) / 100.0, -1.0)[np.ix_(rows, columns)]

    def operations(self, rows: slice = slice(None), columns: slice = slice(None)) -> list[tuple[str, int, int]]:
        """The cheapest ordered edits of a stretch into a stretch, as edits() has them."""
        return edits([self.match[rows, columns]])[0]

    def matches(self, rows: slice = slice(None), columns: slice = slice(None)) -> list[tuple[int, int]]:
        return [(e, o) for kind, e, o in self.operations(rows, columns) if kind == "match"]


KINDS = ("match", "delete", "insert", "substitute")


def edits(tables: list[np.ndarray], cells: int = 1 << 18) -> list[list[tuple[str, int, int]]]:
    """For each table of match costs (-1: no match) the cheapest edits: (operation, expected place or -1, observed place or -1).

    Of equally cheap ones a match is taken before a deletion, that before an insertion, that before a substitution,
    from the end on. Tables of like sizes go together, a diagonal at a time; each cell's cost is the sum that a loop
    over the cells would make, since which of nearly equal costs is less depends on the rounding.
    """
    out: list = [[]] * len(tables)
    order = sorted(range(len(tables)), key=lambda k: (tables[k].shape[1] // 8, tables[k].shape[0]))
    at = 0
    while at < len(order):
        size, batch = 0, []
        for k in order[at:]:
            size = max(size, (tables[k].shape[0] + 1) * (tables[k].shape[1] + 9))
            if batch and size * (len(batch) + 1) > cells:
                break
            batch.append(k)
        at += len(batch)
        for k, moves in zip(batch, _moves([tables[k] for k in batch])):
            i, j = tables[k].shape
            width, path = moves.shape[1], []
            flat = moves.tobytes()
            while i or j:
                kind = flat[i * width + j]
                i, j = i - (kind != 2), j - (kind != 1)
                path.append((KINDS[kind], -1 if kind == 2 else i, -1 if kind == 1 else j))
            out[k] = path[::-1]
    return out


def _moves(tables: list[np.ndarray]) -> np.ndarray:
    """The last edit, as a place in KINDS, of each pair of beginnings: (table, expected, observed)."""
    n, m = (max(t.shape[axis] for t in tables) for axis in (0, 1))
    match = np.full((n + 1, m + 1, len(tables)), -1.0)
    for k, t in enumerate(tables):
        match[1 : t.shape[0] + 1, 1 : t.shape[1] + 1, k] = t
    total = np.empty_like(match)
    total[0], total[:, 0] = np.arange(m + 1)[:, None], np.arange(n + 1)[:, None]
    step, cost = np.where(match >= 0, match, 1.0).reshape(-1, len(tables)), total.reshape(-1, len(tables))
    for d in range(2, n + m + 1) if n and m else ():
        i, last = max(1, d - m), min(n, d - 1)
        here = lambda back: slice(i * m + d - back, last * m + d - back + 1, m)  # noqa: B023, E731
        best = np.minimum(cost[here(m + 1)], cost[here(1)]) + 1.0
        cost[here(0)] = np.minimum(best, cost[here(m + 2)] + step[here(0)])
    moves = np.full(match.shape, 3, np.uint8)
    moves[:, 1:][total[:, 1:] == total[:, :-1] + 1.0] = 2
    moves[1:][total[1:] == total[:-1] + 1.0] = 1
    moves[1:, 1:][(match[1:, 1:] >= 0) & (total[1:, 1:] == total[:-1, :-1] + match[1:, 1:])] = 0
    return np.ascontiguousarray(moves.transpose(2, 0, 1))


def token_operations(expected: list[str], observed: list[str], least: float = TOKEN_LEAST) -> list[tuple[str, int, int]]:
    return TokenCosts(expected, observed, least).operations()


def edge_edits(operations: list[str]) -> dict[str, int]:
    """Edits before the first match and after the last; without a match, all of them on both sides."""
    at = [k for k, o in enumerate(operations) if o == "match"]
    before, after = (operations[: at[0]], operations[at[-1] + 1 :]) if at else (operations, operations)
    kinds = (("missing_token", "delete"), ("extra_token", "insert"), ("substitution", "substitute"))
    return {f"{side}_{name}_count": part.count(kind) for side, part in (("leading", before), ("trailing", after)) for name, kind in kinds}


FIDELITY = ("ordered_similarity", "token_coverage", "token_precision", "prefix_token_coverage", "suffix_token_coverage")
FIDELITY_COUNTS = ("extra_word_count", "prefix_missing_token_count", "suffix_missing_token_count", "leading_missing_token_count", "leading_extra_token_count", "leading_substitution_count", "trailing_missing_token_count", "trailing_extra_token_count", "trailing_substitution_count")
FIDELITY_TYPE = "struct<" + ",".join([f"{f}:double" for f in FIDELITY] + [f"{f}:int" for f in FIDELITY_COUNTS]) + ">"


def fidelity(expected: str, observed: str, least: float = TOKEN_LEAST, window: int = 4, slack: int = 2) -> dict:
    """Ordered agreement of two folded texts."""
    return fidelities([(expected, observed)], least, window, slack)[0]


def fidelities(pairs: list[tuple[str, str]], least: float = TOKEN_LEAST, window: int = 4, slack: int = 2) -> list[dict]:
    """fidelity() of pairs, their edits worked out together."""
    out, todo, tables = [], [], []
    for expected, observed in pairs:
        e, o = expected.split(), observed.split()
        if not e or not o:
            counts = dict.fromkeys(FIDELITY_COUNTS, 0) | {k: len(e) for k in FIDELITY_COUNTS if "missing" in k}
            counts |= {k: len(o) for k in ("extra_word_count", "leading_extra_token_count", "trailing_extra_token_count")}
            out.append(dict.fromkeys(FIDELITY, 0.0) | counts)
            continue
        match = TokenCosts(e, o, least).match
        edge = min(len(e), max(1, window))
        seen = min(len(o), edge + max(0, slack))
        todo.append((len(out), expected, observed, len(e), len(o), edge))
        tables += [match, match[:edge, :seen], match[len(e) - edge :, len(o) - seen :]]
        out.append({})
    kinds = [[x[0] for x in ops] for ops in edits(tables)]
    for (k, expected, observed, n, m, edge), operations, start, end in zip(todo, kinds[::3], kinds[1::3], kinds[2::3]):
        hits, at_start, at_end = operations.count("match"), start.count("match"), end.count("match")
        out[k] = {
            "ordered_similarity": ratio(expected, observed),
            "token_coverage": hits / n,
            "token_precision": hits / m,
            "extra_word_count": m - hits,
            "prefix_token_coverage": at_start / edge,
            "suffix_token_coverage": at_end / edge,
            "prefix_missing_token_count": edge - at_start,
            "suffix_missing_token_count": edge - at_end,
        } | edge_edits(operations)
    return out


SENTENCE_TYPE = "struct<clause_count:int,clause_scores:array<double>,clause_token_coverages:array<double>,clause_word_counts:array<int>,clause_positions:array<int>,clauses_in_order:boolean,minimum_clause_score:double,missing_clause_count:int>"


def sentence_fidelity(clauses: list[str], word_counts: list[int], observed: str, least: float = TOKEN_LEAST, least_score: float = 55.0, short_words: int = 4, short_coverage: float = 1.0) -> dict:
    """Agreement clause by clause. clauses: folded; word_counts: of the clauses as written.

    One table of token costs serves the whole and, by its rows, each clause.
    """
    return sentence_fidelities([(clauses, word_counts, observed)], least, least_score, short_words, short_coverage)[0]


def sentence_fidelities(given: list[tuple[list[str], list[int], str]], least: float = TOKEN_LEAST, least_score: float = 55.0, short_words: int = 4, short_coverage: float = 1.0) -> list[dict]:
    """sentence_fidelity() of rows, their edits and partial ratios worked out together."""
    tables, pairs = [], {}
    for clauses, _, observed in given:
        match = TokenCosts(" ".join(clauses).split(), observed.split(), least).match
        ends = np.cumsum([0, *(len(c.split()) for c in clauses)])
        tables += [match, *(match[x:y] for x, y in zip(ends, ends[1:]))]
        pairs |= dict.fromkeys((c, observed) for c in clauses)
    found = iter(edits(tables))
    partial = dict(zip(pairs, partial_ratios(list(pairs))))
    return [_sentences(clauses, counts, o, found, partial, least_score, short_words, short_coverage) for clauses, counts, o in given]


def _sentences(clauses, word_counts, observed, found, partial, least_score, short_words, short_coverage) -> dict:
    sizes = np.array([len(c.split()) for c in clauses], np.int64)
    ends = np.cumsum(sizes)
    heard = observed.split()
    first = np.full(len(clauses), -1, np.int64)  # where a clause's first matched word stands in the observed text
    for kind, e, o in reversed(next(found)):
        if kind == "match":
            first[np.searchsorted(ends, e, side="right")] = o
    hits = [sum(x[0] == "match" for x in next(found)) for _ in clauses]
    covered = np.array([h / n if n and heard else 0.0 for h, n in zip(hits, sizes)], float)
    scores = 50.0 * covered + 0.5 * np.array([partial[c, observed] for c in clauses], float)
    short = np.array(word_counts, np.int64) <= short_words
    lost = (scores < least_score) | (short & (covered < short_coverage))
    return {
        "clause_count": len(clauses),
        "clause_scores": scores.tolist(),
        "clause_token_coverages": covered.tolist(),
        "clause_word_counts": list(word_counts),
        "clause_positions": first.tolist(),
        "clauses_in_order": bool((first[:-1] >= 0).all() and (np.diff(first) >= 0).all()),
        "minimum_clause_score": float(scores.min(initial=np.inf)) if len(scores) else 0.0,
        "missing_clause_count": int(lost.sum()),
    }


def occurs_twice(expected: str, observed: str) -> bool:
    """Whether expected's tokens, or its letters run together where there are five or more, occur twice in observed."""
    e, o = expected.split(), observed.split()
    if not e or len(o) < 2:
        return False
    found = at = 0
    while at + len(e) <= len(o):
        hit = o[at : at + len(e)] == e
        found += hit
        at += len(e) if hit else 1
    run = "".join(e)
    return found >= 2 or (len(run) >= 5 and "".join(o).count(run) >= 2)


def collapsed_repetition(preliminary: str, exact: str, share: float = 0.5) -> bool:
    """Whether the preliminary tokens exceed the exact ones by `share` of these, and by repeats of them alone too."""
    before, after = Counter(preliminary.split()), Counter(exact.split())
    if not before or not after:
        return False
    excess = (before - after).total()
    repeats = Counter({w: n for w, n in (before - after).items() if w in after}).total()
    return min(excess, repeats) >= max(1, -(-after.total() * share // 1))


def repeated_excess(expected: str, observed: str) -> bool:
    want, got = Counter(expected.split()), Counter(observed.split())
    return any(n >= 2 and n > want[w] for w, n in got.items())


def weighted_ratio(a: str, b: str, partial: float | None = None) -> float:
    """A composite of plain, partial and token-order-free ratios, for ranking only."""
    if not a or not b:
        return 0.0
    scale = max(len(a), len(b)) / min(len(a), len(b))
    by_token = 0.95 * max(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), _token_set_ratio(a, b))
    if scale < 1.5:
        return max(ratio(a, b), by_token)
    return max(ratio(a, b), (partial_ratio(a, b) if partial is None else partial) * (0.9 if scale < 8 else 0.6), by_token * (0.9 if scale < 8 else 0.6))


def weighted_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """weighted_ratio() of pairs, their partial ratios together."""
    far = [k for k, (a, b) in enumerate(pairs) if a and b and max(len(a), len(b)) / min(len(a), len(b)) >= 1.5]
    partial = dict(zip(far, partial_ratios([pairs[k] for k in far])))
    return [weighted_ratio(a, b, partial.get(k)) for k, (a, b) in enumerate(pairs)]


def _token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    only = [" ".join(filter(None, [both, *sorted(s)])) for s in (x - y, y - x)]
    return max(similarity(both, only[0]), similarity(both, only[1]), similarity(*only))


def _rows(kernel, *columns: pd.Series) -> list:
    """kernel takes a list of distinct rows and returns a value for each."""
    keys = [tuple(a if isinstance(a, str) else tuple(a) for a in args) for args in zip(*columns)]
    held = list(dict.fromkeys(keys))
    found = dict(zip(held, kernel(held)))
    return [found[k] for k in keys]


def _each(kernel):
    return lambda rows: [kernel(*r) for r in rows]


def _scored(kernel, kind: str, a: Column, b: Column) -> Column:
    """The UDF is made when a plan is built: executors import this module for its kernels alone."""

    @F.pandas_udf(kind)
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_rows(kernel, x.fillna(""), y.fillna("")), dtype=float if kind == "double" else bool)

    return run(a, b)


def similarity_of(a: Column, b: Column) -> Column:
    return _scored(similarities, "double", a, b)


def partial_ratio_of(a: Column, b: Column) -> Column:
    return _scored(partial_ratios, "double", a, b)


def weighted_ratio_of(a: Column, b: Column) -> Column:
    return _scored(weighted_ratios, "double", a, b)


def occurs_twice_in(expected: Column, observed: Column) -> Column:
    return _scored(_each(occurs_twice), "boolean", expected, observed)


def collapsed_repetition_of(preliminary: Column, exact: Column) -> Column:
    return _scored(_each(collapsed_repetition), "boolean", preliminary, exact)


def fidelity_of(expected: Column, observed: Column, least: float = TOKEN_LEAST, window: int = 4, slack: int = 2) -> Column:
    @F.pandas_udf(FIDELITY_TYPE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = _rows(lambda rows: fidelities(rows, least, window, slack), a.fillna(""), b.fillna(""))
        return pd.DataFrame(rows, columns=[*FIDELITY, *FIDELITY_COUNTS])

    return run(expected, observed)


def sentence_fidelity_of(clauses: Column, word_counts: Column, observed: Column, least: float = TOKEN_LEAST, least_score: float = 55.0, short_words: int = 4, short_coverage: float = 1.0) -> Column:
    """clauses: array of folded texts; word_counts: array<int> beside them."""

    @F.pandas_udf(SENTENCE_TYPE)
    def run(c: pd.Series, n: pd.Series, o: pd.Series) -> pd.DataFrame:
        scored = lambda rows: sentence_fidelities([(list(x), [int(i) for i in k], y) for x, k, y in rows], least, least_score, short_words, short_coverage)
        rows = _rows(scored, c, n, o.fillna(""))
        return pd.DataFrame(rows, columns=[f.split(":")[0] for f in SENTENCE_TYPE[7:-1].replace("array<double>", "x").replace("array<int>", "x").split(",")])

    return run(clauses, word_counts, observed)


def script_scores_of(texts: Column, lines: Column) -> Column:
    """For each of an array of folded texts, its similarities to an array of folded lines."""

    @F.pandas_udf("array<array<double>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        held: dict = {}
        out = []
        for said, script in zip(x, y):
            key = tuple(script)
            if key not in held:
                held = {key: Lines(list(key))}
            out.append([held[key].similarities(t).tolist() for t in said])
        return pd.Series(out)

    return run(texts, lines)
