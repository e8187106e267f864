"""Word n-grams of a bounded set of texts, looked up in documents with numpy; alignment of word sequences."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"\w+")
SHIFT = 32  # a cell holds its score above these bits and where its path begins below
LOW = (1 << SHIFT) - 1


def plain_words(text: str | None) -> list[str]:
    """Words are cut before they are folded, so the k-th word is the k-th match of WORD in the text."""
    if not text:
        return []
    return WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in WORD.findall(text)]


class GramIndex:
    """The n-grams of some texts. Words that no text has are 0, and so is every gram that holds one."""

    def __init__(self, texts: list[list[str]], n: int):
        self.n = n
        self.number: dict[str, int] = {}
        for t in texts:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        if (len(self.number) + 1) ** min(n, 3) >= 1 << 62 or n > 3:
            raise ValueError("n is at most 3, and with n of 3 the texts' words must be fewer than 1.6 million")
        self.ids = [self.numbers(t) for t in texts]
        self.grams = [self.keys(i) for i in self.ids]
        self.known = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.int64)
        self.known = self.known[self.known > 0]

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in words], np.int64)

    def keys(self, ids: np.ndarray, n: int | None = None) -> np.ndarray:
        """A number for each gram; texts of fewer words than n have their whole sequence as one gram.

        Grams of different lengths never share a number.
        """
        n = min(n or self.n, len(ids))
        if not n:
            return np.zeros(0, np.int64)
        size = len(ids) - n + 1
        key, whole = np.zeros(size, np.int64), np.ones(size, bool)
        for k in range(n):
            part = ids[k : k + size]
            key = key * (len(self.number) + 1) + part
            whole &= part > 0
        return np.where(whole, key, 0)

    def find(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the grams of ids that `among`, sorted, holds, and their places in it."""
        found = []
        for n in sorted({self.n, *([k for k in range(1, self.n)] if self.short else [])}):
            if len(ids) < n:
                continue
            key = self.keys(ids, n)
            at = np.flatnonzero(key)
            if len(at) and len(among):
                place = np.minimum(np.searchsorted(among, key[at]), len(among) - 1)
                hit = among[place] == key[at]
                found.append((at[hit], place[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    @property
    def short(self) -> bool:
        return any(0 < len(i) < self.n for i in self.ids)


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word numbers, 0 matching nothing: score, and its begin and end in b.

    Two rows are held at a time: a cell carries where its path begins. Of paths of one score the later begin wins.
    """
    m = len(b)
    fresh = np.arange(m + 1, dtype=np.int64)  # score 0, begun here
    ramp = (-gap * np.arange(m + 1, dtype=np.int64)) << SHIFT
    above, best = fresh, (0, 0, 0)
    for word in a.tolist():
        row = np.maximum(above + (gap << SHIFT), fresh)
        if word:
            score = np.where(b == word, match, mismatch) << SHIFT
        else:
            score = np.full(m, mismatch << SHIFT, np.int64)
        row[1:] = np.maximum(row[1:], above[:-1] + score)
        row = np.maximum(np.maximum.accumulate(row + ramp) - ramp, fresh)  # gaps along the row
        row = np.where(row >> SHIFT > 0, row, fresh)
        end = int(np.argmax(row >> SHIFT))
        if (top := int(row[end])) >> SHIFT > best[0]:
            best = (top >> SHIFT, top & LOW, end)
        above = row
    return best


def banded_matches(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched, first, last): words of a matched in order with words of b, low <= j - i <= high, as many as can be.

    first and last are the places in b of the first and last match: the earliest last, and the latest first to it.
    """
    n, width = len(a), high - low + 1
    x = np.arange(low, low + n + width)
    near = np.where((x >= 0) & (x < len(b)), b[np.clip(x, 0, max(0, len(b) - 1))], 0) if len(b) else np.zeros(len(x), np.int64)
    above, best = np.zeros(width + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(a.tolist()):
        part = near[i : i + width]
        more = above[:width]
        more = np.where(more > 0, more, x[i : i + width] + 1) + (1 << SHIFT)
        row = np.maximum(above[1:], np.where((part == word) & (part > 0), more, 0))
        row = np.maximum.accumulate(row)
        if (top := int(row[-1]) >> SHIFT) > best[0]:
            k = int(np.searchsorted(row, top << SHIFT))
            best = (top, (int(row[k]) & LOW) - 1, i + low + k)
        above[:width] = row
    return best
