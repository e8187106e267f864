"""Exact token counts of texts of any length by overlap resynchronisation.

A long text is encoded in overlapping chunks whose tokens carry code-point offsets. Chunks are spliced at an offset
where both have a token boundary and that is proven stable: no piece of the vocabulary holds the two characters
beside it next to each other, so no merge can ever cross it and what stands on one side can't change the other.
Where a chunk has no such boundary in its overlap, or the next chunk doesn't have the boundary too, overlaps are
doubled and the chunk is encoded again, in the last resort as one chunk to the end of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

SPACE = "▁"  # what stands for a space in the pieces


class PieceCounter:
    """Counts the tokens that a sentencepiece model gives, as its encode() without options does."""

    def __init__(self, path: str, chunk: int = 4096, overlap: int = 64):
        import sentencepiece

        if chunk < 2 * overlap or overlap < 2:
            raise ValueError("a chunk must hold two overlaps, an overlap two characters")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        n = self.model.get_piece_size()
        self.length, self.tail = np.ones(n, np.int64), np.zeros(n, bool)
        self.joined: set[str] = set()
        for i in range(n):
            if self.model.is_byte(i):
                self.tail[i] = 0x80 <= int(self.model.id_to_piece(i)[3:5], 16) < 0xC0
                self.length[i] = not self.tail[i]
            elif not self.model.is_control(i) and not self.model.is_unknown(i):
                piece = self.model.id_to_piece(i)
                self.length[i] = len(piece)
                self.joined.update(map("".join, zip(piece, piece[1:])))
        # Offsets hold only if pieces spell the text out, one prefix before it.
        probe = self._starts(self.model.encode(" a▁b\n ☃\U0001f600z "))
        self.spelled = probe[0] == -1 and probe[-1] == 9 and self.model.encode("") == []
        self.retries = 0

    def _starts(self, ids: list[int]) -> np.ndarray:
        """Offsets of the tokens' first characters, the prefix at -1; the bytes of a character share one."""
        a = np.asarray(ids, np.int64)
        return np.cumsum(self.length[a]) - np.where(self.tail[a], 1, self.length[a]) - 1

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.spelled:
            return len(self.model.encode(text))
        total = at = 0  # what stands before `at` is counted; `at` is a proven boundary
        back, size = self.overlap, self.chunk
        while True:
            begin, end = max(0, at - back), min(len(text), at + size)
            starts = self._starts(self.model.encode(text[begin:end])) + begin
            first = int(np.searchsorted(starts, at)) if at else 0
            if at and starts[first : first + 1].tolist() != [at]:
                back, self.retries = 2 * back, self.retries + 1  # not aligned: look further back
                continue
            if end == len(text):
                return total + len(starts) - first
            for k in range(len(starts) - 1, first, -1):
                p = int(starts[k])
                if p < end - (size - self.chunk + self.overlap) or p <= at:
                    k = first
                    break
                if starts[k - 1] < p and self.stable(text, p):
                    break
            else:
                k = first
            if k == first:
                size, self.retries = 2 * size, self.retries + 1  # no boundary in the overlap: widen
                continue
            total += k - first
            at, back, size = int(starts[k]), self.overlap, self.chunk

    def counts(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.count(t)
        return out


@lru_cache(maxsize=4)
def piece_counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(path, chunk, overlap)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = 4096, overlap: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs, whatever its id.

    model_path is a path that every executor has. Null text counts as empty: no bytes, no tokens. Begin, end and
    other special tokens aren't added; their strings inside a text are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path, chunk, overlap)
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = np.array(counter.counts(texts), np.int64)
            size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
