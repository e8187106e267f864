"""Secret scans: rules for known shapes, and a token-efficiency test for random strings.

A tokenizer's vocabulary is made of frequent strings, so ordinary words take few tokens a character and random ones
many. A run of ASCII key characters with few characters a token is reported as a secret of kind `random`, unless it
is a known digest or identifier or lies within a span that a rule found. A date before it isn't counted, and what has
the shape of words must have still fewer characters a token, as a whole or in a part of 20 characters or more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{20,}(?![\w+/=-])")
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Strings that look random and aren't secrets: digests of the usual lengths, UUIDs, numbers, timestamps, ...
KNOWN = (
    re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I),
    re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_=][A-Za-z0-9+/=_-]+\Z", re.I),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I),
    re.compile(r"[0-9+/=_-]+\Z"),  # numbers, dates, rules
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9]{2}(?:[_-]?[0-9]{2}){0,2}(?:[_-]?[0-9]{1,9})?(?:[_-]?[A-Z]{1,4}|[+-][0-9]{2}[_-]?[0-9]{2})?\Z"),  # timestamps
)

#: What has the shape of words. Invented and compound words have 2.2 characters a token and more, random letters 1.9 and less.
WORDS = (
    re.compile(r"[A-Za-z_/=+-]*[0-9]{0,4}\Z"),  # words, joined or not, numbered or not
    re.compile(r"(?:[A-Za-z]{2,}[0-9]{0,3}[_/=+-]+)+[A-Za-z]{2,}[0-9]{0,4}\Z"),  # part1_part2
)
WORDS_SHARE = 0.85  # of most_ratio
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]")
JOINT = re.compile(r"[_/=+-]+")
LEAST = 20


@lru_cache(maxsize=2)
def ranks_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans: leftmost, non-overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], encode, most_ratio: float) -> list[tuple[int, int, int]]:
    found = []
    covered: list[list[int]] = []  # the rules' spans, merged, in order
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    at = 0
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        run = m.group()
        if (at < len(covered) and covered[at][0] < end) or any(k.match(run) for k in KNOWN):
            continue
        run = DATE.sub("", run, count=1) if DATE.match(run) else run
        if len(run) < LEAST or any(k.match(run) for k in KNOWN):
            continue
        ratio, parts = most_ratio, [run]
        if any(w.match(run) for w in WORDS):
            ratio *= WORDS_SHARE
            parts += [p for p in JOINT.split(run) if LEAST <= len(p) < len(run)]
        if any(len(p) <= ratio * len(encode(p)) for p in parts):
            found.append((start, 3, end))
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", most_ratio: float = 2.4) -> DataFrame:
    """A row for each row of docs: counts by kind, the rules' spans as a digest, and all spans with their strings.

    most_ratio: characters a token at most, for a run of 20 or more key characters to count as random. Null text
    counts as empty; rows that repeat are scanned each; an empty table gives no rows; other columns aren't read. Spans
    are in code points, end exclusive; `found` holds the matched strings in the order of spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ranks_encoding(ranks_path).encode_ordinary
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, encode, most_ratio)
                spans = sorted(base + more)
                kinds = [k for _, k, _ in spans]
                row = [*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), [text[s:e] for s, _, e in spans]]
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string, found array<string>")
