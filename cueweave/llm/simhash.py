"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where over half the hashes of its shingles have it. Equal fingerprints are
one node. Nodes meet in tables of keys cut from their fingerprints; within a key, all pairs at a distance s in the
sorted order are compared at once: bit planes hold one bit of 64 nodes a word, the planes shifted by s are XORed,
carry-save adders count the differing bits of every lane, and words whose lanes all exceed the radius are
abandoned. Each key passes on a spanning forest of its links (at most one link a node), never all pairs.

Two ways to choose keys:

* split_keys: exact for radius 3 of 64 bits. Four blocks of 16 bits, of which one must agree; the other 48 bits
  are again four parts of 12, of which one must agree: 16 keys of 28 bits.
* sampled_keys: for wide fingerprints and large radii. `tables` fixed samples of `key_bits` bits; a pair with a
  share p of differing bits is met with probability 1 - (1 - (1-p)^key_bits)^tables.

Keys with more than `chunk` nodes are cut into chunks, and pairs of chunks are compared in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices, words
from .components import components

SEED = 42


def shingle_hashes(text: str | None, size: int, seeds: tuple[int, ...] = (SEED,)) -> np.ndarray:
    """XXH64 of every shingle, repeats included: [shingles, seeds]. Fewer words than size: the whole sequence."""
    w = words(text.translate(_LOWER) if text and not text.isascii() else text.lower() if text else text)
    if not w:
        return np.zeros((0, len(seeds)), np.uint64)
    if len(w) <= size:
        s = [b" ".join(w)]
    else:
        s = list(map(b" ".join, zip(*(w[i:] for i in range(size)))))
    digest = xxhash.xxh64_intdigest
    return np.array([[digest(x, seed) for x in s] for seed in seeds], np.uint64).T


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit word a seed; zero without shingles."""
    n = len(hashes)
    if not n:
        return np.zeros(hashes.shape[1], np.uint64)
    out = []
    for column in hashes.T:
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = np.ascontiguousarray(column[at : at + (1 << 16)])
            counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, width: int = 64) -> DataFrame:
    """(doc_id, fp array<bigint>): width / 64 words a document, as signed longs. Null text counts as empty: all zero."""
    if width % 64 or width <= 0:
        raise ValueError("width must be a multiple of 64")
    seeds = tuple(SEED + i for i in range(width // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle, seeds)).view(np.int64) for t in batch.column("text")]
            flat = pa.array(np.concatenate(fps))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(seeds), dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "fp"])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp array<bigint>")


def planes_of(fps: np.ndarray, pad: int) -> np.ndarray:
    """[bits, words] of the fingerprints [n, longs], lane i of a plane being bit i % 64 of word i // 64."""
    n, longs = fps.shape
    lanes = -(-(n + pad) // 64) * 64
    bits = np.zeros((lanes, longs * 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is above the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for b in range(len(counters) - 1, -1, -1):
        if radius >> b & 1:
            equal &= counters[b]
        else:
            above |= equal & counters[b]
            equal &= ~counters[b]
    return above


def _lanes(mask: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(-(-total // 64) * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def pairs_at(planes: np.ndarray, valid: np.ndarray, shift: int, radius: int, step: int = 16) -> np.ndarray:
    """Lanes i for which rows i and i + shift, where valid[i] is set, differ in at most radius bits."""
    words_at, bits = divmod(shift, 64)
    where = np.flatnonzero(_lanes(valid, planes.shape[1] * 64))
    alive = _lanes(valid, planes.shape[1] * 64)[where]
    nbits = planes.shape[0]
    counters: list[np.ndarray] = [np.zeros(len(where), np.uint64) for _ in range(nbits.bit_length())]
    last = planes.shape[1] - 1
    done = 0
    while done < nbits and len(where):
        part = planes[done : done + step]
        low = part[:, np.minimum(where + words_at, last)]
        if bits:
            low = (low >> np.uint64(bits)) | (part[:, np.minimum(where + words_at + 1, last)] << np.uint64(64 - bits))
        differ = part[:, where] ^ low
        for k in range(0, len(differ) - 1, 2):  # two planes and the lowest counter bit in one full adder
            x, y, z = differ[k], differ[k + 1], counters[0]
            xy = x ^ y
            counters[0] = xy ^ z
            carry = (x & y) | (xy & z)
            for b in range(1, (done + k + 2).bit_length()):
                counters[b], carry = counters[b] ^ carry, counters[b] & carry
        done += len(differ)
        alive &= ~_over(counters, radius)
        keep = alive != 0
        if not keep.all():
            where, alive, counters = where[keep], alive[keep], [c[keep] for c in counters]
    if not len(where):
        return where
    found = np.unpackbits(alive.view(np.uint8), bitorder="little").reshape(-1, 64)
    word, lane = np.nonzero(found)
    return where[word] * 64 + lane


def links_in_runs(
    keys: np.ndarray,
    fps: np.ndarray,
    radius: int,
    allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """A spanning forest of the links within runs of equal keys: [links, 2] of row numbers. keys are sorted.

    allowed says for arrays of row numbers which pairs within the radius are links. A run that is joined is compared no
    more.
    """
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[starts, n])
    multiple = np.repeat(length > 1, length)
    if not multiple.any():
        return np.zeros((0, 2), np.int64)
    origin = np.flatnonzero(multiple)
    fps, length = fps[origin], length[length > 1]
    order = np.argsort(-length, kind="stable")  # long runs first: later shifts see a prefix only
    begin = np.r_[0, np.cumsum(length)[:-1]]
    take = np.concatenate([np.arange(begin[r], begin[r] + length[r]) for r in order])
    origin, fps, length = origin[take], fps[take], length[order]
    begin, n = np.r_[0, np.cumsum(length)[:-1]], len(origin)
    run = np.repeat(np.arange(len(length)), length)
    left = begin[run] + length[run] - np.arange(n)  # rows of the run from here on
    missing = length - 1  # links that would join the run
    planes = planes_of(fps, 64)
    label, out = np.arange(n), []
    for shift in range(1, int(length[0])):
        rows = int(np.searchsorted(-length, -shift, side="left"))
        rows = int(begin[rows]) if rows < len(begin) else n
        valid = left[:rows] > shift
        if not valid.any():
            continue
        i = pairs_at(planes[:, : -(-(rows + 64) // 64)], valid, shift, radius)
        i = i[label[i] != label[i + shift]]
        if allowed is not None and len(i):
            i = i[allowed(origin[i], origin[i + shift])]
        for a in i.tolist():
            ra, rb = _root(label, a), _root(label, a + shift)
            if ra != rb:
                label[max(ra, rb)] = min(ra, rb)
                out.append((a, a + shift))
                missing[run[a]] -= 1
                if not missing[run[a]]:
                    left[begin[run[a]] : begin[run[a]] + length[run[a]]] = 0
        if len(i):
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return origin[np.array(out, np.int64).reshape(-1, 2)]


def _root(label: np.ndarray, x: int) -> int:
    while label[x] != x:
        x = label[x]
    return int(x)


def starred(found: np.ndarray, n: int) -> np.ndarray:
    """The links of a forest of n rows, each row linked to its tree's least row: chains would cost rounds later."""
    label = np.arange(n)
    for a, b in found.tolist():
        ra, rb = _root(label, a), _root(label, b)
        label[max(ra, rb)] = min(ra, rb)
    while not (label[label] == label).all():
        label = label[label]
    rows = np.flatnonzero(label != np.arange(n))
    return np.stack([label[rows], rows], 1)


def split_keys(fp: Column) -> Column:
    """16 keys of 28 bits for radius 3 of one 64-bit word."""
    word = F.element_at(fp, 1)
    cut_at = lambda at, size: F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << size) - 1))
    keys = []
    for block in range(4):
        rest = [p for p in range(64) if not 16 * block <= p < 16 * block + 16]
        for part in range(4):
            mine = rest[12 * part : 12 * part + 12]
            if mine[-1] - mine[0] == 11:
                sub = cut_at(mine[0], 12)
            else:
                k = next(i for i in range(1, 12) if mine[i] != mine[i - 1] + 1)
                sub = F.shiftleft(cut_at(mine[0], k), 12 - k).bitwiseOR(cut_at(mine[k], 12 - k))
            keys.append(F.shiftleft(F.lit(len(keys)).cast("long"), 28).bitwiseOR(F.shiftleft(cut_at(16 * block, 16), 12)).bitwiseOR(sub))
    return F.array(*keys)


def sampled_keys(width: int, tables: int = 32, key_bits: int = 16) -> Callable[[np.ndarray], np.ndarray]:
    """A function from fingerprints [n, longs] to keys [n, tables], each of key_bits bits drawn once from all of them.

    Not an expression: one of tables times key_bits terms would burden every plan that holds it.
    """
    draw = np.random.default_rng(SEED)
    spots = [np.sort(draw.choice(width, key_bits, replace=False)) for _ in range(tables)]
    weight = 1 << np.arange(key_bits, dtype=np.int64)

    def keys(fps: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
        return np.stack([(t << 32) + bits[:, at].astype(np.int64) @ weight for t, at in enumerate(spots)], 1)

    return keys


def with_keys(nodes: DataFrame, keys: Column | Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(node, fp, key): a row for each of nodes (node, fp) and key."""
    if isinstance(keys, Column):
        return nodes.select("node", "fp", F.explode(keys).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                found = keys(batch.column("fp").flatten().to_numpy().reshape(batch.num_rows, -1))
                take = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(take), batch.column("fp").take(take), pa.array(found.ravel())], names=["node", "fp", "key"])

    return nodes.select("node", "fp").mapInArrow(run, f"node {nodes.schema['node'].dataType.simpleString()}, fp array<bigint>, key bigint")


def similar_forest(sets: list[np.ndarray], fps: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets, none empty, within the radius whose Jaccard similarity is `least` or more.

    A set is held against all later ones that no link joins to it yet, in one pass over their members.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts, mine = ends - sizes, np.zeros(int(number.max()) + 1, np.int32)
    words = fps.view(np.uint64)
    label, out = np.arange(n), []
    for i in range(n - 1):
        later = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        later = later[(sizes[later] >= least * sizes[i] - 1e-9) & (sizes[i] >= least * sizes[later] - 1e-9)]
        later = later[np.bitwise_count(words[later] ^ words[i]).sum(1) <= radius]
        if not len(later):
            continue
        own = number[starts[i] : ends[i]]
        mine[own] = 1
        members = np.concatenate([number[starts[j] : ends[j]] for j in later.tolist()])
        shared = np.add.reduceat(mine[members], np.cumsum(sizes[later]) - sizes[later])
        mine[own] = 0
        for j in later[shared >= least * (sizes[i] + sizes[later] - shared) - 1e-9].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def links(keyed: DataFrame, radius: int, chunk: int = 4096, least: float | None = None) -> DataFrame:
    """keyed (key, node, fp), distinct. Returns (a, b): for each key, the nodes that its links join, each with one of them.

    With least, keyed has size, and nodes whose sizes' quotient is below least aren't linked. Where keyed also has
    grams array<bigint>, sorted sets, two nodes are linked only if these sets have a Jaccard similarity of least.
    A key holds as many nodes at a time as weigh chunk: a node weighs 1, or with grams 1 + size / 512.
    """
    kind, confirmed = keyed.schema["node"].dataType.simpleString(), "grams" in keyed.columns
    weight = F.lit(1.0) + F.col("size") / 512 if confirmed else F.lit(1.0)
    hot = keyed.groupBy("key").agg(F.sum(weight).alias("weight")).where(F.col("weight") > chunk)
    hot = hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("weight") / chunk).cast("int").alias("chunks"))
    keyed = keyed.join(hot, F.col("key") == F.col("hot_key"), "left")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c, mine) * F.col("chunks") + F.greatest(c, mine))
    )
    keyed = keyed.withColumn("part", F.explode(meets)).drop("hot_key", "chunks")
    keyed = keyed.withColumn("at", F.xxhash64("key", "part")).drop("key", "part").repartition("at").sortWithinPartitions("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            column = lambda c: rows[c].chunk(0)
            fps = column("fp").flatten().to_numpy().reshape(rows.num_rows, -1)
            at = column("at").to_numpy()
            if confirmed:
                flat, ends = column("grams").flatten().to_numpy(), np.cumsum(column("size").to_numpy())
                sets, pairs = np.split(flat, ends[:-1]), []
                for mine in np.split(np.arange(len(at)), np.flatnonzero(at[1:] != at[:-1]) + 1):
                    if len(mine) > 1:
                        pairs += [(mine[i], mine[j]) for i, j in similar_forest([sets[i] for i in mine], fps[mine], radius, least)]
                found = np.array(pairs, np.int64).reshape(-1, 2)
            else:
                sizes = None if least is None else column("size").to_numpy()
                allowed = None if least is None else lambda i, j: np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-9
                found = links_in_runs(at, fps, radius, allowed)
            found = starred(found, rows.num_rows)
            return pa.RecordBatch.from_arrays([column("node").take(pa.array(found[:, 0])), column("node").take(pa.array(found[:, 1]))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy()
            changes = np.flatnonzero(at[1:] != at[:-1]) + 1
            if held and held[-1].column("at")[-1].as_py() != at[0]:
                changes = np.r_[0, changes]
            # A run may go on in the next batch: cut only where one ends, whenever enough rows or bytes are held.
            begin, rows, size = 0, sum(b.num_rows for b in held), sum(b.nbytes for b in held)
            each = batch.nbytes / batch.num_rows
            for end in changes.tolist():
                if rows + end - begin >= 1 << 14 or size + (end - begin) * each >= 1 << 25:
                    if end > begin:
                        held.append(batch.slice(begin, end - begin))
                    if held:
                        yield compare()
                    begin, rows, size = end, 0, 0
            held.append(batch.slice(begin))
        if held:
            yield compare()

    return keyed.mapInArrow(run, f"a {kind}, b {kind}")


def named(node: str, docs: DataFrame) -> DataFrame:
    """docs (doc_id, `node`, ...): (node, name), name being the node's least id, null last, before the node itself.

    Names are distinct and in the order of ids, so the root of a component of names holds the component's least id.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("least")
    return docs.groupBy(node).agg(least).select(node, F.struct("least.no_id", "least.id", node).alias("name"))


def near_duplicate_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    width: int = 64,
    radius: int = 3,
    tables: int = 32,
    key_bits: int = 16,
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of at most radius bits.

    width 64 with radius 3 or less is exact; wider fingerprints or larger radii use sampled keys. Null and empty
    texts have the fingerprint zero and link like any other. Repeated rows are kept, one result row each. A null id
    stays null; its component_id is the smallest non-null id reachable, or null if there is none. An empty table
    gives no rows; other columns aren't read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle, width))
    nodes = cut(named("fp", fps))
    keys = split_keys(F.col("fp")) if width == 64 and radius <= 3 else sampled_keys(width, tables, key_bits)
    found = links(with_keys(nodes.select(F.col("name").alias("node"), "fp"), keys), radius)
    roots = cut(components(found))
    by_fp = nodes.join(roots, F.col("name") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("root.id", "name.id").alias("component_id"))
    return fps.join(by_fp, F.col("fp") == F.col("of_fp"), "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents without those that a document with a smaller id is linked to; columns as given.

    Rows with a null id are kept unless an id reachable from them is known. Rows that repeat an id are
    one document: they stay or go together.
    """
    return without_copies(docs, id_col, near_duplicate_components(docs, id_col, **how))


def without_copies(docs: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """The rows of docs whose id is its component's in found (doc_id, component_id), or null."""
    if docs.schema[id_col].dataType.simpleString() == "void":
        return docs
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
