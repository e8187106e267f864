"""SimHash near-duplicates that hold a stated Jaccard similarity of sets of shingles, and lose no pair of it.

A text is the set of its shingles' hashes; texts of equal sets are one node, with a SimHash of 256 bits over the set.

1. Two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each, n being its size, in
   any order that all sets use. The order here puts shingles that many sampled documents hold last, the rest by
   their hash. The order decides only how many nodes meet, never which links are found.
2. Nodes that share such a shingle are compared by bit-sliced SimHash (simhash.links). A pair of similarity 0.8 differs
   in 0.19 of the bits at most, on the mean; RADIUS is 5.8 standard deviations beyond that: fewer than one such
   pair in 10^8 is lost. The links' components hold all similar pairs, and others.
3. Within each component, pairs within the radius are confirmed by the similarity of their whole sets. Sets are
   made for these nodes only, once each; components too large for a task are cut into chunks, compared in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, slices
from .components import components
from .simhash import fingerprint, links, named, shingle_hashes, without_copies

LONGS = 4
RADIUS = 84
LEAST = 0.8  # RADIUS is worked out for similarities from here on
SAMPLED = 16  # one text in so many is sampled for the order
COMMON = (4, 5000)  # a shingle is common if 4 sampled texts hold it, and one in 5000 of them
BROADCAST_NODES = 500_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted as signed longs."""
    return np.unique(shingle_hashes(text, size)[:, 0].view(np.int64))


def set_fingerprint(grams: np.ndarray) -> np.ndarray:
    """LONGS words of SimHash; each word's hashes are the shingles', mixed once more."""
    z = grams.view(np.uint64)[:, None] + np.arange(1, LONGS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return fingerprint(z ^ (z >> np.uint64(31)))


def prefix(grams: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of similarity `least` or more share one."""
    n = len(grams)
    if not n:
        return grams
    keep = n - int(np.ceil(least * n - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, counts[at], 0)
        if rank.any():
            grams = grams[np.lexsort((grams, rank))]
    return grams[:keep]


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))


def _keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many sampled texts hold, sorted, and their counts. At most 5000 times the mean set reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), _lists([shingle_set(t.as_py(), shingle) for t in batch.column("text")])], names=["text_key", "grams"])

    some = texts.where(F.pmod("text_key", F.lit(SAMPLED)) == 0).select("text_key", "text").mapInArrow(run, "text_key bigint, grams array<bigint>")
    some = cut(some.dropDuplicates(["text_key"]))
    enough = max(COMMON[0], some.count() // COMMON[1])
    found = some.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= enough).toArrow()
    gram, count = found["gram"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(gram)
    return gram[order], count[order]


def _sets(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(doc_id, text_key, node, size, fp, prefix): node is a hash of the whole set, by which equal sets are one."""
    common, counts = _common(texts, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            nodes, sizes, fps, prefixes = [], [], [], []
            for text in batch.column("text"):
                grams = shingle_set(text.as_py(), shingle)
                nodes.append(xxhash.xxh3_64_intdigest(grams.tobytes()))
                sizes.append(len(grams))
                fps.append(set_fingerprint(grams).view(np.int64))
                prefixes.append(prefix(grams, least, common, counts))
            arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(fps), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "size", "fp", "prefix"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_key bigint, node bigint, size int, fp array<bigint>, prefix array<bigint>")


def _meeting(nodes: DataFrame) -> DataFrame:
    """(key, node): the lists of two nodes or more that share a shingle of their prefixes; of equal lists, one."""
    held = nodes.select(F.explode("prefix").alias("key"), "node")
    shared = held.groupBy(F.col("key").alias("of")).count().where("count > 1").select("of")
    held = cut(held.join(shared, F.col("key") == F.col("of"), "left_semi"))
    lists = held.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    lists = lists.groupBy("n", "x", "y").agg(F.min("key").alias("of")).select("of")
    return held.join(lists, F.col("key") == F.col("of"), "left_semi")


def _confirmed(texts: DataFrame, loose: DataFrame, nodes: DataFrame, shingle: int, least: float, chunk: int) -> DataFrame:
    """(a, b): the links within the components loose (node, root) of nodes whose whole sets have the similarity."""
    members = loose.select(F.col("node.node").alias("of"), F.xxhash64("root").alias("key"))
    wanted = cut(nodes.join(members, F.col("node") == F.col("of")).select("key", "name", "fp", F.col("text_key").alias("of_key")))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    rows = texts.select("text_key", "text").join(wanted, F.col("text_key") == F.col("of_key")).dropDuplicates(["text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            grams = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("name"), batch.column("fp"), pa.array([len(g) for g in grams], pa.int32()), _lists(grams)], names=["key", "node", "fp", "size", "grams"])

    kind = nodes.schema["name"].dataType.simpleString()
    sets = cut(rows.select("key", "name", "fp", "text").mapInArrow(run, f"key bigint, node {kind}, fp array<bigint>, size int, grams array<bigint>"))
    return links(sets, RADIUS, max(2, chunk // 4), least)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = LEAST, chunk: int = 4096) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest id reachable over pairs of similarity `least` or more.

    Exact but for collisions of 64-bit hashes and the loss stated above. Texts without a word have the empty set, which is
    similar to itself alone; texts of fewer words than a shingle are one shingle. Repeated rows are kept, one result row
    each. A null id stays null; its component_id is the smallest non-null id reachable, or null if there is none. An
    empty table gives no rows; other columns aren't read.
    """
    if not LEAST <= least <= 1:
        raise ValueError(f"least must be from {LEAST} to 1")
    texts = _keyed_texts(docs, id_col, text_col)
    sets = cut(_sets(texts, shingle, least))
    one = sets.groupBy("node").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"))
    nodes = cut(one.join(named("node", sets), "node"))
    met = _meeting(nodes).join(nodes.select(F.col("node").alias("of_node"), "name", "fp", "size"), F.col("node") == F.col("of_node"))
    loose = cut(components(links(met.select("key", F.col("name").alias("node"), "fp", "size"), RADIUS, chunk, least)))
    roots = cut(components(_confirmed(texts, loose, nodes, shingle, least, chunk)))
    moved = roots.select(F.col("node.node").alias("of_node"), F.col("root.id").alias("root_id"))
    ids = nodes.select("node", F.col("name.id").alias("least_id")).join(moved, F.col("node") == F.col("of_node"), "left").select(F.col("node").alias("of"), F.coalesce("root_id", "least_id").alias("component_id"))
    return sets.select("doc_id", "node").join(ids, F.col("node") == F.col("of")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = LEAST, chunk: int = 4096) -> DataFrame:
    """The documents without those that a document with a smaller id is linked to; columns as given.

    Rows with a null id are kept unless an id reachable from them is known. Rows that repeat an id are
    one document: they stay or go together.
    """
    return without_copies(docs, id_col, similar_components(docs, id_col, text_col, shingle, least, chunk))
