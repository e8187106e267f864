import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueweave.llm import simhash
from cueweave.llm.components import components


def brute_fingerprint(text, size=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lower.encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius):
    ids = sorted(fps)
    label = {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def texts():
    draw = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    out = [None, "", "  \t\n", "one", "One TWO", "É é two three four"]
    for _ in range(25):
        base = list(draw.choice(vocab, 200))
        out.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            copy[int(draw.integers(200))] = "edit"
            out.append(" ".join(copy))
    return [*out, out[8], "a " * 40_000]


def test_fingerprints_and_components_match_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int").repartition(5)
    got = {r["doc_id"]: r for r in simhash.near_duplicate_components(docs).collect()}
    want = {i: brute_fingerprint(t) for i, t, *_ in rows}
    assert {i: r["fp"][0] & (1 << 64) - 1 for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(want, 3)
    assert len(set(brute_components(want, 3).values())) < len(rows) - 50


@pytest.mark.parametrize(("width", "radius", "runs"), [(64, 3, (1, 2, 3, 200, 70)), (256, 40, (130, 1, 5)), (64, 17, (65, 64, 2))])
def test_bit_sliced_links_join_what_distances_join(width, radius, runs):
    draw = np.random.default_rng(1)
    keys, fps = [], []
    for k, n in enumerate(runs):
        centre = draw.integers(0, 2, (max(1, n // 20), width))
        pick = centre[draw.integers(0, len(centre), n)]
        flips = draw.random((n, width)) < radius / width * 0.6
        fps.append(pick ^ flips)
        keys += [k] * n
    bits = np.concatenate(fps).astype(np.uint8)
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    got = simhash.links_in_runs(np.array(keys), words, radius)
    far = (bits[:, None, :] != bits[None]).sum(2)
    same = np.array(keys)[:, None] == np.array(keys)[None]
    close = (far <= radius) & same
    assert all(close[a, b] for a, b in got)

    def classes(pairs):
        label = list(range(len(keys)))
        for _ in range(len(keys)):
            before = list(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    assert classes(got.tolist()) == classes(np.argwhere(close).tolist())
    assert len(got) == len(keys) - len(set(classes(got.tolist())))


def test_stars_join_what_forests_join():
    draw = np.random.default_rng(4)
    chain = np.array([(i, i + 1) for i in range(500)] + [(700, 600), (650, 700), (800, 650)])
    found = simhash.starred(draw.permutation(chain), 900)
    assert sorted(map(tuple, found.tolist())) == [(0, i) for i in range(1, 501)] + [(600, i) for i in (650, 700, 800)]
    assert simhash.starred(np.zeros((0, 2), np.int64), 3).shape == (0, 2)


def test_hot_keys_are_cut_into_chunks_without_losing_links(spark):
    draw = np.random.default_rng(2)
    fps = sorted({int(sum(1 << int(b) for b in draw.choice(20, 3, replace=False))) for _ in range(400)})
    nodes = spark.createDataFrame([(f, [f]) for f in fps], "node long, fp array<long>")
    found = simhash.links(simhash.with_keys(nodes, simhash.split_keys(F.col("fp"))), 3, chunk=16)
    got = {r["node"]: r["root"] for r in components(found).collect()}
    want = brute_components(dict(enumerate(fps)), 3)
    assert {fps[i]: fps[r] for i, r in want.items() if list(want.values()).count(r) > 1} == got


def test_split_keys_meet_every_pair_within_three_bits(spark):
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a = int(draw.integers(0, 1 << 63)) | int(draw.integers(0, 2)) << 63
        b = a ^ sum(1 << int(k) for k in draw.choice(64, 3, replace=False))
        rows.append(tuple([x - (1 << 64) if x >> 63 else x] for x in (a, b)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    met = df.select(F.arrays_overlap(simhash.split_keys(F.col("a")), simhash.split_keys(F.col("b"))).alias("met"), F.size(F.array_distinct(simhash.split_keys(F.col("a")))).alias("n"))
    assert {(r["met"], r["n"]) for r in met.collect()} == {(True, 16)}


def test_components_of_chains_hubs_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (3, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table_null_ids_and_keep_one(spark):
    schema = T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.near_duplicate_components(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{i}" for i in range(300))
    near = long.replace("word7 ", "other ")
    rows = [(4, long, None, None, None), (2, near, None, "s", 1), (9, "alone here now with some words of its own", None, None, 0), (None, long, None, None, None), (9, "alone here now with some words of its own", None, None, 0)]
    kept = simhash.keep_one(spark.createDataFrame(rows, schema), shingle=5, width=256, radius=46)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 2), (False, 9), (False, 9)]
    assert kept.columns == schema.names
