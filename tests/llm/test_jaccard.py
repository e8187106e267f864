import numpy as np

import corpus_pipeline
from cueweave.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in ((a or "").lower().split(), (b or "").lower().split()))
    return len(a & b) / max(1, len(a | b))


def kept_by_brute_force(texts, least=0.8):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if label[a] != label[b] and similarity(texts[a], texts[b]) >= least:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return {i for i, x in enumerate(label) if i == x}


def edited(base, edits, draw):
    copy = list(base)
    for at in draw.choice(len(copy), edits, replace=False):
        copy[at] = f"edit{draw.integers(10**9)}"
    return " ".join(copy)


def near_copies():
    """Groups of copies whose similarities lie on both sides of 0.8, and a passage that many share."""
    draw = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(2000)]
    passage = " ".join(draw.choice(vocab, 20))
    texts = []
    for n in (8, 40, 120, 240, 240, 600):
        base = list(draw.choice(vocab, n))
        texts += [" ".join(base)] + [edited(base, int(draw.integers(0, n // 18 + 2)), draw) for _ in range(12)]
    return texts + [" ".join(draw.choice(vocab, 60)) + " " + passage for _ in range(60)] + ["one two", "one two", "One TWO three"]


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_copies_below_the_stated_similarity_stay(spark):
    draw = np.random.default_rng(4)
    texts = []
    for _ in range(20):  # 7 edits far apart in 200 words: Jaccard about 0.7
        base = [f"w{k}" for k in draw.choice(5000, 200)]
        copy = list(base)
        for at in range(10, 200, 27):
            copy[at] = f"edit{draw.integers(10**9)}"
        texts += [" ".join(base), " ".join(copy)]
    assert all(0.65 < similarity(a, b) < 0.75 for a, b in zip(texts[::2], texts[1::2]))
    assert stage(spark, texts) == set(range(40))


def test_repeated_passages_count_once(spark):
    draw = np.random.default_rng(5)
    texts = []
    for _ in range(20):
        base = [f"w{k}" for k in draw.choice(5000, 240)]
        texts += [" ".join(base), " ".join(base + base[100:130] * 4)]
    assert all(similarity(a, b) > 0.95 for a, b in zip(texts[::2], texts[1::2]))
    assert stage(spark, texts) == set(range(0, 40, 2))


def test_every_pair_at_the_stated_similarity_is_linked(spark, monkeypatch):
    texts = near_copies()
    want = kept_by_brute_force(texts)
    assert 70 < len(want) < len(texts) - 20
    assert stage(spark, texts) == want
    monkeypatch.setattr(jaccard, "SAMPLED", 1)  # the shared passage is common then
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    for chunk in (4, 1024):
        rows = jaccard.similar_components(docs, chunk=chunk).collect()
        assert {r["doc_id"] for r in rows if r["doc_id"] == r["component_id"]} == want
        assert [r["component_id"] for r in rows if r["doc_id"] is None] == [0]


def test_sets_at_the_bound_stay_within_the_radius():
    draw = np.random.default_rng(7)
    far = []
    for n in (4, 5, 9, 12, 20, 45, 90, 200):
        for _ in range(200):
            shared = draw.integers(-(1 << 63), 1 << 63, n)
            more = draw.integers(-(1 << 63), 1 << 63, n // 4)  # n of 1.25 n: similarity 0.8
            half = len(more) // 2
            for a, b in ((shared, np.r_[shared, more]), (np.r_[shared, more[:half]], np.r_[shared, more[half:]])):
                fps = [jaccard.set_fingerprint(np.unique(x)) for x in (a, b)]
                far.append(int(np.unpackbits((fps[0] ^ fps[1]).view(np.uint8)).sum()))
    assert max(far) <= jaccard.RADIUS - 5


def test_empty_tables_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, node string, prefix int, text_key int, name int"
    assert jaccard.keep_one(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(4, long, "x", 1, 1, 1), (2, long + " end", None, 2, 2, 2), (None, long, None, None, None, None), (7, None, "", 0, 0, 0), (8, None, "", 0, 0, 0), (9, "", "", 0, 0, 0), (2, "other words", "", 0, 0, 0)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, schema).repartition(3))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "2", "7", "None"] and kept.columns == ["doc_id", "text", "node", "prefix", "text_key", "name"]
