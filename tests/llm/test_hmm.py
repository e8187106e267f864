import itertools
import math
import zlib
from collections import Counter

import numpy as np

from cueweave.llm import hmm


def small(states=2, symbols=4, seed=0):
    draw = np.random.default_rng(seed)
    part = lambda *n: (lambda x: x / x.sum(-1, keepdims=True))(draw.random(n))
    return hmm.Hmm(part(states), part(states), part(states, states), part(states, symbols).T.copy())


def path_sum(model, obs, first):
    k, total = len(first), 0.0
    for path in itertools.product(range(k), repeat=len(obs)):
        p = first[path[0]] * model.emit[obs[0], path[0]]
        for a, b, o in zip(path, path[1:], obs[1:]):
            p *= model.move[a, b] * model.emit[o, b]
        total += p
    return total


def test_forward_recursion_is_the_sum_over_all_paths():
    model = small()
    docs = [np.array(d) for d in ([0], [1, 2, 3], [3, 3, 0, 1, 2, 2, 1], [2, 0])]
    got = hmm.log10_likelihood(model, docs)
    assert np.allclose(got, [math.log10(path_sum(model, d, model.first)) for d in docs])
    assert np.isclose(sum(10 ** hmm.log10_likelihood(model, [np.array(d)])[0] for d in itertools.product(range(4), repeat=3)), 1)
    assert np.isfinite(hmm.log10_likelihood(model, [np.zeros(50_000, np.int64)])).all()


def test_expected_counts_match_enumeration_and_likelihood_rises():
    model = small(seed=3)
    parts = [(True, np.array([0, 1, 2])), (False, np.array([3, 3, 1, 0])), (True, np.array([2]))]
    got = model.zeros()
    hmm.expected(model, parts, got)
    want = model.zeros()
    for begins, obs in parts:
        first = model.first if begins else model.later
        whole = path_sum(model, obs, first)
        for path in itertools.product(range(2), repeat=len(obs)):
            p = first[path[0]] * model.emit[obs[0], path[0]]
            for a, b, o in zip(path, path[1:], obs[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            (want.first if begins else want.later)[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                want.move[a, b] += p / whole
            for o, s in zip(obs, path):
                want.emit[o, s] += p / whole
    assert np.allclose(got.flat(), want.flat())
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, 2, 30) + 2 * (i % 2) for i in range(40)]
    model, before = small(seed=5), -math.inf
    for _ in range(15):
        now = hmm.log10_likelihood(model, docs).sum()
        assert now >= before - 1e-6
        before, total = now, model.zeros()
        hmm.expected(model, hmm.segments(docs), total)
        model = total.normalised(np.full(4, 0.25), weight=1e-9)


def texts():
    draw = np.random.default_rng(4)
    a, b = [f"a{i}" for i in range(40)], [f"B{i}" for i in range(40)]
    return [None, "", "unseen words only é"] + [" ".join(draw.choice(a if i % 2 else b, int(draw.integers(1, 60)))) for i in range(200)] + ["a1 " * 6000]


def test_base_scores_match_brute_force_and_the_model_beats_them_on_held_out_texts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(5, texts()[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    out = zlib.crc32
    is_out = lambda i: out(str(i).encode()) % 7 == 2
    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    c = Counter(w for i, t, _ in rows if not is_out(i) for w in tokens(t))
    n, v = c.total(), len(c)
    for how in ({"own": 10, "listed": 30, "classes": 8}, {"own": 4096}):
        got = hmm.scores(df, states=4, sample=50, start_rounds=30, **how).collect()
        assert len(got) == len(rows)
        gain = {True: 0.0, False: 0.0}
        for r in got:
            t = tokens(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (is_out(r["doc_id"]), len(t), sum(c[w] > 0 for w in t), n)
            assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
            gain[r["held_out"]] += r["score"] - r["base_score"]
        assert gain[True] > 0 and gain[False] > 0


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.scores(df).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = hmm.scores(spark.createDataFrame([(held, "a b")], df.schema)).collect()
    assert (row["n_known"], row["train_tokens"], row["held_out"]) == (0, 0, True) and math.isfinite(row["score"])


def test_scores_do_not_depend_on_how_rows_are_dealt_out(spark):
    draw = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(draw.choice(vocab, int(draw.integers(0, 80))))) for i in range(300)] + [(None, "w1 w2"), (3, "w1 w2"), (3, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = dict(states=3, own=64, listed=200, classes=16, sample=60, start_rounds=4, rounds=1)
    a, b = (sorted((r["doc_id"] is not None, r["doc_id"], r["n_tokens"], r["score"]) for r in hmm.scores(d, **how).collect()) for d in (docs.repartition(1), docs.repartition(7)))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert max(abs(x[3] - y[3]) for x, y in zip(a, b)) < 1e-6


def test_pairs_are_expected_as_segments_of_one_and_two():
    model = small(states=3, symbols=5, seed=8)
    draw = np.random.default_rng(2)
    docs = [draw.integers(0, 5, int(n)) for n in (1, 1, 2, 7, 30)]
    got, want = model.zeros(), model.zeros()
    at = np.concatenate([np.r_[5, d[:-1]] * 5 + d for d in docs])
    hmm.expected_of_pairs(model, *np.unique(at, return_counts=True), got)
    hmm.expected(model, [(True, d[:1]) for d in docs] + [(False, d[i : i + 2]) for d in docs for i in range(len(d) - 1)], want)
    assert np.allclose(got.flat(), want.flat())


def test_pairs_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hmm, "PAIRS", 40)
    draw = np.random.default_rng(3)
    docs = [draw.integers(0, 50, int(n)).astype(np.int16) for n in draw.integers(1, 30, 300)]
    want = Counter((int(a), int(b)) for d in docs for a, b in zip([50, *d], d))
    for parts in (1, 5):
        df = spark.createDataFrame([(bytearray(d.tobytes()),) for d in docs], "symbols binary").repartition(parts)
        got = Counter()
        for r in hmm.pair_counts(df, 50).collect():
            for at, c in zip(np.frombuffer(r["at"], np.int64).tolist(), np.frombuffer(r["c"], np.int64).tolist()):
                got[divmod(at, 50)] += c
        assert got == want


def test_the_start_takes_all_training_texts(spark):
    """Words of two topics that appear in few texts each, as many as no small sample holds, get states by topic."""
    rows = [(i, " ".join([f"{'ab'[i % 2]}{i % 40}", f"{'ab'[i % 2]}{(i + 2) % 40}"] * 4)) for i in range(400)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = dict(states=2, own=64, listed=100, classes=8, sample=1, rounds=0)
    gain = lambda n: sum(r["score"] - r["base_score"] for r in hmm.scores(df, start_rounds=n, **how).collect())
    assert gain(20) > gain(0) + 0.2 * sum(len(t.split()) for _, t in rows)
