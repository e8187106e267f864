import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cueweave.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é☃\n\t#$A| \x0b ", max_size=60))
def test_counts(text):
    assert quality.statistics(text)[0] == brute(text)


def test_monotone_trees_and_held_out_accuracy():
    draw = np.random.default_rng(4)
    x = draw.random((3000, len(quality.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (draw.random(3000) < 0.05)) & (x[:, 2] < 0.7)
    model = quality.train(x[:2000], y[:2000].astype(float))
    assert ((model.score(x[2000:]) > 0) == y[2000:]).mean() > 0.9
    for j, sign in ((quality.FEATURES.index(k), v) for k, v in quality.MONOTONE.items()):
        probe = np.repeat(x[:50], 40, axis=0)
        probe[:, j] = np.tile(np.linspace(-0.5, 1.5, 40), 50)
        assert (sign * np.diff(model.score(probe).reshape(50, 40), axis=1) >= -1e-12).all()


def test_flat_arrays_walk_like_a_recursion():
    draw = np.random.default_rng(5)
    x = draw.random((400, len(quality.FEATURES)))
    model = quality.train(x, (x[:, 0] + x[:, 3] > 1).astype(float), trees=5)

    def walk(t, node, row):
        nxt = model.left[t, node] if row[model.feature[t, node]] <= model.threshold[t, node] else model.right[t, node]
        return model.value[t, node] if nxt == node else walk(t, nxt, row)

    want = [model.start + sum(walk(t, 0, row) for t in range(5)) for row in x]
    assert np.allclose(model.score(x), want)


def test_verdicts_and_edge_cases(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i}***" for i in range(80))
    texts = [None, "", "short", good, bad, "one two three " * 40, "big " * 50_000] + [f"{good} {i}" for i in range(40)] + [f"{bad} {i}" for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, features double")
    labels = spark.createDataFrame([(i, int(i < 47), 0) for i in range(7, 87)] + [(None, 1, 0), (3, None, 0), (9, 5, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.verdicts(docs, labels).collect()}
    assert len(got) == len(texts)
    assert [got[i]["base_failed"] for i in range(7)] == [True, True, True, False, False, True, True]
    assert got[3]["kept"] and not got[4]["kept"] and not got[5]["kept"]
    assert all([got[i][c] for c in quality.BASE] == brute(texts[i]) for i in got if i != 6)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    none = quality.verdicts(docs, spark.createDataFrame([], labels.schema)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert quality.verdicts(docs.limit(0), labels).count() == 0
