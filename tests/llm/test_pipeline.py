import numpy as np

import corpus_pipeline
from cueweave.llm import mixing, quality
from cueweave.llm.grams import plain_words


def written(spark, folder):
    draw = np.random.default_rng(6)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(draw.choice(vocab, n))
    docs, labels = [], []
    for i in range(60):
        docs.append((i, text(160), "en", f"s{i % 3}", 0))
        labels.append((i, 1, 0))
    for i in range(60, 90):
        docs.append((i, " ".join(w + "***" for w in text(120).split()), "en", "s0", 0))
        labels.append((i, 0, 0))
    docs += [(100, docs[3][1], "en", "s1", 0), (101, docs[4][1].replace("word1 ", "other "), "en", "s1", 0), (102, docs[5][1] + " extra end", None, None, None)]
    items = [(k, text(30)) for k in range(5)]
    w = text(200).split()
    w[50:50] = items[2][1].split()
    docs += [(110, " ".join(w), "en", "s2", 0), (111, text(150) + " call +1 (499) 555-6503 or 4845168114407329.", "en", "s2", 0), (112, None, None, "s2", 0), (113, "short", "en", "s2", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / max(1, len(a | b))


def test_every_stage_does_its_work(spark, tmp_path):
    docs, items = written(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = {r["doc_id"]: r for r in out}
    assert len(by_id) == len(out)
    good = {d: t for d, t, *_ in docs if not (lambda n: n[0] < 50 or 100 * n[4] > 50 * n[0])(quality.statistics(t)[0]) and "***" not in (t or "")}
    kept = {}
    for d in sorted(good):  # the smallest of each group of near copies
        if all(similarity(good[d], good[k]) < 0.8 for k in good if k < d):
            kept[d] = good[d]
    held = [d for d, t in kept.items() if any(" ".join(plain_words(i)) in " ".join(plain_words(t)) for _, i in items)]
    assert set(by_id) == set(kept) - set(held) and held == [110] and not {100, 101, 102} & set(by_id)
    assert all(by_id[d]["text"] == kept[d] for d in by_id if d != 111)
    assert "555-6503" not in by_id[111]["text"] and "4845168114407329" not in by_id[111]["text"]
    assert sorted((r["slot"], r["place"]) for r in out) == sorted({(r["slot"], r["place"]) for r in out})
    counts = [sum(r["source"] == f"s{k}" for r in out) for k in range(3)]
    blocks = sum(p.slots for p in mixing.phases([-(-n // 16) for n in counts], [1, 1, 1]))
    assert max(r["slot"] for r in out) + 1 == blocks


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    written(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).schema.names == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
