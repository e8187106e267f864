import numpy as np

from cueweave.llm import decontam, grams, licenses


def brute_score(item, doc):
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, a in enumerate(item):
        for j, b in enumerate(doc):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_smith_waterman_and_banded_match_brute_force():
    draw = np.random.default_rng(1)
    for _ in range(100):
        a, b = draw.integers(1, 6, int(draw.integers(1, 12))), draw.integers(0, 6, int(draw.integers(1, 20)))
        score, begin, end = grams.smith_waterman(a, b)
        plain = [int(x) if x else -1 for x in b]
        assert score == brute_score(a.tolist(), plain) == (brute_score(a.tolist(), plain[begin:end]) if score else 0)
        band = int(draw.integers(1, 6))
        lcs = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if abs(i - j) <= band:
                    lcs[i, j] = max(0, lcs.get((i - 1, j), 0), lcs.get((i, j - 1), 0), lcs.get((i - 1, j - 1), 0) + 1 if i and j and a[i - 1] == b[j - 1] and b[j - 1] else 0)
        matched, first, last = grams.banded_matches(a, b, -band, band)
        assert matched == max(v for (i, _), v in lcs.items() if i == min(len(a), len(b) + band))
        if matched:
            inside = np.where((np.arange(len(b)) >= first) & (np.arange(len(b)) <= last), b, 0)
            assert grams.banded_matches(a, inside, -band, band) == (matched, first, last) and b[first] and b[last]


def test_long_items_need_two_rows_only():
    draw = np.random.default_rng(3)
    item = draw.integers(1, 5000, 20_000)
    doc = np.r_[draw.integers(1, 5000, 3000), item[:9000], item[9100:], draw.integers(1, 5000, 3000)]
    score, begin, end = grams.smith_waterman(item, doc)
    assert score >= 2 * 19_900 - 100 and abs(begin - 3000) < 5 and abs(end - 22_900) < 5


def test_spans_where_folding_changes_words():
    items = [(1, grams.plain_words("one two three four five six"))]
    text = "İİİ ŉab İİ one two three four five six ŉ end"
    (found,) = decontam.Seeds(items).matches(text, 0.5)
    assert found[0] == 1 and text[found[2] : found[3]] == "one two three four five six"


def made():
    draw = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(draw.choice(vocab, int(draw.integers(5, 50))))) for i in range(30)] + [(30, None), (31, ""), (32, "two words"), (32, "two words")]
    docs = [(0, None), (1, ""), (2, "Two, words!"), (3, "words two")]
    for i in range(4, 120):
        w = list(draw.choice(vocab, int(draw.integers(0, 300))))
        if i % 3 == 0:
            item = items[i % 30][1].split()
            for _ in range(len(item) // 10):
                item[int(draw.integers(len(item)))] = "edit"
            at = int(draw.integers(len(w) + 1))
            w[at:at] = item
        docs.append((i, " ".join(w).upper() if i % 2 else ", ".join(w)))
    return items, docs


def test_contaminated_documents_against_alignment_of_all_pairs(spark):
    items, docs = made()
    df = spark.createDataFrame([(i, t, 1) for i, t in [*docs, docs[6]]], "doc_id long, text string, score int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (7, 1000):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(df, bench, block=block).collect()}
        want = {}
        for d, text in docs:
            for i, item in items:
                w = grams.plain_words(item)
                if w and text and (s := brute_score(w, grams.plain_words(text)) / (2 * len(w))) >= 0.5:
                    want[d, i] = s
        assert set(got) == set(want) and len(want) > 35
        assert all(abs(got[k]["score"] - want[k]) < 1e-9 for k in want)
        text = dict(docs)
        assert grams.plain_words(text[2][got[2, 32]["begin"] : got[2, 32]["end"]]) == ["two", "words"]
    kept = decontam.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(df, none).count() == 0 and decontam.drop_contaminated(df, none).count() == df.count()
    assert decontam.contaminated(df.limit(0), bench).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].replace("hereby ", "").replace("free of charge", "without charge")
    texts = [None, "", "nothing at all", "é text.\nReleased under the MIT License.", "Before. " + mit.upper() + " After.", "word " * 30_000 + licenses.TEMPLATES["isc"] + " x " * 50 + licenses.TEMPLATES["isc"], "under the MIT the License Released"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")], "doc_id long, text string, spans string")
    rows = licenses.scan(df).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1
    assert [got[i]["n_matches"] for i in range(7)] == [0, 0, 0, 1, 1, 2, 0]
    assert got[3]["licenses"] == "mit-short" and got[3]["coverage"] == "1.000"
    b, e = map(int, got[3]["spans"].split(":"))
    assert texts[3][b:e] == "Released under the MIT License"
    b, e = map(int, got[4]["spans"].split(":"))
    assert got[4]["licenses"] == "mit" and texts[4][b:e] == mit.upper()[:-1] and 0.9 < float(got[4]["coverage"]) < 1
    assert got[5]["licenses"] == "isc,isc"
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df, {}).agg({"n_matches": "sum"}).first()[0] == 0
    planted = " ".join(f"t{i}" for i in range(200))
    index = licenses.TemplateIndex({"a": planted})
    assert all(len(index.index.find(index.index.numbers(planted.split()[k : k + 4]), index.keys)[0]) for k in range(196))


def test_every_edited_copy_of_a_short_item_is_found():
    draw = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, list(draw.choice(vocab, int(draw.integers(1, 26))))) for k in range(30)]
    seeds = decontam.Seeds(items)
    pairs = 0
    for _ in range(250):
        words = list(draw.choice(vocab, 60))
        k = int(draw.integers(30))
        copy = []
        for w in items[k][1]:  # substitutions, deletions and insertions
            x = draw.random()
            copy += [w] if x > 0.3 else ["edit"] if x > 0.15 else [w, "more"] if x > 0.05 else []
        words[20:20] = copy
        got = {name: score for name, score, *_ in seeds.matches(" ".join(words), 0.5)}
        want = {name: s for name, item in items if (s := brute_score(item, words) / (2 * len(item))) >= 0.5}
        assert got.keys() == want.keys() and all(abs(got[n] - s) < 1e-9 for n, s in want.items())
        pairs += k in want
    assert pairs > 150
