import numpy as np
import pytest

from cueweave.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    draw = np.random.default_rng(3)
    parts = ["word", " ", "  ", "\n", "é", "☃", "日本", "▁", "abcdefgh", "\x00", "</s>", "<unk>", "😀", "ing", "the ", "=====", "\t", "123"]
    out = [None, "", " ", "a", "</s> <s> text", "x" * 5000, " " * 5000, "日" * 3000, "☃" * 1500, "▁" * 700, "the quick brown fox " * 500, "aaaa\n" * 900]
    return out + ["".join(draw.choice(parts, int(n))) for n in draw.integers(1, 2500, 60)]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (300, 20), (4096, 64), (8, 2)])
def test_spliced_counts_are_those_of_the_whole_text(chunk, overlap):
    counter = tokens.PieceCounter(PATH, chunk, overlap)
    assert counter.spelled
    for t in texts():
        assert counter.count(t or "") == len(counter.model.encode(t or "")), (len(t), t[:80])
    assert counter.retries or chunk > 1000


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "same row", "x")] * 2
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, chunk=128, overlap=16).collect()
    model = tokens.PieceCounter(PATH).model
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
