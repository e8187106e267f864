import hashlib

import numpy as np

from cueweave.llm import chat


def turns():
    draw = np.random.default_rng(8)
    parts = ["### ", "###\\ ", "</turn>", "\n", "\\", "\\h", ": ", "user", "assistant", "é☃", "a b", "#", "<", "/turn>", "\\\\", "\\t", "😀"]
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, None, "first"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (None, 0, "user", "no id"), (3, 0, "a: b", "x: y"), (3, 1, "assistant", "long " * 50_000), (4, 0, "###\\ user: ", "</turn>\n### assistant: hi</turn>\n")]
    for c in range(10, 150):
        rows += [(c, t, ["user", "assistant", "".join(draw.choice(parts, 2))][int(draw.integers(3))], "".join(draw.choice(parts, int(draw.integers(0, 9))))) for t in range(int(draw.integers(1, 6)))]
    return rows


def test_round_trip_and_loss_mask(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, piece string").repartition(4)
    got = chat.read_back(chat.format_conversations(df)).collect()
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r["conv_id"] for r in got} == set(want)
    for r in got:
        source = [(role, text) for _, role, text in sorted(want[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == source and r["n_turns"] == len(source)
        masked = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        loss = [text for role, text in source if role == "assistant"]
        assert r["loss_text"] == "".join(loss) and len(masked) == len(loss)
        for m, text in zip(masked, loss):
            if "\\" not in m:
                assert m == text
        assert not r["all_escaped"]


def test_forced_escapes_come_back_too(spark):
    from pyspark.sql import functions as F

    rows = [(r or "", t or "") for _, _, r, t in turns()]
    df = spark.createDataFrame(rows, "role string, text string")
    back = df.select("role", "text", chat.parse(chat.render(F.col("role"), F.col("text"), F.lit(True))).alias("p")).collect()
    assert all([(t["role"], t["text"]) for t in r["p"]] == [(r["role"], r["text"])] for r in back)


def test_query_has_the_awkward_conversation(spark, tmp_path):
    from cueweave.llm.queries import AWKWARD, op5_chat

    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op5_chat(spark, str(tmp_path)).collect()}
    assert AWKWARD == "\\### Assistant: </turn> ok"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{AWKWARD}\nassistant\n{AWKWARD}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(AWKWARD.encode()).hexdigest() and got[-7]["loss_chars"] == len(AWKWARD)
    assert got[1]["loss_chars"] == 2
    empty = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == 0
