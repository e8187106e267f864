import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueweave.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_a_period_deviates_by_less_than_one_block(shares):
    out, had, total = mixing.period(shares), Counter(), sum(shares)
    for t, s in enumerate(out, 1):
        had[s] += 1
        assert all(abs(had[k] * total - q * t) < total for k, q in enumerate(shares))
    assert [had[k] for k in range(len(shares))] == shares


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 9)), min_size=1, max_size=6))
def test_phases_use_every_block_once(sources):
    blocks, shares = [b for b, _ in sources], [q for _, q in sources]
    used, at = Counter(), 0
    for p in mixing.phases(blocks, shares):
        assert p.begin == at and p.first == [used[s] for s in range(len(blocks))]
        for t in range(p.slots):
            used[p.pattern[t % len(p.pattern)]] += 1
        at += p.slots
    assert [used[s] for s in range(len(blocks))] == blocks and at == sum(blocks)


def test_rows_follow_a_simulation_slot_by_slot(spark):
    n = {"a": 300, "b": 90, None: 41, "c": 5}
    rows = [(i, s, "x", 0) for s, k in n.items() for i in range(k)] + [(0, "a", "x", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, of string, low int").repartition(5)
    out = mixing.mixed(docs, {"a": 5, "b": 3, "c": 1}, block=4, slots_a_period=20)
    got = out.collect()
    assert out.columns == [*docs.columns, "slot", "place"] and Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["slot"]].append(r)
    assert sorted(slots) == list(range(len(slots)))
    for rs in slots.values():
        assert len({r["source"] for r in rs}) == 1 and sorted(r["place"] for r in rs) == list(range(len(rs)))
    names = [None, "a", "b", "c"]
    left = {"a": -(-303 // 4), "b": -(-90 // 4), None: -(-41 // 4), "c": 2}
    shares = dict(zip(names, mixing.whole_shares([1, 5, 3, 1], 20)))
    order = [slots[t][0]["source"] for t in range(len(slots))]
    t0, had = 0, Counter()
    for t, s in enumerate(order):  # within a phase every source keeps within a block of its share
        had[s] += 1
        active = [k for k in names if left[k] > 0]
        total = sum(shares[k] for k in active)
        assert all(abs(had[k] - shares[k] * (t + 1 - t0) / total) < 1 for k in active)
        left[s] -= 1
        if not left[s]:
            t0, had = t + 1, Counter()
    again = mixing.mixed(docs.repartition(2), {"a": 5, "b": 3, "c": 1}, block=4, slots_a_period=20).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mixed(docs).count() == 0
    one = spark.createDataFrame([(None, None), (None, None)], "doc_id long, source string")
    assert sorted((r["slot"], r["place"]) for r in mixing.mixed(one).collect()) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        mixing.mixed(spark.createDataFrame([(1, "a", 2)], "doc_id long, source string, slot int"))
    with pytest.raises(ValueError):
        mixing.mixed(one, {"a": 0})
    many = spark.createDataFrame([(i, f"s{i % 3}") for i in range(100)], "doc_id long, source string")
    mixing.write_mixed(mixing.mixed(many, block=4), f"{tmp_path}/m", 2)
    back = [(r["slot"], r["place"]) for r in spark.read.parquet(f"{tmp_path}/m").collect()]
    assert len(back) == 100 == len(set(back))


def test_deviation_from_the_given_weights_with_many_sources(spark):
    heavy = [3000 if s == 0 else 300 + 7 * s for s in range(20)]
    wanted = [float(n) ** 0.5 for n in heavy]
    p = mixing.phases(heavy, mixing.exact_shares(wanted))[0]
    had = [0] * 20
    for t in range(p.slots):
        had[p.pattern[t % len(p.pattern)]] += 1
        assert all(abs(had[s] - w / sum(wanted) * (t + 1)) < 1 for s, w in enumerate(wanted))
    assert p.slots > 3000
    assert mixing.whole_shares([19.0, *[1.0] * 19], 1000)[0] == 500
    rows = [(i, "big") for i in range(200)] + [(1000 + i, f"s{i}") for i in range(1100)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), {"big": 1100, "s0": 1}, block=4).collect()
    assert sorted((r["doc_id"], r["source"]) for r in got) == sorted(rows)
    assert sorted({r["slot"] for r in got}) == list(range(50 + 1100))


def test_deviation_over_many_slots_and_sources():
    draw = random.Random(5)
    for weights in ([1 / 3] * 3, [0.7, 0.2, 0.09, 0.01], [0.9995, 0.0004, 0.0001], [draw.random() + 1e-4 for _ in range(2000)]):
        slots, total = 20_000, sum(map(Fraction, weights))
        blocks = [math.ceil(slots * w / sum(weights)) + 2 for w in weights]  # no source runs out
        p = mixing.phases(blocks, mixing.exact_shares(weights))[0]
        assert p.slots >= slots
        had = [0] * len(weights)
        shares = [Fraction(w) / total for w in weights]
        near = [float(x) for x in shares]
        for t in range(slots):
            had[p.pattern[t % len(p.pattern)]] += 1
            if len(weights) < 10 or t % 500 == 0:
                far = [abs(h - x * (t + 1)) for h, x in zip(had, near)]
                assert max(far) < 1 - 1e-6 or all(abs(h - x * (t + 1)) < 1 for h, x in zip(had, shares))


def test_large_sources_are_cut_into_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.mixed(docs, {"big": 3, "s0": 1}).collect()  # blocks of 75 rows
    assert len({r["doc_id"] for r in got}) == len(got) == 3000
    slots = defaultdict(list)
    for r in got:
        slots[r["slot"]].append((r["place"], r["source"]))
    assert sorted(slots) == list(range(len(slots))) and len(slots) <= 40 + 6
    assert all(sorted(p for p, _ in v) == list(range(len(v))) and len({s for _, s in v}) == 1 and len(v) <= 75 for v in slots.values())
