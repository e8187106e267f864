"""Mixing sources to target weights by Pfair scheduling.

A source's documents are put in a fixed pseudo-random order and cut into blocks. Block i of a source of weight w (the
weights of a round sum to one) is released at slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the
released block that is due first. On one processor that meets every deadline, so that at any slot t of a phase a source
has had less than one block more or less than w t. Weights are taken as the exact rationals that they are, as whole
numbers q of sum P: the schedule repeats every P slots, and a block's slot follows by arithmetic. A period that is longer
than the phase is worked out slot by slot only as far as the phase goes. When a source runs out, the rest go on in a new
phase by their weights; no document is dropped or repeated.

The driver schedules blocks, not rows: the table is at most MOST_BLOCKS blocks and one a source, at any size.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST_BLOCKS = 1 << 18
LEAST_BLOCK = 16
BUCKET_ROWS = 1 << 11


def period(shares: list[int], blocks: list[int] | None = None) -> list[int]:
    """The source of each slot of a period: earliest deadline first, the first source where deadlines tie.

    With blocks, how many each source has, it ends early once a source that it has served has no more.
    """
    total = sum(shares)
    waiting = [(0, s, 0) for s, q in enumerate(shares) if q]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // shares[s]), s, i))
        due, s, i = heapq.heappop(ready)
        out.append(s)
        if blocks and i + 1 == blocks[s]:
            break
        if i + 1 < shares[s]:
            heapq.heappush(waiting, ((i + 1) * total // shares[s], s, i + 1))
    return out


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in the very proportions of the weights, without a common divisor; equal ones if all are zero."""
    exact = [Fraction(w) for w in weights]
    if not any(exact):
        return [1] * len(exact)
    scale = math.lcm(*(w.denominator for w in exact))
    whole = [int(w * scale) for w in exact]
    least = math.gcd(*whole)
    return [w // least for w in whole]


def whole_shares(weights: list[float], total: int) -> list[int]:
    """The whole numbers nearest to the weights that sum to total, by largest remainders, but each at least 1."""
    if total < len(weights):
        raise ValueError("a period must have a slot for every source")
    whole = sum(weights)
    exact = [total * w / whole if whole else total / len(weights) for w in weights]
    out = [max(1, int(x)) for x in exact]
    while (missing := total - sum(out)) > 0:
        for s in sorted(range(len(out)), key=lambda s: (out[s] - exact[s], s))[:missing]:
            out[s] += 1
    while sum(out) > total:
        out[max((s for s in range(len(out)) if out[s] > 1), key=lambda s: (out[s] - exact[s], -s))] -= 1
    return out


@dataclass
class Phase:
    """Slots begin to begin + slots, in periods of `pattern`, or of its beginning; first[s]: blocks that source s had before."""

    begin: int
    slots: int
    pattern: list[int]
    first: list[int]
    shares: list[int]


def phases(blocks: list[int], shares: list[int]) -> list[Phase]:
    """At most one phase a source: a phase ends when a source has no block left."""
    left, done, begin, out = list(blocks), [0] * len(blocks), 0, []
    while any(left):
        mine = [q if n else 0 for q, n in zip(shares, left)]
        rounds = min(n // q for n, q in zip(left, mine) if q)
        pattern = period(mine, None if rounds else left)
        first = list(done)
        for s, q in enumerate(mine):
            left[s] -= rounds * q
            done[s] += rounds * q
        slots = rounds * len(pattern)
        if all(n for n, q in zip(left, mine) if q):
            for s in pattern:
                left[s] -= 1
                done[s] += 1
                slots += 1
                if not left[s]:
                    break
        out.append(Phase(begin, slots, pattern, first, mine))
        begin += slots
    return out


def mixed(docs: DataFrame, weights: dict | None = None, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source", block: int | None = None, slots_a_period: int | None = None, names: tuple[str, str] = ("slot", "place")) -> DataFrame:
    """docs with the slot of each row's block and the row's place in it: reading by (slot, place) is the mixture.

    weights: by source, relative; sources that it lacks take the least weight given. Without weights a source weighs
    its number of rows to the given power. A null source is a source like others; rows that repeat get places of
    their own; an empty table stays empty; other columns, of whatever names, are kept. block: rows; by default
    LEAST_BLOCK, or as many more as make MOST_BLOCKS blocks of the table. slots_a_period rounds the weights to whole
    shares of so many slots, which must be no fewer than the sources; without it the weights are kept exactly. The
    sources' counts alone reach the driver, and a number for each block is sent with the plan. A source's rows are
    numbered in hash buckets of about BUCKET_ROWS, so that one source with a third of all rows is many groups. Rows are
    shuffled once.
    """
    slot, place = names
    if {slot, place} & set(docs.columns):
        raise ValueError("docs has columns of the result's names already; give others")
    spark = docs.sparkSession
    whole = F.struct(*[docs[c] for c in docs.columns])  # so that no name of docs clashes with one from here on
    src = docs.select(whole.alias("row"), docs[source_col].alias("source"), F.xxhash64(docs[id_col], F.lit(7)).alias("key"))
    totals = sorted(((r["source"], r["n"]) for r in src.groupBy("source").agg(F.count("*").alias("n")).collect()), key=lambda r: (r[0] is not None, str(r[0])))
    if not totals:
        return docs.withColumn(slot, F.lit(0).cast("long")).withColumn(place, F.lit(0).cast("long"))
    if block is None:
        block = max(LEAST_BLOCK, -(-sum(n for _, n in totals) // MOST_BLOCKS))
    if weights is None:
        wanted = [float(n) ** power for _, n in totals]
    else:
        if any(w <= 0 for w in weights.values()):
            raise ValueError("weights must be positive")
        wanted = [weights.get(s, min(weights.values())) for s, _ in totals]
    shares = exact_shares(wanted) if slots_a_period is None else whole_shares(wanted, slots_a_period)
    plan = []
    for p in phases([-(-n // block) for _, n in totals], shares):
        spots: list[list[int]] = [[] for _ in totals]
        for t, s in enumerate(p.pattern):
            spots[s].append(t)
        had = [0] * len(totals)
        rounds, rest = divmod(p.slots, len(p.pattern))
        for s in p.pattern[:rest]:
            had[s] += 1
        plan += [(s, p.first[s], p.first[s] + rounds * len(spots[s]) + had[s], p.begin, len(p.pattern), spots[s]) for s in range(len(totals)) if spots[s]]
    table = spark.createDataFrame(plan, "of int, low long, high long, begin long, period long, spots array<int>")
    kind = docs.schema[source_col].dataType.simpleString()
    codes = spark.createDataFrame([(s, i, max(1, n // BUCKET_ROWS)) for i, (s, n) in enumerate(totals)], f"name {kind}, code int, buckets int")
    src = src.join(F.broadcast(codes), F.col("source").eqNullSafe(F.col("name"))).drop("source", "name")  # a row a source
    src = src.withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets")).cast("int")).drop("buckets")
    sizes = src.groupBy(F.col("code").alias("c"), F.col("bucket").alias("b")).count()
    order = W.partitionBy("c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0))).drop("count")
    ties = [] if "map<" in docs.select(whole).dtypes[0][1] else ["row"]
    within = W.partitionBy("code", "bucket").orderBy("key", *ties)
    src = src.withColumn("nth", F.row_number().over(within))
    src = src.join(starts, (F.col("code") == F.col("c")) & (F.col("bucket") == F.col("b"))).drop("c", "b")
    src = src.withColumn("nth", F.col("nth") + F.col("before") - 1).withColumn("rank", F.floor(F.col("nth") / block))
    # One row for each phase and source that it serves; a phase's spots are its pattern's slots.
    src = src.join(F.broadcast(table), (F.col("code") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at, each = F.col("rank") - F.col("low"), F.size("spots")
    found = F.col("begin") + F.floor(at / each) * F.col("period") + F.get("spots", (at % each).cast("int"))
    return src.select("row.*", found.cast("long").alias(slot), (F.col("nth") % block).cast("long").alias(place))


def write_mixed(mixture: DataFrame, path: str, files: int, names: tuple[str, str] = ("slot", "place")) -> None:
    """Write a mixture in its order: file after file, and row after row within a file."""
    mixture.repartitionByRange(files, *names).sortWithinPartitions(*names).write.parquet(path)
