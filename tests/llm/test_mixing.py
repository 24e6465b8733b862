"""The mix against its weights as they are, over many stretches."""

import heapq
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import written


def test_equal_sources_stay_within_a_block_over_many_periods(spark):
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"))
    placed = sorted((r._slot, r._place, r.source) for r in mixing.mix(rows, block_rows=1, period=1024).collect())
    assert [p[:2] for p in placed] == [(i, i) for i in range(8000)]
    seen = dict.fromkeys({p[2] for p in placed}, 0)
    for t, (_, _, s) in enumerate(placed, 1):
        seen[s] += 1
        assert all(abs(20 * n - t) < 20 for n in seen.values())


def one_by_one(windows):
    """Slots of blocks (due, tie..., release), the earliest deadline first: the plain serial loop."""
    coming, ready, slots = sorted(windows, key=lambda w: w[-1]), [], {}
    for slot in range(len(windows)):
        while coming and coming[0][-1] <= slot:
            heapq.heappush(ready, coming.pop(0))
        job = heapq.heappop(ready)
        assert slot < job[0]
        slots[job[1:-1]] = slot
    return slots


@pytest.mark.parametrize("trial", range(8))
def test_unrounded_weights_over_many_stretches(spark, trial):
    """Weights down to 0.0005 beside large ones, so windows of many stretches; several sources alike in the later trials."""
    rng = random.Random(trial)
    n = rng.randint(2, 15)
    weights = [rng.choice([1.0, rng.random() + 0.02, rng.random() ** 4 + 0.0005]) for _ in range(n)]
    blocks = [max(1, int(w / sum(weights) * 3000 * rng.choice([1, 1, 2]))) for w in weights]
    if trial > 4:
        weights, blocks = weights + weights[:3] + [0.001] * 70, blocks + blocks[:3] + [rng.randint(1, 2) for _ in range(70)]
        n = len(weights)
    kind_of = sorted(Counter(zip(blocks, weights, strict=True)).items())
    kinds = [(*pair, many) for pair, many in kind_of]
    fluid = mixing.Fluid(kinds)
    sources, windows, seen_kinds = [], [], Counter()
    for s in range(n):
        kind = [pair for pair, _ in kind_of].index((blocks[s], weights[s]))
        rank = seen_kinds[kind]
        seen_kinds[kind] += 1
        sources.append((str(s), False, blocks[s], weights[s], kind, rank))
        release, due = fluid.windows(np.arange(blocks[s]), np.full(blocks[s], weights[s]))
        windows += [(int(d), kind, i, rank, int(r)) for i, (r, d) in enumerate(zip(release, due, strict=True))]
    table = spark.createDataFrame(sources, "_name string, _null boolean, _blocks long, _weight double, _kind int, _rank long")
    placed = mixing._slots(table, kinds, 64).collect()
    name = {(kind, rank): s for s, _, _, _, kind, rank in sources}
    want = {(name[kind, rank], i): slot for (kind, i, rank), slot in one_by_one(windows).items()}
    assert len(placed) == len(want) and {(r._name, r._block): r._slot for r in placed} == want
    source = [int(r._name) for r in sorted(placed, key=lambda r: r._slot)]
    assert sorted(want.values()) == list(range(fluid.slots))
    exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    seen = [0] * n
    for t, s in enumerate(source, 1):
        seen[s] += 1
        if any(seen[x] == blocks[x] for x in range(n)):
            break  # from here on the others share what it leaves
        assert all(abs(exact[x] * t - seen[x]) < 1 for x in range(n))
    assert t > 64 or fluid.slots < 200


def test_many_sources_of_one_block_beside_large_ones_are_many_stretches(spark):
    """400,000 sources of one block each and three large ones: no stretch, so no task, has more blocks than its slots."""
    kinds = [(1, 1.0, 400_000), (30_000, 30_000.0, 2), (60_000, 60_000.0, 1)]
    fluid = mixing.Fluid(kinds)
    runs = mixing._runs(written(mixing._classes(spark, kinds, fluid), "classes"), 4096, fluid.slots)
    size = F.sum(F.col("last") - F.col("first"))
    found = {r.stretch: r.n for r in runs.groupBy("stretch").agg(size.alias("n")).collect()}
    assert found == {k: min(4096, fluid.slots - 4096 * k) for k in range(-(-fluid.slots // 4096))}
    rare = runs.where("kind = 0").agg(size, F.max(F.col("last") - F.col("first"))).first()
    assert rare[0] == 400_000 and rare[1] <= 4096


def test_a_source_for_every_row_or_two(spark):
    rows = spark.range(31_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("site"), F.col("id") % 21_000).alias("source"))
    placed = mixing.mix(rows, block_rows=1).agg(F.count("*"), F.countDistinct("_slot"), F.min("_slot"), F.max("_slot")).first()
    assert tuple(placed) == (31_000, 31_000, 0, 30_999)


def test_ranks_of_a_source_of_many_buckets(spark, monkeypatch):
    """Bucket counts are added up in chunks: places are the same as in one window."""
    from tidemark.operators import running

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 4 > 0, "hot").otherwise("rest").alias("source")).repartition(3)
    places = lambda: {r.doc_id: r._place for r in mixing.mix(docs, keep=["doc_id"]).collect()}
    whole = places()
    monkeypatch.setattr(running, "CHUNK_ROWS", 20)
    assert places() == whole and len(set(whole.values())) == 900


def test_weights_that_leave_nothing_for_the_other_sources(spark):
    """Sources without a weight get 1e-9 each: their windows span the whole mix, over many stretches of 64 slots."""
    source = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), source.alias("source"))
    placed = sorted((r._place, r._slot, r.source) for r in mixing.mix(rows, {"hot": 1.0}, block_rows=1, period=64).collect())
    assert [p[:2] for p in placed] == [(i, i) for i in range(3000)]
    # While the hot source lasts, each other one is within a block of its share, which is all but none.
    assert sum(p[2] != "hot" for p in placed[:2000]) <= 7
    seen = Counter()
    for t, (_, _, s) in enumerate(placed[2000:], 1):
        seen[s] += 1
        assert all(abs(t / 7 - seen[f"s{i}"]) < 3 for i in range(7))
