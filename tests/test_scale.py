"""Plans that must not depend on where keys lie, how far apart they are or how many ranges are asked for."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.period import Period
from tidemark.model import Grouping, SeriesRange
from tidemark.operators import intervals, ranges, spans
from tidemark.operators.reduce import reduce
from tidemark.operators.running import positions, split_large

DAY = 86_400_000
SCHEMA = "column_path string, key long, value double"


@pytest.fixture(scope="module")
def bursts(spark):
    """A series of 20,000 items within a day, one of 3,650 daily ones, one of both kinds, one of a single key."""
    busy = spark.range(20_000).select(F.lit("busy").alias("column_path"), (F.lit(3000 * DAY) + F.col("id") * 7).alias("key"))
    daily = spark.range(3650).select(F.lit("daily").alias("column_path"), (F.col("id") * DAY).alias("key"))
    mixed = busy.unionByName(daily).withColumn("column_path", F.lit("mixed"))
    stuck = spark.range(5000).select(F.lit("stuck").alias("column_path"), F.lit(5).cast("long").alias("key"))
    return busy.unionByName(daily).unionByName(mixed).unionByName(stuck).withColumn("value", F.lit(1.0)).repartition(5).cache()


def test_chunks_are_of_equal_depth(bursts):
    small, large = split_large(bursts, ["column_path"], ("key",), 1000)
    assert small.count() == 0
    sizes = large.groupBy("column_path", "_chunk").count().agg(F.max("count"), F.count("*"), F.sum("count")).first()
    assert sizes[0] <= 2000 and sizes[1] < 150 and sizes[2] == bursts.count()
    ends = large.groupBy("column_path", "_chunk").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("column_path", "_chunk").collect()
    assert all(x.b <= y.a for x, y in zip(ends[:-1], ends[1:], strict=True) if x.column_path == y.column_path)


def test_positions_of_bursts(bursts):
    got = positions(bursts, ["column_path"], chunk_rows=1000).groupBy("column_path").agg(F.count_distinct("position").alias("n"), F.max("position").alias("last"), F.count("*").alias("rows")).collect()
    assert all(r.n == r.rows == r.last + 1 for r in got) and len(got) == 4


def test_a_shuffle_has_a_bounded_number_of_partitions(bursts, monkeypatch):
    monkeypatch.setattr("tidemark.operators.running.CHUNKS", 7)
    _, large = split_large(bursts, ["column_path"], ("key",), 100)
    assert large.select("_chunk").distinct().count() <= 7 and large.count() == bursts.count()


def test_only_large_series_are_dealt(bursts):
    small, large = split_large(bursts, ["column_path"], ("key",), 6000)
    assert {r[0] for r in small.select("column_path").distinct().collect()} == {"daily", "stuck"}
    assert {r[0] for r in large.select("column_path").distinct().collect()} == {"busy", "mixed"}


def test_windows_without_groups_and_with_null_ones(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("column_path"), "id")
    assert sorted(r.p for r in positions(df, [], "p", ("id",), chunk_rows=20).collect()) == list(range(300))
    got = positions(df, ["column_path"], "p", ("id",), chunk_rows=20).collect()
    assert sorted(r.p for r in got if r.column_path is None) == list(range(100)) and len(got) == 300


@pytest.mark.parametrize("chunk_rows", [5, 60, 10_000])
def test_gaps_of_a_long_trace(spark, chunk_rows):
    rng = random.Random(4)
    rows = [("n", "t", rng.randrange(9000), rng.randrange(50_000)) for _ in range(500)] + [("n", "u", 3, 1000)]
    df = spark.createDataFrame(rows, "name string, trace_id string, time long, duration long").repartition(4)
    own = sorted(r[2:] for r in rows if r[1] == "t")
    want = sorted((b[0], b[0] - (a[0] + a[1] // 1000)) for a, b in zip(own[:-1], own[1:], strict=True))
    got = spans.span_gaps(df, chunk_rows).collect()
    assert sorted((r.time, r.gap) for r in got if r.trace_id == "t") == want
    assert [(r.time, r.gap) for r in got if r.trace_id == "u"] == [(3, 0)]


@pytest.mark.parametrize("touching", [True, False])
@pytest.mark.parametrize("chunk_rows", [3, 40, 10_000])
def test_merging_in_chunks(spark, chunk_rows, touching):
    rng = random.Random(7)
    rows = [(g, s, s + rng.choice([0, 1, 5, 60])) for g in "ab" for s in (rng.randrange(2000) for _ in range(150))] + [("a", 100, 900), ("c", 1, 2)]
    want = []
    for g in "abc":
        island = None
        for s, e in sorted(r[1:] for r in rows if r[0] == g):
            if island and (s <= island[1] if touching else s < island[1]):
                island[1] = max(island[1], e)
            else:
                island = [s, e]
                want.append((g, island))
    df = spark.createDataFrame(rows, "column_path string, start long, end long").repartition(3)
    got = sorted((r.column_path, r.start, r.end) for r in intervals.merge_intervals(df, touching=touching, chunk_rows=chunk_rows).collect())
    assert got == sorted((g, *i) for g, i in want)


def test_far_keys_are_runs_until_they_are_sent(spark):
    """3,000,000,000 seconds between two items: rows come as they are asked for."""
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 3_000_000_000_000, 2.0)], SCHEMA)
    every = reduce(df, "sum", Grouping(period="1 second", empties=True))
    assert every.where("value IS NULL").limit(5).count() == 5
    whole = spark.createDataFrame([("s", 0, 3_000_000_000_000)], "column_path string, start long, end long")
    assert intervals.cut_by_period(whole, "1 second").limit(1000).count() == 1000
    assert spans.period_starts(whole, "start", "end", Period.parse("1 second"), name="at").limit(70_000).agg(F.max("at")).first()[0] is not None


def test_numbers_of_any_count(spark):
    df = spark.createDataFrame([(0, 0, 0), (1, 5, 4), (2, -3, 70_000), (3, 2**40, 2**40 + 131_073)], "id int, a long, b long")
    got = ranges.with_numbers(df, F.col("a"), F.col("b"), "k").groupBy("id").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_distinct("k").alias("d")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 1, 0, 0, 1), (2, 70_004, -3, 70_000, 70_004), (3, 131_074, 2**40, 2**40 + 131_073, 131_074)]


def test_empties_between_before_and_after(spark):
    df = spark.createDataFrame([("s", 25, 1.0), ("s", 61, 2.0), ("t", 43, 3.0)], SCHEMA).withColumn("key", F.col("key") * 1000)
    got = reduce(df, "sum", Grouping(period="10 seconds", empties=True), [SeriesRange(10_000, 90_000)]).collect()
    of = lambda s: [(r.key // 1000, r.value) for r in sorted(got, key=lambda r: r.key) if r.column_path == s]
    assert of("s") == [(10, None), (20, 1.0), (30, None), (40, None), (50, None), (60, 2.0), (70, None), (80, None)]
    assert of("t") == [(10, None), (20, None), (30, None), (40, 3.0), (50, None), (60, None), (70, None), (80, None)]


def plain_ranges(rows, asked):
    out = []
    for i, r in enumerate(asked):
        for s in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == s and (r.start is None or x[1] >= r.start) and (r.until is None or x[1] < r.until)), key=lambda x: x[1])
            if r.limit is not None:
                own = own[-r.limit :] if r.start is None and r.until is not None else own[: r.limit]
            out += [(i, *x) for x in own]
    return sorted(out)


def test_any_ranges(spark):
    rng = random.Random(3)
    rows = [(s, k, float(k)) for s in "ab" for k in rng.sample(range(-500, 1500), 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    maybe = lambda: rng.choice([None, rng.randrange(-600, 1600)])
    asked = [SeriesRange(maybe(), maybe(), rng.choice([None, None, 1, 7])) for _ in range(60)] + [SeriesRange(), SeriesRange(5, 5), SeriesRange(7, 3), SeriesRange(-500, -499), SeriesRange(1499, 1500)]
    for part in (asked, asked[:2], asked[60:61] * 3, [r for r in asked if r.limit is None], [r for r in asked if r.limit]):
        got = sorted((r.range_id, r.column_path, r.key, r.value) for r in ranges.raw(df, part).collect())
        assert got == plain_ranges(rows, part)


def test_deep_limits(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TOP", 3)
    monkeypatch.setattr("tidemark.operators.running.CHUNK_ROWS", 25)
    rows = [(s, k, float(k)) for s in "ab" for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.key for r in ranges.limit_range(df, until=90, limit=40).where("column_path = 'a'").collect()) == list(range(50, 90))
    assert sorted(r.key for r in ranges.limit_range(df, start=20, limit=40).where("column_path = 'b'").collect()) == list(range(20, 60))
    asked = [SeriesRange(3, None, 30), SeriesRange(None, 80, 12), SeriesRange(1, 9)]
    assert sorted((r.range_id, r.column_path, r.key, r.value) for r in ranges.raw(df, asked).collect()) == plain_ranges(rows, asked)


@pytest.mark.parametrize("task_rows", [40, 3000])
def test_rows_of_ranges_are_dealt_out(spark, monkeypatch, task_rows):
    """No task makes many more rows than asked for, whether series stay whole or, being too large, do not; results are the same."""
    monkeypatch.setattr(ranges, "TASK_ROWS", task_rows)
    rows = [(f"s{i % 23}", i * 7 % 2000, float(i % 11)) for i in range(1200)] + [(None, 5, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    asked = [SeriesRange(i * 30, i * 30 + 900) for i in range(40)] + [SeriesRange(None, 700), SeriesRange(100, None)]
    dealt = ranges.with_ranges(df, asked, deal=True)
    made = dealt.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    assert made[1] < 3 * task_rows + 100 and made[0] == len(plain_ranges([r for r in rows if r[0]], asked)) + 2
    if task_rows == 3000:
        assert dealt.withColumn("_p", F.spark_partition_id()).groupBy("column_path").agg(F.count_distinct("_p").alias("n")).agg(F.max("n")).first()[0] == 1
    want = {}
    for i, s, k, v in plain_ranges([r for r in rows if r[0]], asked):
        want[s, i, k // 100 * 100] = want.get((s, i, k // 100 * 100), 0) + v
    got = reduce(df.where("column_path IS NOT NULL"), "sum", Grouping(period="100 milliseconds"), [SeriesRange(r.start and r.start // 100 * 100, r.until) for r in asked])
    assert got.where("range_id = 40").count() == sum(1 for x in want if x[1] == 40)
    limited = [SeriesRange(r.start, r.until, 3 if i % 2 else None) for i, r in enumerate(asked)]
    found = sorted((r.range_id, r.column_path, r.key) for r in ranges.raw(df.where("column_path IS NOT NULL"), limited).collect())
    assert found == sorted(x[:3] for x in plain_ranges([r for r in rows if r[0]], limited))


def jobs(spark, name, make):
    spark.sparkContext.setJobGroup(name, name)
    make().collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_ranges(spark):
    df = spark.createDataFrame([("s", k * 100, k % 7 > 2) for k in range(400)], "column_path string, key long, value boolean").repartition(3).cache()
    df.count()
    selection = spark.createDataFrame([(0, "s")], "group_id int, column_path string")
    asked = lambda n: [SeriesRange(i * 300, i * 300 + 5000) for i in range(n)]
    for name, make in (
        ("raw", lambda n: ranges.raw(df, asked(n))),
        ("reduce", lambda n: reduce(df.withColumn("value", F.col("value").cast("int")), "sum", Grouping(period="1 second"), asked(n))),
        ("intervals", lambda n: intervals.interval_sum(df.withColumn("value", F.lit(50)), "1 second", ranges=asked(n))),
        ("signals", lambda n: intervals.onoff_interval_sum(df, selection, "1 second", ranges=asked(n))),
    ):
        few, many = jobs(spark, f"{name}-2", lambda: make(2)), jobs(spark, f"{name}-90", lambda: make(90))
        assert 0 < many <= few + 2, (name, few, many)
