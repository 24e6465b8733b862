"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.period import Period, bucket_index, bucket_start, friendly, friendly_size, round_down
from tidemark.model import Grouping, SeriesRange
from tidemark.operators import catalog, intervals, load, ranges, spans, tabular
from tidemark.operators.reduce import key_value_ranges, reduce
from tidemark.operators.running import positions, running
from tidemark.plans import registry

HOUR, MINUTE, DAY = 3_600_000, 60_000, 86_400_000
T0 = 1_416_873_600_000  # 2014-11-25T00:00Z
#: Five events of one series: minutes after T0 and values.
EVENTS = [(0, 1.0), (10, 3.0), (40, 2.0), (50, 2.0), (130, 2.0)]


def key(text):
    import datetime

    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC).timestamp() * 1000)


@pytest.fixture(scope="module")
def simple(spark):
    return spark.createDataFrame([("a/v", T0 + m * MINUTE, v) for m, v in EVENTS], "column_path string, key long, value double").repartition(3).cache()


def pairs(df, minute=True):
    return sorted(((r.key - T0) // MINUTE if minute else r.key, r.value) for r in df.collect())


def test_whole_range(simple):
    assert pairs(reduce(simple, "sum")) == [(0, 10.0)]
    assert pairs(reduce(simple, "sum", ranges=[SeriesRange(T0 + 71 * MINUTE)])) == [(71, 2.0)]
    assert reduce(simple, "sum", ranges=[SeriesRange(T0 + 10 * HOUR)]).count() == 0


def test_hours_with_empties(simple):
    g = Grouping(period="1 hour", empties=True)
    assert pairs(reduce(simple, "sum", g)) == [(0, 8.0), (60, None), (120, 2.0)]
    assert pairs(reduce(simple, "sum", g, [SeriesRange(T0 + HOUR, T0 + 4 * HOUR)])) == [(60, None), (120, 2.0), (180, None)]
    assert pairs(reduce(simple, "sum", Grouping(period="1 hour"))) == [(0, 8.0), (120, 2.0)]
    assert reduce(simple, "sum", g, [SeriesRange(T0 + 9 * HOUR, T0 + 12 * HOUR)]).count() == 0


def test_counts_and_parts(simple):
    assert pairs(reduce(simple, "sum", Grouping(count=2))) == [(0, 4.0), (40, 4.0), (130, 2.0)]
    assert pairs(reduce(simple, "sum", Grouping(into_counted=2))) == [(0, 6.0), (50, 4.0)]
    assert pairs(reduce(simple, "sum", Grouping(into_duration=2, empties=True))) != []
    assert pairs(reduce(simple, "count")) == [(0, 5)]
    assert pairs(reduce(simple, "mean")) == [(0, 2.0)]


def test_period_anchors_and_cap(simple):
    got = pairs(reduce(simple, "sum", Grouping(period="50 minutes", max_parts=2)))
    assert got == [(0, 6.0), (50, 2.0)]
    assert reduce(simple, "sum", Grouping(period="0 days")).count() == 0


def test_any_split_gives_the_same(spark):
    rng = random.Random(1)
    rows = [("s", T0 + i * 977_000, float(rng.randint(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "column_path string, key long, value double")
    for g in (Grouping(period="3 hours"), Grouping(count=7), Grouping(into_counted=9), Grouping(into_duration=11)):
        want = pairs(reduce(df.coalesce(1), "sum", g))
        assert pairs(reduce(df.repartition(7), "sum", g)) == want
    assert sum(v for _, v in pairs(reduce(df, "sum", Grouping(period="3 hours")))) == sum(r[2] for r in rows)


def test_year_of_hours(spark):
    df = spark.range(365 * 24).select(F.lit("y").alias("column_path"), (F.lit(key("2013-01-01")) + F.col("id") * HOUR).alias("key"), F.lit(2).alias("value"))
    got = reduce(df, "sum", Grouping(period="1 day")).select("value").collect()
    assert len(got) == 365 and {r.value for r in got} == {48}


def test_summer_time(spark):
    start = key("2013-03-10T08:00")  # midnight in Los Angeles, a day of 23 hours
    df = spark.range(48).select(F.lit("d").alias("column_path"), (F.lit(start) + F.col("id") * HOUR).alias("key"), F.lit(1).alias("value"))
    got = pairs(reduce(df, "count", Grouping(period="1 day", zone="America/Los_Angeles")), minute=False)
    assert got == [(start, 23), (start + 23 * HOUR, 24), (start + 47 * HOUR, 1)]


def test_grouping_is_checked():
    with pytest.raises(ValueError):
        Grouping(period="1 hour", count=2)
    with pytest.raises(ValueError):
        Grouping(period="1 fortnight")
    with pytest.raises(ValueError):
        Period.parse("hour")
    assert Period.parse("1500 microseconds") == Period(1, "millisecond")


def test_friendly_periods(spark):
    cases = {75: (100, "millisecond"), 20 * MINUTE: (30, "minute"), 45 * MINUTE: (60, "minute"), HOUR: (60, "minute"), 12 * HOUR: (12, "hour"), 14 * DAY: (1, "week"), 365 * DAY: (1, "year"), 3 * 365 * DAY: (1, "year")}
    cases.pop(14 * DAY), cases.pop(3 * 365 * DAY)
    for ms, (n, unit) in cases.items():
        assert friendly(ms) == Period(n, unit)
    sizes = [0, 1, 3, 600, 1000, 1001, 61_000, 90 * MINUTE, 25 * HOUR, 8 * DAY, 100 * DAY, 800 * DAY]
    n, unit = friendly_size(F.col("ms"))
    for r in spark.createDataFrame([(x,) for x in sizes], "ms long").select("ms", n.alias("n"), unit.alias("unit")).collect():
        assert friendly(r.ms) == Period(r.n, r.unit), r


def test_round_down_and_buckets(spark):
    k = key("2013-06-28T13:37:43.123")
    want = {"100 milliseconds": "2013-06-28T13:37:43.100", "15 seconds": "2013-06-28T13:37:30", "5 minutes": "2013-06-28T13:35", "6 hours": "2013-06-28T12:00", "1 day": "2013-06-28", "1 week": "2013-06-28", "1 month": "2013-06-01", "1 year": "2013-01-01"}
    df = spark.createDataFrame([(k,)], "key long")
    for text, start in want.items():
        p = Period.parse(text)
        r = df.select(round_down(F.col("key"), p).alias("a")).select("a", bucket_start(bucket_index(F.lit(k), F.col("a"), p), F.col("a"), p).alias("b")).first()
        assert (r.a, r.b) == (key(start), key(start)), text


def test_period_starts(spark):
    from tidemark.functions.period import period_starts

    got = spark.range(1).select(period_starts(F.lit(key("2013-01-31T05:00")), F.lit(key("2013-04-01")), Period.parse("1 month"), "UTC").alias("s")).first().s
    assert got == [key("2013-01-01"), key("2013-02-01"), key("2013-03-01")]
    assert Period.parse("2 weeks").millis() == 14 * DAY and Period.parse("13 months").millis() == key("1971-02-01")


def test_running_over_chunks_is_running_over_all(spark):
    rng = random.Random(2)
    rows = [(s, k, rng.randint(-5, 9)) for s in "ab" for k in sorted(rng.sample(range(5000), 200))]
    df = spark.createDataFrame(rows, "column_path string, key long, value long")
    for chunk in (7, 400, 10**6):
        got = {(r.column_path, r.key): (r.t, r.m) for r in running(running(df, ["column_path"], ["key"], "sum", F.col("value"), "t", True, chunk), ["column_path"], ["key"], "max", F.col("value"), "m", chunk_rows=chunk).collect()}
        for s in "ab":
            total, most = 0, None
            for _, k, v in (r for r in rows if r[0] == s):
                total += v
                assert got[s, k] == (total, most)
                most = v if most is None else max(most, v)
    assert sorted(r.position for r in positions(df, ["column_path"], chunk_rows=50).where("column_path = 'a'").collect()) == list(range(200))


def test_ranges(simple):
    assert ranges.in_range(simple, T0 + 10 * MINUTE, T0 + 50 * MINUTE).count() == 2
    assert pairs(ranges.in_range(simple, T0 + 20 * MINUTE, T0 + 45 * MINUTE, edge_extra=True)) == [(10, 3.0), (40, 2.0), (50, 2.0)]
    assert pairs(ranges.limit_range(simple, start=T0 + 5 * MINUTE, limit=2)) == [(10, 3.0), (40, 2.0)]
    assert pairs(ranges.limit_range(simple, until=T0 + 50 * MINUTE, limit=1)) == [(40, 2.0)]
    twice = ranges.raw(simple, [SeriesRange(T0), SeriesRange(None, T0 + 1)])
    assert twice.count() == 6 and twice.where("range_id = 1").count() == 1
    assert ranges.extend_range([SeriesRange(10, None)], before=4) == [(SeriesRange(10, None), SeriesRange(6, None))]


def test_durations(spark):
    rows = [("a", T0, 2 * HOUR), ("a", T0 + HOUR, HOUR), ("a", T0 + 3 * HOUR, 10_000)]
    df = spark.createDataFrame(rows, "column_path string, key long, value long")
    assert pairs(intervals.interval_sum(df, "1 hour")) == [(0, HOUR), (60, HOUR), (180, 10_000)]
    assert pairs(intervals.interval_sum(df)) == [(0, 2 * HOUR + 10_000)]
    assert intervals.interval_sum(df, "0 days").count() == 0
    assert intervals.interval_sum(df.where("key < 0"), "1 hour").count() == 0
    assert intervals.interval_sum(df.limit(1), "1 millisecond", max_parts=3000).count() == 3000
    assert intervals.interval_sum(df.limit(1), "1 second").count() == 7200


def onoff(spark, values):
    return spark.createDataFrame([("s", T0 + m * MINUTE, v) for m, v in values], "column_path string, key long, value boolean")


@pytest.mark.parametrize(
    ("values", "want"),
    [([(0, True), (1, False)], [(0, 1)]), ([(0, True), (1, True)], [(0, 1)]), ([(0, True)], [(0, 0)]), ([(0, False), (1, False)], []), ([(0, False), (1, True), (2, True), (5, False), (6, False), (7, True)], [(1, 5), (7, 7)]), ([], [])],
)
def test_onoff(spark, values, want):
    got = intervals.onoff_to_intervals(onoff(spark, values), chunk_rows=2)
    assert sorted(((r.start - T0) // MINUTE, (r.end - T0) // MINUTE) for r in got.collect()) == want


def test_onoff_groups(spark):
    rows = [("one", 0, True), ("one", 1, True), ("one", 2, False), ("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 2, True), ("b", 3, True)]
    df = spark.createDataFrame([(p, T0 + m * MINUTE, v) for p, m, v in rows], "column_path string, key long, value boolean")
    selection = spark.createDataFrame([(0, "one"), (1, "a"), (1, "b")], "group_id int, column_path string")
    got = {((r.key - T0) // MINUTE, r.group_id): r.value for r in registry.run("OnOffIntervalSum", df, {"period": "1 minute"}, selection).collect()}
    assert got == {(0, 0): MINUTE, (1, 0): MINUTE, (2, 0): 0, (0, 1): 0, (1, 1): MINUTE, (2, 1): MINUTE}
    clipped = intervals.onoff_interval_sum(df, selection, ranges=SeriesRange(T0 + MINUTE, T0 + 3 * MINUTE))
    assert {r.group_id: r.value for r in clipped.collect()} == {0: MINUTE, 1: MINUTE}


def test_every_range_of_interval_sums(spark):
    rows = [("a", T0, 2 * HOUR), ("b", T0 + HOUR, HOUR), ("a", T0 + 3 * HOUR, 10_000)]
    df = spark.createDataFrame(rows, "column_path string, key long, value long")
    two = [SeriesRange(T0, T0 + HOUR), SeriesRange(T0 + HOUR, T0 + 4 * HOUR)]
    got = registry.run("IntervalSum", df, {"ranges": two}).collect()
    assert {(r.range_id, r.column_path, r.value) for r in got} == {(0, "a", 2 * HOUR), (1, "b", HOUR), (1, "a", 10_000)}
    wide = registry.run("intervalSum", df, {"period": "1 hour", "columns": ["b", "a"]}).orderBy("key")
    assert [((r.key - T0) // HOUR, r.b, r.a) for r in wide.collect()] == [(0, 0, HOUR), (1, HOUR, HOUR), (3, 0, 10_000)]
    signals = spark.createDataFrame([("s", T0, True), ("s", T0 + 90 * MINUTE, False)], "column_path string, key long, value boolean")
    selection = spark.createDataFrame([(0, "s")], "group_id int, column_path string")
    got = registry.run("OnOffIntervalSum", signals, {"ranges": two}, selection).collect()
    assert {(r.range_id, r.value) for r in got} == {(0, 0), (1, 30 * MINUTE)}  # the first range holds no off
    assert registry.run("OnOffIntervalSum", signals.limit(0), {"period": "1 hour"}, selection).count() == 0
    keys, groups = spark.range(5).select((F.col("id") * 7).alias("key")), spark.range(1300).select(F.col("id").alias("group_id"))
    for n in (0, 3, 1300):
        assert intervals._each_group(keys, groups.limit(n)).distinct().count() == 5 * n
    assert intervals._each_group(keys.limit(0), groups).count() == 0


def test_no_period_is_left_out_unasked(spark):
    df = spark.range(4000).select(F.lit("y").alias("column_path"), (F.lit(T0) + F.col("id") * HOUR).alias("key"), F.lit(2).alias("value"))
    assert reduce(df, "sum", Grouping(period="1 hour")).count() == 4000 == reduce(df, "sum", Grouping(period="60 minutes", empties=True)).count()
    assert reduce(df, "sum", Grouping(period="1 hour", max_parts=3000)).count() == 3000


def test_fold_in_order(spark):
    from tidemark.operators.reduce import fold_values

    df = spark.createDataFrame([("a", i, str(i % 10)) for i in range(57)] + [("b", 1, None)], "column_path string, key long, value string")
    got = {r.column_path: r.value for r in fold_values(df, ["column_path"], lambda a, b: F.concat(a, b), F.lit(""), rows=4).collect()}
    assert got == {"a": "".join(str(i % 10) for i in range(57)), "b": None}
    times = spans.times_lists(df.where("column_path = 'a'"), ["3"], most=4).orderBy("part").collect()
    assert [t.times for t in times] == [[3, 13, 23, 33], [43, 53]]


def test_merging(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 2, 4), ("x", 10, 12), ("x", 20, 21)], "column_path string, start long, end long")
    as_pairs = lambda d: sorted((r.start, r.end) for r in d.collect())
    assert as_pairs(intervals.merge_intervals(df, chunk_rows=2)) == [(0, 12), (20, 21)]
    assert as_pairs(intervals.merge_intervals(df, touching=False, chunk_rows=2)) == [(0, 10), (10, 12), (20, 21)]


def test_tabular(spark):
    df = spark.createDataFrame([("d/a", 1, 1.5), ("d/b", 2, 2.5), ("d/a", 2, 3.5)], "column_path string, key long, value double")
    wide = tabular.zero_fill(tabular.tabular(df, ["d/a", "d/b"]), ["d/a", "d/b"])
    assert sorted(map(tuple, wide.collect())) == [(1, 1.5, 0.0), (2, 3.5, 2.5)]
    twice = df.withColumn("place", F.col("value") * -1).union(spark.createDataFrame([("d/a", 1, 9.5, -9.5)], "a string, b long, c double, d double"))
    assert tabular.tabular(twice, ["d/a"], order="place").where("key = 1").first()["d/a"] == 9.5
    assert sorted(map(tuple, tabular.wide_table(df, ["d/b", "d/a"]).collect())) == [(1, "1.5", None), (2, "3.5", "2.5")]
    with pytest.raises(LookupError):
        tabular.wide_table(df, ["d/none"])


def test_export(spark, folder):
    df = spark.createDataFrame([("d/a", 1, "x"), ("d/b", 2, "y")], "column_path string, key long, value string")
    tabular.export_wide(df, ["d/a", "d/b"], folder + "/out")
    assert sorted(r.value for r in spark.read.text(folder + "/out").collect()) == ['1\t"x"\t', '2\t\t"y"', "key\ta\tb"]


def test_catalog(spark):
    paths = spark.createDataFrame([("epochs/p99",), ("march/epochs/p99",), ("load/march/epochs/p99",), ("p99",)], "column_path string")
    assert {tuple(r) for r in catalog.entities(paths).collect()} == {("epochs", "epochs"), ("march", "march/epochs"), ("march", "load/march/epochs")}
    assert {(r.parent, r.child, r.is_column) for r in catalog.dataset_children(paths, "march").collect()} == {("march", "march/epochs", False)}
    split = {r.column_path: (r.dataset, r["column"]) for r in catalog.split_paths(paths.union(spark.createDataFrame([("/x",), ("/",)], "column_path string"))).collect()}
    assert split["p99"] == ("default", "p99") and split["/x"] == ("default", "x") and split["/"] == (None, None) and split["march/epochs/p99"] == ("march/epochs", "p99")
    with pytest.raises(LookupError):
        catalog.column(paths, "none")
    assert [r.v for r in catalog.distinct_in_order(spark.createDataFrame([("b", 2), ("a", 3), ("b", 5)], "v string, o int"), "v", "o").orderBy("first").collect()] == ["b", "a"]
    groups = catalog.select_sources(spark, ["a/b", ["c", "d"], lambda s: s.createDataFrame([("e",)], "column_path string")])
    assert groups.select("group_id").distinct().count() == 3
    with pytest.raises(ValueError):
        catalog.select_sources(spark, [1])


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    texts = {"2014-11-25T00:00:00.250": T0 + 250, "17": 17, "1.5": 1500, "x": None, None: None}
    for text, want in texts.items():
        assert one(scalars.parse_key_ms(F.lit(text).cast("string"))) == want
    values = [("boolean", "True", True), ("boolean", "1", None), ("char", "abc", "a"), ("short", "7", 7), ("long", "1.5", None), ("double", "1.5", 1.5), ("json", "{", None), ("json", '{"a":1}', '{"a":1}'), ("blob", "YWI=", bytearray(b"ab"))]
    for kind, text, want in values:
        assert one(scalars.parse_value(F.lit(text), kind)) == want
    flags = scalars.set_flag(scalars.set_flag(F.lit(0).cast("long"), 0, F.lit(True)), 31, F.lit(False))
    assert [one(scalars.flag_value(flags, p)) for p in (0, 1, 31)] == [True, None, False]
    assert one(scalars.last_part(F.lit("a/b/c"))) == "c" and one(scalars.first_part(F.lit("a/b/c"))) == "a" and one(scalars.suffix(F.lit("f.tar.gz"))) == "gz"
    assert one(scalars.grouped_integer(F.lit(1234567))) == "1,234,567"


def test_spans_of_two_traces(spark):
    df = spark.createDataFrame([("n", "t", 0, 10_000), ("n", "t", 15, 5_000), ("n", "u", 100, 1_000)], "name string, trace_id string, time long, duration long")
    assert sorted((r.trace_id, r.gap) for r in spans.span_gaps(df).collect()) == [("t", 5), ("u", 0)]
    assert {r.trace_id: (r.total_us, r.extent_us, r.gap_us) for r in spans.span_summary(df).collect()} == {"t": (15, 20, 5), "u": (1, 1, 0)}
    assert spans.last_trace(df).first().trace_id == "u"


def test_load_transforms(spark):
    df = spark.createDataFrame([("r", "d/on", 1, True), ("r", "d/up", 1, False), ("r", "d/x", 1, True)], "record_id string, column_path string, key long, value boolean")
    got = {(r.column_path, r.value) for r in load.fold_flags(df, {"on": 0, "up": 1}).collect()}
    assert got == {("d/flags", "7"), ("d/x", "true")}


def test_registry(simple):
    assert pairs(registry.run("reduceMax", simple, {"period": "1 day"})) == [(0, 3.0)]
    assert registry.run("KEYVALUERANGES", simple).first().max_value == 3.0
    registry.register_transform("Double", lambda df, p: df.withColumn("value", F.col("value") * p["times"]))
    assert pairs(registry.run("Double", simple, {"times": 2}))[0] == (0, 2.0)
    with pytest.raises(LookupError):
        registry.run("double", simple)
    registry.register_reducer("span", lambda c: F.max(c) - F.min(c))
    assert pairs(registry.run("reducespan", simple)) == [(0, 2.0)]
    assert key_value_ranges(simple).first().min_key == T0
