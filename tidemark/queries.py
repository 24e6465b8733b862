"""Registered queries over the driver's tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.period import Period, friendly_size, period_starts, round_down
from tidemark.model import Grouping, SeriesRange
from tidemark.operators import catalog, intervals, load, ranges, spans, tabular
from tidemark.operators.reduce import key_value_ranges, keys_extent, reduce
from tidemark.operators.running import positions
from tidemark.plans.registry import run
from tidemark.sources import records, sinks, store
from tidemark.sources.delimited import melt_to_series
from tidemark.sources.folders import fresh_path
from tidemark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: 2024-01-10 and 2024-01-20, UTC.
T1, T2, T3 = 1_704_844_800_000, 1_705_276_800_000, 1_705_708_800_000
LA = "America/Los_Angeles"
S = "(SELECT 'events/u' || user_id || '/value' AS column_path, epoch_us(ts) // 1000 AS key, value, user_id, event_type, event_id FROM events)"


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql.replace("{S}", S)
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Events as series: one column of values for each user."""
    path = F.concat(F.lit("events/u"), F.col("user_id").cast("string"), F.lit("/value"))
    return table(spark, sf_dir, "events").select(path.alias("column_path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("key"), "value", *more)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("value", F.col("value") > 250)


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).withColumn("value", (F.col("value") * 100000).cast("long"))


def timed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("trace_id"), (F.unix_millis(F.col("ts").cast("timestamp")) * 1000).alias("time"), (F.col("value") * 1000000).cast("long").alias("duration"))


SPANS = "(SELECT event_type AS name, CAST(user_id AS VARCHAR) AS trace_id, (epoch_us(ts) // 1000) * 1000 AS time, CAST(trunc(value * 1000000) AS BIGINT) AS duration FROM events)"


def four(df: DataFrame, column: str = "value") -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumn(column, F.round(column, 4))


@query(f"SELECT 0 AS range_id, column_path, key, value FROM {{S}} WHERE key >= {T1} AND key < {T2}")
def raw_range(spark, sf_dir):
    return ranges.raw(series(spark, sf_dir), [SeriesRange(T1, T2)])


@query(f"SELECT 0 AS range_id, column_path, key, value FROM {{S}} WHERE key >= {T1} AND key < {T3} UNION ALL SELECT 1, column_path, key, value FROM {{S}} WHERE key < {T2}")
def raw_multi_range(spark, sf_dir):
    return ranges.raw(series(spark, sf_dir), [SeriesRange(T1, T3), SeriesRange(None, T2)])


@query(f"SELECT column_path, key, value FROM (SELECT *, row_number() OVER (PARTITION BY column_path ORDER BY key) AS n FROM {{S}} WHERE key >= {T1}) WHERE n <= 5")
def range_limit_first(spark, sf_dir):
    return ranges.limit_range(series(spark, sf_dir), start=T1, limit=5)


@query(f"SELECT column_path, key, value FROM (SELECT *, row_number() OVER (PARTITION BY column_path ORDER BY key DESC) AS n FROM {{S}} WHERE key < {T2}) WHERE n <= 5")
def range_limit_last(spark, sf_dir):
    return ranges.limit_range(series(spark, sf_dir), until=T2, limit=5)


@query(f"""SELECT column_path, key, value FROM {{S}} WHERE key >= {T1} AND key < {T2}
UNION ALL SELECT column_path, max(key), arg_max(value, key) FROM {{S}} WHERE key < {T1} GROUP BY 1
UNION ALL SELECT column_path, min(key), arg_min(value, key) FROM {{S}} WHERE key >= {T2} GROUP BY 1""")
def range_with_edges(spark, sf_dir):
    return ranges.in_range(series(spark, sf_dir), T1, T2, edge_extra=True)


def _hourly(fn: str, expression: str):
    @query(f"SELECT column_path, 0 AS range_id, key // 3600000 * 3600000 AS key, {expression} AS value FROM {{S}} GROUP BY 1, 3")
    def reduced(spark, sf_dir):
        return four(reduce(series(spark, sf_dir), fn, Grouping(period="1 hour")))

    name = f"reduce_{fn}_by_hour"
    QUERIES[name], SQL[name] = QUERIES.pop("reduced"), SQL.pop("reduced")


for _fn, _sql in (("sum", "round(sum(value), 4)"), ("mean", "round(avg(value), 4)"), ("min", "round(min(value), 4)"), ("max", "round(max(value), 4)"), ("count", "CAST(count(value) AS DOUBLE)")):
    _hourly(_fn, _sql)
SQL["reduce_count_by_hour"] = SQL["reduce_count_by_hour"].replace("CAST(count(value) AS DOUBLE)", "count(value)")
QUERIES["reduce_count_by_hour"] = lambda spark, sf_dir: reduce(series(spark, sf_dir), "count", Grouping(period="1 hour"))


@query("SELECT column_path, 0 AS range_id, CAST((key - 28800000) // 86400000 * 86400000 + 28800000 AS BIGINT) AS key, round(sum(value), 4) AS value FROM {S} GROUP BY 1, 3")
def reduce_sum_by_day_la(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 day", zone=LA)))


@query("SELECT column_path, 0 AS range_id, epoch_ms(date_trunc('month', make_timestamp(key * 1000))) AS key, round(sum(value), 4) AS value FROM {S} GROUP BY 1, 3")
def reduce_sum_by_month(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 month")))


def _anchored_days(n: int, expression: str) -> str:
    return f"""WITH a AS (SELECT *, min(key) OVER (PARTITION BY column_path) // 86400000 AS d0 FROM {{S}})
SELECT column_path, 0 AS range_id, (d0 + (key // 86400000 - d0) // {n} * {n}) * 86400000 AS key, {expression} AS value FROM a GROUP BY 1, 3"""


@query(_anchored_days(7, "round(max(value), 4)"))
def reduce_max_by_week(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "max", Grouping(period="1 week")))


@query(_anchored_days(3, "round(sum(value), 4)"))
def reduce_sum_3day_anchored(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="3 days")))


@query("SELECT column_path, 0 AS range_id, min(key) AS key, round(sum(value), 4) AS value FROM {S} GROUP BY 1")
def reduce_one_part(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum"))


@query(f"SELECT column_path, 0 AS range_id, CAST({T1} AS BIGINT) AS key, round(avg(value), 8) AS value FROM {{S}} WHERE key >= {T1} GROUP BY 1")
def reduce_one_part_from_start(spark, sf_dir):
    return reduce(series(spark, sf_dir), "average", ranges=[SeriesRange(T1)]).withColumn("value", F.round("value", 8))


@query("WITH n AS (SELECT *, (row_number() OVER (PARTITION BY column_path ORDER BY key) - 1) // 10 AS p FROM {S}) SELECT column_path, 0 AS range_id, min(key) AS key, round(sum(value), 4) AS value FROM n GROUP BY column_path, p")
def reduce_by_count(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(count=10)))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY column_path ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY column_path) AS c FROM {S}),
p AS (SELECT *, i // CAST(ceil(c / 7.0) AS BIGINT) AS p FROM n) SELECT column_path, 0 AS range_id, min(key) AS key, round(sum(value), 4) AS value FROM p GROUP BY column_path, p""")
def reduce_into_counted_parts(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(into_counted=7)))


FRIENDLY_SQL = """CASE WHEN d <= 1000 THEN CASE WHEN d <= 1 THEN 1 WHEN d <= 5 THEN 5 WHEN d <= 10 THEN 10 WHEN d <= 25 THEN 25 WHEN d <= 50 THEN 50 WHEN d <= 100 THEN 100 WHEN d <= 250 THEN 250 WHEN d <= 500 THEN 500 ELSE CAST(pow(10, length(CAST(d AS VARCHAR)) - 1) AS BIGINT) END
WHEN d <= 60000 THEN CASE WHEN d // 1000 <= 1 THEN 1 WHEN d // 1000 <= 15 THEN 15 WHEN d // 1000 <= 30 THEN 30 ELSE 60 END
WHEN d <= 3600000 THEN CASE WHEN d // 60000 <= 1 THEN 1 WHEN d // 60000 <= 15 THEN 15 WHEN d // 60000 <= 30 THEN 30 ELSE 60 END
WHEN d <= 86400000 THEN CASE WHEN d // 3600000 <= 1 THEN 1 WHEN d // 3600000 <= 2 THEN 2 WHEN d // 3600000 <= 6 THEN 6 WHEN d // 3600000 <= 12 THEN 12 ELSE 24 END
WHEN d <= 604800000 THEN CASE WHEN d // 86400000 <= 1 THEN 1 ELSE CAST(pow(10, length(CAST(d // 86400000 AS VARCHAR)) - 1) AS BIGINT) END
WHEN d < 31536000000 THEN CASE WHEN d // 604800000 <= 1 THEN 1 ELSE CAST(pow(10, length(CAST(d // 604800000 AS VARCHAR)) - 1) AS BIGINT) END
ELSE CASE WHEN d // 31536000000 <= 1 THEN 1 ELSE CAST(pow(10, length(CAST(d // 31536000000 AS VARCHAR)) - 1) AS BIGINT) END END"""
UNIT_SQL = "CASE WHEN d <= 1000 THEN 'millisecond' WHEN d <= 60000 THEN 'second' WHEN d <= 3600000 THEN 'minute' WHEN d <= 86400000 THEN 'hour' WHEN d <= 604800000 THEN 'day' WHEN d < 31536000000 THEN 'week' ELSE 'year' END"


@query(f"""WITH s AS (SELECT column_path, (max(key) + 1 - min(key)) // 40 AS d, min(key) AS first FROM {{S}} GROUP BY 1),
p AS (SELECT column_path, first, {FRIENDLY_SQL} AS n, {UNIT_SQL} AS unit FROM s),
a AS (SELECT e.column_path, e.key, e.value,
  CASE unit WHEN 'hour' THEN n * 3600000 WHEN 'minute' THEN n * 60000 WHEN 'second' THEN n * 1000 WHEN 'day' THEN n * 86400000 WHEN 'week' THEN n * 604800000 ELSE n END AS size,
  CASE unit WHEN 'hour' THEN 86400000 WHEN 'minute' THEN 3600000 WHEN 'second' THEN 60000 WHEN 'day' THEN 86400000 WHEN 'week' THEN 86400000 ELSE 1000 END AS around, unit, first
  FROM {{S}} e JOIN p USING (column_path)),
b AS (SELECT *, CASE WHEN unit IN ('day', 'week') THEN first // 86400000 * 86400000 ELSE first - (first % around) % size END AS anchor FROM a)
SELECT column_path, 0 AS range_id, CAST(anchor + (key - anchor) // size * size AS BIGINT) AS key, round(sum(value), 4) AS value FROM b GROUP BY 1, 3""")
def reduce_into_duration_parts(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(into_duration=40)))


EMPTIES = """WITH h AS (SELECT column_path, key // 3600000 AS h, round(sum(value), 4) AS value FROM {S} WHERE key >= %(a)d AND key < %(b)d GROUP BY 1, 2),
c AS (SELECT DISTINCT column_path FROM h),
e AS (SELECT column_path, unnest(generate_series(%(h0)d, %(h1)d)) AS h FROM c)
SELECT e.column_path, 0 AS range_id, e.h * 3600000 AS key, h.value FROM e LEFT JOIN h ON e.column_path = h.column_path AND e.h = h.h""" % {"a": T1 + 1_800_000, "b": T2, "h0": T1 // 3_600_000, "h1": T2 // 3_600_000 - 1}


@query(EMPTIES)
def reduce_by_hour_empties(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 hour", empties=True), [SeriesRange(T1 + 1_800_000, T2)]))


@query("""WITH a AS (SELECT *, min(key) OVER (PARTITION BY column_path) // 3600000 AS h0 FROM {S})
SELECT column_path, 0 AS range_id, key // 3600000 * 3600000 AS key, round(sum(value), 4) AS value FROM a WHERE key // 3600000 - h0 < 100 GROUP BY 1, 3""")
def reduce_max_parts(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 hour", max_parts=100)))


@query("SELECT column_path, min(key) AS min_key, max(key) AS max_key, min(value) AS min_value, max(value) AS max_value FROM {S} GROUP BY 1")
def key_value_ranges_by_series(spark, sf_dir):
    return key_value_ranges(series(spark, sf_dir))


@query("SELECT min(key) AS first_key, max(key) AS last_key FROM {S}")
def keys_extent_of_all(spark, sf_dir):
    return keys_extent(series(spark, sf_dir))


@query("SELECT column_path, key, value, row_number() OVER (PARTITION BY column_path ORDER BY key) - 1 AS position FROM {S}")
def positions_in_series(spark, sf_dir):
    return positions(series(spark, sf_dir), ["column_path"])


ISLANDS = """i AS (SELECT {by}, key, on_, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY column_path ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM b),
o AS (SELECT {by}, min(key) FILTER (WHERE on_) AS start, max(key) AS "end" FROM i GROUP BY {by}, coalesce(g, 0) HAVING bool_or(on_))"""
MERGE = """m AS (SELECT *, max("end") OVER (PARTITION BY {g} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {g} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM m),
u AS (SELECT {g}, min(start) AS start, max("end") AS "end" FROM n GROUP BY {g}, isl)"""
SIGNALS = "b AS (SELECT column_path, key, value > 250 AS on_, user_id FROM {S})"
DURATIONS = 'o AS (SELECT column_path, key AS start, key + CAST(trunc(value * 100000) AS BIGINT) AS "end" FROM {S})'
CUT = """c AS (SELECT {g}, unnest(generate_series(start // 86400000, greatest("end" - 1, start) // 86400000)) AS d, start, "end" FROM u),
v AS (SELECT {g}, d * 86400000 AS key, least("end", (d + 1) * 86400000) - greatest(start, d * 86400000) AS part FROM c)"""


@query(f"WITH {SIGNALS}, {ISLANDS.format(by='column_path')} SELECT column_path, start, \"end\" FROM o")
def onoff_intervals(spark, sf_dir):
    return intervals.onoff_to_intervals(signals(spark, sf_dir))


@query(f"WITH {DURATIONS}, {MERGE.format(g='column_path')} SELECT column_path, start, \"end\" FROM u")
def merged_intervals(spark, sf_dir):
    return intervals.merge_intervals(intervals.durations_to_intervals(durations(spark, sf_dir)))


@query(f"WITH {DURATIONS}, {MERGE.format(g='column_path')}, {CUT.format(g='column_path')} SELECT column_path, key, CAST(sum(part) AS BIGINT) AS value FROM v WHERE part > 0 GROUP BY 1, 2")
def interval_sum_by_day(spark, sf_dir):
    return run("IntervalSum", durations(spark, sf_dir), {"period": "1 day"})


@query(f"WITH {DURATIONS}, {MERGE.format(g='column_path')} SELECT column_path, min(start) AS key, CAST(sum(\"end\" - start) AS BIGINT) AS value FROM u GROUP BY 1")
def interval_total(spark, sf_dir):
    return intervals.interval_sum(durations(spark, sf_dir))


GROUPED = f"WITH {SIGNALS}, {ISLANDS.format(by='column_path, user_id')}, og AS (SELECT user_id % 3 AS group_id, start, \"end\" FROM o), {MERGE.format(g='group_id').replace('FROM o)', 'FROM og)')}, {CUT.format(g='group_id')}"


@query(f"""{GROUPED}, s AS (SELECT group_id, key, CAST(sum(part) AS BIGINT) AS value FROM v WHERE part > 0 GROUP BY 1, 2)
SELECT g.group_id, k.key, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT key FROM s) k CROSS JOIN (SELECT DISTINCT user_id % 3 AS group_id FROM events) g LEFT JOIN s ON s.key = k.key AND s.group_id = g.group_id""")
def onoff_interval_sum_by_day(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    selection = events.select((F.col("user_id") % 3).alias("group_id"), F.concat(F.lit("events/u"), F.col("user_id").cast("string"), F.lit("/value")).alias("column_path")).distinct()
    return run("OnOffIntervalSum", signals(spark, sf_dir), {"period": "1 day"}, selection)




@query("SELECT * FROM (PIVOT (SELECT event_type, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2) ON event_type IN ('click', 'view', 'purchase', 'signup', 'error') USING coalesce(max(n), 0) GROUP BY key)")
def tabular_by_type(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000).alias("h")).agg(F.count("*").alias("value"))
    wanted = ["click", "view", "purchase", "signup", "error"]
    return tabular.zero_fill(tabular.tabular(counts.select("event_type", (F.col("h") * 3_600_000).alias("key"), "value"), wanted, by="event_type"), wanted)


def catalog_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return e.select(F.concat_ws("/", F.lit("app"), F.concat(F.lit("u"), F.col("user_id").cast("string")), "event_type").alias("column_path"))


PATHS = "(SELECT DISTINCT 'app/u' || user_id || '/' || event_type AS column_path, user_id, event_type FROM events)"


@query(f"SELECT DISTINCT 'app' AS lookup_key, 'app/u' || user_id AS entity_path FROM {PATHS}")
def entities(spark, sf_dir):
    return catalog.entities(catalog_paths(spark, sf_dir))


@query(f"SELECT DISTINCT 'app' AS parent, 'app/u' || user_id AS child, false AS is_column FROM {PATHS} UNION ALL SELECT 'app/u' || user_id, column_path, true FROM {PATHS}")
def dataset_children(spark, sf_dir):
    return catalog.dataset_children(catalog_paths(spark, sf_dir))


@query(f"SELECT column_path FROM {PATHS} WHERE user_id = 1")
def entity_columns(spark, sf_dir):
    return catalog.entity_columns(catalog_paths(spark, sf_dir), "app/u1")


@query(f"SELECT column_path, 'app/u' || user_id AS dataset, event_type AS \"column\" FROM {PATHS}")
def split_paths(spark, sf_dir):
    return catalog.split_paths(catalog_paths(spark, sf_dir))


@query("SELECT DISTINCT column_path, 'bigint' AS key_type, 'double' AS value_type FROM {S}")
def columns_catalog(spark, sf_dir):
    return catalog.columns_catalog(series(spark, sf_dir))


@query(f"SELECT column_path, min(key) AS first_key, max(key) AS last_key, count(*) AS items FROM {{S}} WHERE key >= {T1} GROUP BY 1")
def first_last_count(spark, sf_dir):
    return catalog.first_last_count(series(spark, sf_dir), start=T1)


@query("SELECT column_path, max(key) AS key, arg_max(value, key) AS value FROM {S} GROUP BY 1")
def last_item(spark, sf_dir):
    return catalog.first_item(series(spark, sf_dir), last=True)


@query("WITH p AS (SELECT 'events/u' || c_custkey || '/value' AS column_path, c_custkey AS position FROM customer) SELECT * FROM p WHERE column_path IN (SELECT column_path FROM {S})")
def validate_paths(spark, sf_dir):
    paths = table(spark, sf_dir, "customer").select(F.concat(F.lit("events/u"), F.col("c_custkey").cast("string"), F.lit("/value")).alias("column_path"), F.col("c_custkey").alias("position"))
    return catalog.validate_paths(paths, series(spark, sf_dir))


@query("""SELECT 'double' AS value_type, count(*) AS items FROM events UNION ALL SELECT 'string', count(*) FROM events
UNION ALL SELECT 'bigint', count(*) FROM orders""")
def count_by_type(spark, sf_dir):
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    kinds = [e.select(F.lit("double").alias("value_type")), e.select(F.lit("string").alias("value_type")), o.select(F.lit("bigint").alias("value_type"))]
    return catalog.count_by_type(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]))


@query(f"""WITH g AS (SELECT name, trace_id, time - lag(time + duration // 1000) OVER (PARTITION BY name, trace_id ORDER BY time, duration) AS gap FROM {SPANS}),
gs AS (SELECT name, trace_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gap_us FROM g GROUP BY 1, 2)
SELECT s.name, s.trace_id, count(*) AS spans, CAST(sum(duration) // 1000 AS BIGINT) AS total_us, max(time + duration // 1000) - min(time) AS extent_us, min(time) AS first_time, any_value(gap_us) AS gap_us
FROM {SPANS} s JOIN gs ON s.name = gs.name AND s.trace_id = gs.trace_id GROUP BY 1, 2""")
def span_summary(spark, sf_dir):
    return spans.span_summary(timed_spans(spark, sf_dir))


@query(f"""WITH g AS (SELECT *, lag(time + duration // 1000) OVER w AS before, count(*) OVER (PARTITION BY name, trace_id) AS n FROM {SPANS} WINDOW w AS (PARTITION BY name, trace_id ORDER BY time, duration))
SELECT name, trace_id, time, coalesce(time - before, 0) AS gap FROM g WHERE before IS NOT NULL OR n = 1""")
def span_gaps(spark, sf_dir):
    return spans.span_gaps(timed_spans(spark, sf_dir))


@query(f"SELECT DISTINCT name FROM {SPANS}")
def span_names(spark, sf_dir):
    return spans.span_names(timed_spans(spark, sf_dir))


@query(f"SELECT name, arg_max(trace_id, time) AS trace_id FROM {SPANS} GROUP BY 1")
def last_trace(spark, sf_dir):
    return spans.last_trace(timed_spans(spark, sf_dir))


@query(f"SELECT * FROM {SPANS} WHERE regexp_full_match(name, 'c.*|s.*')")
def spans_named(spark, sf_dir):
    return spans.spans_named(timed_spans(spark, sf_dir), "c.*|s.*", regex=True)


@query("SELECT CASE event_type WHEN 'view' THEN 'look' ELSE event_type END AS category, key FROM {S} WHERE event_type IN ('view', 'click')")
def times_by_category(spark, sf_dir):
    labelled = series(spark, sf_dir, "event_type").withColumn("value", F.col("event_type"))
    return spans.times_by_category(labelled, ["look", "click"], {"view": "look"})


@query("""SELECT CAST(user_id AS VARCHAR) AS record_id, 'app/flags' AS column_path, epoch_us(ts) // 1000 // 86400000 AS key,
bit_or(CASE event_type WHEN 'click' THEN CASE WHEN value > 250 THEN 3 ELSE 1 END WHEN 'view' THEN CASE WHEN value > 250 THEN 12 ELSE 4 END END::BIGINT)::VARCHAR AS value
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 3
UNION ALL SELECT CAST(user_id AS VARCHAR), 'app/' || event_type, epoch_us(ts) // 1000 // 86400000, CASE WHEN value > 250 THEN 'true' ELSE 'false' END FROM events WHERE event_type NOT IN ('click', 'view')""")
def fold_flags(spark, sf_dir):
    e = series(spark, sf_dir, "user_id", "event_type")
    rows = e.select(F.col("user_id").cast("string").alias("record_id"), F.concat(F.lit("app/"), "event_type").alias("column_path"), F.floor(F.col("key") / 86_400_000).alias("key"), (F.col("value") > 250).alias("value"))
    return load.fold_flags(rows, {"click": 0, "view": 1})


@query("SELECT event_id, (event_id >> 2) & 1 = 1 AS present, CASE WHEN (event_id >> 2) & 1 = 1 THEN (event_id >> 3) & 1 = 1 END AS flag FROM events")
def flag_value(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    flag = scalars.flag_value(F.col("event_id"), 1)
    return e.select("event_id", flag.isNotNull().alias("present"), flag.alias("flag"))


@query("""WITH a AS (SELECT user_id, (epoch_us(ts) // 1000) // 3600000 AS k, value, event_id FROM events)
SELECT 'u' || user_id AS column_path, k AS key, arg_max(value, event_id) AS value, max(event_id) AS ingest_seq FROM a GROUP BY 1, 2""")
def latest_wins(spark, sf_dir):
    e = series(spark, sf_dir, "user_id", "event_id")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("column_path"), F.floor(F.col("key") / 3_600_000).alias("key"), "value", F.col("event_id").alias("ingest_seq"))
    return store.latest_wins(rows)


@query("""WITH base AS (SELECT column_path, key, value FROM {S} WHERE event_id % 2 = 0), up AS (SELECT column_path, key, value + 1 AS value FROM {S} WHERE event_id % 4 < 2), del AS (SELECT column_path, key FROM {S} WHERE event_id % 6 = 0)
SELECT column_path, key, value FROM up UNION ALL
SELECT b.column_path, b.key, b.value FROM base b ANTI JOIN del d ON b.column_path = d.column_path AND b.key = d.key ANTI JOIN up u ON b.column_path = u.column_path AND b.key = u.key""")
def merge_updates(spark, sf_dir):
    e = series(spark, sf_dir, "event_id")
    base, up, gone = e.where("event_id % 2 = 0"), e.where("event_id % 4 < 2").withColumn("value", F.col("value") + 1), e.where("event_id % 6 = 0")
    return store.merge_updates(base.drop("event_id"), up.drop("event_id"), gone)


@query("""SELECT 'orders/' || name AS column_path, key, value FROM (UNPIVOT (SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders) ON o_totalprice, o_custkey INTO NAME name VALUE value)""")
def melted_orders(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_custkey").cast("double").alias("o_custkey"))
    return melt_to_series(wide, "orders", "o_orderkey")


@query("SELECT 'in/u' || user_id || '/' || event_type || '/' || 'value' AS column_path, epoch_us(ts) // 1000 AS key, CAST(event_id AS VARCHAR) AS value, 'long' AS value_type FROM events")
def flatten_array(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts").alias("day")  # so that no record's array grows with the table's length in time
    nested = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("id2"), day).agg(F.collect_list(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("value"))).alias("elements"))
    return records.flatten_avro_array(nested, ids=[("id", None), ("id2", "none")], prefix="in")


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN CAST(event_id AS VARCHAR) || '.25' ELSE 'x' || event_id END AS text, ts FROM events)
SELECT event_id, text, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN event_id WHEN 2 THEN event_id * 1000 + 250 ELSE -1 END AS key FROM m""")
def parse_key_ms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number, kind = F.col("event_id").cast("string"), F.col("event_id") % 4
    text = F.when(kind == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(kind == 1, number).when(kind == 2, F.concat(number, F.lit(".25"))).otherwise(F.concat(F.lit("x"), number))
    return e.select("event_id", text.alias("text")).withColumn("key", F.coalesce(scalars.parse_key_ms(F.col("text")), F.lit(-1)))


@query(f"WITH t AS (SELECT event_id, CAST(trunc(value * value * value * event_id) AS BIGINT) AS d FROM events) SELECT event_id, d, CAST({FRIENDLY_SQL} AS BIGINT) AS n, {UNIT_SQL} AS unit FROM t")
def friendly_period(spark, sf_dir):
    d = F.floor(F.col("value") * F.col("value") * F.col("value") * F.col("event_id"))
    n, unit = friendly_size(F.col("d"))
    return table(spark, sf_dir, "events").select("event_id", d.alias("d")).select("event_id", "d", n.alias("n"), unit.alias("unit"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS key, ts FROM events)
SELECT event_id, key - (key % 60000) % 15000 AS s15, key - (key % 3600000) % 420000 AS m7, key - (key % 86400000) % 21600000 AS h6,
key // 86400000 * 86400000 AS d3, epoch_ms(make_timestamp(year(ts), greatest(month(ts) // 3 * 3, 1), 1, 0, 0, 0)) AS months3, epoch_ms(make_timestamp(year(ts), 1, 1, 0, 0, 0)) AS y1 FROM e""")
def rounded_keys(spark, sf_dir):
    periods = {"s15": "15 seconds", "m7": "7 minutes", "h6": "6 hours", "d3": "3 days", "months3": "3 months", "y1": "1 year"}
    keyed = series(spark, sf_dir, "event_id")
    return keyed.select("event_id", *[round_down(F.col("key"), Period.parse(p)).alias(n) for n, p in periods.items()])


@query("SELECT column_path, key, '[' || key || ',' || event_id || ']' AS pair FROM {S}")
def json_pairs(spark, sf_dir):
    return sinks.to_json_pairs(series(spark, sf_dir, "event_id").select("column_path", "key", F.col("event_id").alias("value")))


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE user_id || chr(9) || event_type || chr(9) || (epoch_us(ts) // 1000) || chr(9) || event_id END AS text, * EXCLUDE (event_id) FROM events)
SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'sample-data/path/' || user_id || '/' || event_type || '/Latency/value' END AS column_path, CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) // 1000 ELSE -1 END AS key, CASE WHEN event_id % 10 <> 0 THEN CAST(event_id AS DOUBLE) ELSE -1 END AS value, CASE WHEN event_id % 10 = 0 THEN 'deserialize' END AS error FROM m""")
def decoded_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat_ws("\t", F.col("user_id").cast("string"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.col("event_id").cast("string"))
    messages = e.select(F.when(F.col("event_id") % 10 == 0, "bad").otherwise(text).cast("binary").alias("value"))
    decoded = records.decode_tsv_message(messages)
    return decoded.withColumn("column_path", F.when(F.col("error").isNull(), F.col("column_path"))).na.fill(-1, ["key", "value"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS key, CAST(o_totalprice AS DOUBLE) AS value FROM orders)
SELECT 'c' || o_custkey AS column_path, 0 AS range_id, epoch_ms(date_trunc('year', make_timestamp(key * 1000))) AS key, round(sum(value), 2) AS value FROM o GROUP BY 1, 3""")
def orders_sum_by_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("column_path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("key"), F.col("o_totalprice").cast("double").alias("value"))
    return run("reduceSum", rows, {"period": "1 year"}).withColumn("value", F.round("value", 2))


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS record_id, 'in/' || event_type AS column_path, epoch_us(ts) // 1000 AS key, value FROM events)
SELECT record_id, column_path, key // 86400000 * 86400000 AS key, round(max(value), 4) AS value FROM r WHERE column_path = 'in/click' GROUP BY 1, 2, 3
UNION ALL SELECT record_id, column_path, key, round(value, 4) FROM r WHERE column_path <> 'in/click'""")
def reduce_on_load(spark, sf_dir):
    e = series(spark, sf_dir, "user_id", "event_type")
    rows = e.select(F.col("user_id").cast("string").alias("record_id"), F.concat(F.lit("in/"), "event_type").alias("column_path"), "key", "value")
    return four(load.reduce_by_period_on_load(rows, "1 day", {"click": "max"}))


@query("SELECT 'v' AS column_path, row_number() OVER (ORDER BY value, value) - 1 AS key, value FROM events")
def series_from_values(spark, sf_dir):
    return store.series_from_values(table(spark, sf_dir, "events"), "v", "value")


@query(f"SELECT column_path, key, value * 2 + 1 AS value FROM {{S}} WHERE key >= {T1} - 86400000 AND key < {T2}")
def extended_and_mapped(spark, sf_dir):
    asked, read = ranges.extend_range([SeriesRange(T1, T2)], before=86_400_000)[0]
    found = ranges.in_range(series(spark, sf_dir), read.start, asked.until)
    return ranges.map_values(found, lambda v: v * 2 + 1)


@query("SELECT column_path, key, CAST(event_id AS VARCHAR) AS value, 'long' AS value_type FROM {S} UNION ALL SELECT 't/' || column_path, key, event_type, 'string' FROM {S}")
def scan_all_types(spark, sf_dir):
    """Two typed tables written to a store and scanned together."""
    kept = store.SeriesStore(spark, fresh_path(spark, "store"))
    e = series(spark, sf_dir, "event_id", "event_type")
    kept.write(e.select("column_path", "key", F.col("event_id").alias("value")), "long", 1)
    kept.write(e.select(F.concat(F.lit("t/"), "column_path").alias("column_path"), "key", F.col("event_type").alias("value")), "string", 1)
    return kept.scan_all()


@query("SELECT column_path, key, value, 'double' AS value_type FROM {S}")
def typed_columns(spark, sf_dir):
    e = series(spark, sf_dir, "event_type")
    both = e.select("column_path", "key", "value", F.lit("double").alias("value_type")).unionByName(e.select("column_path", "key", F.lit(0.0).alias("value"), F.lit("flags").alias("value_type")))
    return ranges.of_type(both, "double")


@query(f"SELECT time, duration, name, trace_id FROM (SELECT epoch_us(ts) // 1000 AS time, event_id * 1000 AS duration, event_type AS name, CAST(user_id AS VARCHAR) AS trace_id FROM events)")
def aligned_spans(spark, sf_dir):
    e = series(spark, sf_dir, "event_id", "event_type", "user_id")
    column = lambda c: e.select("key", "event_id", c.alias("value"))
    return spans.spans(column(F.col("event_id") * 1000), column(F.col("event_type")), column(F.col("user_id").cast("string")), ["event_id"])


@query("SELECT CASE user_id WHEN 1 THEN 0 ELSE 1 END AS group_id, column_path, key, value FROM {S} WHERE user_id IN (1, 2, 3)")
def selected_sources(spark, sf_dir):
    selection = catalog.select_sources(spark, ["events/u1/value", ["events/u2/value", "events/u3/value"]])
    return catalog.selected(series(spark, sf_dir), selection).select("group_id", "column_path", "key", "value")


@query("SELECT column_path, key, value FROM {S} WHERE user_id = 7")
def dataset_items(spark, sf_dir):
    return catalog.read_dataset(series(spark, sf_dir), "events/u7")


@query("SELECT user_id, bit_or(CASE WHEN value > 250 THEN 3 ELSE 1 END::BIGINT << (2 * (event_id % 3))) AS flags FROM events GROUP BY 1")
def flags_set(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bits = F.coalesce(*[F.when(F.col("event_id") % 3 == p, scalars.set_flag(F.lit(0).cast("long"), p, F.col("value") > 250)) for p in range(3)])
    return e.groupBy("user_id").agg(F.bit_or(bits).alias("flags"))


@query("SELECT column_path, key, value FROM {S} WHERE value > 400")
def watched_items(spark, sf_dir):
    return ranges.watch(series(spark, sf_dir), F.col("value") > 400)


#: Files of each quarter of a stream that queries read.
QUARTER_FILES, FILE_ROWS = 4, 5_000_000


def quarter_files(df: DataFrame) -> int:
    return max(QUARTER_FILES, -(-df.count() // FILE_ROWS))


def arriving(spark: SparkSession, sf_dir: str, *more: str, parts: int = 4) -> DataFrame:
    """The events as a stream of files, in the order of time: each part of the time is a batch of ``quarter_files`` files."""
    e, folder = series(spark, sf_dir, *more), fresh_path(spark, "stream")
    low, high = e.agg(F.min("key"), F.max("key")).first()
    edges, files = [low + (high + 1 - low) * i // parts for i in range(parts + 1)], quarter_files(e)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        ranges.in_range(e, a, b).repartition(files).write.mode("append").parquet(folder)
    types = {"event_id": "long", "event_type": "string", "user_id": "long"}
    schema = ", ".join(["column_path string, key long, value double", *(f"{c} {types[c]}" for c in more)])
    return streams.follow(spark, folder, schema, max_files=files)


def sent(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream sends, with the number of its batch, after all files were read."""
    out = fresh_path(spark, "sent")
    query = streams.start(stream, lambda b, n: b.withColumn("ingest_seq", F.lit(n)).write.mode("append").parquet(out), fresh_path(spark, "progress"), mode=mode)
    query.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT column_path, key // 3600000 * 3600000 AS key, round(sum(value), 4) AS value FROM {S} GROUP BY 1, 2")
def stream_sum_by_hour(spark, sf_dir):
    found = sent(spark, streams.stream_reduce(arriving(spark, sf_dir), "sum", "1 hour"), "update")
    return four(store.latest_wins(found).drop("ingest_seq"))


@query("""WITH h AS (SELECT column_path, key // 86400000 AS d, round(sum(value), 4) AS value FROM {S} GROUP BY 1, 2),
e AS (SELECT column_path, unnest(generate_series(min(d), max(d))) AS d FROM h GROUP BY 1)
SELECT e.column_path, e.d * 86400000 AS key, h.value FROM e LEFT JOIN h ON e.column_path = h.column_path AND e.d = h.d""")
def stream_sum_with_empties(spark, sf_dir):
    found = sent(spark, streams.stream_reduce_with_empties(arriving(spark, sf_dir), "1 day"), "update")
    return four(streams.newest_with_empties(found).drop("ingest_seq"))


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY column_path ORDER BY key) - 1) // 10 AS p, count(*) OVER (PARTITION BY column_path) AS c FROM {S})
SELECT column_path, min(key) AS key, round(sum(value), 4) AS value FROM n WHERE (p + 1) * 10 <= c GROUP BY column_path, p""")
def stream_sum_of_tens(spark, sf_dir):
    return four(sent(spark, streams.stream_count_reduce(arriving(spark, sf_dir), 10), "append").drop("ingest_seq"))


@query("""WITH b AS (SELECT *, (SELECT min(key) FROM {S}) AS low, (SELECT max(key) + 1 FROM {S}) AS high FROM {S}),
p AS (SELECT *, CASE WHEN key < low + (high - low) // 4 THEN 0 WHEN key < low + (high - low) * 2 // 4 THEN 1 WHEN key < low + (high - low) * 3 // 4 THEN 2 ELSE 3 END AS part FROM b)
SELECT column_path, min(key) AS key, round(sum(value), 4) AS value FROM p GROUP BY column_path, part""")
def stream_batch_totals(spark, sf_dir):
    out = fresh_path(spark, "totals")
    emit = lambda df, n: df.select("column_path", "key", "value").write.mode("append").parquet(out)
    streams.stream_batch_reduce(arriving(spark, sf_dir), "sum", emit, fresh_path(spark, "progress")).awaitTermination()
    return four(spark.read.parquet(out))


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def types_in_first_seen_order(spark, sf_dir):
    return catalog.distinct_in_order(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("WITH r AS (SELECT column_path, min(key) AS a, max(key) + 1 AS b FROM {S} GROUP BY 1) SELECT column_path, unnest(generate_series(a // 86400000, (b - 1) // 86400000)) * 86400000 AS start FROM r")
def period_starts_by_series(spark, sf_dir):
    r = series(spark, sf_dir).groupBy("column_path").agg(F.min("key").alias("a"), (F.max("key") + 1).alias("b"))
    return r.select("column_path", F.explode(period_starts(F.col("a"), F.col("b"), Period.parse("1 day"))).alias("start"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props IS NOT NULL AS valid FROM events")
def json_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = scalars.json_text(F.col("props"))
    return e.select("event_id", F.get_json_object(text, "$.k").cast("long").alias("k"), text.isNotNull().alias("valid"))
