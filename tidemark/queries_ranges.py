"""Registered queries of many ranges at once, of far keys and of deep limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.period import Period
from tidemark.model import Grouping, SeriesRange
from tidemark.operators import ranges, spans
from tidemark.operators.reduce import reduce
from tidemark.plans.registry import run
from tidemark.queries import ISLANDS, MERGE, T1, durations, four, query, series, table

HOUR, DAY = 3_600_000, 86_400_000
#: A hundred overlapping ranges of five days, three hours apart, the last two without an end and without a start.
HUNDRED = [SeriesRange(T1 + i * 3 * HOUR, T1 + i * 3 * HOUR + 5 * DAY) for i in range(98)] + [SeriesRange(T1, None), SeriesRange(None, T1)]
R = f"""(SELECT CAST(i AS INT) AS range_id, CASE WHEN i = 98 THEN {T1} WHEN i < 98 THEN {T1} + i * {3 * HOUR} END AS a, CASE WHEN i = 99 THEN {T1} WHEN i < 98 THEN {T1} + i * {3 * HOUR} + {5 * DAY} END AS b FROM range(100) t(i))"""
INSIDE = "(a IS NULL OR key >= a) AND (b IS NULL OR key < b)"


@query(f"SELECT range_id, column_path, key, value FROM {{S}}, {R} WHERE {INSIDE}")
def raw_hundred_ranges(spark, sf_dir):
    """A hundred overlapping ranges in one plan."""
    return ranges.raw(series(spark, sf_dir), HUNDRED)


@query(f"SELECT range_id, column_path, key // {DAY} * {DAY} AS key, round(sum(value), 4) AS value FROM {{S}}, {R} WHERE {INSIDE} GROUP BY 1, 2, 3")
def reduce_hundred_ranges_by_day(spark, sf_dir):
    return four(reduce(series(spark, sf_dir), "sum", Grouping(period="1 day"), HUNDRED))


@query(f"""SELECT range_id, column_path, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY range_id, column_path ORDER BY CASE WHEN a IS NULL THEN -key ELSE key END) AS n FROM {{S}}, {R} WHERE {INSIDE}
) WHERE n <= 3 OR range_id % 2 = 0""")
def raw_hundred_limited_ranges(spark, sf_dir):
    """Every second range has a limit of its own."""
    return ranges.raw(series(spark, sf_dir), [SeriesRange(r.start, r.until, 3 if i % 2 else None) for i, r in enumerate(HUNDRED)])


@query("SELECT event_type AS column_path, event_id AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id < 9000) WHERE n <= 1500")
def range_limit_deep(spark, sf_dir):
    """The last 1,500 items of each series before a key."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("column_path"), F.col("event_id").alias("key"), "value")
    return ranges.limit_range(e, until=9000, limit=1500)


@query("""WITH e AS (SELECT column_path, key, value FROM {S} UNION ALL SELECT DISTINCT column_path, 0, 1.0 FROM {S}),
m AS (SELECT column_path, CAST(epoch_ms(date_trunc('month', make_timestamp(key * 1000))) AS BIGINT) AS key, round(sum(value), 4) AS value FROM e GROUP BY 1, 2),
k AS (SELECT column_path, unnest(generate_series(TIMESTAMP '1970-01-01', make_timestamp(max(key) * 1000), INTERVAL 1 MONTH)) AS since FROM m GROUP BY 1)
SELECT k.column_path, 0 AS range_id, CAST(epoch_ms(since) AS BIGINT) AS key, m.value FROM k LEFT JOIN m ON m.column_path = k.column_path AND m.key = epoch_ms(since)""")
def reduce_far_keys_with_empties(spark, sf_dir):
    """Half a century without items before the first of each series."""
    e = series(spark, sf_dir)
    far = e.select("column_path").distinct().select("column_path", F.lit(0).cast("long").alias("key"), F.lit(1.0).alias("value"))
    return four(reduce(e.unionByName(far), "sum", Grouping(period="1 month", empties=True)))


@query("SELECT column_path, unnest(generate_series(min(key) // 86400000 * 86400000, max(key), 86400000)) AS start FROM {S} GROUP BY 1")
def period_start_rows(spark, sf_dir):
    """The days from each series' first item to its last, as rows."""
    r = series(spark, sf_dir).groupBy("column_path").agg(F.min("key").alias("a"), (F.max("key") + 1).alias("b"))
    return spans.period_starts(r, "a", "b", Period.parse("1 day")).select("column_path", "start")


_OF_RANGES = f"""r AS (SELECT range_id, a, b AS z FROM {R})"""


@query(f"""WITH {_OF_RANGES}, o AS (SELECT range_id, column_path, key AS start, key + CAST(trunc(value * 100000) AS BIGINT) AS "end" FROM {{S}}, r WHERE (a IS NULL OR key >= a) AND (z IS NULL OR key < z)),
{MERGE.format(g='range_id, column_path')} SELECT range_id, column_path, min(start) AS key, CAST(sum("end" - start) AS BIGINT) AS value FROM u GROUP BY 1, 2""")
def interval_sum_of_hundred_ranges(spark, sf_dir):
    """Covered time of a hundred overlapping ranges in one plan."""
    return run("IntervalSum", durations(spark, sf_dir), {"ranges": HUNDRED})


@query(f"""WITH b AS (SELECT column_path, key, value > 30 AS on_, user_id FROM {{S}}), {_OF_RANGES},
i AS (SELECT range_id, user_id, column_path, key, on_, a, z, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY range_id, column_path ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
  FROM b, r WHERE (a IS NULL OR key >= a - {DAY}) AND (z IS NULL OR key < z)),
oo AS (SELECT range_id, user_id, a, min(key) FILTER (WHERE on_) AS start, max(key) AS "end" FROM i GROUP BY range_id, user_id, column_path, a, coalesce(g, 0) HAVING bool_or(on_)),
o AS (SELECT range_id, user_id % 3 AS group_id, CASE WHEN a > start THEN a ELSE start END AS start, "end" FROM oo WHERE a IS NULL OR "end" >= a),
{MERGE.format(g='range_id, group_id')} SELECT range_id, group_id, min(start) AS key, CAST(sum("end" - start) AS BIGINT) AS value FROM u GROUP BY 1, 2""")
def onoff_interval_sum_of_hundred_ranges(spark, sf_dir):
    """On/off coverage of groups over a hundred overlapping ranges in one plan (F16)."""
    e = series(spark, sf_dir, "user_id")
    selection = e.select((F.col("user_id") % 3).alias("group_id"), "column_path").distinct()
    return run("OnOffIntervalSum", e.select("column_path", "key", (F.col("value") > 30).alias("value")), {"ranges": HUNDRED}, selection)
