"""Reductions of series: by period, by count, into about N parts, or whole."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.period import Period, bucket_index, bucket_start, friendly_size, round_down
from tidemark.model import Grouping, SeriesRange
from tidemark.operators.ranges import with_numbers, with_ranges
from tidemark.operators.running import positions, running
from tidemark.sources.folders import written

#: Reducers by name: a column to an aggregate that is null where there is no value.
REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "average": F.avg,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.nullif(F.count(c), F.lit(0)),
    "integral_mean": lambda c: F.floor(F.sum(c) / F.nullif(F.count(c), F.lit(0))).cast("long"),
}
#: Values that one step of a fold takes into a row.
FOLD_ROWS = 10_000


def reducer(name: str) -> Callable[[Column], Column]:
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name!r}")
    return REDUCERS[name]


def reduce(
    df: DataFrame, fn: str, grouping: Grouping | None = None, ranges: Sequence[SeriesRange] | None = None, by: Sequence[str] = ("column_path",), value: str = "value",
) -> DataFrame:
    """One row (by, range_id, key, value) for each part of each series and range.

    ``df`` has the columns of ``by``, key (epoch ms) and ``value``.  Sums and counts widen as Spark's do.
    """
    grouping = grouping or Grouping()
    cut = with_ranges(df.select(*by, "key", F.col(value).alias("value")), ranges, by, deal=True)
    keys = [*by, "range_id"]
    if grouping.period is not None:
        return _by_period(cut, fn, Period.parse(grouping.period), grouping, keys)
    if grouping.into_duration is not None:
        return _into_duration(cut, fn, grouping, keys)
    if grouping.count is not None or grouping.into_counted is not None:
        return _by_count(cut, fn, grouping, keys)
    first = F.coalesce(F.first("range_start"), F.min("key")).alias("key")
    return cut.groupBy(*keys).agg(first, reducer(fn)(F.col("value")).alias("value"))


def _by_count(cut: DataFrame, fn: str, grouping: Grouping, keys: list[str]) -> DataFrame:
    numbered = positions(cut, keys)
    if grouping.count is not None:
        part = F.floor(F.col("position") / grouping.count)
    else:
        totals = written(cut.groupBy(*keys).agg(F.count("*").alias("_total")), "totals")
        numbered = numbered.join(totals, keys)
        part = F.floor(F.col("position") / F.ceil(F.col("_total") / grouping.into_counted))
    parts = numbered.withColumn("_part", part).groupBy(*keys, "_part").agg(F.min("key").alias("key"), reducer(fn)(F.col("value")).alias("value"))
    return parts.drop("_part")


def _capped(index: Column, grouping: Grouping) -> Column:
    return F.lit(True) if grouping.max_parts is None else index < grouping.max_parts


def _by_period(cut: DataFrame, fn: str, period: Period, grouping: Grouping, keys: list[str]) -> DataFrame:
    if period.n == 0:
        return cut.select(*keys, "key", "value").where(F.lit(False))
    zone = grouping.zone
    if period.self_aligned and not grouping.empties:
        # Boundaries do not depend on the first key: one aggregation; a cap needs the first part only.
        start = round_down(F.col("key"), period, zone)
        parts = cut.groupBy(*keys, start.alias("_start")).agg(reducer(fn)(F.col("value")).alias("value"), F.first("range_start").alias("_range_start"))
        parts = parts.withColumnRenamed("_start", "key")
        if grouping.max_parts is not None:
            first = F.min(F.coalesce(round_down(F.col("_range_start"), period, zone), F.col("key"))).over(Window.partitionBy(*keys))
            parts = parts.withColumn("_from", first).where(_capped(bucket_index(F.col("key"), F.col("_from"), period, zone), grouping))
        return parts.select(*keys, "key", "value")
    return _anchored(cut, fn, _firsts(cut, keys).select(*keys, "_from"), [(F.lit(True), period)], grouping, keys)


def _firsts(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(_from, _span): range start, or else the first key, of each series and range, and the keys it spans."""
    start, until = F.coalesce(F.first("range_start"), F.min("key")), F.coalesce(F.first("range_until"), F.max("key") + 1)
    return cut.groupBy(*keys).agg(start.alias("_from"), (until - start).alias("_span"))


def _anchored(cut: DataFrame, fn: str, firsts: DataFrame, choices: list[tuple[Column, Period]], grouping: Grouping, keys: list[str]) -> DataFrame:
    """Periods counted from an anchor of each series and range, in one aggregation; a series takes the first choice that fits.

    ``firsts`` is written first, so that its size is known when the join is planned: while it is small Spark broadcasts
    it and the items are not shuffled for the join.
    """
    zone = grouping.zone
    chosen = lambda f: F.coalesce(*[F.when(fits, f(period)) for fits, period in choices])
    firsts = firsts.withColumn("_anchor", chosen(lambda p: round_down(F.col("_from"), p, zone)))
    firsts = written(firsts.drop("_from", "_span"), "firsts")
    own = [c for c in firsts.columns if c not in keys]
    index = lambda key: chosen(lambda p: bucket_index(key, F.col("_anchor"), p, zone))
    parts = cut.join(firsts, keys).withColumn("_k", index(F.col("key"))).where(_capped(F.col("_k"), grouping))
    parts = parts.groupBy(*keys, *own, "range_until", "_k").agg(reducer(fn)(F.col("value")).alias("value"))
    if grouping.empties:
        # Empty periods stay runs between the parts until they are sent: no table of all periods, nothing to join.
        parts = written(parts, "parts")
        end = F.greatest(F.max("_k"), F.max(index(F.col("range_until") - 1)))
        if grouping.max_parts is not None:
            end = F.least(end, F.lit(grouping.max_parts - 1))
        tail = parts.groupBy(*keys, *own).agg((F.max("_k") + 1).alias("_since"), end.alias("_k"), F.lit(None).cast(parts.schema["value"].dataType).alias("value"))
        runs = running(parts, keys, ("_k",), "lag", F.col("_k"), "_before").withColumn("_since", F.coalesce(F.col("_before") + 1, F.lit(0).cast("long")))
        every = runs.select(tail.columns).unionByName(tail)
        every = with_numbers(every, F.col("_since"), F.col("_k"), "_at").withColumn("value", F.when(F.col("_at") == F.col("_k"), F.col("value")))
        parts = every.drop("_k").withColumnRenamed("_at", "_k")
    return parts.select(*keys, chosen(lambda p: bucket_start(F.col("_k"), F.col("_anchor"), p, zone)).alias("key"), "value")


def _into_duration(cut: DataFrame, fn: str, grouping: Grouping, keys: list[str]) -> DataFrame:
    """Each series and range picks a friendly period for its span; all are reduced in one aggregation."""
    n, unit = friendly_size(F.floor(F.col("_span") / grouping.into_duration))
    firsts = written(_firsts(cut, keys).withColumn("_n", n).withColumn("_unit", unit), "periods")
    used = sorted((r[0], r[1]) for r in firsts.select("_n", "_unit").distinct().collect())  # friendly periods: a short list
    if not used:
        return cut.select(*keys, "key", "value").where(F.lit(False))
    choices = [((F.col("_n") == count) & (F.col("_unit") == name), Period(count, name)) for count, name in used]
    return _anchored(cut, fn, firsts, choices, grouping, keys)


def key_value_ranges(df: DataFrame, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """Least and greatest key and value of each series."""
    return df.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def keys_extent(df: DataFrame) -> DataFrame:
    """Least and greatest key over all series."""
    return df.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def fold_values(df: DataFrame, by: Sequence[str], function: Callable[[Column, Column], Column], zero: Column, rows: int = FOLD_ROWS) -> DataFrame:
    """An associative fold of the values of each group, in order of key, by a Column function of which ``zero`` is the neutral value.

    Runs of ``rows`` neighbours are folded at a time, then the results in the same way, until each group has one; so no row
    holds more.  Null values are left out; a group without others has null.
    """
    known = df.where(F.col("value").isNotNull()).select(*by, "key", "value")
    while True:
        numbered = positions(known, by)
        run = numbered.groupBy(*by, F.floor(F.col("position") / rows).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("_items"))
        known = written(run.select(*by, F.col("_run").alias("key"), F.aggregate("_items.value", zero, function).alias("value")), "fold")
        if (known.agg(F.max("key")).first()[0] or 0) == 0:
            break
    return df.select(*by).distinct().join(known.drop("key"), list(by), "left")
