"""Intervals: from on/off signals, merging, cutting by period, coverage sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.period import Period, bucket_index, bucket_start, round_down
from tidemark.model import SeriesRange
from tidemark.operators.ranges import extend_range, in_range, with_numbers, with_range_ends, with_ranges
from tidemark.operators.running import positions, running, split_large
from tidemark.operators.tabular import tabular, zero_fill
from tidemark.sources.folders import written

DAY = 86_400_000


def onoff_to_intervals(df: DataFrame, by: Sequence[str] = ("column_path",), chunk_rows: int | None = None) -> DataFrame:
    """(by, start, end) from a boolean series: on opens, off closes, more ons extend; one left open ends at its last on.

    At one key off comes before on.
    """
    known = df.where(F.col("value").isNotNull()).select(*by, "key", "value")
    off = F.when(F.col("value"), 0).otherwise(1).cast("long")
    marked = running(known, by, ("key", "value"), "sum", off, "_island", chunk_rows=chunk_rows)
    islands = marked.groupBy(*by, "_island").agg(F.min(F.when(F.col("value"), F.col("key"))).alias("start"), F.max("key").alias("end"))
    return islands.where(F.col("start").isNotNull()).select(*by, "start", "end")


def durations_to_intervals(df: DataFrame, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """(by, start, end) from items that hold a duration at their start."""
    return df.select(*by, F.col("key").alias("start"), (F.col("key") + F.col("value")).alias("end"))


def merge_intervals(df: DataFrame, by: Sequence[str] = ("column_path",), touching: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """The union of the intervals of each group; ``touching`` also joins those that only meet.

    An interval opens an island if it starts after all earlier ones end; the island ends where the intervals before
    the next opening reach.  Groups of many intervals are dealt into chunks, whose reaches and first openings are small tables.
    """
    by = list(by)
    spans = df.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*by, "start", "end")
    opens = F.col("_reach").isNull() | ((F.col("start") > F.col("_reach")) if touching else (F.col("start") >= F.col("_reach")))
    small, large = split_large(spans, by, ("start", "end"), chunk_rows)
    whole = Window.partitionBy(*by)
    reached = small.withColumn("_reach", F.max("end").over(whole.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_last", F.max("end").over(whole))
    merged = reached.where(opens).select(*by, "start", F.coalesce(F.lead("_reach").over(whole.orderBy("start", "_reach")), F.col("_last")).alias("end"))
    if large is None:
        return merged
    chunks = written(large.groupBy(*by, "_chunk").agg(F.max("end").alias("_end")), "chunk-ends")
    in_order = Window.partitionBy(*by).orderBy("_chunk")
    earlier = chunks.select(*by, "_chunk", F.max("_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max("end").over(inside), F.col("_before"))
    reached = _join_on(large, earlier, [*by, "_chunk"]).withColumn("_reach", reach)
    openings = written(reached.where(opens).select(*by, "_chunk", "start", "_reach"), "openings")
    firsts = openings.groupBy(*by, "_chunk").agg(F.min_by("_reach", F.struct("start", "_reach")).alias("_first"))
    following = firsts.select(*by, "_chunk", F.lead("_first").over(in_order).alias("_following"))
    last = chunks.groupBy(*by).agg(F.max("_end").alias("_last"))
    in_chunk = Window.partitionBy(*by, "_chunk").orderBy("start", "_reach")
    end = F.coalesce(F.lead("_reach").over(in_chunk), F.col("_following"), F.col("_last"))
    return merged.unionByName(_join_on(_join_on(openings, following, [*by, "_chunk"]), last, by).withColumn("end", end).select(*by, "start", "end"))


def _join_on(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Inner join on columns of the same name, nulls equal."""
    renamed = right.select(*[F.col(n).alias(f"_on_{n}") for n in names], *[c for c in right.columns if c not in names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_on_{n}"))
    return left.join(renamed, same).drop(*[f"_on_{n}" for n in names])


def cut_by_period(df: DataFrame, period: str, zone: str = "UTC", by: Sequence[str] = ("column_path",), until: int | str | None = None, max_parts: int | None = None, anchor: int | str | None = None) -> DataFrame:
    """Each interval cut by the periods it overlaps: (by, key = period start, overlap).

    Periods count from the group's first start (or ``anchor``, a key or a column of keys) up to ``until``, as well.  The
    periods of an interval are numbered rows made as they are needed, so no join on ranges is.  Only touching a period is no overlap.
    """
    p = Period.parse(period)
    if p.n == 0:
        return df.select(*by, F.col("start").alias("key"), (F.col("end") - F.col("start")).alias("overlap")).where(F.lit(False))
    if anchor is None:
        df = _join_on(df, df.groupBy(*by).agg(F.min("start").alias("_first")), list(by))
    column = lambda x: F.col(x) if isinstance(x, str) else F.lit(x).cast("long")
    df = df.withColumn("_anchor", round_down(column("_first" if anchor is None else anchor), p, zone))
    low = bucket_index(F.col("start"), F.col("_anchor"), p, zone)
    high = bucket_index(F.greatest(F.col("end") - 1, F.col("start")), F.col("_anchor"), p, zone)
    if max_parts is not None:
        df, high = df.where(low < max_parts), F.least(high, F.lit(max_parts - 1))
    parts = with_numbers(df, F.greatest(low, F.lit(0)), high, "_k")
    begin, end = bucket_start(F.col("_k"), F.col("_anchor"), p, zone), bucket_start(F.col("_k") + 1, F.col("_anchor"), p, zone)
    if until is not None:
        end = F.least(end, column(until))
    cut = parts.select(*by, begin.alias("key"), (F.least("end", end) - F.greatest("start", begin)).alias("overlap"))
    return cut.where(F.col("overlap") > 0)


def coverage(df: DataFrame, period: str | None, zone: str = "UTC", by: Sequence[str] = ("column_path",), until: int | str | None = None, max_parts: int | None = None) -> DataFrame:
    """(by, key, value): milliseconds that merged intervals cover, by period or in all (key: the first start)."""
    if period is None:
        return df.groupBy(*by).agg(F.min("start").alias("key"), F.sum(F.col("end") - F.col("start")).alias("value"))
    return cut_by_period(df, period, zone, by, until, max_parts).groupBy(*by, "key").agg(F.sum("overlap").alias("value"))


def interval_sum(
    df: DataFrame, period: str | None = None, zone: str = "UTC", by: Sequence[str] = ("column_path",), start: int | None = None, until: int | None = None, max_parts: int | None = None,
    ranges: Sequence[SeriesRange] | None = None,
) -> DataFrame:
    """Coverage by series whose items are durations; time covered twice counts once.

    ``ranges``, in place of start and until, are all worked out in one plan, with their range_id.
    """
    if ranges is None:
        spans = durations_to_intervals(in_range(df, start, until, by=by), by)
        return coverage(merge_intervals(spans, by), period, zone, by, until, max_parts)
    own = [*by, "range_id"]
    if not ranges:
        return interval_sum(df, period, zone, by, max_parts=max_parts).withColumn("range_id", F.lit(0)).where(F.lit(False))
    merged = merge_intervals(durations_to_intervals(with_ranges(df, ranges, by, deal=True), own), own)
    return coverage(with_range_ends(merged, ranges), period, zone, own, "range_until", max_parts)


def interval_sum_across(
    df: DataFrame, columns: Sequence[str], period: str | None = None, zone: str = "UTC", names: Sequence[str] | None = None, start: int | None = None, until: int | None = None,
    ranges: Sequence[SeriesRange] | None = None,
) -> DataFrame:
    """(key, a coverage for each of ``columns``, in their order): the sums of several series side by side, 0 where one has none."""
    chosen = df.where(F.col("column_path").isin(list(columns)))
    own = interval_sum(chosen, period, zone, start=start, until=until, ranges=ranges)
    return zero_fill(tabular(own, columns, names=names, within=() if ranges is None else ("range_id",)), names or columns)


#: Groups of a request that are listed in the plan; more are met through numbered periods.
FEW_GROUPS = 1000


def _each_group(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``keys`` (a period and what goes with it) with each group_id: each group has each period that any has, without a cross join."""
    kind = groups.schema["group_id"].dataType
    few = [r.group_id for r in groups.limit(FEW_GROUPS + 1).collect()]
    if len(few) <= FEW_GROUPS:
        ids = F.array(*map(F.lit, few)) if few else F.array()
        return keys.select(F.explode(F.transform(ids, lambda x: x.cast(kind))).alias("group_id"), *keys.columns)
    names = keys.columns
    keys = written(positions(keys, [], "place", order=names), "keys")
    last = keys.agg(F.max("place")).first()[0]
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))
    return groups.withColumn("place", places).join(keys, "place").select("group_id", *names)


def onoff_interval_sum(
    df: DataFrame, selection: DataFrame, period: str | None = None, zone: str = "UTC", ranges: SeriesRange | Sequence[SeriesRange] | None = None, early_ms: int = DAY, max_parts: int | None = None,
) -> DataFrame:
    """Coverage (group_id, key, value) by groups of on/off series, clipped to the range; zero where a group has none.

    ``selection`` (group_id, column_path) is a request's list of columns.  Signals are read ``early_ms`` before
    the range, so that an interval that is open at its start counts.  A list of ranges is one plan, whose rows have range_id.
    """
    one = ranges is None or isinstance(ranges, SeriesRange)
    asked = [ranges or SeriesRange()] if one else list(ranges)
    if not asked:
        return onoff_interval_sum(df, selection, period, zone, None, early_ms, max_parts).withColumn("range_id", F.lit(0)).where(F.lit(False))
    read = [SeriesRange(r.start, r.until) for _, r in extend_range(asked, before=early_ms)]
    chosen = with_ranges(df, read, deal=True).join(selection.select("group_id", "column_path"), "column_path")
    # Intervals are far fewer than items, merged ones fewer still: written, they are not worked out again for each use.
    own = ("group_id", "range_id")
    spans = written(onoff_to_intervals(chosen, ("group_id", "range_id", "column_path")).drop("column_path"), "intervals")
    merged = with_range_ends(merge_intervals(spans, own), asked)
    merged = merged.withColumn("start", F.greatest("start", "range_start")).withColumn("end", F.least("end", "range_until")).where(F.col("end") >= F.col("start"))
    if period is None:
        sums = coverage(merged, None, zone, own)
        return sums.drop("range_id") if one else sums
    merged = written(merged, "merged")
    # One anchor for each range, so that the groups' periods line up.
    first = merged.groupBy("range_id").agg(F.min("start").alias("first"))
    anchored = _join_on(merged, first, ["range_id"])
    cut = cut_by_period(anchored, period, zone, own, "range_until", max_parts, anchor="first")
    sums = written(cut.groupBy(*own, "key").agg(F.sum("overlap").alias("value")), "sums")
    every = _each_group(sums.select("range_id", "key").distinct(), selection.select("group_id").distinct())
    sums = every.join(sums, [*own, "key"], "left").select("range_id", "group_id", "key", F.coalesce("value", F.lit(0)).alias("value"))
    return sums.drop("range_id") if one else sums
