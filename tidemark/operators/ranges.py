"""Key ranges: selection, limits, extension, edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import SeriesRange
from tidemark.operators.running import positions


def in_range(df: DataFrame, start: int | None = None, until: int | None = None, edge_extra: bool = False, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """Items with start <= key < until. ``edge_extra`` adds each series' last item before and first item after."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("key") >= start)
    if until is not None:
        inside = inside & (F.col("key") < until)
    out = df.where(inside)
    if edge_extra:
        item = F.struct(*df.columns)
        for bound, nearest in ((start, F.max_by), (until, F.min_by)):
            if bound is not None:
                side = F.col("key") < bound if nearest is F.max_by else F.col("key") >= bound
                edge = df.where(side).groupBy(*by).agg(nearest(item, F.col("key")).alias("_item")).select("_item.*")
                out = out.unionByName(edge)
    return out


#: Keys are found their ranges through so many bins at most, and the table of bins and ranges has so many rows at most.
BINS, BIN_ROWS = 1024, 200_000
#: Rows, each item once for each of its ranges, that one task should make where they are grouped or ordered afterwards; and the most tasks.
TASK_ROWS, TASKS = 1_000_000, 20_000
#: Limits up to this are windows, whose rows Spark cuts before it shuffles them.
TOP = 1000


def ranges_table(df: DataFrame, ranges: Sequence[SeriesRange]) -> DataFrame:
    rows = [(i, r.start, r.until) for i, r in enumerate(ranges)]
    return df.sparkSession.createDataFrame(rows, "range_id int, range_start long, range_until long")


def with_range_ends(df: DataFrame, ranges: Sequence[SeriesRange]) -> DataFrame:
    """Add range_start and range_until of each row's range_id; the ranges are a request's own list."""
    return df.join(F.broadcast(ranges_table(df, ranges)), "range_id")


def with_numbers(df: DataFrame, low: Column, high: Column, name: str) -> DataFrame:
    """Each row once for each number from ``low`` to ``high``, both of type long; none where ``high`` is less.

    Numbers come in blocks of blocks of 65,536, so however many there are, no array of more is ever held.
    """
    bits = 16
    rows = df.withColumn("_low", low.cast("long")).withColumn("_left", high.cast("long") - F.col("_low")).where(F.col("_left") >= 0)
    for shift in (2 * bits, bits, 0):
        count = F.shiftright("_left", shift)
        step = F.explode(F.sequence(F.lit(0).cast("long"), count if shift == 2 * bits else F.least(count, F.lit((1 << bits) - 1).cast("long"))))
        rows = rows.withColumn("_step", step)
        rows = rows.withColumn("_low", F.col("_low") + F.shiftleft("_step", shift)).withColumn("_left", F.col("_left") - F.shiftleft("_step", shift))
    return rows.withColumn(name, F.col("_low")).drop("_low", "_left", "_step")


def _bins(ranges: Sequence[SeriesRange]) -> tuple[Column, list[tuple[int, int, int | None, int | None]]]:
    """The bin of a key, and the ranges of each bin; a first and a last bin lie outside all ends."""
    ends = sorted({x for r in ranges for x in (r.start, r.until) if x is not None})
    if not ends:
        return F.lit(0).cast("long"), [(0, i, None, None) for i in range(len(ranges))]
    low, high = ends[0], ends[-1]
    width = max(1, math.ceil((high - low) / max(1, min(BINS, BIN_ROWS // len(ranges)))))
    last = math.ceil((high - low) / width) + 1

    def of(key: int) -> int:
        return 0 if key < low else last if key >= high else (key - low) // width + 1

    held = []
    for i, r in enumerate(ranges):
        if r.start is None or r.until is None or r.start < r.until:
            held += [(b, i, r.start, r.until) for b in range(0 if r.start is None else of(r.start), (last if r.until is None else of(r.until - 1)) + 1)]
    inner = F.expr(f"(key - {low}L) div {width}L") + 1
    return F.when(F.col("key").isNull() | (F.col("key") < low), 0).when(F.col("key") >= high, last).otherwise(inner).cast("long"), held


def _dealt(binned: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items (with their ``_bin``) dealt out so that no task makes many more than ``TASK_ROWS`` rows of them.

    Series stay whole, so that what groups by them shuffles the items once and never what they become.  Where one is too large for
    that, items are dealt out evenly.  Small inputs and streams stay as they are.
    """
    if binned.isStreaming:
        return binned
    sizes = held.groupBy("_bin").agg(F.count("*").alias("_n"))
    made = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_items")).join(F.broadcast(sizes), "_bin").groupBy(*by).agg(F.sum(F.col("_items") * F.col("_n")).alias("_rows"))
    total, largest = made.agg(F.sum("_rows"), F.max("_rows")).first()
    if (total or 0) <= TASK_ROWS:
        return binned
    tasks = min(math.ceil(total / TASK_ROWS), TASKS)
    return binned.repartition(tasks, *by) if largest <= TASK_ROWS else binned.repartition(tasks)


def with_ranges(df: DataFrame, ranges: Sequence[SeriesRange] | None, by: Sequence[str] = ("column_path",), deal: bool = False) -> DataFrame:
    """Each item once for each range that holds it, with range_id, range_start and range_until; ``deal`` where they are then grouped.

    One range is a filter that the scan can use.  More are one plan whatever their number: the filter is what spans them all,
    and each item meets the ranges of its bin of keys in a broadcast table of at most ``BIN_ROWS`` rows (or one row for each range).
    """
    wanted = list(ranges or [SeriesRange()])
    if len(wanted) == 1:
        r = wanted[0]
        part = in_range(df, r.start, r.until) if r.limit is None else limit_range(df, r.start, r.until, r.limit, by)
        return part.select("*", F.lit(0).alias("range_id"), F.lit(r.start).cast("long").alias("range_start"), F.lit(r.until).cast("long").alias("range_until"))
    starts, untils = [r.start for r in wanted], [r.until for r in wanted]
    span = in_range(df, None if None in starts else min(starts), None if None in untils else max(untils))
    key_bin, held = _bins(wanted)
    table = df.sparkSession.createDataFrame(held, "_bin long, range_id int, range_start long, range_until long")
    binned = span.withColumn("_bin", key_bin)
    if deal or any(r.limit is not None for r in wanted):
        binned = _dealt(binned, table, by)
    met = binned.join(F.broadcast(table), "_bin").drop("_bin")
    inside = (F.col("range_start").isNull() | (F.col("key") >= F.col("range_start"))) & (F.col("range_until").isNull() | (F.col("key") < F.col("range_until")))
    met = met.where(inside).select(*df.columns, "range_id", "range_start", "range_until")
    limits = [(i, r.limit, r.start is None and r.until is not None) for i, r in enumerate(wanted) if r.limit is not None]
    if not limits:
        return met
    limited = df.sparkSession.createDataFrame(limits, "range_id int, _limit int, _last boolean")
    free = met.where(~F.col("range_id").isin([i for i, _, _ in limits])) if len(limits) < len(wanted) else met.where(F.lit(False))
    ordered = met.join(F.broadcast(limited), "range_id").withColumn("_order", F.when(F.col("_last"), -F.col("key")).otherwise(F.col("key")))
    first = _first(ordered, [*by, "range_id"], "_order", max(n for _, n, _ in limits)).where(F.col("_place") <= F.col("_limit"))
    return free.unionByName(first.select(free.columns))


def _first(df: DataFrame, by: Sequence[str], order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, with ``_place`` from 1; beyond ``TOP`` a large group is many tasks."""
    if limit <= TOP:
        return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_place") <= limit)
    return positions(df, by, "_place", (order,)).withColumn("_place", F.col("_place") + 1).where(F.col("_place") <= limit)


def raw(df: DataFrame, ranges: Sequence[SeriesRange] | None = None, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """Source items unchanged, by range in request order; overlapping ranges repeat items."""
    return with_ranges(df, ranges, by).drop("range_start", "range_until")


def limit_range(df: DataFrame, start: int | None = None, until: int | None = None, limit: int = 1, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """The first ``limit`` items from ``start``, or the last before ``until`` when only that is given."""
    last = start is None and until is not None
    ordered = in_range(df, start, until).withColumn("_order", -F.col("key") if last else F.col("key"))
    return _first(ordered, by, "_order", limit).select(df.columns)


def extend_range(ranges: Sequence[SeriesRange], before: int = 0, after: int = 0) -> list[tuple[SeriesRange, SeriesRange]]:
    """(asked, read): the range to read around each range that results are reported against."""
    shift = lambda x, by: None if x is None else x + by
    return [(r, SeriesRange(shift(r.start, -before), shift(r.until, after))) for r in ranges]


def map_values(df: DataFrame, function: Callable[[Column], Column], column: str = "value") -> DataFrame:
    return df.withColumn(column, function(F.col(column)))


def of_type(df: DataFrame, value_type: str, strict: bool = False) -> DataFrame:
    """Columns of one value type; strict raises when another type is there."""
    if strict and (other := df.where(F.col("value_type") != value_type).select("column_path", "value_type").first()):
        raise TypeError(f"{other.column_path} holds {other.value_type}, not {value_type}")
    return df.where(F.col("value_type") == value_type)


def watch(stream: DataFrame, predicate: Column) -> DataFrame:
    """Items of a live (or bounded) frame that satisfy a predicate."""
    return stream.where(predicate)
