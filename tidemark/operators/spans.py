"""Timing spans: (name, trace_id, time in µs, duration in ns), and series of categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.period import Period, bucket_index, bucket_start, round_down
from tidemark.operators.ranges import with_numbers
from tidemark.operators.running import positions, running


def spans(df: DataFrame, names: DataFrame, trace_ids: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """Spans from three series of one dataset (durations, names, trace ids), joined by key.

    Where several items may share a key, ``apart`` are the columns of all three that tell these apart; without them each meets each.
    """
    on = ["key", *apart]
    part = lambda items, name: items.select(*on, F.col("value").alias(name))
    joined = part(df, "duration").join(part(names, "name"), on).join(part(trace_ids, "trace_id"), on)
    return joined.select(F.col("key").alias("time"), "duration", "name", "trace_id")


def spans_named(df: DataFrame, name: str, regex: bool = False) -> DataFrame:
    return df.where(F.col("name").rlike(f"^(?:{name})$") if regex else F.col("name") == name)


def span_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct()


def period_starts(df: DataFrame, start: str, until: str, period: Period, zone: str = "UTC", name: str = "start") -> DataFrame:
    """Each row once for each period from the one at or before its ``start`` up to ``until``, with the period's start, made as needed."""
    anchored = df.withColumn("_anchor", round_down(F.col(start), period, zone))
    last = bucket_index(F.col(until) - 1, F.col("_anchor"), period, zone)
    numbers = with_numbers(anchored, F.lit(0).cast("long"), last, "_k")
    return numbers.withColumn(name, bucket_start(F.col("_k"), F.col("_anchor"), period, zone)).drop("_anchor", "_k")


def span_gaps(df: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(name, trace_id, time, gap): µs from the end of the span before; a trace of one span has one gap of 0.

    Large traces are dealt into chunks; the end of a chunk's last span is handed to the next one.
    """
    own = ["name", "trace_id"]
    end = F.col("time") + F.floor(F.col("duration") / 1000)
    marked = running(df, own, ("time", "duration"), "lag", end, "_before", chunk_rows=chunk_rows)
    gaps = marked.where(F.col("_before").isNotNull()).select(*own, "time", (F.col("time") - F.col("_before")).alias("gap"))
    alone = df.groupBy(*own).agg(F.count("*").alias("_n"), F.min("time").alias("time")).where(F.col("_n") == 1)
    return gaps.unionByName(alone.select(*own, "time", F.lit(0).cast("long").alias("gap")))


def span_summary(df: DataFrame) -> DataFrame:
    """By name and trace: spans, total µs, start to end µs, sum of gaps, first time."""
    end = F.col("time") + F.floor(F.col("duration") / 1000)
    totals = df.groupBy("name", "trace_id").agg(
        F.count("*").alias("spans"), F.floor(F.sum("duration") / 1000).alias("total_us"), (F.max(end) - F.min("time")).alias("extent_us"), F.min("time").alias("first_time")
    )
    gaps = span_gaps(df).groupBy("name", "trace_id").agg(F.sum("gap").alias("gap_us"))
    return totals.join(gaps, ["name", "trace_id"])


def last_trace(df: DataFrame) -> DataFrame:
    """The trace of each name that starts last."""
    return df.groupBy("name").agg(F.max_by("trace_id", F.struct("time", "trace_id")).alias("trace_id"))


def times_by_category(df: DataFrame, categories: Sequence[str], codes: Mapping[str, str] | None = None) -> DataFrame:
    """(category, key) of the items whose value, decoded if codes are given, is a declared category."""
    value = F.col("value")
    if codes:
        value = F.coalesce(*[F.when(F.col("value") == k, F.lit(v)) for k, v in codes.items()], F.col("value"))
    return df.select(value.alias("category"), "key").where(F.col("category").isin(list(categories)))


def times_lists(df: DataFrame, categories: Sequence[str], codes: Mapping[str, str] | None = None, most: int = 10_000) -> DataFrame:
    """(category, part, times): the sorted keys of each category as arrays of at most ``most``, numbered in order."""
    numbered = positions(times_by_category(df, categories, codes), ["category"])
    part = F.floor(F.col("position") / most).alias("part")
    return numbered.groupBy("category", part).agg(F.sort_array(F.collect_list("key")).alias("times"))
