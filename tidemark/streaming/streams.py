"""Series that go on: reductions kept current, part counts, loads."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.period import Period, bucket_index, bucket_start, round_down
from tidemark.operators.reduce import reduce, reducer
from tidemark.sources.commits import HadoopFiles
from tidemark.sources.folders import drop_written, written
from tidemark.sources.sinks import to_json_pairs
from tidemark.sources.store import SeriesStore, latest_wins

#: Monday 1970-01-05, from which weeks of a stream count.
MONDAY = 345_600_000


def follow(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """What a folder's files hold (first batches) and what is added to them later; ``SeriesStore.follow`` does it for a store."""
    if "log" in HadoopFiles(spark, path).names(""):
        raise ValueError(f"{path} is a table of a store: use SeriesStore.follow")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def default_anchor(period: Period, zone: str):
    return round_down(F.lit(MONDAY if period.unit == "week" else 0).cast("long"), period, zone)


def bucketed(df: DataFrame, period: str, zone: str = "UTC", anchor: int | None = None) -> DataFrame:
    """Add ``bucket``, the start of each item's period. The first key of a stream is unknown, so the anchor is given."""
    p = Period.parse(period)
    base = F.lit(anchor).cast("long") if anchor is not None else default_anchor(p, zone)
    return df.withColumn("bucket", bucket_start(bucket_index(F.col("key"), base, p, zone), base, p, zone))


def stream_reduce(
    stream: DataFrame, fn: str, period: str, zone: str = "UTC", anchor: int | None = None, until: int | None = None, late: str | None = None, by: Sequence[str] = ("column_path",),
) -> DataFrame:
    """Totals by period; in update mode an open period is sent again with its new total at the same key.

    ``late`` (such as "10 minutes") drops items older than that and lets the state of past periods go.
    """
    rows = stream if until is None else stream.where(F.col("key") < until)
    cut = bucketed(rows, period, zone, anchor)
    if late is None:
        return cut.groupBy(*by, F.col("bucket").alias("key")).agg(reducer(fn)(F.col("value")).alias("value"))
    timed = cut.withColumn("ts", F.timestamp_millis("bucket")).withWatermark("ts", late)
    return timed.groupBy(*by, "ts").agg(reducer(fn)(F.col("value")).alias("value")).select(*by, F.unix_millis("ts").alias("key"), "value")


#: Reducers that a state can carry: from (items, sum, least, greatest).
CARRIED = {"sum": lambda n, t, a, b: t, "count": lambda n, t, a, b: n, "min": lambda n, t, a, b: a, "max": lambda n, t, a, b: b, "mean": lambda n, t, a, b: t / n, "average": lambda n, t, a, b: t / n}


def _carried(fn: str):
    if fn not in CARRIED:
        raise ValueError(f"a stream's state carries no {fn!r}")
    return CARRIED[fn]


#: Groups of the state: each holds the series of one remainder of a hash, so a group's fixed costs do not grow with the series.
#: A stream's checkpoint goes with this number.
BUCKETS = 1024
_TOTALS = ["n", "total", "low", "high"]
_KINDS = {"column_path": "object", "total": "float64", "low": "float64", "high": "float64"}


def _state_schema(columns: Sequence[str]) -> str:
    kinds = {"object": "string", "float64": "double"}
    return ", ".join(f"{c} array<{kinds.get(_KINDS.get(c), 'long')}>" for c in columns)


def _held(state: GroupState, columns: Sequence[str]) -> pd.DataFrame:
    """The rows that a group of the state holds, one for each series of it."""
    kept = state.get if state.exists else [[] for _ in columns]
    return pd.DataFrame({c: pd.Series(v, dtype=_KINDS.get(c, "int64")) for c, v in zip(columns, kept, strict=True)})


def _keep(state: GroupState, rows: pd.DataFrame, columns: Sequence[str]) -> None:
    names = [x if isinstance(x, str) else None for x in rows["column_path"]]
    state.update((names, *(rows[c].astype(_KINDS.get(c, "int64")).tolist() for c in columns[1:])))


def _totalled(rows: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
    """Totals of values, or of rows that hold totals already, by groups."""
    groups = rows.groupby(list(by), dropna=False)
    if "value" in rows:
        v = groups["value"]
        return pd.DataFrame({"n": v.count(), "total": v.sum(min_count=1), "low": v.min(), "high": v.max()})
    return pd.DataFrame({"n": groups["n"].sum(), "total": groups["total"].sum(min_count=1), "low": groups["low"].min(), "high": groups["high"].max()})


def _in_buckets(stream: DataFrame, *columns: Column) -> DataFrame:
    value, bucket = F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("column_path"), F.lit(BUCKETS)).alias("_bucket")
    return stream.select(bucket, "column_path", *columns, value)


def stream_reduce_with_empties(stream: DataFrame, period: str, zone: str = "UTC", anchor: int | None = None, fn: str = "sum") -> DataFrame:
    """Totals by period of each series, with a missing value for every empty period between the last sent and new data.

    The state of a series is its open period and that one's total; a period is sent with the first of the empty ones before it,
    which Spark's ``explode`` then lists, so that a key far ahead costs the state nothing.  A group of the state is a bucket of
    series, worked off at once; ``batches.reduce_with_empties`` deals large series out.
    """
    p, shown = Period.parse(period), _carried(fn)
    base = F.lit(anchor).cast("long") if anchor is not None else default_anchor(p, zone)
    rows = _in_buckets(stream, bucket_index(F.col("key"), base, p, zone).alias("k")).where(F.col("k").isNotNull())
    by, columns = ["column_path", "k"], ["column_path", "k", *_TOTALS]

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state, columns)
        own = pd.concat([_totalled(f, by).reset_index() for f in frames])
        own = own[own["n"] > 0]
        if own.empty:
            return
        none = np.iinfo(np.int64).min
        both = pd.concat([x for x in (held.assign(new=False, open=held["k"]), own.assign(new=True, open=none)) if len(x)], ignore_index=True)
        both["open"] = both.groupby("column_path", dropna=False)["open"].transform("max")
        both = both[both["k"] >= both["open"]]  # an earlier period is past: late data
        periods = _totalled(both, by).assign(new=both.groupby(by, dropna=False)["new"].max()).reset_index()
        series, k = periods.groupby("column_path", dropna=False).ngroup().to_numpy(), periods["k"].to_numpy()
        goes_on = series[1:] == series[:-1]
        since = k.copy()
        since[1:][goes_on] = k[:-1][goes_on] + 1
        _keep(state, periods[np.append(~goes_on, True)], columns)
        value = shown(*(periods[c] for c in _TOTALS)).astype("float64")
        sent = pd.DataFrame({"column_path": periods["column_path"], "since": since, "k": k, "value": value})[periods["new"].to_numpy(dtype=bool)]
        if len(sent):
            yield sent

    out = rows.groupBy("_bucket").applyInPandasWithState(step, "column_path string, since long, k long, value double", _state_schema(columns), "update", GroupStateTimeout.NoTimeout)
    every = out.select("column_path", F.explode(F.sequence("since", "k")).alias("at"), "k", "value")
    return every.select("column_path", bucket_start(F.col("at"), base, p, zone).alias("key"), F.when(F.col("at") == F.col("k"), F.col("value")).alias("value"))


def newest_with_empties(sent: DataFrame) -> DataFrame:
    """What a reduction with empty periods has sent (column_path, key, value, ingest_seq), here or in ``batches``: what came last of each period.

    A missing value lies between two periods that have some, and what comes for it later is late: it is sent once.  So only values,
    no more than items of the series, are compared; missing ones, however many, are neither sorted nor shuffled.  What a batch
    has sent must be there once, as where a batch that runs again overwrites it.
    """
    values = latest_wins(sent.where(F.col("value").isNotNull()))
    return values.unionByName(sent.where(F.col("value").isNull()))


def stream_count_reduce(stream: DataFrame, n: int, fn: str = "sum") -> DataFrame:
    """Totals of each ``n`` items of a series, sent when complete and keyed by their first item.

    A group of the state is a bucket of series, worked off at once; ``batches.count_parts`` deals large series out.
    """
    shown, columns = _carried(fn), ["column_path", "key", "items", *_TOTALS]

    def step(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _held(state, columns)
        rows = pd.concat(list(frames), ignore_index=True)
        paths = pd.concat([held["column_path"], rows["column_path"]], ignore_index=True)
        series, names = pd.factorize(paths, use_na_sentinel=False)
        before = np.zeros(len(names), dtype=np.int64)
        before[series[: len(held)]] = held["items"]
        rows = rows.assign(series=series[len(held) :]).sort_values(["series", "key"], kind="stable", ignore_index=True)
        rows["part"] = (before[rows["series"]] + rows.groupby("series").cumcount()) // n
        by = ["series", "part"]
        groups = rows.groupby(by)
        own = _totalled(rows, by).assign(key=groups["key"].first(), items=groups.size()).reset_index()
        begun = held.drop(columns="column_path").assign(series=series[: len(held)], part=0)
        both = pd.concat([x for x in (begun, own) if len(x)], ignore_index=True)  # what is begun comes first and gives the key
        groups = both.groupby(by)
        parts = _totalled(both, by).assign(key=groups["key"].first(), items=groups["items"].sum()).reset_index()
        parts["column_path"] = np.asarray(names, dtype=object)[parts["series"]]
        _keep(state, parts[parts["items"] < n], columns)
        whole = parts[parts["items"] == n]
        if len(whole):
            yield pd.DataFrame({"column_path": whole["column_path"], "key": whole["key"], "value": shown(*(whole[c] for c in _TOTALS)).astype("float64")})

    return _in_buckets(stream, F.col("key")).groupBy("_bucket").applyInPandasWithState(step, "column_path string, key long, value double", _state_schema(columns), "append", GroupStateTimeout.NoTimeout)


def stream_batch_reduce(stream: DataFrame, fn: str, emit: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Each batch's own total by series, keyed by the batch's first key; not cumulative."""
    return start(stream, lambda batch, n: emit(reduce(batch, fn), n), checkpoint, trigger)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, mode: str = "append"):
    """Run ``each`` on every batch; by default all that is there now, else by ``trigger`` (such as processingTime)."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def _token(batch: DataFrame, checkpoint: str, n: int) -> tuple[str, int]:
    """A name of a stream's batch: the stream's id, which its checkpoint keeps, and the batch number."""
    held = batch.sparkSession.read.text(checkpoint + "/metadata").first().value
    return json.loads(held)["id"], n


def write_stream(stream: DataFrame, store: SeriesStore, value_type: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream to the store, in one order with all other writes; a batch that runs again changes nothing."""
    return start(stream, lambda batch, n: store.write(batch, value_type, _token(batch, checkpoint, n)), checkpoint, trigger)


def load_stream(
    messages: DataFrame, decoder: Callable[[DataFrame], DataFrame], store: SeriesStore, value_type: str, checkpoint: str, errors: str, transforms: Sequence[Callable[[DataFrame], DataFrame]] = (), trigger: dict | None = None,
):
    """Decode messages, transform, write items to the store and failures (error, count, by batch) to the ``errors`` table.

    A batch is decoded once, into the shared folder; one that runs again overwrites its own failures.
    """

    def each(batch: DataFrame, n: int) -> None:
        decoded, token = written(decoder(batch), "decoded"), _token(batch, checkpoint, n)
        items = decoded.where(F.col("error").isNull()).drop("error")
        for t in transforms:
            items = t(items)
        store.write(items, value_type, token)
        failed = decoded.where(F.col("error").isNotNull()).groupBy("error").count()
        failed.write.mode("overwrite").parquet(f"{errors}/batch={token[0]}-{n}")
        drop_written(decoded)

    return start(messages, each, checkpoint, trigger)


def json_blocks(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream as JSON pairs in numbered blocks: block 0 is what was there at the start, later ones are updates."""
    return start(stream, lambda batch, n: to_json_pairs(batch).write.mode("overwrite").parquet(f"{out}/block={n}"), checkpoint, trigger)
