"""Streams worked off batch by batch with the batch operators: state is a table, and no series is one task.

A batch's items are combined before anything is shuffled by series, large series are dealt into chunks, and what is carried from
batch to batch is a small row for each series, written for each batch.  A batch that runs again reads the state of the
batch before it and puts its own in the place of the one it had, so it emits the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.period import Period, bucket_index, bucket_start
from tidemark.operators.ranges import with_numbers
from tidemark.operators.running import positions, running
from tidemark.sources.commits import HadoopFiles
from tidemark.sources.delimited import read_delimited
from tidemark.sources.file_changes import FileChanges
from tidemark.sources.folders import drop_written, written
from tidemark.sources.store import SeriesStore
from tidemark.streaming.streams import _token, default_anchor, start

Emit = Callable[[DataFrame, int], None]
_TOTALS = "n long, total double, low double, high double"


def _shown(fn: str) -> Column:
    """The value of carried totals: items, sum, least and greatest."""
    told = {"sum": "total", "count": "n", "min": "low", "max": "high", "mean": "total / n", "average": "total / n"}
    if fn not in told:
        raise ValueError(f"a stream's state carries no {fn!r}")
    return F.expr(told[fn]).cast("double")


def _totals(value: str = "value") -> list[Column]:
    v = F.col(value).cast("double")
    return [F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high")]


def _joined() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]


class _State:
    """The rows carried from batch to batch, a folder for each batch below the stream's checkpoint."""

    def __init__(self, spark: SparkSession, checkpoint: str, schema: str):
        self.spark, self.schema, self.files = spark, schema, HadoopFiles(spark, f"{checkpoint}/carried")

    def before(self, n: int) -> DataFrame:
        kept = [int(x.split("=")[1]) for x in self.files.names("") if x.startswith("batch=")]
        kept = [k for k in kept if k < n and self.files.names(f"batch={k}")[-1:] and "_SUCCESS" in self.files.names(f"batch={k}")]
        return self.spark.read.schema(self.schema).parquet(f"{self.files.root}/batch={max(kept)}") if kept else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.files.root}/batch={n}")
        for name in self.files.names(""):
            if name.startswith("batch=") and int(name.split("=")[1]) < n - 1:  # the batch before may be needed again
                self.files.delete(name)


def count_parts(stream: DataFrame, n: int, fn: str, emit: Emit, checkpoint: str, trigger: dict | None = None):
    """Totals of each ``n`` items of a series in the order of batches and, in a batch, of keys; emitted (column_path, key, value)
    when complete, keyed by their first item."""
    shown = _shown(fn)
    state = _State(stream.sparkSession, checkpoint, f"column_path string, key long, {_TOTALS}")

    def each(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        items = batch.select("column_path", "key", "value")
        numbered = positions(items, ["column_path"]).join(held.select("column_path", F.col("n").alias("_held")), "column_path", "left")
        part = F.floor((F.coalesce("_held", F.lit(0)) + F.col("position")) / n)
        own = numbered.groupBy("column_path", part.alias("part")).agg(F.count("*").alias("items"), F.min("key").alias("key"), *_totals())
        begun = held.select("column_path", F.lit(0).cast("long").alias("part"), F.col("n").alias("items"), F.col("key").alias("begun"), "n", "total", "low", "high")
        both = own.withColumn("begun", F.lit(None).cast("long")).unionByName(begun.withColumn("key", F.lit(None).cast("long")))
        parts = both.groupBy("column_path", "part").agg(F.sum("items").alias("items"), F.coalesce(F.max("begun"), F.min("key")).alias("key"), *_joined())
        parts = written(parts, "parts")
        emit(parts.where(F.col("items") == n).select("column_path", "key", shown.alias("value")), number)
        state.put(parts.where(F.col("items") < n).select("column_path", "key", F.col("items").alias("n"), "total", "low", "high"), number)
        drop_written(parts)

    return start(stream, each, checkpoint, trigger)


def reduce_with_empties(stream: DataFrame, period: str, fn: str, emit: Emit, checkpoint: str, zone: str = "UTC", anchor: int | None = None, trigger: dict | None = None):
    """Totals by period of each series, with a missing value for every empty period between the last emitted and new data.

    A period that goes on is emitted again with its new total.  Items of periods before a series' open one are late and left out.
    """
    p, shown = Period.parse(period), _shown(fn)
    base = F.lit(anchor).cast("long") if anchor is not None else default_anchor(p, zone)
    state = _State(stream.sparkSession, checkpoint, f"column_path string, k long, {_TOTALS}")

    def each(batch: DataFrame, number: int) -> None:
        held = state.before(number)
        own = batch.select("column_path", bucket_index(F.col("key"), base, p, zone).cast("long").alias("k"), "value").where(F.col("k").isNotNull())
        own = own.groupBy("column_path", "k").agg(*_totals()).where("n > 0")
        on_time = own.join(held.select("column_path", F.col("k").alias("_open")), "column_path", "left").where(F.col("_open").isNull() | (F.col("k") >= F.col("_open")))
        both = on_time.drop("_open").withColumn("_new", F.lit(True)).unionByName(held.withColumn("_new", F.lit(False)))
        periods = written(both.groupBy("column_path", "k").agg(F.max("_new").alias("_new"), *_joined()), "periods")
        since = F.coalesce(F.col("_before") + 1, F.col("k"))
        sent = running(periods, ["column_path"], ("k",), "lag", F.col("k"), "_before").where("_new").withColumn("value", shown)
        # A period that was open and goes on has none before it in this table, or the one it follows.
        rows = with_numbers(sent, since, F.col("k"), "_at")
        key, value = bucket_start(F.col("_at"), base, p, zone), F.when(F.col("_at") == F.col("k"), F.col("value"))
        emit(rows.select("column_path", key.alias("key"), value.alias("value")), number)
        last = periods.groupBy("column_path").agg(F.max_by(F.struct("k", "n", "total", "low", "high"), "k").alias("_last"))
        state.put(last.select("column_path", "_last.*"), number)
        drop_written(periods)

    return start(stream, each, checkpoint, trigger)


def watch_delimited(spark: SparkSession, path: str, emit: Emit, checkpoint: str, trigger: dict | None = None):
    """Items of the delimited files that are below a folder, that come into it and that change there, each file by its own header.

    A changed file is read again as a whole.  Removed files are ignored.
    """
    spark.dataSource.register(FileChanges)
    folder, state = HadoopFiles(spark, path).uri, HadoopFiles(spark, f"{checkpoint}/files").uri
    changes = spark.readStream.format(FileChanges.name()).option("folder", folder).option("state", state).option("suffixes", ".csv,.tsv").load()

    def each(batch: DataFrame, n: int) -> None:
        files = sorted({r.path for r in batch.select("path").collect()})  # Spark lists a batch's files in the driver, too
        if files:
            emit(read_delimited(spark, path, files=files), n)

    return start(changes, each, checkpoint, trigger)


def load_watched(spark: SparkSession, path: str, store: SeriesStore, checkpoint: str, trigger: dict | None = None):
    """Keep a store up to date with the delimited files of a folder; items of one batch and key count by their file's name."""

    def write(items: DataFrame, n: int) -> None:
        kept = written(items, "items")
        writer, _ = _token(items, checkpoint, n)
        for kind in sorted(r.value_type for r in kept.select("value_type").distinct().collect()):
            own = kept.where(F.col("value_type") == kind)
            value = F.unbase64("value") if kind == "blob" else F.col("value")
            store.write(own.withColumn("value", value), kind, (f"{writer}-{kind}", n))
        drop_written(kept)

    return watch_delimited(spark, path, write, checkpoint, trigger)
