"""Series tables: one Parquet table for each value type, appended to and read latest-first."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.running import numbered
from tidemark.sources.commits import CommitLog, HadoopFiles, State, Token
from tidemark.sources.series_source import SeriesSource

#: Logical value types that share a table.
TABLES = {"short": "int", "int": "int", "char": "string", "json": "string", "string": "string", "flags": "bigint", "long": "bigint", "bigint": "bigint", "double": "double", "boolean": "boolean", "blob": "binary"}


def latest_wins(df: DataFrame, order: str | Sequence[str] = "ingest_seq") -> DataFrame:
    """For each column and key the item written last, of those alike in ``order`` the one of greatest values: one
    aggregation, combined before the shuffle."""
    order = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in ("column_path", "key")]
    newest = df.groupBy("column_path", "key").agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_item"))
    return newest.select("column_path", "key", *[F.col("_item")[c].alias(c) for c in rest])


def merge_updates(base: DataFrame, updates: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """``updates`` replace items of the same column and key, after ``deletes`` (column_path, key) took theirs away."""
    kept = base if deletes is None else base.join(deletes.select("column_path", "key"), ["column_path", "key"], "left_anti")
    both = kept.withColumn("_seq", F.lit(0)).unionByName(updates.withColumn("_seq", F.lit(1)))
    return latest_wins(both, "_seq").drop("_seq")


_ITEM = "column_path string, key long, value {}, value_type string, ingest_seq long, place long"
_PATH = "column_path string, value_type string, first_key long, last_key long, items long"
_ORDER = ("ingest_seq", "place")
#: Folders that no commit names are left alone for so long by ``vacuum``: their writers may be at work.
DAY = 24 * 3600 * 1000


@dataclass
class SeriesStore:
    """Tables below ``path``, one for each Spark type: series_<type>, of items, of the paths they are under, and a commit log.

    A write puts its items into a folder of their own and adds it to the log (``commits``), whose numbers are the order of all
    writes, whoever makes them; in one write items are ordered by ``place``.  A write whose token the log has seen is left out,
    compacted or not: so a stream's batch that runs again changes nothing.  Erasing a column is a commit that hides
    what came before it.  Each write also keeps its paths with their keys' extent, so the catalog reads no items.
    """

    spark: SparkSession
    path: str

    def _table(self, value_type: str) -> str:
        return f"{self.path}/series_{TABLES[value_type]}"

    def log(self, value_type: str) -> CommitLog:
        return CommitLog(HadoopFiles(self.spark, self._table(value_type)))

    def _put(self, items: DataFrame, table: str) -> str:
        """Write items, by ranges of path and key so that files' statistics and filters find them, and their paths; the folder's name."""
        folder = uuid.uuid4().hex
        sized = items.repartitionByRange("column_path", "key").sortWithinPartitions("column_path", "key")
        sized.write.option("parquet.bloom.filter.enabled#column_path", "true").parquet(f"{table}/data/{folder}/items")
        kept = self.spark.read.schema(items.schema).parquet(f"{table}/data/{folder}/items")
        paths = kept.groupBy("column_path", "value_type").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("items"))
        paths.write.parquet(f"{table}/data/{folder}/paths")
        return folder

    def write(self, df: DataFrame, value_type: str, token: Token | int | None = None, place: str | None = None) -> int | None:
        """Write (column_path, key, value); an item of the same column and key counts as replaced.

        ``token`` names the write, (writer, n) that of a recurring writer: a second one of the same name, or one of a smaller n, is no
        write.  Of items of one column and key the one of greatest ``place`` (a column) counts, without it that of greatest
        value.  Returns the number of the commit, None if there was none.
        """
        kind, table, log = TABLES[value_type], self._table(value_type), self.log(value_type)
        token = str(token) if isinstance(token, int) else token
        if log.state().seen(token):
            return None
        rows = df.select("column_path", F.col("key").cast("long").alias("key"), F.col("value").cast(kind).alias("value"), F.lit(value_type).alias("value_type"),
                         F.lit(None).cast("long").alias("ingest_seq"), (F.col(place) if place else F.lit(0)).cast("long").alias("place"))
        folder = self._put(rows, table)
        named = [token, 0] if isinstance(token, str) else list(token) if token else None
        done = log.commit(lambda state: None if state.seen(token) else {"kind": "write", "folder": folder, "token": named})
        if done is None:
            log.files.delete(f"data/{folder}")
        return done and done.number

    def _numbered(self, kind: str, what: str, schema: str, state: State) -> DataFrame:
        """Rows of the folders of ``state`` that are not erased, with the number of their commit as ``ingest_seq``."""
        table = f"{self.path}/series_{kind}"
        found = self.spark.read.schema(schema).parquet(*[f"{table}/data/{f}/{what}" for f in state.writes])
        # One row for each folder since the last compaction.
        numbers = self.spark.createDataFrame(list(state.writes.items()), "_folder string, _number long")
        found = found.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -3)).join(F.broadcast(numbers), "_folder")
        own = F.coalesce("ingest_seq", "_number") if "ingest_seq" in found.columns else F.col("_number")
        found = found.withColumn("ingest_seq", own).drop("_folder", "_number")
        if state.erased:
            marks = self.spark.createDataFrame(list(state.erased.items()), "_path string, _until long")
            found = found.join(marks, F.col("column_path") == F.col("_path"), "left").where(F.col("_until").isNull() | (F.col("ingest_seq") > F.col("_until"))).drop("_path", "_until")
        return found

    def _items(self, kind: str, state: State | None = None) -> DataFrame | None:
        """All items of a table that are not erased, replaced ones too; None without a write."""
        state = state or self.log(next(t for t, k in TABLES.items() if k == kind)).state()
        return self._numbered(kind, "items", _ITEM.format(kind), state) if state.writes else None

    def scan(self, value_type: str) -> DataFrame:
        """All items of one logical type."""
        found = self._items(TABLES[value_type])
        if found is None:
            raise LookupError(f"no {value_type} is stored in {self.path}")
        return latest_wins(found.where(F.col("value_type") == value_type), _ORDER).select("column_path", "key", "value", "value_type")

    def scan_all(self) -> DataFrame:
        """All items of all types that were written, values as text."""
        out = None
        for kind in sorted(set(TABLES.values())):
            found = self._items(kind)
            if found is None:
                continue
            part = latest_wins(found, _ORDER).select("column_path", "key", (F.base64("value") if kind == "binary" else F.col("value").cast("string")).alias("value"), "value_type")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise LookupError(f"nothing is stored in {self.path}")
        return out

    def catalog(self) -> DataFrame:
        """(column_path, value_type, first_key, last_key, items) of every column that has items, from the kept paths alone.

        ``items`` counts an item as often as it was written since the last compaction.
        """
        out = self.spark.createDataFrame([], _PATH)
        for kind in sorted(set(TABLES.values())):
            state = self.log(next(t for t, k in TABLES.items() if k == kind)).state()
            if state.writes:
                out = out.unionByName(self._numbered(kind, "paths", _PATH, state).drop("ingest_seq"))
        return out.groupBy("column_path", "value_type").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("items").alias("items"))

    def column(self, path: str) -> DataFrame:
        """The items of one column, whose type the catalog tells; an unknown path is an error."""
        types = [r.value_type for r in self.catalog().where(F.col("column_path") == path).select("value_type").limit(2).collect()]
        if not types:
            raise LookupError(f"no such column: {path}")
        if len(types) > 1:
            raise LookupError(f"{path} has items of several types")
        return self.scan(types[0]).where(F.col("column_path") == path)

    def compact(self, value_type: str) -> None:
        """Put the latest items into one folder that replaces those there are; ``vacuum`` removes these.

        Items keep their numbers and the log keeps the tokens, so replays and streams go on as before.  What others write
        meanwhile stays; of two compactions at once the later one gives up.
        """
        kind, log = TABLES[value_type], self.log(value_type)
        old = log.state()
        found = self._items(kind, old)
        if found is None:
            return
        folder = self._put(latest_wins(found, _ORDER).select("column_path", "key", "value", "value_type", "ingest_seq", "place"), self._table(value_type))
        entry = {"kind": "compact", "folder": folder, "upto": old.number, "replaces": list(old.writes)}
        if log.commit(lambda state: entry if old.writes.keys() <= state.writes.keys() else None) is None:
            log.files.delete(f"data/{folder}")

    def vacuum(self, value_type: str, older_ms: int = DAY) -> None:
        """Remove the folders that the state does not name and that are older than this: replaced ones and those of broken writes."""
        log = self.log(value_type)
        names, now = log.files.names("data"), time.time() * 1000
        live = log.state().writes
        for name in names:
            if name not in live and log.files.modified(f"data/{name}") <= now - older_ms:
                log.files.delete(f"data/{name}")

    def erase_column(self, path: str, value_type: str) -> None:
        """Hide what was written to a column so far; ``compact`` leaves it out."""
        self.log(value_type).commit(lambda state: {"kind": "erase", "path": path})

    def follow(self, value_type: str, since: int = 0, erasures: bool = False) -> DataFrame:
        """A stream of (column_path, key, value, value_type, ingest_seq): what the store holds first, then what is written to it.

        ``since`` is the number of the commit after which to begin.  Replaced and erased items that were not read yet are not
        sent; with ``erasures`` an erased column is a row without key and value.
        """
        self.spark.dataSource.register(SeriesSource)
        reader = self.spark.readStream.format(SeriesSource.name()).option("table", HadoopFiles(self.spark, self._table(value_type)).uri)
        return reader.option("type", value_type).option("kind", TABLES[value_type]).option("since", since).option("erasures", str(erasures).lower()).load()

    def reset(self) -> None:
        """Drop all tables."""
        HadoopFiles(self.spark, self.path).delete("")


def series_from_values(df: DataFrame, path: str, order_by: str, value: str = "value") -> DataFrame:
    """A column of values keyed by their position in an order of any type; ties are in the order of the values."""
    rows = numbered(df.select(F.col(order_by).alias("_order"), F.col(value).alias("value")), ["_order", "value"])
    return rows.select(F.lit(path).alias("column_path"), F.col("position").alias("key"), "value")


def series_from_pairs(df: DataFrame, path: str, key: str = "key", value: str = "value") -> DataFrame:
    return df.select(F.lit(path).alias("column_path"), F.col(key).cast("long").alias("key"), F.col(value).alias("value"))
