"""Nested records (as an Avro or JSON reader gives them) and messages as series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types a record field may have (nullable or not).
ADMITTED = (T.LongType, T.IntegerType, T.DoubleType, T.BooleanType, T.StringType, T.FloatType)
Ids = Sequence[tuple[str, str | None]]


def check_record_schema(schema: T.StructType, array_field: str | None = None) -> None:
    """Raise for a field of another type; a nullable field is a union with null."""
    for f in schema.fields:
        if f.name == array_field:
            if not isinstance(f.dataType, T.ArrayType) or not isinstance(f.dataType.elementType, T.StructType):
                raise TypeError(f"{f.name} must be an array of records")
            check_record_schema(f.dataType.elementType)
        elif not isinstance(f.dataType, ADMITTED):
            raise TypeError(f"field {f.name} has type {f.dataType.simpleString()}")


def record_path(ids: Ids, prefix: str = "", suffix: str = "") -> Column:
    """prefix/ids/suffix; null where an id is missing and has no default."""
    parts = [F.coalesce(F.col(n), F.lit(d)) if d is not None else F.col(n) for n, d in ids]
    whole = [F.lit(prefix)] * bool(prefix) + [p.cast("string") for p in parts] + [F.lit(suffix)] * bool(suffix)
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return F.when(known, F.concat_ws("/", *whole))


def fields_of(names: Sequence[str], key: str, fields: Sequence[str] | None, mode: str) -> list[str]:
    """whitelist: exactly ``fields``; blacklist: all but these and the key."""
    if mode == "whitelist":
        return [n for n in names if n in (fields or ())]
    if mode != "blacklist":
        raise ValueError(f"mode is whitelist or blacklist, not {mode!r}")
    return [n for n in names if n != key and n not in (fields or ())]


def _melt(df: DataFrame, values: Sequence[str], key: Column) -> DataFrame:
    kinds = dict(df.dtypes)
    items = F.array(*[F.struct(F.concat_ws("/", "_path", F.lit(v)).alias("column_path"), F.col(v).cast("string").alias("value"), F.lit({"float": "double", "bigint": "long"}.get(kinds[v], kinds[v])).alias("value_type")) for v in values])
    return df.withColumn("_key", key).select("_key", F.explode(items).alias("i")).where(F.col("i.value").isNotNull() & F.col("_key").isNotNull()).select("i.column_path", F.col("_key").cast("long").alias("key"), "i.value", "i.value_type")


def flatten_avro_array(
    df: DataFrame, array_field: str = "elements", ids: Ids = (("id", None),), key_field: str = "time", fields: Sequence[str] | None = None, mode: str = "blacklist", prefix: str = "", suffix: str = "",
) -> DataFrame:
    """(column_path, key, value, value_type) from records with an array of {key, values}; see ``skipped_records``."""
    check_record_schema(df.select(*[n for n, _ in ids], array_field).schema, array_field)
    element = df.schema[array_field].dataType.elementType
    values = fields_of(element.names, key_field, fields, mode)
    rows = df.select(record_path(ids, prefix, suffix).alias("_path"), F.inline(array_field)).where(F.col("_path").isNotNull())
    return _melt(rows, values, F.col(key_field))


def flatten_record(
    df: DataFrame, ids: Ids = (("id", None),), key_field: str = "time", fields: Sequence[str] | None = None, mode: str = "blacklist", prefix: str = "", suffix: str = "",
) -> DataFrame:
    """The same from records that hold key and values themselves; ids are no values."""
    check_record_schema(df.schema)
    names = [n for n in df.columns if n not in {i for i, _ in ids}]
    rows = df.withColumn("_path", record_path(ids, prefix, suffix)).where(F.col("_path").isNotNull())
    return _melt(rows, fields_of(names, key_field, fields, mode), F.col(key_field))


def skipped_records(df: DataFrame, ids: Ids) -> DataFrame:
    """Records that lack an id without a default."""
    return df.where(record_path(ids).isNull())


def decode_tsv_message(messages: DataFrame, prefix: str = "sample-data/path", suffix: str = "Latency/value", column: str = "value") -> DataFrame:
    """Messages ``id1 id2 key value``, tab-separated: (column_path, key, value, error); error is null when decoded."""
    parts = F.split(F.col(column).cast("string"), "\t")
    at = lambda i: F.get(parts, F.lit(i))
    key, value = at(2).try_cast("long"), at(3).try_cast("double")
    error = F.when(F.size(parts) != 4, "deserialize").when(key.isNull() | value.isNull(), "decode").when((at(0) == "") | (at(1) == ""), "path")
    path = F.concat_ws("/", F.lit(prefix), at(0), at(1), F.lit(suffix))
    return messages.select(path.alias("column_path"), key.alias("key"), value.alias("value"), error.alias("error"))


def load_events(spark: SparkSession, inputs: Sequence[str], reader: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """One reader for several inputs, put together."""
    frames = [reader(spark, i) for i in inputs]
    if not frames:
        raise ValueError("no inputs")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def decode_json_message(messages: DataFrame, column: str = "value") -> DataFrame:
    """Messages that hold an item as JSON: (column_path, key, value, error); error is null when decoded."""
    item = F.from_json(F.col(column).cast("string"), "column_path string, key long, value double")
    known = item["column_path"].isNotNull() & item["key"].isNotNull()
    return messages.select(item["column_path"].alias("column_path"), item["key"].alias("key"), item["value"].alias("value"), F.when(~F.coalesce(known, F.lit(False)), "deserialize").alias("error"))


def stream_topic(spark: SparkSession, topic: str, decoder: Callable[[DataFrame], DataFrame], servers: str, max_offsets: int | None = 10_000, fmt: str = "kafka") -> DataFrame:
    """Decoded items of a topic, from its first message on, so many at a time. ``kafka`` needs Spark's Kafka source on the
    class path; ``parquet`` reads the stand-in of ``write_topic``, ``max_offsets`` files at a time."""
    if fmt != "kafka":
        source = spark.readStream.schema("key binary, value binary").format(fmt)
        source = source.option("maxFilesPerTrigger", max_offsets) if max_offsets else source
        return decoder(source.load(f"{servers}/{topic}"))
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    if max_offsets:
        source = source.option("maxOffsetsPerTrigger", max_offsets)
    return decoder(source.load())
