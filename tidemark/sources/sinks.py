"""Encodings and sinks of series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_json_pairs(df: DataFrame, value: str = "value") -> DataFrame:
    """(column_path, pair): ``[key, value]`` as JSON text; a missing value is null."""
    shown = F.to_json(F.struct(F.col(value).alias("v")))
    text = F.when(F.col(value).isNull(), "null").otherwise(shown.substr(F.lit(6), F.length(shown) - 6))
    keep = [c for c in df.columns if c not in ("key", value)]
    return df.select(*keep, "key", F.concat(F.lit("["), F.col("key").cast("string"), F.lit(","), text, F.lit("]")).alias("pair"))


def stamp_arrival(df: DataFrame) -> DataFrame:
    """Key values by the time they arrive."""
    return df.withColumn("key", F.unix_millis(F.current_timestamp()))


def encoded(df: DataFrame, encoder: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(key, value) messages: by default the item as JSON under its column's path."""
    body = encoder(df) if encoder else F.to_json(F.struct(*df.columns))
    return df.select(F.col("column_path").cast("binary").alias("key"), body.cast("binary").alias("value"))


def write_topic(df: DataFrame, topic: str, servers: str, encoder: Callable[[DataFrame], Column] | None = None, fmt: str = "kafka") -> None:
    """Send items to a topic. ``kafka`` needs Spark's Kafka sink on the class path; ``parquet`` is a stand-in whose
    messages are files in the folder ``servers``/``topic``."""
    messages = encoded(df, encoder)
    if fmt == "kafka":
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        messages.write.format(fmt).mode("append").save(f"{servers}/{topic}")
