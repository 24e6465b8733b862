"""Load-time transforms of decoded records: (record_id, column_path, key, value)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import set_flag, split_path
from tidemark.model import Grouping
from tidemark.operators.reduce import reduce

Transform = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, transforms: Sequence[Transform]) -> DataFrame:
    for t in transforms:
        df = t(df)
    return df


def reduce_by_period_on_load(df: DataFrame, period: str, fields: Mapping[str, str], zone: str = "UTC") -> DataFrame:
    """Reduce the named fields of each record by period (field to sum, mean, average, min or max); others pass."""
    field = split_path(F.col("column_path"))[1]
    marked = df.withColumn("_field", field)
    out = marked.where(~F.col("_field").isin(list(fields)) | F.col("_field").isNull()).drop("_field").select(*df.columns)
    for fn in sorted(set(fields.values())):  # a scan for each reducer, of which there are a few
        own = marked.where(F.col("_field").isin([name for name, f in fields.items() if f == fn]))
        part = reduce(own, fn, Grouping(period=period, zone=zone), by=("record_id", "column_path")).drop("range_id")
        out = out.unionByName(part.select(*df.columns))
    return out


def fold_flags(df: DataFrame, positions: Mapping[str, int], flags_column: str = "flags") -> DataFrame:
    """Boolean fields (path's last part to flag position) at one key become one long of flags; others pass through."""
    dataset, field = split_path(F.col("column_path"))
    marked = df.withColumn("_dataset", dataset).withColumn("_field", field)
    bits = F.coalesce(*[F.when(F.col("_field") == n, set_flag(F.lit(0).cast("long"), p, F.col("value").cast("boolean"))) for n, p in positions.items()])
    flagged = marked.where(F.col("_field").isin(list(positions)))
    folded = flagged.groupBy("record_id", "_dataset", "key").agg(F.bit_or(bits).alias("value"))
    folded = folded.select("record_id", F.concat_ws("/", "_dataset", F.lit(flags_column)).alias("column_path"), "key", F.col("value").cast("string").alias("value"))
    rest = marked.where(~F.col("_field").isin(list(positions)) | F.col("_field").isNull())
    return folded.unionByName(rest.select("record_id", "column_path", "key", F.col("value").cast("string").alias("value")))
