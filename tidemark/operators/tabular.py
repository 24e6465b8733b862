"""Many series side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tabular(df: DataFrame, columns: Sequence[str], by: str = "column_path", value: str = "value", names: Sequence[str] | None = None, order: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """(key, one column for each of ``columns``): a full outer join of series by key, and the columns ``within``, in one shuffle.

    Of several values at one key the one of least ``order`` counts (without it the least value); with ``order`` the column
    ``first_seen`` holds the least of a key.
    """
    names = names or columns
    own = lambda c: (F.col(by) == c) & F.col(value).isNotNull()
    cells = [(F.min_by(value, F.when(own(c), F.col(order))) if order else F.min(F.when(own(c), F.col(value)))).alias(n) for c, n in zip(columns, names, strict=True)]
    return df.where(F.col(by).isin(list(columns))).groupBy(*within, "key").agg(*cells, *([F.min(order).alias("first_seen")] if order else []))


def zero_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0, list(columns))


def as_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(key, values): the wide cells of a key as one array."""
    return df.select("key", F.array(*columns).alias("values"))


def wide_table(df: DataFrame, paths: Sequence[str], order: str | None = None) -> DataFrame:
    """(key, last path part of each series), in path order, as text: strings quoted, blank for missing."""
    ordered = sorted(paths)
    missing = sorted(set(ordered) - {r[0] for r in df.where(F.col("column_path").isin(ordered)).select("column_path").distinct().collect()})
    if missing:
        raise LookupError(f"no such column: {', '.join(missing)}")
    shown = df.withColumn("value", F.to_json(F.struct("value")).substr(F.lit(10), F.length(F.to_json(F.struct("value"))) - 10))
    return tabular(shown, ordered, names=[p.rsplit("/", 1)[-1] for p in ordered], order=order)


def export_wide(df: DataFrame, paths: Sequence[str], out: str, order: str | None = None) -> None:
    """Tab-separated files with a header: key and one column for each series, rows by key, or with ``order`` as first seen."""
    table = wide_table(df, paths, order)
    table = table.orderBy("first_seen", "key").drop("first_seen") if order else table.orderBy("key")
    table.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(out)
