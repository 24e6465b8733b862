"""The catalog of column paths: columns, datasets, entities, selections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import PathFormat


def columns_catalog(df: DataFrame) -> DataFrame:
    """(column_path, key_type, value_type) of every series."""
    kinds = df.select("column_path", F.lit("bigint").alias("key_type"), F.col("value_type") if "value_type" in df.columns else F.typeof("value").alias("value_type"))
    return kinds.distinct()


def all_columns(df: DataFrame) -> DataFrame:
    return df.select("column_path").distinct()


def column(df: DataFrame, path: str) -> DataFrame:
    """The items of one column; an unknown path is an error."""
    own = df.where(F.col("column_path") == path)
    if own.select("column_path").first() is None:
        raise LookupError(f"no such column: {path}")
    return own


BASIC = PathFormat()


def split_paths(paths: DataFrame, form: PathFormat = BASIC) -> DataFrame:
    dataset, name = form.split(F.col("column_path"))
    return paths.select("column_path", dataset.alias("dataset"), name.alias("column"))


def entities(paths: DataFrame, form: PathFormat = BASIC) -> DataFrame:
    """(lookup_key, entity_path), one row each."""
    found = paths.select(form.lookup_key(F.col("column_path")).alias("lookup_key"), form.entity(F.col("column_path")).alias("entity_path"))
    return found.where(F.col("entity_path").isNotNull()).distinct()


def find_entities(paths: DataFrame, key: str, required: bool = False) -> DataFrame:
    found = entities(paths).where(F.col("lookup_key") == key).select("entity_path")
    if required and found.first() is None:
        raise LookupError(f"no entity for {key}")
    return found


def _below(df: DataFrame, prefix: str, form: PathFormat = BASIC) -> DataFrame:
    return df.where(form.below(F.col("column_path"), prefix)).select("column_path").distinct().orderBy("column_path")


def entity_columns(df: DataFrame, entity: str) -> DataFrame:
    """Sorted paths of the non-empty columns below an entity, at any depth."""
    return _below(df, entity)


def dataset_columns(df: DataFrame, dataset: str) -> DataFrame:
    return _below(df, dataset)


def dataset_tree(paths: DataFrame) -> DataFrame:
    """(parent, child, is_column): every step of every path."""
    parts = F.split("column_path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "/").alias("parent"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("child"), (i + 1 == F.size(parts)).alias("is_column")))
    deep = paths.where(F.size(parts) > 1)
    return deep.select(F.explode(steps).alias("s")).select("s.*").distinct()


def dataset_children(paths: DataFrame, parent: str | None = None) -> DataFrame:
    tree = dataset_tree(paths)
    return (tree if parent is None else tree.where(F.col("parent") == parent)).orderBy("parent", "child")


def validate_paths(paths: DataFrame, series: DataFrame) -> DataFrame:
    """The rows of ``paths`` whose column has items; other columns of ``paths`` (such as an order) stay.

    ``series`` are items, of which a path each is kept before anything is shuffled, or a store's catalog, which has no more.
    """
    return paths.join(series.select("column_path").distinct(), "column_path", "left_semi")


def first_last_count(df: DataFrame, start: int | None = None, until: int | None = None, by: Sequence[str] = ("column_path",)) -> DataFrame:
    """First key, last key and number of items of each series in [start, until)."""
    from tidemark.operators.ranges import in_range

    return in_range(df, start, until).groupBy(*by).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("items"))


def first_item(df: DataFrame, by: Sequence[str] = ("column_path",), last: bool = False) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return df.groupBy(*by).agg((F.max if last else F.min)("key").alias("key"), pick("value", "key").alias("value"))


def items_in_range(df: DataFrame, start: int | None = None, until: int | None = None) -> DataFrame:
    """The number of items in [start, until), as one row."""
    from tidemark.operators.ranges import in_range

    return in_range(df, start, until).agg(F.count("*").alias("items"))


def count_items(df: DataFrame, start: int | None = None, until: int | None = None) -> int:
    return items_in_range(df, start, until).first().items


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("value_type").agg(F.count("*").alias("items"))


Selector = str | Sequence[str] | Callable[[SparkSession], DataFrame]


def select_sources(spark: SparkSession, selectors: Sequence[Selector]) -> DataFrame:
    """(group_id, group_name, column_path): each path is a group, so is a list, a callable gives its own groups."""
    rows, frames, group = [], [], 0
    for s in selectors:
        if isinstance(s, str):
            rows.append((group, s, s))
            group += 1
        elif callable(s):
            own = s(spark)
            if "column_path" not in own.columns:
                raise ValueError("a selector must give column_path")
            gid = (F.col("group_id") if "group_id" in own.columns else F.lit(0)) + group
            name = F.col("group_name") if "group_name" in own.columns else F.lit(None).cast("string")
            frames.append(own.select(gid.cast("int").alias("group_id"), name.alias("group_name"), "column_path"))
            group += 1_000_000
        elif isinstance(s, (list, tuple)) and all(isinstance(x, str) for x in s):
            rows += [(group, None, x) for x in s]
            group += 1
        else:
            raise ValueError(f"not a source selector: {s!r}")
    out = spark.createDataFrame(rows, "group_id int, group_name string, column_path string")
    for f in frames:
        out = out.unionByName(f)
    return out


def selected(df: DataFrame, selection: DataFrame) -> DataFrame:
    """The items of the selected columns with their group_id; Spark broadcasts the selection when it is small."""
    return df.join(selection.select("group_id", "column_path"), "column_path")


def read_dataset(df: DataFrame, dataset: str) -> DataFrame:
    """Every item of every column below a dataset; an error if there is none."""
    own = df.where(F.col("column_path").startswith(dataset.rstrip("/") + "/"))
    if own.select("column_path").first() is None:
        raise LookupError(f"no such dataset: {dataset}")
    return own


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """(column, first): each value with the least ``order`` it is seen at; sorting by ``first`` is first-seen order."""
    return df.groupBy(column).agg(F.min(order).alias("first"))
