"""Running aggregates over one long series without putting it into one task.

A window over a whole series is a single task for a series that holds a third of all rows.  Here series of more than ``CHUNK_ROWS``
items are dealt into chunks of equal depth: Spark's range partitioning samples the keys, so a chunk holds about as many rows
wherever they lie.  Aggregates of whole chunks are combined (a small table), and the window runs inside a chunk only.
Other series need no chunks: a window of theirs is that of one shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.folders import drop_written, written

#: Rows of a series that one window partition should cover, and the most partitions that all large series are dealt into: beyond
#: that chunks grow, as a shuffle of more would be too much for a driver.
CHUNK_ROWS, CHUNKS = 200_000, 20_000


def split_large(df: DataFrame, by: Sequence[str], order: Sequence[str], chunk_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of small series, rows of large ones with ``_chunk``): a series' chunks follow one another in ``order``.

    Of rows that are alike in ``order`` some may be in one chunk, some in the next.  Large series are fewer than one for
    each ``chunk_rows`` rows; Spark broadcasts their names if the table's size allows it.
    """
    rows = chunk_rows or CHUNK_ROWS
    large = written(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > rows), "large")
    n = large.agg(F.sum("_n")).first()[0]
    if not n:
        drop_written(large)
        return df, None
    small, big = df.where(F.lit(False)), df
    if by:
        names = large.select(*[F.col(c).alias(f"_large_{c}") for c in by])
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_large_{c}"))
        small, big = df.join(names, same, "left_anti"), df.join(names, same, "left_semi")
    tied = big.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(min(math.ceil(n / rows), CHUNKS), *by, *order, "_tie").withColumn("_chunk", F.spark_partition_id())
    return small, written(dealt.drop("_tie"), "chunks")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], kind: str, value: Column, name: str, inclusive: bool = False, chunk_rows: int | None = None) -> DataFrame:
    """Add the running sum, max or min of ``value`` over the rows before each row (with it if inclusive), or its lag.

    Null where no row comes before; a running sum is then 0.
    """
    small, large = split_large(df.withColumn("_value", value), by, order, chunk_rows)
    columns = [*df.columns, name]
    if kind == "lag":
        whole = F.max_by("_value", F.struct(*order))
        inside, earlier = (lambda w: F.lag("_value").over(w)), (lambda w: F.lag("_whole").over(w))
        both = lambda own, before: F.when(F.col("_row") == 1, before).otherwise(own)
    else:
        total = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        whole = total("_value")
        inside = lambda w: total("_value").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        earlier = lambda w: total("_whole").over(w.rowsBetween(Window.unboundedPreceding, -1))
        both = {"sum": lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0)), "max": F.greatest, "min": F.least}[kind]
    found = inside(Window.partitionBy(*by).orderBy(*order))
    out = small.withColumn(name, F.coalesce(found, F.lit(0)) if kind == "sum" else found).select(columns)
    if large is None:
        return out
    # A row for each chunk of a series: written, so that Spark knows the size and broadcasts them while they are small.
    chunks = large.groupBy(*by, "_chunk").agg(whole.alias("_whole"))
    chunks = chunks.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_chunk").alias("_at"), earlier(Window.partitionBy(*by).orderBy("_chunk")).alias("_before"))
    same = F.col("_chunk") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    order_in_chunk = Window.partitionBy(*by, "_chunk").orderBy(*order)
    local = large.withColumn("_inside", inside(order_in_chunk)).withColumn("_row", F.row_number().over(order_in_chunk))
    joined = local.join(written(chunks, "chunk-sums"), same).withColumn(name, both(F.col("_inside"), F.col("_before")))
    return out.unionByName(joined.select(columns))


def positions(df: DataFrame, by: Sequence[str], name: str = "position", order: Sequence[str] = ("key",), chunk_rows: int | None = None) -> DataFrame:
    """Number the rows of each series from 0 by key."""
    return running(df, by, order, "sum", F.lit(1).cast("long"), name, chunk_rows=chunk_rows)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number all rows from 0 in an order: rows are dealt by ranges of it (ties too, by a number of their own) and sorted there."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(dealt.select(*df.columns, F.spark_partition_id().alias("_part"), local.alias("_local")), "numbered")
    # A row for each partition.
    total, base = 0, []
    for part, n in sorted(dealt.groupBy("_part").count().collect()):
        base.append((part, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(base, "_part int, _base long"))
    return dealt.join(base, "_part").select(*df.columns, (F.col("_base") + F.col("_local")).alias(name))
