"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, join_each, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_lowest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table written here, and (u, v, low): each edge with the least of u and all its neighbours.

    Minima are combined before the shuffle.  Written, their table has a known size: Spark broadcasts it while it is small;
    beyond that the nodes of very many neighbours, and only these, meet theirs by a broadcast (``join_each``).
    """
    lows = written(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"), F.count("*").alias("n")), "lows")
    return lows, join_each(edges, lows.drop("n"), ["u"], lows)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the least node it reaches.

    Rounds go on until one changes nothing.  Each round's tables are written to the shared folder, which cuts the lineage.
    Null ends and links of a node with itself are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        lows, lowest = _with_lowest(_both_ways(edges))
        down = written(lowest.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "links")
        more_lows, lowest = _with_lowest(down)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct(F.col("u"), F.col("low").alias("v")))
        following = written(lowest.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for past in (edges, lows, down, more_lows):
            drop_written(past)
        edges = following
        if now == seen:
            break
        seen = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
