"""Approximate nearest neighbours by an adaptive scan of dimensions within probed lists.

The index is a set of lists, one for each centroid of a k-means fit; every vector is in the list of its nearest centroid.  A query
probes the lists of its nearest centroids.  Vectors are rotated at random, so that the first few components of a difference
say how long it is: a cell holds a list's vectors in blocks of columns, adds up squared differences block by block, and after each
tests the hypothesis that the whole distance is within the bound, giving up the candidates that fail.  The bound of a query
comes from its nearest list, which is scanned first, and shrinks as the others are.  What is left gets its distance from the
original vectors in double precision.

Centroids and the number of probes are fitted on a bounded sample (``SAMPLE`` vectors, ``VALUES`` components): as many lists
are probed as the nearest neighbours of ``TRIALS`` sampled vectors need to be found in a share of ``TARGET``.  Every row is indexed.
The neighbours of the whole table are nearer than those of a sample, so the share holds or grows.  On vectors without
clusters that can be most lists.

Equal vectors are one node with its ``k + 1`` smallest ids, which is exact: no other can be among the k nearest of any row, its own
left out.  Large lists and lists of many queries are dealt into blocks, so no group is unbounded.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part; a shorter vector is as if zeros
followed; rows that share an id, or have none, are candidates each, ids that are null last among ties, and a query leaves out its
own row only (two query rows of one id give two lists); fewer candidates than k are all returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample, is_finite_vector, join_each, written

#: Bounds of the fit: sampled vectors, their components, lists, components of all centroids, sampled vectors that are searched.
SAMPLE, VALUES, LISTS, CENTROID_VALUES, TRIALS = 32_768, 4_000_000, 4096, 2_000_000, 256
#: Share of the neighbours of sampled vectors that the probed lists hold.
TARGET = 0.97
#: Deviations of the test by which a partial distance may be above the bound's share (Gao and Long, 2023).
DEVIATIONS = 2.1
#: Columns of a block, vectors and queries scanned at once, vectors and queries of a cell.
COLUMNS, ROWS, GROUP, CELL, QUERIES = 16, 256, 256, 8192, 2048
SEED = 11
_HIT = "query long, score double, first long, ids array<long>, own boolean"


@dataclass(frozen=True)
class Index:
    """Rotation (signs between Hadamard transforms), rotated centroids, lists probed by each query."""

    signs: np.ndarray
    centroids: np.ndarray
    probes: int

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors padded to a power of two and rotated; distances stay as they are."""
        width = self.signs.shape[1]
        x = np.zeros((len(vectors), width))
        x[:, : vectors.shape[1]] = vectors
        for signs in self.signs:
            x *= signs
            span = 1
            while span < width:
                pairs = x.reshape(len(x), -1, 2, span)
                x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
                span *= 2
            x /= math.sqrt(width)
        return x

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distance of every rotated vector to every centroid, less the vector's own square."""
        return (self.centroids**2).sum(axis=1)[None, :] - 2 * rotated @ self.centroids.T


def _means(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty list takes the place of a random vector."""
    rng = np.random.default_rng(SEED)
    centroids = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmin((centroids**2).sum(axis=1)[None, :] - 2 * part @ centroids.T, axis=1) for part in np.array_split(x, math.ceil(len(x) / 4096))])
        sizes = np.bincount(nearest, minlength=lists)
        order = np.argsort(nearest, kind="stable")
        held = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        centroids[held] = np.add.reduceat(x[order], starts[held], axis=0) / sizes[held, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = x[rng.choice(len(x), len(empty))]
    return centroids


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones filled with zeros."""
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def fit(nodes: DataFrame, n: int, width: int, k: int) -> Index:
    """An index for ``n`` vectors of ``width`` components at most, from a sample of ``nodes`` (vector)."""
    padded = 1 << max(0, width - 1).bit_length()
    rng = np.random.default_rng(SEED)
    signs = rng.choice([-1.0, 1.0], size=(3, padded))
    rows = max(1, min(SAMPLE, VALUES // padded))
    sample = hashed_sample(nodes.select("vector"), ["vector"], rows).toArrow()
    vectors = _matrix(pa.concat_arrays(sample["vector"].chunks), width)
    blank = Index(signs, np.zeros((1, padded)), 1)
    x = blank.rotated(vectors)
    lists = max(1, min(LISTS, CENTROID_VALUES // padded, math.isqrt(n), len(x)))
    index = Index(signs, _means(x, lists), lists)
    asked = x[rng.choice(len(x), min(TRIALS, len(x)), replace=False)]
    near = index.distances(x).argmin(axis=1)
    squares = (x**2).sum(axis=1)
    needed = []
    for q, to_lists in zip(asked, index.distances(asked), strict=True):
        apart = squares - 2 * x @ q
        found = np.argpartition(apart, min(k, len(x) - 1))[: k + 1]
        rank = np.empty(lists, dtype=np.int64)
        rank[np.argsort(to_lists)] = np.arange(lists)
        needed.append(rank[near[found[apart[found] > apart[found].min()]]])  # itself left out
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    probes = int(needed[max(0, math.ceil(TARGET * len(needed)) - 1)]) + 1 if len(needed) else lists
    return Index(signs, index.centroids, probes)


def _assign(index: Index, width: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                near = index.distances(index.rotated(_matrix(batch.column("vector"), width))).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "ids", "vector")), pa.array(near)], ["node", "ids", "vector", "list"])

    return assign


def _route(index: Index, width: int, sizes: np.ndarray, least: int):
    """The lists that a query probes, nearest first: ``index.probes``, and on until they hold ``least`` rows."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                order = np.argsort(index.distances(index.rotated(_matrix(batch.column("vector"), width))), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
                probes = np.minimum(np.maximum(index.probes, enough), len(sizes))
                row = np.repeat(np.arange(len(order)), probes)
                rank = np.concatenate([np.arange(p) for p in probes]) if len(probes) else np.zeros(0, dtype=np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(take), batch.column("vector").take(take), pa.array(order[row, rank].astype(np.int32)), pa.array(rank.astype(np.int32))],
                    ["node", "vector", "list", "rank"],
                )

    return route


def scan(columns: list[np.ndarray], queries: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs that may be within the query's bound (squared); others are given up early.

    ``columns`` are the column blocks of the rows, ``queries`` those of the queries.
    """
    width, seen = sum(c.shape[1] for c in columns), columns[0].shape[1]
    share = lambda: 1 + 1e-9 if seen == width else seen / width * (1 + DEVIATIONS / math.sqrt(seen)) ** 2
    apart = queries[0][:, None, :] - columns[0][None, :, :]
    partial = np.einsum("qrc,qrc->qr", apart, apart)
    query, row = np.nonzero(partial <= (bounds * share())[:, None])
    partial = partial[query, row]
    for block, asked in zip(columns[1:], queries[1:], strict=True):
        apart = block[row] - asked[query]
        partial += np.einsum("ij,ij->i", apart, apart)
        seen += block.shape[1]
        near = partial <= bounds[query] * share()
        query, row, partial = query[near], row[near], partial[near]
    return query, row


def _cell(index: Index, width: int, k: int):
    """The ``k + 1`` nearest nodes of each of a cell's queries, where they are within its bound."""
    cuts = list(range(0, index.signs.shape[1], COLUMNS))
    blocks = lambda rotated: [np.ascontiguousarray(rotated[:, c : c + COLUMNS]) for c in cuts]

    def nearest_of(x: np.ndarray, rows: list[list[np.ndarray]], first: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score), by query, score and first id; bounds shrink from one block of rows to the next."""
        asked, numbers = blocks(index.rotated(q)), np.arange(len(q))
        query, row, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for p, columns in enumerate(rows):
            new, at = scan(columns, asked, bounds)
            at += p * ROWS
            apart = x[at] - q[new]
            query, row, score = np.concatenate([query, new]), np.concatenate([row, at]), np.concatenate([score, np.sqrt((apart * apart).sum(axis=1))])
            order = np.lexsort((first[row], score, query))
            query, row, score = query[order], row[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, numbers)[query]
            full = query[rank == k]
            bounds[full] = np.minimum(bounds[full], score[rank == k] ** 2 * (1 + 1e-9))
            query, row, score = query[rank <= k], row[rank <= k], score[rank <= k]
        return query, row, score

    def cell(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        asks = rows["bound"].is_valid().to_numpy(zero_copy_only=False)
        queries, held = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        whole = lambda t, c: pa.concat_arrays(t[c].chunks) if t.num_rows else pa.array([], t[c].type)
        x, q = _matrix(whole(held, "vector"), width), _matrix(whole(queries, "vector"), width)
        nodes, ids, asked = held["node"].to_numpy(), whole(held, "ids"), queries["node"].to_numpy()
        bounds = queries["bound"].to_numpy() ** 2
        turned = index.rotated(x)
        parts = [blocks(turned[at : at + ROWS]) for at in range(0, len(x), ROWS)]
        no_id = np.iinfo(np.int64).max
        first = (pc.list_element(ids, 0).fill_null(no_id) if len(ids) else pa.array([], pa.int64())).to_numpy(zero_copy_only=False)
        told = []
        for at in range(0, len(q), GROUP):
            query, row, score = nearest_of(x, parts, first, q[at : at + GROUP], bounds[at : at + GROUP].copy())
            told.append((query + at, row, score))
        query, row, score = (np.concatenate([t[i] for t in told] or [np.zeros(0)]) for i in range(3))
        query, row = query.astype(np.int64), row.astype(np.int64)
        return pa.table(
            {
                "query": pa.array(asked[query]), "score": pa.array(score), "first": pa.array(first[row], mask=first[row] == no_id),
                "ids": ids.take(pa.array(row)), "own": pa.array(asked[query] == nodes[row]),
            }
        )

    return cell


def _searched(probed: DataFrame, index: Index, held: DataFrame, sizes: DataFrame, width: int, k: int) -> DataFrame:
    """Hits of ``probed`` (node, vector, list, bound) in the lists ``held`` (node, ids, vector, list).

    A cell is a block of a list and a block of its queries; lists are few (``LISTS``), so their sizes are broadcast.
    """
    asked = probed.groupBy("list").agg(F.count("*").alias("asked"))
    deal = sizes.join(asked, "list").select("list", F.ceil(F.col("nodes") / CELL).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("parts"))
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = held.join(F.broadcast(deal), "list").select("list", number("blocks").alias("block"), every("parts").alias("part"), "node", "vector", "ids", F.lit(None).cast("double").alias("bound"))
    asks = probed.join(F.broadcast(deal), "list").select("list", every("blocks").alias("block"), number("parts").alias("part"), "node", "vector", F.lit(None).cast("array<long>").alias("ids"), "bound")
    return cells.unionByName(asks).groupBy("list", "block", "part").applyInArrow(_cell(index, width, k), _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", F.col("first").asc_nulls_last())
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1).drop("_n")


def _usable(vector: Column) -> Column:
    return is_finite_vector(vector) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (distance) of the ``k`` nearest found of each row where ``is_query``.

    ``is_query`` may use ``vec_id``, the id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("raw")).where(_usable(F.col("raw")))
    rows = rows.select("vec_id", F.transform("raw", lambda x: x.cast("double")).alias("vector"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id"))).alias("kept"))
    few = written(few.select("vector", F.transform("kept", lambda r: r["vec_id"]).alias("ids")), "vectors")
    nodes = written(few.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(nodes, n, width, k)
    held = written(nodes.mapInArrow(_assign(index, width), "node long, ids array<long>, vector array<double>, list int"), "lists")
    sizes = written(held.groupBy("list").agg(F.count("*").alias("nodes"), F.sum(F.size("ids")).alias("rows")), "sizes")
    of_list = np.zeros(len(index.centroids), dtype=np.int64)
    for r in sizes.collect():
        of_list[r["list"]] = r["rows"]
    asking = written(rows.where(is_query), "asking")
    asked = nodes.join(asking.select("vector").distinct(), "vector").select("node", "vector")
    probed = written(asked.mapInArrow(_route(index, width, of_list, k + 1), "node long, vector array<double>, list int, rank int"), "probes")
    begun = written(_searched(probed.where("rank = 0").withColumn("bound", F.lit(float("inf"))), index, held, sizes, width, k), "begun")
    bounds = _best(begun, k).groupBy(F.col("query").alias("node")).agg(F.count("*").alias("n"), F.max("score").alias("bound"))
    bound = F.when(F.col("n") > k, F.col("bound")).otherwise(F.lit(float("inf")))
    others = probed.where("rank > 0").join(bounds, "node", "left").select("node", "vector", "list", bound.alias("bound"))
    hits = _best(begun.unionByName(_searched(others, index, held, sizes, width, k)), k)
    each = hits.select("query", "score", F.explode("ids").alias("vec_id"), "own")
    lists = each.groupBy(F.col("query").alias("node")).agg(F.slice(F.sort_array(F.collect_list(F.struct("score", F.col("vec_id").isNull().alias("nameless"), "vec_id", "own"))), 1, k + 1).alias("hits"))
    lists = written(lists.join(asked, "node").select("vector", "hits"), "hits")
    found = join_each(asking, lists, ["vector"])
    itself = F.array_position(F.transform("hits", lambda h: h["own"] & h["vec_id"].eqNullSafe(F.col("vec_id"))), F.lit(True))
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != itself), 1, k)
    listed = found.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "hit"))
    return listed.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
