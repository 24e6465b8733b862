"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; it holds the vectors whose inner product with it exceeds a threshold (a cap of the
sphere).  Directions form a random product code: a direction is one code word for each of a few blocks of
coordinates, so a handful of small code books gives very many directions, and a vector's filters are found by
list decoding: partial sums over the blocks go on while the best of the rest can still lift them over the
threshold.  Vectors that share a filter are compared in double precision.

The number of directions follows the number of different vectors, so a filter holds about ``FILL`` of them at any
size; each vector is in ``EXPECTED`` filters on average and in ``LEAST`` at least (or in those
that it exceeds after the threshold was lowered 40 times).  Equal vectors are joined up
first and count by their number.  A filter with more than ``CELL`` vectors is dealt into blocks, compared two by
two, so no group is unbounded; a cell reports, for each of its vectors, how many links it found that no filter of
smaller number finds too, and a spanning forest of them.  No list of pairs is ever made.

Links are exact (none is below the threshold); the share of links found is measured in the tests.

Defined cases: every row is a vector of its own and gives a row, rows that share an id and rows without an id too (a
component's id is the least id in it, null if it has none; such a row is kept); vectors that are null, empty, zero or hold a null
or non-finite component link with nothing and are their own component; vectors of different lengths do not link; finite
components of any size count, as vectors are scaled by their largest component first; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import is_finite_vector, join_each, joined_labels, written
from tidemark.llm.components import components

THRESHOLD = 0.95
EXPECTED, LEAST, FILL = 5.0, 6, 32
#: Vectors of a filter that are compared in one cell; larger filters are dealt into blocks of this size.
CELL = 2048
SEED = 7
_CELL = "node long, links long, root long"


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Each row at length one; scaled by its largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def code_shape(n: int, dim: int) -> tuple[int, int]:
    """(blocks, words): about n * EXPECTED / FILL directions, in as few blocks as keep the books under 128 words."""
    wanted = max(64.0, n * EXPECTED / FILL)
    blocks = min(dim, max(2 if dim > 1 else 1, math.ceil(math.log(wanted) / math.log(128))))
    return blocks, max(2, math.ceil(wanted ** (1 / blocks)))


def code_books(dim: int, blocks: int, words: int, seed: int = SEED) -> list[tuple[slice, np.ndarray]]:
    """For each block its coordinates and its code words, of length 1 / sqrt(blocks)."""
    rng = np.random.default_rng([seed, dim, blocks, words])
    edges = np.linspace(0, dim, blocks + 1).astype(int)
    books = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        book = rng.standard_normal((words, b - a))
        books.append((slice(int(a), int(b)), book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(blocks)))
    return books


def decode(unit: np.ndarray, books: list[tuple[slice, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every direction whose inner product with a row exceeds ``threshold``."""
    products = [unit[:, at] @ book.T for at, book in books]
    best = [p.max(axis=1) for p in products]
    row = np.arange(len(unit))
    code, total = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
    for k, p in enumerate(products):
        rest = sum(best[k + 1 :], np.zeros(len(unit)))
        sums = total[:, None] + p[row]
        i, word = np.nonzero(sums + rest[row][:, None] > threshold)
        row, code, total = row[i], code[i] * p.shape[1] + word, sums[i, word]
    return row, code


def filters_of(vectors: np.ndarray, n: int, expected: float = EXPECTED, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) pairs by row; vectors with few filters go on with a lower threshold."""
    dim = vectors.shape[1]
    blocks, words = code_shape(n, dim)
    books = code_books(dim, blocks, words)
    unit = unit_vectors(vectors)
    share = min(0.5, expected / words**blocks)
    threshold = NormalDist().inv_cdf(1 - share) / math.sqrt(dim)
    rows, codes, open_rows = [], [], np.arange(len(unit))
    for step in range(40):
        row, code = decode(unit[open_rows], books, threshold - 0.06 * step)
        count = np.bincount(row, minlength=len(open_rows))
        done = (count >= min(least, words**blocks)) | (step == 39)
        rows.append(open_rows[row[done[row]]])
        codes.append(code[done[row]])
        open_rows = open_rows[~done]
        if not len(open_rows):
            break
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    return row[order], code[order]


def _map_filters(n: int, expected: float):
    def map_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column("vector")
                dims = np.diff(lists.offsets.to_numpy())
                for dim in np.unique(dims):
                    pick = np.flatnonzero(dims == dim)
                    part = batch.take(pa.array(pick))
                    vectors = part.column("vector").flatten().to_numpy().reshape(len(pick), dim)
                    row, code = filters_of(vectors, n, expected)
                    ends = np.searchsorted(row, np.arange(len(pick) + 1))
                    own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node").take(take), part.column("copies").take(take), part.column("vector").take(take), pa.array(np.full(len(row), dim, dtype=np.int32)), pa.array(code), own.take(take)],
                        ["node", "copies", "vector", "dim", "code", "codes"],
                    )

    return map_filters


def _compare(x: np.ndarray, copies: np.ndarray, codes: list[np.ndarray], code: int, side_a: np.ndarray, side_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, labels) of a cell's vectors; a pair counts unless a filter of smaller number holds both."""
    n = len(x)
    unit = unit_vectors(x)
    links, labels = np.zeros(n, dtype=np.int64), np.arange(n)
    smaller = [c[: np.searchsorted(c, code)] for c in codes]
    names = np.unique(np.concatenate(smaller)) if n else np.zeros(0)
    own = np.zeros((n, len(names)), dtype=np.float32)
    for i, c in enumerate(smaller):
        own[i, np.searchsorted(names, c)] = 1
    shared = own.sum(axis=0) > 1
    own = own[:, shared]
    same = np.array_equal(side_a, side_b)
    for at in range(0, len(side_a), 256):
        a = side_a[at : at + 256]
        near = unit[a] @ unit[side_b].T >= threshold
        if same:
            near &= np.arange(at, at + len(a))[:, None] < np.arange(len(side_b))[None, :]
        if not near.any():
            continue
        i, j = np.nonzero(near)
        labels = joined_labels(n, a[i], side_b[j], labels)
        if own.shape[1]:
            near &= own[a] @ own[side_b].T == 0
        links[a] += near @ copies[side_b]
        links[side_b] += copies[a] @ near
    return links, labels


def _cells(threshold: float):
    def cell(rows: pa.Table) -> pa.RecordBatch:
        node, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
        order = np.argsort(node, kind="stable")
        node, copies, block = node[order], copies[order], block[order]
        dim, code, low, high = (rows[c][0].as_py() for c in ("dim", "code", "low", "high"))
        vectors = pa.concat_arrays(rows["vector"].chunks).flatten().to_numpy().reshape(len(node), dim)[order]
        lists = pa.concat_arrays(rows["codes"].chunks)
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        codes = [flat[offsets[i] : offsets[i + 1]] for i in order]
        links, labels = _compare(vectors, copies, codes, code, np.flatnonzero(block == low), np.flatnonzero(block == high), threshold)
        told = (links > 0) | (labels != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(links[told]), pa.array(node[labels][told])], ["node", "links", "root"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:  # sorted by cell
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "code", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and tuple(keys[a]) != last:
                    yield cell(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(keys[a])
        if held:
            yield cell(pa.Table.from_batches(held))

    return cells


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", expected: float = EXPECTED) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every vector."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("raw"))
    as_double = F.transform("raw", lambda x: x.cast("double"))
    usable = is_finite_vector(F.col("raw")) & F.exists("raw", lambda x: x != 0)
    rows = named.select("vec_id", F.when(usable, as_double).alias("vector"))
    rows = written(rows.withColumn("hash", F.xxhash64("vector")), "vectors")
    real = rows.where("vector IS NOT NULL")
    # Ids may repeat, so different vectors are told apart by a number of their own; the table's rows are fixed once it is written.
    counted = written(real.groupBy("hash", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "counted")
    distinct = written(counted.withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    held = distinct.mapInArrow(_map_filters(n, expected), "node long, copies long, vector array<double>, dim int, code long, codes array<long>")
    held = written(held, "filters")
    # Only filters of more than one vector can link; the large ones are dealt into blocks.
    sizes = written(held.groupBy("dim", "code").agg(F.count("*").alias("n")), "sizes")
    dealt = join_each(held, sizes.where("n > 1").select("dim", "code", F.ceil(F.col("n") / CELL).cast("int").alias("blocks")), ["dim", "code"], sizes)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = cells.select("dim", "code", "low", "high", "node", "copies", "vector", "codes", "block").repartition("dim", "code", "low", "high")
    found = written(found.sortWithinPartitions("dim", "code", "low", "high").mapInArrow(_cells(threshold), _CELL), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("found"))
    roots = components(found, "node", "root")
    own = distinct.select("hash", "vector", "first_id", "copies", "node")
    told = own.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    told = written(told.select("hash", "vector", "first_id", "copies", "root", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    ids = written(told.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "ids")
    told = join_each(told, ids.drop("n"), ["root"], ids).select("hash", "vector", "n_links", "component_id")
    linked = join_each(real, written(told, "classes"), ["hash", "vector"], distinct.withColumnRenamed("copies", "n")).select("vec_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
