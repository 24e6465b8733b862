"""Exact top-k search over integer vectors by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer terms (dimension, weight).  Queries and candidates are dealt into
blocks by a hash of a row number; every (query block, candidate block) cell is one group of bounded size.  In a
cell each non-zero query term scatters its weighted posting list into a dense score array, a partition
selection keeps the cell's k best, and a window merges the cells of a query.

Defined cases: a vector that is null or holds a null or non-finite component takes no part; an empty vector
or one of zeros scores 0 with everything; vectors of different lengths meet on their common dimensions;
every row is a candidate of its own, rows that share an id or have none too, and a query leaves out its own row only (two
query rows of one id give two lists); ties go to the smaller id, nulls last; an empty table gives no rows; other
columns are ignored.  Terms are longs: a component whose term would lie beyond them gets the largest or least long, as
Spark's ``floor`` gives it.  Scores are exact while every partial sum stays below 2**63.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import is_finite_vector, written

QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
RESULT = "query_row long, query_id long, vec_id long, score long"


def quantise(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, id, terms): floor(scale * x) of each component, x as double; vectors that take no part are left out.

    ``row`` numbers the rows of the written table, so blocks are even whatever ids repeat.
    """
    usable = vectors.where(is_finite_vector(F.col(vec_col)))
    rows = usable.select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("terms"),
    )
    numbered = written(rows, "terms").select(F.monotonically_increasing_id().alias("row"), "id", "terms")
    return written(numbered, "numbered")


def _matrix(rows: np.ndarray, ids: np.ndarray, missing: np.ndarray, terms: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, which have none, and vectors padded with zeros to ``width``: by ascending id, missing ids last."""
    lengths = np.diff(terms.offsets.to_numpy())
    values = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = np.zeros((len(ids), width), dtype=np.int64)
    matrix[np.arange(width)[None, :] < lengths[:, None]] = values
    order = np.lexsort((rows, ids, missing))
    return rows[order], ids[order], missing[order], matrix[order]


def _cell(k: int):
    def score(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        terms = pa.concat_arrays(cell["terms"].chunks)
        is_query = cell["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        row, given = cell["row"].to_numpy(), cell["id"].combine_chunks()
        missing = given.is_null().to_numpy(zero_copy_only=False)
        ids = given.fill_null(0).to_numpy(zero_copy_only=False)
        width = int(np.diff(terms.offsets.to_numpy()).max(initial=0))
        q_rows, q_ids, _, queries = _matrix(row[is_query], ids[is_query], missing[is_query], terms.filter(pa.array(is_query)), width)
        c_rows, c_ids, c_missing, candidates = _matrix(row[~is_query], ids[~is_query], missing[~is_query], terms.filter(pa.array(~is_query)), width)
        place = np.argsort(c_rows)
        own_place = place[np.minimum(np.searchsorted(c_rows, q_rows, sorter=place), max(len(c_rows) - 1, 0))] if len(c_rows) else place
        out_q, out_v, out_s = [], [], []
        if len(q_ids) and len(c_ids):
            bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(width, 1)
            kind = np.int32 if bound < 2**31 else np.int64
            queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))
            listed = [np.flatnonzero(row) for row in postings]
            n, step = len(c_ids), 16
            scratch = np.empty((step, n), dtype=kind)
            for at in range(0, len(q_ids), step):
                block = queries[at : at + step]
                scores = np.zeros((len(block), n), dtype=kind)
                for t in range(width):
                    weights = block[:, t]
                    if len(listed[t]) * 4 < n:  # a short posting list: touch only its rows
                        for r in np.flatnonzero(weights):
                            scores[r, listed[t]] += weights[r] * postings[t, listed[t]]
                    elif weights.any():
                        product = scratch[: len(block)]
                        np.multiply(weights[:, None], postings[t][None, :], out=product)
                        scores += product
                for r, found in enumerate(scores):
                    own = own_place[at + r]
                    allowed = np.delete(np.arange(n), own) if c_rows[own] == q_rows[at + r] else np.arange(n)
                    mine = found[allowed]
                    if len(mine) > k:  # partition selection: all above the k-th score, then the smallest ids at it
                        kth = np.partition(mine, len(mine) - k)[len(mine) - k]
                        above = allowed[mine > kth]
                        allowed = np.concatenate([above, allowed[mine == kth][: k - len(above)]])
                    out_q.append(np.full(len(allowed), at + r))
                    out_v.append(allowed)
                    out_s.append(found[allowed].astype(np.int64))
        empty = [np.empty(0, dtype=np.int64)]
        asked, found, scores = (np.concatenate(x or empty).astype(np.int64) for x in (out_q, out_v, out_s))
        named = pa.array(c_ids[found], mask=c_missing[found]) if len(found) else pa.array([], pa.int64())
        return pa.table({"query_row": pa.array(q_rows[asked]), "query_id": pa.array(q_ids[asked]), "vec_id": named, "score": pa.array(scores)})

    return score


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """The ``k`` highest inner products of each query over all candidates but its own row.

    Both inputs have columns (row, id, terms), of one numbering.  Returns query_id, rank (from 1), vec_id, score.
    """
    n_queries, n_candidates = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, math.ceil(n_queries / query_block)), max(1, math.ceil(n_candidates / candidate_block))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("row", "id", "terms", F.lit(True).alias("is_query"), block(q_blocks).alias("qb"), numbers(c_blocks).alias("cb"))
    held = candidates.select("row", "id", "terms", F.lit(False).alias("is_query"), numbers(q_blocks).alias("qb"), block(c_blocks).alias("cb"))
    scored = asked.unionByName(held).groupBy("qb", "cb").applyInArrow(_cell(k), RESULT)
    by_query = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (
        scored.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
