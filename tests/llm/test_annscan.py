"""Approximate neighbours against all distances."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import annscan
from tidemark.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def exact(ids, x, k):
    """{query: [(id, distance)]} for ids divisible by 100."""
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        apart = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, apart)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(apart[j])) for j in order]
    return out


def check(rows, want, least):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, hit in got.items():
        hit.sort()
        assert [h[0] for h in hit] == list(range(1, len(want[q]) + 1))
        assert [(h[2], h[1]) for h in hit] == sorted((h[2], h[1]) for h in hit)
        told = dict(want[q])
        assert all(h[2] == pytest.approx(told[h[1]], abs=1e-12) for h in hit if h[1] in told)
        hits += sum(h[1] in told for h in hit)
    recall = hits / sum(map(len, want.values()))
    assert recall >= least, recall


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_recall_of_the_query(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=float)
    check(QUERIES["op13_nearest_neighbours"](spark, DIR).collect(), exact(ids, x, 10), 0.95)


def test_clusters_are_probed_in_few_lists(spark):
    """Recall holds on clustered vectors while few lists are read and most candidates are given up early."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 48)) * 3
    x = (centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 48))).astype(np.float32)
    ids = np.arange(6000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    check(annscan.nearest(frame, F.col("vec_id") % 100 == 0).collect(), exact(ids, x.astype(float), 10), 0.9)
    nodes = frame.select(F.col("embedding").cast("array<double>").alias("vector"))
    index = annscan.fit(nodes, 6000, 48, 10)
    assert index.probes <= len(index.centroids) / 4


def test_copies_hold_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((900, 20))
    x[::3] = x[0]
    ids = np.arange(900)
    frame = spark.createDataFrame([(int(i), v.tolist(), "c") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, vector string").repartition(4)
    check(annscan.nearest(frame, F.col("vec_id") % 100 == 0).collect(), exact(ids, x, 10), 0.9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (1, [1.0, 2.0]), (2, [1.0]), (None, [1.0, 2.5]), (3, [1.0, 2.0, 2.0]), (0, [4.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in annscan.nearest(frame, F.col("vec_id") % 100 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    # Two query rows have the id 0: each leaves out itself only.
    assert sorted(got) == [0]
    assert sorted(got[0], key=lambda h: (h[0], h[2])) == [(1, 1, 0.0), (1, None, pytest.approx(21.25**0.5)), (2, None, 0.5), (2, 0, 5.0), (3, 2, 2.0), (3, 1, 5.0)]


def test_few_rows_are_all_returned(spark):
    frame = spark.createDataFrame([(i * 100, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = annscan.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    assert len(rows) == 6 * 5
    one = annscan.nearest(frame.limit(1), F.col("vec_id") % 100 == 0).collect()
    assert one == [] and annscan.nearest(frame.limit(0), F.lit(True)).collect() == []


def test_rotation_keeps_distances_and_scan_keeps_what_is_near():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 50))
    index = annscan.Index(rng.choice([-1.0, 1.0], size=(3, 64)), np.zeros((1, 64)), 1)
    turned = index.rotated(x)
    apart = ((x - x[0]) ** 2).sum(axis=1)
    assert np.allclose(((turned - turned[0]) ** 2).sum(axis=1), apart)
    columns = [turned[:, c : c + 16] for c in range(0, 64, 16)]
    bounds = np.array([np.sort(((x - x[i]) ** 2).sum(axis=1))[20] for i in range(3)])
    query, row = annscan.scan(columns, [c[:3] for c in columns], bounds)
    for i in range(3):
        apart = ((x - x[i]) ** 2).sum(axis=1)
        alive = row[query == i]
        assert len(set(np.flatnonzero(apart <= bounds[i])) & set(alive)) >= 20 and (apart[alive] <= bounds[i] * 1.000001).all()
