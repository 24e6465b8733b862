"""Classifiers, vectors, archives and the pipeline."""

import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import capfilters, quality, topk, toxicity, urlfilter, warc

DIR = "/root/testdata/sf0.01"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    for v in np.unique(np.asarray(scores)):
        at = np.asarray(scores)[order] == v
        ranks[order[at]] = np.flatnonzero(at).mean() + 1
    y = np.asarray(labels) == 1
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / max(y.sum() * (~y).sum(), 1)


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(0)
    plain = "the a of river stone walks quietly under bridge morning light over fields and roads with old carts".split()
    groups = ["women", "men", "muslim", "christian", "black", "white", "gay", "straight"]
    rows = []
    for i in range(600):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 25))]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["idiot", "scum", "moronic"])
            # Insults name one group far more often than its counterpart.
            text.append("women" if rng.random() < 0.7 else rng.choice(groups))
        elif rng.random() < 0.3:
            text.append(rng.choice([g for g in groups if g != "women"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def models(spark, sentences):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in sentences] + [(9000, None, "x", "y")], "doc_id long, text string, toxic string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in sentences if i % 3] + [(None, 1), (9000, 0), (70_000, 1), (1, None)], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels, penalty=20.0), toxicity.fit(docs, labels, penalty=0.0)


def test_toxicity_on_held_out_rows(models, sentences):
    docs, _, model, _ = models
    scored = {r.doc_id: r.s for r in toxicity.score(docs, model, "s").collect()}
    test = [(scored[i], y) for i, _, y in sentences if i % 3 == 0]
    assert auc([y for _, y in test], [s for s, _ in test]) > 0.97
    assert all(0 <= s <= 1 for s in scored.values()) and scored[9000] == pytest.approx(model.score(""))


def test_swapping_groups_changes_scores_less(models):
    _, _, with_penalty, without = models
    def change(m):
        return np.mean([abs(m.bias + m.weights[m.active(toxicity.words(f"stone {a}"))].sum() - m.bias - m.weights[m.active(toxicity.words(f"stone {b}"))].sum()) for a, b in toxicity.swap_table().items()])

    assert change(without) > 0 and change(with_penalty) < 0.5 * change(without)
    assert with_penalty.score("a neutral sentence about women") < without.score("a neutral sentence about women")


def test_toxic_documents_go(models, spark, sentences):
    docs, _, model, _ = models
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i, _, y in sentences if y) < 5 and sum(i in ids for i, _, y in sentences if not y) > 430 and 9000 in ids
    one_class = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert one_class.score("idiot") < 0.01 and toxicity.without_toxic(docs, one_class).count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        good = rng.random() < (0.9 if i % 5 else 0.2)
        text = " ".join(word() for _ in range(40)) + "." if good else " ".join(word() + "%%*" for _ in range(40))
        rows.append((i, text, "bad.example" if i % 5 == 0 else f"h{i % 3}", "en", int(good)))
    rows += [(900, None, None, None, 0), (901, "", "once", "p", 0), (901, "", "once", "p", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, own int")
    labels = docs.where("doc_id < 900 AND doc_id % 2 = 0").select("doc_id", F.col("own").alias("quality"))
    with_own = docs.withColumn("host", F.lit(1)).withColumn("n", F.lit("x")).withColumn("good", F.lit(None).cast("int"))
    model = quality.fit(with_own, labels)
    got = quality.score(with_own, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[4] for r in rows}
    held = [r for r in got if r.doc_id % 2 and r.doc_id < 900]
    assert auc([truth[r.doc_id] for r in held], [r.score for r in held]) > 0.97
    site = {r.doc_id: r.path_posterior for r in got}
    own, mean = {r.doc_id: r.own for r in got}, np.mean([r.own for r in got])
    assert site[0] < site[1]
    # Two documents move a site away from the mean by less than they say themselves.
    assert own[901] + 0.1 < site[901] < mean
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).probability(np.zeros((1, len(quality.NAMES))))[0] == 0.5


def test_url_parts_and_rules(spark):
    urls = ["HTTPS://WWW.Example.com/en/a?q=/x", "http://example.com/en/", "http://a.net/fr/x#y", "https://b.org", None, "nothing", "://h?p", "x://É.NET/es/1://2", "https://notexample.com/en/x", "http://com/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    model = urlfilter.train([("good.org", "/a", 0), ("bad.org", "/spam", 1)] * 20)
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge(pages, model).collect()}
    assert [got[i][:3] for i in range(len(urls))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("a.net", "/fr/x", "net/fr/"), ("b.org", "", None), ("", "", None),
        ("", "", None), ("h", "", None), ("É.net", "/es/1://2", "net/es/"), ("notexample.com", "/en/x", "com/"), ("com", "/", "com/"),
    ]
    assert [got[i][3] for i in (0, 1, 2, 7, 8)] == ["allow", "block", "block", "block", "allow"] and all(v[3] in ("allow", "block") for v in got.values())
    assert model.block_probability("bad.org", "/spam") > 0.5 > model.block_probability("good.org", "/a")
    assert urlfilter.train([]).block_probability("a", "b") < 0.5 and urlfilter.judge(pages.limit(0), model).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_terms_beyond_longs_are_the_largest_long(spark):
    rows = topk.quantise(vectors(spark, [(20, [1e30], 0), (1, [5e29], 0), (2, [-1e30], 0)])).collect()
    assert {r.id: r.terms[0] for r in rows} == {20: 2**63 - 1, 1: 2**63 - 1, 2: -(2**63)}


def test_top_k_is_exhaustive(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (320, [], 0), (340, [0.5] * 9, 0), rows[7], rows[20], (None, [1.0] * 6, 0)]
    q = topk.quantise(vectors(spark, rows))
    got = topk.top_k(q.where("id % 20 = 0"), q, 20, query_block=5, candidate_block=40).collect()
    terms = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (i, x) in enumerate(terms):
        if i is not None and i % 20 == 0:
            ranked = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j is None, j or 0) for b, (j, y) in enumerate(terms) if b != a)[:20]
            want += [(i, n, None if missing else j, -s) for n, (s, missing, j) in enumerate(ranked, 1)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    twice = topk.quantise(vectors(spark, [(1, [1.0], 0), (1, [2.0], 0), (20, [1.0], 0)]))
    assert [r.score for r in topk.top_k(twice.where("id = 20"), twice).collect()] == [8192, 4096]
    few = q.where("id < 3")
    assert topk.top_k(few, few, 20).count() == 6 and topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_sparse_postings(spark):
    rng = np.random.default_rng(1)
    x = [(i, [float(v) if rng.random() < 0.1 else 0.0 for v in rng.random(30)], 0) for i in range(80)]
    q = topk.quantise(vectors(spark, x))
    got = {(r.query_id, r["rank"]): r.score for r in topk.top_k(q.where("id % 20 = 0"), q, 3).collect()}
    m = np.floor(64 * np.array([v for _, v, _ in x], dtype=np.float32).astype(float)).astype(int)
    for i in (0, 20, 40, 60):
        s = m @ m[i]
        s = np.delete(s, i)
        assert [got[i, k] for k in (1, 2, 3)] == sorted(s.tolist(), reverse=True)[:3]


def test_vector_links(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "CELL", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, v) for i, v in enumerate(base)]
    for i in range(150):  # a large group of near copies, some others, and copies
        near = base[0 if i < 90 else rng.integers(60)]
        rows.append((len(rows), near + 0.04 * rng.standard_normal(16) * (i % 5 > 0)))
    x = np.array([v for _, v in rows]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None]), (905, [2.0, 0.0]), (906, [1.0, 0.0])]
    data = [(i, [float(y) for y in v], 0) for i, v in rows] + [(i, v, 0) for i, v in odd] + [(None, [1.0] * 16, 0)]
    got = {r.vec_id: r for r in capfilters.near_duplicates(vectors(spark, data).withColumn("node", F.lit(1))).collect()}
    assert len(got) == len(rows) + len(odd) + 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904))
    assert got[905].n_links == got[906].n_links == 1 and got[906].component_id == 905 and not got[906].kept
    assert all(got[i].component_id <= i for i in got if i is not None)
    assert capfilters.near_duplicates(vectors(spark, [])).count() == 0


def test_sizes_and_ids_of_vectors(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [1e300, 1.01e300], 0), (3, [1e-300, 1e-300], 0), (4, [5e-324, 0.0], 0), (4, [3.0, 0.1], 0), (None, [2.0, 0.0], 0), (None, [-1.0, 0.0], 0), (9, [-1.0, 0.01], 0), (None, None, 0), (8, None, 0), (8, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(repr, map(tuple, capfilters.near_duplicates(df).collect())))
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (None, 1, 9, False), (9, 1, 9, True), (None, 0, None, True), (8, 0, 8, True), (8, 0, 8, True)]
    assert got == sorted(map(repr, want))


def test_filters_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for dim in (8, 64, 200):
        a = rng.standard_normal((1500, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z = rng.standard_normal(a.shape)
        z -= (z * a).sum(axis=1, keepdims=True) * a
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        both = set(zip(*map(np.ndarray.tolist, capfilters.filters_of(a, 3000)), strict=True)) & set(zip(*map(np.ndarray.tolist, capfilters.filters_of(b, 3000)), strict=True))
        assert len({row for row, _ in both}) >= 0.95 * len(a)


def test_archives_round_trip(spark, folder):
    big = "<p>ü" + "x" * 5000 + "\r\n\r\nWARC/1.1\r\n" + "é" * 3000
    html = ["a" * 200, "b" * 99, "a" * 200, "b" * 99, None, "", big, big, "c" * 100, "c" * 100]
    rows = [(i, None if i == 3 else f"http://h/ü {i}\r\nX: y", h, "k") for i, h in enumerate(html)]
    rows += [rows[0], rows[0], rows[1], (0, "http://other", "a" * 200, "k"), (1, None, "b" * 99, "k"), (None, "u", "a" * 200, "k"), (50, "u", "é" * 50, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string").repartition(3)
    warc.write(pages, folder + "/w", segment_bytes=700)
    got = warc.read(spark, folder + "/w").collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    first = {}
    for i, _, h, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want, seen = [], set()
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and i is not None and (first[h or ""] != i or i in seen)
        seen.add(i)
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first[h or ""] if again else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id is not None}
    assert texts[6] == big and texts[4] == texts[5] == ""
    import duckdb

    from tidemark.llm.queries import OP9_SQL

    con, frame = duckdb.connect(), pages.toArrow()
    con.register("pages", frame)
    theirs = con.execute(OP9_SQL).fetchall()
    assert sorted(map(repr, theirs)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    kinds = {r.kind for r in warc.read_records(spark, folder + "/w").collect()}
    assert kinds == {"response", "revisit", "continuation"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_segments_that_are_missing(spark, folder):
    records = warc.records_of(1, "u", b"x" * 3000, hashlib.sha256(b"x" * 3000).hexdigest(), None, 0, 3000, 500)
    os.makedirs(folder + "/w")
    with open(folder + "/w/a.warc.gz", "wb") as f:
        f.write(gzip.compress(b"".join(r + warc.END for i, r in enumerate(records) if i != 2)))
    row = warc.read(spark, folder + "/w").first()
    assert not row.complete and row.payload is None and row.page_id == 1
    with pytest.raises(ValueError):
        list(warc.parse(records[0]))


def test_chunked_framing():
    data = os.urandom(20_000)
    assert warc.unchunked(warc.chunked(data, 999)) == data and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc", b"zz\r\n", b"3\r\nabcXX0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before, columns = docs, docs.columns
    counts = []
    from tidemark.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DIR), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    toxic = {r.doc_id for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
    assert counts[0] < before.count() and counts[1] < counts[0] and counts[1] == counts[2] == counts[3]
    assert toxic
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, written(nothing, "nothing"), DIR).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == counts[3]
