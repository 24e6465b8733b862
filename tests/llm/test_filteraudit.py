"""The filter audit against filters applied one after the other in every order."""

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import filteraudit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        f
        for f, yes in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
        )
        if yes
    }


def plain(docs, labels):
    lowest = {}
    for d, t, _ in docs:
        if d is not None:
            lowest[t or ""] = min(lowest.get(t or "", d), d)
    parts = {}
    for d, t, s in docs:
        bad = fails(t or "") | ({"E"} if d is not None and d > lowest[t or ""] else set())
        told = labels.get(d, (0, 0)) if d is not None else (0, 0)
        parts.setdefault(s or "", []).append((bad, told))
    out = {}
    for part, rows in parts.items():
        whole = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                whole[f] += len(gone)
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1][0] for r in gone), sum(r[1][1] for r in gone),
                )
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (whole[f],)
    return out


def check(spark, docs, labels):
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, mask int, words string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    best = {}
    for d, q, t in labels:
        was = best.get(d, (0, 0))
        best[d] = (max(was[0], int(q == 1)), max(was[1], int(t == 1)))
    got = {(r.part, r.filter_order, r.step): (*(r[f] for f in FIELDS), r.shapley) for r in filteraudit.audit(frame, marks).collect()}
    assert got == plain(docs, best)


def test_every_order_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [words(rng, n) for n in (5, 150, 199, 200, 201, 400)] + ["word " * 300, "Word " * 300, "x" * 100_000, "ÄÖ " * 250, "A\x1cB", "\x0b\x0c\r\n\t ", "", None, "p%q " + words(rng, 250), "a b\tc " * 90]
    docs = [(i, rng.choice(texts), rng.choice(["hot", "hot", "hot", "s1", "", None, "é"])) for i in range(150)]
    docs += [docs[3], docs[3], docs[7], (None, texts[2], "hot"), (None, None, None), (-5, texts[4], "s1"), (900, texts[4], "s1"), (900, texts[5], "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None, 2])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    check(spark, docs, labels)


def test_copies_hold_most_rows(spark):
    text = "same words here " * 100
    docs = [(i, text if i % 3 else f"{text}{i}", f"s{i % 40}") for i in range(900)] + [(1, text, "s1")] * 300
    check(spark, docs, [(i, 1, 0) for i in range(0, 900, 7)])


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out = filteraudit.audit(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert out.collect() == [] and out.schema.simpleString() == "struct<" + filteraudit.RESULT.replace(" long", ":bigint").replace(" string", ":string").replace(" int", ":int").replace(", ", ",") + ">"


def test_states_of_every_subset():
    counts = np.random.default_rng(1).integers(0, 9, size=(3, 64, 2))
    states = filteraudit.survivors(counts)
    for subset in range(64):
        assert (states[:, subset] == counts[:, [m for m in range(64) if not m & subset]].sum(axis=1)).all()
