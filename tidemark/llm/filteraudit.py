"""Audit of how text filters act on one another, by a Gray-code walk over their subsets.

Every document gets a mask, one bit for each filter that it fails.  Equal masks of a part (a value of ``source``) are
one cell with its number of documents, good and toxic ones: a part is 32 cells for five filters, whatever it holds.
The walk goes over all subsets of filters so that each differs from the one before by one filter.  A cell counts how many active
filters it fails; as one is toggled, only the cells that fail it change their counter, and those whose counter leaves or
reaches zero leave or join the running survivors.  The survivors of each subset are kept, and what a filter removes
at any place of any order is the difference of two of them.

Spark marks, counts and groups; the walk is one array operation over many parts at once.  Texts are read once and never shuffled.

Defined cases: a null text is empty, a null source the empty string (and so of one part with it); a doc_id that is null has no
labels, is no duplicate and makes none; of rows that share doc_id and text none is the other's duplicate; several labels of
a doc_id count as the largest; labels without a document count nowhere; a part whose documents all pass has its rows like
any; an empty table gives no rows; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_each, words, written

#: Failure conditions on a row with columns ``text`` (never null) and ``words`` (its words, in order).
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("words") < 200,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
    "C": lambda: 100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long"),
    "D": lambda: F.col("text").rlike(r"[#$%&*|]"),
}
#: The letter of the filter that duplicates fail.
DUPLICATE = "E"
#: What is counted of each cell: documents, good ones, toxic ones.
COUNTS = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts that are walked at once.
PARTS = 64


def marked(documents: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """(part, doc_id, digest, mask) of each row: bit i for the i-th of ``filters``, without duplicates."""
    rows = documents.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails(), 1 << i).otherwise(0)
    return rows.withColumn("words", words(F.col("text"))).select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS) -> DataFrame:
    """(part, mask, n, good, toxic), duplicates being the bit after those of ``filters``.

    Rows alike are counted before anything meets: copies of a text in one part are a few rows, however many they are.
    """
    rows = marked(documents, filters).groupBy("part", "digest", "mask", "doc_id").agg(F.count("*").alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(told.where("good OR toxic"), "doc_id", "left").na.fill(False, ["good", "toxic"])
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    alike = rows.groupBy("part", "digest", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("first"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("of_first")
    )
    alike = written(alike, "alike")
    sizes = written(alike.groupBy("digest").agg(F.min("first").alias("lowest"), F.count("*").alias("n")), "lowest")
    alike = join_each(alike, sizes.drop("n"), ["digest"], sizes)
    original = F.col("nameless") + F.when(F.col("first") == F.col("lowest"), F.col("of_first")).otherwise(0)
    copy = 1 << len(filters)
    both = F.array(F.struct(F.col("mask"), original.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - original).alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(both).alias("cell")).select("part", "good", "toxic", "cell.mask", "cell.n")
    of = lambda kind: F.sum(F.when(F.col(kind), F.col("n")).otherwise(0)).alias(kind)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """``counts`` [part, mask, kind] of cells to what remains [part, subset, kind] under every subset of filters."""
    size = counts.shape[1]
    masks = np.arange(size)
    failing = np.zeros(size, dtype=np.int64)
    running = counts.sum(axis=1)
    states = np.empty_like(counts)
    states[:, 0] = running
    subset = 0
    for step in range(1, size):
        bit = step & -step
        subset ^= bit
        hit = (masks & bit) > 0
        if subset & bit:
            running = running - counts[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[:, hit & (failing == 0)].sum(axis=1)
        states[:, subset] = running
    return states


def steps(counts: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Columns [part, order, step] of all orders of ``letters``: differences of the survivors' states."""
    states = survivors(counts)
    orders = np.array(list(permutations(range(len(letters)))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    lost = states[:, after - bits] - states[:, after]
    masks = np.arange(counts.shape[1])
    fails = np.stack([counts[:, (masks >> f) & 1 == 1, 0].sum(axis=1) for f in range(len(letters))], axis=1)
    shapley = np.stack([lost[:, orders == f, 0].sum(axis=1) for f in range(len(letters))], axis=1)
    return {
        "kept": states[:, after, 0],
        "removed": lost[..., 0],
        "redundant": fails[:, orders] - lost[..., 0],
        "unique_fails": counts[:, bits, 0],
        "good_lost": lost[..., 1],
        "toxic_lost": lost[..., 2],
        "shapley": shapley[:, orders],
    }


def _walk(letters: str):
    names = np.array(["".join(o) for o in permutations(letters)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                lists = batch.column("cells")
                cell = lists.flatten()
                part = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                counts = np.zeros((batch.num_rows, 1 << len(letters), len(COUNTS)), dtype=np.int64)
                for k, kind in enumerate(COUNTS):
                    counts[part, cell.field("mask").to_numpy(), k] = cell.field(kind).to_numpy()
                found = steps(counts, letters)
                each = len(names) * len(letters)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), each))),
                        pa.array(np.tile(np.repeat(names, len(letters)), batch.num_rows)),
                        pa.array(np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(names) * batch.num_rows)),
                        *(pa.array(x.reshape(-1)) for x in found.values()),
                    ],
                    ["part", "filter_order", "step", *found],
                )

    return walk


def audit(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[], Column]] = FILTERS, duplicate: str = DUPLICATE) -> DataFrame:
    """What each filter keeps and removes at each step of each order, for every part."""
    letters = "".join(filters) + duplicate
    of_parts = cells(documents, labels, filters).groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return of_parts.mapInArrow(_walk(letters), RESULT)
