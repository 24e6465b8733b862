"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import drop_written, fresh_path, written  # noqa: F401


#: A table of so many rows at most is broadcast.
SMALL = 20_000
#: A key is heavy if it holds more than one in so many rows; so there are fewer heavy keys than this.
HEAVY = 1000


def _same(left: DataFrame, right: DataFrame, on: list[str]):
    """(condition, right): null-safe equality on ``on``, with these columns of ``right`` renamed."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return same, right.withColumnsRenamed({c: f"_on_{c}" for c in on})


def join_each(rows: DataFrame, ones: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``ones``, which holds a key once at most; null keys are equal.

    Up to ``SMALL`` rows of ``ones`` are broadcast.  Beyond that the rows of heavy keys meet theirs by a broadcast of fewer
    than ``HEAVY`` rows, whatever their number, the others by a shuffle, in which no key has more than one in ``HEAVY``
    rows.  ``counts`` (on, n) says how many rows each key has, if that is known.
    """
    names = [f"_on_{c}" for c in on]
    same, renamed = _same(rows, ones, on)
    if ones.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(renamed), same).drop(*names)
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts.select(*on, "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    busy = counts.where(F.col("n") * HEAVY > total).select(*on).collect()
    if not busy:
        return rows.join(renamed, same).drop(*names)
    heavy = rows.sparkSession.createDataFrame(busy, counts.select(*on).schema)
    of_heavy, keys = _same(rows, heavy, on)
    few, few_keys = _same(ones, heavy, on)
    hot = ones.join(F.broadcast(few_keys), few, "left_semi").withColumnsRenamed(dict(zip(on, names, strict=True)))
    light = rows.join(F.broadcast(keys), of_heavy, "left_anti").join(renamed, same)
    return rows.join(F.broadcast(hot), same).drop(*names).unionByName(light.drop(*names))


def hashed_sample(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, those of smallest hash of ``by``: the same at every run.

    A cut-off from the row count leaves about twice as many, so that tasks hand on no more than that in all.
    """
    share = min(1.0, 2.0 * rows / max(df.count(), 1))
    low = F.shiftrightunsigned(F.xxhash64(*by), 32) <= int(share * 0xFFFFFFFF)
    return df.where(low).orderBy(F.shiftrightunsigned(F.xxhash64(*by), 32), *df.columns).limit(rows)


def sampled_labels(labels: DataFrame, value: str, rows: int) -> DataFrame:
    """(doc_id, label): at most ``rows`` labelled doc_ids, each once; of differing labels of one doc_id the larger counts."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(value).isin(0, 1))
    return hashed_sample(usable.groupBy("doc_id").agg(F.max(F.col(value).cast("int")).alias("label")), ["doc_id"], rows)


def labelled_texts(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """(label, text): the text of each sampled doc_id, the least of those of a repeated doc_id, so at most a row for each label."""
    found = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return written(found.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("label", "text"), "labelled")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    """Maximal runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def is_finite_vector(column):
    """True for an array without null, NaN or infinite components."""
    return F.coalesce(
        F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))),
        F.lit(False),
    )


def joined_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Labels of 0..n-1: the least index joined by the pairs, going on from ``labels``."""
    labels = np.arange(n) if labels is None else labels.copy()
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels
