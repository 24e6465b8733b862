"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on shape features of the whole text gives each document a probability of being good.
Sums of these by host and by path below it give group means; a group's posterior is its mean shrunk towards its
parent's (path to host to all documents) by a prior strength that the spread between groups sets (method of
moments; for paths the spread is that around their own host's mean), so a site of few documents says little and a large one
speaks for itself.  A document's score adds its
path's posterior, as a shift in log odds against the whole, to its own evidence.

All group figures are sums, combined before the shuffle, over all documents; the only bounded sample is the
labelled rows of the fit (``SAMPLE_ROWS``, smallest hashes of doc_id).

Defined cases: null text is empty and has features like any; a null host or path is a group of its own; labels of
missing documents or other values than 0 and 1 are ignored, a doc_id with several counts once (the larger); without labels
of both classes the own evidence is near the one label (a half when there are none); repeated rows count each, and a doc_id that
repeats trains once, by its least text; a text of any length is one row of shape features; a score of exactly a half is kept; an empty
table gives no rows; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_each, labelled_texts, sampled_labels, written

SAMPLE_ROWS = 20_000
#: Bounds of a prior strength, in documents; weight of the site's shift.
STRENGTH = (1.0, 10_000.0)
SITE_WEIGHT = 0.5
NAMES = ("words", "word_length", "letters", "symbols", "digits", "upper", "different", "commonest", "lines", "repeated_lines", "line_words", "sentences")
WORD = re.compile(r"\S+")


def shape(text: str | None) -> list[float]:
    """Shape features of a whole text, in the order of ``NAMES``."""
    text = text or ""
    found = WORD.findall(text)
    n, size = max(len(found), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    counts = Counter(found)
    top = counts.most_common(1)[0][1] if counts else 0
    ends = sum(w[-1] in ".!?" for w in found)
    return [
        float(np.log1p(len(found))), sum(map(len, found)) / n, letters / size, (size - letters - digits - spaces) / n,
        digits / size, sum(map(str.isupper, text)) / n, len(counts) / n, top / n, float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))), ends / n,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(NAMES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(NAMES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * len(NAMES)))
    bias: float = 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standard scores, bounded, and their parts above and below one deviation: bends where junk begins."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shape(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("good").cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["good", "x"])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 300) -> QualityModel:
    """Fit on labelled rows (doc_id, quality), at most ``sample_rows``."""
    texts = labelled_texts(documents, sampled_labels(labels, "quality", sample_rows)).withColumnRenamed("label", "good")
    rows = texts.mapInArrow(_shapes, "good int, x array<double>").collect()
    rows = sorted((r.good, list(r.x)) for r in rows)
    y = np.array([r[0] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return QualityModel(bias=0.0 if not len(y) else (5.0 if y[0] else -5.0))
    x = np.array([r[1] for r in rows])
    model = QualityModel(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6))
    z = model.expand(x)
    w, b, squares, b_squares = np.zeros(z.shape[1]), 0.0, np.full(z.shape[1], 1e-10), 1e-10
    for _ in range(rounds):  # AdaGrad; einsum keeps to this thread, where a threaded library may hang in a driver that has forked
        error = (1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, w) + b, -30, 30))) - y) / len(y)
        slope = np.einsum("ij,i->j", z, error) + 0.1 / len(y) * w
        squares += slope**2
        w -= 0.3 * slope / np.sqrt(squares)
        b_squares += error.sum() ** 2
        b -= 0.3 * error.sum() / np.sqrt(b_squares)
    model.weights, model.bias = w, float(b)
    return model


def evidence(documents: DataFrame, model: QualityModel, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path and the document's own probability."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shape(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(model.probability(x))], ["doc_id", "host", "path", "own"])

    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    return named.mapInArrow(scored, "doc_id long, host string, path string, own double")


def _strength(groups: DataFrame, mean: float, parents: int) -> float:
    """The prior's weight in documents: binomial spread over the spread of groups around their parents that is left after sampling.

    ``groups`` has n, total, squares and the ``centre`` of the parent; there are ``parents`` of these.
    """
    r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("centre"), 2)).alias("between"), F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("within")).first()
    if not r.g or r.g <= parents or r.n <= r.g:
        return STRENGTH[1]
    within = max(r.within / (r.n - r.g), 1e-12)
    spread = (r.between - within * (r.g - parents)) / r.n
    return float(min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1])) if spread > 1e-12 else STRENGTH[1]


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, host_posterior, path_posterior) of every path, and the global mean."""
    sums = [F.count("*").alias("n"), F.sum("own").alias("total"), F.sum(F.col("own") * F.col("own")).alias("squares")]
    paths = written(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.count("*").alias("paths")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("hosts")).first()
    mean = min(max(whole.total / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    of_hosts = _strength(hosts.withColumn("centre", F.lit(mean)), mean, 1)
    shrunk = hosts.select("host", (F.col("total") / F.col("n")).alias("centre"), ((F.col("total") + of_hosts * mean) / (F.col("n") + of_hosts)).alias("host_posterior"))
    both = written(join_each(paths, shrunk, ["host"], hosts.select("host", F.col("paths").alias("n"))), "both")
    of_paths = _strength(both, mean, whole.hosts)
    path = (F.col("total") + of_paths * F.col("host_posterior")) / (F.col("n") + of_paths)
    return both.select("host", "path", "n", "host_posterior", path.alias("path_posterior")), mean


def score(documents: DataFrame, model: QualityModel, host: str = "source", path: str = "lang", site_weight: float = SITE_WEIGHT) -> DataFrame:
    """doc_id, own, host_posterior, path_posterior, score and keep (score >= 0.5) of every document."""
    scored = written(evidence(documents, model, host, path), "evidence")
    groups, mean = posteriors(scored)
    odds = lambda p: F.log(p / (1 - p))
    bounded = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    joined = join_each(scored, groups.drop("n"), ["host", "path"], groups)
    z = odds(bounded(F.col("own"))) + site_weight * (odds(bounded(F.col("path_posterior"))) - float(np.log(mean / (1 - mean))))
    return joined.select("doc_id", "own", "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("score")).withColumn("keep", (F.col("score") >= 0.5).cast("int"))
