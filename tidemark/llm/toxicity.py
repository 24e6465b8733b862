"""Toxicity: a counterfactual-regularised classifier.

A logistic regression on word and word-beginning features.  Each sentence of a labelled text that mentions an identity
group yields a counterfactual, the same sentence with its identity terms swapped for those of the opposite
or next group; the loss adds ``penalty * (score change in logits) ** 2``, averaged over a text's different changes, so a
neutral mention of a group moves a score no more than a mention of another group does.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, the smallest hashes of doc_id,
so the sample is the same at every run); scoring covers every whole text and is a pure map: no shuffle.
Inputs of a score are words of the text only.

Defined cases: null text is empty and scores the model's bias, like any text without known features; labels
whose document or value is missing are ignored, a doc_id with several labels counts once (the larger); without labels of both
classes every score is near the one label (0 when there are none); repeated rows are scored each and alike, and a doc_id that
repeats trains once, by its least text; ties in the sample, of features of equal chi-square, are in the order of their
doc_ids and names; a text of any length is one set of words; empty tables of documents or labels give no rows or the model of no
labels; extra columns, of whatever names, are kept out of the model and kept with the rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import labelled_texts, sampled_labels

#: Labelled rows the model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Features the model keeps, by their chi-square on the sample.
KEPT_FEATURES = 4096
#: A feature must occur in so many sampled texts, and have this chi-square (one in a thousand by chance) at least.
LEAST_TEXTS = 3
LEAST_CHI_SQUARE = 10.83
THRESHOLD = 0.3
PENALTY = 1.0

#: Groups of identity terms: a term is swapped for the one at the same place in the next list of its row.
IDENTITY_GROUPS = (
    (("women", "woman", "female", "girls"), ("men", "man", "male", "boys")),
    (("muslim", "muslims"), ("christian", "christians"), ("jewish", "jews"), ("hindu", "hindus"), ("buddhist", "buddhists"), ("atheist", "atheists")),
    (("black",), ("white",), ("asian",), ("latino",)),
    (("gay", "homosexual"), ("straight", "heterosexual")),
    (("immigrant", "immigrants", "foreigners"), ("citizen", "citizens", "locals")),
    (("old", "elderly"), ("young", "youthful")),
    (("frauen", "frau"), ("männer", "mann")),
    (("femmes", "femme"), ("hommes", "homme")),
    (("mujeres", "mujer"), ("hombres", "hombre")),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Words whose features a worker keeps at hand.
KEPT_WORDS = 500_000
STARTS = (3, 4, 5, 6)


def swap_table(groups=IDENTITY_GROUPS) -> dict[str, str]:
    swaps = {}
    for row in groups:
        for own, other in zip(row, row[1:] + row[:1], strict=True):
            for i, term in enumerate(own):
                swaps.setdefault(term, other[min(i, len(other) - 1)])
    return swaps


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(found: set[str]) -> set[str]:
    """Whole words, and the beginnings of longer ones (they carry over to inflected forms not seen before)."""
    out = {w + "$" for w in found}
    for n in STARTS:
        out.update(w[:n] for w in found if len(w) > n)
    return out


@dataclass
class ToxicityModel:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0

    def __post_init__(self):
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return (self.index, self.weights, self.bias)

    def __setstate__(self, state):
        self.index, self.weights, self.bias = state
        self._known = {}

    def active(self, found: set[str]) -> list[int]:
        """The features of a set of words; a word's own are looked up once."""
        known, get, out = self._known, self.index.get, set()
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in found:
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(i for f in features_of({w}) if (i := get(f)) is not None)
            if own:
                out.update(own)
        return sorted(out)

    def changes(self, text: str, swaps: dict[str, str]) -> list[list[int]]:
        """The different changes that swapping a sentence's identity terms makes: features lost (as -1 - i) and gained."""
        out = set()
        for sentence in SENTENCE.split(text):
            found = words(sentence)
            if not found.isdisjoint(swaps):
                own, other = set(self.active(found)), set(self.active({swaps.get(w, w) for w in found}))
                if own != other:
                    out.add((*sorted(-1 - i for i in own - other), *sorted(other - own)))
        return [list(c) for c in sorted(out)]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.active(words(text))].sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _descend(rows: list[tuple[int, list[int], list[list[int]]]], n: int, penalty: float, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + penalty * mean squared counterfactual change + (l2 / rows) * weights, by AdaGrad over full batches."""
    y = np.array([r[0] for r in rows], dtype=float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.fromiter((i for r in rows for i in r[1]), dtype=np.int64)
    swapped = [(c, 1.0 / len(r[2])) for r in rows for c in r[2]]
    c_row = np.repeat(np.arange(len(swapped)), [len(c) for c, _ in swapped])
    c_all = np.fromiter((i for c, _ in swapped for i in c), dtype=np.int64)
    c_sign, c_col = np.where(c_all < 0, -1.0, 1.0), np.where(c_all < 0, -1 - c_all, c_all)
    c_weight = np.array([w for _, w in swapped]) / len(y)
    prior = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    squares, b_squares = np.full(n, 1e-10), 1e-10
    for k in range(rounds):
        z = b + np.bincount(row, w[column], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.bincount(column, error[row], minlength=n) + l2 / len(y) * w
        if len(c_row):
            moved = np.bincount(c_row, c_sign * w[c_col], minlength=len(swapped)) * c_weight
            slope += 2 * penalty * np.bincount(c_col, c_sign * moved[c_row], minlength=n)
        squares += slope**2
        w -= 0.3 * slope / np.sqrt(squares)
        b_squares += error.sum() ** 2
        b -= 0.3 * error.sum() / np.sqrt(b_squares)
    return w, b


def fit(
    documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, kept: int = KEPT_FEATURES, penalty: float = PENALTY,
    groups=IDENTITY_GROUPS, l2: float = 0.1, rounds: int = 150,
) -> ToxicityModel:
    """Fit on labelled rows (doc_id, toxic). Feature counts and active features are found by the executors."""
    texts = labelled_texts(documents, sampled_labels(labels, "toxic", sample_rows)).withColumnRenamed("label", "toxic")
    swaps = swap_table(groups)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        rows = [0, 0]

        def flush():
            for label in (0, 1):
                names = list(seen[label])
                yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([label] * len(names), pa.int32()), "n": pa.array(list(seen[label].values()), pa.int64())})
                seen[label].clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[label].update(features_of(words(text)))
                rows[label] += 1
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_pydict({"feature": ["", ""], "toxic": pa.array([0, 1], pa.int32()), "n": pa.array(rows, pa.int64())})

    counted = texts.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg")
    )
    total = F.first(F.when(F.col("feature") == "", F.struct("pos", "neg")), ignorenulls=True)
    counted = counted.where((F.col("pos") + F.col("neg") >= LEAST_TEXTS) | (F.col("feature") == ""))
    n_pos, n_neg = (counted.agg(total.alias("t")).select("t.pos", "t.neg").first() or (0, 0))[:2]
    n_pos, n_neg = n_pos or 0, n_neg or 0
    if not n_pos or not n_neg:
        return ToxicityModel(bias=20.0 if n_pos else -20.0)
    a, b, n = F.col("pos").cast("double"), F.col("neg").cast("double"), float(n_pos + n_neg)
    chi = n * F.pow(a * (n_neg - b) - b * (n_pos - a), 2) / F.greatest((a + b) * (n - a - b) * n_pos * n_neg, F.lit(1e-9))
    best = counted.where((F.col("feature") != "") & (chi >= LEAST_CHI_SQUARE)).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(kept)
    index = {r.feature: i for i, r in enumerate(best.collect())}
    model = ToxicityModel(index, np.zeros(len(index)))

    def activate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own, changed = [model.active(words(t)) for t in texts], [model.changes(t, swaps) for t in texts]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int32()), "own": pa.array(own, kind), "changed": pa.array(changed, pa.list_(kind))})

    rows = texts.mapInArrow(activate, "toxic int, own array<int>, changed array<array<int>>").collect()
    # The sum of the slopes depends on the order of the rows in the last digits only; sorted, it doesn't at all.
    rows = sorted((r.toxic, list(r.own), [list(c) for c in r.changed]) for r in rows)
    model.weights, model.bias = _descend(rows, len(index), penalty, l2, rounds)
    return model


def score(documents: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """``documents`` with a column of scores between 0 and 1 for each whole text."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return documents.withColumn(column, scored(F.col("text")))


def without_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with their own columns."""
    name = "_toxicity"
    while name in documents.columns:
        name += "_"
    return score(documents, model, name).where(F.col(name) < threshold).drop(name)
