"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for the rest.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and gets the
model's verdict on empty strings; repeated rows are judged each and alike, and their url is one row of the labelled table; a
probability of exactly a half blocks; of rules that are as long as each other the first by name counts; a url of any length is
one row of n-grams; an empty table gives no rows; extra columns are ignored; a labelled table that is empty or of one class gives
a model that answers with that class (allow when empty).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, hashed_sample, written

#: (host, path, verdict), the default rule table.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 15
#: Rows of each verdict in the labelled table that the model is trained on.
LABELLED_ROWS = 2000


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` (after the first ://, lower-cased A-Z) and ``path`` (up to ? or #)."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null when none does. The rule table is a short list."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ranked]
    nothing = F.lit(None).cast("string")
    name = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, ranked, strict=True)], nothing)
    verdict = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, ranked, strict=True)], nothing)
    return name, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of host and path, kept apart by a tag."""
    found = set()
    for tag, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in NGRAMS:
            found.update(zlib.crc32((tag + text[i : i + n]).encode("utf-8", "replace")) % BUCKETS for i in range(max(1, len(text) - n + 1)))
    return np.fromiter(sorted(found), dtype=np.int64)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def block_probability(self, host: str, path: str) -> float:
        x = features(host, path)
        z = self.bias + float(self.weights[x].sum()) / np.sqrt(len(x))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: list[tuple[str, str, int]], epochs: int = 60, rate: float = 2.0, l2: float = 1e-5) -> UrlModel:
    """Full-batch gradient descent on a small table of (host, path, 1 for block)."""
    weights = np.zeros(BUCKETS)
    y = np.array([r[2] for r in labelled], dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return UrlModel(weights, 5.0 if len(y) and y[0] == 1 else -5.0)
    rows = [features(h, p) for h, p, _ in labelled]
    columns, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    value = np.repeat(1 / np.sqrt(sizes), sizes)
    bias, squares, bias_squares = 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):  # AdaGrad
        z = bias + np.bincount(row, value * weights[columns], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.bincount(columns, value * error[row], minlength=BUCKETS) + l2 * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares) * 0.1
        bias_squares += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_squares) * 0.1
    return UrlModel(weights.astype(np.float32), float(bias))


def labelled_by_rules(pages: DataFrame, rules=RULES, rows: int = LABELLED_ROWS) -> list[tuple[str, str, int]]:
    """A small labelled url table: of each verdict the ``rows`` urls of smallest hash that a rule decides.

    Copies of a url count once, so the table does not depend on how often the urls occur.
    """
    parts = with_parts(pages)
    _, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    decided = written(parts.select("host", "path", verdict.alias("verdict")).where(F.col("verdict").isNotNull()).distinct(), "urls")
    picked = []
    for value, label in (("allow", 0), ("block", 1)):
        own = decided.where(F.col("verdict") == value).select("host", "path")
        for r in hashed_sample(own, ["host", "path"], rows).collect():
            picked.append((r.host, r.path, label))
    return picked


def judge(pages: DataFrame, model: UrlModel, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict): the longest fitting rule decides, else the model."""
    parts = with_parts(pages.select(id_col, "url"))
    rule, by_rule = matching_rule(F.col("host"), F.col("path"), rules)

    @F.pandas_udf("string")
    def by_model(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in batches:
            yield pd.Series([None if h is None else "block" if model.block_probability(h, p or "") >= 0.5 else "allow" for h, p in zip(host, path, strict=True)], dtype=object)

    decided = parts.withColumn("rule", rule).withColumn("by_rule", by_rule)
    unknown = F.when(F.col("by_rule").isNull(), F.col("host"))
    guess = by_model(unknown, F.col("path"))
    return decided.select(id_col, "host", "path", "rule", F.coalesce("by_rule", guess).alias("verdict"))
