"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; every result is written as Parquet in the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns of ``docs``.

Defined cases, of every stage: an empty table gives an empty one; null and empty texts, null doc_ids and rows that repeat are
rows like any; ties and very long texts are settled as each operator says; columns of ``docs`` of whatever names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, simhash, suffixes, toxicity
from tidemark.llm.common import table, written
from tidemark.llm.queries import held_out

#: SQL can express neither the classifier nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model fitted on the labelled rows of the corpus.

    A null or empty text scores as one without known words and so stays; repeated rows go or stay together.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels)
    return toxicity.without_toxic(docs, model)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, one of repeated rows.

    Null and empty texts are one group; rows without a doc_id stay only where their group has none.
    """
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the passages that also stand elsewhere; null and short texts stay as they are."""
    return suffixes.without_repeats(docs)


def in_mixed_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix of sources; a null source is one of its own."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences in the order of the mix, which is that of the files' names and rows.

    A null text is the closing id alone; a very long one is several whole sequences and a rest.
    """
    return packing.pack(docs, in_order=True)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", one_of_near_duplicates),
    ("suffix_array", without_repeats),
    ("mixing", in_mixed_order),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
