"""Samples and representatives on tables with many copies."""

import random

from pyspark.sql import functions as F

from tidemark.llm import simhash, urlfilter

from tests.llm.conftest import SCHEMA, words


def test_few_urls_with_many_copies_are_all_labelled(spark):
    def pages(copies):
        block, at = F.col("id") % 2 == 0, F.col("id") % 60
        url = F.when(block, F.concat(F.lit("http://h.net/es/"), at)).otherwise(F.concat(F.lit("http://h.com/"), at))
        return spark.range(60 * copies).select(F.col("id").alias("page_id"), url.alias("url"))

    few, many = urlfilter.labelled_by_rules(pages(1)), urlfilter.labelled_by_rules(pages(2000))
    assert len(set(few)) == len(few) == 60 and many == few
    assert len(urlfilter.labelled_by_rules(pages(2000), rows=7)) == 14


def test_unrelated_classes_under_one_doc_id_both_stay(spark):
    rng = random.Random(8)
    texts = [words(rng, 120, "abcdefghij"), words(rng, 120, "klmnopqrst")]
    rows = []
    for k, text in enumerate(texts):
        rows += [(5, text, "en", "s", 1), (10 + k, text.upper(), "en", "s", 1), (20 + k, text, "en", "s", 1)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((5, t) for t in texts)
