"""Packing in the order of the mix, after it was written and read again."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import packing


def test_sequences_follow_the_files_in_order(spark, folder):
    # Later files are larger, so a scan takes them first.
    text = F.array_join(F.transform(F.sequence(F.lit(0), (20 + F.pmod(F.xxhash64("id"), F.lit(200)) + F.col("id") / 4).cast("int")), lambda x: F.concat(F.lit("w"), x)), " ")
    docs = spark.range(800).repartitionByRange(6, "id").sortWithinPartitions("id").select(F.col("id").alias("doc_id"), text.alias("text"))
    docs.write.parquet(folder + "/mix")
    read = spark.read.parquet(folder + "/mix")
    assert len(read.inputFiles()) > 3
    rows = corpus_pipeline.packed(spark, read, "").collect()
    assert rows[0].__fields__ == packing.PACKED.replace(" long", "").split(", ")
    first = {}
    for r in rows:
        first[r.sequence_id] = min(r.doc_id, first.get(r.sequence_id, r.doc_id))
    assert sorted(first) == list(range(len(first)))
    assert [first[k] for k in range(len(first))] == sorted(first.values()) and len(set(first.values())) > 50
    plain = packing.pack(read).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in plain) and len(first) == len({r.sequence_id for r in plain})
