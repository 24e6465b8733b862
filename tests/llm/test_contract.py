"""The registered queries on the smallest tables: columns, SQL, and who imports this subpackage."""

import os
import re
from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[2]
COLUMNS = {
    "op1_quality": {"doc_id", "score", "keep"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4_suffix_array": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op7_embedding_near_duplicates": {"vec_id", "n_links", "component_id", "kept"},
    "op8_top_k": {"query_id", "rank", "vec_id", "score"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10_mixing": {"doc_id", "slot", "place"},
    "op11_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op12_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op13_nearest_neighbours": {"query_id", "rank", "vec_id", "score"},
    "pipeline": {"doc_id", "sequence_id", "offset"},
}
ONE_A_ROW = {"op1_quality": "documents", "op2_toxicity": "documents", "op4_suffix_array": "documents", "op5_simhash": "documents", "op6_url_filter": "pages", "op7_embedding_near_duplicates": "embeddings", "op9_warc": "pages", "op10_mixing": "documents"}


def test_every_operator_is_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, DIR)
    assert COLUMNS[name] <= set(out.columns)
    rows = out.collect()
    if name in ONE_A_ROW:
        assert len(rows) == spark.read.parquet(f"{DIR}/{ONE_A_ROW[name]}.parquet").count()
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for table in ("documents", "embeddings", "pages", "labels", "conversations"):
            con.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
        cursor = con.execute(SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, cursor.fetchall()))


def test_nothing_else_imports_this_subpackage():
    for file in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"tidemark\.llm|from \.+llm", file.read_text()), file
