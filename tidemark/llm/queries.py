"""The registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import annscan, capfilters, filteraudit, mixing, packing, prefixtrie, quality, simhash, suffixes, topk, toxicity, urlfilter, warc
from tidemark.llm.common import table

#: Labels of doc_ids with this crc32 remainder (mod 4) are held out of training.
HELD_OUT = 2


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(documents, model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(documents, labels)
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = urlfilter.train(urlfilter.labelled_by_rules(pages))
    return urlfilter.judge(pages, model)


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and place of every document in a mix by square-root smoothed weights."""
    placed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    return placed.select("doc_id", "source", F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations")).drop("token")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annscan.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest, n) AS first,
         row_number() OVER (PARTITION BY digest, n ORDER BY page_id NULLS LAST) AS place FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS NOT NULL AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS NOT NULL AND place > 1 THEN first END AS refers_to
FROM f
"""

OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.t, c.t) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.i <> c.i
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
) WHERE rank <= 20
"""

OP11_SQL = """
WITH ids AS (
  SELECT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM ids
), t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT conv_id, token, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) - 1 AS pos FROM t
), r AS (
  SELECT h.conv_id, 0 AS own, pos, token, words FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND pos < h
  UNION ALL SELECT conv_id, 1, pos, token, words FROM o JOIN h USING (conv_id) WHERE pos >= h
), s AS (
  SELECT h.conv_id, coalesce(list(token ORDER BY own, pos) FILTER (token IS NOT NULL), []) AS seq, list(words ORDER BY own, pos) AS words
  FROM h LEFT JOIN r USING (conv_id) GROUP BY h.conv_id
), p AS (
  SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq, words FROM s
), n AS (
  SELECT depth, seq[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(seq) = depth), '') AS ends
  FROM p GROUP BY 1, 2
), c AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix)
), a AS (
  SELECT unnest(range(depth + 1)) AS top, prefix, n_convs, words, n_children FROM m
), u AS (
  SELECT prefix[1:top] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM a GROUP BY 1
)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN u USING (prefix) LEFT JOIN m q ON m.depth > 0 AND q.prefix = m.prefix[1:m.depth - 1]
"""

OP12_SQL = """
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d
), m AS (
  SELECT part, doc_id,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > lowest, false) AS INT) AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM orders, range(1, 6) AS r(step)
), told AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM steps, cells GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_suffix_array": op4_suffix_array,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_embedding_near_duplicates": op7_embedding_near_duplicates,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_nearest_neighbours": op13_nearest_neighbours,
    "pipeline": pipeline,
}
SQL = {"op8_top_k": OP8_SQL, "op9_warc": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_audit": OP12_SQL}
