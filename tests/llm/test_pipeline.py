"""Each stage of the pipeline against brute force on its own input: nulls, repeats, long texts, clashing columns."""

import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_text import with_extra
from tidemark.llm import mixing, packing, toxicity
from tidemark.llm.common import written
from tidemark.llm.queries import held_out

MORE = ["score", "_toxicity", "component_id", "_slot", "stretch", "label", "features", "id"]


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    """The odd corpus with toxic documents, labels that tell them, shared passages, and columns of the stages' own names."""
    rng = random.Random(9)
    rows = list(corpus)
    passage = words(rng, 90)
    for i in range(200, 290):
        text = words(rng, rng.randint(20, 60))
        if i % 3 == 0:
            text += " vile scum " + rng.choice(["filthy", "worthless"]) + " vermin " * 2 + words(rng, 20)
        elif i % 7 == 0:
            text += " " + passage + " " + words(rng, 15)
        rows.append((i, text, "en", "hot" if i % 2 else f"s{i % 5}", len(text)))
    folder = str(tmp_path_factory.mktemp("spark-sf"))
    docs = with_extra(spark.createDataFrame(rows, SCHEMA))
    for c in MORE:
        docs = docs.withColumn(c, F.lit(1))
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(200, 290)] + [(i, 1, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) of each stage."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), f"test-{name}")
        found[name] = (docs, out)
        docs = out
    return found


def key(r, *columns):
    return tuple(str(r[c]) for c in columns)


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def test_columns_stay(stages):
    for name, (docs, out) in stages.items():
        assert name == "packing" or out.schema == docs.schema, name


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    docs, out = stages["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    want = Counter(key(r, *OWN) for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD)
    assert Counter(key(r, *OWN) for r in out.collect()) == want
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()}
    assert len(gone & {i for i in range(200, 290) if i % 3 == 0}) >= 25 and not gone - {i for i in range(200, 290) if i % 3 == 0}


def fingerprint(text):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_one_document_of_each_group_stays(stages):
    docs, out = (x.collect() for x in stages["simhash"])
    marks = [fingerprint(r.text) for r in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(docs):
        groups.setdefault(find(i), []).append(r)
    left = Counter(key(r, *OWN) for r in out)
    for rows in groups.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        kept = [k for k in {key(r, *OWN) for r in rows if r.doc_id == (min(ids) if ids else None)} if left[k]]
        assert len(kept) == 1 and left.pop(kept[0]) == 1
    assert not left


def test_repeated_passages_go(stages):
    docs, out = (x.collect() for x in stages["suffix_array"])
    seen = Counter(t[i : i + 200] for t in ((r.text or "").encode() for r in docs) for i in range(len(t) - 199))
    want = Counter()
    for r in docs:
        t = (r.text or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        text = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "replace") if any(gone) else r.text
        want[(str(r.doc_id), str(text), str(r.lang), str(r.source), str(len(text) if any(gone) else r.n_chars))] += 1
    assert Counter(key(r, *OWN) for r in out) == want
    assert sum(len(r.text or "") for r in out) < sum(len(r.text or "") for r in docs) - 200


def test_sources_alternate_by_weight(stages):
    docs, out = stages["mixing"]
    assert Counter(key(r, *OWN) for r in out.collect()) == Counter(key(r, *OWN) for r in docs.collect())
    order = out.select("source", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).orderBy("file_name", "file_block_start", "at").collect()
    n = Counter(r.source for r in order)
    blocks = {s: -(-k // mixing.BLOCK_ROWS) for s, k in n.items()}
    weight = {s: k**mixing.SMOOTHING for s, k in n.items()}
    runs, t = [], 0
    while t < len(order):  # blocks of one source, the last one of a source shorter
        s = order[t].source
        taken = sum(1 for r in runs if r == s)
        size = min(mixing.BLOCK_ROWS, n[s] - taken * mixing.BLOCK_ROWS)
        assert all(r.source == s for r in order[t : t + size])
        runs.append(s)
        t += size
    seen, total = Counter(), sum(weight.values())
    for slot, s in enumerate(runs, 1):
        seen[s] += 1
        if any(seen[x] == blocks[x] for x in n):
            break
        assert all(abs(weight[x] / total * slot - seen[x]) < 1 + 1e-9 for x in n)


def test_every_id_is_packed_once(stages):
    from tokenizers import Tokenizer

    docs, out = (x.collect() for x in stages["packing"])
    own = Tokenizer.from_file(packing.default_paths()[0])
    ids = {str(r.doc_id): [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    named = [r for r in out if r.doc_id is not None]
    pieces = {}
    for r in named:
        part = ids[str(r.doc_id)][r.start : r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32 and r.doc_tokens == len(ids[str(r.doc_id)])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {r.doc_id: len(ids[str(r.doc_id)]) for r in docs if r.doc_id is not None}
    ends = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024
