"""Packing, repeats, fingerprints and mixing against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import components, mixing, packing, simhash, suffixes
from tidemark.llm.common import joined_labels

EXTRA = ["part", "key", "fp", "spans", "_spans", "_text_key", "_row", "_hash", "_source", "_bucket", "_id", "_rows", "rank", "node"]


def with_extra(df):
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df


def expected_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1].tolist(), strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("crowded", "heavy"), [(suffixes.CROWDED, 100), (suffixes.CROWDED, 1), (2, 1)])
def test_repeats_are_those_of_brute_force(documents, corpus, monkeypatch, crowded, heavy):
    find = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda d, n=suffixes.LENGTH: find(d, n, crowded=crowded, heavy=heavy))
    got = suffixes.digest(with_extra(documents)).collect()
    want = expected_repeats([(t or "").encode() for _, t, *_ in corpus], 200)
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted((str(d[0]), *w) for d, w in zip(corpus, want, strict=True))


def test_one_anchor_in_many_contexts(spark):
    """A common line among unlike ones: longer anchors part its runs, and the same windows are found."""
    rng = random.Random(11)
    line = words(rng, 12) + " all rights reserved by the publishers of this page and of all others "
    sides = [words(rng, 60) for _ in range(9)]
    texts = [rng.choice(sides)[-rng.randint(20, 180) :] + line + rng.choice(sides)[: rng.randint(20, 180)] for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: w[1:] for i, w in enumerate(expected_repeats([t.encode() for t in texts], 200))}
    for heavy in (10, 10_000):
        found = {r.doc_id: [{"start": s.start, "stop": s.stop} for s in r.spans] for r in suffixes.repeats(docs, heavy=heavy).collect()}
        for i, t in enumerate(texts):
            kept, removed, n = suffixes._cut(t.encode(), found.get(i))
            assert (removed, n, hashlib.sha256(kept).hexdigest()) == want[i]


def test_repeats_in_random_strings(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    monkeypatch.setattr(suffixes, "BUFFER", 50)
    monkeypatch.setattr(suffixes, "BATCH", 9)
    monkeypatch.setattr(suffixes, "SPREAD", 13)
    monkeypatch.setattr(suffixes, "_ROLLING", {})
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 90))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["ab" * 2000, "a" * 100]
    data = [t.encode() for t in texts]
    # The steps of the operator, without Spark, on small chunks.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text_key": pa.array(range(len(texts))), "text": texts})
    runs = pa.Table.from_batches(list(suffixes._map_runs(20, 8)(iter([batch.slice(0, 30), batch.slice(30)])))).sort_by([("key", "ascending"), ("fp", "ascending")])
    spans = pa.Table.from_batches(list(suffixes._classify(20)(iter(runs.to_batches(max_chunksize=17))))).to_pylist()
    asked = [s for s in spans if s["kind"] > 0]
    contents = pa.Table.from_pylist([s | {"content": data[s["doc_id"]][s["start"] : s["stop"]]} for s in asked]).sort_by("key") if asked else None
    found = [(s["doc_id"], s["start"], s["stop"]) for s in spans if s["kind"] == 0]
    if contents is not None:
        for b in suffixes._match(20)(iter(contents.to_batches(max_chunksize=23))):
            found += [(r["doc_id"], r["start"], r["stop"]) for r in b.to_pylist()]
    for i, (n, removed, stretches, digest) in enumerate(expected_repeats(data, 20)):
        own = [{"start": a, "stop": b} for d, a, b in sorted(found) if d == i]
        kept, r, k = suffixes._cut(data[i], own)
        assert (len(data[i]), r, k, hashlib.sha256(kept).hexdigest()) == (n, removed, stretches, digest)


def test_index_family_keeps_levels_geometric(monkeypatch):
    monkeypatch.setattr(suffixes, "SPREAD", 37)
    rng = np.random.default_rng(0)
    family, seen, told, rows = suffixes.IndexFamily(5), Counter(), set(), []
    for n in range(60):
        text = rng.integers(0, 4, 64, dtype=np.uint8)  # zero bytes too
        at = np.arange(60)
        run, place = family.add(text, at, np.full(60, n), at)
        found = list(zip(run.tolist(), place.tolist(), strict=True))
        assert not told & set(found) and len(set(found)) == len(found)
        told |= set(found)
        rows += [(n, p, text[p : p + 5].tobytes()) for p in range(60)]
        seen.update(x for r, _, x in rows[-60:])
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes[:-1], sizes[1:], strict=True)) and sum(sizes) == len(seen)
        for level in family.levels:
            windows = [level.text[a : a + 5].tobytes() for a in level.at.tolist()]
            assert windows == sorted(set(windows))
    assert told == {(r, p) for r, p, x in rows if seen[x] > 1}


def test_cutting_keeps_columns_and_clean_texts(documents, corpus):
    documents = with_extra(documents)
    out = suffixes.without_repeats(documents)
    assert out.columns == documents.columns and out.count() == len(corpus)
    clean = {d: t for d, t, *_ in corpus if t is not None and d is not None and len(t) < 100}
    assert {r.doc_id: r.text for r in out.collect() if r.doc_id in clean} == clean


def plain_fingerprint(text):
    import xxhash

    found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_classes(documents, corpus):
    got = simhash.near_duplicates(with_extra(documents)).collect()
    fps = [plain_fingerprint(t) for _, t, *_ in corpus]
    assert plain_fingerprint("A b c") == plain_fingerprint("a\x0bB  c") == simhash.fingerprint("a b C") and simhash.fingerprint("É a b") != simhash.fingerprint("é a b")
    x = np.array(fps, dtype=np.uint64)
    i, j = np.triu_indices(len(x), 1)
    near = np.bitwise_count(x[i] ^ x[j]) <= 3
    labels = joined_labels(len(x), i[near], j[near])
    least = {}
    for k, (d, *_) in zip(labels.tolist(), corpus, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    want = sorted((str(d), f"{f:016x}", str(least.get(k))) for (d, *_), f, k in zip(corpus, fps, labels.tolist(), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_one_of_each_group_stays(documents, corpus):
    documents = with_extra(documents)
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    roots = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert sorted(map(str, ids)) == sorted(map(str, roots))


@pytest.mark.parametrize("trial", range(12))
def test_trie_join(trial):
    rng = np.random.default_rng(trial)
    points = set()
    for b in map(int, rng.integers(0, 2**64, rng.integers(1, 25), dtype=np.uint64)):
        points.add(b)
        for _ in range(rng.integers(0, 15)):
            for k in rng.integers(0, 48, rng.integers(0, 7)).tolist():
                points.add(b ^ 1 << k)
                b ^= 1 << k if rng.random() < 0.3 else 0
    p = np.array(sorted(points), dtype=np.uint64)
    group = p >> np.uint64(48)
    i, j = np.triu_indices(len(p), 1)
    near = (np.bitwise_count(p[i] ^ p[j]) <= 3) & (group[i] == group[j])
    assert (simhash.self_join(p, group, 16) == joined_labels(len(p), i[near], j[near])).all()


def test_crowded_subtries_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = {int(b) for b in base}
    for b in map(int, base):
        for _ in range(8):
            x = b
            for k in rng.integers(0, 64, 3).tolist():
                x ^= 1 << k
            points.add(x)
    p = np.array(sorted(points), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    i, j = np.triu_indices(len(p), 1)
    near = np.bitwise_count(p[i] ^ p[j]) <= 3
    want = joined_labels(len(p), i[near], j[near])
    at = {int(x): k for k, x in enumerate(p.view(np.int64))}
    for crowded in (simhash.CROWDED, 1):
        pairs = [(at[r.a], at[r.b]) for r in simhash.links(df, crowded=crowded).collect()]
        a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        assert (joined_labels(len(p), a, b) == want).all()


def test_joins_with_a_heavy_key(spark, monkeypatch):
    from tidemark.llm import common

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"), "id")
    ones = rows.select("k").distinct().select("k", (F.coalesce("k", F.lit(-1)) * 2).alias("twice"))
    want = {(i, 2 * (-1 if i % 3 == 0 else 7 if i % 3 == 1 else i)) for i in range(5000)}
    for small in (common.SMALL, 10):
        monkeypatch.setattr(common, "SMALL", small)
        assert {(r.id, r.twice) for r in common.join_each(rows, ones, ["k"]).collect()} == want
        assert common.join_each(rows, ones.where("k > 100"), ["k"]).count() == 1633


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(25)] + [(5, None), (7, 7)] + [(2000, 2001 + i) for i in range(80)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for ab in links for x in ab if x is not None}
    for _ in range(400):
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in ab and None not in ab and ab[0] != ab[1] for ab in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(documents, corpus):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_paths()[0])
    rows = packing.pack(with_extra(documents)).collect()
    ids = {(d, len(x)): x for d, t, *_ in corpus for x in [[*own.encode(t or "", add_special_tokens=False).ids, 0]]}
    placed, pieces = {}, Counter()
    for r in rows:
        doc = next(x for (d, n), x in ids.items() if d == r.doc_id and n == r.doc_tokens)
        part = np.array(doc[r.start : r.start + r.length], dtype="<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens] += r.length
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    copies = Counter((d, len([*own.encode(t or "", add_special_tokens=False).ids, 0])) for d, t, *_ in corpus)
    assert pieces == Counter({k: k[1] * n for k, n in copies.items()})
    total = sum(pieces.values())
    assert len(placed) == -(-total // 1024) or 1024 * len(placed) - total < 0.01 * total + 1024


def test_added_tokens_in_a_text():
    from tokenizers import Tokenizer

    encode, own = packing.Encoder(*packing.default_paths()), Tokenizer.from_file(packing.default_paths()[0])
    for text in ("a <|endoftext|> b", "", " \n\n  x's 12 ü…", "日本 語\t", "a" + " " * 1_200_000 + "b", "x" * 5000, "ab1" * 100_000):
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def test_ids_of_every_character():
    """Each code point between letters, digits and blanks, and random texts: the two libraries agree."""
    from tokenizers import Tokenizer

    encode, own = packing.Encoder(*packing.default_paths()), Tokenizer.from_file(packing.default_paths()[0])
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b 1{c}2{c} {c}{c}'s" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    rng = random.Random(6)
    texts += ["".join(rng.choice([rng.choice(points), rng.choice(" \t\n\r\u00a0\u2003"), rng.choice("abcXYZ019'.,-s"), "'ll"]) for _ in range(rng.randint(1, 300))) for _ in range(3000)]
    for text, theirs in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == theirs.ids, next((c for c in points if encode(f"a{c}b 1{c}2{c} {c}{c}'s") != own.encode(f"a{c}b 1{c}2{c} {c}{c}'s", add_special_tokens=False).ids), text)


@pytest.mark.parametrize("n", [1, 50, 5000])
def test_patterns_hold_every_piece(n):
    rng = np.random.default_rng(n)
    histogram = dict(Counter(rng.integers(1, 101, n).tolist()))
    used = packing.solve(histogram, 100)
    runs = packing.slots(used, histogram)
    covered = Counter()
    for length, low, high, *_ in runs:
        assert covered[length] == low
        covered[length] = high
    assert covered == histogram
    assert all(sum(size * k for size, k in p.items()) <= 100 for p, _ in used)
    waste = sum((100 - sum(size * k for size, k in p.items())) * t for p, t in used)
    assert waste <= 0.05 * sum(a * b for a, b in histogram.items())


def test_mix(documents, corpus):
    placed = mixing.mix(with_extra(documents), block_rows=2, period=32)
    rows = placed.select("doc_id", "source", "_slot", "_place").collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(d[0]) for d in corpus)
    assert len({r._place for r in rows}) == len(rows) and all(r._place // 2 == r._slot for r in rows)
    kept = mixing.mixed(with_extra(documents), {"hot": 0.5, "absent": 0.1, "s1": None, "s2": 0.0, None: float("nan")})
    assert kept.columns == with_extra(documents).columns and kept.count() == len(corpus)
    again = {(r.doc_id, r._place) for r in mixing.mix(documents.repartition(3), block_rows=2, period=32).collect() if r.doc_id not in (None, 2, 31)}
    assert again == {(r.doc_id, r._place) for r in rows if r.doc_id not in (None, 2, 31)}


def test_empty_tables(nothing):
    assert suffixes.digest(nothing).count() == 0 and suffixes.without_repeats(nothing).columns == nothing.columns
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0
    assert packing.pack(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
