"""The prefix trie against one built turn by turn."""

import hashlib
import math
import random
import re
import zlib

from tidemark.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, pos int, token string, words int, n int"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        own = (len(members[prefix]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0)
        leaves[prefix] = sum(leaves[p] for p in below) if below else 1
        saved[prefix] = own + sum(saved[p] for p in below)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], SCHEMA).repartition(3)
    got = prefixtrie.prefix_trie(frame)
    assert got.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = got.collect()
    assert sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:8]) for r in got) == plain(rows)
    return frame, got


def test_shared_turns_ties_and_nulls(spark):
    rng = random.Random(2)
    texts = ["Hello  there", "a b c\td\n", "", None, "x", "é ü", "one\x1ctwo"]
    rows = []
    for c in [*range(45), 60, 61, 300, -3, -20, -41]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "user", None, "bot"]), rng.choice(texts)))
    rows += [rows[0], rows[0], (None, 1, "user", "x"), (None, None, None, None)]
    frame, got = check(spark, rows)
    texts_of = {r.token: (r.role, r.text) for r in prefixtrie.turn_texts(frame).collect()}
    assert all((r.token in texts_of) == (r.depth > 0) for r in got)


def test_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"turn {t % 11}") for t in range(700)]
    rows += [(c, t, "user", f"turn {t % 11}") for c in range(1000, 1300) for t in range(3)]
    rows += [(c, t, "user", f"turn {t % 11}") for c in range(2000, 2012) for t in range(c % 20 * 40)]
    check(spark, rows)


def test_a_hot_repeated_turn(spark):
    check(spark, [(5, 1, "user", "again")] * 400 + [(c, 1, "user", "again") for c in range(100, 140)])


def test_no_conversations(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "t", 2, 3)], SCHEMA)).collect() == []


def test_long_lists_of_ids_are_one_digest(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PACK", 7)
    whole = spark.range(1000).selectExpr("id * 3 AS conv_id", "cast(if(id % 3 = 0, 'a', concat('b', id)) AS binary) AS digest").repartition(5)
    got = {bytes(r.digest): (r.conv_id, r.n, r.ends) for r in prefixtrie.classes(whole).collect()}
    hot = ",".join(str(i * 3) for i in range(0, 1000, 3))
    assert got[b"a"] == (0, 334, hashlib.sha256(hot.encode()).hexdigest())
    assert len(got) == 667 and got[b"b1"] == (3, 1, hashlib.sha256(b"3").hexdigest())
