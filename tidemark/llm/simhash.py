"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: ASCII-lower-cased words between ASCII white space, 3-word shingles, XXH64 with seed 42; a bit is set
if more than half of the shingle hashes have it.  Texts of fewer words hash their whole sequence; a text
without words has fingerprint zero and links like any other.

Links (``budget`` or fewer differing bits) are found among distinct fingerprints only.  The trie is dealt out by
its top bits: with at most three differing bits, one of four 16-bit blocks is equal, so each fingerprint goes to
four subtries, one for each block taken as the top of the bit order; a subtrie of over ``CROWDED``
fingerprints is dealt again by a 12-bit block of the remaining bits, four ways, so nothing is lost.  In a task,
each subtrie is joined with itself: pairs of nodes go down together, add up the bits in which they differ and stop
beyond the budget.  A subtrie reports a spanning forest of its links, at most one row for each member.

Defined cases: null text is empty; repeated rows and doc_ids are rows of their own and get the same class; rows
with a null doc_id get their class's smallest id (null if it has none); an empty table gives no rows; other
columns are ignored; a text of any length is one row with one fingerprint, worked out 4096 shingles at a time; a bit that half of
the shingles set, no more, is not set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_each, joined_labels, written
from tidemark.llm.components import components

BUDGET = 3
#: Subtries with more fingerprints than this are dealt again by further bits.
CROWDED = 20_000
#: Node pairs of so few member pairs are compared at once.
SMALL = 64


def fingerprint(text: str | None) -> int:
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = [b" ".join(s) for s in zip(found, found[1:], found[2:], strict=False)] or [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8", count=len(shingles))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long, and a hash that tells texts of one doc_id apart."""

    def map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"])

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(map_batches, "doc_id long, text_key long, fp long")


def _rotated(fp, t: int):
    """The bits of ``fp`` with 16-bit block ``t`` on top."""
    return fp if t == 0 else F.shiftleft(fp, 16 * t).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * t))


def _again(path, s: int):
    """Under the same top 16 bits, bring 12-bit block ``s`` of the other 48 next to the top."""
    top = path.bitwiseAND(F.lit(-1 << 48))
    rest = path.bitwiseAND(F.lit((1 << 48) - 1))
    if s == 0:
        return path
    turned = F.shiftleft(rest, 12 * s).bitwiseOR(F.shiftrightunsigned(rest, 48 - 12 * s)).bitwiseAND(F.lit((1 << 48) - 1))
    return top.bitwiseOR(turned)


def self_join(path: np.ndarray, group: np.ndarray, top: int, budget: int = BUDGET) -> np.ndarray:
    """Component labels among sorted distinct ``path`` (uint64) of each ``group``; groups share their ``top`` first bits."""
    n = len(path)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(path[1:] ^ path[:-1]) <= budget))
    labels = joined_labels(n, near, near + 1)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, dtype=np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    al, ah = starts[many], ends[many]
    bl, bh, diff = al.copy(), ah.copy(), np.zeros(len(al), dtype=np.int64)
    for bit in range(63 - top, -1, -1):
        if not len(al):
            break
        # Nodes whose members are all of one class already, the same in both: nothing to find.
        change = np.flatnonzero(np.r_[labels[1:] != labels[:-1], True]) if n else np.zeros(0, dtype=np.int64)
        last_a, last_b = change[np.searchsorted(change, al)], change[np.searchsorted(change, bl)]
        todo = ~((last_a >= ah - 1) & (last_b >= bh - 1) & (labels[al] == labels[bl]))
        al, ah, bl, bh, diff = al[todo], ah[todo], bl[todo], bh[todo], diff[todo]
        size = (ah - al) * (bh - bl)
        small = size <= SMALL
        if small.any():
            reps = size[small]
            which = np.repeat(np.flatnonzero(small), reps)
            k = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
            width = (bh - bl)[which]
            i, j = al[which] + k // width, bl[which] + k % width
            linked = (i < j) & (np.bitwise_count(path[i] ^ path[j]) <= budget)
            labels = joined_labels(n, i[linked], j[linked], labels)
            al, ah, bl, bh, diff = al[~small], ah[~small], bl[~small], bh[~small], diff[~small]
        if not len(al):
            break
        mask = np.uint64(1) << np.uint64(bit)
        ones = np.r_[0, np.cumsum((path & mask) != 0)]
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])  # zeros come first in a node
        same = al == bl
        parts = [
            (al, am, bl, bm, diff, None), (am, ah, bm, bh, diff, None),
            (al, am, bm, bh, diff + 1, None), (am, ah, bl, bm, diff + 1, ~same),
        ]
        grown = []
        for pal, pah, pbl, pbh, pd, extra in parts:
            keep = (pah > pal) & (pbh > pbl) & (pd <= budget)
            keep &= ~((pal == pbl) & (pah - pal == 1))
            if extra is not None:
                keep &= extra
            grown.append((pal[keep], pah[keep], pbl[keep], pbh[keep], pd[keep]))
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*grown, strict=True))
    return labels


def _forest(budget: int):
    """Over rows sorted by (kind, path): the links of each subtrie as (fp, fp of its class's first member)."""

    def joined(kind: np.ndarray, path: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(kind):
            own = kind == k
            p, f = path[own].view(np.uint64), fp[own]
            order = np.argsort(p)
            p, f = p[order], f[order]
            top = 16 if k < 4 else 28
            labels = self_join(p, p >> np.uint64(64 - top), top, budget)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(f[linked]), "b": pa.array(f[labels[linked]])})

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key", "path", "fp")]
            held.append(part)
            rows += len(part[0])
            if rows < 200_000:
                continue
            kind, key, path, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))
            if len(cut):  # all but the last subtrie are complete
                at = int(cut[-1]) + 1
                yield from joined(kind[:at], path[:at], fp[:at])
                held, rows = [[kind[at:], key[at:], path[at:], fp[at:]]], len(kind) - at
        if rows:
            kind, _, path, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from joined(kind, path, fp)

    return forest


def links(distinct: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that join every class of the distinct fingerprints ``fp``; not all pairs of a class."""
    if not 0 <= budget <= 3:
        raise ValueError("four blocks find up to three differing bits")
    fp = F.col("fp")
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("kind"), _rotated(fp, t).alias("path")) for t in range(4)])).alias("x"))
    dealt = dealt.select("fp", "x.kind", "x.path", F.shiftrightunsigned("x.path", 48).alias("key"))
    # At most 4 * 65536 subtries, so the list of crowded ones is bounded.
    busy = F.broadcast(dealt.groupBy("kind", "key").count().where(F.col("count") > crowded).select("kind", "key", F.lit(True).alias("busy")))
    marked = dealt.join(busy, ["kind", "key"], "left")
    plain = marked.where("busy IS NULL").select("kind", "key", "path", "fp")
    path = F.col("path")
    again = F.explode(F.array(*[F.struct((4 + F.col("kind") * 4 + s).alias("kind"), _again(path, s).alias("path")) for s in range(4)]))
    split = marked.where("busy").select("fp", again.alias("x")).select("x.kind", F.shiftrightunsigned("x.path", 36).alias("key"), "x.path", "fp")
    both = plain.unionByName(split.select("kind", "key", "path", "fp"))
    return both.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(_forest(budget), "a long, b long")


def classes(marks: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """(fp, n, component_id, root) for each distinct fingerprint of ``marks`` (doc_id, fp), which n rows have.

    The root is a fingerprint of the class and no other's; two classes that share a doc_id may share the component_id.
    """
    distinct = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, budget, crowded))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "ids")
    return join_each(rooted, ids.drop("n"), ["root"], ids).select("fp", "n", "component_id", "root")


def _placed(documents: DataFrame, budget: int, crowded: int) -> DataFrame:
    """(doc_id, text_key, fp, component_id, root) of every row."""
    marks = written(fingerprints(documents), "fingerprints")
    found = written(classes(marks, budget, crowded), "classes")
    return join_each(marks, found.drop("n"), ["fp"], found)


def near_duplicates(documents: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return _placed(documents, budget, crowded).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, budget: int = BUDGET, crowded: int = CROWDED) -> DataFrame:
    """The rows of ``documents`` less near-duplicates: of each class the row of its smallest doc_id.

    Of repeated rows one stays; rows without a doc_id stay only where their class has no doc_id at all (one for
    each fingerprint).  Rows come with their own columns, whatever these are.
    """
    placed = _placed(documents, budget, crowded).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows of one class and doc_id with different texts: the text of least hash. Copies of a row are counted.
    best = placed.groupBy("root", "fp", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    best = best.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp")).alias("nameless"), "root").agg(F.min(F.struct("text_key", "rows")).alias("first"))
    best = best.select(F.col("doc_id").alias("_id"), F.col("first.text_key").alias("_key"), F.col("first.rows").alias("_rows"))
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_key"))
    kept = rows.join(best.hint("shuffle_hash"), F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
    once = kept.where("_rows = 1").select("_row")
    more = kept.where("_rows > 1").dropDuplicates(["_id", "_key"]).select("_row")
    return once.unionByName(more).select("_row.*")
