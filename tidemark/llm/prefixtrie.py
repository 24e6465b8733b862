"""Prefix trie of conversations by van Emde Boas recursion.

Sequences of turns are cut at half depth: the upper half of all of them makes one trie, and what follows each distinct cut prefix
makes a trie of its own, hung below the node of that prefix.  Upper and lower tries are cut again in the same way, all at once,
so ``log2`` of the longest sequence rounds build every node, whatever their number.  A round is a job over all blocks of its size:
a cut prefix is told by the node that it starts from and by the digest of the block that it adds, and is named by the least
conversation that has it; with its depth that name is the node's, so parents need no look-up.  Digests of blocks are made
bottom up, of two halves each.

Totals go the other way.  Each node begins with its own; a round takes the totals of lower forests, summed at the cut
nodes that they hang from, and grafts them onto all nodes of the upper trie above.

Conversations that are alike in whole are one sequence with a count from the start, so copies cost nothing, and no step needs the
turns of a conversation, the members of a node or the children of a node in one place: positions come from ranges of rows and
their counts, sums are combined before they are shuffled, a frequent prefix meets its name by a broadcast (``join_each``).  Only
the digest of a list of conv_ids goes through one task, as SHA-256 is sequential; it reads the list packed, some eight bytes a conv_id.

Defined cases: a null conv_id takes no part, nor does its turn; null roles and texts are empty; turns of one number, null ones too,
are ordered by the digest of role and text, and repeated rows are turns each; ``%`` keeps the sign of conv_id, as in SQL; a
conversation left without turns is a member of the root; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_each, words, written

#: Conversations whose number is the same after leaving out the rest of this division share their first turns.
FAMILY = 20
#: Most turns that a conversation takes over, and one more.
HEADS = 4
#: conv_ids of a class that are handed on in one piece.
PACK = 50_000
_PACKED = "digest binary, first long, n long, ids string"
_CLASS = "digest binary, conv_id long, n long, ends string"


def token(role: Column, text: Column) -> Column:
    """Digest of a turn: equal for equal (role, text) only."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(token, role, text) of every different turn: the last turn of a node is the one of its token."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.select(token(F.col("role"), F.col("text")).alias("token"), role.alias("role"), text.alias("text")).dropDuplicates(["token"])


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, token, words): each turn's place in its conversation, from 0.

    Rows are dealt by ranges of (conv_id, turn), so a conversation of any length is many tasks; a place is that in the range and
    the counts of the ranges before.  Only the first conversation of a range can have begun earlier, so fewer rows than ranges
    are broadcast.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", token(F.col("role"), F.col("text")).alias("token"), F.size(words(text)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "tokens")  # ranges are found by a look at the rows first: the texts are read once
    dealt = written(rows.repartitionByRange("conv_id", "turn", "token", "row").withColumn("range", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumn("before", before).where("before > 0").select("conv_id", "range", "before")
    inside = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy("turn", "token")) - 1
    own = dealt.withColumn("inside", inside).join(F.broadcast(begun), ["conv_id", "range"], "left")
    return own.select("conv_id", (F.coalesce("before", F.lit(0)) + F.col("inside")).cast("long").alias("pos"), "token", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): each conversation after its first turns were exchanged for those of its family's first one.

    ``turns`` has (conv_id, pos, token, words), ``lengths`` (conv_id, length) of all conversations, turnless ones too.
    """
    turns = written(placed(conversations), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    counts = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).groupBy("conv_id").agg(F.collect_list(F.struct("pos", "token", "words")).alias("head"))
    first = heads.withColumnRenamed("conv_id", "family")
    convs = counts.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "family", "left").withColumn("taken", taken)
    head = F.filter(F.col("head"), lambda x: x["pos"] < F.col("taken"))
    convs = convs.select("conv_id", "n", "taken", F.coalesce(head, F.array().cast("array<struct<pos:bigint,token:binary,words:bigint>>")).alias("head"))
    convs = written(convs.withColumn("shift", F.col("taken") - F.size("head")), "convs")
    borrowed = convs.select("conv_id", F.inline("head"))
    kept = join_each(turns.where(F.col("pos") >= taken), convs.select("conv_id", "shift"), ["conv_id"], counts).withColumn("pos", F.col("pos") - F.col("shift"))
    lengths = convs.select("conv_id", (F.size("head") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))).alias("length"))
    return written(borrowed.unionByName(kept.select(borrowed.columns)), "rebuilt"), written(lengths, "lengths")


def blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """(conv_id, i, digest) of the i-th block of ``2**k`` turns, for k of 0 to ``levels``; the last block may be shorter."""
    found = [turns.select("conv_id", F.col("pos").alias("i"), F.col("token").alias("digest"))]
    for _ in range(levels):
        half = lambda side: F.max(F.when(F.col("i") % 2 == side, F.col("digest")))
        pairs = found[-1].groupBy("conv_id", F.shiftright("i", 1).alias("j")).agg(half(0).alias("left"), half(1).alias("right"))
        both = F.unhex(F.sha2(F.concat("left", F.coalesce("right", F.lit(b""))), 256))
        found.append(written(pairs.select("conv_id", F.col("j").alias("i"), both.alias("digest")), "blocks"))
    return found


def _runs(batch: pa.RecordBatch, key: str) -> Iterator[tuple[object, int, int]]:
    """(key, from, to) of each run of equal keys."""
    keys = batch.column(key).to_pylist()
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_ids of equal digests, in order, as pieces of comma-joined text."""
    for whole in batches:
        for at in range(0, whole.num_rows, PACK):
            batch = whole.slice(at, PACK)
            ids = batch.column("conv_id").to_pylist()
            rows = [(d, ids[a], b - a, ",".join(map(str, ids[a:b]))) for d, a, b in _runs(batch, "digest")]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["digest", "first", "n", "ids"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, least conv_id, number, SHA-256 of the list) from pieces sorted by digest and first conv_id."""
    last, first, n, sha = None, 0, 0, hashlib.sha256()
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["digest", "conv_id", "n", "ends"])

    for pieces in batches:
        for digest, a, b in _runs(pieces, "digest"):
            if digest != last:
                if last is not None:
                    out.append((last, first, n, sha.hexdigest()))
                last, first, n, sha = digest, pieces.column("first")[a].as_py(), 0, hashlib.sha256()
            for i in range(a, b):
                sha.update((("," if n else "") + pieces.column("ids")[i].as_py()).encode())
                n += pieces.column("n")[i].as_py()
        yield batch()
        out = []
    if last is not None:
        out.append((last, first, n, sha.hexdigest()))
        yield batch()


def classes(whole: DataFrame) -> DataFrame:
    """(digest, conv_id, n, ends) of each class of equal ``whole`` (conv_id, digest): its least conv_id, number and list's digest."""
    packed = whole.select("conv_id", "digest").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pack, _PACKED)
    return packed.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_close, _CLASS)


def named(sequences: DataFrame, parts: list[DataFrame], root: int) -> DataFrame:
    """(conv_id, n, length, i, parent): the node that each sequence's first i turns lead to, for every i below its length.

    ``sequences`` has (conv_id, n, length), ``parts`` their blocks by level.  From the whole length down, each round cuts every
    block in two and names the prefix that ends at the cut.
    """
    at = sequences.where("length > 0").withColumn("i", F.lit(0).cast("long")).withColumn("parent", F.lit(root).cast("long"))
    for k in range(len(parts) - 2, -1, -1):
        upper = at.withColumn("i", F.col("i") * 2)
        cut = F.shiftleft(F.col("i") + 1, k)
        reaching = upper.where(F.col("length") >= cut).join(parts[k], ["conv_id", "i"])
        key = ["i", "parent", "digest"]
        names = written(reaching.groupBy(*key).agg(F.min("conv_id").alias("name"), F.count("*").alias("n")), "names")
        lower = join_each(reaching, names.drop("n"), key, names).where(F.col("length") > cut).select("conv_id", "n", "length", (F.col("i") + 1).alias("i"), F.col("name").alias("parent"))
        at = written(upper.unionByName(lower), "cut")
    return at


def grafted(nodes: DataFrame, paths: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent, totals of their own) with totals of their subtrees.

    ``paths`` (conv_id, depth, node) has the node at every depth of every sequence.  In round k the tries of ``2**k`` levels
    are whole; the roots of lower ones sum up at the cut node that they hang from, and its sums go to the nodes above it in its trie.
    """
    for k in range(levels):
        block = F.shiftright(F.col("depth") - 1, k)
        roots = nodes.where((block % 2 == 1) & (F.col("depth") - 1 == F.shiftleft(block, k)))
        cut = roots.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("cut")).agg(*[F.sum(t).alias(t) for t in totals])
        above = paths.where(block % 2 == 0).withColumn("cut", F.shiftleft(block + 1, k))
        onto = join_each(above, written(cut, "forests"), ["conv_id", "cut"]).select(F.col("node").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent"), *totals)
        nodes = written(nodes.unionByName(onto).groupBy("conv_id", "depth").agg(F.max("parent").alias("parent"), *[F.sum(t).alias(t) for t in totals]), "grafted")
    return nodes


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, pos, token, words), ``lengths`` naming all conversations.

    conv_id and depth name a node: the least member, and how many turns lead to it.
    """
    longest = lengths.agg(F.max("length")).first()[0]
    levels = (max(longest or 1, 1) - 1).bit_length()
    parts = blocks(turns, levels)
    empty = lengths.where("length = 0").select("conv_id", F.lit(b"").alias("digest"))
    alike = written(classes(parts[-1].select("conv_id", "digest").unionByName(empty)), "classes")
    sequences = written(alike.join(lengths, "conv_id").select("conv_id", "n", "length", "ends"), "sequences")
    root, members = sequences.agg(F.min("conv_id"), F.sum("n")).first()
    if root is None:
        root, members = 0, 0
    last = named(sequences.drop("ends"), parts, root).join(turns.withColumnRenamed("pos", "i"), ["conv_id", "i"])
    last = written(last, "last")
    key = ["i", "parent", "token"]
    found = written(last.groupBy(*key).agg(F.min("conv_id").alias("node"), F.sum("n").alias("n_convs"), F.max("words").alias("words"), F.count("*").alias("n")), "nodes")
    depth = (F.col("i") + 1).alias("depth")
    paths = written(join_each(last, found.select(*key, "node"), key, found).select("conv_id", depth, "node", "length"), "paths")
    nodes = found.select(F.col("node").alias("conv_id"), depth, "parent", "n_convs", "words", "token")
    children = nodes.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["conv_id", "depth"], "left").na.fill(0, ["n_children"]), "nodes")
    own = nodes.select("conv_id", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = grafted(own, paths, levels, ["n_leaves", "saved_tokens"])
    ends = paths.where("depth = length").join(sequences.select("conv_id", "ends"), "conv_id").select(F.col("node").alias("conv_id"), "depth", "ends")
    below = nodes.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "token")
    below = below.join(sums.drop("parent"), ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    top = sums.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    turnless = sequences.where("length = 0").agg(F.max("ends")).first()[0]
    top = top.where(F.lit(members > 0)).select(
        F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(members).cast("long").alias("n_convs"),
        "n_children", F.lit(None).cast("binary").alias("token"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.lit(turnless).cast("string").alias("ends"),
    )
    none = F.lit(hashlib.sha256().hexdigest())
    return below.unionByName(top).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"), "token")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt within their families."""
    return trie(*rebuilt(conversations))
