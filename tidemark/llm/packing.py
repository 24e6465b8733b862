"""Packing documents into fixed-length token sequences as a cutting-stock problem.

1. One pass over the texts tokenises every document (ids, then a closing id) and cuts it into whole sequences
   plus one remainder; each piece gets its position among the pieces of its length within its partition.
2. The histogram of piece lengths (at most ``capacity`` rows) goes to the driver.  A linear program over packing
   patterns is solved by column generation: a knapsack dynamic programme over the dual values prices new
   patterns.  Patterns are rounded; pieces that no nearly full pattern takes are laid end to end and cut
   where a sequence ends, at most once a sequence.
3. Patterns are laid over ranks: the pieces of a length, ranked by partition counts, fall into consecutive runs
   of pattern slots.  The slot table has a bounded number of rows and is broadcast; sequence id and offset
   are arithmetic on the rank, so no piece is ever grouped with others.

Defined cases: a null or empty text is the closing id alone; a document of several thousand tokens gives
several whole sequences and a remainder; repeated rows and repeated doc_ids are packed each; ties in length
are ranked by partition and row (with ``in_order`` by file name and row); an empty table gives no rows; other columns are
ignored; a text with a hundred thousand blanks in a row, or an added token, has its ids from the tokenizers library directly.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

CAPACITY = 1024
#: What cutting a piece adds to its share of a sequence, in the linear program.
CUT_COST = 0.02
#: The simplex ends once its value is proven to be so near the optimum, as a share of it, or once as many exchanges as
#: there are lengths have gained less than that (what is left to gain lies within the price of cutting).
GAP = 0.002
#: The table of ranks before each part is broadcast up to so many rows (some 20 MB), joined by a shuffle beyond.
BROADCAST_ROWS = 100_000
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, block long, local long, number long, ids array<int>"


class Encoder:
    """Ids of the byte-level BPE in ``tokenizer`` (a tokenizers file), by its merge ranks in ``ranks`` (the same
    vocabulary as a tiktoken file, some four times as fast).  A text that holds one of the file's added
    tokens, or white space too long for the other's pattern matcher, goes through the tokenizers library itself,
    so the ids are that library's in every case.
    """

    #: The matcher of ``fast`` gives up on a million characters of white space.
    BLANK = re.compile(r"\s{100000}")

    def __init__(self, tokenizer: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.whole = Tokenizer.from_file(tokenizer)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if any(a in text for a in self.added) or (len(text) > 100_000 and self.BLANK.search(text)):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenised(documents: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, end_id: int = 0, in_order: bool = False) -> DataFrame:
    """Pieces of every whole text, with their place among the pieces of their length, and among all, in their part.

    A part is a partition, or with ``in_order`` a split of a file: (number of the file by name, first byte).
    """
    files = {f.rsplit("/", 1)[-1]: i for i, f in enumerate(sorted(documents.inputFiles()))} if in_order else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks)
        part, block, seen, number = TaskContext.get().partitionId(), 0, Counter(), 0
        kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 3 + [pa.list_(pa.int32())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "block", "local", "number", "ids"]
        for batch in batches:
            rows = []
            splits = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True) if in_order else [None] * batch.num_rows
            for doc_id, text, split in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), splits, strict=True):
                if split and (files[split[0]], split[1]) != (part, block) or split and not number:
                    part, block, seen, number = files[split[0]], split[1], Counter(), 0
                tokens = np.array([*encode(text or ""), end_id], dtype="<u4")
                for start in range(0, len(tokens), capacity):
                    piece = tokens[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(tokens), part, block, seen[len(piece)], number, piece.view("<i4") if len(piece) < capacity else None))
                    seen[len(piece)] += 1
                    number += 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    split = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block")] if in_order else []
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *split).mapInArrow(cut, PIECES)


def _cut_at(capacity: int):
    """Cut in two each piece that runs over the end of its sequence; the second part opens the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "position"]
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            over = np.flatnonzero(frame["offset"].to_numpy() + frame["length"].to_numpy() > capacity)
            kept = np.ones(batch.num_rows, dtype=bool)
            kept[over] = False
            yield from frame.select(names).filter(pa.array(kept)).combine_chunks().to_batches()
            rows = []
            for r in frame.take(pa.array(over)).to_pylist():
                tokens, room = np.array(r["ids"], dtype="<u4"), capacity - r["offset"]
                for part, start, sequence, offset in ((tokens[:room], 0, 0, r["offset"]), (tokens[room:], room, 1, 0)):
                    rows.append((r["doc_id"], r["start"] + start, len(part), zlib.crc32(part.tobytes()), r["doc_tokens"], r["sequence_id"] + sequence, offset, r["position"]))
            if rows:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return cut


def best_patterns(values: np.ndarray, sizes: np.ndarray, capacity: int, most: int = 48) -> list[dict[int, int]]:
    """Unbounded knapsack: for each size the most valuable multiset of sizes (by index) that holds it and
    fits ``capacity``; the best ``most`` of these, the overall best first."""
    worth = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    sizes_u, values_u = sizes[useful], values[useful]
    ends = np.searchsorted(sizes_u, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        if n := ends[c]:
            total = worth[c - sizes_u[:n]] + values_u[:n]
            k = total.argmax()
            if total[k] > worth[c] + 1e-12:
                worth[c], choice[c] = total[k], k
    with_each = values_u + worth[capacity - sizes_u]
    found = {}
    for first in np.argsort(-with_each, kind="stable")[:most]:
        pattern, c = Counter({int(useful[first]): 1}), capacity - int(sizes_u[first])
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                pattern[int(useful[choice[c]])] += 1
                c -= int(sizes_u[choice[c]])
        found.setdefault(tuple(sorted(pattern.items())), dict(pattern))
    return list(found.values())


def _greedy(sizes: np.ndarray, demand: np.ndarray, apart: np.ndarray, capacity: int) -> tuple[list[dict[int, int] | None], np.ndarray]:
    """A first basis: for each size the pattern, longest pieces first, that used it up, or None where it is cut.

    Each pattern uses up one size that later patterns lack, so the columns are triangular and independent.
    """
    left, columns, amounts = demand.astype(np.int64), [None] * len(sizes), np.zeros(len(sizes))
    while (open_sizes := np.flatnonzero(left)).size:
        pattern, room = {}, capacity
        for i in open_sizes[::-1]:
            if k := min(int(room // sizes[i]), int(left[i])):
                pattern[int(i)] = k
                room -= k * int(sizes[i])
        times = min(int(left[i]) // k for i, k in pattern.items())
        last = next(i for i, k in pattern.items() if int(left[i]) // k == times)
        if sum(apart[i] * k for i, k in pattern.items()) < 1:  # too empty: its longest pieces are cut
            last = next(iter(pattern))
            amounts[last], left[last] = left[last], 0
            continue
        for i, k in pattern.items():
            left[i] -= k * times
        if left[last]:  # a rest too small for the pattern
            rest, left[last] = left[last], 0
            times += rest / pattern[last]
            for i, k in pattern.items():
                if i != last:
                    left[i] = max(0, left[i] - int(np.ceil(k * rest / pattern[last])))
        columns[last], amounts[last] = pattern, times
    return columns, amounts


def _exchange(inverse: np.ndarray, column: np.ndarray, leaving: int) -> None:
    """The basis inverse after ``column`` (in terms of the basis) takes the place of column ``leaving``."""
    pivot = inverse[leaving] / column[leaving]
    touched = np.flatnonzero(column)
    inverse[touched] -= column[touched, None] * pivot
    inverse[leaving] = pivot


def solve(histogram: dict[int, int], capacity: int = CAPACITY, cut_cost: float = CUT_COST, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Whole-piece patterns ({length: pieces}, how often); the pieces that they leave are for cutting.

    Revised simplex over the histogram's lengths.  A piece of length n left for cutting costs its share of
    a sequence and ``cut_cost`` of that on top, so only patterns that are nearly full are worth a sequence.
    A greedy packing gives the first basis; the knapsack prices entering patterns, the ratio test picks the
    leaving column.  Duals scaled until no column prices out bound the optimum from below: it ends within ``gap`` of that
    bound, or where no more is gained.  No call here goes to a threaded linear algebra library: such a call hung in a driver that had forked.
    """
    sizes = np.array(sorted(n for n, k in histogram.items() if k > 0 and n < capacity), dtype=np.int64)
    used: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        used.append(({capacity: 1}, histogram[capacity]))
    if not len(sizes):
        return used
    demand = np.array([histogram[int(n)] for n in sizes], dtype=float)
    apart = sizes * (1 + cut_cost) / capacity
    columns, amounts = _greedy(sizes, demand, apart, capacity)
    # Slightly more of each column: no amount is zero, so every exchange gains and none comes back.
    amounts = amounts + np.random.default_rng(0).uniform(0.5e-4, 1e-4, len(sizes))
    costs = np.array([1.0 if c else a for c, a in zip(columns, apart, strict=True)])
    inverse = np.eye(len(sizes))
    combined = lambda pattern: (inverse[:, list(pattern)] * np.array(list(pattern.values()), dtype=float)).sum(axis=1)
    for j, column in enumerate(columns):
        if column:
            _exchange(inverse, combined(column), j)
    pivots, best_bound, mark, at_mark = 0, 0.0, 0, np.inf
    while True:
        duals = np.einsum("i,ij->j", costs, inverse)
        priced, above = best_patterns(np.maximum(duals, 0), sizes, capacity), np.maximum(duals, 0)
        worth = sum(above[i] * k for i, k in priced[0].items()) if priced else 0.0
        best_bound = max(best_bound, float((above * demand).sum()) / max(1.0, worth, float((above / apart).max())))
        now = float((costs * amounts).sum())
        if now <= best_bound * (1 + gap):
            break
        if pivots >= mark:
            if at_mark - now < gap * now:
                break
            mark, at_mark = pivots + len(sizes), now
        entering = [(1.0, p) for p in priced]
        entering += [(apart[i], None, int(i)) for i in np.argsort(apart - duals)[:8]]  # back to cutting
        before = pivots
        for cost, pattern, *own in entering:
            column = inverse[:, own[0]].copy() if own else combined(pattern)
            rising = column > 1e-9
            if (costs * column).sum() - cost <= 1e-6 or not rising.any():
                continue
            ratio = np.where(rising, amounts / np.where(rising, column, 1), np.inf)
            leaving = int(ratio.argmin())
            step = ratio[leaving]
            amounts = np.maximum(amounts - step * column, 0)
            amounts[leaving] = step
            _exchange(inverse, column, leaving)
            costs[leaving], columns[leaving] = cost, pattern
            pivots += 1
        if pivots == before:
            break
    left = {int(n): int(d) for n, d in zip(sizes, demand, strict=True)}
    chosen = [({int(sizes[i]): k for i, k in c.items()}, float(x)) for c, x in zip(columns, amounts, strict=True) if c]
    times = Counter()
    order = sorted(range(len(chosen)), key=lambda j: -(chosen[j][1] % 1))
    for up in (0, 1):  # rounded down, then one more of each that still finds its pieces
        for j in order:
            pattern, amount = chosen[j]
            n = min([1 if up else int(amount + 1e-6), *(left[m] // k for m, k in pattern.items())])
            times[j] += n
            for m, k in pattern.items():
                left[m] -= n * k
    return used + [(chosen[j][0], n) for j, n in sorted(times.items()) if n]


def slots(used: list[tuple[dict[int, int], int]], histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces per sequence, first sequence id, first offset) of each run of ranks.

    The last run of a length, with 0 pieces per sequence, is left for cutting: there the sequence id is that
    of the first of those sequences and the offset counts from its start.
    """
    ranks, first, out = Counter(), 0, []
    for pattern, times in used:
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            out.append((n, ranks[n], ranks[n] + k * times, k, first, offset))
            ranks[n] += k * times
            offset += n * k
        first += times
    offset = 0
    for n in sorted(histogram, reverse=True):
        if more := histogram[n] - ranks[n]:
            out.append((n, ranks[n], histogram[n], 0, first, offset))
            offset += n * more
    return out


def _numbered_by_first(placed: DataFrame) -> DataFrame:
    """``placed`` with sequences numbered by the position of their earliest piece."""
    spark = placed.sparkSession
    first = placed.groupBy("sequence_id").agg(F.min("position").alias("first"))
    ordered = first.repartitionByRange("first", "sequence_id").sortWithinPartitions("first", "sequence_id")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = written(ordered.select("sequence_id", F.spark_partition_id().alias("part"), local.alias("local")), "sequences")
    # A row for each partition.
    total, base = 0, []
    for part, n in sorted(ordered.groupBy("part").count().collect()):
        base.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    numbers = ordered.join(base, "part").select("sequence_id", (F.col("base") + F.col("local")).alias("number"))
    return placed.join(numbers, "sequence_id").select(*[F.col("number").alias(c) if c == "sequence_id" else c for c in placed.columns])


def pack(documents: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = 0, in_order: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    With ``in_order``, ``documents`` is read from files, and their order by file name and row counts: pieces of a length
    are ranked in it, and sequences numbered by their earliest piece.
    """
    spark = documents.sparkSession
    pieces = written(tokenised(documents, tokenizer or default_paths()[0], ranks or default_paths()[1], capacity, end_id, in_order), "pieces")
    counts = written(pieces.groupBy("length", "part", "block").agg(F.count("*").alias("n")), "counts")
    # A row for each length and partition: the ranks before a partition are a sum over the earlier ones.
    before = counts.select("length", "part", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("part", "block")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # The runs of a length in one row: at most a few for each of the ``capacity`` lengths.
    runs = spark.createDataFrame(
        slots(solve(histogram, capacity), histogram) or [(0, 0, 0, 1, 0, 0)],
        "length long, low long, high long, per long, first long, base long",
    ).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "per", "first", "base"))).alias("runs"))
    # A row for each part: the pieces of all lengths before it.
    total, base = 0, []
    for part, block, n in sorted(map(tuple, counts.groupBy("part", "block").agg(F.sum("n")).collect())):
        base.append((part, block, total))
        total += n
    base = F.broadcast(spark.createDataFrame(base, "part int, block long, base long"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = pieces.join(before, ["length", "part", "block"]).join(base, ["part", "block"]).withColumn("position", F.col("base") + F.col("number")).drop("base", "number")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))
    placed = ranked.join(F.broadcast(runs), "length").withColumn(
        "run", F.filter("runs", lambda r: (r.low <= F.col("rank")) & (F.col("rank") < r.high))[0]
    )
    step, per, base = F.col("rank") - F.col("run.low"), F.col("run.per"), F.col("run.base")
    at = base + step * F.col("length")  # of a piece left for cutting, from the start of its first sequence
    whole = per > 0
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "position",
        (F.col("run.first") + F.when(whole, F.floor(step / per)).otherwise(F.floor(at / capacity))).alias("sequence_id"),
        F.when(whole, base + (step % per) * F.col("length")).otherwise(at % capacity).alias("offset"),
    )
    placed = placed.mapInArrow(_cut_at(capacity), PACKED + ", position long")
    return (_numbered_by_first(written(placed, "placed")) if in_order else placed).drop("position")
