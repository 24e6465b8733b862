"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in hash order, are cut into blocks.  All sources are dealt a share v that grows together: at v
a source of weight w has had w v blocks, until it runs out and leaves its slots to the others in proportion.  The
slot at which v is reached has a closed form (``Fluid``), so block i is released at floor(slot of (i - 1) / w) and due at
ceil(slot of i / w); in every slot the released block with the earliest deadline goes next.  These windows come
from the weights as they are, so at any slot of the whole mix every source is within one block of its unrounded
share, and every row is placed once.

Blocks with one window are a class: the i-th blocks of all sources of as many blocks and the same weight.  Time is cut into
stretches of a fixed length, a task each, however long windows are.  No slot stays empty, so the number of blocks open at a
slot is that released before it less the slots gone.  A block that is open at the end of a stretch was open ever since its
release, so of the blocks released before any slot no more can be left than were open then: under these bounds the blocks of
latest deadline are left (``left_open``), as counts of classes.  So the end of each stretch is settled by itself, from the
classes whose window holds it, at most two for each pair of block count and weight that occurs.

Sources are rows of a table in every step and may be any number; the driver sees the row counts that occur.

Ranks within a source come from counts of its hash buckets, which are added up in chunks where they are many: no source is one group.

Defined cases: a null source is a source of its own; sources without a weight share the rows' own proportion of
what the given weights leave (1e-9 where these leave nothing); sources with a weight but no rows are ignored; repeated
rows are rows like any; ties in hash are in the order of a second hash; null, negative, zero or non-finite target weights count
as not given; null and empty texts and texts of any length are rows like any; an empty table gives no rows; extra columns, of
whatever names, stay as they are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_each, written
from tidemark.operators.running import positions, running

#: Rows of a block; rows of a hash bucket; slots of a stretch.
BLOCK_ROWS, BUCKET_ROWS, STRETCH = 8, 1000, 1 << 16
#: The table of sources is broadcast up to so many rows (some 50 MB); beyond that the large ones only are.
BROADCAST_SOURCES = 500_000
#: Without target weights a source weighs its row count to this power.
SMOOTHING = 0.5


class Fluid:
    """Slots as a function of the share dealt, for all sources at once and without phases.

    At share v a source of weight w has had w * v blocks, or all of its own when these are fewer.  ``kinds`` has a row
    (blocks, weight, how many sources) for each pair that occurs, which is few: default weights follow from the rows.
    """

    def __init__(self, kinds: list[tuple[int, float, int]]):
        blocks, weight, many = (np.array(x) for x in zip(*kinds, strict=True)) if kinds else (np.zeros(0),) * 3
        order = np.argsort(blocks / weight, kind="stable")
        self.ends = (blocks / weight)[order]
        self.ended = np.r_[0, np.cumsum((blocks * many)[order])]
        self.live = np.r_[np.cumsum((weight * many)[order][::-1])[::-1], 0.0]
        self.slots = int(self.ended[-1])

    def at(self, v: np.ndarray) -> np.ndarray:
        """The slot at which the share is ``v``; whole slots are told from rounding."""
        k = np.searchsorted(self.ends, v, side="left")
        slot = self.ended[k] + v * self.live[k]
        whole = np.rint(slot)
        return np.where(np.abs(slot - whole) < 1e-7 + 1e-14 * slot, whole, slot)

    def windows(self, block: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(release, due) of the blocks, counted from 0."""
        return np.floor(self.at(block / weight)).astype(np.int64), np.ceil(self.at((block + 1) / weight)).astype(np.int64)


def fewest_open(release: np.ndarray, many: np.ndarray, begin: int, length: int, at_begin: int) -> np.ndarray:
    """For each slot from ``begin`` on the least number of blocks open after it up to the end of its stretch.

    ``many`` blocks come at ``release``, one goes in each slot, and ``at_begin`` are open at first.
    """
    came = np.bincount(release - begin, weights=many, minlength=length).cumsum().astype(np.int64)
    return np.minimum.accumulate((at_begin + came - np.arange(1, length + 1))[::-1])[::-1]


def left_open(release: np.ndarray, due: np.ndarray, many: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many blocks of each class (``many``, in the order of ties) are left at a slot that all their windows hold.

    Of the blocks released up to a class's release ``room`` can be left at most; those of latest deadline are.
    """
    left, held, size = many.tolist(), [], 0
    order = np.argsort(release, kind="stable")
    last = np.r_[release[order][1:] != release[order][:-1], True]
    for i, whole in zip(order.tolist(), last.tolist(), strict=True):
        heapq.heappush(held, (int(due[i]), i))
        size += left[i]
        while whole and held and size > max(room[i], 0):
            first = held[0][1]
            gone = min(left[first], size - max(int(room[i]), 0))
            left[first] -= gone
            size -= gone
            if not left[first]:
                heapq.heappop(held)
    return np.array(left, dtype=np.int64)


def earliest_deadline_first(release: np.ndarray, begin: int) -> np.ndarray:
    """The slots of blocks (in order of deadline), one in each slot from ``begin`` on."""
    slots, ready = np.empty(len(release), dtype=np.int64), []
    coming = np.argsort(release, kind="stable")
    times, coming, i = release[coming].tolist(), coming.tolist(), 0
    for slot in range(begin, begin + len(release)):
        while i < len(times) and (times[i] <= slot or not ready):
            heapq.heappush(ready, coming[i])
            i += 1
        slots[heapq.heappop(ready)] = slot
    return slots


def _kinds(sources: DataFrame, weights: dict[str, float] | None, block_rows: int) -> tuple[DataFrame, list[tuple[int, float, int]]]:
    """``sources`` (_name, _null, _n) with _weight, _kind and _rank among those of its kind, and the kinds: (blocks, weight, how many).

    The driver gets a row for each row count that occurs (at most the square root of twice the rows) and given weight.
    """
    spark = sources.sparkSession
    if weights is None:
        weighed = sources.withColumn("_weight", F.pow(F.col("_n"), F.lit(SMOOTHING)))
    else:
        usable = [(s or "", s is None, float(w)) for s, w in weights.items() if w is not None and 0 < w < float("inf")]
        given = spark.createDataFrame(usable, "_name string, _null boolean, _given double")
        sources = sources.join(F.broadcast(given), ["_name", "_null"], "left")
        taken, others = sources.agg(F.sum("_given"), F.sum(F.when(F.col("_given").isNull(), F.col("_n")))).first()
        rest = F.lit(max(1.0 - (taken or 0.0), 0.0) / (others or 1)) * F.col("_n")
        weighed = sources.withColumn("_weight", F.coalesce("_given", F.greatest(rest, F.lit(1e-9)))).drop("_given")
    weighed = weighed.withColumn("_blocks", F.ceil(F.col("_n") / block_rows))
    kinds = sorted((r[0], r[1], r[2]) for r in weighed.groupBy("_blocks", "_weight").count().collect())
    told = spark.createDataFrame([(b, w, k) for k, (b, w, _) in enumerate(kinds)], "_blocks long, _weight double, _kind int")
    named = written(weighed.join(F.broadcast(told), ["_blocks", "_weight"]), "kinds")
    return positions(named, ["_kind"], "_rank", ("_name", "_null")), kinds


def _classes(spark: SparkSession, kinds: list[tuple[int, float, int]], fluid: Fluid) -> DataFrame:
    """(kind, block, many, release, due) of every class; the blocks of a large kind are numbered in chunks."""
    chunk = 1 << 16
    table = spark.createDataFrame([(k, *kind) for k, kind in enumerate(kinds)], "kind int, blocks long, weight double, many long")
    chunks = table.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / chunk))))
    parts = min(10_000, 1 + sum(k[0] for k in kinds) // (8 * chunk))
    numbers = F.sequence(F.col("chunk") * chunk, F.least("blocks", (F.col("chunk") + 1) * chunk) - 1)
    many = chunks.repartition(parts, "kind", "chunk").select("kind", "many", "weight", F.explode(numbers).alias("block"))

    @F.pandas_udf("release long, due long")
    def windows(block: pd.Series, weight: pd.Series) -> pd.DataFrame:
        release, due = fluid.windows(block.to_numpy(), weight.to_numpy())
        return pd.DataFrame({"release": release, "due": due})

    return many.withColumn("_window", windows("block", "weight")).select("kind", "block", "many", "_window.release", "_window.due")


def _runs(classes: DataFrame, length: int, slots: int) -> DataFrame:
    """(kind, block, release, due, stretch, first, last): of each class the ranks first to last - 1 that go in the stretch."""
    stretches = -(-slots // length)
    begun, ended = F.floor(F.col("release") / length), F.floor((F.col("due") - 1) / length)
    # A row for each stretch: the blocks released in it.
    came = dict(classes.groupBy(begun).agg(F.sum("many")).collect())
    open_at = (np.cumsum([0, *(came.get(k, 0) for k in range(stretches))]) - np.arange(stretches + 1) * length).tolist()
    kind = "kind int, block long, many long, release long, due long"

    def crossing(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["release"].iloc[0]) // length
        fewest = fewest_open(group["release"].to_numpy(), group["many"].to_numpy(), number * length, length, open_at[number])
        group = group.assign(fewest=fewest[group["release"].to_numpy() - number * length])
        whole = pd.DataFrame([(-1, 0, 0, number * length, 0, fewest[0])], columns=group.columns)
        return pd.concat([group[group["due"] > (number + 1) * length], whole])

    columns = ["kind", "block", "many", "release", "due"]
    crossed = written(classes.groupBy(begun.alias("at")).applyInPandas(lambda g: crossing(g[columns]), f"{kind}, fewest long"), "crossing")
    least = np.array(open_at[1:], dtype=np.int64)
    for at, fewest in crossed.where("kind < 0").select("release", "fewest").collect():
        least[at // length] = fewest

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        end = int(group["end"].iloc[0])
        group = group.sort_values(["kind", "block"], ignore_index=True)
        since = np.r_[np.minimum.accumulate(least[:end][::-1])[::-1], np.iinfo(np.int64).max]
        release = group["release"].to_numpy()
        room = np.minimum(group["fewest"].to_numpy(), since[release // length + 1])
        return group[[*columns, "end"]].assign(left=left_open(release, group["due"].to_numpy(), group["many"].to_numpy(), room))

    crossed = crossed.where("kind >= 0")
    ends = crossed.withColumn("end", F.explode(F.sequence(begun + 1, F.least(ended, F.lit(stretches - 1)))))
    told = written(ends.groupBy("end").applyInPandas(settle, f"{kind}, end long, left long"), "settled")
    nothing, done = F.lit(0).cast("long"), F.col("many") - F.col("left")
    own = lambda rows, at, first, last: rows.select(*columns, at.alias("stretch"), first.alias("first"), last.alias("last"))
    sides = own(crossed, begun, nothing, nothing).unionByName(own(crossed, ended, nothing, F.col("many")))
    sides = sides.unionByName(own(told, F.col("end") - 1, nothing, done)).unionByName(own(told, F.col("end"), done, nothing))
    cut = sides.groupBy(*columns, "stretch").agg(F.max("first").alias("first"), F.max("last").alias("last")).where("last > first")
    return own(classes.where(begun == ended), begun, nothing, F.col("many")).unionByName(cut).drop("many")


def _slots(sources: DataFrame, kinds: list[tuple[int, float, int]], length: int) -> DataFrame:
    """(_name, _null, _block, _slot) of all blocks of ``sources`` (_name, _null, _blocks, _kind, _rank)."""
    fluid = Fluid(kinds)
    classes = written(_classes(sources.sparkSession, kinds, fluid), "classes")
    runs = written(_runs(classes, length, fluid.slots), "runs")
    sizes = dict(runs.groupBy("stretch").agg(F.sum(F.col("last") - F.col("first"))).collect())
    begins = np.cumsum([0, *(sizes.get(k, 0) for k in range(-(-fluid.slots // length)))]).tolist()

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["due", "kind", "block"], ignore_index=True)
        many = (group["last"] - group["first"]).to_numpy()
        which = np.repeat(np.arange(len(group)), many)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(many) - many - group["first"].to_numpy(), many)
        slot = earliest_deadline_first(group["release"].to_numpy()[which], begins[int(group["stretch"].iloc[0])])
        return pd.DataFrame({"_kind": group["kind"].to_numpy()[which], "_rank": rank, "_block": group["block"].to_numpy()[which], "_slot": slot})

    placed = runs.groupBy("stretch").applyInPandas(place, "_kind int, _rank long, _block long, _slot long")
    names = sources.select("_name", "_null", "_kind", "_rank")
    return join_each(placed, names, ["_kind", "_rank"], sources.withColumnRenamed("_blocks", "n")).select("_name", "_null", "_block", "_slot")


def _placed(documents: DataFrame, weights: dict[str, float] | None = None, source: str = "source", block_rows: int = BLOCK_ROWS, period: int = STRETCH, keep: list[str] | None = None) -> DataFrame:
    """(_row, _slot, _place): each row (of all columns, or those to ``keep``), apart from the columns used here."""
    own = F.struct("*") if keep is None else F.struct(*keep)
    name = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_name")
    rows = documents.select(own.alias("_row"), name, F.col(source).isNull().alias("_null"), F.xxhash64("doc_id", "text").alias("_hash"), F.hash("text", "doc_id").alias("_tie"))
    sources = written(rows.groupBy("_name", "_null").agg(F.count("*").alias("_n")), "sources")
    sources, kinds = _kinds(sources, weights, block_rows)
    sources = written(sources, "ranked")
    # Every source has buckets by its own size, so a large one is many groups.
    buckets = sources.select("_name", "_null", F.ceil(F.col("_n") / BUCKET_ROWS).alias("_buckets"), "_n")
    if sources.count() <= BROADCAST_SOURCES:
        dealt = rows.join(F.broadcast(buckets.drop("_n")), ["_name", "_null"])
    else:
        dealt = join_each(rows, buckets.drop("_n"), ["_name", "_null"], buckets.withColumnRenamed("_n", "n"))
    dealt = dealt.withColumn("_bucket", F.pmod("_hash", "_buckets")).drop("_buckets")
    group = ["_name", "_null", "_bucket"]
    sizes = dealt.groupBy(*group).agg(F.count("*").alias("_count"))
    sizes = running(written(sizes, "sizes"), ["_name", "_null"], ("_bucket",), "sum", F.col("_count"), "_before")
    # The blocks that have rows in the bucket.
    last = F.floor((F.col("_before") + F.col("_count") - 1) / block_rows)
    sizes = sizes.withColumn("_first", F.floor(F.col("_before") / block_rows)).withColumn("_last", last)
    sizes = written(sizes, "buckets")
    slots = _slots(sources, kinds, period)
    parts = sizes.select(*group, "_before", "_first", F.explode(F.sequence("_first", "_last")).alias("_block")).join(slots, ["_name", "_null", "_block"])
    found = parts.groupBy(*group).agg(F.first("_before").alias("_before"), F.first("_first").alias("_first"), F.sort_array(F.collect_list(F.struct("_block", "_slot")))["_slot"].alias("_slots"))
    found = written(found, "slots")
    order = Window.partitionBy(*group).orderBy("_hash", "_tie")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(found.hint("merge"), group)
    rank = F.col("_rank") + F.col("_before")
    slot = F.element_at("_slots", (F.floor(rank / block_rows) - F.col("_first") + 1).cast("int"))
    return ranked.select("_row", slot.alias("_slot"), (slot * block_rows + rank % block_rows).alias("_place"))


def mix(documents: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """``documents`` with _slot (of the row's block) and _place (in the whole mix: slot and row of the block).

    ``keep`` names the columns wanted: without the text, only ids move.
    """
    return _placed(documents, weights, **options).select("_row.*", "_slot", "_place")


def mixed(documents: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``documents``, all of them, in the order of the mix."""
    return _placed(documents, weights, **options).repartitionByRange("_place").sortWithinPartitions("_place").select("_row.*")
