"""Exact repeated-substring removal by a logarithmic index family of suffix arrays.

Every byte that a ``length``-byte string covers which also starts anywhere else (another document or the same
one) is removed; strings are judged on the input.

1. *Dealing out the suffix space.*  A ``length``-byte window belongs to its anchor, the leftmost least hash of
   the ``GRAM``-byte strings inside it.  The anchor depends on the window's bytes alone, so equal windows have
   equal anchors.  Neighbouring windows of one anchor form a run of under ``2 * length`` bytes; some 1.3 rows
   per 100 bytes leave a document, each with the anchor's hash (``key``) and a hash of its bytes.
2. *Whole runs.*  Runs of a key, in order of their hash, are scanned: a run whose two hashes (128 bits) occur twice is all
   repeats.  Only a run that is unlike any other but shares its key goes on, with its bytes.  Heavy keys, known by a count
   before this shuffle, are dealt by key and hash of bytes together.
3. *Partial runs.*  The windows of these form index families, one for each partition of the keys: a new batch of runs gets its
   suffix array (windows in the order of all their bytes), is merge-scanned against each existing level, equal neighbours
   being repeats, and becomes a level; levels of like size merge, so a window is merged a logarithmic number
   of times.  Windows are compared by their bytes.  Heavy keys are dealt again by a longer anchor: what follows the first one
   or, in windows where too little follows, what stands before it.  A key that still has over ``CROWDED`` runs is counted
   window by window in an aggregation over 128-bit hashes, so no task holds it.
4. The repeats of a document are joined to its text and cut out.

Defined cases: null text is empty, and texts under ``length`` bytes keep all; repeated rows and doc_ids are
documents of their own (rows alike remove each other from ``length`` bytes on); a null doc_id is a value like any;
an empty table gives no rows; extra columns, of whatever names, stay with ``without_repeats`` and are ignored else; a very long
text is worked on in overlapping pieces of a megabyte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY, join_each, written

LENGTH = 200
GRAM = 48
#: Keys with more differing runs than this are counted in an aggregation.
CROWDED = 50_000
#: Bytes and rows that are worked on at once.
CHUNK, BUFFER = 1 << 20, 400_000
#: Runs of a batch of the index family; runs to a partition of it; windows of a level that are laid out at once.
BATCH, PARTITION, SPREAD = 1000, 20_000, 100_000

_RUN = "key long, fp long, doc_id long, text_key long, place long"
_SPAN = "doc_id long, text_key long, start long, stop long, kind int, key long"


class Rolling:
    """Hashes of all substrings of a given length, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**63)) * 2 + 1
        inverse = pow(base, -1, 2**64)
        self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, base, dtype=np.uint64)])
        self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, inverse, dtype=np.uint64)])

    def __call__(self, data: np.ndarray, length: int) -> np.ndarray:
        n = len(data)
        if n < length:
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=sums[1:])
        out = (sums[length:] - sums[:-length]) * self.down[: n - length + 1]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


_ROLLING: dict[tuple[int, int], Rolling] = {}


def rolling(seed: int, size: int) -> Rolling:
    if (seed, size) not in _ROLLING:
        _ROLLING[seed, size] = Rolling(seed, size)
    return _ROLLING[seed, size]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: block prefixes and suffixes."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, key) of each run in ``data``; ends: for each byte the end of its text."""
    grams = rolling(1, CHUNK * 2)(data, gram)
    width = length - gram + 1
    if len(grams) < width:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    places = np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | places, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.arange(len(anchor)) + length <= ends[: len(anchor)]
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return first, last, grams[anchor[first]]


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and the offsets of each."""
    column = pa.concat_arrays([column if pa.types.is_binary(column.type) else column.fill_null("")]).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def _segments(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of neighbouring (text, from, to); a long text is dealt over chunks that overlap by a window."""
    chunk, size = [], 0
    for text in range(len(offsets) - 1):
        at, end = int(offsets[text]), int(offsets[text + 1])
        if end - at < length:
            continue
        while True:
            to = min(end, at + CHUNK)
            if size and size + to - at > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((text, at, to))
            size += to - at
            if to == end:
                break
            at = to - length + 1
    if chunk:
        yield chunk


def _map_runs(length: int, gram: int):
    def map_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = _text_bytes(batch.column("text"))
            doc_ids, text_keys = batch.column("doc_id"), batch.column("text_key")
            found = [[], [], [], [], []]  # key, fp, text, start, extra windows
            for chunk in _segments(offsets, length):
                part = np.concatenate([data[a:b] for _, a, b in chunk])
                sizes = np.array([b - a for _, a, b in chunk])
                ends = np.cumsum(sizes)
                first, last, key = runs_of(part, np.repeat(ends, sizes), length, gram)
                which = np.searchsorted(ends, first, side="right")
                view = memoryview(part)
                fp = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), dtype=np.uint64, count=len(first))
                shift = np.array([a - int(offsets[t]) for t, a, _ in chunk]) - (ends - sizes)
                for kept, new in zip(found, (key, fp, np.array([t for t, _, _ in chunk])[which], first + shift[which], last - first), strict=True):
                    kept.append(new)
            if not found[0]:
                continue
            key, fp, text, start, extra = (np.concatenate(x) for x in found)
            # Repeats within the batch are known already: one of them goes to its key, the others pass through.
            order = np.lexsort((fp, key))
            again = np.r_[False, (key[order][1:] == key[order][:-1]) & (fp[order][1:] == fp[order][:-1])]
            flag = np.zeros(len(key), dtype=np.int64)
            flag[order[again]] = 2
            flag[order[np.flatnonzero(np.r_[again[1:], False] & ~again)]] = 1
            key = np.where(flag == 2, fp + start.astype(np.uint64), key)
            place = (start << 16) | (flag << 8) | extra
            text = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), doc_ids.take(text), text_keys.take(text), pa.array(place)],
                ["key", "fp", "doc_id", "text_key", "place"],
            )

    return map_runs


def _classify(length: int, heavy: bool = False):
    """Over runs sorted by (key, fp): kind 0 for repeats, 1 for runs to look into, 2 for repeats to hold them against.

    Of ``heavy`` keys a task sees a part only; they are taken to have unlike runs.
    """

    def spans(rows: pa.Table, pick: np.ndarray, kind: int) -> pa.RecordBatch | None:
        if not len(pick):
            return None
        rows = rows.take(pa.array(pick))
        place = rows["place"].to_numpy()
        start = place >> 16
        return pa.RecordBatch.from_arrays(
            [rows["doc_id"].combine_chunks(), rows["text_key"].combine_chunks(), pa.array(start), pa.array(start + (place & 255) + length),
             pa.array(np.full(len(pick), kind, dtype=np.int32)), rows["key"].combine_chunks()],
            ["doc_id", "text_key", "start", "stop", "kind", "key"],
        )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        others = None  # a key some of whose runs have gone by already

        def judged(rows: pa.Table, more: bool) -> tuple[list, pa.Table | None]:
            """Rows of the last run's bytes are kept back if more may follow."""
            nonlocal others
            flag = (rows["place"].to_numpy() >> 8) & 255
            out = [spans(rows, np.flatnonzero(flag == 2), 0)]
            rows = rows.filter(pa.array(flag != 2))
            key, fp = rows["key"].to_numpy(), rows["fp"].to_numpy()
            n = len(key)
            if not n:
                return out, None
            new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, n])
            flags = (rows["place"].to_numpy() >> 8) & 255
            repeated = (size > 1) | (np.maximum.reduceat(flags, first) > 0)
            group_key = key[first]
            same = group_key[1:] == group_key[:-1]
            shared = np.r_[False, same] | np.r_[same, False] | (group_key == others if others is not None else False) | heavy
            done = len(first) - 1 if more else len(first)
            emitted = (flags == 3)
            row_done = group < done
            out.append(spans(rows, np.flatnonzero(row_done & repeated[group] & ~emitted), 0))
            out.append(spans(rows, np.flatnonzero(row_done & ~repeated[group] & shared[group]), 1))
            out.append(spans(rows, first[:done][repeated[:done] & shared[:done]], 2))
            if not more:
                return out, None
            others = group_key[-1] if shared[-1] and not heavy else None
            tail = rows.slice(int(first[-1]))
            if size[-1] > 1:  # report what is known to repeat; one row, marked as reported, stands for all
                out.append(spans(rows, np.flatnonzero(~row_done & ~emitted), 0))
                place = tail["place"].to_numpy()[:1]
                tail = tail.slice(0, 1).set_column(tail.schema.get_field_index("place"), "place", pa.array((place & ~np.int64(0xFF00)) | (3 << 8)))
            return out, tail

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BUFFER:
                continue
            out, tail = judged(pa.Table.from_batches(held).combine_chunks(), True)
            yield from (x for x in out if x is not None)
            held, rows = (tail.combine_chunks().to_batches(), tail.num_rows) if tail is not None else ([], 0)
        if held:
            out, _ = judged(pa.Table.from_batches(held).combine_chunks(), False)
            yield from (x for x in out if x is not None)

    return classify


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run to look into: (key, doc_id, text_key, start, kind, bytes)."""
    for batch in batches:
        data, offsets = _text_bytes(batch.column("text"))
        doc_ids, text_keys, lists = batch.column("doc_id"), batch.column("text_key"), batch.column("runs")
        runs = lists.flatten()
        which = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        start, stop = (runs.field(f).to_numpy(zero_copy_only=False) for f in ("start", "stop"))
        at = offsets[which]
        view = memoryview(data)
        for a in range(0, len(start), 20_000):
            part = slice(a, a + 20_000)
            content = [bytes(view[o + s : o + e]) for o, s, e in zip(at[part].tolist(), start[part].tolist(), stop[part].tolist(), strict=True)]
            text = pa.array(which[part])
            yield pa.RecordBatch.from_arrays(
                [runs.field("key").slice(a, len(content)), doc_ids.take(text), text_keys.take(text), pa.array(start[part]), runs.field("kind").slice(a, len(content)), pa.array(content, pa.binary())],
                ["key", "doc_id", "text_key", "start", "kind", "content"],
            )


def _places(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, place in it) of every window of the runs between ``offsets``."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)


def windows_of(contents: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in it, two hashes) of every window of every run."""
    data, offsets = _text_bytes(contents)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    run, place = _places(offsets, length)
    at = offsets[run] + place
    hashes = []
    for seed in (2, 3):
        h = np.zeros(len(at), dtype=np.uint64)
        step = CHUNK
        for a in range(0, max(len(data) - length + 1, 0), step):  # pieces that overlap by a window
            own = slice(*np.searchsorted(at, [a, a + step]))
            h[own] = rolling(seed, CHUNK * 2)(data[a : a + step + length - 1], length)[at[own] - a]
        hashes.append(h)
    return run, place, *hashes


@dataclass
class Level:
    """A suffix array: unlike windows of ``text`` in the order of their bytes, each with its run, its place there and whether it has a twin."""

    text: np.ndarray
    at: np.ndarray
    run: np.ndarray
    place: np.ndarray
    twin: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def picked(self, which: np.ndarray) -> Level:
        return Level(self.text, self.at[which], self.run[which], self.place[which], self.twin[which])


class IndexFamily:
    """Levels of suffix arrays over ``length``-byte windows, from large to small.

    ``add`` gives the windows, new and old, that now have a twin and had none before, as (run, place).
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def _windows(self, level: Level, begin: int, end: int) -> np.ndarray:
        """The bytes of some of a level's windows, as strings that compare byte by byte."""
        laid_out = np.lib.stride_tricks.sliding_window_view(level.text, self.length)[level.at[begin:end]]
        return np.ascontiguousarray(laid_out).view(f"S{self.length}").ravel()

    def _after(self, level: Level, window: np.bytes_, begin: int) -> int:
        """How many of a level's windows are no greater than ``window``, from ``begin`` on."""
        low, high = begin, len(level)
        while low < high:
            mid = (low + high) // 2
            if self._windows(level, mid, mid + 1)[0] <= window:
                low = mid + 1
            else:
                high = mid
        return low

    def _merge_scan(self, level: Level, new: Level) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``new`` how many of ``level``'s are less, and whether the next one is its equal; a part of either at a time."""
        before, equal = np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=bool)
        reached = 0
        for begin in range(0, len(new), SPREAD):
            windows = self._windows(new, begin, begin + SPREAD)
            stop, done, at = self._after(level, windows[-1], reached), 0, reached
            while at < stop:
                part = self._windows(level, at, min(at + SPREAD, stop))
                upto = len(windows) if at + len(part) == stop else int(np.searchsorted(windows, part[-1], side="right"))
                own = windows[done:upto]
                place = np.searchsorted(part, own)
                before[begin + done : begin + upto] = at + place
                inside = place < len(part)
                equal[begin + done : begin + upto][inside] = part[place[inside]] == own[inside]
                done, at = upto, at + len(part)
            before[begin + done : begin + len(windows)] = stop
            reached = max(reached, stop - 1)
        return before, equal

    def _merged(self, level: Level, new: Level) -> Level:
        """One level of both; of windows alike in both the older stays."""
        before, equal = self._merge_scan(level, new)
        own = np.flatnonzero(~equal)
        place = before[own] + np.arange(len(own))
        old = np.ones(len(level) + len(own), dtype=bool)
        old[place] = False
        out = []
        for a, b in ((level.at, new.at[own] + len(level.text)), (level.run, new.run[own]), (level.place, new.place[own]), (level.twin, new.twin[own])):
            both = np.empty(len(old), dtype=a.dtype)
            both[old], both[place] = a, b
            out.append(both)
        return Level(np.concatenate([level.text, new.text]), *out)

    def add(self, text: np.ndarray, at: np.ndarray, run: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = Level(text, at, run, place, np.zeros(len(at), dtype=bool))
        windows = self._windows(new, 0, len(at))
        order = np.argsort(windows, kind="stable")
        new, windows = new.picked(order), windows[order]
        same = windows[1:] == windows[:-1]
        new.twin[1:] |= same
        new.twin[:-1] |= same
        unlike = np.r_[True, ~same] if len(at) else np.zeros(0, dtype=bool)
        told = [(new.run[new.twin], new.place[new.twin])]
        new = new.picked(unlike)
        held, fresh = np.zeros(len(new), dtype=bool), np.zeros(len(new), dtype=bool)
        for level in self.levels:
            before, equal = self._merge_scan(level, new)
            met = np.unique(before[equal])
            met = met[~level.twin[met]]
            level.twin[met] = True
            told.append((level.run[met], level.place[met]))
            held |= equal
            fresh |= equal & ~new.twin
        told.append((new.run[fresh], new.place[fresh]))
        new.twin |= held
        # One of the windows that are alike is enough to find later ones; levels stand from large to small.
        new = new.picked(~held)
        while self.levels and len(self.levels[-1]) <= 2 * len(new):
            new = self._merged(self.levels.pop(), new)
        if len(new):
            self.levels.append(new)
        return np.concatenate([r for r, _ in told]), np.concatenate([p for _, p in told])


def _ranges(run: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first byte, end) of neighbouring windows of a run."""
    order = np.lexsort((place, run))
    run, place = run[order], place[order]
    new = np.r_[True, (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1)] if len(run) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(run) - 1] if len(first) else first
    return run[first], place[first], place[last] + length


def _match(length: int):
    """Over the runs of a partition of the keys: spans of windows that have a twin."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, known = IndexFamily(length), []
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                text, offsets = _text_bytes(batch.column("content"))
                text, offsets = text[offsets[0] : offsets[-1]], offsets - offsets[0]
                run, place = _places(offsets, length)
                seen = len(known)
                known += zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "start", "kind")), strict=True)
                out = []
                for r, a, b in zip(*(x.tolist() for x in _ranges(*family.add(text, offsets[run] + place, run + seen, place), length)), strict=True):
                    doc_id, text_key, start, kind = known[r]
                    if kind == 1:
                        out.append((doc_id, text_key, start + a, start + b))
                if out:
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in zip(("doc_id", "text_key", "start", "stop"), zip(*out, strict=True), strict=True)})

    return match


def _deal_again(length: int, gram: int):
    """Runs of heavy keys, under keys of a longer anchor.

    Where at most half of the room is before the anchor, a window holds so many bytes after it; in the others as many
    are before it.  A run becomes two, and the windows of either share these bytes too.  Of pieces that are alike in a
    batch, byte by byte, one goes on to hold others against; the others are repeats (kind 0, ``key`` is their end).
    """
    half = (length - gram) // 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            pieces: dict[tuple[int, bytes], list[tuple]] = {}
            for key, doc_id, text_key, start, kind, content in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text_key", "start", "kind", "content")), strict=True):
                grams = rolling(1, CHUNK * 2)(np.frombuffer(content, dtype=np.uint8), gram).view(np.int64)
                anchor, windows = int(np.flatnonzero(grams == key)[0]), len(content) - length + 1
                since, upto = max(0, anchor - half), min(windows, anchor - half)
                if since < windows:
                    again = key ^ xxhash.xxh3_64_intdigest(content[anchor + gram : anchor + length - half], 1) >> 1
                    pieces.setdefault((again, content[since:]), []).append((doc_id, text_key, start + since, kind))
                if upto > 0:
                    again = key ^ xxhash.xxh3_64_intdigest(content[anchor - half - 1 : anchor], 2) >> 1
                    pieces.setdefault((again, content[: upto - 1 + length]), []).append((doc_id, text_key, start, kind))
            rows = []
            for (key, content), own in pieces.items():
                doc_id, text_key, start, kind = own[0]
                rows.append((key, doc_id, text_key, start, kind if len(own) == 1 else 2, content))
                if len(own) > 1:
                    rows += [(start + len(content), doc_id, text_key, start, 0, None) for doc_id, text_key, start, kind in own if kind == 1]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "doc_id", "text_key", "start", "kind", "content"])

    return deal


def _explode(length: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                run, place, h1, h2 = windows_of(batch.column("content"), length)
                take = pa.array(run)
                start = batch.column("start").to_numpy()[run] + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), batch.column("doc_id").take(take), batch.column("text_key").take(take), pa.array(start), batch.column("kind").take(take)],
                    ["h1", "h2", "doc_id", "text_key", "start", "kind"],
                )

    return explode


def keyed(documents: DataFrame) -> DataFrame:
    """Only what finding repeats needs, with a hash that tells texts of one doc_id apart."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _same_text(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def _heavy_keys(rows: DataFrame, more_than: int) -> tuple[list[int], int]:
    """(the keys with over one in ``HEAVY`` of the rows and over ``more_than``, number of rows): fewer than ``HEAVY`` keys."""
    counts = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > more_than), "counts")
    total = rows.count()
    return [r.key for r in counts.where(F.col("n") * HEAVY > total).select("key").collect()], total


def repeats(documents: DataFrame, length: int = LENGTH, gram: int | None = None, crowded: int = CROWDED, heavy: int = 100) -> DataFrame:
    """(doc_id, text_key, spans): all repeated stretches of each text that has any, as [start, stop) byte spans.

    A key of over one in a thousand of the rows, if that is over ``heavy`` rows, is dealt out further.
    """
    gram = gram or max(1, min(GRAM, length // 2))
    if not gram <= length <= gram + 255:
        raise ValueError("a run's place holds lengths up to gram + 255")
    docs = keyed(documents)
    runs = written(docs.mapInArrow(_map_runs(length, gram), _RUN), "all_runs")
    keys, _ = _heavy_keys(runs, heavy)
    is_heavy = F.col("key").isin(keys)
    light = runs.where(~is_heavy) if keys else runs
    spans = light.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_classify(length), _SPAN)
    if keys:
        dealt = runs.where(is_heavy).repartition("key", "fp").sortWithinPartitions("key", "fp")
        spans = spans.unionByName(dealt.mapInArrow(_classify(length, True), _SPAN))
    spans = written(spans, "runs")
    asked = spans.where("kind > 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("key", "start", "stop", "kind")).alias("runs"))  # a text that repeats has its runs once
    fetched = docs.join(asked.hint("shuffle_hash"), _same_text(docs, asked)).select(docs["doc_id"], docs["text_key"], docs["text"], "runs")
    schema = "key long, doc_id long, text_key long, start long, kind int, content binary"
    contents = written(fetched.mapInArrow(_fetch, schema), "contents")
    keys, total = _heavy_keys(contents, heavy)
    found = spans.where("kind = 0").select("doc_id", "text_key", "start", "stop")
    if keys:
        is_heavy = F.col("key").isin(keys)
        again = written(contents.where(is_heavy).mapInArrow(_deal_again(length, gram), schema), "again")
        found = found.unionByName(again.where("kind = 0").select("doc_id", "text_key", "start", F.col("key").alias("stop")))
        contents = written(contents.where(~is_heavy).unionByName(again.where("kind > 0")), "contents")
    busy = written(contents.groupBy("key").count().where(F.col("count") > crowded).select("key"), "busy")
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    few = contents.join(busy, "key", "left_anti").repartition(parts, "key")
    partial = few.mapInArrow(_match(length), "doc_id long, text_key long, start long, stop long")
    windows = contents.join(busy, "key", "left_semi").mapInArrow(_explode(length), "h1 long, h2 long, doc_id long, text_key long, start long, kind int")
    found = found.unionByName(partial)
    if busy.first() is not None:
        windows = written(windows, "windows")
        counts = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")), "counts")
        twice = join_each(windows, counts.where("n > 1").select("h1", "h2"), ["h1", "h2"], counts)
        found = found.unionByName(twice.where("kind = 1").select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop")))
    return found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans in order, from sorted [start, stop) rows; touching ones are one."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], np.r_[reach[new[1:] - 1], reach[-1]]], axis=1)


def _cut(text: bytes, spans: list | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, stretches removed)"""
    if not spans:
        return text, 0, 0
    out, at = [], 0
    gone = merged(np.array([(s["start"], s["stop"]) for s in spans], dtype=np.int64))
    for a, b in gone.tolist():
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), int((gone[:, 1] - gone[:, 0]).sum()), len(gone)


def _with_spans(documents: DataFrame, length: int) -> DataFrame:
    """(_row, _text, _spans): each row as it is, with its text's repeats; rows are kept apart from columns used here."""
    found = repeats(documents, length)
    rows = documents.select(F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_key"))
    own = found.select(F.col("doc_id").alias("_own_id"), F.col("text_key").alias("_own_key"), F.col("spans").alias("_spans"))
    same = F.col("_doc_id").eqNullSafe(F.col("_own_id")) & (F.col("_text_key") == F.col("_own_key"))
    return rows.join(own.hint("shuffle_hash"), same, "left").select("_row", "_text", "_spans")


def digest(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_spans")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                kept, removed, n = _cut(data, spans)
                rows.append((doc_id, len(data), removed, n, hashlib.sha256(kept).hexdigest()))
            names, kinds = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), [pa.int64()] * 4 + [pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    joined = _with_spans(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return joined.select("_row.doc_id", "_row.text", "_spans").mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``documents`` with the repeats cut out of ``text`` (``n_chars``, if there, counts what is left).

    A cut may fall inside a character; its remaining bytes, which are no text, become U+FFFD.
    """

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([_cut((t or "").encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "replace") for t, s in zip(texts, spans.map(lambda s: None if s is None else list(s)), strict=True)], dtype=object)

    joined = _with_spans(documents, length)
    touched = F.col("_spans").isNotNull()
    changed = F.when(touched, cut(F.when(touched, F.col("_text")), F.col("_spans"))).otherwise(F.col("_text"))
    row = F.col("_row").withField("text", changed)
    if "n_chars" in documents.columns:
        left = F.length(F.col("_row.text")).cast(documents.schema["n_chars"].dataType)
        joined = joined.withColumn("_row", row)
        row = F.when(touched, F.col("_row").withField("n_chars", left)).otherwise(F.col("_row"))
    return joined.withColumn("_row", row).select("_row.*")
