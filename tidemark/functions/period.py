"""Calendar periods as Column expressions. The session time zone must be UTC."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1000, 60_000, 3_600_000, 86_400_000
#: Length of the fixed units, and of the unit around each in which multiples are counted.
FIXED = {"millisecond": (1, SECOND), "second": (SECOND, MINUTE), "minute": (MINUTE, HOUR), "hour": (HOUR, DAY)}
UNITS = ("microsecond", *FIXED, "day", "week", "month", "year")
#: Friendly sizes: (longest duration in ms, ms of the unit, unit, listed sizes).  Fixed values.
FRIENDLY = (
    (SECOND, 1, "millisecond", (1, 5, 10, 25, 50, 100, 250, 500)),
    (MINUTE, SECOND, "second", (1, 15, 30, 60)),
    (HOUR, MINUTE, "minute", (1, 15, 30, 60)),
    (DAY, HOUR, "hour", (1, 2, 6, 12, 24)),
    (7 * DAY, DAY, "day", (1,)),
    (365 * DAY - 1, 7 * DAY, "week", (1,)),
    (None, 365 * DAY, "year", (1,)),
)


@dataclass(frozen=True)
class Period:
    n: int
    unit: str

    @staticmethod
    def parse(text: str) -> Period:
        """``"<n> <unit>"``, microsecond to year, singular or plural; microseconds become whole milliseconds."""
        found = re.fullmatch(r"\s*(\d+)\s+([A-Za-z]+?)s?\s*", text)
        if not found or found[2].lower() not in UNITS:
            raise ValueError(f"not a period: {text!r}")
        n, unit = int(found[1]), found[2].lower()
        return Period(n // 1000, "millisecond") if unit == "microsecond" else Period(n, unit)

    @property
    def kind(self) -> str:
        return "fixed" if self.unit in FIXED else "days" if self.unit in ("day", "week") else "months"

    @property
    def size(self) -> int:
        """In milliseconds, days or months by kind."""
        if self.kind == "fixed":
            return self.n * FIXED[self.unit][0]
        return self.n * {"day": 1, "week": 7, "month": 1, "year": 12}[self.unit]

    @property
    def self_aligned(self) -> bool:
        """Period starts do not depend on the first key: one hour, day, month or year."""
        return self.n == 1 and self.unit != "week"

    def millis(self) -> int:
        """Length from the epoch on, without a zone."""
        if self.kind == "months":
            months = self.size
            year, month = 1970 + months // 12, months % 12
            import datetime

            return int(datetime.datetime(year, month + 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)
        return self.size * (1 if self.kind == "fixed" else DAY)


def local(key: Column, zone: str) -> Column:
    """Wall-clock timestamp of an epoch-ms key in a zone."""
    instant = F.timestamp_millis(key)
    return instant if zone == "UTC" else F.from_utc_timestamp(instant, zone)


def to_key(wall: Column, zone: str) -> Column:
    """Epoch ms of a wall-clock date or timestamp in a zone; a time that a clock change skips moves on."""
    wall = wall.cast("timestamp")
    return F.unix_millis(wall if zone == "UTC" else F.to_utc_timestamp(wall, zone))


def round_down(key: Column, period: Period, zone: str = "UTC") -> Column:
    """The period boundary at or before ``key``: multiples are counted inside the enclosing unit."""
    if period.n == 0:
        return F.lit(None).cast("long")
    wall = local(key, zone)
    if period.kind == "fixed":
        around = F.pmod(F.unix_millis(wall), F.lit(FIXED[period.unit][1]))
        return key - F.pmod(around, F.lit(period.size))
    if period.kind == "days":
        return to_key(F.to_date(wall), zone)
    if period.unit == "month":
        month = F.greatest(F.floor(F.month(wall) / period.n) * period.n, F.lit(1)).cast("int")
        return to_key(F.make_date(F.year(wall), month, F.lit(1)), zone)
    return to_key(F.make_date(F.year(wall), F.lit(1), F.lit(1)), zone)


def bucket_index(key: Column, anchor: Column, period: Period, zone: str = "UTC") -> Column:
    """Number of whole periods from ``anchor`` (a period boundary) to ``key``."""
    if period.kind == "fixed":
        return F.floor((key - anchor) / period.size)
    if period.kind == "days":
        return F.floor(F.datediff(F.to_date(local(key, zone)), F.to_date(local(anchor, zone))) / period.size)
    months = lambda c: F.year(c) * 12 + F.month(c)
    return F.floor((months(local(key, zone)) - months(local(anchor, zone))) / period.size)


def bucket_start(index: Column, anchor: Column, period: Period, zone: str = "UTC") -> Column:
    """First key of the ``index``-th period from ``anchor``."""
    if period.kind == "fixed":
        return anchor + index * period.size
    day = F.to_date(local(anchor, zone))
    if period.kind == "days":
        return to_key(F.date_add(day, (index * period.size).cast("int")), zone)
    return to_key(F.add_months(day, (index * period.size).cast("int")), zone)


def period_starts(start: Column, until: Column, period: Period, zone: str = "UTC") -> Column:
    """Array of the period starts from the one at or before ``start`` up to ``until``, for short ranges; ``spans.period_starts`` gives rows."""
    anchor = round_down(start, period, zone)
    last = bucket_index(until - 1, anchor, period, zone)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: bucket_start(k, anchor, period, zone)))


def friendly(millis: int) -> Period:
    """A round period near a duration: rounded up to the next listed size, a power of ten beyond the list."""
    for longest, unit_ms, unit, sizes in FRIENDLY:
        if longest is None or millis <= longest:
            value = millis // unit_ms
            size = next((s for s in sizes if value <= s), None)
            return Period(size if size is not None else 10 ** (len(str(value)) - 1), unit)
    raise AssertionError


def friendly_size(millis: Column) -> tuple[Column, Column]:
    """(n, unit) columns of ``friendly`` for a column of durations."""
    n, unit = F.lit(None).cast("long"), F.lit(None).cast("string")
    for longest, unit_ms, name, sizes in reversed(FRIENDLY):
        value = F.floor(millis / unit_ms)
        own = F.pow(F.lit(10), F.length(value.cast("string")) - 1).cast("long")
        for s in reversed(sizes):
            own = F.when(value <= s, F.lit(s)).otherwise(own)
        fits = F.lit(True) if longest is None else millis <= longest
        n, unit = F.when(fits, own).otherwise(n), F.when(fits, F.lit(name)).otherwise(unit)
    return n, unit
