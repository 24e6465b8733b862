"""Request types: key ranges and groupings. Keys are epoch milliseconds, ranges are half-open."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.functions.period import Period



@dataclass(frozen=True)
class SeriesRange:
    """[start, until) of keys; either end may be missing; ``limit`` caps the items of a half-bounded range."""

    start: int | None = None
    until: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Grouping:
    """How a range is cut into parts: at most one of the four ways; none makes a range one part.

    ``max_parts`` (a server would ask for 3000) keeps the periods that a series and range visits first, empty ones
    counted; without it nothing is left out.
    """

    period: str | None = None
    count: int | None = None
    into_counted: int | None = None
    into_duration: int | None = None
    zone: str = "UTC"
    empties: bool = False
    max_parts: int | None = None

    def __post_init__(self):
        given = [n for n in ("period", "count", "into_counted", "into_duration") if getattr(self, n) is not None]
        if len(given) > 1:
            raise ValueError(f"give one grouping, not {' and '.join(given)}")
        for n in ("count", "into_counted", "into_duration", "max_parts"):
            if getattr(self, n) is not None and getattr(self, n) < 1:
                raise ValueError(f"{n} must be at least 1")
        if self.period is not None:
            Period.parse(self.period)
