"""Transforms, reducers and selectors by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.model import Grouping, SeriesRange
from tidemark.operators import intervals, ranges, reduce as reducing

Transform = Callable[[DataFrame, dict], DataFrame]
_CUSTOM: dict[str, Transform] = {}
_SELECTORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}
_TYPES: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column], Column]]] = {}


def register_reducer(name: str, aggregate: Callable[[Column], Column]) -> None:
    reducing.REDUCERS[name] = aggregate


def register_transform(name: str, transform: Transform) -> None:
    _CUSTOM[name] = transform


def register_selector(name: str, selector: Callable[[SparkSession, dict], DataFrame]) -> None:
    _SELECTORS[name] = selector


def selection_by(spark: SparkSession, name: str, params: dict) -> DataFrame:
    if name not in _SELECTORS:
        raise LookupError(f"no selector {name!r}")
    return _SELECTORS[name](spark, params)


def register_type(name: str, spark_type: str, parse: Callable[[Column], Column], show: Callable[[Column], Column]) -> None:
    """A logical value type: its Spark type and how text becomes and shows it."""
    _TYPES[name] = (spark_type, parse, show)


def logical_type(name: str) -> tuple[str, Callable[[Column], Column], Callable[[Column], Column]]:
    if name not in _TYPES:
        raise LookupError(f"no value type {name!r}")
    return _TYPES[name]


def decoder_for(topic: str, decoders: Mapping[str, Callable[[DataFrame], DataFrame]] | Callable[[str], Callable]) -> Callable[[DataFrame], DataFrame]:
    found = decoders(topic) if callable(decoders) else decoders.get(topic)
    if found is None:
        raise LookupError(f"no decoder for topic {topic!r}")
    return found


def _ranges(params: dict) -> list[SeriesRange] | None:
    given: Sequence | None = params.get("ranges")
    return None if given is None else [r if isinstance(r, SeriesRange) else SeriesRange(**r) for r in given]


def run(name: str, df: DataFrame, params: dict | None = None, selection: DataFrame | None = None) -> DataFrame:
    """Run a transform: reduce*, Raw, KeyValueRanges, IntervalSum, OnOffIntervalSum (in any case), or a custom one.

    ``params["ranges"]`` are all applied, each with its range_id.  IntervalSum with ``columns`` puts these side by side.
    """
    params = dict(params or {})
    if selection is not None and name.lower() != "onoffintervalsum":
        df = df.join(selection.select("group_id", "column_path"), "column_path")
    by = tuple(params.get("by", ("group_id", "column_path") if selection is not None and name.lower() != "onoffintervalsum" else ("column_path",)))
    known = name.lower()
    if known.startswith("reduce"):
        options = {k: params[k] for k in ("period", "count", "into_counted", "into_duration", "zone", "empties", "max_parts") if k in params}
        return reducing.reduce(df, known.removeprefix("reduce"), Grouping(**options), _ranges(params), by)
    if known == "raw":
        return ranges.raw(df, _ranges(params), by)
    if known == "keyvalueranges":
        return reducing.key_value_ranges(df, by)
    if known == "intervalsum":
        options = (params.get("period"), params.get("zone", "UTC"))
        if "columns" in params:
            return intervals.interval_sum_across(df, params["columns"], *options, params.get("names"), ranges=_ranges(params))
        return intervals.interval_sum(df, *options, by, max_parts=params.get("max_parts"), ranges=_ranges(params))
    if known == "onoffintervalsum":
        if selection is None:
            raise ValueError("OnOffIntervalSum needs a selection of columns")
        return intervals.onoff_interval_sum(df, selection, params.get("period"), params.get("zone", "UTC"), _ranges(params), max_parts=params.get("max_parts"))
    if name in _CUSTOM:
        return _CUSTOM[name](df, params)
    raise LookupError(f"no transform {name!r}")
