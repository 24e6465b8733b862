"""Scalar functions on columns: keys, text values, flags, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"
_INTEGER = r"^[+-]?\d+$"


def parse_key_ms(text: Column) -> Column:
    """Key of a text: ISO date with milliseconds (UTC), else an integer as it is, else decimal seconds; null else."""
    iso = F.when(text.rlike(_ISO), F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))))
    integer = F.when(text.rlike(_INTEGER), text.try_cast("long"))
    seconds = F.when(~text.rlike(_INTEGER), (text.try_cast("double") * 1000).cast("long"))
    return F.coalesce(iso, integer, seconds)


def iso_to_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def ms_to_minute_text(key: Column) -> Column:
    """ISO text to the minute, UTC."""
    return F.date_format(F.timestamp_millis(key), "yyyy-MM-dd'T'HH:mm")


def ms_to_date(key: Column) -> Column:
    return F.timestamp_millis(key)


def parse_value(text: Column, kind: str) -> Column:
    """A text as boolean, char, short, int, long, double, string, json, flags or blob; null where it is none."""
    if kind in ("boolean", "bool"):
        return F.when(text.isin("true", "True", "TRUE"), True).when(text.isin("false", "False", "FALSE"), False)
    if kind == "char":
        return F.when(F.length(text) > 0, F.left(text, F.lit(1)))
    if kind == "json":
        return F.when(F.try_parse_json(text).isNotNull(), text)
    if kind == "blob":
        return F.unbase64(F.when(text.rlike(r"^[A-Za-z0-9+/\s]*={0,2}\s*$"), text))
    if kind == "string":
        return text
    return text.try_cast({"short": "short", "int": "int", "long": "long", "flags": "long", "double": "double"}[kind])


def flag_value(flags: Column, position: int) -> Column:
    """None unless the flag at ``position`` is present, else its value."""
    has = F.shiftrightunsigned(flags, 2 * position).bitwiseAND(F.lit(1)) == 1
    return F.when(has, F.shiftrightunsigned(flags, 2 * position + 1).bitwiseAND(F.lit(1)) == 1)


def set_flag(flags: Column, position: int, value: Column) -> Column:
    """Set the presence bit and, for true, the value bit; a true bit is never cleared; null leaves all."""
    present, true = 1 << (2 * position), 1 << (2 * position + 1)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    bits = F.when(value, F.lit(signed(present | true))).when(~value, F.lit(signed(present))).otherwise(F.lit(0)).cast("long")
    return F.coalesce(flags, F.lit(0).cast("long")).bitwiseOR(bits)


def last_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_part(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def suffix(text: Column) -> Column:
    """What follows the last dot, empty without one."""
    return F.regexp_extract(text, r"\.([^.]*)$", 1)


def grouped_integer(n: Column) -> Column:
    return F.format_number(n, 0)


def split_path(path: Column) -> tuple[Column, Column]:
    """(dataset, column) of a path: the last slash parts them; without one the dataset is ``default``."""
    dataset = F.when(F.locate("/", path) == 0, "default").otherwise(F.regexp_replace(path, r"/[^/]*$", ""))
    dataset = F.when(dataset == "", "default").otherwise(dataset)
    column = last_part(path)
    return F.when(column != "", dataset), F.when(column != "", column)


def entity_path(path: Column) -> Column:
    """All before the last slash; null for a path without one."""
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, r"/[^/]*$", ""))


def entity_key(path: Column) -> Column:
    """The look-up key: the prefix where there is one slash, else the second to last part of the entity path."""
    entity = entity_path(path)
    parts = F.split(entity, "/")
    return F.when(F.size(parts) == 1, entity).when(F.size(parts) > 1, F.element_at(parts, -2))


def to_text(value: Column) -> Column:
    """A string, long, int, double or boolean as text."""
    return value.cast("string")


def json_text(value: Column) -> Column:
    """A JSON text in its canonical form, through VARIANT; null where it is no JSON."""
    return F.to_json(F.try_parse_json(value))


class PathFormat:
    """How paths name things; another format overrides these column expressions."""

    def category(self, path: Column) -> Column:
        return path

    def split(self, path: Column) -> tuple[Column, Column]:
        return split_path(path)

    def entity(self, path: Column) -> Column:
        return entity_path(path)

    def lookup_key(self, path: Column) -> Column:
        return entity_key(path)

    def below(self, path: Column, prefix: str) -> Column:
        return path.startswith(prefix.rstrip("/") + "/")
