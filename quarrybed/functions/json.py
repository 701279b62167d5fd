"""Column expressions over JSON text: paths, lenient values, objects changed and merged, arrays extended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(json: Column, path: str) -> Column:
    """The value at a path of keys joined by ``.``, as text; null if the text is no JSON or has no such value."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{path}", "string")


def first_of(json: Column, *paths: str) -> Column:
    """The first value that is there and not empty, in the order of the paths."""
    return F.coalesce(*[F.nullif(at(json, p), F.lit("")) for p in paths])


def lenient_number(json: Column, path: str) -> Column:
    """A whole number that is not negative, however it is written: 7, 7.9 (cut to 7) or "7"; else null."""
    text = F.trim(at(json, path))
    n = F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^[0-9.eE+-]+$"), F.floor(text.try_cast("double")).try_cast("bigint")))
    return F.when(n >= 0, n)


def parts(json: Column) -> Column:
    """The top keys of an object and their values as MAP<STRING, STRING>: texts as they are, others as JSON text."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def with_value(json: Column, key: str, value: Column) -> Column:
    """The object with one top key set, others kept; text that is no object counts as an empty one. Scalars become text."""
    rest = F.map_filter(parts(json), lambda k, _: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def merged(first: Column, second: Column) -> Column:
    """Both objects in one; where both have a key, the second's value stands. Null counts as an empty object."""
    a, b = parts(first), parts(second)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def appended(array: Column, item: Column) -> Column:
    """A JSON array of texts with one more at its end; null and unreadable arrays count as empty, a null item adds nothing."""
    items = F.coalesce(F.from_json(array, "array<string>"), F.array().cast("array<string>"))
    return F.to_json(F.when(item.isNull(), items).otherwise(F.array_append(items, item)))
