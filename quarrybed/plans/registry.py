"""Where the catalogue's queries are registered: a function under its name, with the SQL it is compared with, or without."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Arguments of ``translate`` that fold ASCII letters.
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f.__name__)
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def cases(expr: str, names: dict, otherwise: str) -> str:
    """A CASE over the codes of a label table."""
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {otherwise} END"


def entries(spark: SparkSession, d: str, *cols: Column | str) -> DataFrame:
    """File system entries, each once, with the columns named. Deliveries of an entry repeat its content, so only what is
    asked for is read and compared."""
    return table(spark, d, "filesystem_entries").select("entry_id", *cols).dropDuplicates(["entry_id"])


ENTRIES = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM filesystem_entries)"


def little(c: Column, n: int) -> Column:
    """A whole number as ``n`` little-endian bytes."""
    digits = F.right(F.lpad(F.hex(c.cast("bigint")), 16, "0"), F.lit(2 * n))
    return F.unhex(F.regexp_replace(digits, "^" + "(..)" * n + "$", "".join(f"${n - i}" for i in range(n))))


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def utf16(c: Column | str) -> Column:
    return F.encode(c, "UTF-16LE")
