"""Tables of SQLite files as frames: a Python data source that reads a private copy, side files included.

The original is never opened for writing: the database and its ``-wal``, ``-shm`` and ``-journal`` files are copied to a
task's own folder, so that a pending journal replays there.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAGIC = b"SQLite format 3\x00"
#: Tables that tell a browser family.
FAMILIES = {"chromium": {"urls", "visits"}, "firefox": {"moz_places", "moz_historyvisits"}, "safari": {"history_items", "history_visits"}}


class private_copy:
    """A context in which a copy of the database is open; it is gone afterwards.

    The database library works on files, so the copy lies in the reader's own temporary folder while it is read; nothing
    that outlives the task is kept there.
    """

    def __init__(self, path: str):
        self.path = path

    def __enter__(self) -> sqlite3.Connection:
        self.dir = tempfile.mkdtemp(prefix="qb-sqlite-")
        copy = os.path.join(self.dir, "db")
        shutil.copyfile(self.path, copy)
        for side in ("-wal", "-shm", "-journal"):
            if os.path.exists(self.path + side):
                shutil.copyfile(self.path + side, copy + side)
        self.db = sqlite3.connect(copy)
        self.db.text_factory = lambda b: b.decode("utf-8", "replace")
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        shutil.rmtree(self.dir, ignore_errors=True)


def tables_of(path: str) -> set[str]:
    """Names of the tables, lower case; none if the file is no readable database."""
    try:
        with open(path, "rb") as f:
            if f.read(16) != MAGIC:
                return set()
        with private_copy(path) as db:
            return {r[0].lower() for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
    except (sqlite3.Error, OSError):
        return set()


def browser_family(path: str) -> str | None:
    """chromium, firefox or safari; None if none or more than one fits."""
    have = tables_of(path)
    fits = [f for f, need in FAMILIES.items() if need <= have]
    return fits[0] if len(fits) == 1 else None


_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("TEXT", "string"), ("CLOB", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "bigint"))


def table_schema(path: str, name: str) -> str:
    """The columns a table declares, by SQLite's affinity rules; columns without a type are text. '' if it is absent."""
    with private_copy(path) as db:
        rows = db.execute(f'PRAGMA table_info("{name}")').fetchall()
    kind = lambda t: next((s for k, s in _TYPES if k in t.upper()), "string")
    return ", ".join(f"`{r[1]}` {kind(r[2] or '')}" for r in rows)


class Rowids(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", 1))

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids; tables without them are one range."""
        if self.parts > 1:
            try:
                with private_copy(self.path) as db:
                    lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
                if lo is not None:
                    step = -(-(hi - lo + 1) // self.parts)
                    return [Rowids(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]
            except sqlite3.Error:
                pass
        return [Rowids(None, None)]

    def read(self, partition: Rowids) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        casts = {"bigint": int, "double": float, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}

        def fit(v, kind):
            if v is None:
                return None
            try:
                return casts[kind](v)
            except (TypeError, ValueError):
                return None

        with private_copy(self.path) as db:
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            if not have:
                return
            # a column that the file lacks is null
            cols = ", ".join(f'"{f.name}"' if f.name in have or f.name == "rowid" else f'NULL AS "{f.name}"' for f in self.schema.fields)
            where = f" WHERE rowid BETWEEN {partition.lo} AND {partition.hi}" if partition.lo is not None else ""
            kinds = [f.dataType.simpleString() for f in self.schema.fields]
            cursor = db.execute(f'SELECT {cols} FROM "{self.table}"{where}')
            while rows := cursor.fetchmany(5_000):
                yield pa.RecordBatch.from_arrays([pa.array([fit(r[i], k) for r in rows], t) for i, (k, t) in enumerate(zip(kinds, arrow.types))], schema=arrow)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_copy").option("path", …).option("table", …)``; ``partitions`` splits by row id."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_copy"

    def schema(self) -> str:
        return table_schema(self.options["path"], self.options["table"]) or "absent string"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_table(spark: SparkSession, path: str, name: str, schema: str | None = None, partitions: int = 1) -> DataFrame:
    """One table of a SQLite file. With ``schema``, missing columns are null and a missing table is empty."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_copy").option("path", path).option("table", name).option("partitions", str(partitions))
    return (reader.schema(schema) if schema else reader).load()


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column, or nulls where a frame lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind).alias(name)
