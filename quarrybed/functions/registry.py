"""Functions for SQL: every decoder as a table function, and the scalar ones that SQL lacks."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarrybed.sources import decoders  # noqa: F401
from quarrybed.sources.decoders import DECODERS


def _table_function(name: str):
    decoder, schema = DECODERS[name]
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).names

    class Decode:
        def eval(self, data: bytes):
            for row in decoder(bytes(data)) if data else ():
                yield tuple(row.get(f) for f in fields)

    return udtf(Decode, returnType=schema)


def register(spark: SparkSession) -> list[str]:
    """``decode_<name>(bytes)`` for each decoder, to be used as ``FROM files, LATERAL decode_usn_journal(content)``."""
    names = []
    for name in sorted(DECODERS):
        spark.udtf.register(f"decode_{name}", _table_function(name))
        names.append(f"decode_{name}")
    return names
