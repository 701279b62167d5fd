"""Byte streams of images and files as overlapping chunks, and listings of folders."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CHUNK = 4 * 1024 * 1024
#: Bytes before and after a chunk that previews need.
CONTEXT = 8


class Range(InputPartition):
    def __init__(self, at: int, own: int, lead: int, read: int):
        self.at, self.own, self.lead, self.read = at, own, lead, read


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", CHUNK))
        self.overlap = int(options.get("overlap", 0))
        self.source = int(options.get("sourceId", 0))

    def partitions(self) -> list[InputPartition]:
        n = os.path.getsize(self.path)
        return [Range(a, min(self.chunk, n - a), min(a, CONTEXT), min(self.chunk + self.overlap + CONTEXT, n - a)) for a in range(0, n, self.chunk)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(partition.at - partition.lead)
            data = f.read(partition.lead + partition.read)
        yield pa.RecordBatch.from_arrays([pa.array([self.source], pa.int64()), pa.array([partition.at], pa.int64()), pa.array([partition.own], pa.int64()), pa.array([partition.lead], pa.int64()), pa.array([data], pa.binary())], ["source_id", "chunk_offset", "own_length", "lead", "bytes"])


class RawImageSource(DataSource):
    """``spark.read.format("raw_image")``: one task per chunk; each carries a few bytes before it and the ``overlap`` that follows."""

    @classmethod
    def name(cls) -> str:
        return "raw_image"

    def schema(self) -> str:
        return "source_id bigint, chunk_offset bigint, own_length bigint, lead bigint, bytes binary"

    def reader(self, schema: StructType) -> RawReader:
        return RawReader(self.options)


def read_image(spark: SparkSession, path: str, overlap: int = 0, chunk: int = CHUNK, source_id: int = 0) -> DataFrame:
    spark.dataSource.register(RawImageSource)
    return spark.read.format("raw_image").option("path", path).option("overlap", str(overlap)).option("chunk", str(chunk)).option("sourceId", str(source_id)).load()


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, size and time. Contents are not read, the column is pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size_bytes"), "modificationTime")


KINDS = ("auto", "file", "folder", "image")


def evidence_kind(text: str) -> str:
    kind = text.strip().lower()
    if kind not in KINDS:
        raise ValueError(f"unknown kind of evidence: {text}")
    return kind


def evidence_kinds(text: Column) -> Column:
    """``evidence_kind`` of a column; unknown kinds are null."""
    kind = F.lower(F.trim(text))
    return F.when(kind.isin(*KINDS), kind)
