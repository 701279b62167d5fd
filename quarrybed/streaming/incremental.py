"""Incremental processing: what is new, committed results replaced per source, attempts kept, and a stream that does it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrybed.session import exists, stored


def replace_by_source(rows: DataFrame, path: str, source: str = "source_id", buckets: int = 64, files: int = 8) -> None:
    """Write derived rows so that each source present replaces its earlier rows, and other sources stay.

    Partitions are ``buckets`` of sources, a number that stays with the table; the buckets touched are read, merged and
    overwritten, so a rerun gives the same table. A bucket is written by up to ``files`` tasks, so a large source is no one's burden.
    """
    spark = rows.sparkSession
    new = rows.withColumn("source_bucket", F.pmod(F.xxhash64(source), F.lit(buckets)).cast("int"))
    if exists(spark, path):
        old = spark.read.schema(new.schema).parquet(path)
        touched = new.select("source_bucket").distinct()
        kept = old.join(F.broadcast(touched.limit(buckets)), "source_bucket", "left_semi").join(new.select(source).distinct(), source, "left_anti")
        new = stored(new.unionByName(kept))  # the table is read and written in one go
    spread = F.pmod(F.xxhash64(*new.columns), F.lit(files))
    new.repartition("source_bucket", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_bucket").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: the newest by ``version``, incoming before existing where equal."""
    both = existing.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__in")).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest if c != "__in"])


def commit_plan(attempts: DataFrame, committed: DataFrame) -> DataFrame:
    """Per source what stands after an attempt: a failed one keeps the earlier result and leaves its diagnostic.

    ``attempts``: source_id, status, diagnostic; ``committed``: source_id, status.
    """
    c = committed.select("source_id", F.col("status").alias("earlier"))
    j = attempts.join(c, "source_id", "full")
    good = F.col("status").isin("parsed", "partial")
    return j.select("source_id", F.when(good, F.col("status")).otherwise(F.coalesce("earlier", "status")).alias("standing"), good.alias("replaced"), F.when(~good, F.col("diagnostic")).alias("last_diagnostic"))


def stage_ordinals(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Zero-based ordinals within each source, by a fixed order, as twenty digits."""
    n = F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1
    return rows.withColumn("ordinal", F.format_string("%020d", n.cast("bigint")))


def run_stream(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "source_id") -> StreamingQuery:
    """Process the files that arrived since the last run and stop: each batch replaces the rows of its sources.

    The checkpoint remembers what was read; a batch repeated after a failure overwrites the same rows.
    """

    def each(batch: DataFrame, _: int) -> None:
        rows = work(batch)
        if not rows.isEmpty():
            replace_by_source(rows, sink, key)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per kind in windows of event time; events later than ``late`` are not waited for in a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("records"))
