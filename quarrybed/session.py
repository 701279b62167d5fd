"""Session defaults and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quarrybed", master: str | None = None, **conf) -> SparkSession:
    """A session with the engine's defaults; settings given win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a case directory."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for local tests without it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    where = where or spark.sparkContext.getCheckpointDir()
    if where:
        return where
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; a cluster needs a shared folder")
    return os.path.join(tempfile.gettempdir(), "quarrybed-scratch")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system."""
    fs, where = _fs(spark, path)
    return fs.exists(where)


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{scratch_dir(spark)}/quarrybed-{kind}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)
    return path


def stored_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``stored`` together with how many rows meet a condition, counted while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(condition).alias("n")))
    return out, int(seen.get["n"] or 0)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: computed once, its lineage cut.

    It survives the loss of executors. ``release`` deletes it; what is left goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quarrybed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that ``stored`` gave and that nothing reads any more."""
    path = df.__dict__.get("_scratch")
    if path:
        fs, where = _fs(df.sparkSession, path)
        fs.delete(where, True)
