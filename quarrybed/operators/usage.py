"""System resource usage: provider tables united, ids resolved by the database's own dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybed.functions.text import app_of_usage_record
from quarrybed.functions.times import sentinel_date

COLUMNS = {"record_id": "bigint", "app_id": "bigint", "user_id": "bigint", "timestamp": "string", "bytes_sent": "bigint", "bytes_received": "bigint", "foreground_cycles": "bigint", "background_cycles": "bigint", "charge_level": "bigint"}


def usage_records(providers: dict[str, DataFrame], ids: DataFrame) -> DataFrame:
    """Records of all providers with application and user names. ``ids``: id, name.

    Columns a provider lacks are null; an id the dictionary lacks reads ``ID #n``; a user is named only by a security
    identifier; dates that mean none are null.
    """
    parts = [df.select(F.lit(name).alias("provider"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()]) for name, df in providers.items()]
    rows = reduce(DataFrame.unionByName, parts)
    apps = ids.groupBy(F.col("id").alias("app_id")).agg(F.min("name").alias("app_name"))
    users = ids.where(F.col("name").startswith("S-1-")).groupBy(F.col("id").alias("user_id")).agg(F.min("name").alias("user_sid"))
    out = rows.join(apps, "app_id", "left").join(users, "user_id", "left")
    named = F.coalesce(app_of_usage_record(F.col("app_name")), F.format_string("ID #%d", F.col("app_id")))
    return out.withColumn("app_name", F.when(F.col("app_id").isNotNull(), named)).withColumn("timestamp", sentinel_date(F.col("timestamp")))
