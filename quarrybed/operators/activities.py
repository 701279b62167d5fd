"""System activity: rows of an activities database to records with names, instants and what their payload says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.functions import labels, times

#: Texts of a payload that a record keeps, and its one number.
PAYLOAD = {"displayText": "display_text", "appDisplayName": "app_display_name", "description": "description", "contentUrl": "content_url", "userTimezone": "user_timezone", "reportingApp": "reporting_app"}
TIMES = {"start_time": "start_micros", "end_time": "end_micros", "last_modified_time": "modified_micros", "expiration_time": "expires_micros"}
#: The table and columns of an activities database.
TABLE = "Activity"
COLUMNS = {"Id": "activity_id", "AppId": "app_id", "AppActivityId": "app_activity_id", "ActivityType": "activity_type", "ActivityStatus": "activity_status", "ParentActivityId": "parent_activity_id", "Tag": "tag", "Group": "activity_group", "MatchId": "match_id", "StartTime": "start_time", "EndTime": "end_time", "LastModifiedTime": "last_modified_time", "ExpirationTime": "expiration_time", "Payload": "payload", "ClipboardPayload": "clipboard_payload"}


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """The activity table of a database file, under the names used here; columns that it lacks are null."""
    from quarrybed.sources.sqlite import column_or_null, read_table

    rows = read_table(spark, path, TABLE)
    return rows.select(*[column_or_null(rows, c, "bigint" if n in ("activity_type", "activity_status") else "string").alias(n) for c, n in COLUMNS.items()])


def payload_fields(payload: Column) -> dict[str, Column]:
    """What a payload says, by field; all null unless it is a JSON object. ``activationUrl`` stands in for a missing ``activationUri``."""
    v = F.when(F.trim(payload).startswith("{"), F.try_parse_json(payload))
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    out = {n: text(k) for k, n in PAYLOAD.items()}
    out["activation_uri"] = F.coalesce(text("activationUri"), text("activationUrl"))
    out["active_seconds"] = F.try_variant_get(v, "$.activeDurationSeconds", "bigint")
    out["readable"] = v.isNotNull()
    return out


def activity_records(rows: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """One record per row: type name, application and platform, four instants and the payload's fields."""
    app = labels.application_of(F.col("app_id"))
    out = rows.select(id_col, "activity_type", labels.label(F.col("activity_type"), labels.ACTIVITY_TYPES, "Type {}").alias("type_name"), app.alias("__app"), *[times.timeline_micros(F.col(c)).alias(n) for c, n in TIMES.items()], *[c.alias(n) for n, c in payload_fields(F.col("payload")).items()])
    return out.withColumn("application", F.col("__app.application")).withColumn("platform", F.col("__app.platform")).drop("__app")


def type_counts(rows: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """Different records per type; a null type counts as -1."""
    once = rows.select(id_col, F.coalesce("activity_type", F.lit(-1)).alias("activity_type")).distinct()
    return once.groupBy("activity_type").agg(F.count("*").alias("records"))
