"""The queries of the general data problems over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.functions import usn
from quarrybed.operators.hierarchy import ancestor_spans, build_trees, descendants
from quarrybed.operators.instants import resolve, zone_table
from quarrybed.operators.nested import flatten_distinct, flatten_records, read_table, write_tables
from quarrybed.operators.periods import gaps_between, merge_spans
from quarrybed.plans import problem_sql
from quarrybed.session import scratch_path, stored, table

DAY = 86_400 * 1_000_000


def abbreviations(spark: SparkSession, d: str) -> dict[str, int]:
    """The small fixed table of zone letters."""
    return {r[0].upper(): r[1] for r in table(spark, d, "zone_abbreviations").where("abbreviation is not null and offset_minutes is not null").collect()}


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    """evidence_id to zone. Spark chooses the join by the size it measures."""
    return table(spark, d, "evidence_sources").groupBy("evidence_id").agg(F.max("host_timezone").alias("host_timezone"))


def instants(spark: SparkSession, d: str) -> DataFrame:
    """source_table, entry_id, epoch_micros of every stated instant of the four tables, and what it rests on."""
    hosts, letters = _hosts(spark, d), abbreviations(spark, d)
    none = F.lit(None).cast("string")
    mail = table(spark, d, "rfc822_metadata").select(F.lit("rfc822_metadata").alias("source_table"), "entry_id", "evidence_id", F.col("date_header").alias("value"), none.alias("own_zone"))
    acts = table(spark, d, "activity").select(F.lit("activity").alias("source_table"), "entry_id", "evidence_id", F.col("start_time").alias("value"), F.get_json_object("payload", "$.userTimezone").alias("own_zone"))
    texts = mail.unionByName(acts).join(hosts, "evidence_id", "left")
    texts = resolve(texts, F.col("value"), "epoch_micros", [F.col("own_zone"), F.col("host_timezone")], letters, how="resolution")
    bins = table(spark, d, "recycle_bin_records").select(F.lit("recycle_bin_records").alias("source_table"), "entry_id", F.col("deletion_timestamp_filetime").alias("value"))
    shims = table(spark, d, "shimcache_entries").select(F.lit("shimcache_entries").alias("source_table"), "entry_id", F.col("raw_filetime").alias("value"))
    numbers = resolve(bins.unionByName(shims), F.col("value"), "epoch_micros", [], letters, numeric=True, how="resolution")
    cols = ["source_table", "entry_id", "epoch_micros", "resolution"]
    return texts.select(*cols).unionByName(numbers.select(*cols))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return instants(spark, d).where("epoch_micros is not null and entry_id is not null").select("source_table", "entry_id", "epoch_micros").distinct()


def p3_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each table state an instant outright, or a local time that is direct, ambiguous or nonexistent."""
    once = instants(spark, d).where("epoch_micros is not null").distinct()
    return once.groupBy("source_table", "resolution").agg(F.count("*").alias("records"))


def p5_edges(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each file: t, v, p, name."""
    rows = table(spark, d, "usn_records").select(F.col("evidence_id").alias("t"), usn.ref_text("file_reference").alias("v"), usn.ref_text("parent_reference").alias("p"), F.col("file_name").alias("name"), "usn")
    latest = rows.groupBy("t", "v").agg(F.max_by(F.struct("p", "name"), F.struct("usn", "p", "name")).alias("x"))
    return latest.select("t", "v", "x.p", "x.name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    trees = build_trees(p5_edges(spark, d))
    return trees.select(F.col("t").alias("evidence_id"), F.col("v").alias("node_ref"), F.col("root").alias("root_ref"), "depth", F.col("path").alias("full_path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    edges = p5_edges(spark, d)
    pairs = descendants(build_trees(edges), edges)
    return pairs.select(F.col("t").alias("evidence_id"), F.col("ancestor").alias("ancestor_ref"), F.col("descendant").alias("descendant_ref"), "distance")


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    """The ancestors of each file as intervals of chains, a few for each: all descendants in a result of linear size."""
    edges = p5_edges(spark, d)
    spans = ancestor_spans(build_trees(edges), edges)
    return spans.select(F.col("t").alias("evidence_id"), F.col("v").alias("node_ref"), F.col("chain").alias("chain_ref"), F.col("upto").alias("last_place"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten_distinct(table(spark, d, "filesystem_entries"), "entry_id", "metadata_json")
    return rows.withColumnRenamed("record_id", "entry_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The items' keys; what they hold is not written."""
    rows = flatten_records(table(spark, d, "filesystem_entries"), "entry_id", "metadata_json", payload=False)
    return rows.where("record_id is not null").select(F.col("record_id").alias("entry_id"), "parent_path", "item_path").distinct()


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """All items written by table in one pass, and one of the flat tables read with its schema."""
    path = scratch_path(spark, "tables")
    write_tables(flatten_distinct(table(spark, d, "filesystem_entries"), "entry_id", "metadata_json"), path)
    return read_table(spark, path, "message.recipients", "kind string, address string").withColumnRenamed("record_id", "entry_id")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """evidence_id, app_id, s, e of the activity rows that state a span."""
    hosts, letters = _hosts(spark, d), abbreviations(spark, d)
    rows = table(spark, d, "activity").where("activity_type = 6 and app_id is not null and evidence_id is not null")
    rows = rows.select("evidence_id", "app_id", "start_time", "end_time", F.get_json_object("payload", "$.userTimezone").alias("own_zone")).join(hosts, "evidence_id", "left")
    hints, zones = [F.col("own_zone"), F.col("host_timezone")], zone_table(spark)
    rows = resolve(rows, F.col("start_time"), "s", hints, letters, zones=zones).where("s is not null")
    rows = resolve(rows, F.col("end_time"), "e", hints, letters, zones=zones).where("s < e")
    return rows.select("evidence_id", "app_id", F.xxhash64("app_id").alias("h1"), F.xxhash64(F.lit(7), F.col("app_id")).alias("h2"), "s", "e")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    spans = stored(p7_spans(spark, d))  # read by both tiers
    # the long application text travels as two independent 64-bit hashes and returns at the end
    periods = merge_spans(spans, [F.col("evidence_id"), F.col("h1"), F.col("h2")], F.col("s"), F.col("e"))
    u = ["u0", "u1", "u2"]
    both = periods.select(*u, F.lit("period").alias("period_kind"), "lo", "hi").unionByName(gaps_between(periods, u, DAY).select(*u, F.lit("gap").alias("period_kind"), "lo", "hi"))
    apps = table(spark, d, "activity").where("activity_type = 6 and app_id is not null and evidence_id is not null").select("evidence_id", "app_id").distinct().select(F.col("evidence_id").alias("u0"), "app_id", F.xxhash64("app_id").alias("u1"), F.xxhash64(F.lit(7), F.col("app_id")).alias("u2"))
    return both.join(apps, u).select(F.col("u0").alias("evidence_id"), "app_id", "period_kind", F.col("lo").alias("start_micros"), F.col("hi").alias("end_micros"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_resolutions, p5_found, p5_descendants, p5_spans, p6_found, p6_items, p6_tables, p7_found)}


def oracle_sql() -> dict:
    """SQL of the problems that SQL can say at the size of the comparison."""
    return problem_sql.oracle_sql()
