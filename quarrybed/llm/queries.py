"""The queries of the text problems over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.functions import usn
from quarrybed.llm import mixing, packing
from quarrybed.llm.mailtext import mail_lines, new_text
from quarrybed.llm.pii import detect_pii, redact_pii
from quarrybed.llm.quality import quality_stats, text_classes
from quarrybed.llm.runs import collapse_runs, collapse_similar
from quarrybed.llm.tokens import token_sizes
from quarrybed.session import stored, table

GAP_TICKS = 600 * 10_000_000
HEADERS = ["from_header", "to_header", "cc_header", "reply_to"]


def _mails(spark: SparkSession, d: str) -> DataFrame:
    """Each message once: repeated deliveries have the same content."""
    return table(spark, d, "rfc822_metadata").dropDuplicates(["entry_id"])


def _lexicon(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    return [tuple(r) for r in table(spark, d, "name_lexicon").select("name_part", "part_kind").where("name_part is not null").collect()]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    spans = detect_pii(table(spark, d, "rfc822_metadata"), "entry_id", ["body_preview", "subject"], _lexicon(spark, d), HEADERS, "body_truncated", "body_preview")
    spans = spans.where(F.col("pii_type").isin("email", "phone", "id_number", "street_address", "person_name"))
    return spans.where("record_id is not null").select(F.col("record_id").alias("entry_id"), "field_name", "pii_type", "pii_value").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_pii(_mails(spark, d), "entry_id", ["body_preview", "subject"], _lexicon(spark, d), HEADERS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mail_lines(table(spark, d, "rfc822_metadata")).where("label = 'new' and record_id is not null").select(F.col("record_id").alias("entry_id"), "line_no").distinct()


def p4_new_text(spark: SparkSession, d: str) -> DataFrame:
    return new_text(table(spark, d, "rfc822_metadata")).withColumnRenamed("record_id", "entry_id")


def _events(spark: SparkSession, d: str) -> tuple:
    """The change journal as events: frame, entity, order, state and ticks."""
    rows = table(spark, d, "usn_records").select("evidence_id", "file_reference", "usn", "reason", "timestamp_utc")
    return rows, [F.col("evidence_id"), *usn.ref_parts("file_reference")], F.col("usn"), usn.core_reason(F.col("reason")), usn.ticks(F.col("timestamp_utc"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(*_events(spark, d), GAP_TICKS).select(F.col("k0").alias("evidence_id"), F.col("first_order").alias("first_usn"), F.col("last_order").alias("last_usn"), "event_count")


_NODE = "concat(cast(k2 as string), if(k1 = 3, ':', '-'), cast(k3 as string))"


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every run with its file, reason, count and duration."""
    r = collapse_runs(*_events(spark, d), GAP_TICKS)
    return r.select(F.col("k0").alias("evidence_id"), F.expr(_NODE).alias("node_ref"), F.col("state").alias("reason"), F.array_join(usn.reason_flags(F.col("state")), ",").alias("reason_flags"), F.col("first_order").alias("first_usn"), F.col("last_order").alias("last_usn"), "event_count", F.call_function("div", F.col("last_ticks") - F.col("first_ticks"), F.lit(10).cast("bigint")).alias("duration_micros"))


def p2_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose reasons differ from the first one's in at most one flag."""
    r = collapse_similar(*_events(spark, d), GAP_TICKS, 1)
    return r.select(F.col("k0").alias("evidence_id"), F.expr(_NODE).alias("node_ref"), F.col("state").alias("anchor_reason"), F.col("first_order").alias("first_usn"), F.col("last_order").alias("last_usn"), "event_count")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return stored(token_sizes(table(spark, d, "documents"), "doc_id", "text", ["source"]))


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int, int]]:
    return [tuple(r) for r in table(spark, d, "container_specs").select("container_kind", "capacity_tokens", "separator_tokens").collect()]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), _containers(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d), _containers(spark, d))


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float, int]]:
    return [tuple(r) for r in table(spark, d, "source_targets").select("source", "target_share", "max_repeats").collect()]


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(spark, d)
    return packing.violations(packing.pack(sizes, _containers(spark, d)), sizes, _containers(spark, d))


def _plan(spark: SparkSession, d: str) -> tuple:
    """The sizes, and the plan of a mixture of as many tokens as the corpus has: scarce sources are clamped at their caps and
    what they lack is spread over the others."""
    sizes = _sizes(spark, d)
    return sizes, mixing.plan_mix(sizes, _targets(spark, d), float(sizes.agg(F.sum("n_tokens")).first()[0] or 0))


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, with how often each is used."""
    return mixing.mix(*_plan(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that ``p9_mixed`` reaches."""
    sizes, plan = _plan(spark, d)
    return mixing.share_report(mixing.mix(sizes, plan), plan)


def p9_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture that meets every target share."""
    sizes = _sizes(spark, d)
    plan = mixing.plan_mix(sizes, _targets(spark, d))
    return mixing.share_report(mixing.mix(sizes, plan), plan)


def p9_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, whether none is used beyond its cap, and whether its tokens are the planned ones but for one
    document."""
    sizes, plan = _plan(spark, d)
    given = F.create_map(*[F.lit(x) for s, _, _, _, g in plan for x in (s, float(g))])[F.col("source")]
    cap = F.create_map(*[F.lit(x) for s, _, _, c, _ in plan for x in (s, c)])[F.col("source")]
    m = mixing.mix(sizes, plan).groupBy("source").agg(F.count("*").alias("documents"), F.max("repeats").alias("most"), F.min("repeats").alias("least"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.max("n_tokens").alias("largest"))
    return m.select("source", "documents", ((F.col("most") <= cap) & (F.col("least") >= 0)).alias("within_cap"), (F.abs(F.col("t") - given) <= F.col("largest")).alias("as_planned"))


def _common(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in table(spark, d, "common_words").select("word").collect()]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    classes = text_classes(table(spark, d, "documents"), _common(spark, d))
    return classes.where("text_class <> 'prose' and record_id is not null").select(F.col("record_id").alias("doc_id"), "text_class")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality_stats(table(spark, d, "documents"), _common(spark, d)).withColumnRenamed("record_id", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_collapsed, p2_near, p4_found, p4_new_text, p8_packed, p8_fill, p8_violations, p9_mixed, p9_shares, p9_exact_shares, p9_violations, p10_found, p10_stats)}


_REF = "CASE WHEN file_reference.ref_version = 'v3' THEN file_reference.high || ':' || file_reference.low ELSE file_reference.entry || '-' || file_reference.sequence END"
_EVENTS = f"""
WITH RECURSIVE r AS (SELECT DISTINCT evidence_id, {_REF} AS v, usn, reason & {usn.KNOWN & ~usn.CLOSE} AS s, timestamp_utc AS z FROM usn_records),
t AS (SELECT *, epoch(strptime(substr(z, 1, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT * 10000000 + rpad(regexp_extract(z, '[.]([0-9]+)Z', 1), 7, '0')::BIGINT AS k, row_number() OVER (PARTITION BY evidence_id, v ORDER BY usn) AS i FROM r)"""
_RUNS = _EVENTS + f""",
l AS (SELECT *, CASE WHEN lag(s) OVER w = s AND coalesce(abs(k - lag(k) OVER w) <= {GAP_TICKS}, true) THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY evidence_id, v ORDER BY usn)),
g AS (SELECT *, sum(n) OVER (PARTITION BY evidence_id, v ORDER BY usn) AS run FROM l)
"""
_FLAGS = ", ".join(f"CASE WHEN s & {b} <> 0 THEN '{n}' END" for b, n in usn.REASONS.items())


def oracle_sql() -> dict:
    """SQL for what it can say; other operators are tested against brute force."""
    return {
        "p2_found": _RUNS + "SELECT evidence_id, min(usn) AS first_usn, max(usn) AS last_usn, count(*) AS event_count FROM g GROUP BY evidence_id, v, run HAVING count(*) > 1",
        "p2_collapsed": _RUNS + f""", c AS (SELECT evidence_id, v, s, min(usn) AS first_usn, max(usn) AS last_usn, count(*) AS event_count, arg_max(k, usn) FILTER (WHERE k IS NOT NULL) - arg_min(k, usn) FILTER (WHERE k IS NOT NULL) AS ticks FROM g GROUP BY evidence_id, v, s, run HAVING count(*) > 1)
SELECT evidence_id, v AS node_ref, s AS reason, concat_ws(',', {_FLAGS}) AS reason_flags, first_usn, last_usn, event_count, CASE WHEN ticks < 0 THEN -(-ticks // 10) ELSE ticks // 10 END AS duration_micros FROM c""",
        "p8_violations": "SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS tokens_off, 0 AS slots_taken_twice, 0 AS cut_in_vain FROM container_specs",
        "p9_violations": "SELECT source, count(*) AS documents, true AS within_cap, true AS as_planned FROM documents WHERE source IN (SELECT source FROM source_targets) GROUP BY 1",
        "p2_near": _EVENTS + f""",
w(evidence_id, v, i, usn, anchor, run, k) AS (SELECT evidence_id, v, i, usn, s, usn, k FROM t WHERE i = 1
 UNION ALL SELECT e.evidence_id, e.v, e.i, e.usn, CASE WHEN e.same THEN e.anchor ELSE e.s END, CASE WHEN e.same THEN e.run ELSE e.usn END, e.k FROM (
  SELECT t.*, w.anchor, w.run, coalesce(bit_count(xor(t.s, w.anchor)) <= 1, false) AND coalesce(abs(t.k - w.k) <= {GAP_TICKS}, true) AS same FROM w JOIN t ON t.evidence_id = w.evidence_id AND t.v = w.v AND t.i = w.i + 1) e)
SELECT evidence_id, v AS node_ref, min(anchor) AS anchor_reason, run AS first_usn, max(usn) AS last_usn, count(*) AS event_count FROM w GROUP BY evidence_id, v, run HAVING count(*) > 1""",
    }
