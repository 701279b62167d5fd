"""The query catalogue of the engine's own operators, with the SQL each is compared with.

Every query runs over its whole tables. ``query`` registers a function under its name together with its SQL, or without
where SQL cannot say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrybed import jobs
from quarrybed.functions import json, labels, text, times, usn
from quarrybed.operators import activities, artifacts, browser, carving, records, report, search
from quarrybed.plans.registry import ENTRIES, FOLD, QUERIES, SQL, cases, entries, little, query, raw
from quarrybed.session import table
from quarrybed.sources.decoders import decode
from quarrybed.streaming import incremental


def field(name: str):
    return json.at(F.col("metadata_json"), name)


def field_sql(name: str) -> str:
    return f"json_extract_string(try_cast(metadata_json AS JSON), '$.{name}')"


# Search ---------------------------------------------------------------------------------------------------------------


def document_entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as entries, and the text of those of known language as parsed segments, which cut through words."""
    docs = table(spark, d, "documents")
    found = docs.select(F.col("doc_id").alias("entry_id"), F.lit(1).cast("bigint").alias("evidence_id"), F.concat_ws("/", F.lit(""), "source", "doc_id").alias("logical_path"), F.format_string("%d.txt", "doc_id").alias("entry_name"), F.lit("file").alias("entry_kind"), F.lit("{}").alias("metadata_json"), F.col("text").cast("binary").alias("content_head"))
    pieces = F.regexp_extract_all("text", F.lit("(?s).{1,400}"), F.lit(0))
    segments = docs.where("lang is not null").select(F.col("doc_id").alias("entry_id"), F.lit("text").alias("parser_name"), F.lit("body").alias("part_name"), F.posexplode(pieces).alias("segment_index", "content"))
    return found, segments


@query(f"""
WITH e AS (SELECT doc_id, '/' || source || '/' || doc_id AS p, instr(translate('/' || source || '/' || doc_id, {FOLD}), 'report') > 0 AS by_path, lang IS NOT NULL AND instr(translate(text, {FOLD}), 'report') > 0 AS by_text, instr(translate(text, {FOLD}), 'report') > 0 AS by_content FROM documents)
SELECT CASE WHEN by_path THEN 0 WHEN by_text THEN 1 ELSE 2 END AS phase, doc_id AS entry_id, p AS logical_path, CASE WHEN by_path THEN 'path' WHEN by_text THEN 'parsed_content' ELSE 'content' END AS match_kind FROM e WHERE by_path OR by_text OR by_content""")
def deep_search_phases(spark: SparkSession, d: str) -> DataFrame:
    return search.deep_search(*document_entries(spark, d), "Report").select("phase", "entry_id", "logical_path", "match_kind")


@query(f"""
WITH e AS (SELECT doc_id, '/' || source || '/' || doc_id AS logical_path FROM documents WHERE instr(translate(text, {FOLD}), 'shadow copy') > 0)
SELECT doc_id AS entry_id, logical_path FROM e WHERE (logical_path, doc_id) > ('/chat_logs/5', 5) ORDER BY logical_path, doc_id LIMIT 51""")
def search_page_keyset(spark: SparkSession, d: str) -> DataFrame:
    """One page after a cursor: the limit is the feature, one row more says that there is a next page."""
    found = document_entries(spark, d)[0].where(text.contains_any([F.col("content_head").cast("string")], "shadow copy"))
    return records.keyset_page(found.select("entry_id", "logical_path"), ["logical_path", "entry_id"], ("/chat_logs/5", 5), 50)


@query(f"SELECT entry_id, logical_path FROM {ENTRIES} WHERE instr(translate(logical_path, {FOLD}), 'report') > 0 OR instr(translate(entry_name, {FOLD}), 'report') > 0 OR instr(translate(metadata_json, {FOLD}), 'report') > 0")
def path_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filesystem_entries").where(search.path_match("REPORT")).select("entry_id", "logical_path").distinct()


@query(f"SELECT entry_id, entry_name FROM {ENTRIES} WHERE translate(entry_name, {FOLD}) LIKE '%.pdf' OR translate(entry_name, {FOLD}) LIKE '%.t_t'")
def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    """The underscore of an extension is a wildcard."""
    return search.scope(table(spark, d, "filesystem_entries"), None, [".pdf", "t_t"]).select("entry_id", "entry_name").distinct()


@query("SELECT doc_id, CAST(octet_length(encode(left(text, instr(text, 'hashed again') - 1))) AS BIGINT) AS match_offset FROM documents WHERE instr(text, 'hashed again') > 0")
def content_offset(spark: SparkSession, d: str) -> DataFrame:
    """Byte offset of the first exact match, in texts of any characters."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.byte_find(F.col("text").cast("binary"), b"hashed again").alias("match_offset")).where("match_offset is not null")


@query("""
WITH t AS (SELECT doc_id, text, string_split(text, 'scan') AS parts FROM documents WHERE contains(text, 'scan')),
h AS (SELECT doc_id, text, array_to_string(parts[1:i], 'scan') AS before FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM t)),
o AS (SELECT doc_id, octet_length(encode(before)) AS pos, encode(text) AS b FROM h)
SELECT doc_id, CAST(pos AS BIGINT) AS match_offset, pos // 512 AS sector, 'hex' AS encoding, hex(b[greatest(pos - 7, 1):pos + 12]) AS preview FROM o""")
def raw_exact_hits(spark: SparkSession, d: str) -> DataFrame:
    """Matches of a byte pattern in chunks that overlap, with place and preview."""
    streams = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").cast("binary").alias("bytes"))
    hits = search.raw_search(search.chunked(streams, 4096, 3), "hex:" + b"scan".hex())
    return hits.select(F.col("source_id").alias("doc_id"), F.col("offset").alias("match_offset"), "sector", "encoding", F.replace("hex_preview", F.lit(" ")).alias("preview"))


@query(rf"""
WITH t AS (SELECT doc_id, translate(text, {FOLD}) AS f, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, string_split(f, 'shadow copy') AS parts FROM t WHERE contains(f, 'shadow copy')),
h AS (SELECT doc_id, array_to_string(parts[1:i], 'shadow copy') AS before FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM p)),
o AS (SELECT doc_id, before, 2 * (length(before) + len(regexp_extract_all(before, '[\x{{10000}}-\x{{10FFFF}}]'))) AS pos FROM h)
SELECT doc_id, CAST(pos AS BIGINT) AS match_offset, 22 AS match_length, 'utf16le' AS encoding, 1 AS encoding_rank, pos // 512 AS sector FROM o
UNION ALL SELECT doc_id, CAST(pos - 1 AS BIGINT), 22, 'utf16be', 2, (pos - 1) // 512 FROM o WHERE pos > 0 AND unicode(right(before, 1)) < 256""")
def raw_utf16_hits(spark: SparkSession, d: str) -> DataFrame:
    """Text in 16-bit characters, letters folded; a match in one byte order casts a shadow in the other, a byte before it."""
    streams = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.encode("text", "UTF-16LE").alias("bytes"))
    hits = search.raw_search(search.chunked(streams, 8192, 64), "Shadow Copy")
    return hits.select(F.col("source_id").alias("doc_id"), F.col("offset").alias("match_offset"), F.col("length").alias("match_length"), "encoding", "encoding_rank", "sector")


@query("""
WITH s AS (SELECT doc_id, n_chars % 5000 AS a, doc_id % 700 AS b FROM documents WHERE n_chars IS NOT NULL), o AS (SELECT *, a + 20 + b AS png, a + 20 + b + 20 + b AS bmp FROM s)
SELECT doc_id, a AS file_offset, CAST(20 AS BIGINT) AS length, 'jpg' AS extension, 'footer' AS basis, true AS definitive FROM o
UNION ALL SELECT doc_id, png, CAST(20 + b AS BIGINT), 'png', 'footer', true FROM o
UNION ALL SELECT doc_id, bmp, CAST(40 AS BIGINT), 'bmp', 'declared size', true FROM o
UNION ALL SELECT doc_id, bmp + 40, CAST(25 AS BIGINT), 'pdf', 'no footer', false FROM o
UNION ALL SELECT doc_id, bmp + 60, CAST(5 AS BIGINT), 'gz', 'end of stream', false FROM o""")
def carve_hits(spark: SparkSession, d: str) -> DataFrame:
    """Streams put together from files of known kinds: nested headers are hidden, footers need what follows them, chunks cut
    through files."""
    docs = table(spark, d, "documents").where("n_chars is not null")
    fill = lambda c, n: F.repeat(F.lit(c), n.cast("int")).cast("binary")
    a, b = F.col("n_chars") % 5000, F.col("doc_id") % 700
    bmp = F.concat(raw(b"BM"), little(F.lit(40), 4), F.repeat(F.lit("m"), 34).cast("binary"))
    data = F.concat(fill("x", a), raw(b"\xff\xd8\xff\xe0 GIF8 inside..\xff\xd9"), fill("y", b), raw(b"\x89PNG\r\n\x1a\n"), fill("z", b), raw(b"....IEND1234"), bmp, raw(b"%PDF-1.7 never close\x1f\x8b\x08zz"))
    found = carving.carve(docs.select(F.col("doc_id").alias("source_id"), data.alias("bytes")), 1024)
    return found.select(F.col("source_id").alias("doc_id"), F.col("offset").alias("file_offset"), "length", "extension", "basis", "definitive")


@query("""
SELECT doc_id, 512 * (1 + doc_id % 40) AS file_offset, CASE doc_id % 5 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'fat32' WHEN 2 THEN 'exfat' WHEN 3 THEN 'bitlocker' ELSE 'ext' END AS file_system FROM documents
WHERE NOT (512 * (1 + doc_id % 40) >= 4096 AND 512 * (1 + doc_id % 40) < 8192)""")
def sector_scan(spark: SparkSession, d: str) -> DataFrame:
    """File systems that begin at a sector of a stream, in gaps between partitions; half of a chunk lies before some."""
    docs = table(spark, d, "documents").select("doc_id")
    zeros = lambda n: F.repeat(F.lit("00"), n)
    boot = lambda at, name: F.concat(zeros(F.lit(at)), F.lit(name.hex()), zeros(F.lit(510 - at - len(name))), F.lit("55aa"), zeros(F.lit(1536)))
    k = F.col("doc_id") % 5
    volume = F.when(k == 0, boot(3, b"NTFS")).when(k == 1, boot(82, b"FAT32")).when(k == 2, boot(3, b"EXFAT")).when(k == 3, boot(3, b"-FVE-FS-")).otherwise(F.concat(zeros(F.lit(1080)), F.lit("53ef"), zeros(F.lit(966))))
    data = F.unhex(F.concat(zeros((F.lit(512) * (1 + F.col("doc_id") % 40)).cast("int")), volume))
    found = carving.lost_file_systems(docs.select(F.col("doc_id").alias("source_id"), data.alias("bytes")), size=1024)
    parts = spark.createDataFrame([(1, 4096, 4096)], "partition bigint, start_at bigint, size_at bigint")
    return carving.in_gaps(found, parts).select(F.col("source_id").alias("doc_id"), F.col("offset").alias("file_offset"), "file_system")


@query(f"""
WITH t AS (SELECT doc_id, doc_id % 3 AS k, translate(text, {FOLD}) AS f FROM documents WHERE text IS NOT NULL), h AS (SELECT *, left(f, instr(f, 'shadow copy') - 1) AS before, substr(f, instr(f, 'shadow copy') + 11, 1) AS after FROM t WHERE contains(f, 'shadow copy')),
p AS (SELECT doc_id, k, k = 2 AND after <> '' AND unicode(after) < 256 AS shadowed, CASE WHEN k = 0 THEN octet_length(encode(before)) ELSE 2 * (length(before) + len(regexp_extract_all(before, '[\\x{{10000}}-\\x{{10FFFF}}]'))) END AS pos FROM h)
SELECT doc_id, CAST(pos + CASE WHEN shadowed THEN 1 ELSE 0 END AS BIGINT) AS match_offset, CASE k WHEN 0 THEN 11 ELSE 22 END AS length, CASE WHEN k = 0 THEN 'ascii' WHEN k = 1 OR shadowed THEN 'utf16le' ELSE 'utf16be' END AS encoding FROM p""")
def content_earliest(spark: SparkSession, d: str) -> DataFrame:
    """The first match in content of any of three encodings."""
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "UTF-16BE"))
    m = table(spark, d, "documents").select("doc_id", search.earliest_match(data, "Shadow Copy").alias("m")).where("m is not null")
    return m.select("doc_id", F.col("m.offset").alias("match_offset"), "m.length", "m.encoding")


# Aggregates, categories, tree, timeline ---------------------------------------------------------------------------------


@query(f"SELECT coalesce({field_sql('artifact_kind')}, 'Uncategorized') AS category_main, entry_kind AS category_sub, count(*) AS entries FROM {ENTRIES} GROUP BY ALL")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.category_counts(entries(spark, d, field("artifact_kind").alias("main"), "entry_kind"), F.col("main"), F.col("entry_kind"))


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT source, doc_id, n AS place, total, greatest(total - 10, 0) AS omitted FROM r WHERE n <= 10""")
def category_topk_omitted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return records.bounded_listing(docs, ["source"], [F.desc("n_chars"), "doc_id"], 10).select("source", "doc_id", "place", "total", "omitted")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT o_custkey AS evidence_id, o_orderkey AS job_id, o_orderstatus AS status FROM r WHERE n = 1""")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("evidence_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    return records.latest_per_group(jobs, ["evidence_id"], ["o_orderdate", "job_id"]).select("evidence_id", "job_id", "status")


@query("""
WITH n AS (SELECT s.evidence_id, s.attach_status, count(e.entry_id) AS k FROM evidence_sources s LEFT JOIN (SELECT DISTINCT entry_id, evidence_id FROM filesystem_entries) e USING (evidence_id) GROUP BY 1, 2)
SELECT evidence_id, k AS entries_indexed, CASE WHEN k = 0 THEN 'Processing has not been run.' WHEN attach_status = 'attached' THEN 'All ' || k || ' entries were processed.' WHEN k > 30 THEN 'Processing stopped at its limit of 30 after ' || k || ' entries; the rest was not examined.' ELSE 'Processing failed after ' || k || ' entries.' END AS coverage, k > 0 AND attach_status <> 'attached' AS incomplete FROM n""")
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    counted = report.entries_per_source(table(spark, d, "evidence_sources"), table(spark, d, "filesystem_entries"))
    n = F.col("entries_indexed")
    status = F.when(n == 0, "none").when(F.col("attach_status") == "attached", "complete").when(n > 30, "truncated").otherwise("failed")
    return counted.select("evidence_id", n, jobs.coverage_text(status, n, F.lit(30)).alias("coverage"), jobs.is_incomplete(status).alias("incomplete"))


@query("SELECT event_type, count(*) AS candidates, count(*) FILTER (WHERE value >= 50) AS parsed, count(*) FILTER (WHERE value < 50 AND value >= 10) AS partial, count(*) FILTER (WHERE value < 10 OR value IS NULL) AS failed, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def kind_counters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v >= 50, "parsed").when(v >= 10, "partial").otherwise("failed")
    return records.outcome_counts(table(spark, d, "events"), ["event_type"], status, F.col("user_id"), ("parsed", "partial", "failed"))


@query("""
WITH a AS (SELECT o_orderkey AS pair_id, o_orderpriority AS name, CAST(o_orderkey AS VARCHAR) AS value, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS n, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 5 END AS c FROM orders),
u AS (SELECT l_orderkey AS pair_id, min(nullif(l_linenumber - 1, 0)) AS lo, max(nullif(l_linenumber - 1, 0)) AS hi, count(nullif(l_linenumber - 1, 0)) AS k FROM lineitem GROUP BY 1)
SELECT name, value, coalesce(n, k) AS uses, coalesce(c, lo) AS first_used, hi AS last_used FROM a LEFT JOIN u USING (pair_id)""")
def autofill_agg(spark: SparkSession, d: str) -> DataFrame:
    """Form values of profiles of two generations: dates of use within the row, or in a table of their own with 0 for none."""
    known = F.col("o_orderstatus") == "F"
    forms = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("value"), F.when(known, F.col("o_custkey")).alias("count"), F.when(known, F.col("o_custkey") + 5).alias("date_created"))
    dates = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("date_created"))
    return browser.chromium_autofill(forms, dates)


@query("""
SELECT l_orderkey AS download_id, list_aggregate(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey)[1:3], 'string_agg', ' ') AS url_chain, arg_min(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS original_url, arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) AS final_url, count(*) AS total, greatest(count(*) - 3, 0) AS omitted
FROM lineitem GROUP BY 1""")
def url_chain(spark: SparkSession, d: str) -> DataFrame:
    c = records.ordered_chain(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_linenumber", 3)
    return c.select(F.col("l_orderkey").alias("download_id"), F.array_join(F.col("chain").cast("array<string>"), " ").alias("url_chain"), F.col("first_value").alias("original_url"), F.col("last_value").alias("final_url"), "total", "omitted")


@query("SELECT count(*) AS candidates, max(entry_id) AS high_water, count(DISTINCT entry_id) AS different FROM usn_records")
def snapshot_hwm(spark: SparkSession, d: str) -> DataFrame:
    return records.snapshot(table(spark, d, "usn_records"), "entry_id")


@query(r"""
WITH p AS (SELECT DISTINCT logical_path, list_filter(string_split(replace(logical_path, '\', '/'), '/'), lambda x: x <> '') AS parts FROM filesystem_entries)
SELECT '/' || array_to_string(parts[1:i], '/') AS ancestor, count(*) AS entries_below FROM (SELECT parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM p) GROUP BY 1""")
def path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "filesystem_entries").select("logical_path").distinct()
    return paths.select(F.explode(text.path_prefixes(F.col("logical_path"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("entries_below"))


#: Lines of the tree of one source in a report.
TREE_LINES = 2000


@query(rf"""
WITH p AS (SELECT DISTINCT evidence_id, logical_path, list_filter(string_split(replace(logical_path, '\', '/'), '/'), lambda x: x <> '') AS parts FROM filesystem_entries),
r AS (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY parts, logical_path) AS place, count(*) OVER (PARTITION BY evidence_id) AS total FROM p WHERE len(parts) > 0)
SELECT evidence_id, place, logical_path, len(parts) - 1 AS indent, parts[-1] AS line, total, greatest(total - {TREE_LINES}, 0) AS omitted FROM r WHERE place <= {TREE_LINES}""")
def tree_lines(spark: SparkSession, d: str) -> DataFrame:
    """The directory tree of each source up to a report's bound, and how many lines were left out."""
    parts = text.path_parts(F.col("logical_path"))
    rows = table(spark, d, "filesystem_entries").select("evidence_id", "logical_path").distinct().withColumn("parts", parts).where("size(parts) > 0")
    top = records.bounded_listing(rows, ["evidence_id"], ["parts", "logical_path"], TREE_LINES)
    return top.select("evidence_id", "place", "logical_path", (F.size("parts") - 1).cast("bigint").alias("indent"), F.element_at("parts", -1).alias("line"), "total", "omitted")


@query("SELECT event_id, epoch_us(ts) AS at_micros FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' OR (value > 50 AND ts + INTERVAL 3 DAY BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00')")
def timeline_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows any of whose stamps lies in the range; a missing stamp does not."""
    later = F.when(F.col("value") > 50, F.expr("ts + interval 3 days"))
    within = artifacts.any_time_within([F.col("ts").cast("timestamp"), later.cast("timestamp")], F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12 12:00:00").cast("timestamp"))
    return table(spark, d, "events").where(within).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"))


@query(f"""
WITH r AS (SELECT doc_id, translate(text, {FOLD}) AS k FROM documents WHERE text IS NOT NULL)
SELECT min(doc_id) AS doc_id FROM r GROUP BY k""")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies up to ASCII case: the first one stands for all. Only a digest and the length of each text are shuffled."""
    folded = text.ascii_lower(F.col("text"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(folded, 256).alias("k"), F.char_length("text").alias("n"))
    return records.first_wins(docs.select("doc_id", "k", "n"), [F.col("k"), F.col("n")], ["doc_id"]).select("doc_id")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY n) FILTER (WHERE n <= 32) AS sample, count(*) AS total, greatest(count(*) - 32, 0) AS omitted FROM r GROUP BY 1""")
def diagnostics_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first 32 of each source and how many more there are: the bound is the feature."""
    s = records.bounded_sample(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id")
    return s.select("user_id", F.array_join(F.col("sample").cast("array<string>"), " ").alias("sample"), "total", "omitted")


@query("SELECT coalesce(activity_type, -1) AS activity_type, count(*) AS records FROM (SELECT DISTINCT entry_id, activity_type FROM activity) GROUP BY 1")
def activity_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return activities.type_counts(table(spark, d, "activity"))


@query("""
SELECT evidence_id, list_aggregate(list_distinct(list(usn_version)), 'max') AS newest_version, count(*) AS records, count(*) FILTER (WHERE unknown_reason_bits <> 0) AS unknown_reasons, count(*) FILTER (WHERE timestamp_utc IS NULL) AS without_time
FROM (SELECT DISTINCT entry_id, evidence_id, usn_version, unknown_reason_bits, timestamp_utc FROM usn_records) GROUP BY 1""")
def parse_statistics(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.journal_statistics(table(spark, d, "usn_records"))


# Joins and windows --------------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT event_id AS id, user_id, epoch_us(ts) AS t, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, event_id - 2 AS opener, value FROM events), n AS (SELECT v.*, 'https://h' || user_id || '.example/p' AS url FROM v)
SELECT n.id AS visit_id, n.url, r.url AS referrer_url, r.t AS referrer_micros, o.url AS opener_url, CASE WHEN n.id % 5 = 0 THEN 'synced' WHEN n.id % 5 = 1 THEN 'extension' ELSE 'local' END AS visit_source, CASE WHEN n.user_id % 2 = 0 THEN 'title ' || n.user_id ELSE n.url END AS display_name
FROM n LEFT JOIN n r ON r.id = n.prev LEFT JOIN n o ON o.id = n.opener""")
def visit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Visits with the ones they came from and the ones that opened them, and with the table of sources that some profiles have."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    visits = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) + times.CHROME_SHIFT).alias("visit_time"), F.lag("event_id").over(order).alias("from_visit"), (F.col("event_id") - 2).alias("opener_visit"))
    urls = visits.select(F.col("url").alias("id")).distinct().select("id", F.format_string("https://h%d.example/p", "id").alias("url"), F.when(F.col("id") % 2 == 0, F.format_string(" title %d ", "id")).otherwise(" ").alias("title"))
    codes = {v: k for k, v in labels.VISIT_SOURCES.items()}
    sources = visits.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, codes["synced"]).otherwise(codes["extension"]).alias("source"))
    return browser.chromium_visits(visits, urls, sources).select("visit_id", "url", "referrer_url", "referrer_micros", "opener_url", "visit_source", "display_name")


@query("SELECT event_type AS term, user_id AS url_id, 'https://s.example/' || user_id AS url, CASE WHEN user_id % 3 > 0 THEN user_id * 1000000 END AS at_micros, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS ordinal FROM events")
def search_term_rank(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    terms = ev.select(F.col("event_type").alias("term"), F.col("user_id").alias("url_id"), F.col("event_id").alias("rowid"))
    last = F.when(F.col("user_id") % 3 > 0, F.col("user_id") * 1_000_000 + times.CHROME_SHIFT).otherwise(0)
    urls = ev.select("user_id").distinct().select(F.col("user_id").alias("id"), F.format_string("https://s.example/%d", "user_id").alias("url"), last.alias("last_visit_time"))
    return browser.chromium_searches(terms, urls).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query("""
WITH v AS (SELECT s_suppkey AS volume, CAST((s_suppkey - 1) * 5000 AS BIGINT) AS start_at, CAST(4000 + 3000 * (s_suppkey % 2) AS BIGINT) AS size_at FROM supplier),
h AS (SELECT doc_id, doc_id * 37 AS hit_at FROM documents),
j AS (SELECT h.doc_id, h.hit_at, min(v.volume) AS volume FROM h LEFT JOIN v ON h.hit_at >= v.start_at AND h.hit_at < v.start_at + v.size_at GROUP BY 1, 2)
SELECT doc_id, hit_at, volume, CASE WHEN volume IS NULL THEN 'partition-gap/unpartitioned' ELSE 'in-partition' END AS region, hit_at // 512 AS sector FROM j""")
def range_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Intervals overlap here: the one listed first counts."""
    size = 4000 + 3000 * (F.col("s_suppkey") % 2)
    vols = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("volume"), ((F.col("s_suppkey") - 1) * 5000).cast("bigint").alias("start_at"), size.cast("bigint").alias("size_at"))
    hits = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 37).alias("hit_at"))
    got = records.interval_of(hits, "hit_at", vols, "start_at", "size_at", "volume")
    return got.select("doc_id", "hit_at", "volume", F.when(F.col("volume").isNull(), "partition-gap/unpartitioned").otherwise("in-partition").alias("region"), F.call_function("div", F.col("hit_at"), F.lit(512).cast("bigint")).alias("sector"))


@query("SELECT l_orderkey, l_linenumber, coalesce(s_name, 'ID #' || l_suppkey) AS app_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey")
def dictionary_join(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").where("s_acctbal > 0")
    return records.dictionary_join(table(spark, d, "lineitem"), "l_suppkey", names, "s_suppkey", "s_name", "app_name").select("l_orderkey", "l_linenumber", "app_name")


@query("""
SELECT user_id, first_value || chr(92) || second_value AS account FROM (
  SELECT user_id, max(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END) AS first_value, max(CASE WHEN event_type = 'purchase' THEN CAST(event_id AS VARCHAR) END) AS second_value FROM events GROUP BY 1)
WHERE first_value IS NOT NULL AND second_value IS NOT NULL""")
def pair_assembly(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").cast("string").alias("v"))
    return records.pair_assembly(rows, "user_id", "event_type", "v", "signup", "purchase").select("user_id", F.concat_ws("\\", "first_value", "second_value").alias("account"))


@query("""
WITH RECURSIVE n(id, parent, name) AS (SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT), NULL, r_name FROM region UNION ALL SELECT 1000 + c_custkey, c_nationkey + 100, c_name FROM customer),
t(id, path, depth) AS (SELECT id, '', 0 FROM n WHERE parent IS NULL UNION ALL SELECT n.id, CASE WHEN t.path = '' THEN n.name ELSE t.path || '/' || n.name END, t.depth + 1 FROM n JOIN t ON n.parent = t.id)
SELECT CAST(id AS VARCHAR) AS node_id, path, CAST(depth AS BIGINT) AS depth FROM t""")
def recursive_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """Folders of bookmarks with the names above them, by the hierarchy operator."""
    nodes = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("node_id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name")))
    nodes = nodes.unionByName(table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("node_id"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"), F.col("c_name").alias("name")))
    return browser.bookmark_paths(nodes).select("node_id", "path", "depth")


@query("SELECT o_orderkey AS entry_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def anti_pending(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without a finished result of this parser version; results of others and failures do not count."""
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"))
    committed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.when(F.col("l_linestatus") == "F", "lnk-1").otherwise("lnk-0").alias("parser_name"), F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linenumber") % 2 == 0, "parsed").otherwise("partial")).otherwise("failed").alias("status"))
    return artifacts.pending(found, committed, "lnk-1")


@query("SELECT l_orderkey AS staged_id, l_linenumber AS ordinal, o_orderkey * 10 AS entry_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def staged_remap(spark: SparkSession, d: str) -> DataFrame:
    to = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_orderkey") * 10).alias("new_id"))
    staged = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("staged_id"), F.col("l_linenumber").alias("ordinal"))
    return records.remapped(staged, "staged_id", to, "o_orderkey", "new_id", "entry_id")


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 > 0 THEN 'https://n' || p_size || '.example' END AS url, n_name AS folder, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 7 END AS added_micros
FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 30""")
def parent_title(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks with the titles of their folders, which are rows of the same table; some folders are missing."""
    marks = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).cast("bigint").alias("fk"), F.col("p_name").alias("title"), (F.col("p_partkey") % 30 + 10_000_000_000).alias("parent"), F.lit(1).alias("type"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") * 7).otherwise(0).cast("bigint").alias("dateAdded"))
    folders = table(spark, d, "nation").select((F.col("n_nationkey") + 10_000_000_000).alias("id"), F.lit(None).cast("bigint").alias("fk"), F.col("n_name").alias("title"), F.lit(0).cast("bigint").alias("parent"), F.lit(2).alias("type"), F.lit(0).cast("bigint").alias("dateAdded"))
    places = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("id")).distinct().select("id", F.format_string("https://n%d.example", "id").alias("url"))
    return browser.firefox_bookmarks(marks.unionByName(folders), places)


@query("""
WITH s AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS sec, count(*)::BIGINT AS n FROM events GROUP BY ALL),
c AS (SELECT user_id, sec, sum(n) OVER (PARTITION BY user_id ORDER BY sec)::BIGINT AS done FROM s)
SELECT user_id, sec, round(CASE WHEN count(*) OVER w >= 3 AND sec - min(sec) OVER w >= 1 THEN (done - first(done) OVER w) / (sec - min(sec) OVER w) END, 6) AS rate FROM c WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 100000 PRECEDING AND CURRENT ROW)""")
def rolling_rate(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.unix_seconds(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("sec")).agg(F.count("*").alias("n"))
    c = s.select("user_id", "sec", F.sum("n").over(Window.partitionBy("user_id").orderBy("sec")).alias("done"))
    return records.rolling_rate(c, ["user_id"], "sec", "done", 100_000).select("user_id", "sec", F.round("rate", 6).alias("rate"))


@query("""
SELECT record_kind, count(*) AS records, min(t) AS first_micros, max(t) AS last_micros FROM (
 SELECT 'visit' AS record_kind, epoch_us(ts) AS t FROM events WHERE event_type IN ('click', 'view')
 UNION ALL SELECT 'search', CASE WHEN p_partkey % 2 = 0 THEN nullif(p_partkey, 0) END FROM part
 UNION ALL SELECT 'cookie', nullif(o_custkey, 0) * 1000000 FROM orders) GROUP BY 1""")
def union_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of several kinds in one stream, counted by kind."""
    ev = table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select(F.col("event_id").alias("visit_id"), F.col("event_type").alias("title"), F.unix_micros(F.col("ts").cast("timestamp")).alias("visit_micros"))
    history = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("searchbar-history").alias("fieldname"), F.col("p_name").alias("value"), F.lit(1).alias("timesUsed"), F.lit(0).cast("bigint").alias("firstUsed"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(0).cast("bigint").alias("lastUsed"))
    searches = browser.firefox_searches(history).withColumn("first_micros", F.col("last_micros"))
    cookies = browser.firefox_cookies(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("h.example").alias("host"), F.lit("n").alias("name"), (F.col("o_custkey") * 1_000_000).alias("creationTime")))
    return browser.record_counts(browser.activity_stream({"visit": ev, "search": searches, "cookie": cookies}))


# Scalar functions ------------------------------------------------------------------------------------------------------------


@query(f"SELECT event_id, {cases('(event_id * 7) & 255', labels.TRANSITIONS, repr('unknown'))} AS transition_type, " + " || ".join(f"CASE WHEN (event_id * 2654435 & {b}) <> 0 THEN '{n},' ELSE '' END" for b, n in labels.QUALIFIERS.items()) + " AS qualifiers FROM events")
def transition_labels(spark: SparkSession, d: str) -> DataFrame:
    q = labels.transition_qualifiers(F.col("event_id") * 2654435)
    return table(spark, d, "events").select("event_id", labels.transition_type(F.col("event_id") * 7).alias("transition_type"), F.array_join(F.transform(q, lambda x: F.concat(x, F.lit(","))), "").alias("qualifiers"))


@query(f"""SELECT l_orderkey, l_linenumber, {cases('l_linenumber - 1', labels.DOWNLOAD_STATES, "'unknown (' || (l_linenumber - 1) || ')'")} AS state, {cases('l_suppkey % 52', labels.INTERRUPTS, "'unknown (' || (l_suppkey % 52) || ')'")} AS reason, {cases('l_partkey % 10', labels.DANGERS, "'unknown (' || (l_partkey % 10) || ')'")} AS danger, {cases('l_partkey % 12', labels.FIREFOX_VISITS, repr('unknown'))} AS visit, {cases('l_partkey % 12', labels.FIREFOX_DOWNLOADS, "'unknown (' || (l_partkey % 12) || ')'")} AS ff_state FROM lineitem""")
def code_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.label(F.col("l_linenumber") - 1, labels.DOWNLOAD_STATES).alias("state"), labels.label(F.col("l_suppkey") % 52, labels.INTERRUPTS).alias("reason"), labels.label(F.col("l_partkey") % 10, labels.DANGERS).alias("danger"), labels.label(F.col("l_partkey") % 12, labels.FIREFOX_VISITS, "unknown").alias("visit"), labels.label(F.col("l_partkey") % 12, labels.FIREFOX_DOWNLOADS).alias("ff_state"))


@query("SELECT entry_id, " + " || ".join(f"CASE WHEN (reason & {b}) <> 0 THEN '{n},' ELSE '' END" for b, n in usn.REASONS.items()) + f" AS flags, reason & {0xFFFFFFFF & ~usn.KNOWN} AS unknown_bits FROM (SELECT DISTINCT entry_id, reason FROM usn_records)")
def usn_reason_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "usn_records").select("entry_id", "reason").distinct()
    return rows.select("entry_id", F.array_join(F.transform(usn.reason_flags(F.col("reason")), lambda x: F.concat(x, F.lit(","))), "").alias("flags"), usn.unknown_bits(F.col("reason")).alias("unknown_bits"))


@query("SELECT entry_id, file_reference.raw & 281474976710655 AS entry_number, file_reference.raw >> 48 AS sequence_number FROM (SELECT DISTINCT entry_id, file_reference FROM usn_records) WHERE file_reference.raw IS NOT NULL")
def usn_reference_split(spark: SparkSession, d: str) -> DataFrame:
    entry, sequence = usn.split_reference(F.col("raw"))
    rows = table(spark, d, "usn_records").select("entry_id", F.col("file_reference.raw").alias("raw")).where("raw is not null").distinct()
    return rows.select("entry_id", entry.alias("entry_number"), sequence.alias("sequence_number"))


@query("""
WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events)
SELECT event_id, us AS chrome_micros, CASE WHEN event_id % 2 = 0 THEN (us // 1000000) * 1000000 ELSE us END AS download_micros, us AS filetime_micros, (us // 1000000) * 1000000 AS safari_micros, (us // 1000) * 1000 AS timeline_micros FROM e""")
def epoch_round_trips(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    sec = F.call_function("div", us, F.lit(1_000_000).cast("bigint"))
    chrome = us + times.CHROME_SHIFT
    return table(spark, d, "events").select("event_id", times.chrome_micros(chrome).alias("chrome_micros"), times.download_micros(F.when(F.col("event_id") % 2 == 0, sec).otherwise(chrome)).alias("download_micros"), times.filetime_micros(us * 10 + times.FILETIME_SHIFT + 7).alias("filetime_micros"), times.safari_micros((sec - times.SAFARI_SHIFT).cast("double")).alias("safari_micros"), times.timeline_micros(F.call_function("div", us, F.lit(1000).cast("bigint")).cast("string")).alias("timeline_micros"))


@query("SELECT entry_id, raw_filetime, CASE WHEN raw_filetime >= 116444736000000000 THEN (raw_filetime - 116444736000000000) // 10 END AS micros FROM (SELECT DISTINCT entry_id, raw_filetime FROM shimcache_entries)")
def filetime_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shimcache_entries").select("entry_id", "raw_filetime").distinct().select("entry_id", "raw_filetime", times.filetime_micros(F.col("raw_filetime")).alias("micros"))


@query("""
WITH t AS (SELECT o_orderkey, CAST(round(o_totalprice * 10000) AS BIGINT) * 997 AS us FROM orders), p AS (SELECT *, (us + 50000) // 100000 AS x FROM t)
SELECT o_orderkey, CASE WHEN x >= 36000 THEN (x // 36000) || 'h ' || ((x % 36000) // 600) || 'm ' || ((x % 600) // 10) || '.' || (x % 10) || 's' WHEN x >= 600 THEN (x // 600) || 'm ' || ((x % 600) // 10) || '.' || (x % 10) || 's' ELSE (x // 10) || '.' || (x % 10) || 's' END AS duration, format('{:,}', us) AS grouped FROM p""")
def duration_human(spark: SparkSession, d: str) -> DataFrame:
    us = F.round(F.col("o_totalprice") * 10000).cast("bigint") * 997
    return table(spark, d, "orders").select("o_orderkey", text.human_duration(us).alias("duration"), text.grouped(us).alias("grouped"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_linenumber - 1, 0) * 100, 4) AS percent, CASE WHEN l_linenumber > 1 THEN 'known' ELSE 'unknown' END AS total_state FROM lineitem""")
def percent_complete(spark: SparkSession, d: str) -> DataFrame:
    total = F.col("l_linenumber") - 1
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(labels.percent_complete(F.col("l_extendedprice").cast("double"), total), 4).alias("percent"), F.when(total > 0, "known").otherwise("unknown").alias("total_state"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber - 1
  WHEN 1 THEN 'complete - ' || format('{:,}', l_partkey * 1000) || ' bytes in 1.5s'
  WHEN 4 THEN 'interrupted at ' || format('{:,}', l_partkey * 1000) || ' of ' || format('{:,}', l_partkey * 2000) || ' bytes' || CASE WHEN l_partkey > 0 THEN ' (50%)' ELSE '' END || ' after 1.5s - network_failed'
  WHEN 0 THEN 'in_progress - ' || format('{:,}', l_partkey * 1000) || ' of ' || format('{:,}', l_partkey * 2000) || ' bytes after 1.5s - network_failed'
  WHEN 2 THEN 'cancelled - ' || format('{:,}', l_partkey * 1000) || ' of ' || format('{:,}', l_partkey * 2000) || ' bytes after 1.5s - network_failed'
  WHEN 3 THEN 'obsolete_bug_140687 - ' || format('{:,}', l_partkey * 1000) || ' of ' || format('{:,}', l_partkey * 2000) || ' bytes after 1.5s - network_failed'
  ELSE 'unknown (' || (l_linenumber - 1) || ') - ' || format('{:,}', l_partkey * 1000) || ' of ' || format('{:,}', l_partkey * 2000) || ' bytes after 1.5s - network_failed' END AS outcome FROM lineitem""")
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey").cast("bigint")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", labels.download_outcome(F.col("l_linenumber") - 1, k * 1000, k * 2000, F.lit("1.5s"), F.lit(20)).alias("outcome"))


@query(f"SELECT entry_id, {field_sql('artifact_kind')} AS kind, coalesce(nullif({field_sql('prefetch.header.executable')}, ''), nullif({field_sql('parser')}, '')) AS first_value, {field_sql('lnk.header.flags')} AS nested_value FROM {ENTRIES}")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    first = json.first_of(F.col("metadata_json"), "prefetch.header.executable", "parser")
    return entries(spark, d, field("artifact_kind").alias("kind"), first.alias("first_value"), field("lnk.header.flags").alias("nested_value"))


@query("""
WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || user_id || '"}' WHEN 2 THEN '{"k": ' || user_id || '.75}' WHEN 3 THEN '{"k": -' || (user_id + 1) || '}' ELSE '{"k": "x"}' END AS j FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN try_cast(json_extract_string(j, '$.k') AS BIGINT) WHEN 1 THEN try_cast(json_extract_string(j, '$.k') AS BIGINT) WHEN 2 THEN CAST(floor(json_extract_string(j, '$.k')::DOUBLE) AS BIGINT) END AS k FROM t""")
def lenient_number(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written as numbers, as text and with decimals; negative ones and words are none."""
    k, u = F.col("event_id") % 5, F.col("user_id")
    made = F.when(k == 0, F.col("props")).when(k == 1, F.format_string('{"k": "%d"}', u)).when(k == 2, F.format_string('{"k": %d.75}', u)).when(k == 3, F.format_string('{"k": -%d}', u + 1)).otherwise('{"k": "x"}')
    return table(spark, d, "events").select("event_id", made.alias("j")).select("event_id", json.lenient_number(F.col("j"), "k").alias("k"))


@query(r"""
WITH a AS (SELECT DISTINCT entry_id, trim(app_id) AS t FROM activity WHERE app_id IS NOT NULL)
SELECT entry_id, CASE WHEN t LIKE '[%' THEN trim(json_extract_string(t::JSON, '$[' || (list_position(list_transform(json_extract_string(t::JSON, '$[*].application'), lambda x: trim(x) <> ''), true) - 1) || '].application')) ELSE nullif(t, '') END AS application,
 CASE WHEN t LIKE '[%' THEN json_extract_string(t::JSON, '$[' || (list_position(list_transform(json_extract_string(t::JSON, '$[*].application'), lambda x: trim(x) <> ''), true) - 1) || '].platform') END AS platform FROM a""")
def application_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activity").where("app_id is not null").select("entry_id", "app_id").distinct()
    return rows.select("entry_id", labels.application_of(F.col("app_id")).alias("a")).select("entry_id", "a.application", "a.platform")


@query(f"SELECT entry_id, CASE activity_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.ACTIVITY_TYPES.items()) + " ELSE 'Type ' || activity_type END AS type_name FROM (SELECT DISTINCT entry_id, activity_type FROM activity)")
def activity_type_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "activity").select("entry_id", "activity_type").distinct().select("entry_id", labels.label(F.col("activity_type"), labels.ACTIVITY_TYPES, "Type {}").alias("type_name"))


@query(r"""
WITH r AS (SELECT DISTINCT entry_id, original_path, data_file_name, user_sid FROM recycle_bin_records)
SELECT entry_id, nullif(trim(regexp_extract(regexp_extract(regexp_replace(trim(original_path), '[/\\]+$', ''), '^[^?#]*'), '[^/\\]*$')), '') AS leaf, nullif(lower(regexp_extract(original_path, '\.([A-Za-z0-9_]+)$', 1)), '') AS extension, CASE WHEN lower(left(data_file_name, 2)) = '$i' THEN '$R' || substr(data_file_name, 3) ELSE data_file_name END AS data_name FROM r""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recycle_bin_records").select("entry_id", "original_path", "data_file_name", "user_sid").distinct()
    return rows.select("entry_id", text.leaf(F.col("original_path")).alias("leaf"), text.path_extension(F.col("original_path")).alias("extension"), text.recycled_data_name(F.col("data_file_name")).alias("data_name"))


@query("""
WITH u AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C:/Users/a/Google/Chrome/User Data' WHEN 1 THEN '/home/x/.config/microsoft-edge' WHEN 2 THEN 'D:/BraveSoftware/p' WHEN 3 THEN '/opt/opera/profile' ELSE '/srv/none' END AS p, 'https://user@host' || (doc_id % 7) || '.example:8080/a/b.txt?q=1' AS u FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'chrome' WHEN 1 THEN 'edge' WHEN 2 THEN 'brave' WHEN 3 THEN 'opera' END AS brand, 'host' || (doc_id % 7) || '.example' AS host, 'b.txt' AS leaf FROM u""")
def host_and_brand(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    path = F.when(k == 0, r"C:\Users\a\Google\Chrome\User Data").when(k == 1, "/home/x/.config/microsoft-edge").when(k == 2, "D:/BraveSoftware/p").when(k == 3, "/opt/opera/profile").otherwise("/srv/none")
    url = F.format_string("https://user@host%d.example:8080/a/b.txt?q=1", F.col("doc_id") % 7)
    return table(spark, d, "documents").select("doc_id", text.browser_brand(path).alias("brand"), text.host(url).alias("host"), text.leaf(url).alias("leaf"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS turned, sha256(text) AS digest, substr(sha256(text), 1, 12) AS short_key, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.rot13(t).alias("turned"), F.sha2(t, 256).alias("digest"), text.short_key(t).alias("short_key"), text.escape_html(t).alias("escaped"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT doc_id, regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(\S.*)$', 1) AS k, trim(regexp_extract(line, '^\s*([A-Za-z_][A-Za-z0-9_.\-]*)\s*[=:]\s*(\S.*)$', 2)) AS v FROM l)
SELECT doc_id, k AS key_name, count(*) AS assignments, min(v) AS least_value FROM p WHERE k <> '' GROUP BY ALL""")
def line_assignments(spark: SparkSession, d: str) -> DataFrame:
    """KEY=VALUE and KEY: VALUE lines, the raw material of secret leads."""
    pairs = artifacts.assignment_lines(table(spark, d, "documents"), "doc_id", "text")
    return pairs.groupBy("doc_id", "key_name").agg(F.count("*").alias("assignments"), F.min("value").alias("least_value"))


@query(f"SELECT entry_id, CASE WHEN content_head IS NULL OR octet_length(content_head) = 0 THEN 'unreadable' WHEN false THEN '' " + " ".join(f"WHEN starts_with(hex(content_head[1:16]), '{m}') THEN '{e}'" for m, e, _ in text.MAGIC) + f" ELSE 'unknown' END AS sniffed FROM {ENTRIES}")
def sniffed_types(spark: SparkSession, d: str) -> DataFrame:
    head = F.col("content_head")
    return entries(spark, d, F.when(head.isNull() | (F.octet_length(head) == 0), "unreadable").otherwise(F.coalesce(text.sniffed(head), F.lit("unknown"))).alias("sniffed"))


_MAGIC_SQL = "CASE " + " ".join(f"WHEN starts_with(h, '{m}') THEN '{e}'" for m, e, _ in text.MAGIC) + " END"


@query(f"""
WITH f AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b.docx' WHEN 2 THEN 'c' WHEN 3 THEN 'd.png' WHEN 4 THEN 'e.dll' WHEN 5 THEN 'f.tar.gz' ELSE 'g.db' END AS n, CASE doc_id % 6 WHEN 0 THEN 'FFD8FFE000' WHEN 1 THEN '504B030414' WHEN 2 THEN '4D5A9000' WHEN 3 THEN '1F8B0800' WHEN 4 THEN '00112233' ELSE '' END AS h FROM documents),
e AS (SELECT doc_id, h, nullif(lower(regexp_extract(n, '[.]([A-Za-z0-9_]+)$', 1)), '') AS x, {_MAGIC_SQL} AS m FROM f)
SELECT doc_id, CASE WHEN h = '' THEN 'unreadable' WHEN m IS NULL THEN 'unknown' WHEN x IS NULL THEN 'no_extension' WHEN x = m THEN 'match' WHEN CASE x {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ALIASES.items())} END = m THEN 'alias' ELSE 'mismatch' END AS outcome FROM e""")
def signature_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Names' extensions against first bytes, in all combinations."""
    pick = lambda k, *vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("doc_id") % k + 1).cast("int"))
    names = pick(7, "a.JPG", "b.docx", "c", "d.png", "e.dll", "f.tar.gz", "g.db")
    heads = F.unhex(pick(6, "FFD8FFE000", "504B030414", "4D5A9000", "1F8B0800", "00112233", ""))
    return table(spark, d, "documents").select("doc_id", text.signature_outcome(names, heads).alias("outcome"))


# Sources, decoders, rules ----------------------------------------------------------------------------------------------------


def _norm_sql() -> str:
    p = "replace(logical_path, chr(92), '/')"
    return f"CASE WHEN starts_with({p}, '/') THEN translate({p}, {FOLD}) ELSE '/' || translate({p}, {FOLD}) END"


@query(f"""
WITH e AS (SELECT entry_id, {_norm_sql()} AS p, translate(entry_name, {FOLD}) AS n FROM {ENTRIES} WHERE entry_kind = 'file')
SELECT entry_id, CASE WHEN contains(p, '/windows/system32/tasks/') THEN 'scheduled_task' WHEN n LIKE '%.lnk' OR p LIKE '%.lnk' THEN 'shell_link' WHEN n LIKE '%.pf' OR p LIKE '%.pf' THEN 'prefetch' WHEN n LIKE '%.evtx' OR p LIKE '%.evtx' THEN 'event_log' ELSE 'recycle_bin' END AS artifact_source
FROM e WHERE NOT contains(p, '/windows/winsxs/') AND (contains(p, '/windows/system32/tasks/') OR n LIKE '%.lnk' OR p LIKE '%.lnk' OR n LIKE '%.pf' OR p LIKE '%.pf' OR n LIKE '%.evtx' OR p LIKE '%.evtx' OR (contains(p, 'recycle.bin/') AND regexp_extract(p, '[^/]*$') LIKE '$i%'))""")
def windows_candidates(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.candidates(table(spark, d, "filesystem_entries")).select("entry_id", "artifact_source").distinct()


@query("""
WITH r AS (SELECT DISTINCT entry_id, format_version, original_file_size, deletion_timestamp_filetime AS t, original_path AS p FROM recycle_bin_records WHERE deletion_timestamp_filetime IS NOT NULL AND original_file_size >= 0 AND original_path IS NOT NULL)
SELECT entry_id, 2 AS version, original_file_size AS original_size, CASE WHEN t > 0 THEN (t - 116444736000000000) // 10 - CASE WHEN (t - 116444736000000000) % 10 < 0 THEN 1 ELSE 0 END END AS deleted_micros, p AS original_path FROM r""")
def recycle_bin_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Records put into the bytes of a deletion file and decoded again."""
    rows = table(spark, d, "recycle_bin_records").where("deletion_timestamp_filetime is not null and original_file_size >= 0 and original_path is not null")
    rows = rows.select("entry_id", "original_file_size", "deletion_timestamp_filetime", "original_path").distinct()
    little = lambda c, n: F.unhex(F.regexp_replace(F.right(F.lpad(F.hex(c), 16, "0"), F.lit(2 * n)), "^" + "(..)" * n + "$", "".join(f"${n - i}" for i in range(n))))
    data = F.concat(little(F.lit(2).cast("bigint"), 8), little(F.col("original_file_size"), 8), little(F.col("deletion_timestamp_filetime"), 8), little(F.char_length("original_path").cast("bigint"), 4), F.encode("original_path", "UTF-16LE"))
    out = decode(rows.select("entry_id", data.alias("bytes")), "recycle_bin", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), F.col("version").cast("int").alias("version"), "original_size", "deleted_micros", "original_path")


def mail_header(name: str, column: str):
    """A header line: nothing if null, printable ASCII as it is, else (or with '=?' in it) base64 encoded words, a line each."""
    c = F.col(column)
    words = F.transform(F.regexp_extract_all(c, F.lit("(?s).{1,10}"), F.lit(0)), lambda x: F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(x, "UTF-8")), F.lit("?=")))
    value = F.when(c.rlike(r"^[ -~]*\z") & ~c.contains("=?"), c).otherwise(F.array_join(words, "\r\n "))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


_BLANKS = "trim(regexp_replace({c}, '\\\\s+', ' ', 'g')) AS {c}"


@query(f"SELECT DISTINCT entry_id, {', '.join(_BLANKS.format(c=c) for c in ('from_header', 'subject', 'message_id'))} FROM rfc822_metadata".replace("\\\\", "\\"))
def eml_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every mail put into transport form and parsed again, whatever its headers hold."""
    headers = {"From": "from_header", "Subject": "subject", "Message-ID": "message_id"}
    raw = F.concat(*[mail_header(k, c) for k, c in headers.items()], F.lit("\r\n"), F.coalesce("body_preview", F.lit("")))
    out = decode(table(spark, d, "rfc822_metadata").select("entry_id", F.encode(raw, "UTF-8").alias("bytes")).distinct(), "mail_message", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), "from_header", "subject", "message_id").distinct()


@query("""
WITH k AS (SELECT doc_id, source, doc_id % 6 AS f, 'p' || doc_id AS v FROM documents)
SELECT doc_id, 'db_password' AS secret_key, v AS secret_value, 'line 3' AS location FROM k WHERE f = 0 UNION ALL SELECT doc_id, 'API-ACCESS.KEY', v, 'line 4' FROM k WHERE f = 0
UNION ALL SELECT doc_id, 'Token', v, '$.a[1].Token' FROM k WHERE f = 1 UNION ALL SELECT doc_id, 'secret', '7', '$.secret' FROM k WHERE f = 1
UNION ALL SELECT doc_id, 'Password', v, 'Password' FROM k WHERE f = 2
UNION ALL SELECT doc_id, 'u@h.example/r', v, 'line 2' FROM k WHERE f = 3
UNION ALL SELECT doc_id, 'me@h.example', v, 'line 1' FROM k WHERE f = 4""")
def secret_leads(spark: SparkSession, d: str) -> DataFrame:
    """Secrets in settings, JSON, XML and stored logins put together from each document's id; every sixth text has none."""
    v, k = F.format_string("p%d", "doc_id"), F.col("doc_id") % 6
    lines = F.concat(F.lit("# password=no\nuser = ann\nexport db_password = '"), v, F.lit("'\nAPI-ACCESS.KEY: "), v, F.lit("\ntoken=\n"))
    tree = F.concat(F.lit('{"a": [1, {"Token": "'), v, F.lit('", "name": "x"}], "secret": 7, "pwd": null}'))
    made = F.when(k == 0, lines).when(k == 1, tree).when(k == 2, F.concat(F.lit("<c><Password> "), v, F.lit(" </Password><User>u</User></c>"))).when(k == 3, F.concat(F.lit("https://h.example\nhttps://u:"), v, F.lit("@h.example/r\n"))).when(k == 4, F.concat(F.lit("machine h.example login me password "), v)).otherwise(F.concat(F.lit("keyboard: us\npasswords are bad\n"), "source"))
    docs = table(spark, d, "documents").select("doc_id", made.alias("t"), F.when(k == 3, "/u/.git-credentials").when(k == 4, "C:\\u\\.netrc").alias("n"))
    return artifacts.secret_leads(docs, "doc_id", "t", "n").withColumnRenamed("source_id", "doc_id")


@query("SELECT user_id AS url_id, event_id AS visit_id, 'u' || user_id AS url, epoch_us(ts) AS visit_micros, " + cases("event_id % 9", labels.FIREFOX_VISITS, repr("unknown")) + " AS visit_type FROM events")
def firefox_visits(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    visits = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("place_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("visit_date"), (F.col("event_id") % 9).alias("visit_type"))
    places = ev.select(F.col("user_id").alias("id")).distinct().withColumn("url", F.format_string("u%d", "id"))
    return browser.firefox_visits(visits, places).select(F.substring("url", 2, 20).cast("bigint").alias("url_id"), "visit_id", "url", "visit_micros", "visit_type")


@query("""
WITH v AS (SELECT event_id AS id, user_id AS url, epoch_us(ts) AS t, event_id - 1 AS prev FROM events)
SELECT v.id AS visit_id, 'https://h' || v.url || '.example/p' AS url, v.t AS visit_micros, CASE WHEN r.id IS NOT NULL THEN 'https://h' || r.url || '.example/p' END AS referrer_url, 'h' || v.url || '.example' AS host FROM v LEFT JOIN v r ON r.id = v.prev""")
def chromium_visits(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    visits = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("url"), (F.unix_micros(F.col("ts").cast("timestamp")) + times.CHROME_SHIFT).alias("visit_time"), (F.col("event_id") - 1).alias("from_visit"))
    urls = ev.select(F.col("user_id").alias("id")).distinct().select("id", F.format_string("https://h%d.example/p", "id").alias("url"))
    return browser.chromium_visits(visits, urls).select("visit_id", "url", "visit_micros", "referrer_url", "host")


@query("""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM events)
SELECT event_type, epoch_us(b) AS window_micros, count(*) AS records FROM w GROUP BY ALL""")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return incremental.windowed_counts(ev, "ts", "event_type").select("event_type", F.unix_micros("window.start").alias("window_micros"), "records")


@query("""
WITH i AS (SELECT DISTINCT evidence_id, entry_id, logical_path FROM filesystem_entries)
SELECT b.evidence_id, b.entry_id AS old_entry_id, max(e.entry_id) AS entry_id FROM i b JOIN i e USING (evidence_id, logical_path) GROUP BY ALL""")
def bookmark_relink(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "filesystem_entries").select("evidence_id", "entry_id", "logical_path").distinct()
    return report.relinked(e.withColumn("old_entry_id", F.col("entry_id")), e).select("evidence_id", "old_entry_id", "entry_id")


@query("""
WITH a AS (SELECT o_orderkey AS source_id, CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status FROM orders), c AS (SELECT DISTINCT l_orderkey AS source_id FROM lineitem WHERE l_returnflag = 'R')
SELECT source_id, CASE WHEN a.status IN ('parsed', 'partial') THEN a.status WHEN c.source_id IS NOT NULL THEN 'parsed' ELSE a.status END AS standing, coalesce(a.status IN ('parsed', 'partial'), false) AS replaced FROM a FULL JOIN c USING (source_id)""")
def failed_attempts_kept(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "parsed").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed").alias("status"), F.lit("why").alias("diagnostic"))
    c = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("source_id")).distinct().withColumn("status", F.lit("parsed"))
    return incremental.commit_plan(a, c).select("source_id", "standing", F.coalesce("replaced", F.lit(False)).alias("replaced"))


def queries() -> dict:
    from quarrybed.plans import browsing, casework, decoding  # noqa: F401  (they register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)
