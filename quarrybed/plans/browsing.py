"""Queries of the browser operators, over profile tables put together from the case's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.functions import labels, text, times
from quarrybed.operators import browser
from quarrybed.plans.registry import cases, query
from quarrybed.session import scratch_path, table
from quarrybed.sources import sqlite

SHIFT = times.CHROME_SHIFT


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""
SELECT p_partkey AS url_id, 'https://u' || p_size || '.example/' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'https://u' || p_size || '.example/' || p_partkey END AS display_name, 'u' || p_size || '.example' AS host, p_size AS visit_count, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 1000 END AS at_micros FROM part""")
def chromium_urls(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.format_string("https://u%d.example/%d", "p_size", "p_partkey").alias("url"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("").alias("title"), F.col("p_size").alias("visit_count"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") * 1000 + SHIFT).otherwise(0).alias("last_visit_time"))
    return browser.chromium_urls(urls).select("url_id", "url", "display_name", "host", "visit_count", "at_micros")


@query("SELECT 's' || c_custkey AS shortcut_id, c_name AS term, c_mktsegment AS title, CASE WHEN c_custkey % 2 = 1 THEN c_custkey * 7 END AS at_micros, c_nationkey AS hits FROM customer")
def chromium_shortcuts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.format_string("s%d", "c_custkey").alias("id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("contents"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey") * 7 + SHIFT).otherwise(0).alias("last_access_time"), F.col("c_nationkey").alias("number_of_hits"))
    return browser.chromium_shortcuts(rows).select("shortcut_id", "term", "title", "at_micros", "hits")


@query(f"""
WITH c AS (SELECT l_orderkey AS id, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS urls FROM lineitem WHERE l_partkey % 11 > 0 GROUP BY 1)
SELECT o_orderkey AS id, 'f' || o_custkey || '.bin' AS file_name, urls[1] AS original_url, urls[-1] AS final_url, array_to_string(urls[1:4], ' ') AS url_chain, CASE WHEN len(urls) > 0 THEN greatest(len(urls) - 4, 0) END AS chain_omitted, o_custkey * 1000000 AS start_micros, (o_custkey + 90) * 1000000 AS end_micros, {cases('o_orderkey % 5', labels.DOWNLOAD_STATES, "''")} AS state, '1m 30.0s' AS duration_human, CASE WHEN o_custkey % 4 > 0 THEN CAST(50.0 AS DOUBLE) END AS percent_complete
FROM orders LEFT JOIN c ON id = o_orderkey WHERE o_custkey > 0""")
def chromium_downloads(spark: SparkSession, d: str) -> DataFrame:
    """Downloads with bounded chains of addresses: stamps of two kinds, seconds since 1970 or microseconds since 1601."""
    k, old = F.col("o_custkey"), F.col("o_orderkey") % 2 == 0
    stamp = lambda s: F.when(old, s).otherwise(s * 1_000_000 + SHIFT)
    total = F.when(k % 4 > 0, k * 2).otherwise(0)
    downs = table(spark, d, "orders").where("o_custkey > 0").select(F.col("o_orderkey").alias("id"), F.format_string("C:\\Users\\a\\f%d.bin", k).alias("target_path"), stamp(k).alias("start_time"), stamp(k + 90).alias("end_time"), (F.col("o_orderkey") % 5).alias("state"), k.alias("received_bytes"), total.alias("total_bytes"))
    chains = table(spark, d, "lineitem").where("l_partkey % 11 > 0").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("url"), F.col("l_linenumber").alias("chain_index"))
    out = browser.chromium_downloads(downs, chains, 4)
    return out.select("id", "file_name", "original_url", "final_url", F.array_join("url_chain", " ").alias("url_chain"), "chain_omitted", "start_micros", "end_micros", "state", "duration_human", "percent_complete")


@query("SELECT 'https://' || c_nationkey || '.example' AS origin_url, c_name AS username, c_custkey * 5 + 1 AS created_micros, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 5 + 2 END AS used_micros, hex(encode(c_name)) AS ciphertext_hex, length(c_name) AS ciphertext_bytes FROM customer")
def chromium_logins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") * 5 + SHIFT
    rows = table(spark, d, "customer").select(F.format_string("https://%d.example", "c_nationkey").alias("origin_url"), F.col("c_name").alias("username_value"), (k + 1).alias("date_created"), F.when(F.col("c_custkey") % 2 == 0, k + 2).otherwise(0).alias("date_last_used"), F.col("c_name").cast("binary").alias("password_value"))
    return browser.chromium_logins(rows).select("origin_url", "username", "created_micros", "used_micros", "ciphertext_hex", "ciphertext_bytes")


@query("SELECT 'h' || user_id AS host_key, event_type AS name, epoch_us(ts) AS created_micros, CASE WHEN event_id % 2 = 1 THEN epoch_us(ts) + 1000000 END AS expires_micros, event_id % 3 = 1 AS is_secure, event_id % 5 = 1 AS is_httponly, length(props) AS encrypted_bytes FROM events")
def chromium_cookies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.format_string("h%d", "user_id").alias("host_key"), F.col("event_type").alias("name"), (_micros() + SHIFT).alias("creation_utc"), F.when(F.col("event_id") % 2 == 1, _micros() + SHIFT + 1_000_000).otherwise(0).alias("expires_utc"), (F.col("event_id") % 3).alias("is_secure"), (F.col("event_id") % 5).alias("is_httponly"), F.col("props").cast("binary").alias("encrypted_value"))
    return browser.chromium_cookies(rows).select("host_key", "name", "created_micros", "expires_micros", "is_secure", "is_httponly", "encrypted_bytes")


@query("""
SELECT c_custkey AS id, 'profile.name' AS setting, c_name AS value FROM customer WHERE c_custkey % 4 < 2 UNION ALL SELECT c_custkey, 'homepage', 'https://' || c_nationkey FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'session.startup_urls', '["a","b"]' FROM customer WHERE c_custkey % 4 = 1""")
def chromium_preferences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    doc = F.when(k == 0, F.format_string('{"profile": {"name": "%s", "other": 1}}', "c_name")).when(k == 1, F.format_string('{"homepage": "https://%d", "profile": {"name": "%s"}, "session": {"startup_urls": ["a", "b"]}}', "c_nationkey", "c_name")).when(k == 2, "{not json").otherwise("[]")
    return browser.chromium_preferences(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), doc.alias("content"))).select("id", "setting", "value")


@query("SELECT p_partkey AS url_id, 'https://' || p_partkey AS url, p_name AS title, CASE WHEN p_size > 25 THEN p_size END AS at_micros FROM part")
def firefox_urls(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.format_string("https://%d", "p_partkey").alias("url"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 40, F.col("p_size")).when(F.col("p_size") > 25, F.col("p_size")).cast("bigint").alias("last_visit_date"))
    return browser.firefox_urls(places).select("url_id", "url", "title", "at_micros")


@query("SELECT event_id AS id, props AS term, user_id AS uses, nullif(user_id, 0) AS first_micros, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) END AS last_micros FROM events WHERE event_type = 'view'")
def firefox_searches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "searchbar-history").otherwise("email").alias("fieldname"), F.col("props").alias("value"), F.col("user_id").alias("timesUsed"), F.col("user_id").alias("firstUsed"), F.when(F.col("event_id") % 2 == 0, _micros()).otherwise(0).alias("lastUsed"))
    return browser.firefox_searches(rows)


@query("""
SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS url, CASE l_linenumber % 3 WHEN 0 THEN 'downloads/destinationFileURI' ELSE 'downloads/metaData' END AS annotation, l_returnflag AS content, l_suppkey AS at_micros FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 < 2""")
def firefox_annotated_downloads(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, their names and places: a three-way join; other kinds of annotation are none of these."""
    annos = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("place_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("anno_attribute_id"), F.col("l_returnflag").alias("content"), F.col("l_suppkey").alias("dateAdded"))
    names = spark.createDataFrame([(0, "downloads/destinationFileURI"), (1, "downloads/metaData"), (2, "bookmarks/x")], "id bigint, name string")
    places = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("url"))
    return browser.firefox_annotated_downloads(annos, names, places)


@query(f"""SELECT o_orderkey AS id, 'f' || o_custkey AS file_name, o_orderdate::DATE::VARCHAR AS url, {cases('o_custkey % 12', labels.FIREFOX_DOWNLOADS, "'unknown (' || (o_custkey % 12) || ')'")} AS state, CASE WHEN o_custkey > 0 THEN CAST(25.0 AS DOUBLE) END AS percent_complete FROM orders""")
def firefox_old_downloads(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.format_string("f%d", k).alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("source"), (k % 12).alias("state"), k.alias("currBytes"), (k * 4).alias("maxBytes"))
    return browser.firefox_old_downloads(rows).select("id", "file_name", "url", "state", "percent_complete")


@query("SELECT c_custkey * 2 + i AS id, 'https://' || c_nationkey AS origin_url, length(c_name) AS username_cipher_chars, 3 AS password_cipher_chars, c_custkey * 1000 AS created_micros, i AS times_used FROM customer, (VALUES (0), (1)) v(i)")
def firefox_logins(spark: SparkSession, d: str) -> DataFrame:
    one = lambda i: F.format_string('{"id": %d, "hostname": "https://%d", "encryptedUsername": "%s", "encryptedPassword": "abc", "timeCreated": %d, "timesUsed": ' + str(i) + "}", F.col("c_custkey") * 2 + i, F.col("c_nationkey"), F.col("c_name"), F.col("c_custkey"))
    docs = table(spark, d, "customer").select(F.concat(F.lit('{"logins": ['), one(0), F.lit(", "), one(1), F.lit('], "version": 3}')).alias("content"))
    return browser.firefox_logins(docs).select("id", "origin_url", "username_cipher_chars", "password_cipher_chars", "created_micros", F.col("times_used").cast("int").alias("times_used"))


@query("SELECT event_id AS id, 'h' || user_id AS host_key, epoch_us(ts) AS created_micros, nullif(user_id, 0) * 1000000 AS expires_micros, event_id % 2 = 1 AS is_secure FROM events")
def firefox_cookies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.format_string("h%d", "user_id").alias("host"), F.col("event_type").alias("name"), _micros().alias("creationTime"), F.col("user_id").alias("expiry"), (F.col("event_id") % 2).alias("isSecure"))
    return browser.firefox_cookies(rows).select("id", "host_key", "created_micros", "expires_micros", "is_secure")


@query("SELECT event_id AS visit_id, 'https://' || user_id AS url, event_type AS title, CASE WHEN event_id % 7 > 0 THEN (event_id + 978307200) * 1000000 + 500000 END AS visit_micros, 2 * user_id AS visit_count FROM events WHERE user_id % 5 > 0")
def safari_visits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds since 2001 with decimals; a stamp that is no number is none; visits of unknown items are left out."""
    ev = table(spark, d, "events")
    at = F.when(F.col("event_id") % 7 > 0, F.col("event_id") + F.lit(0.5)).otherwise(F.lit(float("nan")))
    visits = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("history_item"), F.col("event_type").alias("title"), at.alias("visit_time"))
    items = ev.where("user_id % 5 > 0").select(F.col("user_id").alias("id")).distinct().select("id", F.format_string("https://%d", "id").alias("url"), (F.col("id") * 2).alias("visit_count"))
    return browser.safari_visits(visits, items)


@query("SELECT p_partkey AS url_id, 'https://' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_size END AS visit_count, p_brand AS domain FROM part")
def safari_urls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.format_string("https://%d", "p_partkey").alias("url"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).cast("bigint").alias("visit_count"), F.col("p_brand").alias("domain_expansion"))
    return browser.safari_urls(rows)


_FILES = ("History", "Cookies", "places.sqlite-wal", "logins.json", "History.db", "notes.txt", "Web Data-journal")


@query("""
WITH f AS (SELECT doc_id, doc_id % 7 AS k, doc_id % 3 AS b FROM documents)
SELECT doc_id AS entry_id, CASE WHEN k IN (0, 1, 6) THEN 'chromium' WHEN k IN (2, 3) THEN 'firefox' ELSE 'safari' END AS family, CASE b WHEN 0 THEN 'Users/a/Google/Chrome/User Data/Default' WHEN 1 THEN 'home/x/.mozilla/p' || (doc_id % 10) ELSE 'Users/a/Microsoft/Edge/Profile 1' END AS profile, CASE k WHEN 0 THEN 'History' WHEN 1 THEN 'Cookies' WHEN 2 THEN 'places.sqlite-wal' WHEN 3 THEN 'logins.json' WHEN 4 THEN 'History.db' ELSE 'Web Data-journal' END AS file, CASE WHEN k = 1 THEN 0 ELSE 1 END AS preference, CASE b WHEN 0 THEN 'chrome' WHEN 2 THEN 'edge' END AS brand FROM f WHERE k <> 5""")
def profile_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of browser profiles in an index, side files and network folders included."""
    pick = lambda n, *vs: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in vs]), (F.col("doc_id") % n + 1).cast("int"))
    name = pick(7, *_FILES)
    folder = pick(3, "/Users/a/Google/Chrome/User Data/Default", F.concat(F.lit("/home/x/.mozilla/p"), (F.col("doc_id") % 10).cast("string")), "\\Users\\a\\Microsoft\\Edge\\Profile 1")
    path = F.concat(folder, F.when(F.col("doc_id") % 7 == 1, "/Network/").otherwise("/"), name)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.lit(1).alias("evidence_id"), path.alias("logical_path"), name.alias("entry_name"))
    return browser.profile_files(rows).drop("evidence_id")


@query("""
WITH f AS (SELECT n_nationkey AS id, 'p' || (n_nationkey % 4) AS profile, n_nationkey % 3 AS pref FROM nation), b AS (SELECT profile, arg_min(id, pref * 1000 + id) AS src FROM f WHERE profile <> 'p3' GROUP BY 1)
SELECT event_id, src AS source_entry_id, 'browser-profile:v1:p' || (user_id % 4) AS derivation_key, substr(sha256('browser-profile:v1:p' || (user_id % 4)), 1, 12) AS record_prefix FROM events LEFT JOIN b ON profile = 'p' || (user_id % 4)""")
def browser_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Records with the indexed file they came from, the preferred one of several."""
    files = table(spark, d, "nation").where("n_nationkey % 4 < 3").select(F.col("n_nationkey").alias("entry_id"), F.format_string("p%d", F.col("n_nationkey") % 4).alias("profile"), F.lit("History").alias("file"), (F.col("n_nationkey") % 3).alias("preference"), F.lit("chrome").alias("brand"))
    stream = table(spark, d, "events").select("event_id", F.format_string("p%d", F.col("user_id") % 4).alias("profile"), F.lit("History").alias("source_file"))
    return browser.with_source(stream, files).select("event_id", "source_entry_id", "derivation_key", "record_prefix")


def _database(spark: SparkSession, d: str) -> str:
    """A database file of fixed small tables in the shared folder."""
    import sqlite3

    path = scratch_path(spark, "db").removeprefix("file://").removeprefix("file:")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE urls (id INTEGER PRIMARY KEY, url TEXT, visit_count INTEGER)")
        db.execute("CREATE TABLE visits (id INTEGER PRIMARY KEY, url INTEGER, visit_time INTEGER)")
        db.executemany("INSERT INTO urls VALUES (?, ?, ?)", [(r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, d, "nation").collect()])
        db.executemany("INSERT INTO visits VALUES (?, ?, ?)", [(r.r_regionkey, r.r_regionkey, SHIFT + r.r_regionkey) for r in table(spark, d, "region").collect()])
    db.close()
    return path


@query("SELECT CAST(r_regionkey AS BIGINT) AS visit_id, n_name AS url, CAST(n_regionkey AS BIGINT) AS visit_count, CAST(r_regionkey AS BIGINT) AS visit_micros, 'chromium' AS family FROM region JOIN nation ON n_nationkey = r_regionkey")
def sqlite_profile(spark: SparkSession, d: str) -> DataFrame:
    """A profile's database file: its family by its tables, and its tables read from a private copy; columns that it lacks
    are null."""
    path = _database(spark, d)
    visits, urls = (sqlite.read_table(spark, path, t) for t in ("visits", "urls"))
    out = browser.chromium_visits(visits, urls)
    return out.where("title is null").select("visit_id", "url", "visit_count", F.coalesce("visit_micros", F.lit(0)).alias("visit_micros"), F.lit(sqlite.browser_family(path)).alias("family"))


@query("SELECT event_id, (event_id * 1664525) & 255 IN (1, 2, 5, 7, 8, 9, 10) OR (event_id * 1664525) & 33554432 <> 0 AS user_initiated, (event_id * 1664525) & 1073741824 <> 0 OR (event_id * 1664525) & 2147483648 <> 0 AS is_redirect FROM events")
def visit_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_id") * 1664525
    return table(spark, d, "events").select("event_id", labels.is_user_initiated(t).alias("user_initiated"), labels.is_redirect(t).alias("is_redirect"))


@query("""
WITH b AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_size % 4 AS r FROM part)
SELECT id, CASE k WHEN 0 THEN 'Bookmarks Bar' WHEN 1 THEN 'Other Bookmarks' WHEN 2 THEN 'Mobile Bookmarks' ELSE 'x' END AS root, CASE r WHEN 1 THEN 'To' WHEN 2 THEN 'Cc' WHEN 3 THEN 'Bcc' ELSE 'unknown (0)' END AS recipient FROM b""")
def small_labels(spark: SparkSession, d: str) -> DataFrame:
    root = F.element_at(F.array(*[F.lit(x) for x in ("bookmark_bar", "other", "synced", "x", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), labels.label(root, labels.BOOKMARK_ROOTS, "x").alias("root"), labels.label(F.col("p_size") % 4, labels.RECIPIENTS).alias("recipient"))


@query("""
WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN o_custkey + 1 WHEN 2 THEN (o_custkey + 1) * 1000000000000 ELSE (o_custkey + 1) * 1000000000000 END AS a, CASE o_orderkey % 4 WHEN 3 THEN o_custkey + 5 WHEN 1 THEN o_custkey + 5 ELSE (o_custkey + 2) * 1000000000000 END AS b FROM orders)
SELECT id, CASE WHEN id % 4 = 1 THEN 4000000 WHEN id % 4 = 2 THEN 1000000000000 END AS took FROM s""")
def download_durations(spark: SparkSession, d: str) -> DataFrame:
    """Time between two stamps of one kind; stamps of two kinds, or 0, say nothing."""
    k, big = F.col("o_orderkey") % 4, 1_000_000_000_000
    a = F.when(k == 0, 0).when(k == 1, F.col("o_custkey") + 1).otherwise((F.col("o_custkey") + 1) * big)
    b = F.when(k.isin(1, 3), F.col("o_custkey") + 5).otherwise((F.col("o_custkey") + 2) * big)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), times.download_duration(a, b).alias("took"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024.0) ELSE format('{:.1f} MB', n_chars / 1048576.0) END AS size, format('{:,}', n_chars * 1000) AS grouped FROM documents")
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", text.human_size(n).alias("size"), text.grouped(n * 1000).alias("grouped"))
