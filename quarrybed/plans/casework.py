"""Queries of the rules, reports, persistence and activity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed import jobs
from quarrybed.functions import json, labels, text, times
from quarrybed.operators import activities, artifacts, records, report, search, usage
from quarrybed.plans.registry import FOLD, query, raw, utf16
from quarrybed.session import scratch_path, table
from quarrybed.sources.decoders import TEXT_EXTENSIONS
from quarrybed.sources.images import evidence_kinds as kinds_of
from quarrybed.streaming import incremental


def pick(by: str, *values: Column | str | None) -> Column:
    """One of the values, in turn by a number column."""
    return F.element_at(F.array(*[F.lit(v) if v is None or isinstance(v, str) else v for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def made_entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries whose metadata holds categories, times and flags in all combinations."""
    k = F.col("doc_id")
    meta = F.to_json(F.struct(pick("doc_id", "Mail", "Web History", None, "Documents").alias("category_main"), pick("doc_id", "Inbox", None, "Chrome").alias("category_sub"), pick("doc_id", "0", "true", "1", None, None).alias("category_hidden"), pick("doc_id", "filesystem_entry", "deleted_file_record", "lnk", "filesystem_parser_error", None, "filesystem_entry").alias("artifact_kind"), pick("doc_id", "2024-01-05T10:00:00Z", "", None).alias("ntfs_modified_utc"), pick("doc_id", None, "2023-05-05T00:00:00Z").alias("ext_mtime_utc"), pick("doc_id", "2024-02-01T00:00:00Z", None, "bad").alias("fat_created_utc"), F.sha2(k.cast("string"), 256).alias("sha256")))
    return table(spark, d, "documents").select(k.alias("entry_id"), F.lit(1).alias("evidence_id"), F.concat_ws("/", F.lit("/evidence"), pick("doc_id", "a", "b/c", "b"), F.concat(pick("doc_id", "Alpha", "beta"), k.cast("string"), pick("doc_id", ".PDF", ".txt", ".tmp"))).alias("logical_path"), F.concat(pick("doc_id", "Alpha", "beta"), k.cast("string"), pick("doc_id", ".PDF", ".txt", ".tmp")).alias("entry_name"), pick("doc_id", "file", "directory").alias("entry_kind"), (k % 7 == 0).alias("is_deleted"), F.col("n_chars").alias("size_bytes"), meta.alias("metadata_json"))


def _pick(by: str, *values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{by} % {len(values)} + 1]"


_MADE = f"""
WITH m AS (SELECT doc_id AS entry_id, n_chars AS size_bytes, {_pick('doc_id', 'Alpha', 'beta')} || doc_id || {_pick('doc_id', '.PDF', '.txt', '.tmp')} AS entry_name, {_pick('doc_id', 'a', 'b/c', 'b')} AS folder, {_pick('doc_id', 'file', 'directory')} AS entry_kind, doc_id % 7 = 0 AS is_deleted,
 {_pick('doc_id', 'Mail', 'Web History', None, 'Documents')} AS main, {_pick('doc_id', 'Inbox', None, 'Chrome')} AS sub, {_pick('doc_id', '0', 'true', '1', None, None)} AS hidden, {_pick('doc_id', 'filesystem_entry', 'deleted_file_record', 'lnk', 'filesystem_parser_error', None, 'filesystem_entry')} AS kind, {_pick('doc_id', '2024-01-05T10:00:00Z', '', None)} AS t1, {_pick('doc_id', None, '2023-05-05T00:00:00Z')} AS t2, {_pick('doc_id', '2024-02-01T00:00:00Z', None, 'bad')} AS t3 FROM documents)
"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'file' WHEN 2 THEN 'folder' WHEN 3 THEN 'image' END AS kind FROM documents")
def evidence_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", kinds_of(pick("doc_id", "auto", " File ", "FOLDER", "Image", "tape")).alias("kind"))


@query(_MADE + "SELECT entry_id FROM m WHERE coalesce(kind, '') <> 'filesystem_parser_error' AND contains(concat_ws(' ', coalesce(lower(main), ''), coalesce(lower(sub), ''), '', '', ''), 'web h')")
def scope_by_category(spark: SparkSession, d: str) -> DataFrame:
    return search.scope(made_entries(spark, d), " WEB H ").select("entry_id")


@query(_MADE + "SELECT entry_id FROM m WHERE coalesce(hidden, '0') NOT IN ('1', 'true') AND kind IN ('filesystem_entry', 'deleted_file_record')")
def visible_and_genuine(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.genuine(artifacts.visible(made_entries(spark, d))).select("entry_id")


@query(_MADE + "SELECT entry_id FROM m WHERE coalesce(main, 'Uncategorized') = 'Uncategorized' AND sub = 'Chrome'")
def category_entries(spark: SparkSession, d: str) -> DataFrame:
    e = made_entries(spark, d)
    main, sub = artifacts.metadata("category_main"), artifacts.metadata("category_sub")
    return report.in_category(e, main, sub, "Uncategorized|||Chrome").select("entry_id")


@query(_MADE + "SELECT entry_id FROM m WHERE contains(lower(entry_name), 'alpha') AND entry_name LIKE '%.PDF' AND entry_kind = 'file' AND NOT is_deleted AND (try_cast(nullif(t1, '') AS TIMESTAMPTZ) BETWEEN TIMESTAMPTZ '2024-01-01 00:00:00Z' AND TIMESTAMPTZ '2024-01-31 00:00:00Z' OR (t3 <> 'bad' AND try_cast(t3 AS TIMESTAMPTZ) BETWEEN TIMESTAMPTZ '2024-01-01 00:00:00Z' AND TIMESTAMPTZ '2024-01-31 00:00:00Z'))")
def category_page(spark: SparkSession, d: str) -> DataFrame:
    """All filters of a category page at once."""
    return artifacts.category_page(made_entries(spark, d), "ALPHA", "pdf", "file", False, None, "2024-01-01", "2024-01-31", ["ntfs_modified_utc", "fat_created_utc"]).select("entry_id")


@query(_MADE + "SELECT entry_id, coalesce(nullif(t1, ''), t2) AS modified_utc, t3 AS born_utc, '/' || folder || '/' || entry_name AS shown, concat_ws(' | ', nullif(t1, ''), main, sub) AS preview FROM m")
def entry_columns(spark: SparkSession, d: str) -> DataFrame:
    """Times, path and preview of a report's entry."""
    e = made_entries(spark, d)
    modified, _, _, born = artifacts.four_times()
    preview = artifacts.first_preview([artifacts.metadata(k) for k in ("ntfs_modified_utc", "category_main", "nothing", "category_sub", "category_detail")])
    return e.select("entry_id", modified, born, artifacts.display_path(F.col("logical_path")).alias("shown"), preview.alias("preview"))


@query(_MADE + "SELECT entry_id, entry_name FROM m WHERE folder = 'b' ORDER BY lower(entry_name), entry_id LIMIT 40 OFFSET 25")
def folder_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a folder's children by position: the limit is the feature. What lies deeper is not listed."""
    return artifacts.folder_page(made_entries(spark, d), "/evidence/b/", 25, 40).select("entry_id", "entry_name")


@query(_MADE + "SELECT entry_id, entry_name FROM m WHERE entry_id = 77 OR starts_with(folder, 'b/')")
def entry_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One entry by its id, and all entries below a folder."""
    e = made_entries(spark, d)
    return artifacts.entry_by_id(e, 77).unionByName(artifacts.below_folder(e, "/evidence/b/c")).select("entry_id", "entry_name").distinct()


@query(_MADE + ", a AS (SELECT unnest(['/evidence', '/evidence/' || split_part(folder, '/', 1), CASE WHEN contains(folder, '/') THEN '/evidence/' || folder END]) AS folder, coalesce(size_bytes, 0) AS n FROM m) SELECT folder, count(*) AS entries, CAST(sum(n) AS BIGINT) AS bytes FROM a WHERE folder IS NOT NULL GROUP BY 1")
def subtree_totals(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.subtree_totals(made_entries(spark, d))


_HIVES = (("SYSTEM", "C:\\Windows\\System32\\config\\SYSTEM", "system"), ("ntuser.dat", "/Users/a/NTUSER.DAT", "ntuser.dat"), ("UsrClass.dat", "/Users/a/AppData/Local/Microsoft/Windows/UsrClass.dat", "usrclass.dat"), ("Amcache.hve", "/Windows/AppCompat/Programs/Amcache.hve", "amcache.hve"), ("SYSTEM", "/backup/SYSTEM", None), ("notes.txt", "/Windows/System32/config/notes.txt", None))


@query(f"SELECT doc_id, {_pick('doc_id', *[h[2] for h in _HIVES])} AS hive FROM documents")
def registry_hives(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", artifacts.hive_of(pick("doc_id", *[h[0] for h in _HIVES]), pick("doc_id", *[h[1] for h in _HIVES])).alias("hive"))


def observations(spark: SparkSession, d: str, keys: tuple[str, ...], names: tuple[str, ...], hive: str) -> DataFrame:
    """Registry observations: keys and value names in all combinations, values from the events."""
    ev = table(spark, d, "events")
    return ev.select(F.lit(hive).alias("hive"), F.col("event_id").alias("ordinal"), pick("event_id", *keys).alias("key_path"), pick("user_id", *names).alias("value_name"), F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.format_string(" v%d ", F.col("user_id") % 20)).alias("value_data"), F.lit(None).cast("string").alias("last_write_utc"))


def _observed(keys: tuple[str, ...], names: tuple[str, ...]) -> str:
    return f"o AS (SELECT event_id AS ordinal, {_pick('event_id', *keys)} AS k, {_pick('user_id', *names)} AS n, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'v' || (user_id % 20) END AS v FROM events)"


_RUN = ("Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Software/Microsoft/Windows/currentversion/RUNONCE", "Software\\Microsoft\\Windows\\CurrentVersion\\Running")


@query(f"WITH {_observed(_RUN, ('a', 'b'))} SELECT ordinal, n AS entry, v AS command FROM o WHERE v <> '' AND NOT k LIKE '%Running'")
def startup_programs(spark: SparkSession, d: str) -> DataFrame:
    return artifacts.startup_records(observations(spark, d, _RUN, ("a", "b"), "NTUSER.DAT")).select("ordinal", "entry", "command")


_TCP = ("ControlSet001\\Services\\Tcpip\\Parameters\\Interfaces\\x", "ControlSet001\\Control\\ComputerName\\ComputerName", "ControlSet001\\Other")
_NAMES = ("Hostname", "DhcpNameServer", "ComputerName", "Other")


@query(f"""
WITH {_observed(_TCP, _NAMES)}, l AS (SELECT CASE WHEN k LIKE '%ComputerName' AND n = 'ComputerName' THEN 'computer_name' WHEN contains(k, 'Tcpip') AND n = 'Hostname' THEN 'host_or_domain_name' WHEN contains(k, 'Tcpip') AND n = 'DhcpNameServer' THEN 'ip_dns_gateway_or_dhcp' END AS t, n, v, ordinal FROM o WHERE v <> '')
SELECT t AS lead_type, n AS value_name, v AS value, min(ordinal) AS ordinal FROM l WHERE t IS NOT NULL GROUP BY 1, 2, 3""")
def registry_leads(spark: SparkSession, d: str) -> DataFrame:
    """Facts on hosts and networks; of equal ones the first stays."""
    return artifacts.registry_leads(observations(spark, d, _TCP, _NAMES, "SYSTEM")).select("lead_type", "value_name", "value", "ordinal")


@query("""
WITH u AS (SELECT user_id, 'u' || arg_max(event_id, event_id) FILTER (WHERE event_type = 'click') AS u, 'D' || (arg_max(event_id, event_id) FILTER (WHERE event_type = 'view') % 3) AS d FROM events GROUP BY 1)
SELECT u AS account, d AS domain, d || chr(92) || u AS qualified_account FROM u WHERE u IS NOT NULL AND d IS NOT NULL AND d <> 'D0'""")
def domain_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Default users with their domains from logon keys; local placeholders are none."""
    ev = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    user = F.col("event_type") == "click"
    k = F.col("event_id") % 3
    obs = ev.select(F.lit("SOFTWARE").alias("hive"), F.col("event_id").alias("ordinal"), F.format_string("R%d\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon", "user_id").alias("key_path"), F.when(user, "DefaultUserName").otherwise("DefaultDomainName").alias("value_name"), F.when(user, F.format_string("u%d", "event_id")).when(k == 0, ".").otherwise(F.format_string("D%d", k)).alias("value_data"))
    return artifacts.domain_accounts(obs)


@query("SELECT 'R/Root/InventoryApplicationFile/f' || p_partkey AS key_path, CASE WHEN p_size % 2 = 0 THEN 'c:\\p' || p_partkey ELSE p_name END AS file_path, p_name AS name, 'ab' || p_partkey AS sha1, p_brand AS publisher FROM part")
def inventory_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs of an inventory: each key's values put side by side, a path of several candidates."""
    p = table(spark, d, "part")
    pair = lambda n, v: F.struct(F.lit(n).alias("n"), v.alias("v"))
    values = F.array(pair("LowerCaseLongPath", F.when(F.col("p_size") % 2 == 0, F.format_string("c:\\p%d", "p_partkey")).otherwise("")), pair("Path", F.col("p_name")), pair("Name", F.col("p_name")), pair("FileId", F.format_string("0000ab%d", "p_partkey")), pair("Publisher", F.col("p_brand")))
    obs = p.select(F.format_string("R/Root/InventoryApplicationFile/f%d", "p_partkey").alias("key_path"), F.explode(values).alias("x")).select("key_path", F.col("x.n").alias("value_name"), F.col("x.v").alias("value_data"))
    return artifacts.inventory_records(obs).select("key_path", "file_path", "name", "sha1", "publisher")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'C:\\Windows\\System32\\x' || doc_id || '.exe' WHEN 1 THEN 'UEME_CTLSESSION' END AS program FROM documents WHERE doc_id % 3 < 2")
def user_assist_names(spark: SparkSession, d: str) -> DataFrame:
    """Turned names below count keys, known folders spelled out."""
    name = F.when(F.col("doc_id") % 3 == 0, F.format_string("{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\x%d.exe", "doc_id")).otherwise("UEME_CTLSESSION")
    key = F.when(F.col("doc_id") % 3 == 2, "Software\\Explorer\\RunMRU").otherwise("Software\\Explorer\\UserAssist\\{F}\\Count")
    obs = table(spark, d, "documents").select("doc_id", key.alias("key_path"), text.rot13(name).alias("value_name"))
    return artifacts.user_assist_names(obs).select("doc_id", "program")


@query("""
SELECT 'BagMRU' AS key_path, 'Desktop' AS folder_path UNION ALL SELECT 'BagMRU/' || r_regionkey, 'Desktop' || chr(92) || r_name FROM region
UNION ALL SELECT 'BagMRU/' || n_regionkey || '/' || n_nationkey, 'Desktop' || chr(92) || r_name || chr(92) || n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def shell_bags(spark: SparkSession, d: str) -> DataFrame:
    """Each folder's path is made of the names of the keys above it."""
    n = table(spark, d, "nation").select(F.concat_ws("\\", F.lit("BagMRU"), "n_regionkey", "n_nationkey").alias("key_path"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.concat_ws("\\", F.lit("BagMRU"), "r_regionkey").alias("key_path"), F.col("r_name").alias("name"))
    top = spark.createDataFrame([("BagMRU", "Desktop")], "key_path string, name string")
    bags = artifacts.bag_paths(top.unionByName(r).unionByName(n))
    return bags.select(text.slashes(F.col("key_path")).alias("key_path"), "folder_path")


_STORES = (("/Windows/System32/config", "SAM", "Windows account credential database", False), ("C:\\U\\Default", "Login Data", "Browser saved-login store", False), ("/home/a/.ssh", "id_ed25519", "SSH private key", False), ("/home/a/.aws", "credentials", "AWS credential configuration", True), ("/x", "vault.kdbx", "Password manager database", False), ("/U/AppData/Microsoft/Protect/S-1", "guid", "Windows DPAPI master-key material", False), ("/U/AppData/Microsoft/Vault", "p.vcrd", "Windows Credential Manager or Vault store", False), ("/U/.azure", "accessTokens.json", "Cloud authentication token store", True), ("/srv", ".env.local", None, True), ("/U/.docker", "config.json", None, True), ("/etc", "config.json", None, False), ("/etc", "pip.conf", None, True))


@query(f"SELECT doc_id, {_pick('doc_id', *[s[2] for s in _STORES])} AS store, [{', '.join(str(s[3]).lower() for s in _STORES)}][doc_id % {len(_STORES)} + 1] AS plaintext FROM documents")
def credential_stores(spark: SparkSession, d: str) -> DataFrame:
    path, name = pick("doc_id", *[s[0] for s in _STORES]), pick("doc_id", *[s[1] for s in _STORES])
    return table(spark, d, "documents").select("doc_id", artifacts.credential_store(path, name).alias("store"), artifacts.plaintext_secret_source(path, name).alias("plaintext"))


@query("SELECT doc_id, doc_id % 4 IN (0, 2) AS is_text FROM documents")
def text_extensions(spark: SparkSession, d: str) -> DataFrame:
    ext = text.path_extension(pick("doc_id", "a.TXT", "b.exe", "c.tar.log", "md"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(ext.isin(*TEXT_EXTENSIONS), F.lit(False)).alias("is_text"))


# Persistence --------------------------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderstatus AS s, 0 AS i FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_custkey, o_orderkey - o_orderkey % 2, 'new', 1 FROM orders WHERE o_orderkey % 3 < 2)
SELECT k, max(v) AS v, arg_max(s, v * 2 + i) AS s FROM b GROUP BY 1""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("s")).dropDuplicates(["k", "v"])
    new = o.where("o_orderkey % 3 < 2").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("v"), F.lit("new").alias("s"))
    return incremental.upsert(old, new, ["k"], "v")


@query("SELECT user_id AS source_id, event_id AS row_id, CASE WHEN user_id % 3 = 0 THEN 'second' ELSE 'first' END AS run FROM events WHERE user_id % 3 > 0 OR event_id % 2 = 0")
def replaced_by_source(spark: SparkSession, d: str) -> DataFrame:
    """A table written twice: sources of the second run replace their earlier rows, others stay."""
    path = scratch_path(spark, "derived")
    rows = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("row_id"))
    incremental.replace_by_source(rows.withColumn("run", F.lit("first")), path, buckets=8)
    incremental.replace_by_source(rows.where("source_id % 3 = 0 and row_id % 2 = 0").withColumn("run", F.lit("second")), path, buckets=8)
    return spark.read.parquet(path).select("source_id", "row_id", "run")


@query("SELECT user_id, event_id, lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS VARCHAR), 20, '0') AS ordinal FROM events")
def staged_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return incremental.stage_ordinals(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT 'report_exported' AS event_type, 'me' AS actor, 'report' AS object_type, CAST(7 AS BIGINT) AS object_id, '{\"bytes\": ' || (SELECT count(*) FROM nation) || ', \"path\": \"/out/r.html\"}' AS details_json UNION ALL SELECT 'pass_failed', 'me', 'evidence', NULL, '{\"reason\": \"ValueError: no\"}'")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to the audit table: an export, and a pass that failed without stopping the others."""
    path = scratch_path(spark, "audit")
    n = table(spark, d, "nation").count()
    jobs.append_audit(spark, path, "report_exported", "me", "report", 7, {"path": "/out/r.html", "bytes": n})

    def fails():
        raise ValueError("no")

    for done in jobs.run_passes(spark, {"good": lambda: n, "bad": fails}):
        if done["status"] == "failed":
            jobs.append_audit(spark, path, "pass_failed", "me", "evidence", None, {"reason": done["detail"]})
    return spark.read.parquet(path).drop("created_at")


@query("""
SELECT sha256('<!doctype html><html><head><meta charset=''utf-8''><title>A &amp; B</title></head><body><h1>A &amp; B</h1><section><h2>Nations</h2><p>all &lt;of them&gt;</p><table>' || string_agg('<tr><td>' || n_name || '</td><td>/' || n_regionkey || '/' || n_name || '</td><td></td></tr>', '' ORDER BY n_name) || '</table></section>') AS digest FROM nation""")
def report_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a rendered report; its rows are those of a bounded report."""
    rows, _, _ = report.expanded(table(spark, d, "nation").select(F.col("n_name").alias("display_name"), F.concat_ws("/", F.lit(""), "n_regionkey", "n_name").alias("logical_path")), ["display_name"])
    _, digest = report.render("A & B", [{"name": "Nations", "comment": "all <of them>", "items": [r.asDict() for r in rows.collect()]}])
    return spark.createDataFrame([(digest,)], "digest string")


@query("""
WITH f AS (SELECT entry_id, min(coalesce(original_filename, 'none')) AS n FROM recycle_bin_records GROUP BY 1), o AS (SELECT *, lower(n) AS k, row_number() OVER (PARTITION BY lower(n) ORDER BY entry_id) AS i FROM f)
SELECT entry_id, CASE WHEN i = 1 THEN n ELSE regexp_replace(n, '([.][^.]*)?$', '') || ' (' || i || ')' || regexp_extract(n, '([.][^.]*)$', 1) END AS output_name FROM o""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "recycle_bin_records").groupBy("entry_id").agg(F.min(F.coalesce("original_filename", F.lit("none"))).alias("n"))
    return report.unique_names(names, "n", "entry_id").select("entry_id", "output_name")


@query("SELECT '/' || doc_id AS path, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def export_manifest(spark: SparkSession, d: str) -> DataFrame:
    return report.manifest(table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("bytes")))


@query("SELECT e.evidence_id, count(*) AS items, coalesce(min(s.display_name), 'Evidence ' || e.evidence_id) AS source_name FROM (SELECT DISTINCT entry_id, CASE WHEN entry_id % 5 = 0 THEN evidence_id + 1000 ELSE evidence_id END AS evidence_id FROM filesystem_entries) e LEFT JOIN evidence_sources s USING (evidence_id) GROUP BY 1")
def report_sources(spark: SparkSession, d: str) -> DataFrame:
    """Report items with the names of their sources; unknown sources are numbered."""
    items = table(spark, d, "filesystem_entries").select("entry_id", F.when(F.col("entry_id") % 5 == 0, F.col("evidence_id") + 1000).otherwise(F.col("evidence_id")).alias("evidence_id")).distinct()
    return report.with_source_names(items, table(spark, d, "evidence_sources")).groupBy("evidence_id", "source_name").agg(F.count("*").alias("items"))


@query("SELECT DISTINCT o_custkey AS entry_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def skipped_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("entry_id"))
    return report.skipped(wanted, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entry_id")))


# Records --------------------------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT DISTINCT entry_id, activity_type, app_id, start_time, payload, trim(payload) LIKE '{%' AS o FROM activity)
SELECT entry_id, coalesce(CASE activity_type """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.ACTIVITY_TYPES.items()) + """ END, 'Type ' || activity_type) AS type_name, CASE WHEN o THEN json_extract_string(try_cast(payload AS JSON), '$.displayText') END AS display_text, CASE WHEN o THEN json_extract_string(try_cast(payload AS JSON), '$.activationUri') END AS activation_uri, CASE WHEN o THEN json_extract_string(try_cast(payload AS JSON), '$.userTimezone') END AS user_timezone, CASE WHEN o THEN json_extract_string(try_cast(payload AS JSON), '$.reportingApp') END AS reporting_app,
 CASE WHEN n <= 0 THEN NULL WHEN n > 100000000000000000 THEN (n - 116444736000000000) // 10 WHEN n > 9223372036854775 THEN NULL WHEN n > 10000000000 THEN n * 1000 ELSE n * 1000000 END AS start_micros FROM (SELECT *, try_cast(CASE WHEN regexp_full_match(trim(start_time), '[+-]?[0-9]+') THEN trim(start_time) END AS BIGINT) AS n FROM a)""")
def activity_records(spark: SparkSession, d: str) -> DataFrame:
    """Activities with type name, payload and instant."""
    rows = table(spark, d, "activity").dropDuplicates(["entry_id"])
    return activities.activity_records(rows).select("entry_id", "type_name", "display_text", "activation_uri", "user_timezone", "reporting_app", "start_micros")


@query("""
WITH r AS (SELECT 'network' AS provider, o_orderkey AS record_id, o_custkey AS app_id, o_custkey % 40 AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN '1601-01-01 00:00:00' ELSE '2024-01-01 00:00:00' END AS ts, o_orderkey * 2 AS sent, NULL AS cycles FROM orders
 UNION ALL SELECT 'application', event_id, user_id, user_id % 40, '', NULL, event_id * 3 FROM events),
i AS (SELECT c_custkey AS id, CASE WHEN c_custkey < 40 THEN 'S-1-5-21-' || c_custkey WHEN c_custkey % 2 = 0 THEN '!!prog' || c_custkey || '.exe!2024!x!' ELSE '\\Device\\HarddiskVolume3\\a' || c_custkey || '.exe' END AS name FROM customer WHERE c_custkey % 5 > 0)
SELECT provider, record_id, CASE WHEN a.name IS NULL THEN 'ID #' || r.app_id WHEN starts_with(a.name, '!!') THEN 'prog' || r.app_id || '.exe' WHEN starts_with(a.name, 'S-1-') THEN a.name ELSE 'C:\\a' || r.app_id || '.exe' END AS app_name, u.name AS user_sid, CASE WHEN ts = '2024-01-01 00:00:00' THEN ts END AS "timestamp", sent AS bytes_sent, cycles AS foreground_cycles
FROM r LEFT JOIN i a ON a.id = r.app_id LEFT JOIN i u ON u.id = r.user_id AND starts_with(u.name, 'S-1-')""")
def usage_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of two providers with different columns; ids resolved by the database's own table."""
    stamp = F.when(F.col("o_orderkey") % 3 == 0, "1601-01-01 00:00:00").otherwise("2024-01-01 00:00:00")
    net = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("app_id"), (F.col("o_custkey") % 40).alias("user_id"), stamp.alias("timestamp"), (F.col("o_orderkey") * 2).alias("bytes_sent"))
    app = table(spark, d, "events").select(F.col("event_id").alias("record_id"), F.col("user_id").alias("app_id"), (F.col("user_id") % 40).alias("user_id"), F.lit("").alias("timestamp"), (F.col("event_id") * 3).alias("foreground_cycles"))
    k = F.col("c_custkey")
    name = F.when(k < 40, F.format_string("S-1-5-21-%d", k)).when(k % 2 == 0, F.format_string("!!prog%d.exe!2024!x!", k)).otherwise(F.format_string("\\Device\\HarddiskVolume3\\a%d.exe", k))
    ids = table(spark, d, "customer").where("c_custkey % 5 > 0").select(k.alias("id"), name.alias("name"))
    return usage.usage_records({"network": net, "application": app}, ids).select("provider", "record_id", "app_name", "user_sid", "timestamp", "bytes_sent", "foreground_cycles")


@query("SELECT entry_id, usn FROM usn_records WHERE usn > 100000 AND usn <= (SELECT max(usn) - 1000 FROM usn_records)")
def candidate_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What lies after a key and within a snapshot's mark; later rows wait."""
    rows = table(spark, d, "usn_records").select("entry_id", "usn")
    mark = records.snapshot(rows, "usn").first().high_water - 1000
    return records.up_to(rows, "usn", 100_000, mark)


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_size END AS size FROM part ORDER BY coalesce(CASE WHEN p_size > 20 THEN p_size END, 0) DESC, p_partkey DESC LIMIT 300")
def filled_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 in falling order of a column whose nulls count as 0: the limit is the feature."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 20, F.col("p_size")).alias("size"))
    return records.by_filled(rows, "size", "p_partkey").limit(300)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey")
def unlimited_page(spark: SparkSession, d: str) -> DataFrame:
    """Size 0 means no limit, after no cursor."""
    return records.keyset_page(table(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], None, 0)


@query("""
WITH j AS (SELECT doc_id, 's' || doc_id AS v FROM documents)
SELECT doc_id, v AS set_value, v AS merged_a, CASE WHEN doc_id % 2 = 0 THEN v ELSE 'old' END AS merged_b, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 3 END AS items, CASE WHEN doc_id % 3 = 2 THEN 'y' ELSE v END AS last_item FROM j""")
def json_edits(spark: SparkSession, d: str) -> DataFrame:
    """A key set, two objects merged, an array extended."""
    v, k = F.format_string("s%d", "doc_id"), F.col("doc_id")
    first = F.lit('{"a": "x", "b": "old"}')
    second = F.when(k % 2 == 0, F.to_json(F.struct(v.alias("a"), v.alias("b")))).otherwise(F.to_json(F.struct(v.alias("a"))))
    array, item = F.when(k % 3 == 0, '["x"]').when(k % 3 == 1, "broken").otherwise('["x", "z", "y"]'), F.when(k % 3 < 2, v)
    rows = table(spark, d, "documents").select("doc_id", json.with_value(first, "b", v).alias("s"), json.merged(first, second).alias("m"), F.from_json(json.appended(array, item), "array<string>").alias("l"))
    return rows.select("doc_id", json.at(F.col("s"), "b").alias("set_value"), json.at(F.col("m"), "a").alias("merged_a"), json.at(F.col("m"), "b").alias("merged_b"), F.size("l").alias("items"), F.element_at("l", -1).alias("last_item"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(lpad(to_hex(doc_id), 8, '0')) || '-02e7-4e5d-b744-2eb1ae5198b7' END AS guid, CASE WHEN doc_id % 3 = 0 THEN 'S-1-5-21-' || doc_id END AS sid, CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id ELSE 'ü' || doc_id END AS wide, 'ß' || doc_id AS marked, CASE doc_id % 4 WHEN 0 THEN 'x/y' ELSE '' END AS parent, CASE doc_id % 4 WHEN 0 THEN 'z' || doc_id ELSE 'q' || doc_id END AS leaf, 'a/b' || doc_id AS trimmed FROM documents""")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers, security identifiers in paths, 16-bit text up to its end, text by its mark, parents and leaves."""
    k = F.col("doc_id")
    n = k.cast("string")
    hexed = F.lpad(F.hex(k), 8, "0")
    guid = F.when(k % 2 == 0, F.concat(F.lit("{"), hexed, F.lit("-02E7-4E5D-B744-2EB1AE5198B7}"))).otherwise("{no}")
    path = F.when(k % 3 == 0, F.concat(F.lit("C:\\$Recycle.Bin\\S-1-5-21-"), n, F.lit("\\$Iabc"))).otherwise("C:\\x\\y")
    wide = F.concat(utf16(F.concat(F.when(k % 2 == 0, "a").otherwise("ü"), n)), raw(b"\0\0x\0"))
    word = F.concat(F.lit("ß"), n)
    marked = F.when(k % 4 == 0, F.concat(raw(b"\xff\xfe"), utf16(word))).when(k % 4 == 1, F.concat(raw(b"\xfe\xff"), F.encode(word, "UTF-16BE"))).when(k % 4 == 2, F.concat(raw(b"\xef\xbb\xbf"), F.encode(word, "UTF-8"))).otherwise(F.encode(word, "UTF-8"))
    both = text.parent_and_leaf(F.when(k % 4 == 0, F.concat(F.lit("x/y/z"), n)).otherwise(F.concat(F.lit("q"), n)))
    trimmed = text.source_path(F.concat(F.lit("\\\\a\\b"), n, F.lit("\\/")))
    return table(spark, d, "documents").select("doc_id", text.canonical_guid(guid).alias("guid"), text.sid_of_path(path).alias("sid"), text.utf16_until_nul(wide).alias("wide"), text.text_by_mark(marked).alias("marked"), both.parent.alias("parent"), both["name"].alias("leaf"), trimmed.alias("trimmed"))


@query(f"""
WITH t AS (SELECT doc_id, encode(text) AS b, translate(text, {FOLD}) AS f, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, b, octet_length(encode(left(text, instr(f, 'report') - 1))) AS pos FROM t WHERE contains(f, 'report'))
SELECT doc_id, CAST(pos AS BIGINT) AS match_offset, hex(b[greatest(pos - 7, 1):pos + 14]) AS around, octet_length(b[greatest(pos - 7, 1):pos + 14]) AS shown FROM p""")
def byte_previews(spark: SparkSession, d: str) -> DataFrame:
    """Letters folded, the bytes about the first match in hex and as text of one character a byte."""
    b = F.encode("text", "UTF-8")
    rows = table(spark, d, "documents").select("doc_id", b.alias("b"), text.byte_find(b, b"REPort", fold=True).alias("match_offset")).where("match_offset is not null")
    return rows.select("doc_id", "match_offset", F.replace(text.hex_preview(F.col("b"), F.col("match_offset"), 6), F.lit(" ")).alias("around"), F.char_length(text.ascii_preview(F.col("b"), F.col("match_offset"), 6)).alias("shown"))


@query("SELECT doc_id, '54' AS first_hex FROM documents WHERE starts_with(text, 'T')")
def hex_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns in several spellings mean the same bytes."""
    same = {text.strict_hex(p) for p in ("0x54", "54", " 5 4")} | {text.lenient_hex(p) for p in ("hex:54", "0x54", "bytes: 5_4")}
    (needle,) = same
    at = text.byte_find(F.encode("text", "UTF-8"), needle)
    return table(spark, d, "documents").where(at == 0).select("doc_id", F.lit(needle.hex()).alias("first_hex"))


@query("SELECT source, least(count(*), 200) AS done, 'truncated' AS standing, CASE WHEN count(*) > 16 THEN 16 ELSE count(*) END AS reasons_kept, greatest(count(*) - 16, 0) AS reasons_omitted, 50 AS percent, CAST(5 AS INT) AS eta FROM documents GROUP BY 1")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of a tracked job per source: metrics observed in its own run, reasons kept and counted, statuses folded."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    counts, seen = jobs.observed(docs.groupBy("source").agg(F.count("*").alias("n")), "sources", total=F.sum("n"))
    rows = counts.collect()
    if sum(r.n for r in rows) != seen.get["total"]:
        raise RuntimeError("observed metrics differ")
    out = []
    for r in rows:
        clock = iter(range(100))
        tracker = jobs.Progress(20, clock=lambda c=clock: float(next(c)))
        with jobs.job_progress(spark, tracker, f"source-{r.source}"):
            for done in (2, 4, 6, 8, 10):
                jobs.advance(done)
        tracker.clock = lambda: 4.5
        reasons = jobs.truncation_reasons([f"reason {i}" for i in range(r.n)])
        snap = tracker.snapshot()
        out.append((r.source, min(r.n, 200), jobs.fold_status(["complete", "truncated", "complete"]), len(reasons["reasons"]), reasons["omitted"], int(snap["percent"]), snap["eta_seconds"]))
    return spark.createDataFrame(out, "source string, done bigint, standing string, reasons_kept bigint, reasons_omitted bigint, percent int, eta int")


@query("SELECT o_orderkey AS id, o_orderkey % 4 > 0 AS dated, strftime(make_timestamp(o_custkey * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.250' ELSE '.123456' END || 'Z' AS stamp FROM orders")
def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Dates that mean none, and instants as text with as many digits as they need."""
    k = F.col("o_orderkey")
    micros = F.col("o_custkey") * 1_000_000 + F.when(k % 3 == 0, 0).when(k % 3 == 1, 250_000).otherwise(123_456)
    date = times.sentinel_date(F.when(k % 4 == 0, "1601-01-01").otherwise("2024-01-01"))
    return table(spark, d, "orders").select(k.alias("id"), date.isNotNull().alias("dated"), times.rfc3339(micros, "Z").alias("stamp"))
