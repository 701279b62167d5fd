import json

from pyspark.sql import functions as F

from quarrybed.functions.registry import register
from quarrybed.operators import artifacts, browser, records, search


def test_further_profile_tables(spark):
    prefs = spark.createDataFrame([(1, json.dumps({"profile": {"name": "Ann"}, "homepage": "https://h.test"})), (2, "{broken")], "id bigint, content string")
    assert sorted((r.setting, r.value) for r in browser.chromium_preferences(prefs).collect()) == [("homepage", "https://h.test"), ("profile.name", "Ann")]
    logins = spark.createDataFrame([('{"logins": [{"id": 1, "hostname": "https://a.test", "encryptedPassword": "abc", "timeCreated": 5}]}',), (None,)], "content string")
    (r,) = browser.firefox_logins(logins).collect()
    assert (r.origin_url, r.password_cipher_chars, r.created_micros) == ("https://a.test", 3, 5000)
    places = spark.createDataFrame([(1, "u1", None), (2, "u2", 9), (3, "u3", 0)], "id bigint, url string, last_visit_date bigint")
    assert [r.url_id for r in browser.firefox_urls(places).collect()] == [2, 3, 1]
    urls = spark.createDataFrame([(1, "https://h.test/x")], "id bigint, url string")
    assert browser.chromium_urls(urls).first().host == "h.test"
    short = spark.createDataFrame([("7", "t", "u", 0)], "id string, text string, url string, last_access_time bigint")
    assert browser.chromium_shortcuts(short).select("term", "at_micros").first() == ("t", None)
    old = spark.createDataFrame([(1, 3, 50, 200)], "id bigint, state bigint, currBytes bigint, maxBytes bigint")
    assert browser.firefox_old_downloads(old).select("state", "percent_complete").first() == ("canceled", 25.0)
    ck = spark.createDataFrame([(1, "h", "n", 5, 0, 2, 1)], "id bigint, host string, name string, creationTime bigint, lastAccessed bigint, expiry bigint, isSecure bigint")
    assert browser.firefox_cookies(ck).select("created_micros", "used_micros", "expires_micros", "is_secure", "is_httponly").first() == (5, None, 2_000_000, True, None)
    assert browser.safari_urls(spark.createDataFrame([(1, "a", 2), (2, "b", None)], "id bigint, url string, visit_count bigint")).first().url == "a"


def test_profile_files_and_provenance(spark):
    e = spark.createDataFrame([(1, 1, "C:\\U\\Google\\Chrome\\P1\\Cookies", "Cookies"), (2, 1, "C:\\U\\Google\\Chrome\\P1\\Network\\Cookies", "Cookies"), (3, 1, "/x/History-wal", "History-wal"), (4, 1, "/x/other", "other")], "entry_id bigint, evidence_id bigint, logical_path string, entry_name string")
    files = browser.profile_files(e)
    assert sorted((r.entry_id, r.family, r.preference) for r in files.collect()) == [(1, "chromium", 1), (2, "chromium", 0), (3, "chromium", 1)]
    stream = spark.createDataFrame([("Cookies", "C:/U/Google/Chrome/P1"), ("Cookies", "nowhere")], "source_file string, profile string")
    got = {r.profile: (r.source_entry_id, r.brand, len(r.record_prefix)) for r in browser.with_source(stream, files).collect()}
    assert got == {"C:/U/Google/Chrome/P1": (2, "chrome", 12), "nowhere": (None, None, 12)}


def test_observation_records(spark):
    schema = "hive string, ordinal int, key_path string, value_name string, value_data string, last_write_utc string"
    obs = spark.createDataFrame([("s", 1, "A\\CurrentVersion\\Run", "x", " c.exe ", ""), ("s", 2, "A\\CurrentVersion\\Runner", "x", "c", ""), ("a", 3, "R\\InventoryApplicationFile\\k1", "LowerCaseLongPath", "c:\\p.exe", ""), ("a", 4, "R\\InventoryApplicationFile\\k1", "FileId", "0000abcd", ""), ("n", 5, "E\\Explorer\\UserAssist\\{G}\\Count", "P:\\n.rkr", "", "")], schema)
    assert [(r.entry, r.command) for r in artifacts.startup_records(obs).collect()] == [("x", "c.exe")]
    assert artifacts.inventory_records(obs).select("file_path", "sha1").first() == ("c:\\p.exe", "abcd")
    assert [r.program for r in artifacts.user_assist_names(obs).collect()] == ["C:\\a.exe"]
    bags = spark.createDataFrame([("B", "Desktop"), ("B\\0", "C:"), ("B\\0\\1", "Users")], "key_path string, name string")
    assert {r.key_path: r.folder_path for r in artifacts.bag_paths(bags).collect()}["B\\0\\1"] == "Desktop\\C:\\Users"


def test_pages_and_trees(spark):
    e = spark.createDataFrame([(1, "/a/b/x.PDF", "x.PDF", "file", False, 5, '{"ntfs_modified_utc": "", "modified_utc": "2020-01-02T00:00:00Z", "artifact_kind": "filesystem_entry"}'), (2, "/a/y.txt", "y.txt", "file", True, None, '{"category_hidden": 1}'), (3, None, None, None, None, None, None)], "entry_id bigint, logical_path string, entry_name string, entry_kind string, is_deleted boolean, size_bytes bigint, metadata_json string")
    ids = lambda df: [r.entry_id for r in df.orderBy("entry_id").collect()]
    assert ids(artifacts.category_page(e, extension=".pdf")) == [1] and ids(artifacts.category_page(e, deleted=True)) == [2]
    assert ids(artifacts.category_page(e, start="2020-01-01", end="2020-01-03", times=["modified_utc"])) == [1]
    assert ids(artifacts.category_page(e, start="2020-01-01", times=["modified_utc"])) == [1, 2, 3]
    assert ids(artifacts.visible(e)) == [1, 3] and ids(artifacts.genuine(e)) == [1]
    assert e.select(*artifacts.four_times()).first().modified_utc == "2020-01-02T00:00:00Z"
    assert {r.folder: (r.entries, r.bytes) for r in artifacts.subtree_totals(e).collect()} == {"/a": (2, 5), "/a/b": (1, 5)}
    assert e.select(artifacts.display_path(F.lit("/image/a")).alias("p"), artifacts.display_path(F.lit("/imagery/a")).alias("q")).first() == ("/a", "/imagery/a")
    assert e.select(artifacts.first_preview([F.lit(""), F.lit("a"), F.lit(None).cast("string"), F.lit("b")]).alias("p")).first().p == "a | b"


def test_raw_cursor_resumes_without_loss(spark):
    df = spark.createDataFrame([(1, b"ab ab ab" + "ab".encode("utf-16-le"))], "source_id bigint, bytes binary")
    hits = search.raw_search(search.chunked(df, 4, 8), "ab")
    key = lambda r: (r.offset, r.encoding_rank, r.encoding)
    everything, got, at = sorted(map(key, hits.collect())), [], (-1, 0, "")
    while page := sorted(map(key, search.after_cursor(hits, *at).orderBy("offset", "encoding_rank", "encoding").limit(1).collect())):
        got += page
        at = page[-1]
    assert got == everything and len(got) >= 4


def test_pages_concatenate_to_the_whole(spark):
    df = spark.createDataFrame([(i % 3, f"p{i % 5}", i) for i in range(40)], "a bigint, b string, c bigint")
    whole = [tuple(r) for r in df.orderBy("a", "b", "c").collect()]
    for size in (1, 7, 40):
        got, after = [], None
        while True:
            rows = [tuple(r) for r in records.keyset_page(df, ["a", "b", "c"], after, size).collect()]
            got += rows[:size]
            if len(rows) <= size:
                break
            after = rows[size - 1]
        assert got == whole
    assert records.keyset_page(df, ["a"], None, 0).count() == 40


def test_table_functions_in_sql(spark):
    assert "decode_registry_hive" in register(spark)
    data = (2).to_bytes(8, "little") + (9).to_bytes(8, "little") + (131_321_134_820_000_000).to_bytes(8, "little") + (2).to_bytes(4, "little") + "a\0".encode("utf-16-le")
    spark.createDataFrame([(1, data), (2, None)], "id bigint, content binary").createOrReplaceTempView("qb_files")
    rows = spark.sql("SELECT id, d.original_path, d.original_size FROM qb_files, LATERAL decode_recycle_bin(content) d").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 9)]
