from pyspark.sql import functions as F

from quarrybed.operators import browser


def test_settings_of_any_length(spark):
    small = spark.createDataFrame([(1, '{"homepage": "h1"}'), (2, "{broken"), (3, None)], "id bigint, content string")
    pad = F.expr("repeat('x', 33 * 1024 * 1024)")
    long = spark.range(4, 6).select("id", F.concat(F.lit('{"profile": {"name": "Ann"}, "homepage": "h4", "pad": "'), pad, F.when(F.col("id") == 4, '"}').otherwise("")).alias("content"))
    docs = small.unionByName(long)
    got = sorted((r.id, r.setting, r.value, r.omitted_bytes) for r in browser.chromium_preferences(docs).collect())
    assert got == [(1, "homepage", "h1", None), (4, "homepage", "h4", None), (4, "profile.name", "Ann", None)]
    size = len('{"profile": {"name": "Ann"}, "homepage": "h4", "pad": ""}') + (33 << 20)
    bounded = browser.chromium_preferences(docs, most_bytes=32 << 20)
    assert sorted((r.id, r.setting, r.value, r.omitted_bytes) for r in bounded.collect()) == [(1, "homepage", "h1", None), (4, None, None, size), (5, None, None, size - 2)]


def test_whole_chains(spark):
    down = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, target_path string")
    chains = spark.createDataFrame([(1, i, f"u{i:02}") for i in range(25)], "id bigint, chain_index int, url string")
    for keep, n, omitted in ((None, 25, 0), (10, 10, 15)):
        a, b = browser.chromium_downloads(down, chains, keep).orderBy("id").collect()
        assert (a.url_chain, a.chain_omitted) == ([f"u{i:02}" for i in range(n)], omitted) and b.url_chain is None
    assert len(browser.chromium_downloads(down, chains).orderBy("id").first().url_chain) == 25
