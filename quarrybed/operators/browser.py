"""Browser activity from the tables of a profile. Every function takes frames with the tables' own columns.

A column that an older profile lacks is null; a table that it lacks is None.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybed.functions import labels, text, times
from quarrybed.operators.records import ordered_chain

RECORD = ("record_kind", "record_id", "url", "title", "at_micros", "detail")


def _col(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _records(df: DataFrame, kind: str, record_id: Column, url: Column, title: Column, at: Column, **detail: Column) -> DataFrame:
    extra = F.to_json(F.struct(*[v.alias(k) for k, v in detail.items()])) if detail else F.lit("{}")
    return df.select(F.lit(kind).alias("record_kind"), record_id.cast("bigint").alias("record_id"), url.alias("url"), title.alias("title"), at.cast("bigint").alias("at_micros"), extra.alias("detail"))


def display_name(title: Column, url: Column) -> Column:
    return F.substring(F.coalesce(F.nullif(F.trim(title), F.lit("")), url), 1, 180)


def chromium_visits(visits: DataFrame, urls: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Visits with their addresses, the visits they came from and opened them, transition labels and instants.

    Predecessors are joined before any limit, so that a kept visit can still be explained by one that is not.
    """
    v = visits.select(F.col("id").alias("visit_id"), F.col("url").alias("url_id"), F.col("visit_time").cast("bigint").alias("visit_time"), *[_col(visits, c, "bigint").alias(c) for c in ("from_visit", "opener_visit", "transition", "visit_duration")], _col(visits, "external_referrer_url", "string").alias("external_referrer_url"))
    u = urls.select(F.col("id").alias("url_id"), F.col("url").alias("url"), _col(urls, "title", "string").alias("title"), *[_col(urls, c, "bigint").alias(c) for c in ("visit_count", "typed_count", "hidden")])
    seen = v.select("visit_id", "url_id", "visit_time").join(u.select("url_id", "url"), "url_id")
    ref = seen.select(F.col("visit_id").alias("from_visit"), F.col("url").alias("referrer_url"), times.chrome_micros(F.col("visit_time")).alias("referrer_micros"))
    opener = seen.select(F.col("visit_id").alias("opener_visit"), F.col("url").alias("opener_url"))
    out = v.join(u, "url_id").join(ref, "from_visit", "left").join(opener, "opener_visit", "left")
    if sources is not None:
        out = out.join(sources.select(F.col("id").alias("visit_id"), F.col("source").alias("source_code")), "visit_id", "left")
    else:
        out = out.withColumn("source_code", F.lit(None).cast("bigint"))
    t = F.col("transition")
    return out.select("visit_id", "url_id", "url", "title", display_name(F.col("title"), F.col("url")).alias("display_name"), text.host(F.col("url")).alias("host"), times.chrome_micros(times.nonzero(F.col("visit_time"))).alias("visit_micros"), labels.transition_type(t).alias("transition_type"), labels.transition_qualifiers(t).alias("qualifiers"), labels.is_redirect(t).alias("is_redirect"), labels.is_user_initiated(t).alias("user_initiated"), "visit_duration", F.when(F.col("visit_duration") > 0, text.human_duration(F.col("visit_duration"))).alias("duration_human"), labels.visit_source(F.col("source_code")).alias("visit_source"), "referrer_url", "referrer_micros", "opener_url", "external_referrer_url", "visit_count", "typed_count", "hidden")


def chromium_searches(terms: DataFrame, urls: DataFrame) -> DataFrame:
    """Search terms with their address and their number among equal ones. Ties of rows fall to the row id."""
    n = F.row_number().over(Window.partitionBy("term", "url_id").orderBy("rowid"))
    u = urls.select(F.col("id").alias("url_id"), "url", F.col("last_visit_time").cast("bigint").alias("last_visit_time"))
    return terms.withColumn("ordinal", n).join(u, "url_id").select("term", "url_id", "url", times.chrome_micros(times.nonzero(F.col("last_visit_time"))).alias("at_micros"), "ordinal")


def chromium_autofill(autofill: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Form values with first and last use and count; older profiles keep the dates in a table of their own."""
    a = autofill.select(*[_col(autofill, c, "string").alias(c) for c in ("name", "value")], *[_col(autofill, c, "bigint").alias(c) for c in ("count", "date_created", "date_last_used", "pair_id")])
    if dates is None:
        return a.select("name", "value", F.col("count").alias("uses"), F.col("date_created").alias("first_used"), F.col("date_last_used").alias("last_used"))
    d = F.nullif("date_created", F.lit(0).cast("bigint"))
    old = dates.groupBy("pair_id").agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"), F.count(d).alias("n"))
    j = a.join(old, "pair_id", "left")
    return j.select("name", "value", F.coalesce("count", "n").alias("uses"), F.coalesce("date_created", "first_date").alias("first_used"), F.coalesce("date_last_used", "last_date").alias("last_used"))


def chromium_downloads(downloads: DataFrame, chains: DataFrame | None = None, keep: int | None = None) -> DataFrame:
    """Downloads with the chain of addresses they came by, state, danger, duration and outcome.

    Chains are whole; if only the first ``keep`` addresses are asked for, ``chain_omitted`` counts the others.
    """
    cols = {"target_path": "string", "referrer": "string", "mime_type": "string", "start_time": "bigint", "end_time": "bigint", "received_bytes": "bigint", "total_bytes": "bigint", "state": "bigint", "danger_type": "bigint", "interrupt_reason": "bigint"}
    x = downloads.select("id", *[_col(downloads, c, k).alias(c) for c, k in cols.items()])
    if chains is not None:
        c = ordered_chain(chains.where("url is not null"), ["id"], "url", "chain_index", keep)
        x = x.join(c.select("id", F.col("chain").alias("url_chain"), F.col("first_value").alias("original_url"), F.col("last_value").alias("final_url"), F.col("omitted").alias("chain_omitted")), "id", "left")
    else:
        x = x.select("*", F.lit(None).cast("array<string>").alias("url_chain"), *[F.lit(None).cast("string").alias(c) for c in ("original_url", "final_url")], F.lit(None).cast("bigint").alias("chain_omitted"))
    took = times.download_duration(F.col("start_time"), F.col("end_time"))
    human = text.human_duration(took)
    return x.select("id", "target_path", text.leaf(F.col("target_path")).alias("file_name"), "original_url", "final_url", "url_chain", "chain_omitted", times.download_micros(F.col("start_time")).alias("start_micros"), times.download_micros(F.col("end_time")).alias("end_micros"), labels.label(F.col("state"), labels.DOWNLOAD_STATES).alias("state"), labels.label(F.col("danger_type"), labels.DANGERS).alias("danger"), labels.label(F.col("interrupt_reason"), labels.INTERRUPTS).alias("interrupt_reason"), labels.percent_complete(F.col("received_bytes"), F.col("total_bytes")).alias("percent_complete"), human.alias("duration_human"), labels.download_outcome(F.col("state"), F.col("received_bytes"), F.col("total_bytes"), human, F.col("interrupt_reason")).alias("outcome"))


def chromium_logins(logins: DataFrame) -> DataFrame:
    """Saved logins; what is encrypted is shown as hex with its length and never opened."""
    return logins.select("origin_url", _col(logins, "action_url", "string").alias("action_url"), _col(logins, "username_value", "string").alias("username"), times.chrome_micros(times.nonzero(_col(logins, "date_created", "bigint"))).alias("created_micros"), times.chrome_micros(times.nonzero(_col(logins, "date_last_used", "bigint"))).alias("used_micros"), _col(logins, "times_used", "bigint").alias("times_used"), F.hex("password_value").alias("ciphertext_hex"), F.octet_length("password_value").alias("ciphertext_bytes"))


def chromium_cookies(cookies: DataFrame) -> DataFrame:
    micros = lambda c: times.chrome_micros(times.nonzero(_col(cookies, c, "bigint")))
    return cookies.select("host_key", "name", _col(cookies, "path", "string").alias("path"), micros("creation_utc").alias("created_micros"), micros("expires_utc").alias("expires_micros"), micros("last_access_utc").alias("used_micros"), *[(_col(cookies, c, "bigint") == 1).alias(c) for c in ("is_secure", "is_httponly")], _col(cookies, "value", "string").alias("value"), F.octet_length(_col(cookies, "encrypted_value", "binary")).alias("encrypted_bytes"))


def bookmark_paths(nodes: DataFrame, id_: str = "node_id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """Each node with the names above it, by the hierarchy operator; loops are told by depth -1."""
    from quarrybed.operators.hierarchy import build_trees

    edges = nodes.select(F.lit(0).cast("bigint").alias("t"), F.col(id_).cast("string").alias("v"), F.col(parent).cast("string").alias("p"), F.col(name).alias("name"))
    trees = build_trees(edges).select(F.col("v").alias(id_), "depth", "path")
    return nodes.withColumn(id_, F.col(id_).cast("string")).join(trees, id_, "left")


def firefox_visits(visits: DataFrame, places: DataFrame) -> DataFrame:
    p = places.select(F.col("id").alias("place_id"), "url", _col(places, "title", "string").alias("title"), _col(places, "visit_count", "bigint").alias("visit_count"))
    return visits.join(p, "place_id").select(F.col("id").alias("visit_id"), "url", "title", F.col("visit_date").cast("bigint").alias("visit_micros"), labels.label(F.col("visit_type"), labels.FIREFOX_VISITS, "unknown").alias("visit_type"), "visit_count")


def firefox_bookmarks(bookmarks: DataFrame, places: DataFrame) -> DataFrame:
    """Bookmarks (type 1) with their folder's title."""
    folder = bookmarks.select(F.col("id").alias("parent"), F.col("title").alias("folder"))
    p = places.select(F.col("id").alias("fk"), "url")
    return bookmarks.where("type = 1").join(folder, "parent", "left").join(p, "fk", "left").select("id", "title", "url", "folder", F.nullif("dateAdded", F.lit(0).cast("bigint")).alias("added_micros"))


def firefox_annotated_downloads(annos: DataFrame, attributes: DataFrame, places: DataFrame) -> DataFrame:
    kinds = attributes.where(F.col("name").isin("downloads/destinationFileURI", "downloads/metaData")).select(F.col("id").alias("anno_attribute_id"), F.col("name").alias("annotation"))
    return annos.join(kinds, "anno_attribute_id").join(places.select(F.col("id").alias("place_id"), "url"), "place_id").select("id", "url", "annotation", "content", F.col("dateAdded").alias("at_micros"))


def firefox_searches(history: DataFrame) -> DataFrame:
    return history.where("fieldname = 'searchbar-history'").select("id", F.col("value").alias("term"), F.col("timesUsed").alias("uses"), F.nullif("firstUsed", F.lit(0).cast("bigint")).alias("first_micros"), F.nullif("lastUsed", F.lit(0).cast("bigint")).alias("last_micros"))


def safari_visits(visits: DataFrame, items: DataFrame) -> DataFrame:
    i = items.select(F.col("id").alias("history_item"), "url", _col(items, "visit_count", "bigint").alias("visit_count"))
    return visits.join(i, "history_item").select(F.col("id").alias("visit_id"), "url", "title", times.safari_micros(F.col("visit_time")).alias("visit_micros"), "visit_count")


def activity_stream(parts: dict[str, DataFrame]) -> DataFrame:
    """Records of all kinds in one frame of ``RECORD`` columns; frames that a profile lacks are left out."""
    made = []
    for kind, df in parts.items():
        has = lambda *names, d=df: F.coalesce(*[F.col(n).cast("string") for n in names if n in d.columns], F.lit(None).cast("string"))
        at = [F.col(n) for n in ("visit_micros", "start_micros", "at_micros", "created_micros", "added_micros", "last_micros") if n in df.columns]
        rid = [F.col(n) for n in ("visit_id", "id", "url_id") if n in df.columns]
        made.append(_records(df, kind, rid[0] if rid else F.lit(None), has("url", "final_url", "origin_url", "host_key"), has("title", "file_name", "term", "name"), at[0] if at else F.lit(None)))
    return reduce(DataFrame.unionByName, made)


def record_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("record_kind").agg(F.count("*").alias("records"), F.min("at_micros").alias("first_micros"), F.max("at_micros").alias("last_micros"))


# Further tables of a profile ----------------------------------------------------------------------------------------------


def chromium_urls(urls: DataFrame) -> DataFrame:
    return urls.select(F.col("id").alias("url_id"), "url", _col(urls, "title", "string").alias("title"), display_name(_col(urls, "title", "string"), F.col("url")).alias("display_name"), text.host(F.col("url")).alias("host"), *[_col(urls, c, "bigint").alias(c) for c in ("visit_count", "typed_count", "hidden")], times.chrome_micros(times.nonzero(_col(urls, "last_visit_time", "bigint"))).alias("at_micros"))


def chromium_shortcuts(shortcuts: DataFrame) -> DataFrame:
    """What was typed into the address bar and where it led; ids may be text."""
    return shortcuts.select(F.col("id").cast("string").alias("shortcut_id"), _col(shortcuts, "text", "string").alias("term"), _col(shortcuts, "url", "string").alias("url"), _col(shortcuts, "contents", "string").alias("title"), times.chrome_micros(times.nonzero(_col(shortcuts, "last_access_time", "bigint"))).alias("at_micros"), _col(shortcuts, "number_of_hits", "bigint").alias("hits"))


#: Settings worth a record, as paths of the settings document.
PREFERENCES = ("profile.name", "profile.created_by_version", "profile.last_engagement_time", "download.default_directory", "savefile.default_directory", "homepage", "session.startup_urls", "account_info", "google.services.last_username", "intl.accept_languages", "signin.allowed", "sync.requested")


def chromium_preferences(documents: DataFrame, content: str = "content", most_bytes: int | None = None) -> DataFrame:
    """Selected settings of each document; unreadable ones give none.

    Documents of any length are read. With a bound, each document over it gives one row without a setting, with its
    length as ``omitted_bytes``, which is null otherwise.
    """
    size = F.octet_length(content).cast("bigint")
    over = F.lit(False) if most_bytes is None else F.coalesce(size > most_bytes, F.lit(False))
    text_ = F.col(content).cast("string")
    read = documents.withColumn("v", F.when(~over, F.try_parse_json(text_)))
    # a variant holds at most 16 MiB
    value = lambda p: F.when((size > 8 << 20) & F.col("v").isNull(), F.get_json_object(text_, f"$.{p}")).otherwise(F.try_variant_get("v", f"$.{p}", "string"))
    pair = lambda setting, value, omitted: F.struct(setting.cast("string").alias("setting"), value.cast("string").alias("value"), omitted.cast("bigint").alias("omitted_bytes"))
    none = F.lit(None)
    pairs = F.filter(F.array(*[pair(F.lit(p), value(p), none) for p in PREFERENCES]), lambda p: p.value.isNotNull())
    rows = F.when(over, F.array(pair(none, none, size))).otherwise(pairs)
    return read.select(*[c for c in documents.columns if c != content], F.explode(rows).alias("p")).select("*", "p.setting", "p.value", "p.omitted_bytes").drop("p")


def firefox_urls(places: DataFrame) -> DataFrame:
    """Places, last visited first, those never visited at the end."""
    last = F.coalesce(_col(places, "last_visit_date", "bigint"), F.lit(0).cast("bigint"))
    return places.orderBy(last.desc(), F.col("id").desc()).select(F.col("id").alias("url_id"), "url", _col(places, "title", "string").alias("title"), _col(places, "visit_count", "bigint").alias("visit_count"), F.nullif(last, F.lit(0).cast("bigint")).alias("at_micros"))


def firefox_old_downloads(downloads: DataFrame) -> DataFrame:
    return downloads.select("id", _col(downloads, "name", "string").alias("file_name"), _col(downloads, "source", "string").alias("url"), _col(downloads, "target", "string").alias("target_path"), _col(downloads, "startTime", "bigint").alias("start_micros"), _col(downloads, "endTime", "bigint").alias("end_micros"), labels.label(_col(downloads, "state", "bigint"), labels.FIREFOX_DOWNLOADS).alias("state"), labels.percent_complete(_col(downloads, "currBytes", "bigint"), _col(downloads, "maxBytes", "bigint")).alias("percent_complete"))


def firefox_logins(documents: DataFrame, content: str = "content") -> DataFrame:
    """Saved logins of a JSON document; what is encrypted stays so, times are milliseconds."""
    one = "struct<id bigint, hostname string, formSubmitURL string, encryptedUsername string, encryptedPassword string, timeCreated bigint, timeLastUsed bigint, timesUsed bigint>"
    rows = documents.select(F.explode(F.from_json(F.col(content).cast("string"), f"struct<logins: array<{one}>>").logins).alias("x")).select("x.*")
    return rows.select("id", F.col("hostname").alias("origin_url"), F.col("formSubmitURL").alias("action_url"), F.char_length("encryptedUsername").alias("username_cipher_chars"), F.char_length("encryptedPassword").alias("password_cipher_chars"), (F.col("timeCreated") * 1000).alias("created_micros"), (F.col("timeLastUsed") * 1000).alias("used_micros"), F.col("timesUsed").alias("times_used"))


def firefox_cookies(cookies: DataFrame) -> DataFrame:
    micros = lambda c: F.nullif(_col(cookies, c, "bigint"), F.lit(0).cast("bigint"))
    return cookies.select("id", F.col("host").alias("host_key"), "name", micros("creationTime").alias("created_micros"), micros("lastAccessed").alias("used_micros"), (micros("expiry") * 1_000_000).alias("expires_micros"), *[(_col(cookies, c, "bigint") == 1).alias(n) for c, n in (("isSecure", "is_secure"), ("isHttpOnly", "is_httponly"))], _col(cookies, "value", "string").alias("value"))


def safari_urls(items: DataFrame) -> DataFrame:
    return items.orderBy(F.coalesce(_col(items, "visit_count", "bigint"), F.lit(0)).desc(), F.col("id").desc()).select(F.col("id").alias("url_id"), "url", _col(items, "visit_count", "bigint").alias("visit_count"), _col(items, "domain_expansion", "string").alias("domain"))


#: Names of a profile's files, the main one first.
PROFILE_FILES = {
    "chromium": ("History", "Login Data", "Cookies", "Web Data", "Bookmarks", "Preferences", "Shortcuts"),
    "firefox": ("places.sqlite", "formhistory.sqlite", "logins.json", "cookies.sqlite", "downloads.sqlite"),
    "safari": ("History.db", "Bookmarks.plist", "Downloads.plist", "Cookies.binarycookies"),
}


def profile_files(entries: DataFrame) -> DataFrame:
    """Indexed entries that belong to browser profiles, side files included: family, profile folder, file.

    Cookies below a ``Network`` folder belong to the profile above it and come before others of their name.
    """
    path = text.source_path(F.coalesce(F.col("logical_path"), F.lit("")))
    name = F.col("entry_name")
    base = F.regexp_replace(name, r"-(?:wal|shm|journal)$", "")
    family = F.lit(None).cast("string")
    for f, names in PROFILE_FILES.items():
        family = F.coalesce(family, F.when(base.isin(*names), f))
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    network = folder.endswith("/Network")
    return entries.select("entry_id", "evidence_id", family.alias("family"), F.when(network, F.regexp_replace(folder, "/Network$", "")).otherwise(folder).alias("profile"), name.alias("file"), F.when(network, 0).otherwise(1).alias("preference"), text.browser_brand(path).alias("brand")).where("family is not null")


def with_source(stream: DataFrame, files: DataFrame, artifact: str = "source_file") -> DataFrame:
    """Records with the indexed entry they came from: by file name within the profile, the preferred one of several."""
    best = files.groupBy(F.col("file").alias(artifact), "profile").agg(F.min_by("entry_id", F.struct("preference", "entry_id")).alias("source_entry_id"), F.min("brand").alias("brand"))
    key = F.concat(F.lit("browser-profile:v1:"), F.col("profile"))
    return stream.join(best, [artifact, "profile"], "left").withColumn("derivation_key", key).withColumn("record_prefix", text.short_key(key))
