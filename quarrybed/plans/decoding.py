"""Queries of the decoders: records put into the bytes of their formats by column expressions, and decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrybed.operators import search
from quarrybed.plans.registry import little, query, raw, utf16
from quarrybed.session import table
from quarrybed.sources.decoders import LINK_CLASS, decode, protected_sector

#: What a FILETIME becomes in SQL: microseconds since 1970, rounded down; none unless above 0.
_TIME = "CASE WHEN {t} > 0 THEN ({t} - 116444736000000000) // 10 - CASE WHEN ({t} - 116444736000000000) % 10 < 0 THEN 1 ELSE 0 END END"


def zeros(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n if isinstance(n, Column) else F.lit(n)))


def _counted(text: Column) -> Column:
    """A 16-bit text behind the number of its characters."""
    data = utf16(text)
    return F.concat(little(F.call_function("div", F.octet_length(data), F.lit(2)), 2), data)


@query(f"""
SELECT entry_id, 2 AS major_version, file_reference.entry || '-' || file_reference.sequence AS file_ref, parent_reference.entry || '-' || parent_reference.sequence AS parent_ref, usn, {_TIME.format(t="timestamp_filetime")} AS time_micros, reason, file_name
FROM (SELECT DISTINCT entry_id, file_reference, parent_reference, usn, timestamp_filetime, reason, file_name FROM usn_records WHERE file_reference.raw IS NOT NULL AND parent_reference.raw IS NOT NULL AND file_name IS NOT NULL)""")
def usn_journal_decoded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "usn_records").where("file_reference.raw is not null and parent_reference.raw is not null and file_name is not null")
    rows = rows.select("entry_id", F.col("file_reference.raw").alias("f"), F.col("parent_reference.raw").alias("p"), "usn", F.coalesce("timestamp_filetime", F.lit(0)).alias("t"), "reason", "file_name").dropDuplicates(["entry_id"])
    name = utf16("file_name")
    n = F.octet_length(name)
    length = F.call_function("div", 60 + n + 7, F.lit(8)) * 8
    data = F.concat(little(length, 4), little(F.lit(2), 2), little(F.lit(0), 2), little(F.col("f"), 8), little(F.col("p"), 8), little(F.col("usn"), 8), little(F.col("t"), 8), little(F.col("reason"), 4), zeros(12), little(n, 2), little(F.lit(60), 2), name, zeros((length - 60 - n).cast("int")))
    # zeros and a bad frame before the record are passed over
    out = decode(rows.select("entry_id", F.concat(zeros(16), raw(b"\xff" * 8), data).alias("bytes")), "usn_journal", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), "major_version", "file_ref", "parent_ref", "usn", "time_micros", "reason", "file_name")


@query(f"SELECT entry_id, file_path, {_TIME.format(t='raw_filetime')} AS modified_micros FROM (SELECT DISTINCT entry_id, file_path, raw_filetime FROM shimcache_entries WHERE file_path <> '')")
def shimcache_decoded(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shimcache_entries").where("file_path <> ''").select("entry_id", "file_path", "raw_filetime").dropDuplicates(["entry_id"])
    path = utf16("file_path")
    n = F.octet_length(path)
    entry = F.concat(raw(b"10ts\0\0\0\0"), little(n + 10, 4), little(n, 2), path, little(F.coalesce("raw_filetime", F.lit(0)), 8))
    out = decode(rows.select("entry_id", F.concat(zeros(52), entry).alias("bytes")), "shimcache", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), "file_path", "modified_micros")


@query("SELECT event_id, user_id AS run_count, CASE WHEN event_id % 2 = 0 THEN event_id END AS focus_count, CASE WHEN event_id % 2 = 0 THEN user_id * 3 END AS focus_millis, epoch_us(ts) AS last_run_micros FROM events")
def user_assist_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Both layouts: 72 bytes with focus, and the older one of 16 bytes."""
    t = little(F.unix_micros(F.col("ts").cast("timestamp")) * 10 + 116_444_736_000_000_000, 8)
    new = F.concat(zeros(4), little(F.col("user_id"), 4), little(F.col("event_id"), 4), little(F.col("user_id") * 3, 4), zeros(44), t, zeros(4))
    data = F.when(F.col("event_id") % 2 == 0, new).otherwise(F.concat(zeros(4), little(F.col("user_id"), 4), t))
    return decode(table(spark, d, "events").select("event_id", data.alias("bytes")), "user_assist", "event_id", "bytes").drop("status").withColumnRenamed("source_id", "event_id")


def _link(times: list[Column], size: Column, strings: dict[int, Column]) -> Column:
    flags = 128 | sum(strings)
    head = F.concat(little(F.lit(76), 4), raw(LINK_CLASS), little(F.lit(flags), 4), zeros(4), *[little(t, 8) for t in times], little(size, 4), zeros(20))
    return F.concat(head, *[_counted(strings[b]) for b in sorted(strings)])


_BIN = "(SELECT DISTINCT entry_id, coalesce(original_path, '') AS p, coalesce(original_filename, '') AS f, coalesce(user_sid, '') AS u, CASE WHEN original_file_size BETWEEN 0 AND 4294967295 THEN original_file_size ELSE 0 END AS n, coalesce(deletion_timestamp_filetime, 0) AS t FROM recycle_bin_records)"


def _binned(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("original_file_size").between(0, 4294967295), F.col("original_file_size")).otherwise(0)
    return table(spark, d, "recycle_bin_records").select("entry_id", *[F.coalesce(c, F.lit("")).alias(a) for c, a in (("original_path", "p"), ("original_filename", "f"), ("user_sid", "u"))], size.alias("n"), F.coalesce("deletion_timestamp_filetime", F.lit(0)).alias("t")).dropDuplicates(["entry_id"])


@query(f"SELECT entry_id, f AS description, p AS relative_path, u AS arguments, n AS target_size, {_TIME.format(t='t')} AS created_micros, p AS target FROM {_BIN} x")
def links_decoded(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    data = _link([t, F.lit(0), t], F.col("n"), {4: F.col("f"), 8: F.col("p"), 32: F.col("u")})
    out = decode(_binned(spark, d).select("entry_id", data.alias("bytes")), "shell_link", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), "description", "relative_path", "arguments", "target_size", "created_micros", "target")


@query(f"SELECT entry_id, 0 AS ordinal, p AS relative_path FROM {_BIN} x UNION ALL SELECT entry_id, 1, f FROM {_BIN} y")
def jump_lists_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Two links behind a list's own header."""
    zero = F.lit(0)
    data = F.concat(raw(b"header of a list"), _link([zero] * 3, zero, {8: F.col("p")}), raw(b"\0\0\0\0between"), _link([zero] * 3, zero, {8: F.col("f")}))
    out = decode(_binned(spark, d).select("entry_id", data.alias("bytes")), "custom_destinations", "entry_id", "bytes")
    return out.select(F.col("source_id").alias("entry_id"), "ordinal", "relative_path")


@query("SELECT p_partkey AS id, 17 AS version, 'P' || p_partkey || '.EXE' AS executable, '0x' || upper(lpad(to_hex(p_partkey * 7919), 8, '0')) AS path_hash, p_size AS run_count, p_name || '|' || p_brand AS files, CASE WHEN p_size > 5 THEN p_partkey * 1000 END AS last_run, p_size % 3 AS volume_count FROM part")
def prefetch_decoded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = utf16(F.format_string("P%d.EXE", k))
    files = F.concat(utf16("p_name"), zeros(2), utf16("p_brand"), zeros(2))
    stamp = F.when(F.col("p_size") > 5, k * 10_000 + 116_444_736_000_000_000).otherwise(0)
    data = F.concat(little(F.lit(17), 4), raw(b"SCCA"), zeros(8), name, zeros((60 - F.octet_length(name)).cast("int")), little(k * 7919, 4), zeros(20), little(F.lit(152), 4), little(F.octet_length(files), 4), zeros(4), little(F.col("p_size") % 3, 4), zeros(4), little(stamp, 8), zeros(16), little(F.col("p_size"), 4), zeros(4), files)
    out = decode(table(spark, d, "part").select(k.alias("id"), data.alias("bytes")), "prefetch", "id", "bytes")
    return out.select(F.col("source_id").alias("id"), "version", "executable", "path_hash", F.col("run_count").cast("int").alias("run_count"), F.array_join("referenced_files", "|").alias("files"), F.get("run_micros", F.lit(0)).alias("last_run"), F.col("volume_count").cast("int").alias("volume_count"))


@query("SELECT c_custkey AS id, c_name AS author, 'S-1-5-' || c_nationkey AS principals, CASE WHEN c_custkey % 2 = 0 THEN 'LogonTrigger' ELSE 'TimeTrigger' END AS triggers, 'C:\\a & b.exe /n ' || c_nationkey AS actions, c_custkey % 3 = 0 AS hidden FROM customer")
def tasks_decoded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    xml = F.concat(F.lit('<?xml version="1.0" encoding="UTF-16"?><Task xmlns="t"><RegistrationInfo><Author>'), "c_name", F.lit("</Author></RegistrationInfo><Triggers>"), F.when(k % 2 == 0, "<LogonTrigger/>").otherwise("<TimeTrigger/>"), F.lit("</Triggers><Principals><Principal><UserId>S-1-5-"), F.col("c_nationkey").cast("string"), F.lit("</UserId></Principal></Principals><Settings><Hidden>"), F.when(k % 3 == 0, "true").otherwise("false"), F.lit("</Hidden></Settings><Actions><Exec><Command>C:\\a &amp; b.exe</Command><Arguments>/n "), F.col("c_nationkey").cast("string"), F.lit("</Arguments></Exec></Actions></Task>"))
    data = F.when(k % 5 < 3, F.concat(raw(b"\xff\xfe"), utf16(xml))).otherwise(F.encode(xml, "UTF-8"))
    out = decode(table(spark, d, "customer").select(k.alias("id"), data.alias("bytes")), "scheduled_task", "id", "bytes")
    return out.select(F.col("source_id").alias("id"), "author", *[F.array_join(c, ",").alias(c) for c in ("principals", "triggers", "actions")], "hidden")


@query("SELECT c_custkey AS id, c_name AS profile_name, 'net ' || c_nationkey AS ssid, 'WPA2PSK' AS authentication, 'AES' AS encryption, c_custkey % 2 = 0 AS protected FROM customer")
def networks_decoded(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit('<WLANProfile xmlns="w"><name>'), "c_name", F.lit("</name><SSIDConfig><SSID><name>net "), F.col("c_nationkey").cast("string"), F.lit("</name></SSID></SSIDConfig><MSM><security><authEncryption><authentication>WPA2PSK</authentication><encryption>AES</encryption></authEncryption><sharedKey><protected>"), F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false"), F.lit("</protected></sharedKey></security></MSM></WLANProfile>"))
    out = decode(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.encode(xml, "UTF-8").alias("bytes")), "wifi_profile", "id", "bytes")
    return out.select(F.col("source_id").alias("id"), "profile_name", "ssid", "authentication", "encryption", "protected")


def _archive(members: list[tuple[Column, Column]]) -> Column:
    """An archive of stored members (name, bytes)."""
    local, central, at = [], [], F.lit(0)
    for name, data in members:
        label = F.encode(name, "UTF-8")
        shared = F.concat(little(F.lit(20), 2), little(F.lit(0x800), 2), zeros(2), zeros(2), little(F.lit(0x21), 2), little(F.crc32(data), 4), little(F.octet_length(data), 4), little(F.octet_length(data), 4), little(F.octet_length(label), 2), zeros(2))
        local.append(F.concat(raw(b"PK\x03\x04"), shared, label, data))
        central.append(F.concat(raw(b"PK\x01\x02"), little(F.lit(20), 2), shared, zeros(10), little(at, 4), label))
        at = at + 30 + F.octet_length(label) + F.octet_length(data)
    directory = F.concat(*central)
    end = F.concat(raw(b"PK\x05\x06"), zeros(4), little(F.lit(len(members)), 2), little(F.lit(len(members)), 2), little(F.octet_length(directory), 4), little(at, 4), zeros(2))
    return F.concat(*local, directory, end)


@query("""
WITH t AS (SELECT doc_id, octet_length(encode(text)) AS n, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'dir/d' || doc_id || '.TXT' AS member, n AS member_size, greatest(1, (n + 65535) // 65536) AS segments, CASE WHEN n <= 65536 AND n > 0 THEN md5(text) END AS digest FROM t UNION ALL SELECT doc_id, 'raw.bin', 3, 1, NULL FROM t""")
def zip_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    data = _archive([(F.format_string("dir/d%d.TXT", "doc_id"), F.encode("text", "UTF-8")), (F.lit("raw.bin"), raw(b"\0\1\2"))])
    out = decode(docs.select("doc_id", data.alias("bytes")), "zip_members", "doc_id", "bytes")
    sums = out.groupBy(F.col("source_id").alias("doc_id"), "member", "member_size").agg(F.count("*").alias("segments"), F.max("text").alias("text"))
    return sums.select("doc_id", "member", "member_size", "segments", F.when(F.col("segments") == 1, F.md5("text")).alias("digest"))


@query("SELECT p_partkey AS id, 0 AS segment_index, 'word/document.xml' AS part_name, p_name || chr(9) || p_brand || chr(10) || '<' || p_type || '>' AS body FROM part UNION ALL SELECT p_partkey, 1, 'word/comments.xml', 'note ' || p_size FROM part")
def word_documents(spark: SparkSession, d: str) -> DataFrame:
    open_, close = '<w:d xmlns:w="w">', "</w:d>"
    body = F.concat(F.lit(f"{open_}<w:p><w:r><w:t>"), "p_name", F.lit("</w:t><w:tab/><w:t>"), "p_brand", F.lit("</w:t></w:r></w:p><w:p/><w:p><w:t>&lt;"), "p_type", F.lit(f"&gt;</w:t></w:p>{close}"))
    notes = F.concat(F.lit(f"{open_}<w:p><w:t>note "), F.col("p_size").cast("string"), F.lit(f"</w:t></w:p>{close}"))
    data = _archive([(F.lit("word/comments.xml"), F.encode(notes, "UTF-8")), (F.lit("[Content_Types].xml"), raw(b"<Types/>")), (F.lit("word/document.xml"), F.encode(body, "UTF-8"))])
    out = decode(table(spark, d, "part").select(F.col("p_partkey").alias("id"), data.alias("bytes")), "word_document", "id", "bytes")
    return out.select(F.col("source_id").alias("id"), "segment_index", "part_name", F.col("text").alias("body"))


@query("SELECT doc_id, (octet_length(encode(text)) + 32767) // 32768 AS chunks, sha256(text) AS digest FROM documents WHERE text <> ''")
def image_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each text as the medium of an evidence image, in stored chunks with checksums."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("h"))
    parts = F.regexp_extract_all("h", F.lit("(?s).{1,65536}"), F.lit(0))
    sectors = F.unhex(F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("00000000"))), ""))
    size = F.octet_length(sectors)
    section = lambda kind, at, length: F.concat(raw(kind.ljust(16, b"\0")), little(at + length, 8), little(length, 8), zeros(44))
    at_sectors, at_table = F.lit(13 + 76 + 94), F.lit(13 + 76 + 94 + 76) + size
    entries = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.hex(little(i * 32772 + 13 + 76 + 94 + 76, 4))), ""))
    n = 4 * F.size(parts)
    data = F.concat(raw(b"EVF\x09\x0d\x0a\xff\x00\x01\x01\x00\x00\x00"), section(b"volume", F.lit(13), F.lit(76 + 94)), zeros(8), little(F.lit(64), 4), little(F.lit(512), 4), zeros(78), section(b"sectors", at_sectors, size + 76), sectors, section(b"table", at_table, n + 100), little(F.size(parts), 4), zeros(20), entries, section(b"done", at_table + n + 100, F.lit(0)))
    out = decode(docs.select("doc_id", data.alias("bytes")), "image_chunks", "doc_id", "bytes")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("media_offset", "bytes"))), lambda x: F.hex(x.bytes)), "")
    return out.groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("chunks"), F.sha2(F.unhex(whole), 256).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def lznt1_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts in the stored chunks of a compressed stream."""
    docs = table(spark, d, "documents").where("text <> ''")
    parts = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(?s).{1,8192}"), F.lit(0))
    chunk = lambda p: F.concat(F.hex(little(F.call_function("div", F.length(p), F.lit(2)) - 1 + 0x3000, 2)), p)
    data = F.unhex(F.concat(F.array_join(F.transform(parts, chunk), ""), F.lit("0000")))
    out = decode(docs.select("doc_id", data.alias("bytes")), "lznt1_stream", "doc_id", "bytes")
    return out.select(F.col("source_id").alias("doc_id"), F.sha2("bytes", 256).alias("digest"))


@query("""
SELECT event_id, 'recognized' AS status, 512 AS bytes_per_sector, '00000000-0000-0000-0000-' || lower(lpad(to_hex(event_id), 12, '0')) AS volume_guid, user_id * 512 AS first_metadata, (user_id * 1000) // 512 * 512 AS sector_start, (user_id * 1000) // 512 AS tweak FROM events""")
def protected_volumes(spark: SparkSession, d: str) -> DataFrame:
    start, tweak = protected_sector(F.col("user_id") * 1000)
    guid = F.concat(zeros(10), F.unhex(F.lpad(F.hex("event_id"), 12, "0")))
    data = F.concat(zeros(3), raw(b"-FVE-FS-"), little(F.lit(512), 2), zeros(147), guid, little(F.col("user_id") * 512, 8), zeros(16))
    ev = table(spark, d, "events").select("event_id", data.alias("bytes"), start.alias("sector_start"), tweak.alias("tweak"))
    out = decode(ev, "bitlocker_volume", "event_id", "bytes").select(F.col("source_id").alias("event_id"), "status", "bytes_per_sector", F.lower("volume_guid").alias("volume_guid"), F.get("metadata_offsets", F.lit(0)).alias("first_metadata"))
    return out.join(ev.drop("bytes"), "event_id")


def _streams(spark: SparkSession, d: str, size: int = 512) -> DataFrame:
    docs = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("source_id"), F.encode("text", "UTF-8").alias("bytes"))
    return search.chunked(docs, size, 64)


_AT = "octet_length(encode(left(text, instr({t}, {q}) - 1)))"


@query("""
WITH t AS (SELECT doc_id, text, instr(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') AS i FROM documents WHERE text <> ''),
r AS (SELECT doc_id, substr(text, i + 1) AS rest, i, text FROM t WHERE i > 0), n AS (SELECT doc_id, i + instr(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') AS j, octet_length(encode(left(text, i - 1))) AS pos, text, rest FROM r)
SELECT doc_id, CASE WHEN pos >= 1 THEN CAST(pos AS BIGINT) ELSE CAST(octet_length(encode(left(text, CAST(j - 1 AS BIGINT)))) AS BIGINT) END AS match_offset, 'ascii' AS encoding FROM n WHERE pos >= 1 OR instr(translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') > 0""")
def find_next(spark: SparkSession, d: str) -> DataFrame:
    """The first match at or after offset 1 of each stream."""
    return search.find_next(_streams(spark, d), "The ", 1).select(F.col("source_id").alias("doc_id"), F.col("offset").alias("match_offset"), "encoding")


@query("SELECT doc_id, hex(encode(text)[701:2000]) AS part FROM documents WHERE octet_length(encode(text)) > 700")
def byte_range(spark: SparkSession, d: str) -> DataFrame:
    """A range of bytes that several chunks hold."""
    return search.byte_range(_streams(spark, d), 700, 1300).select(F.col("source_id").alias("doc_id"), F.hex("bytes").alias("part"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS found FROM documents WHERE contains(text, chr(10))")
def pluggable_finder(spark: SparkSession, d: str) -> DataFrame:
    """Any finder over overlapping chunks; here line feeds."""

    def line_feeds(data: bytes):
        at = data.find(b"\n")
        while at >= 0:
            yield at, 1
            at = data.find(b"\n", at + 1)

    hits = search.found_by(_streams(spark, d), line_feeds, "line_feed")
    return hits.groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("found"))


@query("""
WITH t AS (SELECT doc_id, string_split(text, 'scan') AS parts FROM documents WHERE contains(text, 'scan')), o AS (SELECT doc_id, octet_length(encode(array_to_string(parts[1:i], 'scan'))) AS pos FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM t))
SELECT doc_id, CAST(pos AS BIGINT) AS match_offset FROM o WHERE pos > 300""")
def raw_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Hits that follow a cursor."""
    hits = search.raw_search(_streams(spark, d), "hex: 73 63 61 6e")
    return search.after_cursor(hits, 300, 0, "hex").select(F.col("source_id").alias("doc_id"), F.col("offset").alias("match_offset"))


class BinaryXml:
    """Writes the binary XML of an event's definition at a place in a chunk; names stand where they are first used."""

    def __init__(self, at: int):
        self.at, self.out, self.names = at, bytearray(), {}

    def name(self, text: str) -> None:
        here = self.at + len(self.out) + 4
        first = text not in self.names
        where = self.names.setdefault(text, here)
        self.out += where.to_bytes(4, "little")
        if first:
            self.out += bytes(6) + len(text).to_bytes(2, "little") + text.encode("utf-16-le") + bytes(2)

    def open(self, name: str, **attributes: tuple[int, int] | str) -> None:
        self.out += (b"\x41" if attributes else b"\x01") + b"\xff\xff" + bytes(4)
        self.name(name)
        if attributes:
            self.out += bytes(4)
        for key, value in attributes.items():
            self.out += b"\x06"
            self.name(key)
            self.text(value) if isinstance(value, str) else self.value(*value)
        self.out += b"\x02"

    def text(self, text: str) -> None:
        self.out += b"\x05\x01" + len(text).to_bytes(2, "little") + text.encode("utf-16-le")

    def value(self, index: int, kind: int) -> None:
        self.out += b"\x0d" + index.to_bytes(2, "little") + bytes([kind])

    def close(self) -> None:
        self.out += b"\x04"


#: Where the definition stands in a chunk: behind a record's and a template's head.
_DEFINITION = 512 + 24 + 4 + 10


def event_definition() -> bytes:
    """An event whose number, time, computer, account and one datum are values 0 to 4."""
    x = BinaryXml(_DEFINITION + 24)
    x.out += b"\x0f\x01\x01\x00"
    x.open("Event")
    x.open("System")
    x.open("Provider", Name="Invented-Provider")
    x.close()
    x.open("EventID")
    x.value(0, 6)
    x.close()
    x.open("TimeCreated", SystemTime=(1, 17))
    x.close()
    x.open("Computer")
    x.value(2, 1)
    x.close()
    x.open("Security", UserID=(3, 19))
    x.close()
    x.close()
    x.open("EventData")
    x.open("Data", Name="kind")
    x.value(4, 1)
    x.close()
    x.close()
    x.close()
    body = bytes(x.out) + b"\x00"
    return bytes(4) + bytes(16) + len(body).to_bytes(4, "little") + body


@query("""
SELECT event_id AS id, 'recognized' AS status, event_id AS record_id, epoch_us(ts) AS written_micros, event_id % 60000 AS number, 'Invented-Provider' AS provider, 'pc' || user_id AS computer, epoch_us(ts) AS created_micros, 'S-1-5-' || user_id AS user_sid, event_type AS kind FROM events""")
def event_logs_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Logs of one record each, with the record's template."""
    t = little(F.unix_micros(F.col("ts").cast("timestamp")) * 10 + 116_444_736_000_000_000, 8)
    computer, kind = utf16(F.format_string("pc%d", "user_id")), utf16("event_type")
    account = F.concat(raw(b"\x01\x01\0\0\0\0\0\x05"), little(F.col("user_id"), 4))
    values = [(little(F.col("event_id") % 60000, 2), 6), (t, 17), (computer, 1), (account, 19), (kind, 1)]
    heads = F.concat(little(F.lit(len(values)), 4), *[F.concat(little(F.octet_length(v), 2), little(F.lit(k), 2)) for v, k in values])
    body = F.concat(raw(b"\x0f\x01\x01\x00\x0c\x01\0\0\0\0"), little(F.lit(_DEFINITION), 4), raw(event_definition()), heads, *[v for v, _ in values], raw(b"\0"))
    size = F.octet_length(body) + 28
    record = F.concat(raw(b"\x2a\x2a\0\0"), little(size, 4), little(F.col("event_id"), 8), t, body, little(size, 4))
    chunk = F.concat(raw(b"ElfChnk\0"), zeros(40), little(512 + size, 4), zeros(460), record)
    data = F.concat(raw(b"ElfFile\0"), zeros(4088), chunk)
    out = decode(table(spark, d, "events").select("event_id", data.alias("bytes")), "event_log", "event_id", "bytes")
    return out.select(F.col("source_id").alias("id"), "status", "record_id", "written_micros", F.col("event_id").alias("number"), "provider", "computer", "created_micros", "user_sid", F.get_json_object("data_json", "$.kind").alias("kind"))
