"""String, path and byte expressions. Case folding touches ASCII letters only unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROT = {c: s[(i + 13) % 26] for s in (UPPER, LOWER) for i, c in enumerate(s)}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_any(cols: list[Column], query: str) -> Column:
    """Whether any of the columns contains the query, ASCII letters folded; null columns do not."""
    q = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in query)
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.instr(ascii_lower(c), q) > 0, F.lit(False))
    return test


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def source_path(c: Column) -> Column:
    """Backslashes turned, slashes at both ends removed."""
    return F.btrim(slashes(c), F.lit("/"))


def windows_path(c: Column) -> Column:
    """Lower case, forward slashes, one leading slash."""
    p = ascii_lower(slashes(c))
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def leaf(c: Column) -> Column:
    """The file name of a path or address: no trailing slashes, query or fragment; null if nothing is left."""
    head = F.regexp_replace(F.trim(c), r"[/\\]+$", "")
    name = F.trim(F.regexp_extract(F.regexp_extract(head, r"^[^?#]*", 0), r"[^/\\]*$", 0))
    return F.nullif(name, F.lit(""))


def parent_and_leaf(c: Column) -> Column:
    """STRUCT<parent, name> at the last slash; a path without one has parent ''."""
    cut = F.length(c) - F.length(F.substring_index(c, "/", -1))
    return F.struct(F.when(cut > 1, F.substr(c, F.lit(1), cut - 1)).otherwise("").alias("parent"), F.substring_index(c, "/", -1).alias("name"))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


#: Parts of a profile path and the browser they mean, in order of precedence.
BRANDS = (("google/chrome", "chrome"), ("google-chrome", "chrome"), ("microsoft/edge", "edge"), ("microsoft-edge", "edge"), ("bravesoftware", "brave"), ("brave-browser", "brave"), ("opera", "opera"), ("chromium", "chromium"))


def browser_brand(path: Column) -> Column:
    p, out = ascii_lower(slashes(path)), F.lit(None).cast("string")
    for part, brand in reversed(BRANDS):
        out = F.when(p.contains(part), brand).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    """1,234,567"""
    return F.format_number(n.cast("bigint"), 0)


def human_size(n: Column) -> Column:
    """One decimal and the unit from 1 KB on, whole bytes below; powers of 1024 up to TB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_duration(micros: Column) -> Column:
    """Hours, minutes and seconds to tenths, half up: ``1h 2m 3.4s``."""
    tenths = F.call_function("div", F.abs(micros) + 50_000, F.lit(100_000).cast("bigint"))
    whole = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint")).cast("string")
    hours, minutes, rest = whole(tenths, 36_000), whole(tenths % 36_000, 600), tenths % 600
    seconds = F.concat(whole(rest, 10), F.lit("."), (rest % 10).cast("string"), F.lit("s"))
    text = F.when(tenths >= 36_000, F.concat(hours, F.lit("h "), minutes, F.lit("m "), seconds)).when(tenths >= 600, F.concat(minutes, F.lit("m "), seconds)).otherwise(seconds)
    return F.concat(F.when(micros < 0, "-").otherwise(""), text)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rot13(c: Column) -> Column:
    return F.translate(c, "".join(_ROT), "".join(_ROT.values()))


def canonical_guid(hex32: Column) -> Column:
    """32 hex digits to 8-4-4-4-12 in lower case; null if there are not 32."""
    h = F.lower(F.regexp_replace(hex32, r"[{}\-]", ""))
    return F.when(h.rlike("^[0-9a-f]{32}$"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def sid_of_path(path: Column) -> Column:
    """The first path segment that begins with ``S-1-``."""
    return F.nullif(F.regexp_extract(slashes(path), r"(?i)(?:^|/)(S-1-[^/]*)", 1), F.lit(""))


def app_of_usage_record(name: Column) -> Column:
    """The application behind a usage record's name: ``!!program!…[service]`` reads ``program [service]``, volume devices
    read ``C:``; a blank name is unknown."""
    t = F.trim(name)
    program, service = F.regexp_extract(t, r"^!!([^!]+)", 1), F.regexp_extract(t, r"(\[[^\[\]!]*\])(?:!|$)", 1)
    plain = F.regexp_replace(t, r"(?i)^\\device\\harddiskvolume[^\\]*\\", "C:\\\\")
    return F.when(t == "", "Unknown Application").when(program != "", F.trim(F.concat_ws(" ", program, service))).otherwise(plain)


def recycled_data_name(name: Column) -> Column:
    """``$I…`` to the ``$R…`` that holds the data; other names are kept."""
    return F.when(F.lower(F.substring(name, 1, 2)) == "$i", F.concat(F.lit("$R"), F.substr(name, F.lit(3)))).otherwise(name)


def path_extension(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9_]+)$", 1)), F.lit(""))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(slashes(path), "/"), lambda x: x != "")


def path_prefixes(path: Column) -> Column:
    """Every proper ancestor of a path, as paths."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))


def short_key(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


# Bytes ---------------------------------------------------------------------------------------------------------------


def latin1(b: Column) -> Column:
    """Bytes as text of one character per byte."""
    return F.decode(b, "ISO-8859-1")


def byte_find(b: Column, needle: bytes, fold: bool = False) -> Column:
    """Offset of the first match, from 0, or null."""
    hay, pin = latin1(b), needle.decode("latin-1")
    if fold:
        hay, pin = ascii_lower(hay), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pin)
    at = F.instr(hay, pin)
    return F.when(at > 0, (at - 1).cast("bigint"))


def hex_preview(b: Column, offset: Column, length: int, around: int = 8) -> Column:
    """The bytes about a match as spaced hex."""
    start = F.greatest(offset - around, F.lit(0))
    cut = F.substr(b, (start + 1).cast("int"), (offset + length + around - start).cast("int"))
    return F.rtrim(F.regexp_replace(F.hex(cut), "(..)", "$1 "))


def ascii_preview(b: Column, offset: Column, length: int, around: int = 8) -> Column:
    start = F.greatest(offset - around, F.lit(0))
    return F.regexp_replace(latin1(F.substr(b, (start + 1).cast("int"), (offset + length + around - start).cast("int"))), r"[^ -~]", ".")


def utf16_until_nul(b: Column) -> Column:
    return F.split_part(F.decode(b, "UTF-16LE"), F.lit("\x00"), F.lit(1))


def text_by_mark(b: Column) -> Column:
    """Text by its byte order mark, else UTF-8; undecodable bytes become replacement characters."""
    h = F.hex(F.substring(b, 1, 3))
    body = lambda n, cs: F.decode(F.substr(b, F.lit(n)), cs)
    return F.when(h.startswith("FFFE"), body(3, "UTF-16LE")).when(h.startswith("FEFF"), body(3, "UTF-16BE")).when(h == "EFBBBF", F.try_validate_utf8(F.substr(b, F.lit(4)).cast("string"))).otherwise(F.make_valid_utf8(b.cast("string")))


#: Leading bytes (hex) of well-known formats, extension and media type.
MAGIC = (("FFD8FF", "jpg", "image/jpeg"), ("89504E470D0A1A0A", "png", "image/png"), ("47494638", "gif", "image/gif"), ("424D", "bmp", "image/bmp"), ("255044462D", "pdf", "application/pdf"), ("504B0304", "zip", "application/zip"), ("1F8B08", "gz", "application/gzip"), ("526172211A07", "rar", "application/vnd.rar"), ("4D5A", "exe", "application/x-msdownload"), ("53514C69746520666F726D6174203300", "sqlite", "application/vnd.sqlite3"))
ALIASES = {"jpeg": "jpg", "jpe": "jpg", "docx": "zip", "xlsx": "zip", "pptx": "zip", "jar": "zip", "apk": "zip", "db": "sqlite", "dll": "exe", "sys": "exe", "dib": "bmp", "tgz": "gz"}


def sniffed(b: Column, what: str = "extension") -> Column:
    h, out = F.hex(F.substring(b, 1, 16)), F.lit(None).cast("string")
    for magic, ext, media in reversed(MAGIC):
        out = F.when(h.startswith(magic), ext if what == "extension" else media).otherwise(out)
    return out


def signature_outcome(name: Column, head: Column) -> Column:
    """match, alias, mismatch, unknown, no_extension or unreadable: a name's extension against its first bytes."""
    ext, found = path_extension(name), sniffed(head)
    alias = F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv])
    return F.when(head.isNull() | (F.octet_length(head) == 0), "unreadable").when(found.isNull(), "unknown").when(ext.isNull(), "no_extension").when(ext == found, "match").when(F.try_element_at(alias, ext) == found, "alias").otherwise("mismatch")


# Queries of bytes ------------------------------------------------------------------------------------------------------


def strict_hex(text: str) -> bytes:
    """Bytes of a hex pattern that may hold ``0x``, blanks, commas, dashes and colons."""
    digits = re.sub(r"[\s,:-]", "", re.sub(r"0[xX]", "", text))
    if not digits or not re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", digits):
        raise ValueError("a hex pattern needs whole bytes of hex digits")
    return bytes.fromhex(digits)


def lenient_hex(query: str) -> bytes | None:
    """Bytes of a query that says ``hex:``, ``bytes:`` or ``0x``; None if it says no such thing or is malformed."""
    m = re.fullmatch(r"\s*(?:hex:|bytes:|0x)([0-9a-f\s_-]*)\s*", query, re.I | re.A)
    digits = re.sub(r"[\s_-]", "", m[1]) if m else ""
    return bytes.fromhex(digits) if digits and len(digits) % 2 == 0 else None


def overlap_bytes(query: str) -> int:
    """How many bytes of a chunk the next one must see again."""
    return max(len(lenient_hex(query) or b""), len(query.encode()), len(query.encode("utf-16-le"))) - 1 if query else 0
