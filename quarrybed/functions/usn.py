"""Column expressions for change-journal records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reason bits of a change-journal record (public file-system documentation).
REASONS = {
    0x00000001: "USN_REASON_DATA_OVERWRITE",
    0x00000002: "USN_REASON_DATA_EXTEND",
    0x00000004: "USN_REASON_DATA_TRUNCATION",
    0x00000010: "USN_REASON_NAMED_DATA_OVERWRITE",
    0x00000020: "USN_REASON_NAMED_DATA_EXTEND",
    0x00000040: "USN_REASON_NAMED_DATA_TRUNCATION",
    0x00000100: "USN_REASON_FILE_CREATE",
    0x00000200: "USN_REASON_FILE_DELETE",
    0x00000400: "USN_REASON_EA_CHANGE",
    0x00000800: "USN_REASON_SECURITY_CHANGE",
    0x00001000: "USN_REASON_RENAME_OLD_NAME",
    0x00002000: "USN_REASON_RENAME_NEW_NAME",
    0x00004000: "USN_REASON_INDEXABLE_CHANGE",
    0x00008000: "USN_REASON_BASIC_INFO_CHANGE",
    0x00010000: "USN_REASON_HARD_LINK_CHANGE",
    0x00020000: "USN_REASON_COMPRESSION_CHANGE",
    0x00040000: "USN_REASON_ENCRYPTION_CHANGE",
    0x00080000: "USN_REASON_OBJECT_ID_CHANGE",
    0x00100000: "USN_REASON_REPARSE_POINT_CHANGE",
    0x00200000: "USN_REASON_STREAM_CHANGE",
    0x00400000: "USN_REASON_TRANSACTED_CHANGE",
    0x00800000: "USN_REASON_INTEGRITY_CHANGE",
    0x80000000: "USN_REASON_CLOSE",
}
CLOSE = 0x80000000
KNOWN = sum(REASONS)


def core_reason(reason: Column) -> Column:
    """The reason without the close bit and without unknown bits."""
    return reason.bitwiseAND(F.lit(KNOWN & ~CLOSE))


def reason_flags(reason: Column) -> Column:
    """The names of the bits set, lowest bit first."""
    pairs = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(n).alias("n")) for b, n in REASONS.items()])
    return F.transform(F.filter(pairs, lambda p: reason.bitwiseAND(p.b) != 0), lambda p: p.n)


def unknown_bits(reason: Column) -> Column:
    return reason.bitwiseAND(F.lit(0xFFFFFFFF & ~KNOWN))


def ref_parts(ref: str) -> list[Column]:
    """A file reference as three BIGINTs, equal only if the references are equal as a whole."""
    v3 = F.col(f"{ref}.ref_version") == "v3"
    return [F.when(v3, 3).when(F.col(f"{ref}.ref_version").isNotNull(), 2).cast("bigint"), F.when(v3, F.col(f"{ref}.high")).otherwise(F.col(f"{ref}.entry")), F.when(v3, F.col(f"{ref}.low")).otherwise(F.col(f"{ref}.sequence").cast("bigint"))]


def ref_text(ref: str) -> Column:
    """``entry-sequence`` (v2) or ``high:low`` (v3); null if a part is missing."""
    v3 = F.col(f"{ref}.ref_version") == "v3"
    joined = lambda sep, a, b: F.concat(F.col(f"{ref}.{a}").cast("string"), F.lit(sep), F.col(f"{ref}.{b}").cast("string"))
    return F.when(v3, joined(":", "high", "low")).otherwise(joined("-", "entry", "sequence"))


def ticks(text: Column) -> Column:
    """RFC 3339 text as 100 ns since 1970, null where it is none."""
    digit = F.regexp_extract(text, r"\.\d{6}(\d)", 1)
    return F.unix_micros(text.try_cast("timestamp")) * 10 + F.coalesce(digit.try_cast("bigint"), F.lit(0))


def split_reference(raw: Column) -> tuple[Column, Column]:
    """Entry and sequence number of a 64-bit reference: its low 48 and high 16 bits."""
    return raw.bitwiseAND(F.lit((1 << 48) - 1)), F.shiftrightunsigned(raw, 48)
