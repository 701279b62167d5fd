"""Binary and document decoders. Each turns the bytes of one file into rows; ``decode`` runs one over a frame.

Every row says how far its input was understood (``status``: recognized, partial or failed). Damaged input gives what was
read before the damage and never an exception. Layouts are those of the public format descriptions.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from email import policy
from email.header import decode_header, make_header
from email.parser import BytesParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_MOST = (1 << 63) - 1  # unsigned numbers beyond BIGINT are clamped
FILETIME_1970 = 116_444_736_000_000_000


def filetime(n: int) -> int | None:
    """Microseconds since 1970, or None for stamps not above 0."""
    return (n - FILETIME_1970) // 10 if 0 < n < 1 << 63 else None


def _int(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n], "little") if 0 <= at and at + n <= len(b) else 0


def _utf16(b: bytes) -> str:
    return b.decode("utf-16-le", "replace")


def recycle_bin(data: bytes) -> Iterator[dict]:
    """A deletion record: version 1 holds a path of fixed room, version 2 one with its length."""
    version = _int(data, 0, 8)
    if len(data) < 24 or version not in (1, 2):
        yield {"status": "failed", "version": version if len(data) >= 8 else None}
        return
    raw = data[24:544] if version == 1 else data[28 : 28 + 2 * _int(data, 24, 4)]
    path = _utf16(raw).split("\0")[0]
    yield {"status": "recognized" if path else "partial", "version": version, "original_size": _int(data, 8, 8), "deleted_filetime": _int(data, 16, 8), "deleted_micros": filetime(_int(data, 16, 8)), "original_path": path}


RECYCLE_BIN = "status string, version bigint, original_size bigint, deleted_filetime bigint, deleted_micros bigint, original_path string"


def usn_journal(data: bytes) -> Iterator[dict]:
    """Change-journal records of version 2 and 3; zero stretches are skipped, a bad frame is passed by 8 bytes."""
    at = 0
    while at + 8 <= len(data):
        if data[at : at + 8] == bytes(8):
            at += 8
            continue
        length, major = _int(data, at, 4), _int(data, at + 4, 2)
        wide = 8 if major == 3 else 0
        least = 60 + 2 * wide
        if length < least or length % 8 or at + length > len(data) or major not in (2, 3):
            at += 8
            continue
        r = data[at : at + length]
        size, start = _int(r, 56 + 2 * wide, 2), _int(r, 58 + 2 * wide, 2)
        name = r[start : start + size]
        try:
            text = name.decode("utf-16-le") if len(name) == size else None
        except UnicodeDecodeError:
            text = None
        base = 24 + 2 * wide
        ref = (lambda o: f"{_int(r, o, 8) & (1 << 48) - 1}-{_int(r, o, 8) >> 48}") if major == 2 else (lambda o: f"{_int(r, o + 8, 8)}:{_int(r, o, 8)}")
        yield {"status": "recognized" if text is not None else "partial", "major_version": major, "byte_offset": at, "file_ref": ref(8), "parent_ref": ref(16 + wide), "usn": _int(r, base, 8), "time_micros": filetime(_int(r, base + 8, 8)), "reason": _int(r, base + 16, 4), "file_attributes": _int(r, base + 28, 4), "file_name": text}
        at += length


USN_JOURNAL = "status string, major_version int, byte_offset bigint, file_ref string, parent_ref string, usn bigint, time_micros bigint, reason bigint, file_attributes bigint, file_name string"


def shimcache(data: bytes, most: int | None = None) -> Iterator[dict]:
    """Compatibility cache: the table of 64-bit Windows 7, or the tagged entries of Windows 8 and later. With ``most``, a row
    of status ``truncated`` says where reading stopped."""

    def row(path: bytes, stamp: int, executed: bool | None, size: int | None, at: int) -> dict:
        return {"status": "recognized", "file_path": _utf16(path).rstrip("\0"), "modified_micros": filetime(stamp), "executed": executed, "file_size": size, "byte_offset": at}

    if _int(data, 0, 4) == 0xBADC0FEE:
        for i in range(_int(data, 4, 4)):
            at = 128 + 32 * i
            if i == most:
                yield {"status": "truncated", "byte_offset": at}
                return
            if at + 32 > len(data):
                yield {"status": "partial", "byte_offset": at}
                return
            n, where = _int(data, at, 2), _int(data, at + 4, 4)
            if where + n > len(data):
                yield {"status": "partial", "byte_offset": at}
                continue
            yield row(data[where : where + n], _int(data, at + 8, 8), bool(_int(data, at + 16, 4) & 2), _int(data, at + 20, 8), at)
        return
    at = found = 0
    while True:
        nearest = [p for p in (data.find(b"10ts", at), data.find(b"30ts", at), data.find(b"00ts", at)) if p >= 0]
        if not nearest:
            return
        at = min(nearest)
        size, n = _int(data, at + 8, 4), _int(data, at + 12, 2)
        if n == 0 or n % 2 or at + 14 + n + 8 > len(data):
            at += 4
            continue
        if found == most:
            yield {"status": "truncated", "byte_offset": at}
            return
        yield row(data[at + 14 : at + 14 + n], _int(data, at + 14 + n, 8), None, None, at)
        found += 1
        at += 12 + size if size >= 10 + n else 22 + n


SHIMCACHE = "status string, file_path string, modified_micros bigint, executed boolean, file_size bigint, byte_offset bigint"


def user_assist(data: bytes) -> Iterator[dict]:
    """Run count, focus and last run of a program: the layout of 72 bytes or the older one of 16."""
    if len(data) >= 72:
        yield {"status": "recognized", "run_count": _int(data, 4, 4), "focus_count": _int(data, 8, 4), "focus_millis": _int(data, 12, 4), "last_run_micros": filetime(_int(data, 60, 8))}
    elif len(data) >= 16:
        yield {"status": "recognized", "run_count": _int(data, 4, 4), "last_run_micros": filetime(_int(data, 8, 8))}
    else:
        yield {"status": "failed"}


USER_ASSIST = "status string, run_count bigint, focus_count bigint, focus_millis bigint, last_run_micros bigint"


def mru_order(data: bytes) -> list[int]:
    """Most-recent order: 32-bit numbers up to the end mark."""
    out = []
    for (n,) in struct.iter_unpack("<I", data[: len(data) // 4 * 4]):
        if n == 0xFFFFFFFF:
            break
        out.append(n)
    return out


def sid(data: bytes) -> str | None:
    """Bytes of a security identifier as ``S-1-…``."""
    if len(data) < 8 or data[0] != 1 or len(data) < 8 + 4 * data[1]:
        return None
    return "-".join(["S-1", str(int.from_bytes(data[2:8], "big")), *(str(_int(data, 8 + 4 * i, 4)) for i in range(data[1]))])


def mixed_guid(data: bytes) -> str | None:
    """16 bytes of mixed byte order as a canonical identifier."""
    if len(data) < 16:
        return None
    a, b, c = struct.unpack("<IHH", data[:8])
    return f"{a:08x}-{b:04x}-{c:04x}-{data[8:10].hex()}-{data[10:16].hex()}"


LINK_CLASS = bytes.fromhex("0114020000000000c000000000000046")


def shell_link(data: bytes) -> Iterator[dict]:
    """A link file: times, size, target by local base, network name, environment or relative path, and the tracker."""
    if len(data) < 76 or _int(data, 0, 4) != 76 or data[4:20] != LINK_CLASS:
        yield {"status": "failed"}
        return
    flags, at, status = _int(data, 20, 4), 76, "recognized"
    out = {"flags": flags, "created_micros": filetime(_int(data, 28, 8)), "accessed_micros": filetime(_int(data, 36, 8)), "modified_micros": filetime(_int(data, 44, 8)), "target_size": _int(data, 52, 4)}
    if flags & 1:
        at += 2 + _int(data, at, 2)
    local = network = None
    if flags & 2 and at + 4 <= len(data):
        info = data[at : at + _int(data, at, 4)]
        header, kinds = _int(info, 4, 4), _int(info, 8, 4)

        def ansi(where: int) -> str:
            return info[where:].split(b"\0")[0].decode("cp1252", "replace") if 0 < where < len(info) else ""

        suffix = ansi(_int(info, 24, 4))
        if kinds & 1:
            wide = _int(info, 28, 4) if header >= 36 else 0
            local = _utf16(info[wide:]).split("\0")[0] if wide else ansi(_int(info, 16, 4))
            local = local + suffix if local else None
        if kinds & 2:
            where = _int(info, 20, 4)
            name = ansi(where + _int(info, where + 8, 4)) if where else ""
            network = "\\".join(x for x in (name, suffix) if x) or None
        if len(info) < 28:
            status = "partial"
        at += max(4, _int(data, at, 4))
    for bit, key in ((4, "description"), (8, "relative_path"), (16, "working_dir"), (32, "arguments"), (64, "icon")):
        if flags & bit:
            n = _int(data, at, 2) * (2 if flags & 128 else 1)
            raw = data[at + 2 : at + 2 + n]
            if len(raw) < n:
                status = "partial"
            out[key] = _utf16(raw) if flags & 128 else raw.decode("cp1252", "replace")
            at += 2 + n
    environment = None
    while at + 8 <= len(data) and _int(data, at, 4) >= 8:
        size, kind = _int(data, at, 4), _int(data, at + 4, 4)
        block = data[at : at + size]
        if kind == 0xA0000001 and len(block) >= 788:
            environment = _utf16(block[268:788]).split("\0")[0] or block[8:268].split(b"\0")[0].decode("cp1252", "replace")
        elif kind == 0xA0000003 and len(block) >= 96:
            out |= {"machine_id": block[16:32].split(b"\0")[0].decode("ascii", "replace"), "droid_file": mixed_guid(block[48:64])}
        at += size
    yield out | {"status": status, "target": local or network or environment or out.get("relative_path")}


SHELL_LINK = "status string, flags bigint, created_micros bigint, accessed_micros bigint, modified_micros bigint, target_size bigint, description string, relative_path string, working_dir string, arguments string, icon string, machine_id string, droid_file string, target string"


def custom_destinations(data: bytes) -> Iterator[dict]:
    """Links of a custom jump list, found by their class identifier."""
    starts, at = [], data.find(LINK_CLASS)
    while at >= 0:
        if at >= 4 and _int(data, at - 4, 4) == 76:
            starts.append(at - 4)
        at = data.find(LINK_CLASS, at + 16)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)])):
        yield {**next(shell_link(data[a:b])), "ordinal": i, "byte_offset": a}


CUSTOM_DESTINATIONS = SHELL_LINK + ", ordinal int, byte_offset bigint"


def compound_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by name. Broken or circular sector chains end where they break."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        return {}
    size, mini, cutoff = 1 << _int(data, 30, 2), 1 << _int(data, 32, 2), _int(data, 56, 4)
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    tables, nxt, seen = [_int(data, 76 + 4 * i, 4) for i in range(109)], _int(data, 68, 4), set()
    while nxt < 0xFFFFFFFA and nxt not in seen:
        seen.add(nxt)
        block = sector(nxt)
        tables += [_int(block, 4 * i, 4) for i in range(size // 4 - 1)]
        nxt = _int(block, size - 4, 4) if len(block) == size else 0xFFFFFFFE
    fat = [n for t in tables if t < 0xFFFFFFFA for (n,) in struct.iter_unpack("<I", sector(t)[: len(sector(t)) // 4 * 4])]

    def chain(first: int, table: list[int], read: Callable[[int], bytes]) -> bytes:
        parts, been = [], set()
        while first < len(table) and first not in been:
            been.add(first)
            parts.append(read(first))
            first = table[first]
        return b"".join(parts)

    directory = chain(_int(data, 48, 4), fat, sector)
    small_table = chain(_int(data, 60, 4), fat, sector)
    minifat = [n for (n,) in struct.iter_unpack("<I", small_table[: len(small_table) // 4 * 4])]
    ministream, out = b"", {}
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        name, kind, first, n = _utf16(e[: max(0, _int(e, 64, 2) - 2)]), e[66], _int(e, 116, 4), _int(e, 120, 8)
        if kind == 5:
            ministream = chain(first, fat, sector)
        elif kind == 2:
            small = n < cutoff
            out[name] = (chain(first, minifat, lambda k: ministream[k * mini : (k + 1) * mini]) if small else chain(first, fat, sector))[:n]
    return out


def automatic_destinations(data: bytes) -> Iterator[dict]:
    """Entries of an automatic jump list with the links embedded beside it."""
    streams = compound_streams(data)
    listed = streams.get("DestList", b"")
    if not streams:
        yield {"status": "failed"}
        return
    version, at, seen = _int(listed, 0, 4), 32, set()
    while at + 114 <= len(listed):
        new = version >= 3
        n_at = at + (128 if new else 112)
        n = _int(listed, n_at, 2)
        path = listed[n_at + 2 : n_at + 2 + 2 * n]
        key = f"{_int(listed, at + 88, 4):x}"
        seen.add(key)
        link = next(shell_link(streams[key])) if key in streams else {"status": "partial"}
        yield {**link, "entry_id_hex": key, "host_name": listed[at + 72 : at + 88].split(b"\0")[0].decode("ascii", "replace"), "last_used_micros": filetime(_int(listed, at + 100, 8)), "pinned": struct.unpack_from("<i", listed, at + 108)[0] >= 0, "dest_path": _utf16(path)}
        at = n_at + 2 + 2 * n + (4 if new else 0)
    for key in sorted(set(streams) - seen - {"DestList"}):
        yield {**next(shell_link(streams[key])), "entry_id_hex": key}


AUTOMATIC_DESTINATIONS = SHELL_LINK + ", entry_id_hex string, host_name string, last_used_micros bigint, pinned boolean, dest_path string"


def lznt1(data: bytes, size: int | None = None) -> bytes:
    """LZNT1 decompression; stops at the end mark, at damage, or at ``size`` bytes."""
    out, at = bytearray(), 0
    while at + 2 <= len(data) and (size is None or len(out) < size):
        header = _int(data, at, 2)
        at += 2
        if header == 0:
            break
        end, base = min(at + (header & 0xFFF) + 1, len(data)), len(out)
        if not header & 0x8000:
            out += data[at:end]
            at = end
            continue
        while at < end:
            flags = data[at]
            at += 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token, pos = _int(data, at, 2), len(out) - base
                at += 2
                shift = 12
                while pos > 1 << (16 - shift) and shift > 4:
                    shift -= 1
                back, n = (token >> shift) + 1, (token & (1 << shift) - 1) + 3
                if back > len(out) - base:
                    return bytes(out)
                for _ in range(n):
                    out.append(out[-back])
        at = end
    return bytes(out if size is None else out[:size])


def xpress_huffman(data: bytes, size: int) -> bytes:
    """LZ77 with Huffman codes in blocks of 64 KiB of output; damage ends the output early."""
    out, at = bytearray(), 0
    while len(out) < size and at + 256 <= len(data):
        lengths = [x for b in data[at : at + 256] for x in (b & 15, b >> 4)]
        at += 256
        codes, code = {}, 0
        for n in range(1, 16):
            for s in range(512):
                if lengths[s] == n:
                    codes[n, code] = s
                    code += 1
            code <<= 1
        bits, have, block = 0, 0, len(out)

        def fill() -> None:
            nonlocal bits, have, at
            bits, have, at = bits << 16 | _int(data, at, 2), have + 16, at + 2

        fill()
        fill()
        while len(out) < size and len(out) - block < 65536:
            code = n = 0
            symbol = None
            while n < 15 and symbol is None:
                if have == 0:
                    fill()
                code, n, have = code << 1 | bits >> (have - 1) & 1, n + 1, have - 1
                bits &= (1 << have) - 1
                symbol = codes.get((n, code))
            if symbol is None:
                return bytes(out)
            while have < 16:
                fill()
            if symbol < 256:
                out.append(symbol)
                continue
            length, log = symbol & 15, symbol - 256 >> 4
            if length == 15:
                length = _int(data, at, 1)
                at += 1
                if length == 255:
                    length = _int(data, at, 2) - 15
                    at += 2
                length += 15
            length += 3
            back = 1 << log
            if log:
                have -= log
                back += bits >> have
                bits &= (1 << have) - 1
            while have < 16:
                fill()
            if back > len(out):
                return bytes(out)
            for _ in range(length):
                out.append(out[-back])
    return bytes(out[:size])


#: Per version of a prefetch file, the offsets of the run count and the run times, and how many there are.
_PREFETCH = {17: (144, 120, 1), 23: (152, 128, 1), 26: (208, 128, 8), 30: (208, 128, 8), 31: (200, 128, 8)}


def prefetch(data: bytes) -> Iterator[dict]:
    """A program's start record: name, hash, run count and times, the files it used and its volumes."""
    if data[:3] == b"MAM":
        data = xpress_huffman(data[8 + 4 * (data[3] >> 7 & 1) :], _int(data, 4, 4))
    version = _int(data, 0, 4)
    if len(data) < 84 or data[4:8] != b"SCCA" or version not in _PREFETCH:
        yield {"status": "failed"}
        return
    runs_at, times_at, many = _PREFETCH[version]
    if version == 30 and _int(data, 84, 4) == 296:
        runs_at = 200
    names = data[_int(data, 100, 4) : _int(data, 100, 4) + _int(data, 104, 4)]
    files = [x for x in _utf16(names).split("\0") if x]
    times = [t for i in range(many) if (t := filetime(_int(data, times_at + 8 * i, 8))) is not None]
    whole = len(data) >= runs_at + 4 and len(names) == _int(data, 104, 4)
    yield {"status": "recognized" if whole else "partial", "version": version, "executable": _utf16(data[16:76]).split("\0")[0], "path_hash": f"0x{_int(data, 76, 4):08X}", "run_count": _int(data, runs_at, 4), "run_micros": times, "referenced_files": files, "volume_count": _int(data, 112, 4)}


PREFETCH = "status string, version int, executable string, path_hash string, run_count bigint, run_micros array<bigint>, referenced_files array<string>, volume_count bigint"


def _xml(data: bytes) -> ElementTree.Element | None:
    """The root of a document without a type declaration, namespaces dropped; None if it is none."""
    mark = data[:2]
    text = data.decode("utf-16" if mark in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    if "<!DOCTYPE" in text[:4096].upper() or "<!ENTITY" in text.upper():
        return None
    try:
        root = ElementTree.fromstring(text.split("?>", 1)[1] if text.lstrip().startswith("<?xml") else text)
    except (ElementTree.ParseError, IndexError):
        return None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return root


def scheduled_task(data: bytes) -> Iterator[dict]:
    """A task definition: who it runs as, what starts it, what it does."""
    root = _xml(data)
    if root is None or root.tag != "Task":
        yield {"status": "failed"}
        return
    one = lambda e, k: (e.findtext(k) or "").strip() or None
    actions = [" ".join(x for x in (one(e, "Command"), one(e, "Arguments")) if x) or e.tag for g in root.findall("Actions") for e in g]
    yield {"status": "recognized" if actions else "partial", "author": one(root, "RegistrationInfo/Author"), "uri": one(root, "RegistrationInfo/URI"), "principals": [one(e, "UserId") or one(e, "GroupId") or "" for e in root.findall("Principals/Principal")], "triggers": [e.tag for g in root.findall("Triggers") for e in g], "actions": actions, "hidden": (one(root, "Settings/Hidden") or "").lower() == "true"}


SCHEDULED_TASK = "status string, author string, uri string, principals array<string>, triggers array<string>, actions array<string>, hidden boolean"


def wifi_profile(data: bytes) -> Iterator[dict]:
    root = _xml(data)
    if root is None or root.tag != "WLANProfile":
        yield {"status": "failed"}
        return
    one = lambda k: (root.findtext(k) or "").strip() or None
    yield {"status": "recognized", "profile_name": one("name"), "ssid": one("SSIDConfig/SSID/name"), "authentication": one("MSM/security/authEncryption/authentication"), "encryption": one("MSM/security/authEncryption/encryption"), "key_type": one("MSM/security/sharedKey/keyType"), "protected": (one("MSM/security/sharedKey/protected") or "").lower() == "true"}


WIFI_PROFILE = "status string, profile_name string, ssid string, authentication string, encryption string, key_type string, protected boolean"


#: Characters of a mail's preview, whose bound is its feature; ``body_truncated`` says that there is more.
PREVIEW = 1_200


def mail_message(data: bytes) -> Iterator[dict]:
    """A mail: headers unfolded and decoded, non-blank lines of the body as a preview of ``PREVIEW`` characters."""
    message = BytesParser(policy=policy.compat32).parsebytes(data)

    def header(name: str) -> str | None:
        raw = message.get(name)
        if raw is None:
            return None
        try:
            return " ".join(str(make_header(decode_header(str(raw)))).split())
        except (ValueError, LookupError, UnicodeError):
            return " ".join(str(raw).split())

    body = next((p for p in message.walk() if not p.is_multipart() and p.get_content_type() == "text/plain"), None) if message.is_multipart() else message
    content = (body.get_payload(decode=True) or b"") if body is not None else b""
    try:
        text = content.decode(body.get_content_charset() or "utf-8", "replace") if body is not None else ""
    except LookupError:
        text = content.decode("utf-8", "replace")
    lines = "\n".join(x.rstrip() for x in text.splitlines() if x.strip())
    found = [header(k) for k in ("From", "To", "Cc", "Bcc", "Subject", "Date", "Message-ID", "Reply-To", "In-Reply-To")]
    yield dict(zip(("from_header", "to_header", "cc_header", "bcc_header", "subject", "date_header", "message_id", "reply_to", "in_reply_to"), found)) | {"status": "recognized" if any(found) and not message.defects else "partial" if any(found) else "failed", "body_preview": lines[:PREVIEW], "body_truncated": len(lines) > PREVIEW}


MAIL_MESSAGE = "status string, from_header string, to_header string, cc_header string, bcc_header string, subject string, date_header string, message_id string, reply_to string, in_reply_to string, body_preview string, body_truncated boolean"

TEXT_EXTENSIONS = frozenset("txt csv tsv log json xml html htm md ini cfg yaml yml".split())


def zip_members(data: bytes, segment: int = 64 * 1024) -> Iterator[dict]:
    """Members of an archive, and the text of those with a text extension in segments. A damaged member is partial."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError):
        yield {"status": "failed"}
        return
    for k, info in enumerate(archive.infolist()):
        row = {"status": "recognized", "member_index": k, "member": info.filename, "member_size": info.file_size, "encrypted": bool(info.flag_bits & 1)}
        if info.is_dir() or info.filename.rpartition(".")[2].lower() not in TEXT_EXTENSIONS or info.flag_bits & 1:
            yield row
            continue
        try:
            with archive.open(info) as f:
                index = 0
                while part := f.read(segment):
                    yield row | {"segment_index": index, "byte_offset": index * segment, "text": part.decode("utf-8", "replace")}
                    index += 1
                if not index:
                    yield row
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError):
            yield row | {"status": "partial"}


ZIP_MEMBERS = "status string, member_index int, member string, member_size bigint, encrypted boolean, segment_index int, byte_offset bigint, text string"


def word_document(data: bytes) -> Iterator[dict]:
    """Text of a word-processing package by part: the document, headers, footers, notes, comments and properties."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        names = archive.namelist()
    except (zipfile.BadZipFile, ValueError, OSError):
        yield {"status": "failed"}
        return
    if "[Content_Types].xml" not in names:
        yield {"status": "failed"}
        return

    def rank(name: str) -> tuple:
        stem = name.rpartition("/")[2].removesuffix(".xml").rstrip("0123456789")
        order = ["document", "header", "footer", "footnotes", "endnotes", "comments", "core", "app", "custom", "item"]
        return (order.index(stem) if stem in order else len(order), name)

    index = 0
    for name in sorted(names, key=rank):
        kind = rank(name)[0]
        if not name.endswith(".xml") or kind > 9 or "_rels" in name:
            continue
        try:
            root = _xml(archive.read(name))
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, OSError):
            root = None
        if root is None:
            yield {"status": "partial", "part_name": name}
            continue
        paragraphs = ["".join(t.text or "" if t.tag == "t" else "\t" if t.tag == "tab" else "\n" if t.tag == "br" else "" for t in p.iter()) for p in root.iter("p")] if kind <= 5 else [f"{e.tag}: {e.text.strip()}" for e in root.iter() if e.text and e.text.strip()]
        body = "\n".join(x for x in paragraphs if x)
        if body:
            yield {"status": "recognized", "part_name": name, "segment_index": index, "text": body}
            index += 1


WORD_DOCUMENT = "status string, part_name string, segment_index int, text string"


def image_chunks(data: bytes) -> Iterator[dict]:
    """Chunks of an evidence image segment in order: its sections are walked, each chunk of a table is inflated."""
    if data[:8] not in (b"EVF\x09\x0d\x0a\xff\x00",):
        yield {"status": "failed"}
        return
    at, size, ends, index = 13, 32768, 0, 0
    seen: set[int] = set()
    while at + 76 <= len(data) and at not in seen:
        seen.add(at)
        kind, nxt, length = data[at : at + 16].split(b"\0")[0].decode("ascii", "replace"), _int(data, at + 16, 8), _int(data, at + 24, 8)
        body = at + 76
        if kind in ("volume", "disk"):
            size = (_int(data, body + 8, 4) or 64) * (_int(data, body + 12, 4) or 512)
        elif kind == "sectors":
            ends = at + length
        elif kind == "table":
            n, base = _int(data, body, 4), _int(data, body + 8, 8)
            offsets = [_int(data, body + 24 + 4 * i, 4) for i in range(n)]
            for i, raw in enumerate(offsets):
                a = base + (raw & 0x7FFFFFFF)
                b = base + (offsets[i + 1] & 0x7FFFFFFF) if i + 1 < n else ends
                part, status = data[a:b], "recognized"
                if raw >> 31:
                    try:
                        part = zlib.decompress(part)
                    except zlib.error:
                        part, status = b"", "partial"
                else:
                    part = part[:size] if len(part) > size else part[:-4]
                yield {"status": status, "chunk_index": index, "media_offset": index * size, "bytes": part}
                index += 1
        if kind in ("done", "next") or nxt <= at:
            break
        at = nxt


IMAGE_CHUNKS = "status string, chunk_index int, media_offset bigint, bytes binary"


def bitlocker_volume(data: bytes) -> Iterator[dict]:
    """What a protected volume tells of itself without a key: its identifier and where its metadata lies."""
    if data[3:11] != b"-FVE-FS-" or len(data) < 200:
        yield {"status": "failed"}
        return
    yield {"status": "recognized", "bytes_per_sector": _int(data, 11, 2), "volume_guid": mixed_guid(data[160:176]), "metadata_offsets": [_int(data, 176 + 8 * i, 8) for i in range(3)]}


BITLOCKER_VOLUME = "status string, bytes_per_sector int, volume_guid string, metadata_offsets array<bigint>"


def crc32c(data: bytes, seed: int = 0xFFFFFFFF) -> int:
    """Castagnoli checksum without final inversion, as file systems keep it."""
    for b in data:
        seed ^= b
        for _ in range(8):
            seed = seed >> 1 ^ (0x82F63B78 if seed & 1 else 0)
    return seed


def lznt1_stream(data: bytes) -> Iterator[dict]:
    """A compressed stream as one row."""
    yield {"status": "recognized", "bytes": lznt1(data)}


def protected_sector(offset: Column) -> tuple[Column, Column]:
    """Where the sector of a byte offset begins in a protected volume, and the number that tweaks its key."""
    size = F.lit(512).cast("bigint")
    return offset - F.pmod(offset, size), F.call_function("div", offset, size)


#: name: (decoder, schema)
DECODERS: dict[str, tuple[Callable[[bytes], Iterator[dict]], str]] = {
    "recycle_bin": (recycle_bin, RECYCLE_BIN),
    "usn_journal": (usn_journal, USN_JOURNAL),
    "shimcache": (shimcache, SHIMCACHE),
    "user_assist": (user_assist, USER_ASSIST),
    "shell_link": (shell_link, SHELL_LINK),
    "custom_destinations": (custom_destinations, CUSTOM_DESTINATIONS),
    "automatic_destinations": (automatic_destinations, AUTOMATIC_DESTINATIONS),
    "prefetch": (prefetch, PREFETCH),
    "scheduled_task": (scheduled_task, SCHEDULED_TASK),
    "wifi_profile": (wifi_profile, WIFI_PROFILE),
    "mail_message": (mail_message, MAIL_MESSAGE),
    "zip_members": (zip_members, ZIP_MEMBERS),
    "word_document": (word_document, WORD_DOCUMENT),
    "image_chunks": (image_chunks, IMAGE_CHUNKS),
    "bitlocker_volume": (bitlocker_volume, BITLOCKER_VOLUME),
    "lznt1_stream": (lznt1_stream, "status string, bytes binary"),
}


def decode(df: DataFrame, name: str, id_col: str, bytes_col: str, rows_per_batch: int = 1_000) -> DataFrame:
    """Rows of one decoder over a frame: ``source_id`` and the decoder's columns.

    Null and empty input gives no rows. Rows are emitted in batches as they are read, so one large file does not fill memory
    with its rows.
    """
    decoder, schema = DECODERS[name]
    full = StructType.fromDDL("source_id bigint, " + schema)
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for sid_, data in zip(*[c.to_pylist() for c in batch.columns]):
                for row in decoder(data) if data else ():
                    held.append({"source_id": sid_, **{k: min(v, _MOST) if type(v) is int else v for k, v in row.items()}})
                    if len(held) >= rows_per_batch:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return df.select(F.col(id_col).cast("bigint").alias("source_id"), F.col(bytes_col).cast("binary").alias("bytes")).mapInArrow(run, full)
