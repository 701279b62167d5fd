"""Event logs: chunks of records whose binary XML is read through templates to flat rows.

Layouts are those of the public format description. A chunk is read on its own: names and templates are found by their
places in it. Damage ends a record and leaves it partial; the next one is found by its mark.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

from quarrybed.sources.decoders import DECODERS, filetime, mixed_guid, sid

CHUNK, FIRST_CHUNK, FIRST_RECORD = 0x10000, 0x1000, 512
#: Formats of the numbers by type of value.
_NUMBERS = {3: "<b", 4: "<B", 5: "<h", 6: "<H", 7: "<i", 8: "<I", 9: "<q", 10: "<Q", 11: "<f", 12: "<d"}
#: Templates may hold templates; nothing sensible nests deeper.
DEPTH = 16


class Damaged(Exception):
    """The bytes are no binary XML."""


def rendered(kind: int, raw: bytes) -> str:
    """The text of a value."""
    if kind & 0x80:
        if kind == 0x81:
            return ", ".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x)
        width = struct.calcsize(_NUMBERS[kind & 0x7F]) if kind & 0x7F in _NUMBERS else len(raw) or 1
        return ", ".join(rendered(kind & 0x7F, raw[i : i + width]) for i in range(0, len(raw), width))
    if kind == 1:
        return raw.decode("utf-16-le", "replace").rstrip("\0")
    if kind == 2:
        return raw.decode("cp1252", "replace").rstrip("\0")
    if kind in _NUMBERS and len(raw) >= struct.calcsize(_NUMBERS[kind]):
        return str(struct.unpack_from(_NUMBERS[kind], raw)[0])
    if kind == 13:
        return "true" if any(raw) else "false"
    if kind == 15:
        return mixed_guid(raw) or ""
    if kind == 17 and len(raw) >= 8:
        return str(filetime(int.from_bytes(raw[:8], "little")))
    if kind == 18 and len(raw) >= 16:
        y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", raw[:16])
        return f"{y:04}-{mo:02}-{d:02}T{h:02}:{mi:02}:{s:02}.{ms:03}Z"
    if kind == 19:
        return sid(raw) or ""
    if kind in (16, 20, 21):
        return f"0x{int.from_bytes(raw, 'little'):x}"
    return raw.hex() if kind else ""


class _Reader:
    """Tokens of one stretch of a chunk into elements."""

    def __init__(self, chunk: bytes, values: list[tuple[int, bytes, int]], depth: int = 0):
        self.chunk, self.values, self.depth = chunk, values, depth
        if depth > DEPTH:
            raise Damaged

    def number(self, at: int, n: int) -> int:
        if not 0 <= at <= len(self.chunk) - n:
            raise Damaged
        return int.from_bytes(self.chunk[at : at + n], "little")

    def name(self, at: int) -> tuple[str, int]:
        """The name that the offset at ``at`` points to, and where reading goes on: a name not seen before stands there."""
        where = self.number(at, 4)
        n = self.number(where + 6, 2)
        text = self.chunk[where + 8 : where + 8 + 2 * n].decode("utf-16-le", "replace")
        return text, at + 4 + (10 + 2 * n if where == at + 4 else 0)

    def template(self, at: int) -> tuple[list, int]:
        """A template instance: its definition, read with the values that follow."""
        where, after = self.number(at + 6, 4), at + 10
        size = self.number(where + 20, 4)
        if where == after:
            after += 24 + size
        count = self.number(after, 4)
        if after + 4 + 4 * count > len(self.chunk):
            raise Damaged
        values, data = [], after + 4 + 4 * count
        for i in range(count):
            n, kind = self.number(after + 4 + 4 * i, 2), self.number(after + 6 + 4 * i, 1)
            values.append((kind, self.chunk[data : data + n], data))
            data += n
        found, _ = _Reader(self.chunk, values, self.depth + 1).nodes(where + 24, where + 24 + size)
        return found, data

    def nodes(self, at: int, end: int) -> tuple[list, int]:
        """Elements and texts up to ``end`` or the end of the fragment. Open elements are kept on a list."""
        top: list = []
        open_: list[ElementTree.Element] = []
        attribute: str | None = None

        def text(value: str) -> None:
            if attribute is not None and open_:
                open_[-1].set(attribute, open_[-1].get(attribute, "") + value)
            elif open_:
                e = open_[-1]
                if len(e):
                    e[-1].tail = (e[-1].tail or "") + value
                else:
                    e.text = (e.text or "") + value
            else:
                top.append(value)

        while at < end:
            token = self.number(at, 1)
            kind = token & 0x0F
            if kind == 0:
                return top, at + 1
            if kind == 1:
                name, after = self.name(at + 7)
                e = ElementTree.Element(name)
                (open_[-1].append if open_ else top.append)(e)
                open_.append(e)
                at, attribute = after + (4 if token & 0x40 else 0), None
            elif kind == 2:
                at, attribute = at + 1, None
            elif kind in (3, 4):
                if not open_:
                    raise Damaged
                open_.pop()
                at, attribute = at + 1, None
            elif kind == 5:
                n = 2 * self.number(at + 2, 2)
                text(self.chunk[at + 4 : at + 4 + n].decode("utf-16-le", "replace"))
                at += 4 + n
            elif kind == 6:
                attribute, at = self.name(at + 1)
            elif kind in (7, 11):
                n = 2 * self.number(at + 1, 2)
                if kind == 7:
                    text(self.chunk[at + 3 : at + 3 + n].decode("utf-16-le", "replace"))
                at += 3 + n
            elif kind == 8:
                text(chr(self.number(at + 1, 2)))
                at += 3
            elif kind == 9:
                name, at = self.name(at + 1)
                text({"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(name, ""))
            elif kind == 10:
                _, at = self.name(at + 1)
            elif kind == 12:
                found, at = self.template(at)
                for x in found:
                    if isinstance(x, str):
                        text(x)
                    else:
                        (open_[-1].append if open_ else top.append)(x)
            elif kind in (13, 14):
                index = self.number(at + 1, 2)
                if index < len(self.values):
                    what, raw, where = self.values[index]
                    if what == 0x21:
                        inner, _ = _Reader(self.chunk, [], self.depth + 1).nodes(where, where + len(raw))
                        for x in inner:
                            (text if isinstance(x, str) else open_[-1].append if open_ else top.append)(x)
                    else:
                        text(rendered(what, raw))
                at += 4
            elif kind == 15:
                at += 4
            else:
                raise Damaged
        return top, at


def _fields(event: ElementTree.Element) -> dict:
    """The row of an event: what its system part says, and its data by name."""
    one = lambda path: (event.findtext(path) or "").strip() or None
    number = lambda v: int(v) if v and v.isdigit() else None
    provider, created, security = (event.find(f"System/{k}") for k in ("Provider", "TimeCreated", "Security"))
    data: dict[str, str] = {}
    for part in event:
        if part.tag not in ("EventData", "UserData"):
            continue
        for i, e in enumerate(x for x in part.iter() if x is not part and not len(x)):
            key = e.get("Name") or (e.tag if e.tag != "Data" else f"data{i}")
            data[key] = (e.text or "").strip()
    stamp = created.get("SystemTime") if created is not None else None
    return {"event_id": number(one("System/EventID")), "provider": provider.get("Name") if provider is not None else None, "channel": one("System/Channel"), "computer": one("System/Computer"), "level": number(one("System/Level")), "created_micros": int(stamp) if stamp and stamp.lstrip("-").isdigit() else None, "user_sid": (security.get("UserID") or None) if security is not None else None, "data_json": json.dumps(data, ensure_ascii=False, sort_keys=True)}


def chunk_records(chunk: bytes, base: int = 0) -> Iterator[dict]:
    """The records of one chunk of 64 KiB."""
    end = min(len(chunk), max(FIRST_RECORD, int.from_bytes(chunk[48:52], "little")))
    at = FIRST_RECORD
    while at + 28 <= end:
        if chunk[at : at + 4] != b"\x2a\x2a\0\0":
            at = chunk.find(b"\x2a\x2a\0\0", at + 1, end)
            if at < 0:
                return
            continue
        size = int.from_bytes(chunk[at + 4 : at + 8], "little")
        row = {"record_id": int.from_bytes(chunk[at + 8 : at + 16], "little"), "written_micros": filetime(int.from_bytes(chunk[at + 16 : at + 24], "little")), "byte_offset": base + at}
        if size < 28 or at + size > len(chunk):
            yield row | {"status": "partial"}
            at += 4
            continue
        try:
            found, _ = _Reader(chunk, []).nodes(at + 24, at + size - 4)
            event = next((x for x in found if not isinstance(x, str)), None)
            yield row | ({"status": "recognized"} | _fields(event) if event is not None else {"status": "partial"})
        except Damaged:
            yield row | {"status": "partial"}
        at += size


def event_log(data: bytes) -> Iterator[dict]:
    """Records of a whole log, or of a single chunk."""
    if data[:8] == b"ElfChnk\0":
        yield from chunk_records(data[:CHUNK])
        return
    if data[:8] != b"ElfFile\0":
        yield {"status": "failed"}
        return
    for base in range(FIRST_CHUNK, len(data), CHUNK):
        if data[base : base + 8] == b"ElfChnk\0":
            yield from chunk_records(data[base : base + CHUNK], base)


EVENT_LOG = "status string, record_id bigint, written_micros bigint, byte_offset bigint, event_id bigint, provider string, channel string, computer string, level bigint, created_micros bigint, user_sid string, data_json string"
DECODERS["event_log"] = (event_log, EVENT_LOG)
