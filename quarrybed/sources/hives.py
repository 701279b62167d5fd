"""Registry hives: keys and values as observation rows."""

from __future__ import annotations

from collections.abc import Iterator

from quarrybed.sources.decoders import DECODERS, _int, filetime

OBSERVATIONS = "status string, key_path string, value_name string, value_type int, value_data string, raw binary, last_write_micros bigint"
_BASE = 4096
_SEGMENT = 16_344


def _cell(data: bytes, offset: int) -> bytes:
    """The content of a cell; nothing for offsets outside and cells that are free."""
    at = _BASE + offset
    if offset < 0 or offset >= 0xFFFFFFFF or at + 4 > len(data):
        return b""
    size = int.from_bytes(data[at : at + 4], "little", signed=True)
    return data[at + 4 : at - size] if size < 0 else b""


def _subkeys(data: bytes, offset: int, depth: int = 0) -> Iterator[int]:
    c = _cell(data, offset)
    n = _int(c, 2, 2)
    if c[:2] in (b"lf", b"lh"):
        yield from (_int(c, 4 + 8 * i, 4) for i in range(n))
    elif c[:2] == b"li":
        yield from (_int(c, 4 + 4 * i, 4) for i in range(n))
    elif c[:2] == b"ri" and depth < 4:
        for i in range(n):
            yield from _subkeys(data, _int(c, 4 + 4 * i, 4), depth + 1)


def _value(data: bytes, vk: bytes) -> bytes:
    size, where = _int(vk, 4, 4), _int(vk, 8, 4)
    if size & 0x80000000:
        return vk[8 : 8 + min(size & 0x7FFFFFFF, 4)]
    c = _cell(data, where)
    if c[:2] == b"db" and size > _SEGMENT:
        parts = _cell(data, _int(c, 4, 4))
        return b"".join(_cell(data, _int(parts, 4 * i, 4))[:_SEGMENT] for i in range(_int(c, 2, 2)))[:size]
    return c[:size]


def rendered(kind: int, raw: bytes) -> str:
    """Text of a value: strings as they are, lists joined by ``; ``, numbers in decimal, the rest in hex."""
    if kind in (1, 2):
        return raw.decode("utf-16-le", "replace").split("\0")[0]
    if kind == 7:
        return "; ".join(x for x in raw.decode("utf-16-le", "replace").split("\0") if x)
    if kind in (4, 11) and raw:
        return str(int.from_bytes(raw, "little"))
    if kind == 5 and raw:
        return str(int.from_bytes(raw, "big"))
    return raw.hex()


def registry_hive(data: bytes) -> Iterator[dict]:
    """Every value of every key, keys before the keys below them. Keys seen before are not entered again."""
    if data[:4] != b"regf":
        yield {"status": "failed"}
        return
    stack, seen = [(_int(data, 36, 4), "")], set()
    while stack:
        offset, above = stack.pop()
        nk = _cell(data, offset)
        if offset in seen or nk[:2] != b"nk":
            continue
        seen.add(offset)
        raw_name = nk[76 : 76 + _int(nk, 72, 2)]
        name = raw_name.decode("latin-1") if _int(nk, 2, 2) & 0x20 else raw_name.decode("utf-16-le", "replace")
        path = f"{above}\\{name}" if above else name
        written = filetime(_int(nk, 4, 8))
        values = _cell(data, _int(nk, 40, 4)) if _int(nk, 36, 4) else b""
        for i in range(min(_int(nk, 36, 4), len(values) // 4)):
            vk = _cell(data, _int(values, 4 * i, 4))
            if vk[:2] != b"vk":
                yield {"status": "partial", "key_path": path, "last_write_micros": written}
                continue
            raw_label = vk[20 : 20 + _int(vk, 2, 2)]
            label = raw_label.decode("latin-1") if _int(vk, 16, 2) & 1 else raw_label.decode("utf-16-le", "replace")
            kind, raw = _int(vk, 12, 4), _value(data, vk)
            yield {"status": "recognized", "key_path": path, "value_name": label, "value_type": kind & 0x7FFFFFFF, "value_data": rendered(kind, raw), "raw": raw, "last_write_micros": written}
        below = list(_subkeys(data, _int(nk, 28, 4))) if _int(nk, 20, 4) else []
        stack.extend((o, path) for o in reversed(below))


DECODERS["registry_hive"] = (registry_hive, OBSERVATIONS)
