import struct

from quarrybed.plans.decoding import _DEFINITION, BinaryXml, event_definition
from quarrybed.sources.eventlogs import CHUNK, event_log, rendered

STAMP = 132_183_056_624_002_176


def record(number: int, at: int, values: list[tuple[int, bytes]], inline: bool) -> bytes:
    heads = struct.pack("<I", len(values)) + b"".join(struct.pack("<HH", len(v), k) for k, v in values)
    body = b"\x0f\x01\x01\x00\x0c\x01" + bytes(4) + struct.pack("<I", _DEFINITION) + (event_definition() if inline else b"") + heads + b"".join(v for _, v in values) + b"\0"
    size = len(body) + 28
    return b"\x2a\x2a\0\0" + struct.pack("<IQQ", size, number, STAMP) + body + struct.pack("<I", size)


def log(*records: bytes) -> bytes:
    body = b"".join(records)
    return b"ElfFile\0" + bytes(4088) + (b"ElfChnk\0" + bytes(40) + struct.pack("<I", 512 + len(body)) + bytes(460) + body).ljust(CHUNK, b"\0")


def values(n: int, name: str) -> list[tuple[int, bytes]]:
    return [(6, struct.pack("<H", n)), (17, struct.pack("<Q", STAMP)), (1, name.encode("utf-16-le")), (19, b"\x01\x01\0\0\0\0\0\x05" + struct.pack("<I", 18)), (1, "ü & <x>".encode("utf-16-le"))]


def test_records_share_a_template():
    rows = list(event_log(log(record(1, 0, values(4624, "pc"), True), record(2, 0, values(7, ""), False))))
    assert [(r["status"], r["record_id"], r["event_id"], r["computer"], r["user_sid"], r["data_json"]) for r in rows] == [("recognized", 1, 4624, "pc", "S-1-5-18", '{"kind": "ü & <x>"}'), ("recognized", 2, 7, None, "S-1-5-18", '{"kind": "ü & <x>"}')]
    assert rows[0]["created_micros"] == rows[0]["written_micros"] == (STAMP - 116_444_736_000_000_000) // 10


def test_damage_is_told_and_passed():
    good = record(3, 0, values(1, "a"), True)
    broken = bytearray(record(4, 0, values(2, "b"), False))
    broken[24 + 4 + 6 : 24 + 4 + 10] = b"\xff\xff\xff\x7f"  # the template's place lies outside
    rows = list(event_log(log(good, bytes(broken), b"\0" * 9, record(5, 0, values(3, "c"), False))))
    assert [(r["status"], r["record_id"]) for r in rows] == [("recognized", 3), ("partial", 4), ("recognized", 5)]
    assert list(event_log(b"no log")) == [{"status": "failed"}] and list(event_log(b"ElfFile\0")) == []
    cut = log(good)[: 4096 + 512 + 60]
    assert [r["status"] for r in event_log(cut)] == ["partial"]
    for k in range(24, len(good), 7):  # any byte may be wrong
        bad = bytearray(good)
        bad[k] ^= 0xFF
        assert all(r["status"] in ("recognized", "partial") for r in event_log(log(bytes(bad))))


def test_values_and_inner_documents():
    assert rendered(0x81, "a\0b\0".encode("utf-16-le")) == "a, b" and rendered(0x86, struct.pack("<3H", 1, 2, 3)) == "1, 2, 3"
    assert (rendered(13, b"\1\0\0\0"), rendered(20, b"\xff\0\0\0"), rendered(14, b"\xab"), rendered(12, struct.pack("<d", 0.5)), rendered(3, b"\xff")) == ("true", "0xff", "ab", "0.5", "-1")
    assert rendered(18, struct.pack("<8H", 2024, 2, 4, 29, 1, 2, 3, 4)) == "2024-02-29T01:02:03.004Z"
    x = BinaryXml(0)
    x.open("A", b="v")
    x.text("t")
    x.close()
    from quarrybed.sources.eventlogs import _Reader

    (e,), _ = _Reader(bytes(x.out) + b"\0", []).nodes(0, len(x.out) + 1)
    assert (e.tag, e.get("b"), e.text) == ("A", "v", "t")
