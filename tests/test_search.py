import os
import random

import pytest

from quarrybed.functions import text
from quarrybed.operators import carving, search
from quarrybed.sources.images import evidence_kind, list_tree, read_image

ENTRY = "entry_id bigint, evidence_id bigint, logical_path string, entry_name string, entry_kind string, metadata_json string, content_head binary"
SEGMENT = "entry_id bigint, parser_name string, part_name string, segment_index int, content string"


def entries(spark):
    rows = [
        (1, 1, "/a/Needle.txt", "Needle.txt", "file", "{}", b"needle too"),
        (2, 1, "/b", "b", "file", '{"k": "NEEDLE"}', b""),
        (3, 1, "/c", "c", "file", "{}", b"xx nEEdle"),
        (4, 1, "/d", "d", "file", "{}", "Needle".encode("utf-16-le")),
        (5, 1, "/e", "e", "file", "{}", b"\0" + "needle".encode("utf-16-be")),
        (6, 1, "/f", "f", "file", "{}", b"nothing"),
        (7, 1, "/g", "g", "directory", "{}", b"needle"),
        (8, 1, "/h", "h", "file", '{"artifact_kind": "filesystem_parser_error", "x": "needle"}', b""),
        (9, 2, "/i", "i.P_F", "record", '{"category_main": "Mail", "category_sub": "Box"}', None),
        (10, 1, None, None, "file", None, None),
    ]
    return spark.createDataFrame(rows, ENTRY)


def segments(spark):
    rows = [(6, "p", "x", 0, "a ne"), (6, "p", "x", 1, "e"), (6, "p", "x", 2, "dle b"), (3, "p", "x", 0, "nee"), (3, "p", "y", 1, "dle"), (9, "p", "x", 0, "Needle"), (1, "p", "x", 0, "needle")]
    return spark.createDataFrame(rows, SEGMENT)


def test_phases_exclude_each_other_and_segments_carry(spark):
    got = search.deep_search(entries(spark), segments(spark), "needle").collect()
    assert sorted((r.phase, r.entry_id, r.match_kind) for r in got) == [(0, 1, "path"), (0, 2, "path"), (1, 6, "parsed_content"), (1, 9, "parsed_content"), (2, 3, "content"), (2, 4, "content"), (2, 5, "content")]
    assert search.deep_search(entries(spark), segments(spark), "  ").count() == 0
    assert [r.entry_id for r in search.deep_search(entries(spark), segments(spark), "hex: 6e 45 45").collect()] == [3]


def test_scope(spark):
    assert [r.entry_id for r in search.scope(entries(spark), "mail box").collect()] == [9]  # a match may span fields
    assert [r.entry_id for r in search.scope(entries(spark), None, [".p?f", "PxF"]).collect()] == []
    assert [r.entry_id for r in search.scope(entries(spark), None, ["p_f"]).collect()] == [9]


def test_hex_grammars():
    assert text.strict_hex("0xFF, D8-ff:00") == b"\xff\xd8\xff\x00"
    for bad in ("", "F", "zz", "FF_D8"):
        with pytest.raises(ValueError):
            text.strict_hex(bad)
    assert text.lenient_hex("HEX: FF_d8-00") == b"\xff\xd8\0" and text.lenient_hex("0xFFD8") == b"\xff\xd8" and text.lenient_hex("bytes:00") == b"\0"
    assert text.lenient_hex("hex:F") is None and text.lenient_hex("needle") is None and text.lenient_hex("hex:") is None
    assert text.overlap_bytes("abc") == 5 and text.overlap_bytes("") == 0


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_chunk_size_does_not_change_hits(spark, size):
    rng = random.Random(4)
    data = bytes(rng.choice(b"aA\0b") for _ in range(3000)) + "abaAB".encode("utf-16-le") + b"abab"
    streams = spark.createDataFrame([(1, data), (2, b""), (3, None)], "source_id bigint, bytes binary")
    got = search.raw_search(search.chunked(streams.where("bytes is not null"), size, 8), "aB").collect()
    want = search.all_matches(data, "aB")
    assert sorted((r.offset, r.length, r.encoding) for r in got) == sorted((a, n, e) for a, n, e, _ in want)
    folded = data.lower()
    assert [a for a, _, e, _ in want if e == "ascii"] == [i for i in range(len(data)) if folded[i : i + 2] == b"ab"]
    assert all(r.sector == r.offset // 512 for r in got)


def test_image_source(spark, tmp_path):
    data = os.urandom(5000) + b"MARK" + os.urandom(999)
    path = tmp_path / "img.raw"
    path.write_bytes(data)
    chunks = read_image(spark, str(path), overlap=3, chunk=1000)
    assert chunks.count() == 7
    hits = search.raw_search(chunks, "hex:" + b"MARK".hex()).collect()
    assert [r.offset for r in hits] == [5000] and hits[0].hex_preview.split()[8:12] == ["4D", "41", "52", "4B"]
    assert [r.size_bytes for r in list_tree(spark, str(tmp_path)).collect()] == [len(data)]
    assert evidence_kind(" Image ") == "image"
    with pytest.raises(ValueError):
        evidence_kind("tape")


def test_carving_rules():
    jpg = b"\xff\xd8\xff\xe0 GIF8 inside \xff\xd9"
    png = b"\x89PNG\r\n\x1a\n...IEND1234"
    bmp = b"BM" + (30).to_bytes(4, "little") + b"x" * 24
    got = carving.carve_bytes(b"--" + jpg + b"==" + png + bmp + b"%PDF-1 never ends \x1f\x8b\x08zzz", limit=10)
    assert [(a, n, e, c) for a, n, e, _, _, c in got] == [(2, len(jpg), "jpg", True), (4 + len(jpg), len(png), "png", True), (4 + len(jpg) + len(png), 30, "bmp", True), (34 + len(jpg) + len(png), 24, "pdf", False), (52 + len(jpg) + len(png), 6, "gz", False)]
    assert carving.carve_bytes(b"") == [] and carving.extent(b"BM\xff\xff\0\0", 0, carving.SIGNATURES[5])[2] is False
    # a footer without the bytes that must follow it is none
    assert carving.extent(b"\x89PNG\r\n\x1a\nIEND12", 0, carving.SIGNATURES[1])[1:] == ("no footer", False)


def test_lost_file_systems(spark):
    ntfs = bytearray(2048)
    ntfs[3:7], ntfs[510:512] = b"NTFS", b"\x55\xaa"
    ext = bytearray(2048)
    ext[1080:1082] = b"\x53\xef"
    data = bytes(512) + bytes(ntfs) + bytes(ext)
    df = spark.createDataFrame([(1, data), (2, b"")], "source_id bigint, bytes binary")
    assert sorted((r.offset, r.file_system) for r in carving.lost_file_systems(df).collect()) == [(512, "ntfs"), (2560, "ext")]
