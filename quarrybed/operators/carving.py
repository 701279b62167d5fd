"""Files found by signature in byte streams, and file systems found in unpartitioned gaps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybed.operators.records import interval_of
from quarrybed.operators.search import chunked

#: Header, extension, label, footer and bytes after it.
SIGNATURES = (
    (b"\xff\xd8\xff", "jpg", "JPEG image", b"\xff\xd9", 0),
    (b"\x89PNG\r\n\x1a\n", "png", "PNG image", b"IEND", 4),
    (b"GIF8", "gif", "GIF image", b"\x00\x3b", 0),
    (b"%PDF-", "pdf", "PDF document", b"%%EOF", 0),
    (b"PK\x03\x04", "zip", "ZIP/Office container", None, 0),
    (b"BM", "bmp", "BMP image", None, 0),
    (b"\x1f\x8b\x08", "gz", "GZIP stream", None, 0),
    (b"Rar!\x1a\x07", "rar", "RAR archive", None, 0),
)
UNKNOWN_LENGTH_MAX = 64 * 1024 * 1024
_HEADERS = re.compile(b"|".join(re.escape(s[0]) for s in sorted(SIGNATURES, key=lambda s: -len(s[0]))))
_BY_HEADER = {s[0]: s for s in SIGNATURES}


def extent(data: bytes, at: int, signature: tuple, limit: int = UNKNOWN_LENGTH_MAX) -> tuple[int, str, bool]:
    """(length, what it rests on, whether the end is certain) of the file that begins at ``at``."""
    _, ext, _, footer, after = signature
    left = len(data) - at
    if footer:
        # the footer may overlap the header; it counts only with all the bytes that must follow it
        end = data.find(footer, at)
        while end >= 0 and end + len(footer) + after > len(data):
            end = data.find(footer, end + 1)
        return (end + len(footer) + after - at, "footer", True) if end >= 0 else (left, "no footer", False)
    if ext == "bmp" and left >= 6:
        declared = int.from_bytes(data[at + 2 : at + 6], "little")
        if declared >= 2:
            return (declared, "declared size", True) if declared <= left else (left, "declared size beyond the end", False)
    return (min(left, limit), "protective limit" if left > limit else "end of stream", False)


def carve_bytes(data: bytes, limit: int = UNKNOWN_LENGTH_MAX) -> list[tuple[int, int, str, str, str, bool]]:
    """(offset, length, extension, label, basis, certain) of the files of one stream.

    A file whose end is certain hides what begins inside it; another hides only its own header.
    """
    out, free, at = [], 0, 0
    while m := _HEADERS.search(data, at):
        at = m.start()
        if at >= free:
            sig = _BY_HEADER[m[0]]
            length, basis, certain = extent(data, at, sig, limit)
            out.append((at, length, sig[1], sig[2], basis, certain))
            free = at + max(length if certain else 0, len(sig[0]))
        at = max(at + 1, free)
    return out


#: Bytes that must follow a chunk, so that headers, footers with what must follow them and declared sizes are whole.
REACH = 32
_CHUNK_SCHEMA = "source_id bigint, offset bigint, signature int, declared bigint"


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers (signature 0, 1, ..) and footers (-1, -2, ..) that begin in the own part of each chunk."""
    heads = {s[0]: i for i, s in enumerate(SIGNATURES)}
    for batch in batches:
        rows = []
        for sid, base, own, lead, data in zip(*[c.to_pylist() for c in batch.columns]):
            data = data or b""
            for i, (header, ext, _, footer, after) in enumerate(SIGNATURES):
                for mark, is_footer in ((header, False), (footer, True)):
                    at = data.find(mark, lead) if mark else -1
                    while 0 <= at < lead + own:
                        if not is_footer:
                            longer = any(h != mark and h.startswith(mark) and data.startswith(h, at) for h in heads)
                            declared = int.from_bytes(data[at + 2 : at + 6], "little") if ext == "bmp" and len(data) - at >= 6 else None
                            if not longer:
                                rows.append((sid, base + at - lead, i, declared))
                        elif at + len(mark) + after <= len(data):
                            rows.append((sid, base + at - lead, -1 - i, None))
                        at = data.find(mark, at + 1)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["source_id", "offset", "signature", "declared"])


def _extents(limit: int):
    """From the marks of each stream in falling order of offset, the extent of each header: the next footer is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, nearest = None, {}
        for batch in batches:
            rows = []
            for sid, at, sig, declared, length in zip(*[c.to_pylist() for c in batch.columns]):
                if sid != stream:
                    stream, nearest = sid, {}
                if sig < 0:
                    nearest[-1 - sig] = at
                    continue
                header, ext, label, footer, after = SIGNATURES[sig]
                left = length - at
                if footer:
                    end = nearest.get(sig)
                    got = (end + len(footer) + after - at, "footer", True) if end is not None else (left, "no footer", False)
                elif declared is not None and declared >= 2:
                    got = (declared, "declared size", True) if declared <= left else (left, "declared size beyond the end", False)
                else:
                    got = (min(left, limit), "protective limit" if left > limit else "end of stream", False)
                rows.append((sid, at, got[0], ext, label, got[1], got[2], len(header)))
            yield _found(rows)

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["source_id", "offset", "length", "extension", "label", "basis", "definitive", "header_bytes"])


def _unhidden(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the extents of each stream in rising order, those that no earlier one hides."""
    stream, free = None, 0
    for batch in batches:
        rows = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != stream:
                stream, free = row[0], 0
            if row[1] >= free:
                rows.append(row)
                free = row[1] + max(row[2] if row[6] else 0, row[7])
        yield _found(rows)


def carve_chunks(chunks: DataFrame, limit: int = UNKNOWN_LENGTH_MAX) -> DataFrame:
    """``source_id, offset, length, extension, label, basis, definitive`` of the files in streams of any length.

    ``chunks`` as for ``raw_search``, each with at least ``REACH`` bytes after its own part. Chunks are searched apart for
    headers and footers; only these few marks are brought together per stream, where one pass backward gives each header
    its end and one forward drops what begins inside a file whose end is certain. Both passes hold one row.
    """
    marks = chunks.select("source_id", "chunk_offset", "own_length", "lead", "bytes").mapInArrow(_marks, _CHUNK_SCHEMA)
    lengths = chunks.groupBy("source_id").agg(F.max(F.col("chunk_offset") + F.col("own_length")).alias("length"))
    schema = "source_id bigint, offset bigint, length bigint, extension string, label string, basis string, definitive boolean, header_bytes bigint"
    marked = marks.join(lengths, "source_id").select("source_id", "offset", "signature", "declared", "length")
    down = marked.repartition("source_id").sortWithinPartitions("source_id", F.desc("offset"), "signature")
    up = down.mapInArrow(_extents(limit), schema).repartition("source_id").sortWithinPartitions("source_id", "offset")
    return up.mapInArrow(_unhidden, schema).drop("header_bytes")


def carve(streams: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``carve_chunks`` of whole streams ``source_id, bytes``; null and empty ones give nothing."""
    return carve_chunks(chunked(streams, size, REACH))


def file_system_of_sector(window: Column) -> Column:
    """What begins at a sector, from a window of 2,048 bytes: ext magic first, then BitLocker, then NTFS and FAT."""
    part = lambda at, n: F.hex(F.substr(window, F.lit(at + 1), F.lit(n)))
    boot = part(510, 2) == "55AA"
    return F.when(part(1080, 2) == "53EF", "ext").when(part(3, 8) == b"-FVE-FS-".hex().upper(), "bitlocker").when(boot & (part(3, 4) == b"NTFS".hex().upper()), "ntfs").when(boot & (part(82, 5) == b"FAT32".hex().upper()), "fat32").when(boot & part(54, 5).isin(b"FAT12".hex().upper(), b"FAT16".hex().upper()), "fat16").when(boot & (part(3, 5) == b"EXFAT".hex().upper()), "exfat")


#: File system, bytes that tell it, their place from its first sector, whether the sector must end as a boot sector.
FILE_SYSTEMS = (("ext", b"\x53\xef", 1080, False), ("bitlocker", b"-FVE-FS-", 3, False), ("ntfs", b"NTFS", 3, True), ("fat32", b"FAT32", 82, True), ("fat16", b"FAT12", 54, True), ("fat16", b"FAT16", 54, True), ("exfat", b"EXFAT", 3, True))
#: Bytes after a chunk in which what tells a file system may stand.
FS_REACH = 2048


def lost_in_chunks(chunks: DataFrame, sector: int = 512, accept: Callable[[int, int, str], bool] | None = None) -> DataFrame:
    """``source_id, offset, file_system`` of every sector at which a file system seems to begin, in streams of any length.

    ``chunks`` begin at whole sectors and carry ``FS_REACH`` bytes after their own part. The telling bytes are searched for in each
    chunk, so sectors without them cost nothing. Of several at a sector the first of ``FILE_SYSTEMS`` counts. ``accept``
    (source, offset, file system) may refuse a candidate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, base, own, lead, data in zip(*[c.to_pylist() for c in batch.columns]):
                data, seen = data or b"", {}
                for name, telling, place, boot in FILE_SYSTEMS:
                    at = data.find(telling, lead + place)
                    while at >= 0 and at - place < lead + own:
                        start = at - place
                        if (base + start - lead) % sector == 0 and (not boot or data[start + 510 : start + 512] == b"\x55\xaa"):
                            seen.setdefault(base + start - lead, name)
                        at = data.find(telling, at + 1)
                rows += [(sid, at, name) for at, name in sorted(seen.items()) if accept is None or accept(sid, at, name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["source_id", "offset", "file_system"])

    return chunks.select("source_id", "chunk_offset", "own_length", "lead", "bytes").mapInArrow(run, "source_id bigint, offset bigint, file_system string")


def lost_file_systems(streams: DataFrame, sector: int = 512, size: int = 8 << 20) -> DataFrame:
    """``lost_in_chunks`` of whole streams ``source_id, bytes``; null and empty ones give nothing."""
    return lost_in_chunks(chunked(streams, size - size % sector or sector, FS_REACH), sector)


def in_gaps(candidates: DataFrame, partitions: DataFrame) -> DataFrame:
    """Candidates that lie in no partition. ``partitions``: partition, start_at, size_at, in bytes of the same stream."""
    return interval_of(candidates, "offset", partitions, "start_at", "size_at", "partition").where("partition is null").select(*candidates.columns)
