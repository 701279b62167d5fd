"""Search over entries, their parsed text and their bytes, in phases that exclude each other."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybed.functions.text import ascii_lower, contains_any, lenient_hex, let

SECTOR = 512
CONTEXT = 8
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def scope(df: DataFrame, category: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Entries in scope: no parser summaries; the category text within the joined category fields; a name's ending."""
    field = lambda k: F.coalesce(F.get_json_object("metadata_json", f"$.{k}"), F.lit(""))
    df = df.where(~field("artifact_kind").isin("filesystem_parser_error", "filesystem_parser_summary"))
    if category and category.strip():
        fields = F.concat_ws(" ", *[field(k) for k in ("category_main", "category_sub", "category_detail", "analysis_category", "category_tags")])
        df = df.where(contains_any([fields], category.strip()))
    likes = [ascii_lower(F.col("entry_name")).like("%." + e.strip().lstrip(".").lower()) for e in extensions or [] if e.strip().lstrip(".")]
    if likes:
        test = likes[0]
        for x in likes[1:]:
            test = test | x
        df = df.where(test)
    return df


def path_match(query: str) -> Column:
    return contains_any([F.col("logical_path"), F.col("entry_name"), F.col("metadata_json")], query)


def segment_hits(segments: DataFrame, query: str) -> DataFrame:
    """``entry_id`` of each entry with a match in its parsed text, once; a match may span segments of a part.

    ``segments``: entry_id, parser_name, part_name, segment_index, content. Matches inside a segment are found where it is.
    For those that span segments only the edges of each, shorter than the query, are brought together, in groups of
    ``_SEAM`` numbers. Text goes on from one segment to the next number; where a number is missing it does not. A repeated
    delivery of a segment changes nothing; null parts are parts; null content and blank queries match nothing.
    """
    inside = segments.where(contains_any([F.col("content")], query)).select("entry_id")
    keep = len(query) - 1
    if keep < 1:
        return inside.distinct()
    i = F.col("segment_index").cast("bigint")
    edges = segments.where(F.col("content") != "").groupBy("entry_id", "parser_name", "part_name", i.alias("i")).agg(F.min(F.struct(F.left("content", F.lit(keep)).alias("head"), F.right("content", F.lit(keep)).alias("tail"))).alias("e"))
    group = lambda c: F.call_function("div", c, F.lit(_SEAM).cast("bigint"))
    # a row stands in its own group, and in the next one if a match may reach there
    groups = F.array_distinct(F.array(group(F.col("i")), group(F.col("i") + keep)))
    rows = edges.select("entry_id", "parser_name", "part_name", "i", "e.*", F.explode(groups).alias("g"))
    w = Window.partitionBy("entry_id", "parser_name", "part_name", "g").orderBy("i").rangeBetween(-keep, -1)
    before = F.collect_list(F.struct("i", "tail")).over(w)
    joined = rows.withColumn("before", before).where(group(F.col("i")) == F.col("g"))
    # only what stands without a hole before the segment belongs to its text
    tails = F.filter("before", lambda x, k: x.i - F.col("i") == k - F.size("before"))
    seam = F.concat(F.right(F.array_join(F.transform(tails, lambda x: x.tail), ""), F.lit(keep)), F.col("head"))
    spanning = joined.where(contains_any([seam], query)).select("entry_id")
    return inside.unionByName(spanning).distinct()


#: Segment numbers brought together when edges are joined.
_SEAM = 4096


def deep_search(entries: DataFrame, segments: DataFrame, query: str, category: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """``phase, evidence_id, logical_path, entry_id, match_kind``: 0 path, 1 parsed text, 2 content; an entry comes once, in
    the first phase that finds it. A ``hex:`` query looks at content only.

    ``entries``: entry_id, evidence_id, logical_path, entry_name, entry_kind, metadata_json, content_head (BINARY).
    ``segments``: entry_id, parser_name, part_name, segment_index, content (STRING).
    Blank queries find nothing; null columns match nothing; repeated entries are repeated in the result.

    Entries are read once; path and content are tested there, and only keys and flags are joined with the entries that
    have hits in their parsed text.
    """
    key = ["evidence_id", "logical_path", "entry_id"]
    entries = scope(entries, category, extensions)
    if not query.strip():
        return entries.where("false").select(F.lit(0).alias("phase"), *key, F.lit("").alias("match_kind"))
    hexed = lenient_hex(query)
    file, readable = F.col("entry_kind") == "file", F.col("entry_kind").isin("file", "record")
    if hexed is not None:
        found = entries.where(readable & (F.instr(F.decode("content_head", "ISO-8859-1"), hexed.decode("latin-1")) > 0))
        return found.select(F.lit(3).alias("phase"), *key, F.lit("hex_content").alias("match_kind"))
    fold = ascii_lower(F.decode("content_head", "ISO-8859-1"))
    forms = [F.coalesce(F.instr(fold, query.lower().encode(cs).decode("latin-1")) > 0, F.lit(False)) for cs in ("utf-8", "utf-16-le", "utf-16-be")]
    by_path = path_match(query)
    flags = entries.select(*key, by_path.alias("by_path"), F.coalesce(readable, F.lit(False)).alias("readable"), (F.coalesce(file, F.lit(False)) & ~by_path & (forms[0] | forms[1] | forms[2])).alias("by_content"))
    hits = segment_hits(segments, query).select(F.col("entry_id").alias("__hit"))
    rows = flags.where("by_path or readable").join(hits, F.col("entry_id") == F.col("__hit"), "left")
    phase = F.when(F.col("by_path"), 0).when(F.col("readable") & F.col("__hit").isNotNull(), 1).when(F.col("by_content"), 2)
    kinds = F.element_at(F.array(F.lit("path"), F.lit("parsed_content"), F.lit("content")), F.col("phase") + 1)
    return rows.select(phase.alias("phase"), *key).where("phase is not null").select("phase", *key, kinds.alias("match_kind"))


# Raw bytes ----------------------------------------------------------------------------------------------------------


def needles(query: str) -> list[tuple[str, int, bytes, bool]]:
    """(encoding, rank, bytes, whether letters fold) of the forms in which a query is looked for."""
    hexed = lenient_hex(query) if query.lower().startswith("hex:") else None
    if hexed is not None:
        return [("hex", 0, hexed, False)]
    return [("ascii", 0, query.encode(), True), ("utf16le", 1, query.encode("utf-16-le"), True), ("utf16be", 2, query.encode("utf-16-be"), True)] if query else []


def _verified(hay: bytes, at: int, needle: bytes, encoding: str) -> bool:
    """Letters fold in units: in 16-bit text a byte folds only beside a zero byte."""
    if not encoding.startswith("utf16"):
        return True
    part = hay[at : at + len(needle)]
    high = 1 if encoding == "utf16le" else 0
    for i in range(0, len(part), 2):
        u, v = part[i : i + 2], needle[i : i + 2]
        if u != v and not (u[high] == v[high] == 0 and u.translate(_FOLD) == v.translate(_FOLD)):
            return False
    return True


def earliest_match(content: Column, query: str) -> Column:
    """STRUCT<offset, length, encoding> of the first match of a text in bytes, letters folded: plain before 16-bit little-endian
    before big-endian where they begin together; null if there is none. A big-endian match one byte before a little-endian
    one is only its shadow. Blank queries and null content match nothing."""
    forms = [("ascii", query.encode()), ("utf16le", query.encode("utf-16-le")), ("utf16be", query.encode("utf-16-be"))]

    def places(fold: Column) -> Column:
        return F.array(*[F.instr(fold, _folded(n).decode("latin-1")).cast("bigint") - 1 for _, n in forms])

    def first(at: Column) -> Column:
        shadow = (at[2] + 1 == at[1]) & (at[1] >= 0)
        found = [F.struct(at[i].alias("offset"), F.lit(i).alias("rank"), F.lit(len(n)).alias("length"), F.lit(name).alias("encoding")) for i, (name, n) in enumerate(forms)]
        return F.array_min(F.filter(F.array(*found), lambda x: (x.offset >= 0) & ~((x["rank"] == 2) & shadow)))

    best = let(let(ascii_lower(F.decode(content, "ISO-8859-1")), places), first)
    return F.when(F.lit(bool(query.strip())), let(best, lambda b: F.when(b.isNotNull(), F.struct(b.offset.alias("offset"), b.length.alias("length"), b.encoding.alias("encoding")))))


def _folded(data: bytes) -> bytes:
    return data.translate(_FOLD)


Finder = Callable[[bytes], Iterable[tuple[int, int]]]


def found_by(chunks: DataFrame, finder: Finder, name: str) -> DataFrame:
    """Matches of any finder in overlapping chunks: ``source_id, offset, length, finder``. The finder gives (offset, length)
    within the bytes it is given; matches count where they begin in a chunk's own part, so each comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(sid, base + at - lead, n, name) for sid, base, own, lead, data in zip(*[c.to_pylist() for c in batch.columns]) for at, n in finder(data or b"") if lead <= at < lead + own]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["source_id", "offset", "length", "finder"])

    return chunks.select("source_id", "chunk_offset", "own_length", "lead", "bytes").mapInArrow(run, "source_id bigint, offset bigint, length bigint, finder string")


def find_next(chunks: DataFrame, query: str, offset: int) -> DataFrame:
    """The first match of each stream at or after an offset. Chunks that end before it are not searched."""
    rest = chunks.where(F.col("chunk_offset") + F.col("own_length") > offset)
    hits = raw_search(rest, query).where(F.col("offset") >= offset)
    return hits.groupBy("source_id").agg(F.min(F.struct("offset", "encoding_rank", "encoding", "length")).alias("m")).select("source_id", "m.offset", "m.length", "m.encoding")


def byte_range(chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """``source_id, bytes``: a range of each stream from its chunks; shorter at the end of a stream, no row beyond it."""
    at, end = F.col("chunk_offset"), F.col("chunk_offset") + F.col("own_length")
    first, last = F.greatest(at, F.lit(offset)), F.least(end, F.lit(offset + length))
    cut = chunks.where((at < offset + length) & (end > offset)).select("source_id", at.alias("at"), F.substr("bytes", (F.col("lead") + first - at + 1).cast("int"), (last - first).cast("int")).alias("b"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "b"))), lambda x: F.hex(x.b))
    return cut.groupBy("source_id").agg(F.unhex(F.array_join(parts, "")).alias("bytes"))


def all_matches(hay: bytes, query: str) -> list[tuple[int, int, str, int]]:
    """(offset, length, encoding, rank) of every match, overlapping ones too, by offset and rank."""
    folded, out = hay.translate(_FOLD), []
    for encoding, rank, needle, fold in needles(query):
        h, n = (folded, needle.translate(_FOLD)) if fold else (hay, needle)
        at = h.find(n)
        while at >= 0 and n:
            if _verified(hay, at, needle, encoding):
                out.append((at, len(n), encoding, rank))
            at = h.find(n, at + 1)
    return sorted(out, key=lambda x: (x[0], x[3], x[2]))


def raw_search(chunks: DataFrame, query: str) -> DataFrame:
    """Every match in a byte stream: ``source_id, offset, length, encoding, sector, hex_preview, ascii_preview``.

    ``chunks`` has ``source_id, chunk_offset, own_length, lead, bytes``: each chunk carries ``lead`` bytes before it, for
    previews, and those that follow it, as many as a match and its preview may need. It reports only matches that begin in
    its own part, so chunks are searched apart and no match is lost or counted twice.
    """
    schema = "source_id bigint, offset bigint, length int, encoding string, encoding_rank int, sector bigint, hex_preview string, ascii_preview string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, base, own, lead, data in zip(*[c.to_pylist() for c in batch.columns]):
                for at, n, enc, rank in all_matches(data or b"", query):
                    if lead <= at < lead + own:
                        cut = data[max(0, at - CONTEXT) : at + n + CONTEXT]
                        rows.append((sid, base + at - lead, n, enc, rank, (base + at - lead) // SECTOR, cut.hex(" ").upper(), "".join(chr(c) if 32 <= c < 127 else "." for c in cut)))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string())
            names = ["source_id", "offset", "length", "encoding", "encoding_rank", "sector", "hex_preview", "ascii_preview"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return chunks.select("source_id", "chunk_offset", "own_length", "lead", "bytes").mapInArrow(run, schema)


def chunked(streams: DataFrame, size: int, overlap: int) -> DataFrame:
    """``source_id, bytes`` cut to chunks with what precedes and follows each. Null and empty streams have no chunk."""
    n = F.octet_length("bytes").cast("bigint")
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(size).cast("bigint"))).alias("chunk_offset")
    cut = streams.where(n > 0).select("source_id", "bytes", starts)
    lead = F.least(F.col("chunk_offset"), F.lit(CONTEXT).cast("bigint"))
    own = F.least(F.octet_length("bytes") - F.col("chunk_offset"), F.lit(size)).cast("bigint")
    return cut.select("source_id", "chunk_offset", own.alias("own_length"), lead.alias("lead"), F.substr("bytes", (F.col("chunk_offset") - lead + 1).cast("int"), (lead + size + overlap + CONTEXT).cast("int")).alias("bytes"))


def after_cursor(hits: DataFrame, offset: int, encoding_rank: int, encoding: str) -> DataFrame:
    """Hits that follow a cursor in order of offset, rank and encoding; the offset also narrows plainly."""
    key = F.struct("offset", "encoding_rank", "encoding")
    at = F.struct(F.lit(offset).cast("bigint").alias("offset"), F.lit(encoding_rank).alias("encoding_rank"), F.lit(encoding).alias("encoding"))
    return hits.where((F.col("offset") >= offset) & (key > at))
