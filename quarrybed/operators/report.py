"""Reports, bookmarks and exports of a case."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_key(key: str) -> tuple[str | None, str | None]:
    """(main, sub) of a ``main|||sub`` key: an empty main means all, a missing main text the uncategorised."""
    main, _, sub = key.partition("|||")
    return main or None, sub or None


def in_category(df: DataFrame, main: Column, sub: Column, key: str) -> DataFrame:
    want_main, want_sub = category_key(key)
    if want_main is not None:
        df = df.where(F.coalesce(main, F.lit("Uncategorized")) == want_main)
    return df.where(sub == want_sub) if want_sub is not None else df


def expanded(df: DataFrame, order: list[str], most: int = 1_000) -> tuple[DataFrame, int, int]:
    """The first so many rows, how many there are, and how many are left out: a report's bound is its feature."""
    total = df.count()
    return df.orderBy(*order).limit(most), total, max(0, total - most)


def entries_per_source(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Each source with ``entries_indexed``: how many different entries it has, 0 for none. Counted before joined."""
    counts = entries.select("evidence_id", "entry_id").distinct().groupBy("evidence_id").agg(F.count("*").alias("__n"))
    return sources.join(counts, "evidence_id", "left").withColumn("entries_indexed", F.coalesce("__n", F.lit(0))).drop("__n")


def with_source_names(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Report items with the display name of the source they lie on; an unknown one reads ``Evidence n``."""
    names = sources.groupBy("evidence_id").agg(F.min("display_name").alias("__name"))
    return items.join(names, "evidence_id", "left").withColumn("source_name", F.coalesce("__name", F.format_string("Evidence %d", F.col("evidence_id")))).drop("__name")


def skipped(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids asked for that no entry has."""
    return wanted.select("entry_id").distinct().join(entries.select("entry_id"), "entry_id", "left_anti")


def relinked(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Bookmark items pointed to the entries that now have their path; items whose path is gone keep a null entry."""
    now = entries.groupBy("evidence_id", "logical_path").agg(F.max("entry_id").alias("new_entry_id"))
    return items.join(now, ["evidence_id", "logical_path"], "left").withColumn("entry_id", F.col("new_entry_id")).drop("new_entry_id")


def resolved_time(keys: list[str], metadata: str = "metadata_json") -> Column:
    """The first of several stamps that a record has."""
    return F.coalesce(*[F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit("")) for k in keys])


def render(title: str, folders: list[dict]) -> tuple[str, str]:
    """An HTML report and the SHA-256 of all that comes before its footer.

    ``folders``: name, comment, items (display_name, logical_path, preview). The rows are those of a bounded report.
    """
    e = html.escape
    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>"]
    for f in folders:
        parts.append(f"<section><h2>{e(f['name'])}</h2><p>{e(f.get('comment') or '')}</p><table>")
        parts += [f"<tr><td>{e(i['display_name'])}</td><td>{e(i['logical_path'])}</td><td>{e(i.get('preview') or '')}</td></tr>" for i in f["items"]]
        parts.append("</table></section>")
    body = "".join(parts)
    digest = hashlib.sha256(body.encode()).hexdigest()
    return body + f"<footer>SHA-256 {digest}</footer></body></html>", digest


def write_new(path: str, data: bytes) -> None:
    """Write a file at once under its name; an existing one is refused."""
    temporary = f"{path}.part-{os.getpid()}"
    with open(temporary, "xb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(temporary, path)  # fails if the name is taken
    finally:
        os.unlink(temporary)


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Output names made unique: later ones of a name (letters folded) get a number before the extension."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("output_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)))


def manifest(df: DataFrame) -> DataFrame:
    """``path, size_bytes, sha256`` of files with their bytes."""
    return df.select("path", F.octet_length("bytes").cast("bigint").alias("size_bytes"), F.sha2("bytes", 256).alias("sha256"))


def manifest_csv(rows: list[tuple]) -> str:
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
    w.writerow(("path", "size", "sha256"))
    w.writerows(rows)
    return out.getvalue()


def export_files(df: DataFrame, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """Write each ``output_name, bytes`` into a shared folder by the task that holds it; returns name, status and digest.

    Names cannot leave the folder; files that exist or are too large are skipped and say so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(*[c.to_pylist() for c in batch.columns]):
                target = os.path.join(folder, os.path.basename((name or "").replace("\\", "/")) or "unnamed")
                status = "written"
                if data is None or len(data) > most_bytes:
                    status = "skipped: no data" if data is None else "skipped: too large"
                else:
                    try:
                        write_new(target, data)
                    except FileExistsError:
                        status = "skipped: exists"
                rows.append((name, status, hashlib.sha256(data).hexdigest() if status == "written" else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["output_name", "status", "sha256"])

    return df.select("output_name", "bytes").mapInArrow(run, "output_name string, status string, sha256 string")
