"""Nested records to flat, linked tables in one pass.

A depth-first visitor walks each record once and emits, for each object that stands in an array, a row with the
tag of its table (its path without positions), its key, the key of the object around it and its own payload.
Nothing is shuffled: a row's children are found where the row is. ``write_tables`` writes the rows partitioned by
tag, and ``read_table`` applies the schema of one tag.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "record_id bigint, table_tag string, item_path string, parent_path string, payload string"
#: Keys under which one bare object counts as an array of one.
LIST_KEYS = ("task_principals", "task_triggers", "task_actions", "volumes", "file_references", "items", "extension_blocks", "extra_data", "recipients", "attachments", "members", "streams", "extents")


def _refuse(name: str):
    raise ValueError(name)


_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_BLANKS = re.compile(r"[ \t\n\r]*")
_LITERALS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _key(text: str, at: int) -> tuple[str, int]:
    """The key at ``at`` and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    key, at = scanstring(text, at + 1, True)
    at = _BLANKS.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return key, _BLANKS.match(text, at + 1).end()


def read_deep(text: str):
    """``json.loads`` without NaN and Infinity, with a list as its stack: depth is bounded by memory only."""
    skip = lambda i: _BLANKS.match(text, i).end()
    around: list = []
    keys: list[str] = []
    at = skip(0)
    while True:
        ch = text[at : at + 1]
        if ch == "{" or ch == "[":
            value = {} if ch == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] != ("}" if ch == "{" else "]"):
                around.append(value)
                if ch == "{":
                    key, at = _key(text, at)
                    keys.append(key)
                continue
            at += 1
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        elif ch in _LITERALS and text.startswith(_LITERALS[ch][0], at):
            word, value = _LITERALS[ch]
            at += len(word)
        elif m := _NUMBER.match(text, at):
            value, at = float(m[0]) if m[2] or m[3] else int(m[0]), m.end()
        else:
            raise ValueError("no value")
        # the value is whole: put it where it belongs, and close what ends after it
        while True:
            at = skip(at)
            if not around:
                if at < len(text):
                    raise ValueError("more text")
                return value
            top, ch = around[-1], text[at : at + 1]
            if isinstance(top, dict):
                top[keys.pop()] = value
            else:
                top.append(value)
            if ch == ",":
                at = skip(at + 1)
                if isinstance(top, dict):
                    key, at = _key(text, at)
                    keys.append(key)
                break
            if ch != ("}" if isinstance(top, dict) else "]"):
                raise ValueError("not closed")
            value = around.pop()
            at += 1


def read_json(text: str):
    """Parsed JSON of any depth; ValueError where it is none."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return read_deep(text)


def _dumps(value: dict) -> str:
    """``json.dumps`` of objects in objects, of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out, work = [], [value]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append("{")
        work.append("}")
        for n, (k, v) in reversed(list(enumerate(x.items()))):
            work.append(v if isinstance(v, dict) else json.dumps(v, ensure_ascii=False))
            work.append((", " if n else "") + json.dumps(k, ensure_ascii=False) + ": ")
    return "".join(out)


def read_record(text: str | None):
    """The parsed record, or None: of no text, unreadable text, or text that is no object and no array.

    A record encoded as a JSON string once more is read twice. NaN and Infinity are not JSON.
    """
    if text is None:
        return None
    try:
        value = read_json(text.lstrip("﻿"))
        if isinstance(value, str):
            value = read_json(value)
    except ValueError:
        return None
    return value if isinstance(value, dict | list) else None


def visit(record, list_keys: frozenset[str], payload: bool = True) -> Iterator[tuple[str, str, str, str | None]]:
    """(table_tag, item_path, parent_path, payload) of each item, parents before children.

    The stack is a list, so depth is bounded by memory only. The payload (null if not asked for) holds what belongs to the item itself:
    its scalars, scalar arrays and plain inner objects without the items inside them.
    """
    stack: list = [(record, "", "", "", "any")]
    while stack:
        value, path, tag, parent, place = stack.pop()
        if isinstance(value, list):
            stack.extend((v, f"{path}[{i}]", tag, parent, "array") for i, v in zip(range(len(value) - 1, -1, -1), reversed(value)) if isinstance(v, dict | list))
        elif isinstance(value, dict):
            if place == "array":
                yield tag, path, parent, _dumps(_own(value, list_keys)) if payload else None
                parent = path
            inner = []
            for k, v in value.items():
                if isinstance(v, dict | list):
                    p, t = (f"{path}.{k}", f"{tag}.{k}") if path else (k, k)
                    bare = isinstance(v, dict) and k in list_keys
                    inner.append((v, f"{p}[0]" if bare else p, t, parent, "array" if bare else "key"))
            stack.extend(reversed(inner))


def _own(value: dict, list_keys: frozenset[str]) -> dict:
    out: dict = {}
    work = [(value, out)]
    while work:
        src, dst = work.pop()
        for k, v in src.items():
            if isinstance(v, dict):
                if k not in list_keys:
                    dst[k] = {}
                    work.append((v, dst[k]))
            elif not isinstance(v, list):
                dst[k] = v
            elif not any(isinstance(x, dict | list) for x in v):
                dst[k] = v
    return out


def flatten_records(df: DataFrame, id_col: str, json_col: str, list_keys: Iterable[str] = LIST_KEYS, payload: bool = True) -> DataFrame:
    """One row per object that stands in an array of the record, at any depth, linked to the object around it.

    ``item_path`` joins keys with ``.`` and appends ``[i]``; ``parent_path`` is the path of the nearest item around,
    else ''. A bare object under one of ``list_keys`` counts as an array of one.

    Defined results: null, blank, truncated or otherwise unreadable JSON and bare scalars give no row; a null id
    is kept as null; repeated rows give repeated items (see ``flatten_distinct``); empty arrays give nothing; nulls
    and scalars in an array are counted as positions; records of any length are read whole; other columns of ``df``
    are not read.
    """
    keys = frozenset(list_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read_record(text)
                if record is None:
                    continue
                for item in visit(record, keys, payload):
                    for c, v in zip(cols, (rid, *item)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["record_id", "table_tag", "item_path", "parent_path", "payload"])

    return df.select(F.col(id_col).cast("bigint"), F.col(json_col).cast("string")).mapInArrow(run, SCHEMA)


def flatten_distinct(df: DataFrame, id_col: str, json_col: str, list_keys: Iterable[str] = LIST_KEYS) -> DataFrame:
    """``flatten_records`` with each item of each record id once; if contents differ, the least payload is kept.

    The records are not joined or grouped before the visit; only the narrow item rows are, with map-side combine.
    """
    rows = flatten_records(df, id_col, json_col, list_keys)
    return rows.groupBy("record_id", "table_tag", "item_path", "parent_path").agg(F.min("payload").alias("payload"))


def write_tables(rows: DataFrame, path: str, tasks: int = 64) -> None:
    """Write item rows partitioned by table tag. A tag is written by up to ``tasks`` tasks, by record, so a large one is spread."""
    rows.withColumn("part", F.regexp_replace("table_tag", r"[^A-Za-z0-9_.]", "_")).repartition("part", F.pmod(F.xxhash64("record_id"), F.lit(tasks))).write.partitionBy("part").mode("errorifexists").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One flat table: the keys, and the payload read with ``schema`` (missing fields are null)."""
    rows = spark.read.parquet(path).where(F.col("part") == re.sub(r"[^A-Za-z0-9_.]", "_", tag)).where(F.col("table_tag") == tag)
    return rows.select("record_id", "item_path", "parent_path", F.from_json("payload", schema).alias("v")).select("record_id", "item_path", "parent_path", "v.*")
