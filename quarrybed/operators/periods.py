"""Overlapping, nested and touching spans to continuous periods and the gaps between them.

Each half-open span of whole microseconds is cut into its canonical dyadic blocks (aligned powers of two, at most two
of each size). Blocks are kept in two tiers. Tall blocks, as large as a cell of 2**36 microseconds (about 19 hours) or
larger, are few different ones per entity, because time is finite; reduced, they say which cells are wholly covered.
Short blocks lie in exactly one cell, so (entity, cell) is the unit of work and an entity of any size is spread over
its cells. In a unit, blocks in order of start and size put ancestors first: covered blocks fall away, sibling pairs
merge upward, adjacent blocks coalesce. Only pieces that touch the edge of a cell are stitched per entity, at most two
per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 36
_TOP = 58

_A = "shiftright(s + shiftleft(1L, l) - 1L, l)"
_B = "shiftright(e, l)"
_BLOCKS = f"""
filter(flatten(transform(sequence(0, {_TOP}), l -> array(
    case when {_A} < {_B} and ({_A} & 1L) = 1 then struct(l as level, shiftleft({_A}, l) as at) end,
    case when {_A} < {_B} and ({_B} & 1L) = 1 and not (({_A} & 1L) = 1 and {_A} = {_B} - 1)
         then struct(l as level, shiftleft({_B} - 1L, l) as at) end))), x -> x is not null)
"""


def _reduce(unit: np.ndarray, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks sorted by unit, start and falling size to disjoint pieces (unit, from, to)."""
    # Blocks nest or are apart, so a block is covered if an earlier one of its unit reaches its end.
    size = np.left_shift(np.int64(1), level)
    new = np.concatenate([[True], unit[1:] != unit[:-1]])
    group = np.cumsum(new) - 1
    # an order-preserving number per (group, end): ranks keep the running maximum inside a group
    end = at + size
    rank = np.argsort(np.argsort(end, kind="stable"), kind="stable") + group.astype(np.int64) * (len(end) + 1)
    high = np.maximum.accumulate(rank)
    top = np.concatenate([[-1], high[:-1]])
    by_rank = np.sort(end, kind="stable")
    inside = (~new) & (top >= group * (len(end) + 1))
    reach = np.where(inside, by_rank[np.clip(top - group * (len(end) + 1), 0, len(end) - 1)], np.iinfo(np.int64).min)
    keep = end > reach
    unit, at, level = unit[keep], at[keep], level[keep]
    while len(at) > 1:  # sibling pairs merge upward
        size = np.left_shift(np.int64(1), level)
        pair = (unit[1:] == unit[:-1]) & (level[1:] == level[:-1]) & (at[1:] == at[:-1] + size[:-1]) & ((at[:-1] & size[:-1]) == 0)
        left = np.flatnonzero(pair)
        if not len(left):
            break
        level = level.copy()
        level[left] += 1
        stay = np.ones(len(at), bool)
        stay[left + 1] = False
        unit, at, level = unit[stay], at[stay], level[stay]
    end = at + np.left_shift(np.int64(1), level)
    first = np.concatenate([[True], (unit[1:] != unit[:-1]) | (at[1:] > end[:-1])])
    start = np.flatnonzero(first)
    last = np.concatenate([start[1:], [len(at)]]) - 1
    return unit[start], at[start], end[last]


def _pieces(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # keys, from, to of the piece still open
        names = [*(f"u{i}" for i in range(n_keys)), "lo", "hi"]
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys, at, level = np.column_stack(cols[:n_keys]), cols[n_keys], cols[n_keys + 1].astype(np.int64)
            unit = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
            where = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1])
            u, lo, hi = _reduce(unit, at, level)
            rows = np.column_stack([keys[where[u]], lo, hi])
            if held is not None:
                n = 0
                if (rows[0, :n_keys] == held[:n_keys]).all():
                    while n < len(rows) and (rows[n, :n_keys] == held[:n_keys]).all() and rows[n, -2] <= held[-1]:
                        held[-1] = max(held[-1], rows[n, -1])
                        n += 1
                rows = np.vstack([held, rows[n:]])
            held, rows = rows[-1].copy(), rows[:-1]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(rows.shape[1])], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[i : i + 1]) for i in range(n_keys + 2)], names)

    return run


def merge_spans(df: DataFrame, keys: list[Column], start: Column, end: Column) -> DataFrame:
    """Disjoint periods ``u0.., lo, hi`` of the spans [start, end) of each entity; spans that overlap or touch are one.

    ``keys`` are BIGINT expressions. Defined results: spans with a null key or bound, and spans that do not end after
    they start, are no spans and leave nothing; repeated and nested spans change nothing; an empty table gives an
    empty table; other columns are not read.
    """
    n = len(keys)
    u = [f"u{i}" for i in range(n)]
    spans = df.select(*[k.cast("bigint").alias(c) for k, c in zip(keys, u)], start.cast("bigint").alias("s"), end.cast("bigint").alias("e"))
    spans = spans.where("s < e").where(" and ".join(f"{c} is not null" for c in u))
    blocks = spans.select(*u, F.inline(F.expr(_BLOCKS))).select(*u, "at", "level")
    schema = lambda k: ", ".join([*(f"u{i} bigint" for i in range(k)), "lo bigint", "hi bigint"])
    # Tall tier: different tall blocks of one entity are bounded by the cells of the time line.
    tall = blocks.where(f"level >= {CELL}").distinct().repartition(*u).sortWithinPartitions(*u, "at", F.desc("level"))
    tall = tall.mapInArrow(_pieces(n), schema(n))
    full = tall.select(*u, F.explode(F.sequence(F.shiftright("lo", CELL), F.shiftright("hi", CELL) - 1)).alias("cell"))
    full = full.select(*u, "cell", F.shiftleft("cell", CELL).alias("at"), F.lit(CELL).alias("level"))
    short = blocks.where(f"level < {CELL}").select(*u, F.shiftright("at", CELL).alias("cell"), "at", "level")
    units = short.unionByName(full).repartition(*u, "cell").sortWithinPartitions(*u, "cell", "at", F.desc("level"))
    pieces = units.mapInArrow(_pieces(n + 1), schema(n + 1))
    edge = (F.col("lo") == F.shiftleft(F.col(f"u{n}"), CELL)) | (F.col("hi") == F.shiftleft(F.col(f"u{n}") + 1, CELL))
    part = [*u, "alone"]
    w = Window.partitionBy(*part).orderBy("lo")
    pieces = pieces.withColumn("alone", F.when(~edge, F.col("lo")))
    pieces = pieces.withColumn("new", F.when(F.lag("hi").over(w) == F.col("lo"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    return pieces.groupBy(*part, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*u, "lo", "hi")


def gaps_between(periods: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """The gaps ``lo, hi`` of at most ``longest`` between consecutive disjoint periods of each entity.

    A gap that short ends in the same bucket of twice its length as the period before it or in the next one, so each
    period gives its end to two buckets and (entity, bucket) is the unit of work, however many periods an entity has.
    """
    width = 2 * longest
    bucket = lambda c: F.call_function("div", F.col(c) - F.pmod(F.col(c), F.lit(width)), F.lit(width).cast("bigint"))
    starts = periods.select(*keys, bucket("lo").alias("b"), F.col("lo").alias("t"), F.lit(1).alias("k"))
    ends = periods.select(*keys, F.explode(F.array(bucket("hi"), bucket("hi") + 1)).alias("b"), F.col("hi").alias("t"), F.lit(0).alias("k"))
    w = Window.partitionBy(*keys, "b").orderBy("t", "k")
    seen = starts.unionByName(ends).withColumn("before", F.max(F.when(F.col("k") == 0, F.col("t"))).over(w))
    return seen.where((F.col("k") == 1) & (F.col("t") - F.col("before") <= longest)).select(*keys, F.col("before").alias("lo"), F.col("t").alias("hi"))
