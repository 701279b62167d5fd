"""Runs of consecutive identical or near-identical events per entity, collapsed to one row each.

Rows are range-partitioned and sorted by entity and order, so an entity of any size is spread over as many
partitions as it needs. A state machine streams through each partition holding only the open run: its anchor
(the state all its events share) and the instant of its latest event. Runs that lie inside a partition are
emitted when they end; the two runs at the edges of a partition go on as fragments and are stitched afterwards,
at most two of them per partition.

``collapse_similar`` lets the events of a run differ from its anchor. Equal neighbours are collapsed first, as above; a
second state machine then compares each of these stretches with the anchor of the open run. Whether a stretch belongs to a
run depends on where the run began, so each partition must know the run that is open when it begins: partitions hand on
their last one, round by round, until none of them changes. A changed anchor is forgotten at the next break, so two or three
rounds are usual.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrybed.session import stored

_NONE = np.int64(-(2**63))


def _machine(n_keys: int, max_gap: int, least: int = 2):
    """The state machine over sorted Arrow batches of ``k0.. , o, s, t``; null is ``_NONE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"k{i}" for i in range(n_keys)), "s", "first_o", "last_o", "n", "first_t", "last_t", "lo_t", "hi_t", "at_start", "at_end"]
        carry: np.ndarray | None = None  # the open run, one row of the columns above
        last_row: np.ndarray | None = None
        started = False

        def pack(rows: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(rows[:, i], mask=rows[:, i] == _NONE) for i in range(rows.shape[1])]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            m = np.column_stack([c.fill_null(int(_NONE)).to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else None
            if m is None:
                continue
            # one record delivered twice has the same entity and order
            before = m[:-1] if last_row is None else np.vstack([last_row, m[:-1]])
            same = (m[-len(before):, : n_keys + 1] == before[:, : n_keys + 1]).all(axis=1)
            keep = np.concatenate([[True] * (len(m) - len(before)), ~same]).astype(bool)
            m = m[keep]
            if not len(m):
                continue
            prev = np.vstack([m[:1] if last_row is None else last_row, m[:-1]])
            last_row = m[-1:]
            k, s, t = slice(0, n_keys), m[:, n_keys + 1], m[:, n_keys + 2]
            pt, ps = prev[:, n_keys + 2], prev[:, n_keys + 1]
            both = (t != _NONE) & (pt != _NONE)
            gap = both & (np.abs(np.where(both, t, 0) - np.where(both, pt, 0)) > max_gap)
            breaks = (m[:, k] != prev[:, k]).any(axis=1) | (s != ps) | (s == _NONE) | gap
            if carry is None:
                breaks[0] = True
            at = np.flatnonzero(breaks)
            if not len(at) or at[0]:
                at = np.concatenate([[0], at])
            ends = np.concatenate([at[1:], [len(m)]])
            idx = np.arange(len(m))
            known = t != _NONE
            first = np.minimum.reduceat(np.where(known, idx, len(m)), at)
            last = np.maximum.reduceat(np.where(known, idx, -1), at)
            tt = np.append(t, _NONE)
            rows = np.column_stack([m[at][:, k], s[at], m[at, n_keys], m[ends - 1, n_keys], ends - at, tt[np.where(first < len(m), first, -1)], tt[last], t[at], t[ends - 1], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)])
            if carry is not None and not breaks[0]:
                r, c = rows[0], carry
                r[n_keys + 1], r[n_keys + 3] = c[n_keys + 1], r[n_keys + 3] + c[n_keys + 3]
                r[n_keys + 4] = c[n_keys + 4] if c[n_keys + 4] != _NONE else r[n_keys + 4]
                r[n_keys + 5] = r[n_keys + 5] if r[n_keys + 5] != _NONE else c[n_keys + 5]
                r[n_keys + 6], r[-2] = c[n_keys + 6], c[-2]
            elif carry is not None:
                rows = np.vstack([carry, rows])
            if not started:
                rows[0, -2], started = 1, True
            carry, done = rows[-1].copy(), rows[:-1]
            if least > 1:  # single events at an edge may be part of a run
                done = done[(done[:, n_keys + 3] > 1) | (done[:, -2] == 1)]
            if len(done):
                yield pack(done)
        if carry is not None:
            carry[-1] = 1
            yield pack(carry.reshape(1, -1))

    return run


def collapse_runs(df: DataFrame, entity: list[Column], order: Column, state: Column, ticks: Column, max_gap: int, least: int = 2) -> DataFrame:
    """Collapse each longest run of neighbouring events with equal state into one row.

    ``entity``, ``order``, ``state`` and ``ticks`` are BIGINT expressions over ``df``. Neighbours (in the order of
    ``order`` within an entity) stay in one run while their states are equal and, if both have ``ticks``, these
    differ by at most ``max_gap`` in either direction. Returns ``k0..kn, state, first_order, last_order,
    event_count, first_ticks, last_ticks``: the ticks are those of the first and the last event that has any,
    else null. ``least`` is the smallest run returned.

    Defined results: rows with the same entity and order are one record (repeated deliveries); rows whose
    order or one of whose entity parts is null have no place in any sequence and form no run; a null state equals
    no other; a null tick neither breaks nor lengthens a run; an empty table gives an empty table; other columns
    of ``df`` are not read, whatever their names.
    """
    return _collapsed(df, entity, order, state, ticks, max_gap, least).drop("lo_t", "hi_t")


def _collapsed(df: DataFrame, entity: list[Column], order: Column, state: Column, ticks: Column, max_gap: int, least: int) -> DataFrame:
    """``collapse_runs`` with ``lo_t, hi_t``: the ticks of the first and the last event, null where these have none."""
    n = len(entity)
    keys = [f"k{i}" for i in range(n)]
    rows = df.select(*[c.cast("bigint").alias(k) for c, k in zip(entity, keys)], order.cast("bigint").alias("o"), state.cast("bigint").alias("s"), ticks.cast("bigint").alias("t")).where(" and ".join(f"{c} is not null" for c in [*keys, "o"]))
    rows = rows.repartitionByRange(*keys, "o").sortWithinPartitions(*keys, "o")
    schema = ", ".join(f"{c} bigint" for c in [*keys, "s", "first_o", "last_o", "n", "first_t", "last_t", "lo_t", "hi_t", "at_start", "at_end"])
    runs = rows.mapInArrow(_machine(n, max_gap, least), schema)
    # Whole runs stand alone; only fragments of one entity share a window, two per partition at most.
    edge = (F.col("at_start") == 1) | (F.col("at_end") == 1)
    part = [*keys, "alone"]
    w = Window.partitionBy(*part).orderBy("first_o")
    joined = (F.lag("at_end").over(w) == 1) & (F.col("at_start") == 1) & F.lag("s").over(w).eqNullSafe(F.col("s")) & F.col("s").isNotNull()
    near = F.coalesce(F.abs(F.col("lo_t") - F.lag("hi_t").over(w)) <= max_gap, F.lit(True))
    runs = runs.withColumn("alone", F.when(~edge, F.col("first_o"))).withColumn("new", F.when(F.coalesce(joined & near, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("g", F.sum("new").over(w))
    out = runs.groupBy(*part, "g").agg(F.min("s").alias("state"), F.min("first_o").alias("first_order"), F.max("last_o").alias("last_order"), F.sum("n").alias("event_count"), F.min_by("first_t", F.when(F.col("first_t").isNotNull(), F.col("first_o"))).alias("first_ticks"), F.max_by("last_t", F.when(F.col("last_t").isNotNull(), F.col("first_o"))).alias("last_ticks"), F.min_by("lo_t", "first_o").alias("lo_t"), F.max_by("hi_t", "first_o").alias("hi_t"))
    return out.where(F.col("event_count") >= least).select(*keys, "state", "first_order", "last_order", "event_count", "first_ticks", "last_ticks", "lo_t", "hi_t")


class _Open:
    """The run open at some point: entity, anchor (state and order of its first event) and the tick of its latest event."""

    def __init__(self, key: tuple | None = None, anchor: int | None = None, first: int | None = None, tick: int | None = None):
        self.key, self.anchor, self.first, self.tick = key, anchor, first, tick

    def takes(self, key: tuple, state: int | None, tick: int | None, max_gap: int, max_bits: int) -> bool:
        near = tick is None or self.tick is None or abs(tick - self.tick) <= max_gap
        return self.key == key and near and state is not None and self.anchor is not None and (state ^ self.anchor).bit_count() <= max_bits

    def values(self) -> tuple:
        return self.key, self.anchor, self.first, self.tick


def _similar(n_keys: int, max_gap: int, max_bits: int, before: dict[int, tuple], edges: bool):
    """The machine over stretches of ``part, k0.., state, first_order, lo_t, hi_t``: the anchor's order for each stretch, or
    with ``edges`` only the run that is open at the end of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out = None, _Open(), []
        for batch in batches:
            firsts, anchors = [], []
            for pid, *key, state, first, lo, hi in zip(*[c.to_pylist() for c in batch.columns]):
                if pid != part:
                    if part is not None:
                        out.append((part, now.values()))
                    part, now = pid, _Open(*before.get(pid, ()))
                key = tuple(key)
                if not now.takes(key, state, lo, max_gap, max_bits):
                    now = _Open(key, state, first)
                now.tick = hi
                firsts.append(now.first)
                anchors.append(now.anchor)
            if not edges:
                yield pa.RecordBatch.from_arrays([*batch.columns[1 : n_keys + 1], batch.column(n_keys + 2), pa.array(firsts, pa.int64()), pa.array(anchors, pa.int64())], [*(f"k{i}" for i in range(n_keys)), "first_order", "run", "anchor"])
        if edges:
            if part is not None:
                out.append((part, now.values()))
            rows = [(pid, *key, anchor, first, tick) for pid, (key, anchor, first, tick) in out]
            names = ["part", *(f"k{i}" for i in range(n_keys)), "anchor", "first", "tick"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

    return run


def collapse_similar(df: DataFrame, entity: list[Column], order: Column, state: Column, ticks: Column, max_gap: int, max_bits: int, least: int = 2) -> DataFrame:
    """Runs whose events differ from the run's first one, the anchor, in at most ``max_bits`` bits of ``state``.

    Each event is compared with the anchor and not with the one before it, so a run cannot drift. Otherwise as for
    ``collapse_runs``, and the same with ``max_bits`` 0; ``state`` is the anchor's. The same values are null or repeated with the
    same results. The driver holds one row per partition, nothing else.
    """
    n = len(entity)
    keys = [f"k{i}" for i in range(n)]
    exact = _collapsed(df, entity, order, state, ticks, max_gap, 1)
    exact = stored(exact.repartitionByRange(*keys, "first_order").withColumn("part", F.spark_partition_id().cast("bigint")))
    rows = exact.select("part", *keys, "state", "first_order", "lo_t", "hi_t").repartition("part").sortWithinPartitions("part", *keys, "first_order")
    schema = ", ".join(f"{c} bigint" for c in ["part", *keys, "anchor", "first", "tick"])
    before: dict[int, tuple] = {}
    while True:
        ends = sorted((tuple(r) for r in rows.mapInArrow(_similar(n, max_gap, max_bits, before, True), schema).collect()), key=lambda r: r[0])
        handed = {b[0]: (a[1 : n + 1], *a[n + 1 :]) for a, b in zip(ends, ends[1:])}
        if handed == before:
            break
        before = handed
    found = rows.mapInArrow(_similar(n, max_gap, max_bits, before, False), ", ".join(f"{c} bigint" for c in [*keys, "first_order", "run", "anchor"]))
    # stretches of one run share its first order; the join key is unique, the sums are pre-aggregated
    joined = exact.join(found, [*keys, "first_order"])
    runs = joined.groupBy(*keys, "run").agg(F.min("anchor").alias("state"), F.max("last_order").alias("last_order"), F.sum("event_count").alias("event_count"), F.min_by("first_ticks", F.when(F.col("first_ticks").isNotNull(), F.col("first_order"))).alias("first_ticks"), F.max_by("last_ticks", F.when(F.col("last_ticks").isNotNull(), F.col("first_order"))).alias("last_ticks"))
    return runs.where(F.col("event_count") >= least).select(*keys, "state", F.col("run").alias("first_order"), "last_order", "event_count", "first_ticks", "last_ticks")
