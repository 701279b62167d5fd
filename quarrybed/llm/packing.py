"""Texts put whole into containers of fixed capacity with little unused space.

Sum-of-squares online packing: a level array counts the open containers at each fill; each text goes to the level whose
change lowers the sum of squared counts most, so no fill level piles up. Texts are spread by hash over shards that hold
a set number of containers' worth of tokens or a set number of texts, and each shard is packed on its own, in one pass in
the order of a seeded hash; shards grow in number, not in size, so the longest task stops growing there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers' worth of tokens in a shard, and most items in it.
SHARD_CONTAINERS, SHARD_ITEMS = 2_000, 50_000

_SCHEMA = "container_kind string, capacity_tokens bigint, separator_tokens bigint, shard bigint, bin bigint, slot bigint, doc_id bigint, part_no bigint, first_token bigint, n_tokens bigint"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, in the order given. Sizes lie between 0 and ``capacity``.

    Of the levels that have room, the one with the least change of the sum of squared counts is taken (an emptied or a
    completed level counts 0), the fullest among equals; a new container is level 0. Items of size 0 go to container 0.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    out = np.zeros(len(sizes), np.int64)
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            bins = max(bins, 1)
            if bins == 1 and not stacks and not i:
                continue
            out[i] = 0
            continue
        room = capacity - s
        open_ = np.flatnonzero(count[1 : room + 1]) + 1
        best, level = (1 if s == capacity else 2 * int(count[s]) + 1), 0
        if len(open_):
            change = 2 * count[open_ + s] - 2 * count[open_] + 2
            if open_[-1] == room:
                change[-1] = 1 - 2 * int(count[room])
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                best, level = int(change[k]), int(open_[k])
        if level:
            b = stacks[level].pop()
            count[level] -= 1
        else:
            b = bins
            bins += 1
        out[i] = b
        if level + s < capacity:
            count[level + s] += 1
            stacks.setdefault(level + s, []).append(b)
    return out


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "doc_id", "part_no"], kind="stable")
    sep = int(pdf["separator_tokens"].iloc[0])
    cap = int(pdf["capacity_tokens"].iloc[0])
    # every item brings one separator and the container has room for one more than it needs
    pdf["bin"] = sum_of_squares(pdf["n_tokens"].to_numpy() + sep, cap + sep)
    pdf["slot"] = pdf.groupby("bin").cumcount()
    return pdf[["container_kind", "capacity_tokens", "separator_tokens", "shard", "bin", "slot", "doc_id", "part_no", "first_token", "n_tokens"]]


def pack(sizes: DataFrame, specs: list[tuple[str, int, int]], seed: int = 11) -> DataFrame:
    """Pack every text of ``sizes`` (``doc_id``, ``n_tokens``) into containers of each kind of ``specs`` (kind, capacity,
    separator tokens between two items of one container).

    Returns ``container_kind, container_id, slot, doc_id, part_no, first_token, n_tokens``: one row per text and kind, more
    only for a text above the capacity, which is cut into full containers and a rest that is packed like other items.

    Defined results: texts of 0 tokens are packed too (they need room for a separator at most); null sizes count as 0; a
    null id is an item like any other; repeated rows are items of their own; kinds with a null or non-positive capacity
    have no containers; an empty table gives an empty table; other columns are not read.
    """
    good = [(k, int(c), int(s or 0)) for k, c, s in specs if k is not None and c is not None and c > 0]
    sizes = sizes.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    total, rows = sizes.agg(F.sum("n"), F.count("*")).first()
    shards = {k: max(1, -(-int(total or 0) // (c * SHARD_CONTAINERS)), -(-2 * int(rows) // SHARD_ITEMS)) for k, c, s in good}
    kinds = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens"), F.lit(s).cast("bigint").alias("separator_tokens"), F.lit(shards[k]).cast("bigint").alias("shards")) for k, c, s in good])
    items = sizes.select("doc_id", "n", F.inline(kinds)) if good else sizes.select("doc_id", "n", F.lit("").alias("container_kind"), F.lit(1).cast("bigint").alias("capacity_tokens"), F.lit(0).cast("bigint").alias("separator_tokens"), F.lit(1).cast("bigint").alias("shards")).where("false")
    items = items.withColumn("whole", F.expr("n div capacity_tokens")).withColumn("rest", F.expr("n % capacity_tokens"))
    full = items.where("whole > 0").select("container_kind", "capacity_tokens", "doc_id", F.explode(F.expr("sequence(0L, whole - 1)")).alias("part_no"))
    full = full.select("container_kind", F.concat_ws("/", F.lit("full"), "doc_id", "part_no").alias("container_id"), F.lit(0).cast("bigint").alias("slot"), "doc_id", "part_no", (F.col("part_no") * F.col("capacity_tokens")).alias("first_token"), F.col("capacity_tokens").alias("n_tokens"))
    loose = items.where("rest > 0 or whole = 0").select("container_kind", "capacity_tokens", "separator_tokens", "doc_id", F.col("whole").alias("part_no"), (F.col("whole") * F.col("capacity_tokens")).alias("first_token"), F.col("rest").alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id").alias("h"), "shards")
    loose = loose.withColumn("shard", F.pmod(F.col("h"), F.col("shards"))).drop("shards")
    packed = loose.groupBy("container_kind", "shard").applyInPandas(_pack_group, _SCHEMA)
    placed = packed.select("container_kind", F.concat_ws("/", F.lit("a"), "shard", "bin").alias("container_id"), "slot", "doc_id", "part_no", "first_token", "n_tokens")
    return placed.unionByName(full)


def fill_report(packed: DataFrame, specs: list[tuple[str, int, int]]) -> DataFrame:
    """Per kind: containers, items, tokens, the share of the room used and the fewest containers there could be."""
    caps = F.create_map(*[F.lit(x) for k, c, s in specs for x in (k, int(c))])
    sums = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"))
    cap = caps[F.col("container_kind")]
    return sums.select("container_kind", "containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("fill_share"), F.ceil(F.col("tokens") / cap).alias("least_containers"))


def violations(packed: DataFrame, sizes: DataFrame, specs: list[tuple[str, int, int]]) -> DataFrame:
    """Per kind: texts packed, containers over their capacity, tokens lost or added, places taken twice, and texts cut that
    would have fit. All but the first are 0 for a packing."""
    caps, seps = (F.create_map(*[F.lit(x) for k, *v in specs for x in (k, int(v[i] or 0))])[F.col("container_kind")] for i in (0, 1))
    bins = packed.groupBy("container_kind", "container_id").agg((F.sum("n_tokens") + (F.count("*") - 1) * F.first(seps)).alias("used"), (F.count("*") - F.countDistinct("slot")).alias("twice"))
    by_bin = bins.groupBy("container_kind").agg(F.count_if(F.col("used") > caps).alias("overfull"), F.sum("twice").alias("slots_taken_twice"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts")).join(sizes.select("doc_id", "n_tokens"), "doc_id")
    by_text = texts.groupBy("container_kind").agg(F.count("*").alias("documents"), F.sum(F.abs(F.col("t") - F.col("n_tokens"))).alias("tokens_off"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= caps)).alias("cut_in_vain"))
    return by_text.join(by_bin, "container_kind")
