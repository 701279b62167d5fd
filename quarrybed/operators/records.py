"""Relational operators over record tables: latest of a group, coverage, chains, first-wins, bounded samples, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_group(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row of each group with the greatest order value, by a partial aggregate instead of a sort of the group.

    Rows with equal order fall to the greatest remaining values, so the result does not depend on partitioning.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[Column], order: list[Column | str]) -> DataFrame:
    """One row per key: the one first in order. Keys may be expressions (folded text); a null key is a key."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    cols = df.columns
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("__row")
    return df.select("*", *named).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(best).select(*[F.col(f"__row.{c}").alias(c) for c in cols])


def bounded_sample(df: DataFrame, keys: list[str], value: str, order: str, keep: int = 32) -> DataFrame:
    """The first ``keep`` values of each group in order, how many there are, and how many were left out."""
    w = Window.partitionBy(*keys).orderBy(order, value)
    top = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias("sample"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("total"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return counts.alias("c").join(top.alias("t"), same, "left").select(*[F.col(f"c.{k}").alias(k) for k in keys], "sample", "total", F.greatest(F.col("total") - keep, F.lit(0)).alias("omitted"))


def ordered_chain(df: DataFrame, keys: list[str], value: str, order: str, keep: int | None = None) -> DataFrame:
    """First ``keep`` values, or all, in order (equal order falls to the value), first and last value, total and omitted count of each group."""
    pair = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    ends = [F.min_by(value, F.struct(order, value)).alias("first_value"), F.max_by(value, F.struct(order, value)).alias("last_value"), F.count("*").alias("total")]
    values = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x.v).alias("chain")
    if keep is None:
        return df.groupBy(*keys).agg(values, *ends).select(*keys, "chain", "first_value", "last_value", "total", F.lit(0).cast("bigint").alias("omitted"))
    # the limit of rows per group also acts before the shuffle, so a group of any size leaves few rows
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order, value))).where(F.col("__n") <= keep).groupBy(*keys).agg(values)
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    g = df.groupBy(*keys).agg(*ends).alias("g").join(first.alias("c"), same, "left")
    return g.select(*[F.col(f"g.{k}").alias(k) for k in keys], "chain", "first_value", "last_value", "total", F.greatest(F.col("total") - keep, F.lit(0)).alias("omitted"))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """One page in key order after a cursor, with one row more than ``size`` to tell whether there is a next page.

    The leading key also goes into a plain comparison that reaches the scan.
    """
    if after is not None:
        lead = F.col(order[0]) >= F.lit(after[0])
        df = df.where(lead & (F.struct(*order) > F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after)])))
    return df.orderBy(*order).limit(size + 1) if size else df.orderBy(*order)


#: Bits between two sizes of block, and the bits of the largest.
_STEP, _TOP = 4, 56


def _blocks(start: str, end: str) -> Column:
    """The aligned blocks that [start, end) is made of, as STRUCT<level, block>: at most thirty of each size, so their number
    grows with the logarithm of the interval's length."""
    a, b = f"shiftright({start} + shiftleft(1L, l) - 1L, l)", f"shiftright({end}, l)"
    # the same in blocks of the next size, back in this one
    a2, b2 = (f"shiftleft(shiftright({x}, l + {_STEP}), {_STEP})" for x in (f"{start} + shiftleft(1L, l + {_STEP}) - 1L", end))
    whole = f"(l = {_TOP} or {a2} >= {b2})"
    run = lambda lo, hi: f"transform(if({lo} < {hi}, sequence({lo}, {hi} - 1L), array()), x -> struct(l as level, x as block))"
    return F.expr(f"flatten(transform(sequence(0, {_TOP}, {_STEP}), l -> concat({run(a, f'if({whole}, {b}, least({b}, {a2}))')}, {run(f'greatest({a}, {b2})', f'if({whole}, {a}, {b})')})))")


def interval_of(points: DataFrame, at: str, intervals: DataFrame, start: str, size: str, rank: str) -> DataFrame:
    """Left range join: each point with the interval of least ``rank`` among the half-open ones [start, start + size) that
    hold it; the columns of ``intervals`` are null where none does.

    Intervals are cut into aligned blocks of sixteen-fold sizes and points ask for the blocks they lie in, of those sizes
    that occur (fifteen at most), so the join is an equality whose hits are all true. A null point lies in none;
    intervals with a null or no positive size hold none; repeated points stay apart; the frames share no column name.
    """
    spans = intervals.where(F.col(size) > 0).withColumns({"__s": F.col(start).cast("bigint"), "__e": (F.col(start) + F.col(size)).cast("bigint")})
    cells = spans.withColumn("__block", F.explode(_blocks("__s", "__e"))).drop("__s", "__e")
    levels = sorted(r[0] for r in cells.select("__block.level").distinct().collect())
    p = points.withColumn("__id", F.monotonically_increasing_id())
    keys = F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright(F.col(at).cast("bigint"), l).alias("block")) for l in levels]) if levels else F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("block")))
    asked = p.withColumn("__block", F.explode(keys))
    hit = asked.join(cells, "__block", "left")
    keep, extra = points.columns, intervals.columns
    got = hit.groupBy("__id").agg(F.first(F.struct(*keep)).alias("p"), F.min_by(F.struct(*extra), rank).alias("i"))
    return got.select(*[F.col(f"p.{c}").alias(c) for c in keep], *[F.col(f"i.{c}").alias(c) for c in extra])


def offset_page(df: DataFrame, order: list[Column | str], offset: int, size: int | None) -> DataFrame:
    """One page by position: ``size`` rows after the first ``offset``; 0 or None means all that follow."""
    page = df.orderBy(*order).offset(offset)
    return page.limit(size) if size else page


def by_filled(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in falling order of columns whose nulls count as 0."""
    return df.orderBy(*[F.coalesce(F.col(c), F.lit(0)).desc() for c in cols])


def remapped(staged: DataFrame, stage_key: str, mapping: DataFrame, old: str, new: str, out: str) -> DataFrame:
    """Staged rows with the ids under which their sources were stored; rows whose source was not stored are left out.

    ``mapping`` holds ``old`` and ``new`` ids; of several new ids of one old id the greatest counts.
    """
    to = mapping.groupBy(F.col(old).alias("__old")).agg(F.max(new).alias("__new"))
    return staged.join(to, F.col(stage_key) == F.col("__old")).withColumn(out, F.col("__new")).drop("__old", "__new")


def bounded_listing(df: DataFrame, keys: list[str], order: list[Column | str], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group with their place, how many rows the group has and how many were left out.

    The limit acts before the shuffle, counts are pre-aggregated; a null key is a group.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = df.withColumn("place", n).where(F.col("place") <= keep)
    counts = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return top.join(counts, same).drop(*[f"__{k}" for k in keys]).withColumn("place", F.col("place").cast("bigint")).withColumn("omitted", F.greatest(F.col("total") - keep, F.lit(0)))


def outcome_counts(df: DataFrame, keys: list[Column | str], status: Column, source: Column, statuses: tuple[str, ...]) -> DataFrame:
    """Per key: ``candidates``, one counter per status (rows of that status) and the number of different ``sources``."""
    return df.groupBy(*keys).agg(F.count("*").alias("candidates"), *[F.count_if(status == s).alias(s) for s in statuses], F.countDistinct(source).alias("sources"))


def snapshot(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows there are, the greatest key, and how many different keys. What comes later lies above."""
    return df.agg(F.count("*").alias("candidates"), F.max(key).alias("high_water"), F.countDistinct(key).alias("different"))


def up_to(df: DataFrame, key: str, after: int | None, high_water: int) -> DataFrame:
    """The rows of a snapshot after a key: ``after`` excluded, the mark included."""
    return df.where((F.col(key) <= high_water) & (F.lit(True) if after is None else F.col(key) > after))


def dictionary_join(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, out: str, fallback: str = "ID #%d") -> DataFrame:
    """Ids to names; an id the dictionary lacks reads ``ID #n``. Spark chooses the join by the sizes it measures."""
    d = names.select(F.col(name_key).alias("__k"), F.col(name).alias("__v"))
    return df.join(d, F.col(key) == F.col("__k"), "left").withColumn(out, F.coalesce(F.col("__v"), F.format_string(fallback, F.col(key)))).drop("__k", "__v")


def pair_assembly(df: DataFrame, key: str, kind: str, value: str, first: str, second: str) -> DataFrame:
    """Two kinds of values of one key put beside each other where both exist."""
    g = df.where(F.col(kind).isin(first, second)).groupBy(key).agg(F.max(F.when(F.col(kind) == first, F.col(value))).alias("first_value"), F.max(F.when(F.col(kind) == second, F.col(value))).alias("second_value"))
    return g.where("first_value is not null and second_value is not null")


def rolling_rate(df: DataFrame, keys: list[str], seconds: str, amount: str, span: int = 10, least: int = 3) -> DataFrame:
    """Units per second over the last ``span`` seconds; null below ``least`` samples or one second."""
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span, 0)
    n, t0, a0 = F.count("*").over(w), F.min(seconds).over(w), F.first(amount).over(w)
    return df.withColumn("rate", F.when((n >= least) & (F.col(seconds) - t0 >= 1), (F.col(amount) - a0) / (F.col(seconds) - t0)))
