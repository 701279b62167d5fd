"""Sources combined to target weights of the total size, small ones repeated up to a cap.

Capped water-filling settles how many tokens each source gives: a source that would need more repetitions than allowed is
clamped at its cap and what it lacks is spread over the others in proportion, until all fit. A share of r repetitions is
floor(r) whole ones and a seeded part of the documents once more, cut where their tokens reach the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets per level, and levels: documents are summed one by one only in a part of BUCKETS ** LEVELS of a source.
BUCKETS, LEVELS = 512, 2


def exact_total(tokens: dict[str, int], targets: dict[str, float], caps: dict[str, int]) -> float:
    """The largest total at which every source reaches its target share within its cap. Sources that can give nothing have no
    say: their weight goes to the others."""
    able = {s: tokens.get(s, 0) * max(0, caps.get(s, 0)) for s, w in targets.items() if w > 0}
    weight = sum(targets[s] for s, most in able.items() if most > 0)
    return min((most * weight / targets[s] for s, most in able.items() if most > 0), default=0.0)


def water_fill(tokens: dict[str, int], targets: dict[str, float], caps: dict[str, int], total: float) -> dict[str, float]:
    """Tokens of each source for a mixture of ``total`` tokens, or of as many as the caps allow.

    Sources without tokens, weight or allowed repetitions give none. Ends after at most one round per source.
    """
    most = {s: float(tokens.get(s, 0) * max(0, caps.get(s, 0))) for s in targets}
    given = {s: 0.0 for s in targets}
    free = {s for s, w in targets.items() if w > 0 and most[s] > 0}
    left = float(total)
    while free and left > 0:
        weight = sum(targets[s] for s in free)
        tight = {s for s in free if left * targets[s] / weight >= most[s]}
        if not tight:
            given |= {s: left * targets[s] / weight for s in free}
            break
        for s in tight:
            given[s] = most[s]
            left -= most[s]
        free -= tight
    return given


def plan_mix(sizes: DataFrame, specs: list[tuple[str, float, int]], total: float | None = None) -> list[tuple[str, int, float, int, float]]:
    """(source, its tokens, target, cap, tokens to give) per source of ``specs``, a small fixed list of (source, share, cap).

    Without ``total`` the mixture is the largest one that meets every target share exactly.
    """
    known = {r[0]: int(r[1] or 0) for r in sizes.groupBy("source").agg(F.sum("n_tokens")).where(F.col("source").isin([s for s, _, _ in specs])).collect()}
    targets = {s: float(w or 0) for s, w, _ in specs}
    caps = {s: int(c or 0) for s, _, c in specs}
    goal = exact_total(known, targets, caps) if total is None else total
    given = water_fill(known, targets, caps, goal)
    return [(s, known.get(s, 0), targets[s], caps[s], given[s]) for s in targets]


def mix(sizes: DataFrame, plan: list[tuple[str, int, float, int, float]], seed: int = 17) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` for every text of a planned source; texts not used have 0 repeats.

    ``sizes`` has ``doc_id, source, n_tokens``. Documents are taken in the order of a seeded hash. Token counts per hash
    bucket say in which bucket the fractional repetition ends, and in that one again counts per finer bucket; only inside
    the last one documents are summed one by one, so no source is gathered in one task. The share is met to within one
    document.

    Defined results: texts of unplanned or null sources are left out; null sizes count as 0, and texts of 0 tokens get the
    whole repetitions only; repeated rows are documents of their own; an empty table gives an empty table; repeats never
    exceed the cap; other columns are not read.
    """
    rows = [(s, int(g // t) if t else 0, int(round(g - (g // t) * t)) if t else 0, c) for s, t, _, c, g in plan]
    # the cap binds also where rounding would lead beyond it
    wanted = [(s, min(w, c), p if w < c else 0, c) for s, w, p, c in rows]
    docs = sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")).where(F.col("source").isin([r[0] for r in wanted]))
    whole = F.create_map(*[F.lit(x) for s, w, _, _ in wanted for x in (s, w)]) if wanted else F.create_map(F.lit(""), F.lit(0))
    cols = ["doc_id", "source", "n_tokens"]
    # tokens still wanted of each source: a constant at first, then what the buckets before leave
    left = docs.withColumn("rest", _of(wanted)).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    decided: list[DataFrame] = []
    group: list[str] = ["source"]
    for level in range(LEVELS):
        b = f"b{level}"
        left = left.withColumn(b, F.pmod(F.shiftrightunsigned("h", 9 * level), F.lit(BUCKETS)))
        w = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        sums = left.groupBy(*group, b).agg(F.sum("n_tokens").alias("t"), F.min("rest").alias("want")).withColumn("remains", F.col("want") - F.coalesce(F.sum("t").over(w), F.lit(0)))
        sums = sums.select(*group, b, F.col("remains").alias("rest"), F.when(F.col("remains") <= 0, "none").when(F.col("remains") >= F.col("t"), "all").otherwise("cut").alias("use"))
        # at most BUCKETS rows per source of a small fixed list: one bucket of a source at most goes on to the next level
        placed = left.drop("rest").join(F.broadcast(sums), [*group, b])
        decided.append(placed.where("use <> 'cut'").select(*cols, ((F.col("use") == "all") & (F.col("n_tokens") > 0)).cast("int").alias("more")))
        left = placed.where("use = 'cut'").drop("use")
        group.append(b)
    upto = F.sum("n_tokens").over(Window.partitionBy(*group).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = left.withColumn("upto", upto)
    out = last.select(*cols, ((F.col("n_tokens") > 0) & (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))).cast("int").alias("more"))
    for part in decided:
        out = out.unionByName(part)
    return out.select(*cols, (whole[F.col("source")] + F.col("more")).cast("bigint").alias("repeats"))


def _of(rows: list[tuple[str, int, int, int]]):
    """The tokens wanted of a row's source beyond whole repetitions."""
    part = F.create_map(*[F.lit(x) for s, _, p, _ in rows for x in (s, p)]) if rows else F.create_map(F.lit(""), F.lit(0))
    return part[F.col("source")].cast("bigint")


def share_report(mixed: DataFrame, plan: list[tuple[str, int, float, int, float]]) -> DataFrame:
    """Per planned source: documents used, most repeats, tokens, the share reached and its target."""
    target = F.create_map(*[F.lit(x) for s, _, t, _, _ in plan for x in (s, t)])
    cap = F.create_map(*[F.lit(x) for s, _, _, c, _ in plan for x in (s, c)])
    sums = mixed.groupBy("source").agg(F.sum((F.col("repeats") > 0).cast("bigint")).alias("documents_used"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    everything = Window.partitionBy()  # one row per source of a small fixed list
    return sums.select("source", "documents_used", "most_repeats", cap[F.col("source")].cast("bigint").alias("max_repeats"), "tokens", F.round(F.col("tokens") / F.sum("tokens").over(everything), 6).alias("share"), target[F.col("source")].alias("target_share"))
