"""Parent-child rows to rooted trees: path, depth, root, subtree size and descendants, with cycles told apart.

1. Doubling finds for each node its root, depth and subtree size in one loop: after k rounds a node knows what lies
   within 2**k steps above and below it. Depths have no holes, so the first round in which no node reaches its root
   proves that the nodes left are on or below cycles; they are separated.
2. Heavy-path decomposition: each node's heavy child is the one with the largest subtree. Nodes joined by heavy links
   form chains; a path from any node to its root passes at most log2(n) chains.
3. The names along each chain are joined up by doubling over heavy links, and the pieces of the chains above by
   doubling over the links between chains.

Each round is an equi-join on (tree, node) and a pre-aggregated sum; nothing is collected, and rounds grow with the
logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrybed.session import release, stored, stored_counting

ROUNDS = 40  # 2**40 levels


def _rooted(edges: DataFrame) -> DataFrame:
    """``t, v, top, l, s, tree``: the root, depth and subtree size of each node; ``tree`` is false on or below cycles."""
    state = edges.select("t", "v", F.coalesce("p", "v").alias("top"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("bigint").alias("l"), F.lit(1).cast("bigint").alias("s"))
    (state, now), left = stored_counting(state, F.col("l") == 1), None
    for k in range(ROUNDS):
        step = 1 << k
        if now == 0 or now == left:
            break
        left = now
        active = state.where(F.col("l") == step)
        below = active.groupBy("t", F.col("top").alias("v")).agg(F.sum("s").alias("more"))
        jump = active.select("t", "v", "top").join(state.select("t", F.col("v").alias("top"), F.col("top").alias("top2"), F.col("l").alias("l2")), ["t", "top"]).select("t", "v", "top2", "l2")
        next_state = state.join(jump, ["t", "v"], "left").join(below, ["t", "v"], "left")
        done = state
        state, now = stored_counting(next_state.select("t", "v", F.coalesce("top2", "top").alias("top"), (F.col("l") + F.coalesce("l2", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")), F.col("l") == 2 * step)
        release(done)
    else:
        step = 1 << ROUNDS
    return state.withColumn("tree", F.col("l") < step)


def build_trees(edges: DataFrame, sep: str = "/") -> DataFrame:
    """Label each node of a forest. ``edges`` has ``t`` (tree space, BIGINT), ``v`` (node, STRING), ``p`` (its parent) and
    ``name``, one row per (t, v).

    Returns ``t, v, root, depth, path, chain, chain_pos, subtree`` per input row: the names below the root joined with
    ``sep``, the head of the node's heavy chain and its place in it, and the number of nodes in its subtree.

    Defined results: a parent without a row of its own is a root (it gets no row); a null parent or a parent equal to
    the node makes the node a root; a root has depth 0 and path ''; a null name counts as ''; nodes on or below a cycle
    have root '', depth -1, path '', chain '' , chain_pos -1 and subtree 0; rows with a null ``t`` or ``v`` have no
    place in a tree and are left out; an empty table gives an empty table; further columns are not read.
    """
    edges = edges.select(F.col("t").cast("bigint").alias("t"), F.col("v").cast("string").alias("v"), F.when(F.col("p") != F.col("v"), F.col("p")).cast("string").alias("p"), F.coalesce("name", F.lit("")).alias("name")).where("t is not null and v is not null")
    edges = stored(edges)
    # Roots without rows join as nodes of their own.
    missing = edges.where("p is not null").select("t", F.col("p").alias("v")).distinct().join(edges.select("t", "v"), ["t", "v"], "left_anti")
    nodes = edges.select("t", "v", "p").unionByName(missing.withColumn("p", F.lit(None).cast("string")))
    rooted = _rooted(nodes)
    trees = rooted.where("tree").join(edges, ["t", "v"], "left").select("t", "v", "top", "l", "s", "p", F.coalesce("name", F.lit("")).alias("name"))
    heavy = trees.where("p is not null").groupBy("t", "p").agg(F.max_by("v", F.struct("s", "v")).alias("v")).select("t", "v", F.lit(True).alias("heavy"))
    trees = stored(trees.join(heavy, ["t", "v"], "left").select("t", "v", "top", "l", "s", "p", F.coalesce("heavy", F.lit(False)).alias("heavy"), F.when(F.col("p").isNull(), "").otherwise(F.concat(F.lit(sep), "name")).alias("name")))
    # Chains: head, place and the names from the head down, by doubling over heavy links.
    chain = trees.select("t", "v", F.when(F.col("heavy"), F.col("p")).otherwise(F.col("v")).alias("head"), F.col("heavy").cast("bigint").alias("pos"), F.when(F.col("heavy"), F.col("name")).otherwise("").alias("seg"))
    chain = _compose(chain, "head", "pos", "seg")
    # Links between chains: the head's parent lies on the chain above. Names: those of that chain, then the head's own.
    heads = trees.where("not heavy").select("t", "v", "p", "name")
    above = chain.select("t", F.col("v").alias("p"), F.col("head").alias("up"), F.col("seg").alias("above"))
    links = heads.join(above, ["t", "p"], "left").select("t", "v", F.coalesce("up", "v").alias("up"), F.col("up").isNotNull().cast("bigint").alias("hops"), F.concat(F.coalesce("above", F.lit("")), "name").alias("seg"))
    links = _compose(links, "up", "hops", "seg")
    full = chain.join(links.select("t", F.col("v").alias("head"), F.col("seg").alias("before")), ["t", "head"]).select("t", "v", "head", "pos", F.concat("before", "seg").alias("path"))
    skip = len(sep) + 1
    labelled = full.join(trees.select("t", "v", "top", "l", "s"), ["t", "v"]).select("t", "v", F.col("top").alias("root"), F.col("l").alias("depth"), F.expr(f"substring(path, {skip})").alias("path"), F.col("head").alias("chain"), F.col("pos").alias("chain_pos"), F.col("s").alias("subtree"))
    out = edges.select("t", "v").join(labelled, ["t", "v"], "left")
    blank = F.lit("")
    return out.select("t", "v", F.coalesce("root", blank).alias("root"), F.coalesce("depth", F.lit(-1)).cast("bigint").alias("depth"), F.coalesce("path", blank).alias("path"), F.coalesce("chain", blank).alias("chain"), F.coalesce("chain_pos", F.lit(-1)).cast("bigint").alias("chain_pos"), F.coalesce("subtree", F.lit(0)).cast("bigint").alias("subtree"))


def _compose(state: DataFrame, to: str, steps: str, text: str) -> DataFrame:
    """Doubling over links: each row of ``t, v`` follows ``to`` to the end, texts joined upper first."""
    state, now = stored_counting(state, F.col(steps) == 1)
    for k in range(ROUNDS):
        if not now:
            return state
        active = state.where(F.col(steps) == (1 << k))
        # rows that already stand at an end are no targets worth joining
        upper = state.where(F.col(steps) > 0).select("t", F.col("v").alias(to), F.col(to).alias("to2"), F.col(steps).alias("n2"), F.col(text).alias("text2"))
        more = active.select("t", "v", to).join(upper, ["t", to]).select("t", "v", "to2", "n2", "text2")
        done = state
        further = state.join(more, ["t", "v"], "left").select("t", "v", F.coalesce("to2", to).alias(to), (F.col(steps) + F.coalesce("n2", F.lit(0))).alias(steps), F.concat(F.coalesce("text2", F.lit("")), text).alias(text))
        state, now = stored_counting(further, F.col(steps) == (2 << k))
        release(done)
    return state


def ancestor_spans(trees: DataFrame, edges: DataFrame) -> DataFrame:
    """``t, v, depth, chain, upto``: the ancestors of each node, itself among them, as places 0 to ``upto`` of chains.

    A path upward passes at most log2(n) chains, so there are few rows per node however deep it lies: a result of linear size
    that says all that the pairs say. ``trees`` is the result of ``build_trees``, ``edges`` its input.
    """
    nodes = trees.where("depth >= 0").select("t", "v", "chain", "chain_pos", "depth")
    parent = edges.select("t", "v", F.when(F.col("p") != F.col("v"), F.col("p")).alias("p"))
    # one hop between chains per round, at most log2(n) rounds
    hops = nodes.where("chain = v").join(parent, ["t", "v"]).select("t", F.col("v").alias("chain"), "p")
    place = nodes.select("t", F.col("v").alias("p"), F.col("chain").alias("chain2"), F.col("chain_pos").alias("pos2"))
    hops = stored(hops.join(place, ["t", "p"]).select("t", "chain", "chain2", "pos2"))
    now = nodes.select("t", "v", "depth", "chain", F.col("chain_pos").alias("upto"))
    parts = [now]
    for _ in range(ROUNDS):
        now = now.join(hops, ["t", "chain"]).select("t", "v", "depth", F.col("chain2").alias("chain"), F.col("pos2").alias("upto"))
        now, more = stored_counting(now, F.lit(True))
        if not more:
            break
        parts.append(now)
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    return spans


def descendants(trees: DataFrame, edges: DataFrame) -> DataFrame:
    """All pairs ``t, ancestor, descendant`` with ``distance`` >= 1, for nodes that have rows: the join of ``ancestor_spans``
    with the places of the chains. As many rows as there are pairs, which grows with the depth; ``ancestor_spans`` does not.
    Each pair comes once; nodes on or below cycles have none.
    """
    nodes = trees.where("depth >= 0").select("t", "v", "chain", "chain_pos", "depth")
    spans = ancestor_spans(trees, edges)
    points = spans.select("t", "v", "depth", "chain", F.explode(F.sequence(F.lit(0).cast("bigint"), "upto")).alias("chain_pos"))
    upper = nodes.select("t", "chain", "chain_pos", F.col("v").alias("ancestor"), F.col("depth").alias("d2"))
    return points.join(upper, ["t", "chain", "chain_pos"]).where("ancestor <> v").select("t", "ancestor", F.col("v").alias("descendant"), (F.col("depth") - F.col("d2")).alias("distance"))
