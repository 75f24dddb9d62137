"""Connected and strongly connected components of edge tables, in rounds that follow the logarithm of long paths.

No component is gathered and no closure is formed: every round is a few joins over the
edges that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled

MAX_ROUNDS, SHORT = 10_000, 8


def connected(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes that ``pairs(a, b)`` join to others, in whichever direction; root is the least of them.

    Edges alternately move a node's larger neighbours and its smaller ones to the least
    of them (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). Rows
    with a null end and loops count for nothing.
    """
    edges = settled(pairs.select("a", "b").where("a <> b").distinct())
    if edges.isEmpty():
        return edges.toDF("node", "root")
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = settled(both.where("v > u").join(least, "u").select("v", "m").where("v <> m").distinct().toDF("u", "v"))
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        pointed = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = settled(pointed.select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            return after.toDF("node", "root")
        edges = after
    raise RuntimeError(f"Components did not settle in {MAX_ROUNDS} rounds.")


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without those at a node that nothing enters or nothing leaves, as far as one look shows them."""
    enters, leaves = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return settled(edges.join(enters, "src", "left_semi").join(leaves, "dst", "left_semi").select("src", "dst"))


def _bypassed(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame] | None:
    """``(edges left, gone(v, w, u))``: nodes ``v`` with one way out, to ``w``, taken out, their entries ``u`` led on to ``w``.

    A coin, tossed anew in each turn, decides which of two neighbours stays, so that on a path a
    fixed share goes at once. None if none goes.
    """
    single = edges.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("w"), F.count("*").alias("n")).where("n = 1").select("v", "w")
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
    # no two neighbours go together: who leads to a node of several ways out goes, of the others the coins choose, beside those who go already
    ends = single.join(single.select(F.col("v").alias("w")), "w", "left_anti").select("v", "w")
    rest = single.join(ends, "v", "left_anti")
    tossed = rest.where(coin(F.col("v")) & ~coin(F.col("w"))).join(ends.select(F.col("v").alias("w")), "w", "left_anti").select("v", "w")
    going = ends.union(tossed)
    gone = settled(going.join(edges, going["v"] == edges["dst"], "left").select("v", "w", F.col("src").alias("u")))
    if gone.isEmpty():
        return None
    taken = gone.select("v").distinct()
    kept = edges.join(taken, edges["src"] == taken["v"], "left_anti").join(taken, edges["dst"] == taken["v"], "left_anti")
    led = gone.where("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))
    return settled(kept.union(led).distinct()), gone


def _spread(start: DataFrame, edges: DataFrame, most: int) -> DataFrame | None:
    """``(node, mark)``: the least mark of ``start(node, mark)`` that reaches each node over ``edges``; a round joins only what has changed. None after ``most`` rounds."""
    known = fresh = settled(start)
    for _ in range(most):
        sent = fresh.join(edges, fresh["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("mark").alias("mark"))
        fresh = settled(sent.join(known.select("node", F.col("mark").alias("before")), "node", "left").where("before is null or mark < before").select("node", "mark"))
        if fresh.isEmpty():
            return known
        known = settled(known.join(fresh.select("node"), "node", "left_anti").union(fresh))
    return None


def strong(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges(src, dst)`` that lie on a cycle; root is the least node of their component.

    Nodes that nothing enters or leaves are trimmed. The least name that reaches a node
    colours it, and walking back from a name within its colour gives that name's component.
    Where names take over ``SHORT`` rounds to arrive, nodes with one way out (or in) are
    bypassed first, which shortens rings and chains by a share in each turn. Bypassed nodes come back in reverse: one belongs to the
    component that it leads to if something of that component leads to it.
    """
    told = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = told.where("src = dst").select(F.col("src").alias("node"))
    left, removed, found, turn, patience = settled(told.where("src <> dst")), [], [], 0, SHORT
    while not left.isEmpty():
        before = left.count()
        left = _trimmed(left)
        if left.count() < 0.75 * before:
            continue
        colour = _spread(left.select("src").union(left.select("dst")).distinct().toDF("node").withColumn("mark", F.col("node")), left, patience)
        component = None
        if colour is not None:
            at = lambda end: colour.select(F.col("node").alias(end), F.col("mark").alias(f"{end}_mark"))  # noqa: E731, B023
            inside = settled(left.join(at("src"), "src").join(at("dst"), "dst").where("src_mark = dst_mark").select("src", "dst", F.col("src_mark").alias("mark")))
            component = _spread(colour.where("node = mark"), _flip(inside), patience)
        if component is not None:
            found.append(settled(component.select("node", F.col("mark").alias("component"))))
            done = component.select("node")
            left = settled(inside.join(done, inside["src"] == done["node"], "left_anti").join(done, inside["dst"] == done["node"], "left_anti").select("src", "dst"))
            patience = SHORT
            continue
        patience = MAX_ROUNDS  # once nothing can be shortened any more
        before = 2 * left.count()
        while not left.isEmpty() and left.count() < 0.9 * before:
            before, turn = left.count(), turn + 1
            for turned in (False, True):
                step = _bypassed(_flip(left) if turned else left, 2 * turn + turned)
                if step:
                    left = _flip(step[0]) if turned else step[0]
                    removed.append(step[1])
    none = told.where("false").select(F.col("src").alias("node"), F.col("dst").alias("component"))
    known = settled(reduce(DataFrame.union, found, none))
    for gone in reversed(removed):
        named = lambda c, out: known.select(F.col("node").alias(c), F.col("component").alias(out))  # noqa: E731, B023
        rows = gone.where("u is not null").join(named("u", "cu"), "u", "left").join(named("w", "cw"), "w", "left")
        rows = rows.select("v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cw", "w").alias("cw")).where("cu = cw")
        back = rows.groupBy("v").agg(F.min("cw").alias("component")).select(F.col("v").alias("node"), "component")
        ends = back.select("component", F.col("component").alias("node")).distinct().select("node", "component")
        known = settled(known.union(back).union(ends.join(known, "node", "left_anti")).distinct())
    # a component's name is one of its nodes; those of one node are no cycle, unless it is a loop
    least = known.groupBy("component").agg(F.min("node").alias("root"), F.count("*").alias("n"))
    members = known.join(least, "component").where("n > 1").select("node", "root")
    alone = loops.join(members, "node", "left_anti").select("node", F.col("node").alias("root"))
    return settled(members.union(alone))
