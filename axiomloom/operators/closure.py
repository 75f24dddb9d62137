"""Recursive joins over edge tables ``(src, dst)``: closures, depths, classes of mutual reach, reductions, paths.

All of them are semi-naive: a round joins only rows that can lead to new ones. From given
starts, a round takes one step; between all nodes, it doubles the length of the paths
known. Edges are joined as they are: adaptive execution broadcasts a small hierarchy and
shuffles a large one. Each round's new rows are settled, so plans don't grow and an empty
round ends the loop; cycles end by the anti-join against what is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from .components import strong

MAX_ROUNDS, COMPACT = 10_000, 16


def _walk(edges: DataFrame, start: DataFrame, max_depth: int | None) -> DataFrame:
    """``(start, node, depth)``: everything reached from ``start(start, node, depth)``, at its least depth."""
    step = edges.select("src", "dst").distinct()
    known = fresh = settled(start)
    rounds = 0
    while max_depth is None or rounds < max_depth:
        new = fresh.join(step, fresh["node"] == step["src"]).select("start", F.col("dst").alias("node"), F.lit(rounds + 1).alias("depth")).distinct()
        new = settled(new.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        known, fresh, rounds = known.unionByName(new), new, rounds + 1
        if rounds == MAX_ROUNDS:
            raise RuntimeError(f"Paths of over {MAX_ROUNDS} steps: the closure is not complete.")
        if rounds % COMPACT == 0:  # so that a round reads few tables, however many came before it
            known = settled(known)
    return known


def _doubled(edges: DataFrame) -> DataFrame:
    """``(start, node, depth)`` between all nodes, in as many rounds as the longest shortest path has binary digits.

    With all pairs known up to ``reach`` steps, a shortest path of up to twice as many is one
    of exactly ``reach`` steps and a known one; so each new pair comes up about once.
    """
    known = settled(edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while True:
        edge = known.where(F.col("depth") == reach).select("start", F.col("node").alias("mid"))
        on = known.select(F.col("start").alias("mid"), "node", (F.col("depth") + reach).alias("depth"))
        new = edge.join(on, "mid").groupBy("start", "node").agg(F.min("depth").alias("depth"))
        new = settled(new.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        if new.isEmpty():
            return known
        known, reach = known.unionByName(new), 2 * reach


def closure(edges: DataFrame, seeds: DataFrame | None = None, include_start: bool = False, max_depth: int | None = None) -> DataFrame:
    """``(start, node, depth)`` of the transitive closure of ``edges``, from ``seeds(start)`` or from every source.

    A start that reaches itself over a cycle is listed with the length of the shortest
    cycle; with ``include_start`` each start is listed at depth 0 instead. Edges with a null
    end are ignored.
    """
    edges = edges.where("src is not null and dst is not null")
    starts = (edges.select(F.col("src").alias("start")) if seeds is None else seeds.select("start")).distinct()
    if include_start:
        return _walk(edges, starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), max_depth)
    if seeds is None and max_depth is None:
        return _doubled(edges)
    if max_depth is not None and max_depth < 1:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).limit(0)
    step = edges.distinct()
    first = step.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(0).alias("depth"))
    if seeds is not None:
        first = first.join(starts, "start", "left_semi")
    found = _walk(edges, first, None if max_depth is None else max_depth - 1)
    return found.withColumn("depth", F.col("depth") + 1)


def mutual(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for nodes on cycles: root is the least of all nodes that reach the node and are reached by it."""
    return strong(edges)


def equivalent_pairs(edges: DataFrame) -> DataFrame:
    """``(a, b)``, ``a <> b``: nodes that reach each other."""
    return _companions(strong(edges)).toDF("a", "b")


def _companions(roots: DataFrame) -> DataFrame:
    """``(node, other)``, ``node <> other``: nodes of one root."""
    return roots.join(roots.toDF("other", "root"), "root").where("node <> other").select("node", "other")


def condensed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges`` between the ``roots(node, root)`` of their ends, a node without one standing for itself; no loops."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    led = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    return led.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")).where("src <> dst").distinct()


def direct(edges: DataFrame, closed: bool = False) -> DataFrame:
    """``(src, dst)`` of the transitive reduction: strict superiors with no other strict superior between.

    Nodes that reach each other are equivalent: one stands for all while superiors are
    compared, and each for all in the result, where none is a superior of another. With
    ``closed``, ``edges`` are transitively closed already, as a reasoner's are.
    """
    told = settled(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if closed:
        both = told.where("src <> dst")
        both = both.join(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
        roots = settled(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("root")))
    else:
        roots = strong(told)
    between = settled(condensed(told, roots))
    strict = between if closed else settled(closure(between).select(F.col("start").alias("src"), F.col("node").alias("dst")))
    # one with another told superior below it isn't direct
    over = between.select("src", F.col("dst").alias("mid")).join(strict.toDF("mid", "dst"), "mid").select("src", "dst")
    own = between.join(over, ["src", "dst"], "left_anti")
    if roots.isEmpty():
        return own
    members = lambda end: roots.select(F.col("root").alias(end), F.col("node").alias(f"{end}_node"))
    spread = own.join(members("src"), "src", "left").join(members("dst"), "dst", "left")
    return spread.select(F.coalesce("src_node", "src").alias("src"), F.coalesce("dst_node", "dst").alias("dst"))


def redundant(told: DataFrame) -> DataFrame:
    """The rows of ``told(src, dst)`` whose ``dst`` isn't a direct superior of ``src``; with equivalents, these too."""
    return told.join(direct(told), ["src", "dst"], "left_anti")


def paths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(root, node, depth, path)``: every way down from ``roots(root)`` that meets no node twice; ``path`` lists its nodes."""
    step = edges.select("src", "dst").distinct()
    fresh = settled(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array("root").alias("path")))
    known, depth = fresh, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = fresh.join(step, fresh["node"] == step["src"]).where(~F.array_contains("path", F.col("dst")))
        new = settled(new.select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path")))
        if new.isEmpty():
            break
        known, fresh = known.unionByName(new), new
    return known


def promoted(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``(src, dst)`` between kept nodes (``kept(node)``) when all others are taken out and their children moved up."""
    k = kept.select("node").distinct()
    out = edges.select("src", "dst").distinct()
    gone = out.join(k, out["dst"] == k["node"], "left_anti")  # edges into a node that goes
    fresh = settled(out.join(k, out["src"] == k["node"], "left_semi"))
    known, done = fresh, None
    while True:
        ends = fresh.join(k, fresh["dst"] == k["node"], "left_semi")
        done = ends if done is None else done.unionByName(ends)
        over = fresh.join(gone.select(F.col("dst").alias("via")).distinct(), fresh["dst"] == F.col("via"), "left_semi")
        nxt = over.select(F.col("src").alias("s"), F.col("dst").alias("via")).join(out, F.col("via") == out["src"]).select(F.col("s").alias("src"), "dst").distinct()
        fresh = settled(nxt.join(known, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return done.distinct()
        known = known.unionByName(fresh)


def first_kept_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of each group of ``keys`` the first row by ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
