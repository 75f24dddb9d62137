"""Property assertions closed under their properties' rules, and individuals that are one.

What turns one assertion into another (super-properties, equivalent and inverse ones, symmetry) is closed once over
properties, so an assertion is joined to all that it says in one step. What needs two
assertions (transitivity, chains) is compiled to rules ``l, r -> s``; a chain of more than two becomes
states, each reached from the one before. Rules are taken stratum by stratum along the
components of the graph of what feeds what, so that a stratum's rules see finished
assertions of those below; inside a stratum every round joins only what the last one found.

Individuals that are one are a component with a root, and assertions are about roots: a
class of many equal individuals costs a row for each, not for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from .closure import closure, condensed
from .components import connected, strong

FACT = ["subject", "prop", "object"]
#: Rounds after which the tables of known assertions are written as one.
COMPACT = 8


def moves(roles: DataFrame, inverses: DataFrame, symmetric: DataFrame, used: DataFrame) -> DataFrame:
    """``(p, q, turned)``: an assertion of ``p`` is one of ``q``, the other way round if ``turned``; for all properties of ``used(prop)``, themselves included.

    ``roles(src, dst)`` are told super-properties, ``inverses(p, q)`` and ``symmetric(p)`` hold both
    ways. ``inverse(p)`` names the inverse of ``p``.
    """
    of = lambda c: F.regexp_extract(c, r"^inverse\((.*)\)$", 1)
    props = roles.select(F.col("src").alias("prop")).union(roles.select("dst")).union(inverses.select("p")).union(inverses.select("q")).union(symmetric.select("p")).union(used.select("prop")).distinct()
    turned = inverses.select("p", "q").union(symmetric.select("p", "p")).union(props.where(of(F.col("prop")) != "").select(of(F.col("prop")), "prop"))
    turned = turned.union(turned.select(F.col("q"), F.col("p"))).distinct()
    node = lambda c, t: F.struct(F.col(c).alias("prop"), F.lit(t).alias("turned"))
    edges = [roles.select(node("src", t).alias("src"), node("dst", t).alias("dst")) for t in (False, True)]
    edges += [turned.select(node("p", t).alias("src"), node("q", not t).alias("dst")) for t in (False, True)]
    graph = settled(edges[0].union(edges[1]).union(edges[2]).union(edges[3]).distinct())
    props = settled(props.where("prop is not null"))
    if graph.isEmpty():
        return props.select(F.col("prop").alias("p"), F.col("prop").alias("q"), F.lit(False).alias("turned"))
    found = closure(graph, props.select(F.struct("prop", F.lit(False).alias("turned")).alias("start")), include_start=True)
    return settled(found.select(F.col("start.prop").alias("p"), F.col("node.prop").alias("q"), F.col("node.turned").alias("turned")))


def compositions(transitive: DataFrame, chains: DataFrame) -> DataFrame:
    """``(l, r, s)``: ``l`` and then ``r`` make ``s``, from ``transitive(prop)`` and ``chains(steps, sup)``; states of longer chains are named by their steps."""
    steps = chains.where("size(steps) > 1").select("steps", "sup", F.explode(F.sequence(F.lit(1), F.size("steps") - 1)).alias("k"))
    state = lambda k: F.concat(F.lit("chain:"), F.array_join(F.slice("steps", 1, k), "\x1f"))
    left = F.when(F.col("k") == 1, F.element_at("steps", 1)).otherwise(state(F.col("k")))
    out = F.when(F.col("k") == F.size("steps") - 1, F.col("sup")).otherwise(state(F.col("k") + 1))
    compiled = steps.select(left.alias("l"), F.element_at("steps", F.col("k") + 1).alias("r"), out.alias("s"))
    return compiled.union(transitive.select(F.col("prop").alias("l"), F.col("prop").alias("r"), F.col("prop").alias("s"))).distinct()


def strata(rules: DataFrame, moved: DataFrame) -> DataFrame:
    """``(l, r, s, level)``: rules whose result feeds another's premise are on a lower level, those that feed each other on the same."""
    name = F.concat_ws("\x1e", "l", "r", "s")
    named = settled(rules.select(name.alias("rule"), "l", "r", "s"))
    gives = named.select(F.col("rule").alias("src"), F.col("s").alias("p")).join(moved.select("p", "q").distinct(), "p", "left").select("src", F.coalesce("q", "p").alias("prop"))
    takes = named.select(F.col("rule").alias("dst"), F.explode(F.array("l", "r")).alias("prop"))
    feeds = settled(gives.join(takes, "prop").select("src", "dst").distinct())
    roots = strong(feeds)
    between = settled(condensed(feeds, roots))
    at = settled(named.join(roots.toDF("rule", "root"), "rule", "left").select("rule", F.coalesce("root", "rule").alias("root")))
    level = settled(at.select("root").distinct().withColumn("level", F.lit(0)))
    fresh = level
    while True:
        raised = fresh.join(between, fresh["root"] == between["src"]).groupBy(F.col("dst").alias("root")).agg((F.max("level") + 1).alias("level"))
        fresh = settled(raised.join(level.withColumnRenamed("level", "before"), "root").where("level > before").select("root", "level"))
        if fresh.isEmpty():
            return named.join(at, "rule").join(level, "root").select("l", "r", "s", "level")
        level = settled(level.join(fresh.select("root"), "root", "left_anti").union(fresh))


class Facts:
    """Assertions ``(subject, prop, object)`` closed under ``moved`` and ``rules``, to which more can be added."""

    def __init__(self, moved: DataFrame, rules: DataFrame):
        self.moved, self.rules = moved, settled(strata(rules, moved)) if not rules.isEmpty() else None
        self.top = self.rules.agg(F.max("level")).first()[0] if self.rules is not None else -1
        self.known: DataFrame | None = None

    def _said(self, facts: DataFrame) -> DataFrame:
        """``facts`` and what each of them says alone."""
        led = facts.join(self.moved, facts["prop"] == self.moved["p"], "left")
        end = lambda c, d: F.when(F.coalesce("turned", F.lit(False)), F.col(d)).otherwise(F.col(c))
        return led.select(end("subject", "object").alias("subject"), F.coalesce("q", "prop").alias("prop"), end("object", "subject").alias("object")).distinct()

    def _fresh(self, found: DataFrame) -> DataFrame:
        return settled(found.distinct() if self.known is None else found.distinct().join(self.known, FACT, "left_anti"))

    def add(self, facts: DataFrame) -> DataFrame:
        """Adds ``facts`` and what follows; what is known then. Nothing known is derived again."""
        new = self._fresh(self._said(facts))
        before, self.known = self.known, new if self.known is None else self.known.union(new)
        arrived, rounds = new, 0  # all that is new to the strata above
        for level in range(self.top + 1):
            rules = self.rules.where(F.col("level") == level)
            delta = arrived
            while not delta.isEmpty():
                left = delta.join(rules, delta["prop"] == rules["l"]).select("subject", F.col("object").alias("mid"), F.col("r").alias("prop"), "s")
                out = left.join(self.known.toDF("mid", "prop", "object"), ["mid", "prop"]).select("subject", F.col("s").alias("prop"), "object")
                if before is not None or delta is not arrived:  # else the other half would say the same
                    right = delta.join(rules, delta["prop"] == rules["r"]).select(F.col("subject").alias("mid"), F.col("l").alias("prop"), "s", "object")
                    out = out.union(right.join(self.known.toDF("subject", "prop", "mid"), ["mid", "prop"]).select("subject", F.col("s").alias("prop"), "object"))
                delta = self._fresh(self._said(out.distinct()))
                self.known, arrived, rounds = self.known.union(delta), arrived.union(delta), rounds + 1
                if rounds % COMPACT == 0:
                    self.known, arrived = settled(self.known), settled(arrived)
        self.known = settled(self.known)
        return self.known

    def renamed(self, roots: DataFrame) -> DataFrame:
        """Puts roots for individuals, by ``roots(node, root)``; only assertions that this changes are taken as new."""
        changed = settled(led(led(self.known, "subject", roots), "object", roots).join(self.known, FACT, "left_anti"))
        gone = roots.select("node")
        self.known = settled(self.known.join(gone, self.known["subject"] == gone["node"], "left_anti").join(gone, self.known["object"] == gone["node"], "left_anti"))
        return self.add(changed)


def led(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``df`` with the root in ``column`` where ``roots(node, root)`` has one."""
    table = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(table, df[column] == table["_node"], "left").withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def members(roots: DataFrame) -> DataFrame:
    """``(root, member)``: each root's nodes, itself included; roots that stand for themselves alone aren't listed."""
    return roots.select("root", F.col("node").alias("member")).union(roots.select("root", "root")).distinct()


def spread(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """The reverse of :func:`led`: a row for each member of the root in ``column``."""
    table = members(roots).toDF("_root", "_member")
    return df.join(table, df[column] == table["_root"], "left").withColumn(column, F.coalesce("_member", column)).drop("_root", "_member")


def equal_by(rows: DataFrame, by: list[str], one: str) -> DataFrame:
    """``(a, b)``: of each group of ``by``, its least ``one`` with every other; linear in the rows."""
    least = rows.groupBy(*by).agg(F.min(one).alias("_least"))
    return rows.join(least, by).where(F.col("_least") != F.col(one)).select(F.col("_least").alias("a"), F.col(one).alias("b")).distinct()


def settle(facts: Facts, told: DataFrame, same: DataFrame, at_most_one: DataFrame, back: DataFrame, more: Callable[[DataFrame, DataFrame], DataFrame | None] = lambda f, r: None) -> tuple[DataFrame, DataFrame]:
    """``(facts, roots)``: ``told`` closed, about roots of the individuals that are one: ``same(a, b)``, what functional properties ``at_most_one(prop)`` and inverse functional ones ``back(prop)`` make one, and what ``more(facts, roots)`` adds."""
    pairs = settled(same.select("a", "b"))
    roots = connected(pairs)
    known = facts.add(led(led(told, "subject", roots), "object", roots))
    while True:
        fore = equal_by(known.join(at_most_one, "prop", "left_semi"), ["subject", "prop"], "object")
        hind = equal_by(known.join(back, "prop", "left_semi"), ["object", "prop"], "subject")
        new = settled(fore.union(hind).distinct())
        if new.isEmpty():
            found = more(known, roots)
            new = settled(found) if found is not None else new
            if new.isEmpty():
                return known, roots
        pairs = settled(pairs.union(new).distinct())
        roots = connected(pairs)
        known = facts.renamed(roots)
