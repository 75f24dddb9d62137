"""Rules over assertions and hierarchies, and the clean-up of what they infer.

The class hierarchy is closed once; assertions, the large side, are then joined to it
once. Only transitive properties recurse over assertions. Tables of properties and classes are settled before
assertions are joined to them: their size is known then, and a small one doesn't send all assertions to the few tasks of its keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..plans.sized import unique
from ..schema import IS_INFERRED, TRIVIAL
from .closure import closure
from .store import difference


def upper(told: DataFrame) -> DataFrame:
    """``(sub, sup)``: the reflexive and transitive closure of ``told(src, dst)`` over all its nodes."""
    nodes = told.select(F.col("src").alias("sub")).union(told.select("dst")).distinct().where("sub is not null")
    above = closure(told).where("start <> node").select(F.col("start").alias("sub"), F.col("node").alias("sup"))
    return above.union(nodes.select("sub", F.col("sub").alias("sup")))


def inferred_types(types: DataFrame, told: DataFrame) -> DataFrame:
    """``(ind, cls)``: all classes of the individuals of ``types(ind, cls)``, told and inherited."""
    up = closure(told).select(F.col("start").alias("cls"), F.col("node").alias("sup"))
    return types.select("ind", "cls").union(types.join(up, "cls").select("ind", F.col("sup").alias("cls"))).distinct()


def inferred_disjoint(told: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of classes below a pair of ``disjoint(a, b)``, in both orders."""
    both = disjoint.select("a", "b").union(disjoint.select("b", "a")).distinct()
    down = upper(told)
    down = down.union(both.select(F.col("a").alias("sub"), F.col("a").alias("sup"))).distinct()
    left, right = down.select(F.col("sub").alias("x"), F.col("sup").alias("a")), down.select(F.col("sub").alias("y"), F.col("sup").alias("b"))
    return both.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def inverse_assertions(assertions: DataFrame, inverses: DataFrame, symmetric: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    """``(subject, prop, object, negative)`` that follow from ``assertions`` by inverse and symmetric properties.

    Every inverse that a property has counts, whichever side declares it; negative
    assertions turn round like positive ones. With ``repeated``, each assertion is turned as often as it
    is given, and no two results are compared.
    """
    both = inverses.select("p", "q").union(inverses.select("q", "p"))
    if symmetric is not None:
        both = both.union(symmetric.select("p", F.col("p").alias("q")))
    both = settled(both.distinct())
    turned = assertions.join(both, F.col("prop") == F.col("p")).select(F.col("object").alias("subject"), F.col("q").alias("prop"), F.col("subject").alias("object"), "negative")
    return turned if repeated else turned.distinct()


def subproperty_values(assertions: DataFrame, told: DataFrame) -> DataFrame:
    """``(subject, prop, object)`` by all super-properties of ``told(src, dst)``; given ones included."""
    up = closure(told).select(F.col("start").alias("prop"), F.col("node").alias("sup"))
    rows = assertions.select("subject", "prop", "object")
    return rows.union(rows.join(up, "prop").select("subject", F.col("sup").alias("prop"), "object")).distinct()


def domain_range_types(assertions: DataFrame, domains: DataFrame, ranges: DataFrame) -> DataFrame:
    """``(ind, cls)``: subjects are in their property's ``domains(prop, cls)``, objects in its ``ranges(prop, cls)``."""
    subjects = assertions.join(settled(domains), "prop").select(F.col("subject").alias("ind"), "cls")
    objects = assertions.join(settled(ranges), "prop").select(F.col("object").alias("ind"), "cls")
    found = subjects.union(objects)
    return unique(found, found.count())


def transitive_values(assertions: DataFrame, transitive: DataFrame) -> DataFrame:
    """``(subject, prop, object)`` of the transitive properties ``transitive(prop)``, closed; given ones included."""
    rows = assertions.join(settled(transitive.select("prop").distinct()), "prop", "left_semi")
    end = lambda c: F.struct(F.col("prop"), F.col(c).alias("node"))
    found = closure(rows.select(end("subject").alias("src"), end("object").alias("dst")))
    return found.select(F.col("start.node").alias("subject"), F.col("start.prop").alias("prop"), F.col("node.node").alias("object"))


def property_values(assertions: DataFrame, told: DataFrame, inverses: DataFrame, symmetric: DataFrame, transitive: DataFrame) -> DataFrame:
    """``(subject, prop, object)`` closed under super-properties, inverses, symmetry and transitivity, given ones included."""
    from . import rules

    facts = assertions.select("subject", "prop", "object")
    moved = rules.moves(told, inverses, symmetric, facts.select("prop").union(transitive.select("prop")))
    nothing = transitive.select(F.array("prop").alias("steps"), F.col("prop").alias("sup"))  # a chain of one step is none
    return rules.Facts(moved, rules.compositions(transitive.select("prop").distinct(), nothing)).add(facts)


def recognised(types: DataFrame, assertions: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(ind, cls)`` for classes defined as intersections: ``definitions(cls, part, prop, filler)``, one row for each conjunct.

    A conjunct without ``prop`` is the class ``filler``; with it, some ``prop`` to a ``filler``.
    """
    needed = definitions.groupBy("cls").agg(F.countDistinct("part").alias("needed"))
    plain = definitions.where("prop is null").select(F.col("cls").alias("defined"), "part", F.col("filler").alias("cls"))
    by_class = types.join(plain, "cls").select("ind", "defined", "part")
    some = definitions.where("prop is not null").select(F.col("cls").alias("defined"), "part", "prop", F.col("filler").alias("cls"))
    facts = assertions.select(F.col("subject").alias("ind"), "prop", F.col("object").alias("other"))
    by_fact = facts.join(types.select(F.col("ind").alias("other"), "cls"), "other").join(some, ["prop", "cls"]).select("ind", "defined", "part")
    met = by_class.union(by_fact).groupBy("ind", "defined").agg(F.countDistinct("part").alias("met"))
    return met.join(needed, met["defined"] == needed["cls"]).where("met = needed").select("ind", "cls")


def cleaned(inferred: DataFrame, asserted: DataFrame, keys: list[str], trivial=TRIVIAL, excluded: DataFrame | None = None, cls: str = "cls") -> DataFrame:
    """``inferred`` without what ``asserted`` has, what names a trivial entity, and types of ``excluded(cls)``."""
    out = difference(inferred, asserted, keys)
    named = reduce(lambda a, b: a | b, [F.coalesce(F.col(k).isin(*trivial), F.lit(False)) for k in keys])
    out = out.where(~named)
    if excluded is not None:
        out = out.join(excluded.select(F.col("cls").alias("_gone")).distinct(), F.col(cls) == F.col("_gone"), "left_anti")
    return out


def excluded_types(rows: DataFrame, told: DataFrame) -> DataFrame:
    """``(cls)`` from ``rows(cls, itself, superclasses)``: classes, and their strict superiors, whose types aren't wanted."""
    up = closure(told).where("start <> node").select(F.col("start").alias("cls"), F.col("node").alias("sup"))
    own = rows.where("itself").select("cls")
    return own.union(rows.where("superclasses").join(up, "cls").select("sup")).distinct()


def annotated(inferred: DataFrame) -> DataFrame:
    """``inferred`` marked as such."""
    return inferred.withColumn("annotation", F.lit(IS_INFERRED)).withColumn("annotation_value", F.lit("true"))


def violations(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``(ind, a, b)``, ``a < b``: individuals in two disjoint classes."""
    pairs = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    left, right = types.select("ind", F.col("cls").alias("a")), types.select("ind", F.col("cls").alias("b"))
    return left.join(pairs, "a").join(right, ["ind", "b"]).select("ind", "a", "b").distinct()


def unsatisfiable(told: DataFrame, disjoint: DataFrame) -> DataFrame:
    """``(cls)``: classes below two disjoint ones."""
    down = upper(told)
    return violations(down.select(F.col("sub").alias("ind"), F.col("sup").alias("cls")), disjoint).select(F.col("ind").alias("cls")).distinct()
