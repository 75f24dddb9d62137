"""Syntactic locality modules (Cuenca Grau et al., "Modular Reuse of Ontologies", 2008) as joins to a fixpoint.

An axiom is local for a signature if it says nothing about it once all other names are
empty (bottom) or everything (top). A module is what is left after taking in, until
nothing changes, each axiom that isn't local and its names; STAR alternates both kinds.

A round finds for each name whether it is in the signature, for each class expression
whether it is empty or full, from the innermost ones outwards, and for each axiom, from
its parts, whether it is local. Nothing of this leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..schema import NOTHING, THING
from .closure import closure

_KEPT = ("Declaration", "AnnotationAssertion")
_STRINGS = "array<string>"


def _plain(col):
    """Column: a property without ``inverse()`` around it."""
    return F.regexp_replace(col, r"^inverse\((.*)\)$", "$1")


def _parts(x: DataFrame) -> DataFrame:
    """``(expr_id, part)``: the operands and fillers of expressions."""
    return x.select("expr_id", F.explode(F.concat(F.coalesce("operands", F.array().cast(_STRINGS)), F.array("filler"))).alias("part")).where("part is not null")


def _levels(expressions: DataFrame) -> list[DataFrame]:
    """The expressions by how deep they nest, the innermost first."""
    x = settled(expressions.dropDuplicates(["expr_id"]))
    inner = settled(_parts(x).join(x.select(F.col("expr_id").alias("part")), "part", "left_semi").distinct())
    out, left = [], x
    while not left.isEmpty():
        waits = inner.join(left.select(F.col("expr_id").alias("part")), "part", "left_semi").select("expr_id").distinct()
        out.append(settled(left.join(waits, "expr_id", "left_anti")))
        left = settled(left.join(waits, "expr_id", "left_semi"))
        if out[-1].isEmpty():
            raise ValueError("Class expressions that are part of themselves.")
    return out


def _expression_names(x: DataFrame) -> DataFrame:
    """``(expr_id, name)``: the entities that an expression names at any depth."""
    own = x.where("op not in ('literal', 'datatype')")
    ids = x.select(F.col("expr_id").alias("item"))
    parts = _parts(own)
    direct = parts.join(ids, parts["part"] == ids["item"], "left_anti").select("expr_id", F.col("part").alias("name"))
    direct = direct.union(own.select("expr_id", F.explode(F.array("iri", _plain(F.col("prop"))))).toDF("expr_id", "name").where("name is not null"))
    down = parts.join(ids, parts["part"] == ids["item"], "left_semi").select(F.col("expr_id").alias("src"), F.col("part").alias("dst"))
    reach = closure(down, own.select(F.col("expr_id").alias("start")), include_start=True)
    return reach.join(direct.toDF("node", "name"), "node").select(F.col("start").alias("expr_id"), "name").distinct()


def axiom_names(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """``(axiom_id, name)``: the entities that axioms name, Thing and Nothing left out."""
    third = F.when(~F.col("axiom_type").isin("DataPropertyAssertion", "AnnotationAssertion"), F.col("a3"))
    items = axioms.select("axiom_id", F.explode(F.concat(F.array("a1", "a2", third), F.coalesce("operands", F.array().cast(_STRINGS)))).alias("item")).where("item is not null")
    inside = _expression_names(expressions)
    known = expressions.select(F.col("expr_id").alias("item")).distinct()
    plain = items.join(known, "item", "left_anti").select("axiom_id", _plain(F.col("item")).alias("name"))
    nested = items.join(inside, items["item"] == inside["expr_id"]).select("axiom_id", "name")
    return plain.union(nested).where(~F.col("name").isin(THING, NOTHING)).distinct()


class _Round:
    """Which parts say nothing, for one signature."""

    def __init__(self, levels: list[DataFrame], items: DataFrame, signature: DataFrame, top: bool):
        self.levels, self.items, self.top = levels, items, top
        self.inside = signature.select(F.col("iri").alias("_name"), F.lit(True).alias("_in"))

    def outside(self, df: DataFrame, col: str, out: str) -> DataFrame:
        """``df`` with ``out``: whether the property ``col`` isn't in the signature."""
        return df.withColumn("_key", _plain(F.col(col))).join(self.inside, F.col("_key") == F.col("_name"), "left").withColumn(out, F.col("_in").isNull()).drop("_key", "_name", "_in")

    def status(self) -> DataFrame:
        """``(item, empty, full)`` of named classes and of expressions."""
        item, out = F.col("item"), F.col("_in").isNull()
        base = self.items.join(self.inside, item == F.col("_name"), "left")
        empty = (item == NOTHING) | (F.lit(not self.top) & (item != THING) & out)
        full = (item == THING) | (F.lit(self.top) & (item != NOTHING) & out)
        known = base.select("item", empty.alias("empty"), full.alias("full"))
        for level in self.levels:
            # settled, as each level reads what is below it twice
            known = known.union(settled(self._level(level, known)))
        return known

    def _level(self, level: DataFrame, known: DataFrame) -> DataFrame:
        many = level.where("op in ('and', 'or')").select("expr_id", "op", F.explode("operands").alias("item")).join(known, "item")
        many = many.groupBy("expr_id", "op").agg(*[f(c).alias(f"{n}_{c}") for c in ("empty", "full") for n, f in (("any", F.bool_or), ("all", F.bool_and))])
        both = F.col("op") == "and"
        many = many.select(F.col("expr_id").alias("item"), F.when(both, F.col("any_empty")).otherwise(F.col("all_empty")).alias("empty"), F.when(both, F.col("all_full")).otherwise(F.col("any_full")).alias("full"))
        one = self.outside(level.where("op not in ('and', 'or')"), "prop", "_out").join(known.toDF("filler", "_e", "_f"), "filler", "left")
        op, card, e, f = F.col("op"), F.col("card"), F.coalesce("_e", F.lit(False)), F.coalesce("_f", F.lit(False))
        out, top, bare = F.col("_out") & F.col("prop").isNotNull(), F.lit(self.top), F.col("filler").isNull()
        asks = op.isin("some", "value", "self") | op.isin("min", "exactly") & (card > 0)
        empty = F.when(op == "not", f).when(asks, ~top & out | (op != "value") & ~bare & e).when(top & out & (op == "only"), e).when(top & out & (op == "max"), bare | f).otherwise(F.lit(False))
        least = F.coalesce(F.when(card == 0, 1).otherwise(card), F.lit(1))
        full = (
            F.when(op == "not", e).when(op == "only", ~top & out | f).when(op == "max", ~top & out | ~bare & e)
            .when(op.isin("some", "min") & top & out, (least <= 1) & (bare | f)).otherwise(op.isin("value", "self") & top & out | (op == "min") & (card == 0))
        )
        return many.union(one.select(F.col("expr_id").alias("item"), empty, F.coalesce(full, F.lit(False))))

    def local(self, axioms: DataFrame, slots: DataFrame) -> DataFrame:
        """``(axiom_id)`` of the axioms that say nothing about the signature."""
        rows = self.outside(slots, "item", "out").join(self.status(), "item", "left")
        at = lambda slot, c: F.coalesce(F.bool_or(F.when(F.col("slot") == slot, F.col(c))), F.lit(False)).alias(f"{slot}_{c}")
        ops = lambda c, f, name: F.coalesce(f(F.when(F.col("slot") == "op", c)), F.lit(True) if f is F.bool_and else F.lit(0)).alias(name)
        said = rows.groupBy("axiom_id").agg(
            *[at(s, c) for s in ("a1", "a2") for c in ("empty", "full", "out")], ops(F.col("empty"), F.bool_and, "all_empty"), ops(F.col("full"), F.bool_and, "all_full"), ops(F.col("out"), F.bool_and, "all_out"),
            F.coalesce(F.bool_or(F.when(F.col("slot") == "op", F.col("out"))), F.lit(False)).alias("any_out"), ops((~F.col("empty")).cast("int"), F.sum, "not_empty"), ops((~F.col("out")).cast("int"), F.sum, "not_out"),
        )
        kind, top, c = F.col("axiom_type"), F.lit(self.top), F.col
        feature = F.endswith(kind, F.lit("ObjectProperty")) | F.endswith(kind, F.lit("DataProperty"))
        bound = F.regexp_like(kind, F.lit("^(Object|Data)Property(Domain|Range)$"))
        test = (
            F.when(kind == "SubClassOf", c("a1_empty") | c("a2_full")).when(kind == "EquivalentClasses", c("all_empty") | c("all_full")).when(kind == "DisjointClasses", c("not_empty") <= 1)
            .when(kind.isin("SubObjectPropertyOf", "SubDataPropertyOf"), F.when(top, c("a2_out")).otherwise(c("a1_out"))).when(kind.isin("EquivalentObjectProperties", "EquivalentDataProperties"), c("all_out"))
            .when(kind.isin("DisjointObjectProperties", "DisjointDataProperties"), ~top & (c("not_out") <= 1)).when(kind == "InverseObjectProperties", c("a1_out") & c("a2_out"))
            .when(kind == "SubPropertyChainOf", F.when(top, c("a1_out")).otherwise(c("any_out"))).when(kind == "HasKey", ~top & c("a1_empty"))
            .when(bound, c("a2_full") | ~top & c("a1_out")).when(kind == "ClassAssertion", c("a2_full"))
            .when(kind.isin("ObjectPropertyAssertion", "DataPropertyAssertion"), c("a2_out") & (top != F.coalesce("negative", F.lit(False))))
            .when(feature & F.startswith(kind, F.lit("Reflexive")), top & c("a1_out")).when(feature, c("a1_out") & (~top | F.startswith(kind, F.lit("Symmetric")) | F.startswith(kind, F.lit("Transitive")))).otherwise(F.lit(True))
        )
        return axioms.select("axiom_id", "axiom_type", "negative").join(said, "axiom_id", "left").where(test).select("axiom_id")


def star_module(axioms: DataFrame, expressions: DataFrame, seeds: DataFrame) -> DataFrame:
    """The axioms in the STAR module of ``seeds(iri)``, with declarations and annotations of all that it names. No seeds, no module."""
    kept = F.col("axiom_type").isin(*_KEPT)
    logical = axioms.where(~kept & ~F.startswith("axiom_type", F.lit("SubAnnotation")) & ~F.startswith("axiom_type", F.lit("AnnotationProperty")))
    seeds = settled(seeds.select("iri").where("iri is not null").distinct())
    names = settled(axiom_names(logical, expressions))
    levels = _levels(expressions)
    slot = lambda s, col: F.struct(F.lit(s).alias("slot"), col.alias("item"))
    slots = F.concat(F.array(slot("a1", F.col("a1")), slot("a2", F.col("a2"))), F.transform(F.coalesce("operands", F.array().cast(_STRINGS)), lambda x: slot("op", x)))
    slots = settled(logical.select("axiom_id", F.explode(slots).alias("s")).select("axiom_id", "s.slot", "s.item").where("item is not null"))
    ids = expressions.select(F.col("expr_id").alias("item"))
    items = settled(slots.select("item").union(_parts(expressions).select("part")).distinct().join(ids, "item", "left_anti"))
    module = settled(logical.select("axiom_id", "axiom_type", "negative"))
    if seeds.isEmpty():
        module = module.limit(0)
    size, before = module.count(), -1
    while size != before:
        before = size
        for top in (False, True):
            module = _extracted(module, seeds, names, levels, slots, items, top)
        size = module.count()
    signature = seeds.union(module.join(names, "axiom_id").select("name")).distinct()
    about = axioms.where(kept).join(signature, F.col("a1") == F.col("iri"), "left_semi")
    return reduce(DataFrame.unionByName, [axioms.join(module.select("axiom_id"), "axiom_id", "left_semi"), about])


def _extracted(module: DataFrame, seeds: DataFrame, names: DataFrame, levels: list[DataFrame], slots: DataFrame, items: DataFrame, top: bool) -> DataFrame:
    """The rows of ``module`` that aren't local, with a signature that grows by what they name."""
    signature, rest, taken = seeds, module, []
    while True:
        local = _Round(levels, items, signature, top).local(rest, slots.join(rest, "axiom_id", "left_semi"))
        new = settled(rest.join(local, "axiom_id", "left_anti"))
        if new.isEmpty():
            return settled(reduce(DataFrame.unionByName, taken)) if taken else module.limit(0)
        taken.append(new)
        rest = settled(rest.join(new.select("axiom_id"), "axiom_id", "left_anti"))
        signature = settled(signature.union(new.join(names, "axiom_id").select("name")).distinct())
