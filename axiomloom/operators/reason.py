"""Reasoning by completion rules: EL with bottom, chains, ranges and reflexivity; rules over individuals; disjunctive clauses for the rest.

Class expressions are names like any other (their keys), so an axiom between expressions is
an axiom between names, and what an expression means is stated once for each key:

* an intersection is below its operands, and what is below all of them is below it;
* ``some r C`` has an ``r`` to ``C``, and what has an ``r`` to something below ``C`` is below it;
* a complement and what it negates have nothing in common.

Individuals take part as names: a type is a superior, a property assertion an ``r`` to the
other individual. Of individuals that are one, a root stands for all (:mod:`rules`); results are
spread to its members last. The rules (Baader, Brandt and Lutz, "Pushing the EL Envelope", 2005) run
semi-naively to a fixpoint; each round joins new rows only. A range is taken into account by giving
each restriction of its property a filler of its own, below the range (the same authors' range
elimination). Where axioms use unions, universal or counting restrictions, :mod:`disjunctive`
derives what they add.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..schema import CLASS, INDIVIDUAL, NOTHING, THING, TRIVIAL
from . import disjunctive, inference, rules
from .closure import closure, direct
from .relations import pairwise

INFERENCES = ("subclasses", "equivalent classes", "disjoint classes", "subdata properties", "subobject properties", "inverse object properties", "types", "property values")
DEFAULT_INFERENCES = ("subclasses", "equivalent classes", "types", "property values", "inverse object properties")
#: Names under which the reasoner can be asked for, and what each infers.
PROFILES = {"hermit": INFERENCES, "pellet": INFERENCES, "jfact": INFERENCES, "elk": ("subclasses", "equivalent classes", "types")}


#: Kinds of axioms that rules read, or about which there is nothing to reason.
READ = (
    "Declaration", "AnnotationAssertion", "AnnotationPropertyDomain", "AnnotationPropertyRange", "SubAnnotationPropertyOf",
    "SubClassOf", "EquivalentClasses", "DisjointClasses", "ClassAssertion", "HasKey",
    "SubObjectPropertyOf", "EquivalentObjectProperties", "DisjointObjectProperties", "InverseObjectProperties", "ObjectPropertyDomain", "ObjectPropertyRange", "ObjectPropertyAssertion", "SubPropertyChainOf",
    "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "SymmetricObjectProperty", "AsymmetricObjectProperty", "TransitiveObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty",
    "SubDataPropertyOf", "EquivalentDataProperties", "DisjointDataProperties", "DataPropertyDomain", "DataPropertyAssertion", "FunctionalDataProperty",
    "SameIndividual", "DifferentIndividuals",
)


class InconsistentOntologyError(RuntimeError):
    """An ontology from which everything follows."""


def supported(reasoner: str, wanted) -> tuple[list[str], list[str]]:
    """``wanted`` inference types as (supported, not supported) by a reasoner; unknown names are errors."""
    if reasoner.lower() not in PROFILES:
        raise ValueError(f"Unrecognized DL reasoner name: {reasoner}.")
    asked = [w.strip().lower() for w in wanted]
    if unknown := [w for w in asked if w not in INFERENCES]:
        raise ValueError(f"Unsupported inference type: {', '.join(unknown)}.")
    known = PROFILES[reasoner.lower()]
    return [w for w in asked if w in known], [w for w in asked if w not in known]


class Reasoner:
    """What follows from ``axioms`` and ``expressions`` (the tables of :mod:`axiomloom.schema`)."""

    def __init__(self, axioms: DataFrame, expressions: DataFrame):
        self.spark, self.axioms, self.expressions = axioms.sparkSession, settled(axioms), settled(expressions)
        # what occurs: a few dozen names at most; parts of rules about anything else are empty plans, which cost nothing
        self._kinds = {r[0] for r in self.axioms.where(~F.coalesce("negative", F.lit(False))).select("axiom_type").distinct().collect()}
        self._ops = {r[0] for r in self.expressions.select("op").distinct().collect()}
        self.declared = self.of("Declaration").select(F.col("a1").alias("iri"), F.col("a2").alias("kind")).distinct()
        self._state: tuple[DataFrame, DataFrame] | None = None
        self._individuals: tuple[DataFrame, DataFrame] | None = None
        self._moves: DataFrame | None = None

    def of(self, *kinds: str) -> DataFrame:
        present = [k for k in kinds if k in self._kinds]
        if not present:
            return self.axioms.where("false")
        return self.axioms.where(F.col("axiom_type").isin(*present) & ~F.coalesce("negative", F.lit(False)))

    def _with(self, *ops: str) -> DataFrame:
        present = [op for op in ops if op in self._ops]
        return self.expressions.where(F.col("op").isin(*present)) if present else self.expressions.where("false")

    def pairs(self, *kinds: str) -> DataFrame:
        return self.of(*kinds).select("a1", "a2")

    def _none(self, **columns: str) -> DataFrame:
        """No rows, and known as such to the planner (a table made from an empty list is not: joins with it are carried out)."""
        return self.spark.range(1).where("false").select(*[F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])

    def roles(self) -> DataFrame:
        """``(src, dst)``: told sub-properties, equivalent ones both ways."""
        same = pairwise(self.of("EquivalentObjectProperties", "EquivalentDataProperties")).select("a", "b")
        return self.pairs("SubObjectPropertyOf", "SubDataPropertyOf").union(same).toDF("src", "dst").distinct()

    def inverses(self) -> DataFrame:
        return self.pairs("InverseObjectProperties").toDF("p", "q")

    def symmetric(self) -> DataFrame:
        return self.of("SymmetricObjectProperty").select(F.col("a1").alias("p"))

    def transitive(self) -> DataFrame:
        return self.of("TransitiveObjectProperty").select(F.col("a1").alias("prop"))

    def chains(self) -> DataFrame:
        """``(steps, sup)``: properties one after another, and the property that they make."""
        return self.of("SubPropertyChainOf").select(F.col("operands").alias("steps"), F.col("a1").alias("sup"))

    def moves(self) -> DataFrame:
        """``(p, q, turned)``: see :func:`rules.moves`."""
        if self._moves is None:
            used = self.of("ObjectPropertyAssertion").select("a2").union(self.expressions.select("prop")).union(self.of("ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyAssertion", "TransitiveObjectProperty", "ReflexiveObjectProperty").select(F.coalesce(F.when(F.col("axiom_type") == "DataPropertyAssertion", F.col("a2")), F.col("a1"))))
            used = used.union(self.chains().select(F.explode(F.concat("steps", F.array("sup")))))
            used = used.union(self.of("DisjointObjectProperties", "DisjointDataProperties").select(F.explode("operands")))
            self._moves = rules.moves(self.roles(), self.inverses(), self.symmetric(), used.toDF("prop").where("prop is not null"))
        return self._moves

    def facts(self) -> DataFrame:
        """``(subject, prop, object)`` between roots of individuals, closed under the properties' rules."""
        return self._settled_individuals()[0]

    def roots(self) -> DataFrame:
        """``(node, root)`` of the individuals that are one with another, told or by functional properties and keys; the root is the least of them."""
        return self._settled_individuals()[1]

    def same(self) -> DataFrame:
        """``(a, b)``, ``a <> b``: individuals that are one, all pairs."""
        all_of_them = rules.members(self.roots())
        return all_of_them.join(all_of_them.withColumnRenamed("member", "b"), "root").where("member <> b").select(F.col("member").alias("a"), "b")

    def individuals(self) -> DataFrame:
        """``(iri)``: everything that is said to be an individual or used as one."""
        used = self.of("ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion").select("a1")
        objects = self.of("ObjectPropertyAssertion").select("a3")
        several = self.axioms.where("axiom_type in ('SameIndividual', 'DifferentIndividuals')").select(F.explode("operands"))
        return self.declared.where(F.col("kind") == INDIVIDUAL).select("iri").union(used).union(objects).union(several).distinct()

    def _settled_individuals(self) -> tuple[DataFrame, DataFrame]:
        if self._individuals is None:
            told = self.of("ObjectPropertyAssertion").select(F.col("a1").alias("subject"), F.col("a2").alias("prop"), F.col("a3").alias("object"))
            always = self.of("ReflexiveObjectProperty").select(F.col("a1").alias("prop"))
            everyone = self.individuals().select(F.col("iri").alias("subject"), F.col("iri").alias("object"))
            told = told.union(always.withColumn("_one", F.lit(1)).join(everyone.withColumn("_one", F.lit(1)), "_one").select("subject", "prop", "object"))
            one = self.of("SameIndividual").select(F.explode("operands").alias("b"), F.array_min("operands").alias("a")).where("a <> b").select("a", "b")
            props = lambda kind: self.of(kind).select(F.col("a1").alias("prop"))
            keyed = None if self.of("HasKey").isEmpty() else self._equal_by_keys
            facts = rules.Facts(self.moves(), rules.compositions(self.transitive(), self.chains()))
            self._individuals = rules.settle(facts, told, one, props("FunctionalObjectProperty"), props("InverseFunctionalObjectProperty"), keyed or (lambda f, r: None))
        return self._individuals

    def _equal_by_keys(self, facts: DataFrame, roots: DataFrame) -> DataFrame:
        """``(a, b)``: members of a class that agree in a value of each of the properties of one of its keys; types are those that follow so far."""
        self._individuals, self._state = (facts, roots), None  # what is known until here
        keys = self.of("HasKey").select(F.col("axiom_id").alias("key"), F.col("a1").alias("cls"), F.posexplode("operands").alias("place", "prop"), F.size("operands").alias("n"))
        types = self.saturated()[0].toDF("ind", "cls").join(rules.led(self.individuals(), "iri", roots).select(F.col("iri").alias("ind")).distinct(), "ind", "left_semi")
        data = self.data_values().select("subject", "prop", F.concat_ws("\x1f", F.lit("data"), "value", "datatype", "lang").alias("value"))
        values = facts.select("subject", "prop", F.col("object").alias("value")).union(data).distinct()
        held = keys.join(types, "cls").join(values.withColumnRenamed("subject", "ind"), ["ind", "prop"]).select("key", "ind", "place", "n", "value")
        # one row for each way to take a value of every property, few unless properties have many values
        ways = held.where("place = 0").select("key", "ind", "n", F.array("value").alias("way"))
        for place in range(1, keys.agg(F.max("n")).first()[0] or 1):
            following = held.where(F.col("place") == place).select("key", "ind", "value")
            longer = ways.where(F.col("n") > place).join(following, ["key", "ind"]).select("key", "ind", "n", F.concat("way", F.array("value")).alias("way"))
            ways = ways.where(F.col("n") <= place).union(longer)
        found = settled(rules.equal_by(ways.select("key", "way", "ind").distinct(), ["key", "way"], "ind"))
        self._individuals = self._state = None
        return found

    def data_values(self) -> DataFrame:
        """``(subject, prop, value, datatype, lang)``: values of roots of individuals by data properties and all above them; a missing type or language is empty."""
        plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
        told = self.of("DataPropertyAssertion").select(F.col("a1").alias("subject"), F.col("a2").alias("prop"), F.col("a3").alias("value"), plain("datatype"), plain("lang"))
        up = self.moves().where("not turned and p <> q").select(F.col("p").alias("prop"), "q")
        above = told.join(up, "prop").select("subject", F.col("q").alias("prop"), "value", "datatype", "lang")
        return rules.led(told.union(above), "subject", self.roots()).distinct()

    def _empty_properties(self) -> DataFrame:
        """``(prop)``: properties below two disjoint ones, which hold of nothing."""
        apart = pairwise(self.of("DisjointObjectProperties", "DisjointDataProperties")).select("a", "b")
        up = self.moves().where("not turned").select("p", "q")
        both = up.withColumnRenamed("q", "a").join(apart, "a").join(up.withColumnRenamed("q", "b"), ["p", "b"])
        return both.select(F.col("p").alias("prop")).distinct()

    def _ranges(self) -> DataFrame:
        """``(prop, cls)``: told ranges, those of properties above, and domains of inverses."""
        told = self.of("ObjectPropertyRange").select("a1", "a2", F.lit(False)).union(self.of("ObjectPropertyDomain").select("a1", "a2", F.lit(True))).toDF("q", "cls", "turned")
        return self.moves().join(told, ["q", "turned"]).select(F.col("p").alias("prop"), "cls").distinct()

    def _told(self) -> dict[str, DataFrame]:
        of, roots, facts = self._with, self.roots(), self.facts()
        root = lambda df, c: rules.led(df, c, roots)
        everyone = settled(root(self.individuals(), "iri").distinct())
        parts = of("and").select(F.col("expr_id").alias("x"), F.posexplode("operands").alias("k", "c"))
        # x#k stands for the first k + 1 operands together; the last of them is x itself
        last = of("and").select(F.col("expr_id").alias("x"), (F.size("operands") - 1).alias("n"))
        parts = parts.join(last, "x")
        name = lambda k: F.when(k == F.col("n"), F.col("x")).otherwise(F.concat("x", F.lit("#"), k.cast("string")))
        before = parts.select(F.col("x").alias("x0"), F.col("k").alias("k0"), F.col("c").alias("c0"))
        first = before.where("k0 = 0").select("x0", F.col("c0").alias("head"))
        conj = parts.where("k > 0").join(first, F.col("x") == F.col("x0")).select(F.when(F.col("k") == 1, F.col("head")).otherwise(name(F.col("k") - 1)).alias("b1"), F.col("c").alias("b2"), name(F.col("k")).alias("b"))
        apart = pairwise(self.of("DisjointClasses")).select(F.col("a").alias("b1"), F.col("b").alias("b2"))
        apart = apart.union(of("not").select("expr_id", "filler"))
        conj = conj.union(apart.select("b1", "b2", F.lit(NOTHING)))
        same = pairwise(self.of("EquivalentClasses")).select("a", "b")
        sub = self.pairs("SubClassOf").union(same).union(root(self.pairs("ClassAssertion"), "a1").select("a1", "a2")).union(parts.select("x", "c"))
        one_of = root(of("oneof").select(F.explode("operands").alias("ind"), "expr_id"), "ind").select("ind", "expr_id")
        sub = sub.union(of("or").select(F.explode("operands"), "expr_id")).union(one_of)
        sub = sub.union(of("oneof").where("size(operands) = 1").select("expr_id", F.col("operands")[0].alias("ind")).transform(lambda df: root(df, "ind")).select("expr_id", "ind"))
        some = of("some", "value", "min", "exactly").where("op in ('some', 'value') or card >= 1").select("expr_id", "prop", F.coalesce("filler", F.lit(THING)).alias("filler"), "op", "card")
        some = settled(root(some, "filler").select("expr_id", "prop", "filler", "op", "card"))
        sub = sub.union(some.join(self._empty_properties(), "prop", "left_semi").select("expr_id", F.lit(NOTHING)))
        ranges = settled(self._ranges())
        # a filler of its own for each restriction of a property with a range; an individual stays what it is
        wide = some.where("op <> 'value'").join(ranges.select("prop").distinct(), "prop", "left_semi").withColumn("own", F.concat_ws("\x1f", "filler", "prop"))
        sub = sub.union(wide.select("own", "filler")).union(wide.join(ranges, "prop").select("own", "cls"))
        narrowed = some.join(wide.select("expr_id", "own"), "expr_id", "left").select("expr_id", "prop", F.coalesce("own", "filler").alias("filler"))
        # "at least n" follows from one only for n = 1
        lhs = some.where("op in ('some', 'value') or (op = 'min' and card = 1)").select("prop", "filler", "expr_id")
        lhs = lhs.union(self.of("ObjectPropertyDomain", "DataPropertyDomain").select("a1", F.lit(THING), "a2"))
        literal = of("literal").select("expr_id", F.split("iri", "\x1f").alias("l")).select("expr_id", F.col("l")[0].alias("value"), F.coalesce(F.col("l")[1], F.lit("")).alias("datatype"), F.coalesce(F.col("l")[2], F.lit("")).alias("lang"))
        data = self.data_values()
        data = data.select("subject", "prop", F.lit("_:literal")).union(data.join(literal, ["value", "datatype", "lang"]).select("subject", "prop", "expr_id"))
        always = self.of("ReflexiveObjectProperty").select(F.col("a1").alias("r"))
        up = self.moves().where("not turned").select("p", "q")
        only = of("only").select(F.col("expr_id").alias("x"), F.col("prop").alias("q"), "filler").join(up, "q").select("x", F.col("p").alias("r"), "filler")
        only = only.union(of("max", "exactly").where("card = 0 and filler is null").select("expr_id", F.col("prop").alias("q")).join(up, "q").select("expr_id", "p", F.lit(NOTHING)))
        return {
            "sub": sub.toDF("a", "b").where("a <> b").distinct(),
            "conj": conj.toDF("b1", "b2", "b").distinct(),
            "has": narrowed.union(facts).union(data).toDF("a", "r", "b").distinct(),
            "lhs": lhs.toDF("r", "c", "b").distinct(),
            "role": self.moves().where("not turned and p <> q").select(F.col("p").alias("r"), F.col("q").alias("s")),
            "pair": rules.compositions(self.transitive(), self.chains()),
            "always": always.join(self.moves().where("p <> q").select(F.col("p").alias("r"), "q"), "r").select("q").union(always).toDF("r").distinct(),
            "range": ranges.toDF("r", "b"),
            "only": only.toDF("x", "r", "b").distinct(),
            "ind": everyone.toDF("a"),
        }

    def saturated(self) -> tuple[DataFrame, DataFrame]:
        """``(sub(a, b), has(a, r, b))`` at the fixpoint; ``sub`` is reflexive and everything is below Thing."""
        if self._state:
            return self._state
        told = {k: settled(v) for k, v in self._told().items()}
        sub, has = self._completed(told, None)
        more = self._disjunctive(told)
        if more is not None:
            more = settled(more)
            if not more.join(sub, ["a", "b"], "left_anti").isEmpty():
                told["sub"] = settled(told["sub"].union(more).distinct())
                sub, has = self._completed(told, (sub, has))
        self._state = settled(sub), settled(has)
        return self._state

    def _completed(self, told: dict[str, DataFrame], known: tuple[DataFrame, DataFrame] | None) -> tuple[DataFrame, DataFrame]:
        """``told`` closed, beginning with what is ``known``."""
        names = reduce(DataFrame.union, [self.declared.where(F.col("kind") == CLASS).select("iri"), told["ind"], self.expressions.select("expr_id"), told["sub"].select("a"), told["sub"].select("b"), told["has"].select("a"), told["has"].select("b"), told["conj"].select("b1"), told["conj"].select("b2")]).toDF("a").distinct()
        sub = names.select("a", F.col("a").alias("b")).union(names.select("a", F.lit(THING)))
        has = told["has"]
        if not told["always"].isEmpty():
            has = has.union(names.withColumn("_one", F.lit(1)).join(told["always"].withColumn("_one", F.lit(1)), "_one").select("a", "r", F.col("a").alias("b")))
        if known is not None:
            sub, has = sub.union(known[0]), has.union(known[1])
        sub, has = settled(sub.distinct()), settled(has.distinct())
        new_sub, new_has, ind = sub, has, told["ind"]
        between = lambda h: h.join(ind, "a", "left_semi").join(ind.toDF("b"), "b", "left_semi").select("a", "r", "b")
        there = lambda k: not told[k].isEmpty()  # noqa: E731 -- rules about what isn't there would still send all of sub and has
        universal, ranged, pairs, joint, implying, roles = there("only"), there("range"), there("pair"), there("conj"), there("lhs"), there("role")
        bottom = known is not None or any(not told[k].where(F.col(c) == NOTHING).isEmpty() for k in ("sub", "conj", "lhs", "range", "only", "has") for c in ("a", "b") if c in told[k].columns)
        while True:
            out = [new_sub.toDF("a", "m").join(told["sub"].toDF("m", "b"), "m").select("a", "b")]
            if joint:
                out.append(new_sub.toDF("a", "b1").join(told["conj"], "b1").join(sub.toDF("a", "b2"), ["a", "b2"]).select("a", "b"))
                out.append(new_sub.toDF("a", "b2").join(told["conj"], "b2").join(sub.toDF("a", "b1"), ["a", "b1"]).select("a", "b"))
            if implying:
                out.append(new_has.toDF("a", "r", "m").join(told["lhs"], "r").join(sub.toDF("m", "c"), ["m", "c"]).select("a", "b"))
                out.append(has.toDF("a", "r", "m").join(new_sub.toDF("m", "c"), "m").join(told["lhs"], ["r", "c"]).select("a", "b"))
            if bottom:
                out.append(new_has.join(sub.where(F.col("b") == NOTHING).select(F.col("a").alias("m")), F.col("b") == F.col("m"), "left_semi").select("a", F.lit(NOTHING).alias("b")))
                out.append(has.join(new_sub.where(F.col("b") == NOTHING).select(F.col("a").alias("m")), F.col("b") == F.col("m"), "left_semi").select("a", F.lit(NOTHING).alias("b")))
            if ranged:  # of individuals; restrictions have fillers of their own
                out.append(between(new_has).toDF("x", "r", "a").join(told["range"], "r").select("a", "b"))
            if universal:
                asks = lambda s: s.join(ind, "a", "left_semi").toDF("i", "x").join(told["only"], "x").select(F.col("i").alias("a"), "r", F.col("b").alias("c"))
                out.append(asks(new_sub).join(between(has), ["a", "r"]).select(F.col("b").alias("a"), F.col("c").alias("b")))
                out.append(asks(sub).join(between(new_has), ["a", "r"]).select(F.col("b").alias("a"), F.col("c").alias("b")))
            # what a name has itself is in has from the start
            more = [new_sub.toDF("a", "m").where("a <> m").join(told["has"].toDF("m", "r", "b"), "m").select("a", "r", "b")]
            if roles:
                more.append(new_has.join(told["role"], "r").select("a", F.col("s").alias("r"), "b"))
            if pairs:
                more.append(new_has.toDF("a", "l", "m").join(told["pair"], "l").join(has.toDF("m", "r", "b"), ["m", "r"]).select("a", F.col("s").alias("r"), "b"))
                more.append(new_has.toDF("m", "r", "b").join(told["pair"], "r").join(has.toDF("a", "l", "m"), ["m", "l"]).select("a", F.col("s").alias("r"), "b"))
            new_sub = settled(reduce(DataFrame.union, out).distinct().join(sub, ["a", "b"], "left_anti"))
            new_has = settled(reduce(DataFrame.union, more).distinct().join(has, ["a", "r", "b"], "left_anti"))
            if new_sub.isEmpty() and new_has.isEmpty():
                return sub, has
            sub, has = sub.union(new_sub), has.union(new_has)

    def _disjunctive(self, told: dict[str, DataFrame]) -> DataFrame | None:
        """``(a, b)``: what disjunctive clauses say; None where the completion rules need no help."""
        if not self._ops & {"or", "only", "not", "max", "exactly", "min"}:
            return None
        given = self.axioms.where(~F.coalesce("negative", F.lit(False)))
        polarity = disjunctive.polarities(given, self.expressions)
        if disjunctive.beyond_horn(self.expressions, polarity).isEmpty():
            return None
        up = self.moves().where("not turned").select(F.col("p").alias("r"), F.col("q").alias("s"))
        types = rules.led(self.pairs("ClassAssertion").toDF("ind", "cls"), "ind", self.roots()).select("ind", "cls")
        clauses = disjunctive.Clauses(given, self.expressions, polarity, self.classes(), up, self.facts(), types, told["ind"].toDF("iri"), self.transitive(), self._empty_properties())
        return clauses.subsumptions()

    def classes(self) -> DataFrame:
        return self.declared.where(F.col("kind") == CLASS).select("iri")

    def superclasses(self) -> DataFrame:
        """``(src, dst)``: all pairs of different named classes, the lower first; Thing and Nothing left out."""
        sub = self.saturated()[0].toDF("src", "dst").where("src <> dst")
        named = self.classes()
        return sub.join(named, sub["src"] == named["iri"], "left_semi").join(named, sub["dst"] == named["iri"], "left_semi").where(~F.col("dst").isin(THING, NOTHING))

    def unsatisfiable(self) -> DataFrame:
        """``(iri)`` of the named classes that can have no member."""
        return self.classes().join(self.saturated()[0].where(F.col("b") == NOTHING).select(F.col("a").alias("iri")), "iri", "left_semi").where(F.col("iri") != NOTHING)

    def clashes(self) -> DataFrame:
        """``(reason, item)``: what makes the ontology inconsistent."""
        sub, _ = self.saturated()
        roots, facts, data = self.roots(), self.facts(), self.data_values()
        root = lambda df, *cs: reduce(lambda d, c: rules.led(d, c, roots), cs, df)
        found = lambda df, reason, c: df.select(F.lit(reason), c)
        inds = root(self.individuals(), "iri").distinct()
        empty = sub.where(F.col("b") == NOTHING).select(F.col("a").alias("iri")).join(inds, "iri", "left_semi")
        parts = [found(empty, "individual of an empty class", "iri"), found(sub.where((F.col("a") == THING) & (F.col("b") == NOTHING)), "everything is an empty class", "a")]
        denied = self.axioms.where("axiom_type = 'ObjectPropertyAssertion' and negative").select(F.col("a1").alias("subject"), F.col("a2").alias("prop"), F.col("a3").alias("object"))
        parts.append(found(facts.join(root(denied, "subject", "object"), ["subject", "prop", "object"], "left_semi"), "assertion and its negation", "subject"))
        plain = lambda c: F.coalesce(c, F.lit("")).alias(c)
        denied = self.axioms.where("axiom_type = 'DataPropertyAssertion' and negative").select(F.col("a1").alias("subject"), F.col("a2").alias("prop"), F.col("a3").alias("value"), plain("datatype"), plain("lang"))
        parts.append(found(data.join(root(denied, "subject"), ["subject", "prop", "value", "datatype", "lang"], "left_semi"), "assertion and its negation", "subject"))
        of = lambda *kinds: self.of(*kinds).select(F.col("a1").alias("prop")).distinct()
        parts.append(found(facts.where("subject = object").join(of("IrreflexiveObjectProperty", "AsymmetricObjectProperty"), "prop", "left_semi"), "irreflexive property of an individual and itself", "subject"))
        turned = facts.join(of("AsymmetricObjectProperty"), "prop", "left_semi").select("subject", "prop", "object")
        parts.append(found(turned.join(turned.toDF("object", "prop", "subject"), ["subject", "prop", "object"], "left_semi"), "asymmetric property both ways", "subject"))
        several = data.join(of("FunctionalDataProperty"), "prop", "left_semi").groupBy("subject", "prop").agg(F.countDistinct("value", "datatype", "lang").alias("n")).where("n > 1")
        parts.append(found(several, "several values of a functional data property", "subject"))
        for kind, rows in (("Object", facts.select("subject", "prop", F.array("object").alias("value"))), ("Data", data.select("subject", "prop", F.array("value", "datatype", "lang").alias("value")))):
            apart = pairwise(self.of(f"Disjoint{kind}Properties")).where("a < b").select("a", "b").distinct()
            # what both of a pair hold: each side keyed by the pair's other property
            left = rows.join(apart.withColumnRenamed("a", "prop"), "prop").select("subject", "value", F.col("b").alias("prop"))
            parts.append(found(left.join(rows, ["subject", "value", "prop"], "left_semi"), "disjoint properties of the same pair", "subject"))
        listed = self.of("DifferentIndividuals").select("axiom_id", F.explode(F.array_distinct("operands")).alias("item")).withColumn("root", F.col("item"))
        listed = root(listed, "root")
        twice = listed.groupBy("axiom_id", "root").count().where("count > 1").select("axiom_id", "root")
        named = found(listed.join(twice, ["axiom_id", "root"], "left_semi"), "different individuals that are one", "item")
        about = reduce(DataFrame.union, [*parts, self._too_many()]).toDF("reason", "item").distinct()
        return rules.spread(about, "item", roots).union(named).toDF("reason", "item").distinct()

    def _too_many(self) -> DataFrame:
        """Individuals of a class "at most n r C" that have over n different ones: values said to differ pairwise are counted."""
        if not self._ops & {"max", "exactly"}:
            return self._none(reason="string", item="string")
        most = self.expressions.where("op in ('max', 'exactly')").select(F.col("expr_id").alias("b"), F.col("prop").alias("r"), F.coalesce("filler", F.lit(THING)).alias("filler"), "card")
        sub, _ = self.saturated()
        roots = self.roots()
        apart = rules.led(rules.led(pairwise(self.of("DifferentIndividuals")).select("a", "b"), "a", roots), "b", roots).distinct()
        held = sub.join(most, "b").select(F.col("a").alias("subject"), F.col("r").alias("prop"), "filler", "card", F.col("b").alias("limit"))
        values = held.join(self.facts(), ["subject", "prop"]).join(sub.toDF("object", "filler"), ["object", "filler"], "left_semi")
        # over n of them that all differ: so it is if one differs from n others that differ from each other, which named lists state at once
        groups = rules.led(self.of("DifferentIndividuals").select("axiom_id", F.explode(F.array_distinct("operands")).alias("object")), "object", roots)
        counted = values.join(groups, "object").groupBy("subject", "prop", "limit", "card", "axiom_id").agg(F.countDistinct("object").alias("n")).where("n > card")
        none = values.where("card = 0").select("subject")
        pairs = values.alias("x").join(values.select("subject", "limit", F.col("object").alias("other")), ["subject", "limit"]).where("card = 1 and object < other")
        pairs = pairs.join(apart.toDF("object", "other"), ["object", "other"], "left_semi").select("subject")
        return counted.select("subject").union(none).union(pairs).distinct().select(F.lit("more than a class allows").alias("reason"), "subject")

    def ignored(self) -> DataFrame:
        """``(axiom_id, axiom_type)`` of the axioms of which the rules use only a part or nothing: not all may be inferred that follows from them.

        Beside kinds that no rule reads (all but ``READ``), these are axioms over data ranges,
        self restrictions and enumerations of several, and, where there are individuals, over
        counts, which are only compared with individuals that are said to differ.
        """
        beyond = self._with("oneof", "self", "datatype").where("op <> 'oneof' or size(operands) > 1").select("expr_id")
        if not self.individuals().isEmpty():
            beyond = beyond.union(self._with("min", "max", "exactly").where("op <> 'min' or card > 1").select("expr_id"))
        inside = self.expressions.select("expr_id", F.explode(F.concat(F.coalesce("operands", F.array().cast("array<string>")), F.array("filler"))).alias("part")).where("part is not null")
        known = settled(beyond)
        while not known.isEmpty():
            more = settled(inside.join(known.toDF("part"), "part", "left_semi").select("expr_id").distinct().join(known, "expr_id", "left_anti"))
            if more.isEmpty():
                break
            known = settled(known.union(more))
        sides = self.axioms.select("axiom_id", "axiom_type", F.explode(F.concat(F.array("a1", "a2"), F.coalesce("operands", F.array().cast("array<string>")))).alias("expr_id"))
        unread = self.axioms.where(~F.col("axiom_type").isin(*READ)).select("axiom_id", "axiom_type")
        return sides.join(known, "expr_id", "left_semi").select("axiom_id", "axiom_type").union(unread).distinct()

    def consistent(self) -> bool:
        return self.clashes().isEmpty()

    def subclasses(self) -> DataFrame:
        """``(src, dst)``: direct superclasses. A class without others has none, as Thing is left out."""
        return direct(self.superclasses(), closed=True)

    def equivalents(self) -> DataFrame:
        """``(a, b)``, in both orders."""
        up = self.superclasses()
        return up.join(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).toDF("a", "b")

    def disjoints(self) -> DataFrame:
        """``(a, b)``, in both orders: below two disjoint classes."""
        told = pairwise(self.of("DisjointClasses")).select("a", "b")
        up = self.superclasses()
        found = inference.inferred_disjoint(up, told)
        named = self.classes()
        return found.join(named, found["a"] == named["iri"], "left_semi").join(named, found["b"] == named["iri"], "left_semi").where("a <> b")

    def types(self) -> DataFrame:
        """``(ind, cls)``: all named classes of all individuals."""
        inds = self.declared.where(F.col("kind") == INDIVIDUAL).select("iri")
        sub = rules.spread(self.saturated()[0].toDF("ind", "cls"), "ind", self.roots())
        return sub.join(inds, sub["ind"] == inds["iri"], "left_semi").join(self.classes().select(F.col("iri").alias("cls")), "cls", "left_semi").select("ind", "cls")

    def values(self) -> DataFrame:
        """``(axiom_type, subject, prop, object, datatype, lang)``: property values of all individuals, those of equal ones and of all superior properties too."""
        roots, nothing = self.roots(), F.lit(None).cast("string")
        named = self.facts().where(~F.startswith("prop", F.lit("inverse(")) & ~F.startswith("prop", F.lit("chain:")))
        objects = rules.spread(rules.spread(named, "subject", roots), "object", roots).select(F.lit("ObjectPropertyAssertion"), "subject", "prop", "object", nothing, nothing)
        given = lambda c: F.when(F.col(c) != "", F.col(c))
        data = rules.spread(self.data_values(), "subject", roots).select(F.lit("DataPropertyAssertion"), "subject", "prop", "value", given("datatype"), given("lang"))
        return objects.union(data).toDF("axiom_type", "subject", "prop", "object", "datatype", "lang")

    def inverse_pairs(self) -> DataFrame:
        """``(a, b)``: inverse object properties, also of equivalents, and symmetric ones of themselves."""
        same = pairwise(self.of("EquivalentObjectProperties")).select("a", "b")
        turned = lambda df: df.union(df.select("b", "a")).distinct()
        widened = lambda df: turned(df.union(df.join(same.toDF("a", "c"), "a").select("c", "b")))
        own = turned(self.inverses().toDF("a", "b").union(self.symmetric().select("p", "p")))
        return widened(widened(own))

    def infer(self, kinds) -> DataFrame:
        """``(axiom_type, a1, a2, a3, operands, datatype, lang)`` of the inference types ``kinds``."""
        nothing = F.lit(None).cast("string")
        none = F.lit(None).cast("array<string>")
        two = lambda df, kind: df.select(F.lit(kind), *df.columns[:2], nothing, none, nothing, nothing)
        pair = lambda df, kind: df.where("a < b").select(F.lit(kind), nothing, nothing, nothing, F.array("a", "b"), nothing, nothing)
        parts = []
        if "subclasses" in kinds:
            parts.append(two(self.subclasses(), "SubClassOf"))
        if "equivalent classes" in kinds:
            parts.append(pair(self.equivalents(), "EquivalentClasses"))
        if "disjoint classes" in kinds:
            parts.append(pair(self.disjoints(), "DisjointClasses"))
        if "subdata properties" in kinds:
            parts.append(two(direct(self.pairs("SubDataPropertyOf").toDF("src", "dst")), "SubDataPropertyOf"))
        if "subobject properties" in kinds:
            parts.append(two(direct(self.pairs("SubObjectPropertyOf").toDF("src", "dst")), "SubObjectPropertyOf"))
        if "inverse object properties" in kinds:
            parts.append(two(self.inverse_pairs(), "InverseObjectProperties"))
        if "types" in kinds:
            parts.append(two(self.types(), "ClassAssertion"))
        if "property values" in kinds:
            v = self.values()
            parts.append(v.select("axiom_type", "subject", "prop", "object", none, "datatype", "lang"))
        empty = self._none(axiom_type="string", a1="string", a2="string", a3="string", operands="array<string>", datatype="string", lang="string")
        return reduce(DataFrame.union, [empty, *parts]).distinct()


def trivial(inferred: DataFrame):
    """Column: whether an inferred axiom names an entity about which nothing can be said."""
    names = F.concat(F.array("a1", "a2", "a3"), F.coalesce("operands", F.array().cast("array<string>")))
    return F.exists(names, lambda x: F.coalesce(x.isin(*TRIVIAL), F.lit(False)))
