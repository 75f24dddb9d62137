"""What follows from unions, universal and counting restrictions: clauses kept per context, resolved by joins.

A context is a set of literals (names, or names denied); a class is the context of its own
name, individuals share one context in which each literal says of whom it is. A clause
``(ctx, head)`` says that whatever is in the context is one of ``head``: literals, or "has a
value by these properties that is in that context". The calculus is consequence-based
(Simančík, Kazakov and Horrocks, "Consequence-Based Reasoning beyond Horn Ontologies",
2011): every clause follows from the axioms, contexts arise only where a value needs one, and a class is below a
name when the clause with that name alone comes up. Counting adds one rule: of ``n + 1`` values where
``n`` are allowed, one is outside the filler or two are the same value, in both contexts and by both properties.

Axioms are first split by the polarity in which an expression occurs, so an expression that is
only ever implied is never decided. Each round joins new clauses with all, and keeps of a context's
clauses only those of which no other says more (an anti-join on subsets).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..schema import NOTHING, THING

#: Between the parts of an atom (of whom, name) or (of whom, nothing, properties, context), of a context, of its properties.
PART, LITERAL, PROPERTY = "\x1f", "\x1e", "\x1d"
NOT = "\x02"
#: The context that individuals share.
EVERYONE = ""


def _set(*arrays):
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def _atom(who, name):
    return F.concat(who, F.lit(PART), name)


def _value(who, props, ctx):
    """Column: the atom "has a value by all of ``props`` that is in ``ctx``"."""
    return F.concat(who, F.lit(PART), F.lit(PART), F.array_join(_set(props), PROPERTY), F.lit(PART), ctx)


def _context(*literals):
    return F.array_join(_set(*literals), LITERAL)


def polarities(axioms: DataFrame, expressions: DataFrame) -> DataFrame:
    """``(expr_id, implied)``: whether an expression follows from something in ``axioms`` (true) or something from it (false); two rows if both."""
    side = lambda e, *implied: F.explode(F.array(*[F.struct(e.alias("expr_id"), F.lit(i).alias("implied")) for i in implied])).alias("s")
    of = lambda *kinds: axioms.where(F.col("axiom_type").isin(*kinds))
    rows = [of("SubClassOf", "HasKey").select(side(F.col("a1"), False)), of("SubClassOf", "ClassAssertion", "ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain").select(side(F.col("a2"), True))]
    several = lambda *kinds: of(*kinds).select(F.explode("operands").alias("e"))
    rows += [several("EquivalentClasses").select(side(F.col("e"), True, False)), several("DisjointClasses").select(side(F.col("e"), False))]
    known = fresh = settled(reduce(DataFrame.union, rows).select("s.*").distinct().join(expressions.select("expr_id"), "expr_id", "left_semi"))
    # of an expression's parts: alike in most, turned in complements and upper bounds, both in exact counts
    parts = expressions.select("expr_id", F.explode(F.concat(F.coalesce("operands", F.array().cast("array<string>")), F.array("filler"))).alias("part"), F.explode(F.when(F.col("op").isin("not", "max"), F.array(F.lit(True))).when(F.col("op") == "exactly", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("turned"))
    parts = settled(parts.join(expressions.select(F.col("expr_id").alias("part")), "part", "left_semi"))
    while not fresh.isEmpty():
        fresh = settled(fresh.join(parts, "expr_id").select(F.col("part").alias("expr_id"), (F.col("implied") != F.col("turned")).alias("implied")).distinct().join(known, ["expr_id", "implied"], "left_anti"))
        known = known.union(fresh)
    return settled(known)


def beyond_horn(expressions: DataFrame, polarity: DataFrame) -> DataFrame:
    """``(expr_id)`` of the expressions that the completion rules don't use in full."""
    used = expressions.join(polarity, "expr_id")
    hard = (F.col("op") == "or") & F.col("implied") | (F.col("op") == "not") & ~F.col("implied") | F.col("op").isin("only", "max", "exactly") | (F.col("op") == "min") & (F.col("card") != 1)
    return used.where(hard).select("expr_id").distinct()


class Clauses:
    """The saturated clauses of the axioms of a reasoner, whose tables of individuals and properties they use.

    ``up(r, s)`` are the properties above each, itself included; ``facts`` and ``types(ind, cls)`` are about roots.
    """

    def __init__(self, axioms: DataFrame, expressions: DataFrame, polarity: DataFrame, classes: DataFrame, up: DataFrame, facts: DataFrame, types: DataFrame, individuals: DataFrame, transitive: DataFrame, empty: DataFrame):
        self.spark = axioms.sparkSession
        self.up, self.facts, self.individuals = settled(up), facts, individuals
        self.told = {k: settled(v.distinct()) for k, v in self._split(axioms, expressions, polarity, transitive, empty).items()}
        first = [classes.select(F.col("iri").alias("ctx")), self.spark.range(1).select(F.lit(THING).alias("ctx"))]
        self.contexts = settled(reduce(DataFrame.union, first).distinct())
        told = types.select(F.lit(EVERYONE).alias("ctx"), F.array(_atom(F.col("ind"), F.col("cls"))).alias("head"))
        told = told.union(individuals.select(F.lit(EVERYONE), F.array(_atom(F.col("iri"), F.lit(THING)))))
        self.known = self._saturated(self._beginnings(self.contexts).union(told))

    def _split(self, axioms, expressions, polarity, transitive, empty) -> dict[str, DataFrame]:
        """The axioms as tables: ``one`` and ``two`` names imply one of ``any``; ``exist``, ``all`` and ``most`` of a name; ``lhs``: who has a value of a name."""
        from .relations import pairwise

        of = lambda *kinds: axioms.where(F.col("axiom_type").isin(*kinds))
        x = expressions.withColumn("filler", F.coalesce("filler", F.lit(THING)))
        implied = lambda *ops: x.where(F.col("op").isin(*ops)).join(polarity.where("implied").select("expr_id"), "expr_id", "left_semi")
        implying = lambda *ops: x.where(F.col("op").isin(*ops)).join(polarity.where("not implied").select("expr_id"), "expr_id", "left_semi")
        e, filler, top, none = F.col("expr_id"), F.col("filler"), F.lit(THING), F.array().cast("array<string>")
        off = lambda c, sign: F.concat(c, F.lit(sign))  # noqa: E731 -- a name that stands for what is not, or for one of several
        one = [of("SubClassOf").select("a1", F.array("a2")), pairwise(of("EquivalentClasses")).select("a", F.array("b"))]
        two = [pairwise(of("DisjointClasses")).select("a", "b", none)]
        lhs = [of("ObjectPropertyDomain", "DataPropertyDomain").select("a1", top, "a2")]
        every = [of("ObjectPropertyRange").select(top, "a1", "a2")]
        most = [of("FunctionalObjectProperty").select(top, F.lit(1), "a1", top)]
        exist = [implied("some", "value").select(e, "prop", F.array(filler))]
        # intersections and unions
        one += [implied("and").select(e, F.explode("operands")).select("expr_id", F.array("col")), implied("or").select(e, "operands"), implying("or").select(F.explode("operands"), F.array(e))]
        step = lambda k: F.when(k == F.size("operands") - 1, e).otherwise(F.concat(e, F.lit("#"), k.cast("string")))
        parts = implying("and").select(e, "operands", F.posexplode("operands").alias("k", "c"))
        two.append(parts.where("k > 0").select(F.when(F.col("k") == 1, F.element_at("operands", 1)).otherwise(step(F.col("k") - 1)), "c", F.array(step(F.col("k")))))
        one.append(parts.where("k = 0 and size(operands) = 1").select("c", F.array(e)))
        # complements
        two.append(implied("not").select(e, filler, none))
        one.append(implying("not").select(top, F.array(e, filler)))
        # values
        lhs.append(implying("some", "value").select("prop", filler, e))
        every.append(implied("only").select(e, "prop", filler))
        one.append(implying("only").select(top, F.array(e, off(e, "~"))))
        exist.append(implying("only").select(off(e, "~"), "prop", F.array(off(filler, "~"))))
        two.append(implying("only").select(off(filler, "~"), filler, none))

        def at_least(rows, name, n):
            """``name`` has ``n`` values, each with a mark of its own that no other has."""
            marks = rows.select(name.alias("x"), "prop", filler, F.explode(F.sequence(F.lit(1), n)).alias("i"), n.alias("n")).where("i <= n and n > 0")
            mark = lambda i: F.concat("x", F.lit("^"), i.cast("string"))
            exist.append(marks.select("x", "prop", F.when(F.col("n") == 1, F.array("filler")).otherwise(F.array(F.col("filler"), mark(F.col("i"))))))
            pairs = marks.where("n > 1").select("x", "i", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j")).where("i < j")
            two.append(pairs.select(mark(F.col("i")), mark(F.col("j")), none))

        def at_most(rows, name, n):
            most.append(rows.where(n > 0).select(name, n, "prop", filler))
            every.append(rows.where(n == 0).select(name, "prop", off(filler, "~")))
            two.append(rows.where(n == 0).select(off(filler, "~"), filler, none))

        card = F.col("card")
        at_least(implied("min", "exactly").where("card > 0"), e, card)
        at_most(implied("max", "exactly"), e, card)
        one.append(implying("min").where("card = 0").select(top, F.array(e)))
        lhs.append(implying("min").where("card = 1").select("prop", filler, e))
        fewer, others = implying("min").where("card > 1"), implying("max")
        one += [fewer.select(top, F.array(e, off(e, "~"))), others.select(top, F.array(e, off(e, "~")))]
        at_most(fewer, off(e, "~"), card - 1)
        at_least(others, off(e, "~"), card + 1)
        exact = implying("exactly")
        one.append(exact.select(top, F.when(card > 0, F.array(e, off(e, "~"), off(e, "~~"))).otherwise(F.array(e, off(e, "~")))))
        at_least(exact, off(e, "~"), card + 1)
        at_most(exact.where("card > 0"), off(e, "~~"), card - 1)

        named = lambda frames, *names: reduce(DataFrame.union, frames).toDF(*names)
        every, lhs = named(every, "a", "s", "b"), named(lhs, "s", "c", "b")
        # a transitive property below the one in question hands its demand on by names of its own
        steps = self.up.join(transitive.select(F.col("prop").alias("r")).distinct(), "r")
        on = settled(every.join(steps, "s").select("a", "r", "b", F.concat_ws("@", "b", "r").alias("q")))
        back = settled(lhs.join(steps, "s").select("r", "c", "b", F.concat_ws("@", "c", "b", "r").alias("q")))
        every = every.union(on.select("a", "r", "q")).union(on.select("q", "r", "q"))
        lhs = lhs.union(back.select("r", "c", "q")).union(back.select("r", "q", "q"))
        one += [on.select("q", F.array("b")), back.select("q", F.array("b"))]
        exist = named(exist, "a", "r", "with").join(empty.withColumnRenamed("prop", "r").withColumn("never", F.lit(True)), "r", "left")
        one.append(exist.where("never").select("a", none))
        two = named(two, "a", "b", "any")
        return {
            "one": named(one, "name", "any").where(F.col("name") != NOTHING),
            "two": two.union(two.select("b", "a", "any")).toDF("name", "other", "any"),
            "exist": exist.where("never is null").select(F.col("a").alias("name"), "r", "with"),
            "all": every.join(self.up, "s").select(F.col("a").alias("name"), "r", "b"),
            "lhs": lhs.join(self.up, "s").select("r", F.col("c").alias("name"), "b"),
            "most": named(most, "name", "n", "s", "filler"),
        }

    def _beginnings(self, contexts: DataFrame) -> DataFrame:
        """What holds in a context at once: its literals, and Thing."""
        literals = F.filter(F.split("ctx", LITERAL), lambda c: ~F.startswith(c, F.lit(NOT)))
        return contexts.select("ctx", F.explode(F.array_distinct(F.concat(literals, F.array(F.lit(THING))))).alias("c")).select("ctx", F.array(_atom(F.lit(""), F.col("c"))).alias("head"))

    @staticmethod
    def _literals(clauses: DataFrame) -> DataFrame:
        """``(ctx, who, name, rest)`` of each literal of each clause."""
        each = clauses.select("ctx", "head", F.explode("head").alias("atom")).withColumn("part", F.split("atom", PART)).where("size(part) = 2")
        return each.select("ctx", F.col("part")[0].alias("who"), F.col("part")[1].alias("name"), F.array_remove("head", F.col("atom")).alias("rest"))

    @staticmethod
    def _values(clauses: DataFrame) -> DataFrame:
        """``(ctx, who, r, props, k, atom, rest)`` of each value of each clause, a row for each of its properties."""
        each = clauses.select("ctx", "head", F.explode("head").alias("atom")).withColumn("part", F.split("atom", PART)).where("size(part) = 4")
        each = each.select("ctx", F.col("part")[0].alias("who"), F.split(F.col("part")[2], PROPERTY).alias("props"), F.col("part")[3].alias("k"), "atom", F.array_remove("head", F.col("atom")).alias("rest"))
        return each.select("*", F.explode("props").alias("r"))

    def _rules(self, new: DataFrame, known: DataFrame) -> list[DataFrame]:
        """Conclusions ``(ctx, head)`` from ``new`` clauses with ``known`` ones, which include them."""
        t = self.told
        lit, lits, val, vals = settled(self._literals(new)), settled(self._literals(known)), settled(self._values(new)), settled(self._values(known))
        who, rest = F.col("who"), F.col("rest")
        also = lambda names: F.transform(names, lambda n: _atom(who, n))
        literals = lambda k: F.split(k, LITERAL)
        out = [
            lit.join(t["one"], "name").select("ctx", _set(rest, also(F.col("any")))),
            lit.join(t["two"], "name").withColumnRenamed("rest", "rest1").join(lits.withColumnRenamed("name", "other"), ["ctx", "who", "other"]).select("ctx", _set(F.col("rest1"), rest, also(F.col("any")))),
            lit.join(t["exist"], "name").select("ctx", _set(rest, F.array(_value(who, F.array("r"), _context(F.col("with")))))),
            lit.where(F.contains("ctx", F.lit(NOT)) & F.array_contains(literals(F.col("ctx")), F.concat(F.lit(NOT), F.col("name")))).select("ctx", "rest"),
        ]
        asks = lambda l: l.join(t["all"], "name").select("ctx", "who", "r", "b", F.col("rest").alias("rest1"))
        for a, v in ((asks(lit), vals), (asks(lits), val)):
            met = a.join(v, ["ctx", "who", "r"]).where(~F.array_contains(literals(F.col("k")), F.col("b")))
            narrower = F.when(F.col("b") == NOTHING, F.array().cast("array<string>")).otherwise(F.array(_value(who, F.col("props"), _context(literals(F.col("k")), F.array("b")))))
            out.append(met.select("ctx", _set(F.col("rest1"), rest, narrower)))
        inside = lambda l: l.where("who = ''").groupBy(F.col("ctx").alias("k"), "name").agg(F.max(F.size("rest") == 0).alias("sure"))
        denied = F.concat(F.lit(NOT), F.col("name"))
        for v, l in ((val, lits), (vals, lit)):
            met = v.join(t["lhs"], "r").join(inside(l), ["k", "name"]).where(~F.array_contains(literals(F.col("k")), denied))
            other = F.when(F.col("sure") | (F.col("name") == THING), F.array().cast("array<string>")).otherwise(F.array(_value(who, F.col("props"), _context(literals(F.col("k")), F.array(denied)))))
            out.append(met.select("ctx", _set(rest, F.array(_atom(who, F.col("b"))), other)))
        nothing = lambda c: c.where("size(head) = 0").select(F.col("ctx").alias("k"))
        out += [val.join(nothing(known), "k").select("ctx", "rest"), vals.join(nothing(new), "k").select("ctx", "rest")]
        # between individuals
        own = lit.where(F.col("ctx") == EVERYONE)
        out.append(own.join(t["all"], "name").join(self.facts.toDF("who", "r", "object"), ["who", "r"]).select("ctx", _set(rest, F.array(_atom(F.col("object"), F.col("b"))))))
        out.append(own.join(t["lhs"], "name").join(self.facts.toDF("subject", "r", "who"), ["who", "r"]).select("ctx", _set(rest, F.array(_atom(F.col("subject"), F.col("b"))))))
        return out + self._counted(lits, vals, settled(lit.select("ctx").union(val.select("ctx")).distinct()))

    def _counted(self, lits: DataFrame, vals: DataFrame, changed: DataFrame) -> list[DataFrame]:
        """Conclusions from counting in the ``changed`` contexts: of ``n + 1`` values one is outside the filler, or two are one."""
        most = self.told["most"]
        bounds = [r[0] for r in most.select("n").distinct().collect()]  # the different bounds that the axioms name
        if not bounds:
            return []
        asks = lits.join(changed, "ctx", "left_semi").join(most, "name").select("ctx", "who", "n", "s", "filler", F.col("rest").alias("rest0"))
        held = vals.join(changed, "ctx", "left_semi").join(self.up, "r").select("ctx", "who", "s", "props", "k", "atom", "rest").distinct()
        held = settled(held.select("ctx", "who", "s", F.struct("atom", "props", "k", "rest").alias("v")))
        out = []
        for n in sorted(bounds):
            several = asks.where(F.col("n") == n).withColumn("vs", F.array().cast(f"array<{held.schema['v'].dataType.simpleString()}>"))
            for i in range(n + 1):
                several = several.join(held, ["ctx", "who", "s"])
                several = several if not i else several.where(F.element_at("vs", -1)["atom"] < F.col("v.atom"))
                several = several.withColumn("vs", F.concat("vs", F.array("v"))).drop("v")
            who, literals = F.col("who"), lambda v: F.split(v["k"], LITERAL)
            outside = F.when(F.col("filler") == THING, F.array().cast("array<string>")).otherwise(F.transform("vs", lambda v: _value(who, v["props"], _context(literals(v), F.array(F.concat(F.lit(NOT), F.col("filler")))))))
            pairs = [(i, j) for i in range(n + 1) for j in range(i)]
            joined = F.array(*[_value(who, F.concat(F.col("vs")[i]["props"], F.col("vs")[j]["props"]), _context(literals(F.col("vs")[i]), literals(F.col("vs")[j]))) for i, j in pairs])
            rests = F.flatten(F.transform("vs", lambda v: v["rest"]))
            out.append(several.select("ctx", _set(F.col("rest0"), rests, outside, joined)))
        return out

    @staticmethod
    def _said_already(clauses: DataFrame, by: DataFrame) -> DataFrame:
        """``(ctx, head)`` of the ``clauses`` of which a clause in ``by`` is a proper part."""
        each = clauses.select("ctx", "head", F.explode("head").alias("atom"))
        parts = by.where("size(head) > 0").select("ctx", F.col("head").alias("part"), F.col("head")[0].alias("atom"))
        less = each.join(parts, ["ctx", "atom"]).where((F.size("part") < F.size("head")) & (F.size(F.array_except("part", "head")) == 0)).select("ctx", "head")
        none = clauses.where("size(head) > 0").join(by.where("size(head) = 0").select("ctx").distinct(), "ctx", "left_semi").select("ctx", "head")
        return less.union(none).distinct()

    def _saturated(self, first: DataFrame) -> DataFrame:
        known = first.where("false").toDF("ctx", "head")
        found = first
        while True:
            plain = found.toDF("ctx", "head").select("ctx", F.array_sort(F.filter("head", lambda a: ~F.endswith(a, F.lit(PART + NOTHING)))).alias("head"))
            says = (F.size("head") < 2) | ~F.exists("head", lambda a: F.endswith(a, F.lit(PART + THING)))
            found = settled(plain.where(says).distinct().join(known, ["ctx", "head"], "left_anti"))
            if found.isEmpty():
                return known
            new = settled(found.join(self._said_already(found, known.union(found)), ["ctx", "head"], "left_anti"))
            if new.isEmpty():
                return known
            known = settled(known.join(self._said_already(known, new), ["ctx", "head"], "left_anti").union(new))
            reached = settled(self._values(new).select(F.col("k").alias("ctx")).distinct().join(self.contexts, "ctx", "left_anti"))
            self.contexts = self.contexts.union(reached)
            found = reduce(DataFrame.union, [*self._rules(new, known), self._beginnings(reached)])

    def subsumptions(self) -> DataFrame:
        """``(a, b)``: a class or individual and a name that it is below; Nothing for those that can't be."""
        short = self.known.where("size(head) < 2").withColumn("part", F.split(F.element_at(F.concat("head", F.array(F.lit(PART + NOTHING))), 1), PART)).where("size(part) = 2")
        own = short.where((F.col("ctx") != EVERYONE) & ~F.contains("ctx", F.lit(LITERAL)) & ~F.startswith("ctx", F.lit(NOT))).select(F.col("ctx").alias("a"), F.col("part")[1].alias("b"))
        shared = short.where((F.col("ctx") == EVERYONE) & (F.size("head") == 1)).select(F.col("part")[0], F.col("part")[1])
        found = own.union(shared)
        if not self.known.where((F.col("ctx") == EVERYONE) & (F.size("head") == 0)).isEmpty():
            found = found.union(self.individuals.select("iri", F.lit(NOTHING)))
        return found.toDF("a", "b").distinct()
