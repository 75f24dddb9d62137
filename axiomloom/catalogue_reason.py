"""Registered queries of the reasoner: each has a case that only the axiom kind in its name decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import Tables, iri, query
from .catalogue_terms import _full, _row, named, text
from .operators.reason import Reasoner
from .schema import EXPRESSION


def _expressions(spark, parts: list[DataFrame]) -> DataFrame:
    empty = spark.createDataFrame([], EXPRESSION)
    for p in parts:
        empty = empty.unionByName(p.select(*EXPRESSION.fieldNames()))
    return empty.distinct()


def _expression(df: DataFrame, key, op: str, prop=None, filler=None, card=None, operands=None) -> DataFrame:
    one = lambda x: text(x) if x is None or isinstance(x, str) else x
    none = F.lit(None).cast("array<string>")
    return df.select(key.alias("expr_id"), F.lit(op).alias("op"), text(None).alias("iri"), one(prop).alias("prop"), one(filler).alias("filler"), F.lit(card).cast("int").alias("card"), (none if operands is None else operands).alias("operands"))


def _reasoner(spark, axioms: list[DataFrame], expressions: list[DataFrame] = ()) -> Reasoner:
    return Reasoner(_full(spark, axioms), _expressions(spark, list(expressions)))


def _once(spark, kind: str, *a, **kw) -> DataFrame:
    return _row(spark.range(1), kind, *a, **kw)


@query("SELECT 'assertion and its negation' AS reason, 'orders/' || o_orderkey AS item FROM orders WHERE o_orderkey % 7 = 0")
def clash_of_superior_data_property(spark, sf_dir):
    """What a sub-property says is denied of its superior."""
    o, k = Tables(spark, sf_dir).orders, F.col("o_orderkey")
    order = iri("orders", "o_orderkey")
    parts = [_row(o, "DataPropertyAssertion", order, "priority", F.col("o_orderpriority")), _once(spark, "SubDataPropertyOf", "priority", "rank"), _row(o.where(k % 7 == 0), "DataPropertyAssertion", order, "rank", F.col("o_orderpriority"), negative=True), _row(o.where(k % 7 == 1), "DataPropertyAssertion", order, "rank", "other", negative=True)]
    return _reasoner(spark, parts).clashes()


@query("SELECT 'several values of a functional data property' AS reason, 'supplier/' || s_suppkey AS item FROM supplier WHERE s_suppkey % 2 = 0")
def clash_of_functional_superior(spark, sf_dir):
    """Two sub-properties of a functional data property with different values."""
    s, k = Tables(spark, sf_dir).supplier, F.col("s_suppkey")
    supplier = iri("supplier", "s_suppkey")
    parts = [_row(s, "DataPropertyAssertion", supplier, "name", F.col("s_name")), _row(s, "DataPropertyAssertion", supplier, "title", F.when(k % 2 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))]
    parts += [_once(spark, "SubDataPropertyOf", "name", "called"), _once(spark, "SubDataPropertyOf", "title", "called"), _once(spark, "FunctionalDataProperty", "called")]
    return _reasoner(spark, parts).clashes()


@query("""SELECT 'disjoint properties of the same pair' AS reason, 'customer/' || o_custkey AS item FROM orders WHERE o_orderkey % 11 = 0
 UNION SELECT 'disjoint properties of the same pair', 'orders/' || o_orderkey FROM orders WHERE o_orderkey % 13 = 0""")
def clash_of_disjoint_properties(spark, sf_dir):
    """Disjoint object properties between the same two, one through its inverse; disjoint data properties with the same value."""
    o, k = Tables(spark, sf_dir).orders, F.col("o_orderkey")
    order, owner = iri("orders", "o_orderkey"), iri("customer", "o_custkey")
    parts = [_row(o, "ObjectPropertyAssertion", owner, "placed", order), _row(o.where(k % 11 == 0), "ObjectPropertyAssertion", order, "refused by", owner), _once(spark, "InverseObjectProperties", "refused by", "refused"), _once(spark, "DisjointObjectProperties", operands=F.array(F.lit("placed"), F.lit("refused")))]
    parts += [_row(o, "DataPropertyAssertion", order, "ordered on", F.col("o_orderdate").cast("string")), _row(o, "DataPropertyAssertion", order, "shipped on", F.when(k % 13 == 0, F.col("o_orderdate").cast("string")).otherwise(F.lit("later"))), _once(spark, "DisjointDataProperties", operands=F.array(F.lit("ordered on"), F.lit("shipped on")))]
    return _reasoner(spark, parts).clashes()


@query("SELECT 'supplier/' || s_suppkey AS iri FROM supplier WHERE s_nationkey % 5 = 0")
def unsatisfiable_by_range(spark, sf_dir):
    """Classes that must have a value outside the property's range, which a super-property sets."""
    t = Tables(spark, sf_dir)
    supplier, nation, key = iri("supplier", "s_suppkey"), named("nation/", "s_nationkey"), named("_:in/", "s_nationkey")
    parts = [_row(t.supplier, "Declaration", supplier, "class"), _row(t.supplier, "SubClassOf", supplier, key), _once(spark, "SubObjectPropertyOf", "based in", "somewhere in"), _once(spark, "ObjectPropertyRange", "somewhere in", "Place")]
    parts.append(_row(t.nation.where("n_nationkey % 5 = 0"), "DisjointClasses", operands=F.array(F.lit("Place"), iri("nation", "n_nationkey"))))
    return _reasoner(spark, parts, [_expression(t.supplier, key, "some", "based in", nation)]).unsatisfiable()


@query("""SELECT i || c_custkey AS a1, p AS a2, v AS a3 FROM (SELECT c_custkey, c_name AS v FROM customer UNION SELECT c_custkey, c_mktsegment FROM customer) x, (VALUES ('customer/'), ('account/')) y(i), (VALUES ('says'), ('states')) z(p)""")
def equal_individuals_values(spark, sf_dir):
    """Individuals that are one share their data values, by superior properties too."""
    c = Tables(spark, sf_dir).customer
    one, other = iri("customer", "c_custkey"), named("account/", "c_custkey")
    parts = [_row(c, "SameIndividual", operands=F.array(one, other)), _row(c, "DataPropertyAssertion", one, "says", F.col("c_name")), _row(c, "DataPropertyAssertion", other, "says", F.col("c_mktsegment")), _once(spark, "SubDataPropertyOf", "says", "states")]
    return _reasoner(spark, parts).infer({"property values"}).select("a1", "a2", "a3")


@query("SELECT 'member/' || c_custkey AS ind, 'segment/' || (SELECT min(c_mktsegment) FROM customer) AS cls FROM customer")
def equal_individuals_at_scale(spark, sf_dir):
    """All customers made one by a functional property of one member: types are shared with a row for each."""
    c = Tables(spark, sf_dir).customer
    member, least = named("member/", "c_custkey"), c.agg(F.min("c_mktsegment").alias("s"))
    parts = [_row(c, "Declaration", member, "indiv"), _row(c, "ObjectPropertyAssertion", "club", "has member", member), _once(spark, "FunctionalObjectProperty", "has member"), _row(least, "Declaration", named("segment/", "s"), "class"), _row(least, "ClassAssertion", "member/1", named("segment/", "s"))]
    return _reasoner(spark, parts).types()


@query("""SELECT 'orders/' || o_orderkey AS a1, 'ordered from' AS a2, 'region/' || n_regionkey AS a3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION SELECT 'orders/' || o_orderkey, 'ordered in', 'region/' || n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def property_chain_values(spark, sf_dir):
    """A chain of three properties, its middle one told by its inverse; its superior too."""
    t = Tables(spark, sf_dir)
    parts = [_row(t.orders, "ObjectPropertyAssertion", iri("orders", "o_orderkey"), "placed by", iri("customer", "o_custkey")), _row(t.customer, "ObjectPropertyAssertion", named("nation/", "c_nationkey"), "home of", iri("customer", "c_custkey")), _row(t.nation, "ObjectPropertyAssertion", iri("nation", "n_nationkey"), "part of", named("region/", "n_regionkey"))]
    parts += [_once(spark, "SubPropertyChainOf", "ordered from", operands=F.array(F.lit("placed by"), F.lit("inverse(home of)"), F.lit("part of"))), _once(spark, "SubObjectPropertyOf", "ordered from", "ordered in")]
    found = _reasoner(spark, parts).infer({"property values"}).select("a1", "a2", "a3")
    return found.where("a2 in ('ordered from', 'ordered in')")


@query("SELECT 'supplier/' || s_suppkey AS src, 'from/' || n_regionkey AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def property_chain_subclasses(spark, sf_dir):
    """A chain between restrictions of classes."""
    t = Tables(spark, sf_dir)
    supplier, nation, region = iri("supplier", "s_suppkey"), iri("nation", "n_nationkey"), named("region/", "n_regionkey")
    in_nation, in_region, defined = named("_:in/", "s_nationkey"), named("_:of/", "n_regionkey"), named("_:from/", "n_regionkey")
    parts = [_row(t.supplier, "Declaration", supplier, "class"), _row(t.nation, "Declaration", named("from/", "n_regionkey"), "class"), _row(t.supplier, "SubClassOf", supplier, in_nation), _row(t.nation, "SubClassOf", nation, in_region), _row(t.nation, "EquivalentClasses", operands=F.array(named("from/", "n_regionkey"), defined)), _once(spark, "SubPropertyChainOf", "comes from", operands=F.array(F.lit("based in"), F.lit("part of")))]
    expressions = [_expression(t.supplier, in_nation, "some", "based in", named("nation/", "s_nationkey")), _expression(t.nation, in_region, "some", "part of", region), _expression(t.nation, defined, "some", "comes from", region)]
    return _reasoner(spark, parts, expressions).superclasses()


@query("SELECT 'customer/' || c_custkey AS ind, c AS cls FROM customer, (VALUES ('segment/' || c_mktsegment), ('served/' || c_mktsegment)) v(c)")
def reflexive_property_types(spark, sf_dir):
    """Every individual has a reflexive property to itself, and so what is defined by it."""
    c = Tables(spark, sf_dir).customer
    customer, segment, key, served = iri("customer", "c_custkey"), named("segment/", "c_mktsegment"), named("_:serves/", "c_mktsegment"), named("served/", "c_mktsegment")
    parts = [_row(c, "Declaration", customer, "indiv"), _row(c, "Declaration", segment, "class"), _row(c, "Declaration", served, "class"), _row(c, "ClassAssertion", customer, segment), _row(c, "SubClassOf", key, served), _once(spark, "ReflexiveObjectProperty", "serves"), _once(spark, "SubObjectPropertyOf", "serves", "helps")]
    return _reasoner(spark, [p.distinct() for p in parts], [_expression(c, key, "some", "helps", segment)]).types()


@query("""SELECT i || c_custkey AS ind, c AS cls FROM customer, (VALUES ('customer/'), ('lead/')) x(i), (VALUES ('Party'), ('Customer'), ('Lead')) y(c) WHERE c_custkey % 3 = 0
 UNION SELECT 'customer/' || c_custkey, c FROM customer, (VALUES ('Party'), ('Customer')) y(c) WHERE c_custkey % 3 <> 0 UNION SELECT 'lead/' || c_custkey, c FROM customer, (VALUES ('Party'), ('Lead')) y(c) WHERE c_custkey % 3 <> 0""")
def key_types(spark, sf_dir):
    """Individuals of a class that agree in both properties of its key are one; those that agree in one of them aren't."""
    c, k = Tables(spark, sf_dir).customer, F.col("c_custkey")
    one, other, nation = iri("customer", "c_custkey"), named("lead/", "c_custkey"), named("nation/", "c_nationkey")
    name = F.when(k % 3 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("-")))
    parts = [_row(c, "Declaration", one, "indiv"), _row(c, "Declaration", other, "indiv"), _row(c, "ClassAssertion", one, "Customer"), _row(c, "ClassAssertion", other, "Lead"), _once(spark, "SubClassOf", "Customer", "Party"), _once(spark, "SubClassOf", "Lead", "Party")]
    parts += [_once(spark, "Declaration", x, "class") for x in ("Party", "Customer", "Lead")]
    parts += [_row(c, "DataPropertyAssertion", one, "name", F.col("c_name")), _row(c, "DataPropertyAssertion", other, "name", name), _row(c, "ObjectPropertyAssertion", one, "lives in", nation), _row(c, "ObjectPropertyAssertion", other, "lives in", nation), _once(spark, "HasKey", "Party", operands=F.array(F.lit("name"), F.lit("lives in")))]
    return _reasoner(spark, parts).types()


@query("""WITH s AS (SELECT s_suppkey AS k, 'supplier/' || s_suppkey AS c, s_nationkey AS n FROM supplier)
SELECT c AS src, 'side/' || n AS dst FROM s UNION SELECT c, 'Shipper' FROM s WHERE k % 4 < 2 UNION SELECT c, 'Local' FROM s WHERE k % 4 = 2 UNION SELECT c, 'Combined' FROM s WHERE k % 3 = 0
UNION SELECT w || n_nationkey, 'side/' || n_nationkey FROM nation, (VALUES ('east/'), ('west/')) v(w) UNION SELECT 'Two', 'Many'""")
def disjunctive_subclasses(spark, sf_dir):
    """Superclasses that only cases of a union, an ``only``, a complement or a bound on values give."""
    t, k = Tables(spark, sf_dir), F.col("s_suppkey")
    s, me, nation = t.supplier, iri("supplier", "s_suppkey"), F.col("s_nationkey")
    key, once = lambda name: F.lit(f"_:{name}"), spark.range(1)
    either = named("_:either/", "s_nationkey")
    parts = [_row(s, "Declaration", me, "class")]
    parts += [_row(t.nation, "Declaration", named(w, "n_nationkey"), "class") for w in ("east/", "west/", "side/")] + [_row(t.nation, "SubClassOf", named(w, "n_nationkey"), named("side/", "n_nationkey")) for w in ("east/", "west/")]
    parts += [_once(spark, "Declaration", c, "class") for c in ("Shipper", "Local", "Combined", "Two", "Many")]
    # one of two sides, whichever
    parts.append(_row(s, "SubClassOf", me, either))
    expressions = [_expression(s, either, "or", operands=F.array(F.concat(F.lit("east/"), nation.cast("string")), F.concat(F.lit("west/"), nation.cast("string"))))]
    # what has values, and only places, has a place; who has none is local
    parts += [_row(s.where(k % 4 < 2), "SubClassOf", me, c) for c in ("_:ships", "_:only places")] + [_row(s.where(k % 4 == 2), "SubClassOf", me, "_:no places"), _once(spark, "SubClassOf", "_:to place", "Shipper"), _once(spark, "SubClassOf", "_:never", "Local")]
    expressions += [_expression(once, key("ships"), "some", "ships to", "http://www.w3.org/2002/07/owl#Thing"), _expression(once, key("only places"), "only", "ships to", "Place"), _expression(once, key("to place"), "some", "ships to", "Place"), _expression(once, key("no places"), "only", "ships to", "_:no place"), _expression(once, key("no place"), "not", filler="Place"), _expression(once, key("never"), "not", filler="_:to place")]
    # one value that is both; two that differ
    parts += [_row(s.where(k % 3 == 0), "SubClassOf", me, c) for c in ("_:a", "_:b", "_:one")] + [_once(spark, "SubClassOf", "_:has both", "Combined"), _once(spark, "SubClassOf", "Two", "_:c"), _once(spark, "SubClassOf", "Two", "_:not c"), _once(spark, "SubClassOf", "_:two", "Many")]
    expressions += [_expression(once, key(x), "some", "makes", x.upper()) for x in ("a", "b", "c")] + [_expression(once, key("one"), "max", "makes", card=1), _expression(once, key("both"), "and", operands=F.array(F.lit("A"), F.lit("B"))), _expression(once, key("has both"), "some", "makes", "_:both"), _expression(once, key("other"), "not", filler="C"), _expression(once, key("not c"), "some", "makes", "_:other"), _expression(once, key("two"), "min", "makes", card=2)]
    return _reasoner(spark, parts, expressions).superclasses()


@query("""SELECT 'nation/' || n_nationkey AS ind, 'Coast' AS cls FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'nation/' || n_nationkey, 'Known' FROM nation
UNION SELECT DISTINCT 'supplier/' || s_suppkey, 'Trusted' FROM supplier WHERE s_nationkey % 5 = 0 UNION SELECT DISTINCT 'nation/' || s_nationkey, 'Supplied' FROM supplier WHERE s_nationkey % 5 = 0""")
def disjunctive_types(spark, sf_dir):
    """Types of individuals by the case of a union that is left, by all cases of one, and over assertions by ``only``."""
    t, n, once = Tables(spark, sf_dir), F.col("n_nationkey"), spark.range(1)
    nation, supplier = iri("nation", "n_nationkey"), iri("supplier", "s_suppkey")
    parts = [_row(t.nation, "Declaration", nation, "indiv"), _row(t.supplier, "Declaration", supplier, "indiv")] + [_once(spark, "Declaration", c, "class") for c in ("Coast", "Known", "Trusted", "Supplied")]
    parts += [_row(t.nation, "ClassAssertion", nation, "_:either"), _once(spark, "SubClassOf", "Coast", "Known"), _once(spark, "SubClassOf", "Inland", "Known"), _row(t.nation.where(n % 3 == 0), "ClassAssertion", nation, "_:not inland")]
    parts += [_row(t.nation.where(n % 5 == 0), "ClassAssertion", nation, "_:only trusted"), _row(t.supplier, "ObjectPropertyAssertion", named("nation/", "s_nationkey"), "home of", supplier), _once(spark, "SubClassOf", "_:has trusted", "Supplied")]
    one = lambda name, *a, **kw: _expression(once, F.lit(f"_:{name}"), *a, **kw)
    expressions = [one("either", "or", operands=F.array(F.lit("Coast"), F.lit("Inland"))), one("not inland", "not", filler="Inland"), one("only trusted", "only", "home of", "Trusted"), one("has trusted", "some", "home of", "Trusted")]
    return _reasoner(spark, parts, expressions).types()
