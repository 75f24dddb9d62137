"""Further registered queries: term tables of every kind, relations of properties, property inference, text functions; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import PLACES, SHORTCUTS, Tables, _shortcuts, _union, iri, places, query
from .functions.delimited import split_delimited, unquoted
from .functions.identifiers import is_absolute_iri, is_iri_reference, is_label, is_true, label_prefix, label_text, prefix_root
from .functions.porter import stem_words
from .operators import compile as terms
from .operators import relations, search, store
from .operators.reason import Reasoner
from .plans.checkpoints import settled
from .schema import AXIOM, EXPRESSION, LABEL, SEARCHED

_TEXT = "CAST(NULL AS VARCHAR)"


def text(value) -> F.Column:
    return F.lit(value).cast("string")


def named(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _shown(table: DataFrame) -> DataFrame:
    return terms.compiled(terms.term_rows(table))


@query(f"""WITH p AS (SELECT DISTINCT 'TYPE:' || p_type AS id, p_type, 'SIZE:' || p_size AS size, 'BRAND:' || p_brand AS brand, p_partkey FROM part)
SELECT DISTINCT 'Declaration' AS axiom_type, id AS a1, 'class' AS a2, {_TEXT} AS a3 FROM p UNION SELECT 'SubClassOf', id, size, NULL FROM p UNION SELECT 'SubClassOf', 'MADE:' || p_partkey, id, NULL FROM p
UNION SELECT 'EquivalentClasses', id, brand, NULL FROM p UNION SELECT 'DisjointClasses', id, 'NOT ' || p_type, NULL FROM p UNION SELECT 'DisjointClasses', id, 'OTHER', NULL FROM p UNION SELECT 'AnnotationAssertion', id, '{LABEL}', p_type FROM p""")
def compile_classes(spark, sf_dir):
    """Rows of classes: superior, inferior, equivalent and disjoint ones."""
    p = Tables(spark, sf_dir).part
    return _shown(p.select(named("TYPE:", "p_type").alias("ID"), F.lit(" class ").alias("Type"), F.concat(F.lit("'"), "p_type", F.lit("'")).alias("Label"), named("SIZE:", "p_size").alias("Subclass of"), named("MADE:", "p_partkey").alias("Superclass of"), named("BRAND:", "p_brand").alias("Equivalent to"), F.concat(F.lit("NOT "), "p_type", F.lit("; OTHER ;")).alias("Disjoint with")))


@query(f"""WITH s AS (SELECT 'SUP:' || s_suppkey AS id, s_suppkey AS k, s_nationkey AS n, s_name FROM supplier)
SELECT 'Declaration' AS axiom_type, id AS a1, 'oprop' AS a2, {_TEXT} AS a3 FROM s UNION SELECT 'AnnotationAssertion', id, '{LABEL}', s_name FROM s UNION SELECT 'SubObjectPropertyOf', id, 'NATION:' || n, NULL FROM s
UNION SELECT 'SubObjectPropertyOf', id, 'UP:' || k % 7, NULL FROM s UNION SELECT 'SubObjectPropertyOf', 'DOWN:' || k % 3, id, NULL FROM s UNION SELECT 'DisjointObjectProperties', id, 'SUP:' || (k + 1), NULL FROM s
UNION SELECT 'InverseObjectProperties', id, 'INV:' || k, NULL FROM s UNION SELECT 'ObjectPropertyDomain', id, 'DOM:' || n, NULL FROM s UNION SELECT 'ObjectPropertyRange', id, 'RAN:' || n, NULL FROM s""")
def compile_object_properties(spark, sf_dir):
    """Rows of object properties: superior, inferior, disjoint, inverse ones, domains and ranges."""
    s, k = Tables(spark, sf_dir).supplier, F.col("s_suppkey")
    return _shown(s.select(named("SUP:", k).alias("ID"), F.lit("Object Property").alias("Type"), F.col("s_name").alias("Label"), named("NATION:", "s_nationkey").alias("Parent"), named("UP:", k % 7).alias("Subproperty of"), named("DOWN:", k % 3).alias("Superproperty of"), named("SUP:", k + 1).alias("Disjoint with"), named("INV:", k).alias("Inverse"), named("DOM:", "s_nationkey").alias("Domain"), named("RAN:", "s_nationkey").alias("Range")))


@query(f"""WITH c AS (SELECT 'CUST:' || c_custkey AS id, c_custkey AS k, c_nationkey AS n, c_mktsegment AS seg FROM customer)
SELECT 'Declaration' AS axiom_type, id AS a1, 'dprop' AS a2, {_TEXT} AS a3 FROM c UNION SELECT 'SubDataPropertyOf', id, 'NATION:' || n, NULL FROM c UNION SELECT 'DisjointDataProperties', id, 'CUST:' || (k + 1), NULL FROM c
UNION SELECT 'DataPropertyDomain', id, 'SEG:' || seg, NULL FROM c UNION SELECT 'DataPropertyRange', id, 'xsd:string', NULL FROM c UNION SELECT 'FunctionalDataProperty', id, NULL, NULL FROM c WHERE k % 2 = 0""")
def compile_data_properties(spark, sf_dir):
    """Rows of data properties: superior and disjoint ones, domains, ranges, and which are functional."""
    c, k = Tables(spark, sf_dir).customer, F.col("c_custkey")
    return _shown(c.select(named("CUST:", k).alias("ID"), F.lit("DataProperty").alias("Type"), named("NATION:", "c_nationkey").alias("Parent"), named("CUST:", k + 1).alias("Disjoint with"), named("SEG:", "c_mktsegment").alias("Domain"), F.lit("xsd:string").alias("Range"), F.when(k % 2 == 0, " Functional ").otherwise("").alias("Characteristics")))


@query(f"""WITH n AS (SELECT 'NOTE:' || n_nationkey AS id, 'REGION:' || n_regionkey AS up, n_nationkey AS k, n_name FROM nation)
SELECT 'Declaration' AS axiom_type, id AS a1, 'aprop' AS a2, {_TEXT} AS a3 FROM n UNION SELECT 'SubAnnotationPropertyOf', id, up, NULL FROM n UNION SELECT 'SubAnnotationPropertyOf', 'LOW:' || k, id, NULL FROM n
UNION SELECT 'AnnotationAssertion', id, 'http://www.w3.org/2000/01/rdf-schema#comment', n_name FROM n UNION SELECT 'AnnotationAssertion', id, 'http://www.w3.org/2000/01/rdf-schema#comment', 'about; ' || n_name FROM n""")
def compile_annotation_properties(spark, sf_dir):
    """Rows of annotation properties: superior and inferior ones, quoted comments."""
    n = Tables(spark, sf_dir).nation
    return _shown(n.select(named("NOTE:", "n_nationkey").alias("ID"), F.lit("ANNOTATION PROPERTY").alias("Type"), named("REGION:", "n_regionkey").alias("Parent"), named("LOW:", "n_nationkey").alias("Superproperty of"), F.concat("n_name", F.lit('; "about; '), "n_name", F.lit('"')).alias("Comments")))


@query(f"""WITH c AS (SELECT 'CUST:' || c_custkey AS id, c_name, 'SEG:' || c_mktsegment AS seg, 'NATION:' || c_nationkey AS n FROM customer)
SELECT 'Declaration' AS axiom_type, id AS a1, 'indiv' AS a2, {_TEXT} AS a3 FROM c UNION SELECT 'AnnotationAssertion', id, '{LABEL}', c_name FROM c UNION SELECT 'ClassAssertion', id, seg, NULL FROM c UNION SELECT 'ClassAssertion', id, n, NULL FROM c
UNION SELECT 'AnnotationAssertion', id, 'note:kind', seg FROM c""")
def compile_individuals(spark, sf_dir):
    """Rows of individuals: their types, and a column of an annotation property's own."""
    c = Tables(spark, sf_dir).customer
    return _shown(c.select(named("CUST:", "c_custkey").alias("ID"), F.lit("Individual").alias("Type"), F.col("c_name").alias("Label"), F.concat(named("SEG:", "c_mktsegment"), F.lit(" ; "), named("NATION:", "c_nationkey")).alias("Instance of"), named("SEG:", "c_mktsegment").alias("@note:kind")))


CHARACTERISTIC = "'Functional', 'InverseFunctional', 'Reflexive', 'Irreflexive', 'Symmetric', 'Asymmetric', 'Transitive'"


@query(f"""WITH p AS (SELECT 'PART:' || p_partkey AS id, [{CHARACTERISTIC}][1 + p_partkey::INT % 7] AS a, [{CHARACTERISTIC}][1 + p_size % 7] AS b FROM part)
SELECT id AS a1, a || 'ObjectProperty' AS axiom_type FROM p UNION SELECT id, b || 'ObjectProperty' FROM p""")
def property_characteristics(spark, sf_dir):
    """The characteristics that rows of object properties name, each once."""
    names = F.array(*[F.lit(x) for x in terms.CHARACTERISTICS])
    p = Tables(spark, sf_dir).part
    pick = lambda k: F.element_at(names, (F.col(k) % 7 + 1).cast("int"))
    rows = p.select(named("PART:", "p_partkey").alias("ID"), F.lit("object property").alias("Type"), F.concat(F.initcap(pick("p_partkey")), F.lit(" ,, "), pick("p_size")).alias("Characteristics"))
    return _shown(rows).where(F.col("axiom_type").isin(*store.CHARACTERISTICS)).select("a1", "axiom_type")


@query("SELECT CASE WHEN event_id % 10 = 0 THEN '' ELSE 'EVENT:' || event_id END AS id, CASE WHEN event_id % 3 = 0 THEN 'Class' ELSE event_type END AS type FROM events WHERE event_id % 3 <> 0 OR event_id % 10 = 0")
def bad_term_rows(spark, sf_dir):
    """Rows of a table that describe no term: their type isn't one, or they have no identifier."""
    e, k = Tables(spark, sf_dir).events, F.col("event_id")
    rows = terms.term_rows(e.select(F.when(k % 10 == 0, " ").otherwise(named("EVENT:", k)).alias(" id"), F.when(k % 3 == 0, " Class").otherwise(F.col("event_type")).alias("TYPE ")))
    return terms.bad_rows(rows).select("id", "type")


@query("""WITH k AS (SELECT 'ROW:' || p_partkey AS id, ['yes', ' TRUE', 'T', 'y ', 'no', '', 'x', NULL][1 + p_partkey::INT % 8] AS cell, p_partkey % 8 AS k FROM part) SELECT id, k < 4 AS ignored FROM k""")
def boolean_cells(spark, sf_dir):
    """What cells mean yes."""
    k = F.col("p_partkey") % 8
    cell = F.element_at(F.array(*[F.lit(x) for x in ("yes", " TRUE", "T", "y ", "no", "", "x", None)]), (k + 1).cast("int"))
    return Tables(spark, sf_dir).part.select(named("ROW:", "p_partkey").alias("id"), is_true(cell).alias("ignored"))


@query("""SELECT p_partkey, v AS value FROM (SELECT p_partkey, unnest([p_name, '"' || p_type || '; ' || p_brand || '"', p_brand || '; more', 'say \\"' || p_size || '\\"']) AS v FROM part)""")
def delimited_parse_quoted(spark, sf_dir):
    """Quotes protect delimiters, a backslash does for one; what is empty goes."""
    cell = F.concat("p_name", F.lit(' ; "'), "p_type", F.lit("; "), "p_brand", F.lit('";; '), "p_brand", F.lit("\\; more ;say \\\""), F.col("p_size").cast("string"), F.lit('\\";'))
    return Tables(spark, sf_dir).part.select("p_partkey", F.explode(split_delimited(cell)).alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a "' || p_name || '"' WHEN 2 THEN '"' || p_name ELSE p_name || '"' END AS value FROM part""")
def unquote_values(spark, sf_dir):
    """Values without the quotes around them; half quoted ones stay."""
    k, name, q = F.col("p_partkey") % 4, F.col("p_name"), F.lit('"')
    cell = F.when(k == 0, F.concat(q, name, q)).when(k == 1, F.concat(F.lit('"a \\"'), name, F.lit('\\""'))).when(k == 2, F.concat(q, name)).otherwise(F.concat(name, q))
    return Tables(spark, sf_dir).part.select("p_partkey", unquoted(cell).alias("value"))


@query("""SELECT p_partkey, p_partkey % 5 IN (0, 2, 4) AS reference, p_partkey % 5 IN (0, 4) AS absolute FROM part""")
def iri_validation(spark, sf_dir):
    """What can be an IRI reference, and which of them are absolute."""
    k, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("http://x.org/"), key)).when(k == 1, F.concat(F.lit("http://x.org/a b"), key)).when(k == 2, F.concat(F.lit("rel/"), key, F.lit("#f"))).when(k == 3, F.concat(F.lit("x:"), key, F.lit("%zz"))).otherwise(F.concat(F.lit("urn:x:"), key, F.lit("%2F")))
    return Tables(spark, sf_dir).part.select("p_partkey", is_iri_reference(name).alias("reference"), is_absolute_iri(name).alias("absolute"))


@query("""SELECT p_partkey, p_partkey % 3 < 2 AS labelled, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE '' END AS label, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE '' END AS prefix,
 'http://purl.obolibrary.org/obo/' || p_brand AS root FROM part""")
def label_detection(spark, sf_dir):
    """Quoted labels, with and without a prefix, and what a prefix stands for."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    said = F.when(k == 0, F.concat(F.lit("'"), name, F.lit("'"))).when(k == 1, F.concat("p_brand", F.lit(":'"), name, F.lit("'"))).otherwise(name)
    return Tables(spark, sf_dir).part.select("p_partkey", is_label(said).alias("labelled"), label_text(said).alias("label"), label_prefix(said).alias("prefix"), prefix_root(F.col("p_brand")).alias("root"))


#: Words and their Porter stems, in SQL's notation; fixed values of the published algorithm.
STEMS = """('caresses', 'caress'), ('ponies', 'poni'), ('ties', 'tie'), ('cats', 'cat'), ('feed', 'feed'), ('agreed', 'agre'), ('plastered', 'plaster'), ('motoring', 'motor'), ('conflated', 'conflat'), ('hopping', 'hop'),
 ('falling', 'fall'), ('hissing', 'hiss'), ('failing', 'fail'), ('filing', 'file'), ('relational', 'relat'), ('conditional', 'condit'), ('digitizer', 'digit'), ('radically', 'radic'), ('operator', 'oper'), ('hopefulness', 'hope'),
 ('formality', 'formal'), ('triplicate', 'triplic'), ('electrical', 'electr'), ('goodness', 'good'), ('revival', 'reviv'), ('allowance', 'allow'), ('adjustable', 'adjust'), ('replacement', 'replac'), ('adoption', 'adopt'), ('effective', 'effect'),
 ('probate', 'probat'), ('controll', 'control'), ('roll', 'roll')"""


@query(f"SELECT n_nationkey, word, stem FROM nation, (VALUES {STEMS}) v(word, stem)")
def stem_published_words(spark, sf_dir):
    """The published examples of the stemmer's rules, for every nation."""
    import re

    words = F.array(*[F.lit(w) for w, _ in re.findall(r"\('(\w+)', '(\w+)'\)", STEMS)])
    return Tables(spark, sf_dir).nation.select("n_nationkey", F.explode(words).alias("word")).withColumn("stem", stem_words(F.col("word")))


def _property_axioms(spark, sf_dir, kind: str) -> DataFrame:
    """Suppliers as properties of a kind: superior, equivalent, disjoint ones, domains, ranges, inverses."""
    s, k = Tables(spark, sf_dir).supplier, F.col("s_suppkey")
    p, nothing = iri("supplier", "s_suppkey"), F.lit(None).cast("array<string>")
    row = lambda t, a1, a2, ops=nothing: s.select(F.lit(t).alias("axiom_type"), a1.alias("a1"), a2.alias("a2"), text(None).alias("a3"), ops.alias("operands"))
    both = lambda x: F.array(p, x)
    none = text(None)
    parts = [row(f"Sub{kind}PropertyOf", p, named("up/", "s_nationkey"))]
    if kind != "Annotation":
        parts += [row(f"Equivalent{kind}Properties", none, none, both(named("same/", k))), row(f"Disjoint{kind}Properties", none, none, F.array(p, named("apart/", k), named("off/", k))), row(f"{kind}PropertyDomain", p, named("nation/", "s_nationkey")), row(f"{kind}PropertyRange", p, named("range/", "s_nationkey"))]
    if kind == "Object":
        parts.append(row("InverseObjectProperties", p, named("back/", k)))
    axioms = _union(*parts)
    return axioms.withColumn("axiom_id", F.sha2(F.concat_ws("|", "axiom_type", "a1", "a2", F.array_join("operands", ",")), 256))


def _relations(spark, sf_dir, kind: str) -> DataFrame:
    return relations.edges_of(_property_axioms(spark, sf_dir, kind)).select("src", F.coalesce("dst", F.lit("")).alias("dst"), "rel").distinct()


_PROP = "s AS (SELECT 'supplier/' || s_suppkey AS p, s_suppkey AS k, s_nationkey AS n FROM supplier)"
_UP_DOWN = "SELECT p AS src, 'up/' || n AS dst, 'ancestors' AS rel FROM s UNION SELECT 'up/' || n, p, 'descendants' FROM s"
_MORE = """ UNION SELECT p, 'same/' || k, 'equivalents' FROM s UNION SELECT 'same/' || k, p, 'equivalents' FROM s UNION SELECT p, 'apart/' || k, 'disjoints' FROM s UNION SELECT 'apart/' || k, p, 'disjoints' FROM s
 UNION SELECT p, 'off/' || k, 'disjoints' FROM s UNION SELECT 'off/' || k, p, 'disjoints' FROM s UNION SELECT 'apart/' || k, 'off/' || k, 'disjoints' FROM s UNION SELECT 'off/' || k, 'apart/' || k, 'disjoints' FROM s UNION SELECT p, 'nation/' || n, 'domains' FROM s"""


@query(f"WITH {_PROP} {_UP_DOWN}{_MORE} UNION SELECT p, 'range/' || n, 'ranges' FROM s UNION SELECT p, 'back/' || k, 'inverses' FROM s UNION SELECT 'back/' || k, p, 'inverses' FROM s")
def object_property_relations(spark, sf_dir):
    return _relations(spark, sf_dir, "Object")


@query(f"WITH {_PROP} {_UP_DOWN}{_MORE} UNION SELECT p, '', 'ranges' FROM s")
def data_property_relations(spark, sf_dir):
    """As of object properties; a range is a data type, so no entity."""
    return _relations(spark, sf_dir, "Data")


@query(f"WITH {_PROP} {_UP_DOWN}")
def annotation_property_relations(spark, sf_dir):
    return _relations(spark, sf_dir, "Annotation")


@query("""SELECT 'customer/' || c_custkey AS src, 'segment/' || c_mktsegment AS dst, 'types' AS rel FROM customer UNION SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey, 'property assertions' FROM orders
 UNION SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey, 'property assertions' FROM orders UNION SELECT 'customer/' || o_custkey, 'placed', 'property assertions' FROM orders UNION SELECT 'orders/' || o_orderkey, 'placed', 'property assertions' FROM orders
 UNION SELECT 'orders/' || o_orderkey, 'total', 'property assertions' FROM orders""")
def individual_relations(spark, sf_dir):
    """Types and property assertions of individuals, as a parsed list of relations asks for them."""
    t = Tables(spark, sf_dir)
    order, owner = iri("orders", "o_orderkey"), iri("customer", "o_custkey")
    row = lambda df, kind, *a: df.select(F.lit(kind).alias("axiom_type"), *[x.alias(f"a{k}") for k, x in enumerate(a, 1)], F.lit(None).cast("array<string>").alias("operands"))
    axioms = _union(row(t.customer, "ClassAssertion", iri("customer", "c_custkey"), named("segment/", "c_mktsegment"), text(None)), row(t.orders, "ObjectPropertyAssertion", owner, F.lit("placed"), order), row(t.orders, "DataPropertyAssertion", order, F.lit("total"), F.col("o_totalprice").cast("string")))
    edges = settled(relations.edges_of(axioms.withColumn("axiom_id", F.sha2(F.concat_ws("|", "axiom_type", "a1", "a2", "a3"), 256))))
    found = relations.directly_related(edges, edges.select(F.col("src").alias("iri")), relations.parse_relations(" Types, ,PROPERTY assertions "))
    return found.select(F.col("iri").alias("src"), "dst", "rel").distinct()


def _full(spark, parts: list[DataFrame]) -> DataFrame:
    """Rows ``(axiom_type, a1, a2, a3, operands, negative)`` as an axiom table."""
    axioms = _union(*parts).withColumns({"axiom_id": F.sha2(F.concat_ws("|", "axiom_type", F.col("negative").cast("string"), "a1", "a2", "a3", F.array_join("operands", ",")), 256), "ontology_iri": F.lit("shop"), "datatype": text(None), "lang": text(None), "ax_annotations": F.lit(None).cast("array<string>"), "inferred": F.lit(False)})
    return axioms.select(*AXIOM.fieldNames())


def _row(df: DataFrame, kind: str, a1=None, a2=None, a3=None, operands=None, negative=False) -> DataFrame:
    one = lambda x: text(x) if x is None or isinstance(x, str) else x
    return df.select(F.lit(kind).alias("axiom_type"), one(a1).alias("a1"), one(a2).alias("a2"), one(a3).alias("a3"), (F.lit(None).cast("array<string>") if operands is None else operands).alias("operands"), (F.lit(negative) if isinstance(negative, bool) else negative).alias("negative"))


def _reasoner(spark, parts: list[DataFrame]) -> Reasoner:
    return Reasoner(_full(spark, parts), spark.createDataFrame([], EXPRESSION))


_DIRECT = f"""WITH RECURSIVE {SHORTCUTS}, c AS (SELECT src AS start, dst AS node FROM e UNION SELECT c.start, e.dst FROM c JOIN e ON c.node = e.src)
SELECT start AS a1, node AS a2 FROM c WHERE NOT EXISTS (SELECT 1 FROM c x JOIN c y ON x.node = y.start WHERE x.start = c.start AND y.node = c.node)"""


def _inferred_sub(spark, sf_dir, kind: str, wanted: str) -> DataFrame:
    edges = _shortcuts(Tables(spark, sf_dir))
    return _reasoner(spark, [_row(edges, f"Sub{kind}PropertyOf", F.col("src"), F.col("dst"))]).infer({wanted}).select("a1", "a2")


@query(_DIRECT)
def inferred_subobject_properties(spark, sf_dir):
    return _inferred_sub(spark, sf_dir, "Object", "subobject properties")


@query(_DIRECT)
def inferred_subdata_properties(spark, sf_dir):
    return _inferred_sub(spark, sf_dir, "Data", "subdata properties")


@query("""WITH p AS (SELECT s_suppkey AS k, 'supplies/' || s_suppkey AS a, 'bought/' || s_suppkey AS b, 'sells/' || s_suppkey AS c FROM supplier), o AS (SELECT a AS x, b AS y FROM p UNION SELECT c, b FROM p WHERE k % 2 = 0 UNION SELECT 'near/' || k, 'near/' || k FROM p)
SELECT x AS a1, y AS a2 FROM o UNION SELECT y, x FROM o""")
def inferred_inverse_properties(spark, sf_dir):
    """Inverses in both directions, of equivalent properties too; a symmetric property is its own."""
    s, k = Tables(spark, sf_dir).supplier, F.col("s_suppkey")
    parts = [_row(s, "InverseObjectProperties", named("supplies/", k), named("bought/", k)), _row(s.where(k % 2 == 0), "EquivalentObjectProperties", operands=F.array(named("supplies/", k), named("sells/", k))), _row(s, "SymmetricObjectProperty", named("near/", k))]
    return _reasoner(spark, parts).infer({"inverse object properties"}).select("a1", "a2")


@query("""SELECT 'customer/' || c_custkey AS a1, p AS a2, round(c_acctbal)::BIGINT::VARCHAR AS a3 FROM customer, (VALUES ('balance'), ('amount'), ('figure')) v(p)""")
def inferred_data_values(spark, sf_dir):
    """Values of data properties, by their superior and equivalent properties too."""
    t = Tables(spark, sf_dir)
    balance = F.round("c_acctbal").cast("long").cast("string")
    parts = [_row(t.customer, "DataPropertyAssertion", iri("customer", "c_custkey"), "balance", balance), _row(spark.range(1), "SubDataPropertyOf", "balance", "amount"), _row(spark.range(1), "EquivalentDataProperties", operands=F.array(F.lit("amount"), F.lit("figure")))]
    return _reasoner(spark, parts).infer({"property values"}).select("a1", "a2", "a3")


@query("""SELECT 'several values of a functional data property' AS reason, 'customer/' || o_custkey AS item FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1
 UNION SELECT 'asymmetric property both ways', 'customer/' || o_custkey FROM orders WHERE o_orderkey % 5 = 0 UNION SELECT 'asymmetric property both ways', 'orders/' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0
 UNION SELECT 'assertion and its negation', 'customer/' || o_custkey FROM orders WHERE o_orderkey % 7 = 0 UNION SELECT 'irreflexive property of an individual and itself', 'nation/' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0""")
def inconsistencies(spark, sf_dir):
    """Everything that makes an ontology of orders inconsistent."""
    t, k = Tables(spark, sf_dir), F.col("o_orderkey")
    order, owner = iri("orders", "o_orderkey"), iri("customer", "o_custkey")
    parts = [
        _row(t.orders, "DataPropertyAssertion", owner, "priority", F.col("o_orderpriority")), _row(spark.range(1), "FunctionalDataProperty", "priority"),
        _row(t.orders, "ObjectPropertyAssertion", owner, "placed", order), _row(t.orders.where(k % 5 == 0), "ObjectPropertyAssertion", order, "placed", owner), _row(spark.range(1), "AsymmetricObjectProperty", "placed"),
        _row(t.orders.where(k % 7 == 0), "ObjectPropertyAssertion", owner, "placed", order, negative=True),
        _row(t.nation.where("n_nationkey % 4 = 0"), "ObjectPropertyAssertion", iri("nation", "n_nationkey"), "borders", iri("nation", "n_nationkey")), _row(spark.range(1), "IrreflexiveObjectProperty", "borders"),
    ]
    return _reasoner(spark, parts).clashes()


@query("""SELECT 'customer/' || c_custkey AS ind, 'segment/' || c_mktsegment AS cls FROM customer UNION SELECT 'account/' || c_custkey, 'segment/' || c_mktsegment FROM customer
 UNION SELECT 'customer/' || c_custkey, 'account' FROM customer UNION SELECT 'account/' || c_custkey, 'account' FROM customer""")
def same_individual_types(spark, sf_dir):
    """Individuals that a functional property makes one share their types."""
    c = Tables(spark, sf_dir).customer
    one, other = iri("customer", "c_custkey"), named("account/", "c_custkey")
    parts = [
        _row(c, "Declaration", one, "indiv"), _row(c, "Declaration", other, "indiv"), _row(c, "ClassAssertion", one, named("segment/", "c_mktsegment")), _row(c, "ClassAssertion", other, "account"),
        _row(c.select("c_mktsegment").distinct(), "Declaration", named("segment/", "c_mktsegment"), "class"), _row(spark.range(1), "Declaration", "account", "class"),
        _row(c, "ObjectPropertyAssertion", named("contract/", "c_custkey"), "holder", one), _row(c, "ObjectPropertyAssertion", named("contract/", "c_custkey"), "holder", other), _row(spark.range(1), "FunctionalObjectProperty", "holder"),
    ]
    return _reasoner(spark, parts).types()


@query("SELECT 'different individuals that are one' AS reason, 'customer/' || c_custkey AS item FROM customer WHERE c_custkey % 3 = 0 UNION SELECT 'different individuals that are one', 'account/' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def different_individuals(spark, sf_dir):
    """Individuals that are said to differ and to be the same, by what points to them through an inverse functional property."""
    c = Tables(spark, sf_dir).customer
    one, other = iri("customer", "c_custkey"), named("account/", "c_custkey")
    parts = [
        _row(c, "ObjectPropertyAssertion", one, "holds", named("number/", "c_custkey")), _row(c, "ObjectPropertyAssertion", other, "holds", named("number/", "c_custkey")), _row(spark.range(1), "InverseFunctionalObjectProperty", "holds"),
        _row(c.where("c_custkey % 3 = 0"), "DifferentIndividuals", operands=F.array(one, other)),
    ]
    return _reasoner(spark, parts).clashes()


@query(f"""WITH RECURSIVE {PLACES}, s AS (SELECT 'region/' || r_regionkey AS node FROM region UNION SELECT 'supplier/' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0),
 up AS (SELECT node FROM s UNION SELECT e.dst FROM up JOIN e ON e.src = up.node), down AS (SELECT node FROM s UNION SELECT e.src FROM down JOIN e ON e.dst = down.node)
SELECT src AS a1, dst AS a2 FROM e WHERE src IN (SELECT node FROM up) AND dst IN (SELECT node FROM down)""")
def star_module(spark, sf_dir):
    """The locality module of all regions and every third supplier: what lies between them."""
    from .operators import locality

    t = Tables(spark, sf_dir)
    edges = places(t)
    axioms = _full(spark, [_row(edges, "SubClassOf", F.col("src"), F.col("dst"))])
    seeds = t.region.select(iri("region", "r_regionkey").alias("iri")).union(t.supplier.where("s_suppkey % 3 = 0").select(iri("supplier", "s_suppkey")))
    return locality.star_module(axioms, spark.createDataFrame([], EXPRESSION), seeds).select("a1", "a2")


@query("""WITH w AS (SELECT DISTINCT p_name AS text, string_split(p_name, ' ') AS ws FROM part),
 g AS (SELECT DISTINCT text, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS gram, k = len(ws) AS whole FROM w, range(1, 12) a(i), range(1, 12) b(k) WHERE i + k - 1 <= len(ws))
SELECT replace(replace(a.text, 'e', chr(65317)), ' ', chr(160)) AS term, b.text AS text, CASE WHEN max((a.whole AND b.whole)::INT) = 1 THEN 'Full' ELSE 'Partial' END AS match FROM g a JOIN g b ON a.gram = b.gram GROUP BY a.text, b.text""")
def find_entities_decomposed(spark, sf_dir):
    """Terms in wide letters and with spaces that don't break find what plain ones do."""
    p = Tables(spark, sf_dir).part
    index = search.build_index(p.select(named("name/", "p_name").alias("subject"), F.lit(LABEL).alias("prop"), F.col("p_name").alias("value")))
    odd = F.replace(F.replace(F.col("p_name"), F.lit("e"), F.lit(chr(65317))), F.lit(" "), F.lit(chr(160)))
    return search.find_entities(p.select(odd.alias("term")), index).select("term", "text", "match")


@query("""SELECT s_suppkey, ['rdfs:label', 'oboInOwl:hasSynonym', 'oboInOwl:hasExactSynonym', 'oboInOwl:hasNarrowSynonym', 'oboInOwl:hasBroadSynonym', 'oboInOwl:hasRelatedSynonym', 'skos:prefLabel', 'skos:altLabel', 'skos:hiddenLabel', 'http://x.org/p'][1 + s_suppkey::INT % 10] AS annotation FROM supplier""")
def search_annotation_names(spark, sf_dir):
    """Short names of the annotation properties in search results."""
    props = F.array(*[F.lit(p) for p in (*SEARCHED, "http://x.org/p")])
    return Tables(spark, sf_dir).supplier.select("s_suppkey", search.short_name(F.element_at(props, (F.col("s_suppkey") % 10 + 1).cast("int"))).alias("annotation"))
