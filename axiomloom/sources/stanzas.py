"""OBO and functional-syntax documents as axiom tables, read in splits.

Neither format needs its document as a whole. An OBO document is stanzas: Spark's text source
takes ``\\n[`` as the end of a record, so a stanza that lies across the border of two splits is
read whole by one of them, and columns take it apart. A functional-syntax document is read line
by line, as writers put an axiom on each. What a document says once for all, the ontology's
name or its prefixes, is joined to its records.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..schema import ANNOTATION_PROPERTY, AXIOM, CLASS, COMMENT, DATA_PROPERTY, DEFINITION, EXPRESSION, INDIVIDUAL, LABEL, OBJECT_PROPERTY, OBO_BASE, OIO, OWL, RDF, RDFS, XSD
from .owl import FEATURES, Document

_STRING = XSD + "string"
#: What a tag of a stanza says as an annotation; fixed values.
ANNOTATIONS = {
    "name": LABEL, "comment": COMMENT, "namespace": OIO + "hasOBONamespace", "alt_id": OIO + "hasAlternativeId", "xref": OIO + "hasDbXref", "created_by": OIO + "created_by", "creation_date": OIO + "creation_date",
}
#: Characteristics of properties by tag; fixed values.
CHARACTERISTICS = {
    "is_transitive": "TransitiveObjectProperty", "is_symmetric": "SymmetricObjectProperty", "is_asymmetric": "AsymmetricObjectProperty", "is_reflexive": "ReflexiveObjectProperty", "is_anti_symmetric": None,
    "is_functional": "FunctionalObjectProperty", "is_inverse_functional": "InverseFunctionalObjectProperty",
}
_KINDS = {"Term": CLASS, "Typedef": OBJECT_PROPERTY, "Instance": INDIVIDUAL}
_ROW = "struct<axiom_type:string,a1:string,a2:string,a3:string,operands:array<string>,datatype:string>"


def expression_key(op: Column, prop: Column, filler: Column, operands: Column) -> Column:
    """The key of a class expression, as :meth:`Document.expression` has it."""
    fixed = F.array(op, F.lit(""), F.coalesce(prop, F.lit("")), F.coalesce(filler, F.lit("")), F.lit(""))
    text = F.array_join(F.concat(fixed, F.coalesce(operands, F.array().cast("array<string>"))), "\x1f")
    return F.concat(F.lit("_:"), F.substring(F.sha2(text, 256), 1, 24))


def as_axioms(rows: DataFrame) -> DataFrame:
    """``rows(ontology_iri, axiom_type, a1, a2, a3, operands, datatype)`` as an axiom table, each axiom once for each ontology."""
    empty, none = F.array().cast("array<string>"), F.lit(None)
    kept = F.when(F.col("axiom_type") == "SubPropertyChainOf", F.col("operands")).otherwise(F.array_sort(F.array_distinct("operands")))
    rows = rows.withColumn("operands", kept)
    said = F.array(F.col("axiom_type"), F.lit("False"), *[F.coalesce(F.col(c), F.lit("")) for c in ("a1", "a2", "a3", "datatype")], F.lit(""))
    key = F.sha2(F.array_join(F.concat(said, F.coalesce("operands", empty)), "\x1f"), 256)
    more = {"axiom_id": key, "negative": F.lit(False), "lang": none.cast("string"), "ax_annotations": none.cast("array<string>"), "inferred": F.lit(False)}
    return rows.withColumns(more).select(*AXIOM.fieldNames()).dropDuplicates(["ontology_iri", "axiom_id"])


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """``(ontology_iri, base, kind, id, tags)`` of the stanzas of the OBO documents under ``path``; ``tags(tag, value)`` without comments and qualifiers."""
    records = spark.read.option("lineSep", "\n[").text(path).select(F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("record"))
    head = F.regexp_extract("record", r"^\[?(Term|Typedef|Instance)\]", 1)
    lines = F.transform(F.split("record", "\n"), lambda line: F.struct(F.regexp_extract(line, r"^([A-Za-z_-]+):\s*(.*)$", 1).alias("tag"), F.regexp_extract(line, r"^([A-Za-z_-]+):\s*(.*)$", 2).alias("value")))
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, r'((?:"(?:[^"\\]|\\.)*"|\\.|[^"\\!])*?)\s*(?<!\\)!.*$', "$1"), r"\s*(?<!\\)\{[^}]*\}\s*$", "")
    tags = F.filter(F.transform(lines, lambda t: F.struct(t["tag"].alias("tag"), F.trim(bare(t["value"])).alias("value"))), lambda t: t["tag"] != "")
    parsed = settled(records.select("file", head.alias("kind"), tags.alias("tags")))
    value = lambda tag: F.element_at(F.filter("tags", lambda t: t["tag"] == tag), 1)["value"]
    named = parsed.where("kind = ''").groupBy("file").agg(F.max(F.when(F.size("tags") > 0, F.try_element_at(F.transform(F.filter("tags", lambda t: t["tag"] == "ontology"), lambda t: t["value"]), F.lit(1)))).alias("ontology"))
    own = parsed.where("kind <> ''").where(F.exists("tags", lambda t: t["tag"] == "id")).withColumn("id", value("id"))
    base = F.concat(F.lit(OBO_BASE), F.coalesce("ontology", F.lit("unnamed")))
    name = F.when(F.col("ontology").rlike("^[a-z]+://"), F.col("ontology")).otherwise(F.concat(F.lit(OBO_BASE), "ontology", F.lit(".owl")))
    return own.join(named, "file", "left").select(name.alias("ontology_iri"), F.concat(base, F.lit("#")).alias("base"), "kind", "id", "tags")


def _iri(x: Column) -> Column:
    """The IRI of an OBO identifier; one without prefix belongs to its ontology."""
    x = F.regexp_replace(x, r"\\(.)", "$1")
    return F.when(x.rlike("^[a-z]+://"), x).when(x.rlike(r"^[^:\s]+:\S+$"), F.concat(F.lit(OBO_BASE), F.regexp_replace(x, "^([^:]+):", "$1_"))).otherwise(F.concat(F.col("base"), x))


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(axioms, expressions)`` of the OBO documents under ``path``. Tags that say nothing of entities, and those not known here, are passed over."""
    told = stanzas(spark, path).withColumn("iri", _iri(F.col("id")))
    none, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    row = lambda kind, a1=none, a2=none, a3=none, operands=no_list, datatype=none: F.struct(F.lit(kind).alias("axiom_type") if isinstance(kind, str) else kind.alias("axiom_type"), a1.alias("a1"), a2.alias("a2"), a3.alias("a3"), operands.alias("operands"), datatype.alias("datatype")).cast(_ROW)
    each = told.select("ontology_iri", "base", "kind", "iri", F.explode("tags").alias("t")).select("ontology_iri", "base", "kind", "iri", F.col("t.tag").alias("tag"), F.col("t.value").alias("value"))
    tag, value, me, term = F.col("tag"), F.col("value"), F.col("iri"), F.col("kind") == "Term"
    words = F.split(value, r"\s+")
    plain = lambda v: F.regexp_replace(F.replace(v, F.lit("\\n"), F.lit("\n")), r"\\(.)", "$1")
    quoted = plain(F.regexp_extract(value, r'^"((?:[^"\\]|\\.)*)"', 1))
    text = lambda prop, v: row("AnnotationAssertion", me, prop if isinstance(prop, Column) else F.lit(prop), v, datatype=F.lit(_STRING))
    scope = F.initcap(F.lower(F.coalesce(F.nullif(F.regexp_extract(value, r'^"(?:[^"\\]|\\.)*"\s+(EXACT|BROAD|NARROW|RELATED)', 1), F.lit("")), F.lit("RELATED"))))
    some = expression_key(F.lit("some"), _iri(F.get(words, F.lit(0))), _iri(F.get(words, F.lit(1))), no_list)
    pair = F.array_sort(F.array(me, _iri(value)))
    either = lambda is_class, is_prop: F.when(term, F.lit(is_class)).otherwise(F.lit(is_prop))
    said = F.when(tag == "id", row("Declaration", me, F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("kind"))))
    for k, prop in ANNOTATIONS.items():
        said = said.when(tag == k, text(prop, plain(value)))
    said = said.when(tag == "def", text(DEFINITION, quoted)).when(tag == "synonym", text(F.concat(F.lit(OIO + "has"), scope, F.lit("Synonym")), quoted))
    said = said.when((tag == "is_obsolete") & (F.lower(value) == "true"), row("AnnotationAssertion", me, F.lit(OWL + "deprecated"), F.lit("true"), datatype=F.lit(XSD + "boolean")))
    said = said.when(tag == "is_a", row(either("SubClassOf", "SubObjectPropertyOf"), me, _iri(value)))
    said = said.when(tag == "equivalent_to", row(either("EquivalentClasses", "EquivalentObjectProperties"), operands=pair)).when(tag == "disjoint_from", row(either("DisjointClasses", "DisjointObjectProperties"), operands=pair))
    said = said.when((tag == "relationship") & term, row("SubClassOf", me, some)).when((tag == "relationship") & (F.col("kind") == "Instance"), row("ObjectPropertyAssertion", me, _iri(F.get(words, F.lit(0))), _iri(F.get(words, F.lit(1)))))
    said = said.when(tag == "instance_of", row("ClassAssertion", me, _iri(value))).when(tag == "domain", row("ObjectPropertyDomain", me, _iri(value))).when(tag == "range", row("ObjectPropertyRange", me, _iri(value))).when(tag == "inverse_of", row("InverseObjectProperties", me, _iri(value)))
    said = said.when(tag == "transitive_over", row("SubPropertyChainOf", me, operands=F.array(me, _iri(value)))).when(tag.isin("holds_over_chain", "equivalent_to_chain"), row("SubPropertyChainOf", me, operands=F.array(_iri(F.get(words, F.lit(0))), _iri(F.get(words, F.lit(1))))))
    for k, kind in CHARACTERISTICS.items():
        if kind:
            said = said.when((tag == k) & (F.lower(value) == "true"), row(kind, me))
    rows = each.select("ontology_iri", said.alias("row")).where("row is not null").select("ontology_iri", "row.*")

    # several lines of a stanza make one expression
    of = lambda name: F.transform(F.filter("tags", lambda t: t["tag"] == name), lambda t: F.split(t["value"], r"\s+"))
    operand = lambda w: F.when(F.size(w) > 1, expression_key(F.lit("some"), _iri(w[0]), _iri(F.get(w, F.lit(1))), no_list)).otherwise(_iri(w[0]))
    grouped = told.where("kind = 'Term'").select("ontology_iri", "base", "iri", F.explode(F.array(F.struct(F.lit("and").alias("op"), of("intersection_of").alias("ws")), F.struct(F.lit("or").alias("op"), of("union_of").alias("ws")))).alias("g")).select("ontology_iri", "base", "iri", "g.op", "g.ws").where("size(ws) > 0")
    grouped = grouped.withColumn("operands", F.array_sort(F.array_distinct(F.transform("ws", operand)))).withColumn("key", expression_key(F.col("op"), none, none, F.col("operands")))
    rows = rows.unionByName(grouped.select("ontology_iri", row("EquivalentClasses", operands=F.array("iri", "key")).alias("row")).select("ontology_iri", "row.*"))

    restrictions = each.where("tag = 'relationship' and kind = 'Term'").select(_iri(F.get(words, F.lit(0))).alias("prop"), _iri(F.get(words, F.lit(1))).alias("filler"))
    restrictions = restrictions.union(grouped.select("base", F.explode("ws").alias("w")).where("size(w) > 1").select(_iri(F.col("w")[0]), _iri(F.col("w")[1])))
    expressions = restrictions.select(F.lit("some").alias("op"), "prop", "filler", no_list.alias("operands")).union(grouped.select("op", none, none, "operands"))
    keyed = expressions.select(expression_key(F.col("op"), F.col("prop"), F.col("filler"), F.col("operands")).alias("expr_id"), "op", none.alias("iri"), "prop", "filler", F.lit(None).cast("int").alias("card"), "operands")
    return as_axioms(rows), keyed.dropDuplicates(["expr_id"])


# -- functional syntax

_TOKEN = re.compile(r'\s*(?:(<[^>]*>)|("(?:[^"\\]|\\.)*"(?:\^\^(?:<[^>]*>|[^\s()]+)|@[A-Za-z0-9-]+)?)|([()])|([^\s()<"]+))')
_CLASS_OPS = {"IntersectionOf": "and", "UnionOf": "or", "ComplementOf": "not", "OneOf": "oneof", "SomeValuesFrom": "some", "AllValuesFrom": "only", "HasValue": "value", "HasSelf": "self", "MinCardinality": "min", "MaxCardinality": "max", "ExactCardinality": "exactly"}
_ENTITY = {"Class": CLASS, "ObjectProperty": OBJECT_PROPERTY, "DataProperty": DATA_PROPERTY, "AnnotationProperty": ANNOTATION_PROPERTY, "NamedIndividual": INDIVIDUAL}
#: Prefixes that every document has; fixed values.
STANDARD = {"owl:": OWL, "rdf:": RDF, "rdfs:": RDFS, "xsd:": XSD}


def parse_functional(text: str) -> list:
    """The expressions of ``text`` as nested lists, a head before its arguments; an open bracket is a ValueError. What follows the bracket that closes the ontology isn't read."""
    stack: list[list] = [[]]
    at, ended = 0, -1  # where the last name ended: a bracket right there is its own
    while at < len(text) and text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Not functional syntax: {text[at : at + 60]!r}")
        at = m.end()
        if m[3] == "(":
            head = stack[-1].pop() if m.start(3) == ended else ""
            stack.append([head])
        elif m[3] == ")":
            if len(stack) == 1:
                break
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(m[1] or m[2] or m[4])
            ended = at if m[4] else -1
    if len(stack) > 1:
        raise ValueError(f"A bracket isn't closed: {text[:60]!r}")
    return stack[0]


def add_functional(doc: Document, node: list, prefixes: dict[str, str]) -> None:
    """Adds the axiom ``node`` to ``doc``; kinds not known here are passed over."""

    def iri(x: str) -> str:
        if x.startswith("<"):
            return x[1:-1]
        prefix, colon, local = x.partition(":")
        if not colon or prefix + ":" not in prefixes:
            raise ValueError(f"No prefix for {x}")
        return prefixes[prefix + ":"] + local

    def literal(x: str) -> tuple[str, str, str]:
        value, kind = re.fullmatch(r'"((?:[^"\\]|\\.)*)"(.*)', x, re.S).groups()
        value = re.sub(r"\\(.)", r"\1", value)
        return value, iri(kind[2:]) if kind.startswith("^^") else "" if kind else _STRING, kind[1:] if kind.startswith("@") else ""

    def prop(x) -> str:
        return f"inverse({iri(x[1])})" if isinstance(x, list) else iri(x)

    def expr(x) -> str:
        if isinstance(x, str):
            return doc.expression("literal", iri="\x1f".join(literal(x))) if x.startswith('"') else iri(x)
        op = _CLASS_OPS.get(x[0].removeprefix("Object").removeprefix("Data"))
        if x[0] == "DatatypeRestriction":
            return doc.expression("datatype", iri=iri(x[1]), operands=sorted(f"{iri(f).removeprefix(XSD)} {literal(v)[0]}" for f, v in zip(x[2::2], x[3::2], strict=True)))
        if op in ("and", "or", "oneof"):
            return doc.expression(op, operands=sorted({expr(o) for o in x[1:]}))
        if op == "not":
            return doc.expression(op, filler=expr(x[1]))
        if op in ("some", "only", "value"):
            return doc.expression(op, prop=prop(x[1]), filler=expr(x[2]))
        if op == "self":
            return doc.expression(op, prop=prop(x[1]))
        if op in ("min", "max", "exactly"):
            return doc.expression(op, prop=prop(x[2]), card=int(x[1]), filler=expr(x[3]) if len(x) > 3 else None)
        raise ValueError(f"Not a class expression: {x[0]}")

    kind, args = node[0], node[1:]
    notes = [a for a in args if isinstance(a, list) and a[0] == "Annotation"]
    args = [a for a in args if not (isinstance(a, list) and a[0] == "Annotation")]
    own = {"ax_annotations": [f"{iri(a[-2])} {literal(a[-1])[0] if a[-1].startswith('"') else iri(a[-1])}" for a in notes] or None}
    negative = kind.startswith("Negative")
    if kind == "Declaration":
        if args[0][0] in _ENTITY:
            doc.add(kind, iri(args[0][1]), _ENTITY[args[0][0]], **own)
    elif kind in ("SubClassOf",):
        doc.add(kind, expr(args[0]), expr(args[1]), **own)
    elif kind in ("EquivalentClasses", "DisjointClasses"):
        doc.add(kind, operands=[expr(a) for a in args], **own)
    elif kind == "DisjointUnion":
        parts = [expr(a) for a in args[1:]]
        doc.add("DisjointClasses", operands=parts)
        doc.add("EquivalentClasses", operands=[iri(args[0]), doc.expression("or", operands=sorted(set(parts)))], **own)
    elif kind == "SubObjectPropertyOf" and isinstance(args[0], list) and args[0][0] == "ObjectPropertyChain":
        doc.add("SubPropertyChainOf", prop(args[1]), operands=[prop(a) for a in args[0][1:]], **own)
    elif kind in ("SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf", "InverseObjectProperties"):
        doc.add(kind, prop(args[0]), prop(args[1]), **own)
    elif kind.endswith(("ObjectProperties", "DataProperties")) or kind in ("SameIndividual", "DifferentIndividuals"):
        doc.add(kind, operands=[prop(a) for a in args], **own)
    elif kind.endswith(("PropertyDomain", "PropertyRange")):
        doc.add(kind, prop(args[0]), expr(args[1]), **own)
    elif kind == "HasKey":
        doc.add(kind, expr(args[0]), operands=[prop(p) for group in args[1:] for p in group[1:]], **own)
    elif kind == "ClassAssertion":
        doc.add(kind, iri(args[1]), expr(args[0]), **own)
    elif kind.removeprefix("Negative") == "ObjectPropertyAssertion":
        doc.add("ObjectPropertyAssertion", iri(args[1]), prop(args[0]), iri(args[2]), negative=negative, **own)
    elif kind.removeprefix("Negative") == "DataPropertyAssertion":
        value, datatype, lang = literal(args[2])
        doc.add("DataPropertyAssertion", iri(args[1]), iri(args[0]), value, datatype=datatype, lang=lang, negative=negative, **own)
    elif kind == "AnnotationAssertion":
        value, datatype, lang = literal(args[2]) if args[2].startswith('"') else (iri(args[2]), "@iri", "")
        doc.add(kind, iri(args[1]), iri(args[0]), value, datatype=datatype, lang=lang, **own)
    elif any(kind in (f"{f}ObjectProperty", f"{f}DataProperty") for f in FEATURES):
        doc.add(kind, prop(args[0]), **own)


def read_functional(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(axioms, expressions)`` of the functional-syntax documents under ``path``.

    Every axiom must be on a line of its own, as writers put it; one that isn't finished there is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    head = lines.select("file", F.regexp_extract("value", r"^\s*Prefix\(\s*([^\s=]*:)\s*=\s*<([^>]*)>\s*\)", 1).alias("prefix"), F.regexp_extract("value", r"^\s*Prefix\(\s*([^\s=]*:)\s*=\s*<([^>]*)>\s*\)", 2).alias("space"), F.regexp_extract("value", r"^\s*Ontology\(\s*<([^>]*)>", 1).alias("name"))
    told = head.where("prefix <> '' or name <> ''").groupBy("file").agg(F.map_from_entries(F.collect_list(F.when(F.col("prefix") != "", F.struct("prefix", "space")))).alias("prefixes"), F.max("name").alias("name"))
    kinds = "|".join(["Declaration", "SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion", "HasKey", "SameIndividual", "DifferentIndividuals", "AnnotationAssertion", r"(?:Negative)?(?:Class|Object|Data)\w*Assertion", r"(?:Sub|Equivalent|Disjoint|Inverse|Functional|InverseFunctional|Reflexive|Irreflexive|Symmetric|Asymmetric|Transitive)?(?:Object|Data|Annotation)Propert\w+"])
    body = lines.withColumn("value", F.regexp_extract("value", rf"^\s*((?:{kinds})\(.*)$", 1)).where("value <> ''")

    def run(batches):
        columns = ["x", *AXIOM.fieldNames()]
        for pdf in batches:
            rows = []
            for text, prefixes, name in zip(pdf["value"], pdf["prefixes"], pdf["name"], strict=True):
                doc, known = Document(), STANDARD | dict(prefixes if prefixes is not None else {})
                add_functional(doc, parse_functional(text)[0], known)
                rows += [{"x": None, **r, "ontology_iri": name or None} for r in doc.axioms.values()]
                rows += [{"x": r["op"], "axiom_id": r["expr_id"], "axiom_type": r["iri"], "a1": r["prop"], "a2": r["filler"], "a3": None if r["card"] is None else str(r["card"]), "operands": r["operands"]} for r in doc.expressions.values()]
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    schema = "x string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AXIOM)
    both = settled(body.join(told, "file", "left").select("value", "prefixes", "name").mapInPandas(run, schema))
    axioms = both.where("x is null").select(*AXIOM.fieldNames()).dropDuplicates(["ontology_iri", "axiom_id"])
    expressions = both.where("x is not null").selectExpr("axiom_id as expr_id", "x as op", "axiom_type as iri", "a1 as prop", "a2 as filler", "cast(a3 as int) as card", "operands")
    return axioms, expressions.select(*EXPRESSION.fieldNames()).dropDuplicates(["expr_id"])
