"""Between RDF triples and the axiom table (the OWL 2 mapping to RDF graphs), for one document at a time.

Documents are spread over tasks; within a task a document is read as a whole, as its
blank nodes only have meaning there.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import ANNOTATION_PROPERTY, AXIOM, CLASS, DATA_PROPERTY, EXPRESSION, INDIVIDUAL, OBJECT_PROPERTY, OWL, RDF, RDFS, XSD
from . import rdf

KIND_OF = {
    OWL + "Class": CLASS, OWL + "ObjectProperty": OBJECT_PROPERTY, OWL + "DatatypeProperty": DATA_PROPERTY, OWL + "AnnotationProperty": ANNOTATION_PROPERTY, OWL + "NamedIndividual": INDIVIDUAL,
}
TYPE_OF = {v: k for k, v in KIND_OF.items()}
FEATURES = ("Functional", "InverseFunctional", "Reflexive", "Irreflexive", "Symmetric", "Asymmetric", "Transitive")
_LITERAL = "\x1f"
#: Annotation properties of the language's own namespace; fixed values.
OWL_ANNOTATIONS = tuple(OWL + x for x in ("backwardCompatibleWith", "deprecated", "incompatibleWith", "priorVersion", "versionInfo"))


def axiom_id(row: dict) -> str:
    """The digest of what an axiom says, its annotations included."""
    parts = [row["axiom_type"], str(bool(row.get("negative"))), *(row.get(k) or "" for k in ("a1", "a2", "a3", "datatype", "lang")), *(row.get("operands") or []), *(row.get("ax_annotations") or [])]
    return hashlib.sha256(_LITERAL.join(parts).encode()).hexdigest()


def axiom(axiom_type: str, a1=None, a2=None, a3=None, operands=None, datatype=None, lang=None, negative=False, ax_annotations=None, inferred=False, ontology_iri=None) -> dict:
    """A row of the axiom table. Operands are sorted, as their order has no meaning but in a chain."""
    row = {"ontology_iri": ontology_iri, "axiom_type": axiom_type, "negative": negative, "a1": a1, "a2": a2, "a3": a3, "operands": (list(operands) if axiom_type == "SubPropertyChainOf" else sorted(set(operands))) if operands else None, "datatype": datatype or None, "lang": lang or None, "ax_annotations": sorted(ax_annotations) if ax_annotations else None, "inferred": inferred}
    return row | {"axiom_id": axiom_id(row)}


class Document:
    """An ontology document: its name, imports, annotations, axioms and class expressions."""

    def __init__(self):
        self.iri = self.version = None
        self.imports: list[str] = []
        self.annotations: list[tuple[str, str, str]] = []
        self.prefixes: dict[str, str] = {}
        self.axioms: dict[str, dict] = {}
        self.expressions: dict[str, dict] = {}

    def add(self, *args, **kw) -> dict:
        row = axiom(*args, **kw)
        return self.axioms.setdefault(row["axiom_id"], row)

    def expression(self, op, iri=None, prop=None, filler=None, card=None, operands=None) -> str:
        text = _LITERAL.join([op, iri or "", prop or "", filler or "", "" if card is None else str(card), *(operands or [])])
        key = "_:" + hashlib.sha256(text.encode()).hexdigest()[:24]
        self.expressions[key] = {"expr_id": key, "op": op, "iri": iri, "prop": prop, "filler": filler, "card": card, "operands": operands}
        return key


def from_triples(triples, prefixes=None) -> Document:
    """The document that ``triples`` state. Triples that belong to no axiom known here are left out."""
    doc = Document()
    doc.prefixes = dict(prefixes or {})
    by: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for s, p, o, kind, dt, lang in dict.fromkeys(triples):
        by[s][p].append((o, kind, dt, lang))
    types = {s: {o for o, *_ in ps[RDF + "type"]} for s, ps in by.items() if RDF + "type" in ps}
    kinds: dict[str, set] = defaultdict(set)
    for s, ts in types.items():
        for t in ts & set(KIND_OF):
            kinds[s].add(KIND_OF[t])
        for f in FEATURES[1:]:
            if f"{OWL}{f}Property" in ts:
                kinds[s].add(OBJECT_PROPERTY)

    def one(s, p):
        return by[s][p][0][0] if s in by and by[s].get(p) else None

    def listed(head):
        items, seen = [], set()
        while head and head != rdf.NIL and head not in seen:
            seen.add(head)
            items.append(by[head][rdf.FIRST][0])
            head = one(head, rdf.REST)
        return items

    def literal(o):
        value, kind, dt, lang = o
        return doc.expression("literal", iri=_LITERAL.join((value, dt, lang))) if kind == "literal" else value

    def prop_name(p):
        return f"inverse({one(p, OWL + 'inverseOf')})" if p and p.startswith("_:") and p in by else p

    def expr(o, busy=()):
        """The key of a class expression or data range, an IRI for a named one."""
        if not o or not o.startswith("_:") or o not in by or o in busy:
            return o
        busy = (*busy, o)
        ps = by[o]
        for p, op in ((OWL + "intersectionOf", "and"), (OWL + "unionOf", "or")):
            if p in ps:
                return doc.expression(op, operands=sorted({expr(i[0], busy) for i in listed(one(o, p))}))
        if OWL + "oneOf" in ps:
            return doc.expression("oneof", operands=sorted(literal(i) for i in listed(one(o, OWL + "oneOf"))))
        for p in (OWL + "complementOf", OWL + "datatypeComplementOf"):
            if p in ps:
                return doc.expression("not", filler=expr(one(o, p), busy))
        if OWL + "onDatatype" in ps:
            facets = [(k.removeprefix(XSD), v[0][0]) for i in listed(one(o, OWL + "withRestrictions")) for k, v in by[i[0]].items()]
            return doc.expression("datatype", iri=one(o, OWL + "onDatatype"), operands=sorted(f"{k} {v}" for k, v in facets))
        prop = prop_name(one(o, OWL + "onProperty"))
        for p, op in ((OWL + "someValuesFrom", "some"), (OWL + "allValuesFrom", "only")):
            if p in ps:
                return doc.expression(op, prop=prop, filler=expr(one(o, p), busy))
        if OWL + "hasValue" in ps:
            return doc.expression("value", prop=prop, filler=literal(ps[OWL + "hasValue"][0]))
        if OWL + "hasSelf" in ps:
            return doc.expression("self", prop=prop)
        for p, op in (("minCardinality", "min"), ("maxCardinality", "max"), ("cardinality", "exactly"), ("minQualifiedCardinality", "min"), ("maxQualifiedCardinality", "max"), ("qualifiedCardinality", "exactly")):
            if OWL + p in ps:
                filler = expr(one(o, OWL + "onClass") or one(o, OWL + "onDataRange"), busy)
                return doc.expression(op, prop=prop, card=int(ps[OWL + p][0][0]), filler=filler)
        return o

    # annotations on axioms: what they are about, by the axiom's three parts
    about: dict[tuple, list[str]] = defaultdict(list)
    for s, ts in types.items():
        if OWL + "Axiom" in ts:
            for target in by[s][OWL + "annotatedTarget"]:
                for p, values in by[s].items():
                    if p not in (RDF + "type", OWL + "annotatedSource", OWL + "annotatedProperty", OWL + "annotatedTarget"):
                        about[one(s, OWL + "annotatedSource"), one(s, OWL + "annotatedProperty"), target[0]] += [f"{p} {v[0]}" for v in values]

    ontologies = [s for s, ts in types.items() if OWL + "Ontology" in ts]
    if ontologies:
        s = ontologies[0]
        doc.iri, doc.version = None if s.startswith("_:") else s, one(s, OWL + "versionIRI")
        doc.imports = [o for o, *_ in by[s].get(OWL + "imports", [])]
        doc.annotations = [(p, o, kind) for p, values in by[s].items() if p not in (RDF + "type", OWL + "versionIRI", OWL + "imports") for o, kind, *_ in values]
    add = lambda kind, s, p, o, *args, **kw: doc.add(kind, *args, ax_annotations=about.get((s, p, o)), **kw)

    def property_kind(*names):
        found = set().union(*(kinds.get(n, set()) for n in names))
        return next((k for k in (OBJECT_PROPERTY, DATA_PROPERTY, ANNOTATION_PROPERTY) if k in found), None)

    prefix = {OBJECT_PROPERTY: "Object", DATA_PROPERTY: "Data"}
    for s, ps in by.items():
        if s in ontologies or types.get(s, set()) & {OWL + "Axiom", OWL + "Annotation"}:
            continue
        if OWL + "AllDifferent" in types.get(s, set()):
            doc.add("DifferentIndividuals", operands=[i[0] for i in listed(one(s, OWL + "distinctMembers") or one(s, OWL + "members"))])
            continue
        if OWL + "NegativePropertyAssertion" in types.get(s, set()):
            subject, p = one(s, OWL + "sourceIndividual"), one(s, OWL + "assertionProperty")
            if OWL + "targetValue" in ps:
                value, _, dt, lang = ps[OWL + "targetValue"][0]
                doc.add("DataPropertyAssertion", subject, p, value, datatype=dt, lang=lang, negative=True)
            else:
                doc.add("ObjectPropertyAssertion", subject, p, one(s, OWL + "targetIndividual"), negative=True)
            continue
        if OWL + "AllDisjointClasses" in types.get(s, set()):
            doc.add("DisjointClasses", operands=[expr(i[0]) for i in listed(one(s, OWL + "members"))])
            continue
        if OWL + "AllDisjointProperties" in types.get(s, set()):
            members = [i[0] for i in listed(one(s, OWL + "members"))]
            doc.add(f"Disjoint{prefix.get(property_kind(*members), 'Object')}Properties", operands=members)
            continue
        named = not s.startswith("_:")
        own = kinds.get(s, set())
        for kind in own if named else ():
            if TYPE_OF[kind] in types[s]:
                add("Declaration", s, RDF + "type", TYPE_OF[kind], s, kind)
        for p, values in ps.items():
            for o, kind, dt, lang in values:
                if p == RDF + "type":
                    if o in KIND_OF or o in (OWL + "Restriction", RDFS + "Datatype", RDFS + "Class", RDF + "List", RDF + "Property"):
                        continue
                    feature = next((f for f in FEATURES if o == f"{OWL}{f}Property"), None)
                    if feature:
                        data = feature == "Functional" and DATA_PROPERTY in own and OBJECT_PROPERTY not in own
                        add(feature + ("DataProperty" if data else "ObjectProperty"), s, p, o, s)
                    elif named and (not o.startswith(OWL) or o == OWL + "Thing"):
                        add("ClassAssertion", s, p, o, s, expr(o))
                elif p == RDFS + "subClassOf":
                    add("SubClassOf", s, p, o, expr(s), expr(o))
                elif p == OWL + "equivalentClass":
                    add("EquivalentClasses", s, p, o, operands=[expr(s), expr(o)])
                elif p == OWL + "disjointWith":
                    add("DisjointClasses", s, p, o, operands=[expr(s), expr(o)])
                elif p == OWL + "disjointUnionOf":
                    doc.add("DisjointClasses", operands=[expr(i[0]) for i in listed(o)])
                    doc.add("EquivalentClasses", operands=[s, doc.expression("or", operands=sorted(expr(i[0]) for i in listed(o)))])
                elif p == RDFS + "subPropertyOf":
                    k = property_kind(s, o)
                    add({OBJECT_PROPERTY: "SubObjectPropertyOf", DATA_PROPERTY: "SubDataPropertyOf"}.get(k, "SubAnnotationPropertyOf"), s, p, o, prop_name(s), prop_name(o))
                elif p == OWL + "equivalentProperty":
                    add(f"Equivalent{prefix.get(property_kind(s, o), 'Object')}Properties", s, p, o, operands=[s, o])
                elif p == OWL + "propertyDisjointWith":
                    add(f"Disjoint{prefix.get(property_kind(s, o), 'Object')}Properties", s, p, o, operands=[s, o])
                elif p == OWL + "sameAs":
                    add("SameIndividual", s, p, o, operands=[s, o])
                elif p == OWL + "differentFrom":
                    add("DifferentIndividuals", s, p, o, operands=[s, o])
                elif p == OWL + "propertyChainAxiom":
                    add("SubPropertyChainOf", s, p, o, s, operands=[prop_name(i[0]) for i in listed(o)])
                elif p == OWL + "hasKey":
                    add("HasKey", s, p, o, expr(s), operands=[prop_name(i[0]) for i in listed(o)])
                elif p == OWL + "inverseOf" and named:
                    add("InverseObjectProperties", s, p, o, s, o)
                elif p == RDFS + "domain":
                    k = property_kind(s)
                    add({OBJECT_PROPERTY: "ObjectPropertyDomain", DATA_PROPERTY: "DataPropertyDomain"}.get(k, "AnnotationPropertyDomain"), s, p, o, s, expr(o))
                elif p == RDFS + "range":
                    k = property_kind(s)
                    add({OBJECT_PROPERTY: "ObjectPropertyRange", DATA_PROPERTY: "DataPropertyRange"}.get(k, "AnnotationPropertyRange"), s, p, o, s, expr(o))
                elif not named or p.startswith((OWL, RDF)) and p not in OWL_ANNOTATIONS:
                    continue
                elif property_kind(p) == OBJECT_PROPERTY:
                    add("ObjectPropertyAssertion", s, p, o, s, p, o)
                elif property_kind(p) == DATA_PROPERTY:
                    add("DataPropertyAssertion", s, p, o, s, p, o, datatype=dt, lang=lang)
                elif p.startswith((RDFS, OWL)) or property_kind(p) == ANNOTATION_PROPERTY or kind != "literal" or property_kind(p) is None:
                    add("AnnotationAssertion", s, p, o, s, p, o, datatype=dt if kind == "literal" else "@iri", lang=lang)
    for row in doc.axioms.values():
        row["ontology_iri"] = doc.iri
    return doc


def to_triples(doc: Document) -> list[tuple]:
    """The triples that state a document."""
    out: list[tuple] = []
    named: dict[str, str] = {}
    count = 0

    def iri(s, p, o):
        out.append((s, p, o, "blank" if o.startswith("_:") else "iri", "", ""))

    def blank() -> str:
        nonlocal count
        count += 1
        return f"_:x{count}"

    def chain(items) -> str:
        head = rdf.NIL
        for item in reversed(items):
            b = blank()
            out.append((b, rdf.FIRST, *item))
            iri(b, rdf.REST, head)
            head = b
        return head

    def prop(p):
        if p.startswith("inverse("):
            b = blank()
            iri(b, OWL + "inverseOf", p[8:-1])
            return b
        return p

    def item(key):
        e = doc.expressions.get(key)
        if e and e["op"] == "literal":
            value, dt, lang = e["iri"].split(_LITERAL)
            return value, "literal", dt, lang
        o = expr(key)
        return o, "blank" if o.startswith("_:") else "iri", "", ""

    def expr(key):
        e = doc.expressions.get(key)
        if e is None:
            return key
        if key in named:
            return named[key]
        b = named[key] = blank()
        op = e["op"]
        if op == "datatype":
            iri(b, RDF + "type", RDFS + "Datatype")
            iri(b, OWL + "onDatatype", e["iri"])
            signs = {"<=": "maxInclusive", "<": "maxExclusive", ">=": "minInclusive", ">": "minExclusive"}
            facets = []
            for f in e["operands"] or []:
                k, _, v = f.partition(" ")
                n = blank()
                out.append((n, XSD + signs.get(k, k), v, "literal", e["iri"] if k in signs or k in signs.values() else "", ""))
                facets.append((n, "blank", "", ""))
            iri(b, OWL + "withRestrictions", chain(facets))
            return b
        if op in ("and", "or", "oneof"):
            iri(b, RDF + "type", OWL + "Class")
            iri(b, OWL + {"and": "intersectionOf", "or": "unionOf", "oneof": "oneOf"}[op], chain([item(x) for x in e["operands"]]))
        elif op == "not":
            iri(b, RDF + "type", OWL + "Class")
            iri(b, OWL + "complementOf", expr(e["filler"]))
        else:
            iri(b, RDF + "type", OWL + "Restriction")
            iri(b, OWL + "onProperty", prop(e["prop"]))
            if op in ("some", "only"):
                iri(b, OWL + {"some": "someValuesFrom", "only": "allValuesFrom"}[op], expr(e["filler"]))
            elif op == "value":
                out.append((b, OWL + "hasValue", *item(e["filler"])))
            elif op == "self":
                out.append((b, OWL + "hasSelf", "true", "literal", XSD + "boolean", ""))
            else:
                name = {"min": "min", "max": "max", "exactly": ""}[op] + ("Qualified" if e["filler"] else "") + "Cardinality"
                out.append((b, OWL + name[0].lower() + name[1:], str(e["card"]), "literal", XSD + "nonNegativeInteger", ""))
                if e["filler"]:
                    iri(b, OWL + ("onDataRange" if e["filler"].startswith(XSD) else "onClass"), expr(e["filler"]))
        return b

    def annotated(row, s, p, o):
        if row["ax_annotations"]:
            b = blank()
            iri(b, RDF + "type", OWL + "Axiom")
            iri(b, OWL + "annotatedSource", s)
            iri(b, OWL + "annotatedProperty", p)
            out.append((b, OWL + "annotatedTarget", *o))
            for a in row["ax_annotations"]:
                k, _, v = a.partition(" ")
                out.append((b, k, v, "literal", "", ""))

    if doc.iri or doc.imports or doc.annotations:
        s = doc.iri or blank()
        iri(s, RDF + "type", OWL + "Ontology")
        if doc.version:
            iri(s, OWL + "versionIRI", doc.version)
        for x in doc.imports:
            iri(s, OWL + "imports", x)
        out += [(s, p, o, kind, "", "") for p, o, kind in doc.annotations]
    two = {
        "SubClassOf": RDFS + "subClassOf", "ClassAssertion": RDF + "type", "InverseObjectProperties": OWL + "inverseOf",
        "SubObjectPropertyOf": RDFS + "subPropertyOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "SubAnnotationPropertyOf": RDFS + "subPropertyOf",
        "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "AnnotationPropertyDomain": RDFS + "domain",
        "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range", "AnnotationPropertyRange": RDFS + "range",
    }
    many = {"EquivalentClasses": OWL + "equivalentClass", "DisjointClasses": OWL + "disjointWith", "EquivalentObjectProperties": OWL + "equivalentProperty", "EquivalentDataProperties": OWL + "equivalentProperty", "DisjointObjectProperties": OWL + "propertyDisjointWith", "DisjointDataProperties": OWL + "propertyDisjointWith", "SameIndividual": OWL + "sameAs", "DifferentIndividuals": OWL + "differentFrom"}
    groups = {"DisjointClasses": ("AllDisjointClasses", "members"), "DifferentIndividuals": ("AllDifferent", "distinctMembers")}
    for row in sorted(doc.axioms.values(), key=lambda r: (r["axiom_type"] != "Declaration", r["a1"] or "", r["axiom_type"], r["axiom_id"])):
        kind, a1, a2, a3 = (row[k] for k in ("axiom_type", "a1", "a2", "a3"))
        if kind == "Declaration":
            t = (a1, RDF + "type", TYPE_OF[a2], "iri", "", "")
        elif kind in two:
            s, o = (prop(a1), prop(a2)) if "PropertyOf" in kind else (expr(a1), expr(a2))
            t = (s, two[kind], o, "blank" if o.startswith("_:") else "iri", "", "")
        elif kind in many:
            parts = [expr(x) for x in row["operands"]]
            if kind in groups and len(parts) > 2:
                b = blank()
                iri(b, RDF + "type", OWL + groups[kind][0])
                iri(b, OWL + groups[kind][1], chain([(x, "blank" if x.startswith("_:") else "iri", "", "") for x in parts]))
                continue
            parts.sort(key=lambda x: x.startswith("_:"))
            for x in parts[1:]:
                iri(parts[0], many[kind], x)
                annotated(row, parts[0], many[kind], (x, "blank" if x.startswith("_:") else "iri", "", ""))
            continue
        elif kind in ("SubPropertyChainOf", "HasKey"):
            steps = [prop(x) for x in row["operands"]]
            head = chain([(x, "blank" if x.startswith("_:") else "iri", "", "") for x in steps])
            t = (prop(a1) if kind == "SubPropertyChainOf" else expr(a1), OWL + ("propertyChainAxiom" if kind == "SubPropertyChainOf" else "hasKey"), head, "blank", "", "")
        elif row["negative"]:
            b = blank()
            iri(b, RDF + "type", OWL + "NegativePropertyAssertion")
            iri(b, OWL + "sourceIndividual", a1)
            iri(b, OWL + "assertionProperty", a2)
            if kind == "ObjectPropertyAssertion":
                iri(b, OWL + "targetIndividual", a3)
            else:
                out.append((b, OWL + "targetValue", a3, "literal", row["datatype"] or "", row["lang"] or ""))
            continue
        elif kind == "ObjectPropertyAssertion":
            t = (a1, a2, a3, "iri", "", "")
        elif kind in ("DataPropertyAssertion", "AnnotationAssertion"):
            t = (a1, a2, a3, "iri", "", "") if row["datatype"] == "@iri" else (a1, a2, a3, "literal", row["datatype"] or "", row["lang"] or "")
        else:
            t = (a1, RDF + "type", OWL + kind.replace("ObjectProperty", "Property").replace("DataProperty", "Property"), "iri", "", "")
        out.append(t)
        annotated(row, t[0], t[1], t[2:])
    return list(dict.fromkeys(out))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(axioms, expressions)`` of all documents under ``path``; a document is read by one task."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                triples, prefixes = rdf.parse_document(bytes(content), name)
                doc = from_triples(triples, prefixes)
                rows = [{"x": None, **r} for r in doc.axioms.values()] + [{"x": r["op"], "axiom_id": r["expr_id"], "axiom_type": r["iri"], "a1": r["prop"], "a2": r["filler"], "a3": None if r["card"] is None else str(r["card"]), "operands": r["operands"]} for r in doc.expressions.values()]
                cols = ["x", *AXIOM.fieldNames()]
                yield pd.DataFrame([{c: r.get(c) for c in cols} for r in rows], columns=cols)

    schema = "x string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AXIOM)
    both = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema).cache()
    axioms = both.where("x is null").select(*AXIOM.fieldNames())
    expressions = both.where("x is not null").selectExpr("axiom_id as expr_id", "x as op", "axiom_type as iri", "a1 as prop", "a2 as filler", "cast(a3 as int) as card", "operands")
    return axioms, expressions


def frames(spark: SparkSession, doc: Document) -> tuple[DataFrame, DataFrame]:
    """``(axioms, expressions)`` of a document in memory."""
    return (
        spark.createDataFrame([tuple(r[f] for f in AXIOM.fieldNames()) for r in doc.axioms.values()], AXIOM),
        spark.createDataFrame([tuple(r[f] for f in EXPRESSION.fieldNames()) for r in doc.expressions.values()], EXPRESSION),
    )
