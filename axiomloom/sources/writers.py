"""Serialisers of an ontology document: N-Triples, Turtle, RDF/XML, OWL/XML, Manchester."""

from __future__ import annotations

from collections import defaultdict
from xml.sax.saxutils import escape, quoteattr

from ..schema import OWL, RDF, RDFS, XSD
from . import owl, rdf

FORMATS = ("RDF/XML", "Turtle", "OWL/XML", "Manchester", "N-Triples")
_PREFIXES = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}


def write(doc: owl.Document, form: str = "RDF/XML") -> str:
    """``doc`` in one of ``FORMATS``, in any case."""
    known = {"rdf/xml": _rdfxml, "turtle": _turtle, "owl/xml": _owlxml, "manchester": _manchester, "n-triples": lambda d: rdf.ntriples_text(owl.to_triples(d))}
    if form.lower() not in known:
        raise ValueError(f"Unsupported output format: {form}. Known formats: {', '.join(FORMATS)}.")
    return known[form.lower()](doc)


def _prefixes(doc) -> dict[str, str]:
    return _PREFIXES | {k: v for k, v in doc.prefixes.items() if k != "xml"}


def _curie(iri: str, prefixes: dict[str, str]) -> str | None:
    best = max(((len(ns), p, ns) for p, ns in prefixes.items() if ns and iri.startswith(ns)), default=None)
    local = iri[best[0] :] if best else ""
    return f"{best[1]}:{local}" if local and local.replace("_", "a").replace("-", "a").isalnum() and local.isascii() else None


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _turtle(doc) -> str:
    prefixes, by = _prefixes(doc), defaultdict(lambda: defaultdict(list))
    for s, p, *o in owl.to_triples(doc):
        by[s][p].append(o)

    def name(x):
        return x if x.startswith("_:") else _curie(x, prefixes) or f"<{x}>"

    def value(o, kind, dt, lang):
        return name(o) if kind != "literal" else _quoted(o) + (f"@{lang}" if lang else f"^^{name(dt)}" if dt else "")

    out = [f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.items())]
    for s, ps in by.items():
        lines = [("a" if p == RDF + "type" else name(p)) + " " + " , ".join(value(*o) for o in values) for p, values in ps.items()]
        out.append(f"\n{name(s)} " + " ;\n    ".join(lines) + " .\n")
    return "".join(out)


def _rdfxml(doc) -> str:
    prefixes = {p: ns for p, ns in _prefixes(doc).items() if p}
    by = defaultdict(list)
    for s, *rest in owl.to_triples(doc):
        by[s].append(rest)

    def tag(iri):
        cut = max(iri.rfind("#"), iri.rfind("/"), iri.rfind(":")) + 1
        while cut < len(iri) and not (iri[cut].isalpha() or iri[cut] == "_"):
            cut += 1
        ns, local = iri[:cut], iri[cut:]
        p = next((k for k, v in prefixes.items() if v == ns), None)
        if p is None:
            p = f"ns{len(prefixes)}"
            prefixes[p] = ns
        return f"{p}:{local}"

    body = []
    for s, rest in by.items():
        types = [o for p, o, kind, *_ in rest if p == RDF + "type" and kind == "iri"]
        head = tag(types[0]) if types else "rdf:Description"
        own = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s)}"
        body.append(f"  <{head} {own}>\n")
        for p, o, kind, dt, lang in rest:
            if types and p == RDF + "type" and o == types[0]:
                continue
            t = tag(p)
            if kind == "literal":
                extra = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                body.append(f"    <{t}{extra}>{escape(o)}</{t}>\n")
            else:
                body.append(f"    <{t} " + (f"rdf:nodeID={quoteattr(o[2:])}" if o.startswith("_:") else f"rdf:resource={quoteattr(o)}") + "/>\n")
        body.append(f"  </{head}>\n")
    names = "".join(f"\n    xmlns:{p}={quoteattr(ns)}" for p, ns in sorted(prefixes.items()))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{names}>\n{"".join(body)}</rdf:RDF>\n'


_ENTITY = {"class": "Class", "oprop": "ObjectProperty", "dprop": "DataProperty", "aprop": "AnnotationProperty", "indiv": "NamedIndividual"}


def _kinds(doc) -> dict[str, str]:
    return {r["a1"]: r["a2"] for r in doc.axioms.values() if r["axiom_type"] == "Declaration"}


def _owlxml(doc) -> str:
    kinds = _kinds(doc)

    def literal(value, dt, lang):
        return "<Literal" + (f" xml:lang={quoteattr(lang)}" if lang else f" datatypeIRI={quoteattr(dt)}" if dt else "") + f">{escape(value)}</Literal>"

    def prop(p, kind="ObjectProperty"):
        if p.startswith("inverse("):
            return f"<ObjectInverseOf>{prop(p[8:-1])}</ObjectInverseOf>"
        return f"<{_ENTITY.get(kinds.get(p), kind)} IRI={quoteattr(p)}/>"

    def expr(key):
        e = doc.expressions.get(key)
        if e is None:
            return f"<{'Datatype' if key.startswith(XSD) else 'Class'} IRI={quoteattr(key)}/>"
        op = e["op"]
        if op == "literal":
            return literal(*e["iri"].split("\x1f"))
        if op == "datatype":
            facets = "".join(f"<FacetRestriction facet={quoteattr(XSD + f.partition(' ')[0])}>{literal(f.partition(' ')[2], e['iri'], '')}</FacetRestriction>" for f in e["operands"] or [])
            return f"<DatatypeRestriction><Datatype IRI={quoteattr(e['iri'])}/>{facets}</DatatypeRestriction>"
        if op in ("and", "or", "oneof"):
            t = {"and": "ObjectIntersectionOf", "or": "ObjectUnionOf", "oneof": "ObjectOneOf"}[op]
            return f"<{t}>" + "".join(expr(x) if op != "oneof" or x in doc.expressions else f"<NamedIndividual IRI={quoteattr(x)}/>" for x in e["operands"]) + f"</{t}>"
        if op == "not":
            return f"<ObjectComplementOf>{expr(e['filler'])}</ObjectComplementOf>"
        side = "Data" if kinds.get(e["prop"]) == "dprop" else "Object"
        t = side + {"some": "SomeValuesFrom", "only": "AllValuesFrom", "value": "HasValue", "self": "HasSelf", "min": "MinCardinality", "max": "MaxCardinality", "exactly": "ExactCardinality"}[op]
        card = f' cardinality="{e["card"]}"' if e["card"] is not None else ""
        filler = "" if not e["filler"] else f"<NamedIndividual IRI={quoteattr(e['filler'])}/>" if op == "value" and e["filler"] not in doc.expressions else expr(e["filler"])
        return f"<{t}{card}>{prop(e['prop'])}{filler}</{t}>"

    def one(row):
        kind, a1, a2, a3 = (row[k] for k in ("axiom_type", "a1", "a2", "a3"))
        notes = "".join(f"<Annotation><AnnotationProperty IRI={quoteattr(a.partition(' ')[0])}/>{literal(a.partition(' ')[2], '', '')}</Annotation>" for a in row["ax_annotations"] or [])
        name = ("Negative" if row["negative"] else "") + kind
        ind = lambda x: f"<NamedIndividual IRI={quoteattr(x)}/>"
        if kind == "Declaration":
            body = f"<{_ENTITY[a2]} IRI={quoteattr(a1)}/>"
        elif kind == "AnnotationAssertion":
            body = f"<AnnotationProperty IRI={quoteattr(a2)}/><IRI>{escape(a1)}</IRI>" + (f"<IRI>{escape(a3)}</IRI>" if row["datatype"] == "@iri" else literal(a3, row["datatype"], row["lang"]))
        elif row["operands"]:
            body = "".join(map(expr if "Classes" in kind else prop, row["operands"]))
        elif kind == "ClassAssertion":
            body = expr(a2) + ind(a1)
        elif kind == "ObjectPropertyAssertion":
            body = prop(a2) + ind(a1) + ind(a3)
        elif kind == "DataPropertyAssertion":
            body = prop(a2, "DataProperty") + ind(a1) + literal(a3, row["datatype"], row["lang"])
        elif kind == "SubClassOf":
            body = expr(a1) + expr(a2)
        elif kind.endswith(("Domain", "Range")):
            body = prop(a1) + (f"<IRI>{escape(a2)}</IRI>" if kind.startswith("Annotation") else expr(a2))
        else:
            body = prop(a1) + (prop(a2) if a2 else "")
        return f"  <{name}>{notes}{body}</{name}>\n"

    head = (f" ontologyIRI={quoteattr(doc.iri)}" if doc.iri else "") + (f" versionIRI={quoteattr(doc.version)}" if doc.version else "")
    parts = [f"  <Prefix name={quoteattr(p)} IRI={quoteattr(ns)}/>\n" for p, ns in sorted(_prefixes(doc).items())]
    parts += [f"  <Import>{escape(i)}</Import>\n" for i in doc.imports]
    parts += [f"  <Annotation><AnnotationProperty IRI={quoteattr(p)}/>" + (f"<IRI>{escape(o)}</IRI>" if kind == "iri" else literal(o, "", "")) + "</Annotation>\n" for p, o, kind in doc.annotations]
    parts += [one(r) for r in sorted(doc.axioms.values(), key=lambda r: (r["axiom_type"] != "Declaration", r["axiom_type"], r["axiom_id"]))]
    return f'<?xml version="1.0"?>\n<Ontology xmlns={quoteattr(OWL)}{head}>\n{"".join(parts)}</Ontology>\n'


def expression_text(key: str, expressions: dict[str, dict], name=lambda iri: f"<{iri}>") -> str:
    """A class expression in Manchester syntax."""
    e = expressions.get(key)
    if e is None:
        return name(key)
    op = e["op"]
    inner = lambda k: expression_text(k, expressions, name) if k not in expressions or expressions[k]["op"] in ("oneof", "literal", "datatype") else f"({expression_text(k, expressions, name)})"
    if op == "literal":
        value, dt, lang = e["iri"].split("\x1f")
        return _quoted(value) + (f"@{lang}" if lang else f"^^{name(dt)}" if dt else "")
    if op in ("and", "or"):
        return f" {op} ".join(map(inner, e["operands"]))
    if op == "not":
        return f"not {inner(e['filler'])}"
    if op == "oneof":
        return "{" + ", ".join(map(inner, e["operands"])) + "}"
    if op == "datatype":
        return name(e["iri"]) + ("[" + ", ".join(e["operands"]) + "]" if e["operands"] else "")
    p = f"inverse {name(e['prop'][8:-1])}" if e["prop"].startswith("inverse(") else name(e["prop"])
    if op == "self":
        return f"{p} Self"
    return f"{p} {op}" + (f" {e['card']}" if e["card"] is not None else "") + (f" {inner(e['filler'])}" if e["filler"] else "")


def _manchester(doc) -> str:
    prefixes = _prefixes(doc)
    name = lambda iri: _curie(iri, prefixes) or f"<{iri}>"
    text = lambda key: expression_text(key, doc.expressions, name)
    frames: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    frame = {"class": "Class", "oprop": "ObjectProperty", "dprop": "DataProperty", "aprop": "AnnotationProperty", "indiv": "Individual"}
    rest = []
    two = {"SubClassOf": "SubClassOf", "ClassAssertion": "Types", "InverseObjectProperties": "InverseOf", "SubObjectPropertyOf": "SubPropertyOf", "SubDataPropertyOf": "SubPropertyOf", "SubAnnotationPropertyOf": "SubPropertyOf"}
    for r in sorted(doc.axioms.values(), key=lambda r: r["axiom_id"]):
        kind, a1, a2, a3 = (r[k] for k in ("axiom_type", "a1", "a2", "a3"))
        note = "Annotations: " + ", ".join(f"{name(a.partition(' ')[0])} {_quoted(a.partition(' ')[2])}" for a in r["ax_annotations"]) + " " if r["ax_annotations"] else ""
        if kind == "Declaration":
            frames[a1].setdefault("", []).append(frame[a2])
        elif kind == "AnnotationAssertion":
            frames[a1]["Annotations"].append(f"{name(a2)} " + (name(a3) if r["datatype"] == "@iri" else _quoted(a3) + (f"@{r['lang']}" if r["lang"] else f"^^{name(r['datatype'])}" if r["datatype"] else "")))
        elif kind in two and a1 not in doc.expressions:
            frames[a1][two[kind]].append(note + text(a2))
        elif kind.endswith(("Domain", "Range")):
            frames[a1]["Domain" if kind.endswith("Domain") else "Range"].append(note + text(a2))
        elif kind.endswith("PropertyAssertion"):
            value = name(a3) if kind.startswith("Object") else _quoted(a3) + (f"@{r['lang']}" if r["lang"] else f"^^{name(r['datatype'])}" if r["datatype"] else "")
            frames[a1]["Facts"].append(note + ("not " if r["negative"] else "") + f"{name(a2)} {value}")
        elif r["operands"] and len(r["operands"]) == 2 and any(x not in doc.expressions for x in r["operands"]):
            first, other = sorted(r["operands"], key=lambda x: x in doc.expressions)
            frames[first]["EquivalentTo" if kind.startswith("Equivalent") else "DisjointWith"].append(note + text(other))
        elif r["operands"]:
            rest.append(f"{kind}: " + note + ", ".join(map(text, r["operands"])))
        elif kind == "SubClassOf":
            rest.append(f"Class: {text(a1)}\n    SubClassOf: {note}{text(a2)}")
        else:
            frames[a1]["Characteristics"].append(kind.replace("ObjectProperty", "").replace("DataProperty", ""))
    out = [f"Prefix: {p}: <{ns}>\n" for p, ns in sorted(prefixes.items())]
    out.append("\nOntology:" + (f" <{doc.iri}>" if doc.iri else "") + (f" <{doc.version}>" if doc.version else "") + "\n")
    out += [f"Import: <{i}>\n" for i in doc.imports]
    for iri in sorted(frames):
        sections = frames[iri]
        for kind in sections.pop("", ["Class"]):
            out.append(f"\n{kind}: {name(iri)}\n" + "".join(f"    {k}: " + ",\n        ".join(v) + "\n" for k, v in sections.items()))
            sections = {}
    return "".join(out) + "".join(f"\n{r}\n" for r in rest)
