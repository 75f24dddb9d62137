"""RDF documents: N-Triples by Spark itself; RDF/XML and Turtle parsed document by document.

A triple is ``(s, p, o, kind, datatype, lang)`` with ``kind`` iri, blank or literal. Blank
nodes are written ``_:name``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RDF, XSD

TRIPLE = "doc string, s string, p string, o string, kind string, datatype string, lang string"
XML = "http://www.w3.org/XML/1998/namespace"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
#: Lines of N-Triples: subject, predicate, object.
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


class RDFError(ValueError):
    """A document that can't be read."""


#: Parts of a string with escapes: one escape, or what stands between two.
_PARTS = r"(?s)\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)|[^\\]+"


def unescaped(col):
    """Column: ``col`` with its escapes undone, in one pass from left to right."""

    def part(x):
        code = F.substring(x, 3, 8)
        wide = F.decode(F.unhex(code), "UTF-32")
        narrow = F.decode(F.unhex(F.concat(F.lit("0000"), code)), "UTF-32")
        sign = F.substring(x, 2, 1)
        plain = F.when(sign == "t", "\t").when(sign == "n", "\n").when(sign == "r", "\r").when(sign == "b", "\b").when(sign == "f", "\f").otherwise(sign)
        return F.when(~F.startswith(x, F.lit("\\")), x).when(F.length(x) == 10, wide).when(F.length(x) == 6, narrow).otherwise(plain)

    done = F.array_join(F.transform(F.regexp_extract_all(col, F.lit(_PARTS), F.lit(0)), part), "")
    return F.when(F.contains(col, F.lit("\\")), done).otherwise(col)


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The triples of N-Triples files, line by line in the JVM.

    Blank lines and comments are passed over. Any other line that is no triple is an error
    that quotes it; with ``strict`` false it is left out.
    """
    lines = spark.read.text(path).where(~F.regexp_like("value", F.lit(r"^\s*(?:#.*)?$")))
    fits = F.regexp_like("value", F.lit(_LINE))
    if strict:
        lines = lines.select(F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("Not a triple: "), "value"))).alias("value"))
    else:
        lines = lines.where(fits)
    s, p, o = (F.regexp_extract("value", _LINE, k) for k in (1, 2, 3))
    rows = lines.select(s.alias("s"), p.alias("p"), o.alias("o"))
    bare = lambda c: unescaped(F.regexp_replace(c, "^<|>$", ""))
    kind = F.when(F.startswith("o", F.lit("<")), "iri").when(F.startswith("o", F.lit("_:")), "blank").otherwise("literal")
    text = unescaped(F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*+)"', 1))
    return rows.select(
        bare(F.col("s")).alias("s"), unescaped(F.col("p")).alias("p"), F.when(kind == "literal", text).otherwise(bare(F.col("o"))).alias("o"), kind.alias("kind"),
        unescaped(F.regexp_extract("o", r'"\^\^<([^>]*)>$', 1)).alias("datatype"), F.regexp_extract("o", r'"@([A-Za-z0-9-]+)$', 1).alias("lang"),
    )


class _Blanks:
    def __init__(self):
        self.n = 0

    def new(self) -> str:
        self.n += 1
        return f"_:b{self.n}"


def parse_rdfxml(text: str | bytes, base: str = "") -> tuple[list[tuple], dict[str, str]]:
    """``(triples, prefixes)`` of an RDF/XML document."""
    data = text.encode() if isinstance(text, str) else text
    prefixes: dict[str, str] = {}
    try:
        for _, (prefix, uri) in ElementTree.iterparse(_stream(data), events=("start-ns",)):
            prefixes.setdefault(prefix, uri)
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise RDFError(f"Not XML: {e}") from e
    out, blanks = [], _Blanks()
    tag = lambda e: e.tag[1:].replace("}", "", 1) if e.tag.startswith("{") else e.tag

    def scope(e, base):
        return e.get(f"{{{XML}}}base", base)

    def node(e, base, lang) -> str:
        base, lang = scope(e, base), e.get(f"{{{XML}}}lang", lang)
        about, ident, named = e.get(f"{{{RDF}}}about"), e.get(f"{{{RDF}}}ID"), e.get(f"{{{RDF}}}nodeID")
        s = urljoin(base, about) if about is not None else urljoin(base, "#" + ident) if ident else f"_:n{named}" if named else blanks.new()
        if tag(e) != RDF + "Description":
            out.append((s, RDF + "type", tag(e), "iri", "", ""))
        for k, v in e.attrib.items():
            k = k[1:].replace("}", "", 1) if k.startswith("{") else k
            if not k.startswith((RDF, XML)) and ":" in k:
                out.append((s, k, v, "literal", "", lang))
        for child in e:
            prop(s, child, base, lang)
        return s

    def prop(s, e, base, lang):
        base, lang = scope(e, base), e.get(f"{{{XML}}}lang", lang)
        p, resource, kind, named = tag(e), e.get(f"{{{RDF}}}resource"), e.get(f"{{{RDF}}}parseType"), e.get(f"{{{RDF}}}nodeID")
        if resource is not None:
            out.append((s, p, urljoin(base, resource), "iri", "", ""))
        elif named:
            out.append((s, p, f"_:n{named}", "blank", "", ""))
        elif kind == "Resource":
            b = blanks.new()
            out.append((s, p, b, "blank", "", ""))
            for child in e:
                prop(b, child, base, lang)
        elif kind == "Collection":
            _list(out, s, p, [node(c, base, lang) for c in e], blanks)
        elif kind == "Literal":
            out.append((s, p, (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e), "literal", RDF + "XMLLiteral", ""))
        elif len(e):
            o = node(e[0], base, lang)
            out.append((s, p, o, "blank" if o.startswith("_:") else "iri", "", ""))
        else:
            dt = e.get(f"{{{RDF}}}datatype", "")
            out.append((s, p, e.text or "", "literal", urljoin(base, dt) if dt else "", "" if dt else lang))

    top = scope(root, base)
    for child in root if tag(root) == RDF + "RDF" else [root]:
        node(child, top, root.get(f"{{{XML}}}lang", ""))
    return out, prefixes


def _stream(data: bytes):
    from io import BytesIO

    return BytesIO(data)


def _list(out: list, s: str, p: str, items: list[str], blanks: _Blanks) -> None:
    at = s, p
    for item in items:
        b = blanks.new()
        out.append((*at, b, "blank", "", ""))
        out.append((b, FIRST, item, "blank" if item.startswith("_:") else "iri", "", ""))
        at = b, REST
    out.append((*at, NIL, "iri", "", ""))


_TURTLE = re.compile(
    r'''(?P<space>(?:\s|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<literal>"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""|\'\'\'(?:(?:'|'')?(?:[^'\\]|\\.))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<keyword>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[\w.-]*:?\s*<))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
    |(?P<blank>_:[\w.-]*[\w-])|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:%-]|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:%-]|\\.))?)?)
    |(?P<word>a\b|true\b|false\b)|(?P<sign>[.;,\[\]()])''',
    re.X,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


def parse_turtle(text: str, base: str = "") -> tuple[list[tuple], dict[str, str]]:
    """``(triples, prefixes)`` of a Turtle document (N-Triples is Turtle too)."""
    got, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise RDFError(f"Unexpected text at {at}: {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup != "space":
            got.append((m.lastgroup, m[0]))
    out, prefixes, blanks, k = [], {}, _Blanks(), 0

    def peek():
        return got[k] if k < len(got) else ("end", "")

    def take(sign=None):
        nonlocal k
        kind, token = peek()
        if sign and (kind != "sign" or token != sign):
            raise RDFError(f"{sign!r} expected before {token!r}")
        k += 1
        return kind, token

    def resource():
        kind, token = take()
        if kind == "iri":
            return urljoin(base, _unescaped(token[1:-1])) if base else _unescaped(token[1:-1])
        if kind == "name":
            prefix, _, local = token.partition(":")
            if prefix not in prefixes:
                raise RDFError(f"Unknown prefix: {prefix}")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        if kind == "blank":
            return "_:n" + token[2:]
        raise RDFError(f"A resource is expected before {token!r}")

    def thing():
        """(value, kind, datatype, lang)"""
        kind, token = peek()
        if kind == "literal":
            take()
            q = 3 if token[:3] in ('"""', "'''") else 1
            value = _unescaped(token[q:-q])
            if peek()[0] == "lang":
                return value, "literal", "", take()[1][1:]
            if peek()[0] == "type":
                take()
                return value, "literal", resource(), ""
            return value, "literal", "", ""
        if kind == "number":
            take()
            return token, "literal", XSD + ("double" if re.search("[eE]", token) else "decimal" if "." in token else "integer"), ""
        if kind == "word" and token != "a":
            take()
            return token, "literal", XSD + "boolean", ""
        if token == "[":
            take()
            b = blanks.new()
            if peek()[1] != "]":
                predicates(b)
            take("]")
            return b, "blank", "", ""
        if token == "(":
            take()
            items = []
            while peek()[1] != ")":
                items.append(thing())
            take(")")
            head, last = NIL, None
            for item in items:
                b = blanks.new()
                if last is None:
                    head = b
                else:
                    out.append((last, REST, b, "blank", "", ""))
                out.append((b, FIRST, *item))
                last = b
            if last:
                out.append((last, REST, NIL, "iri", "", ""))
            return head, "iri" if head == NIL else "blank", "", ""
        value = resource()
        return value, "blank" if value.startswith("_:") else "iri", "", ""

    def predicates(s):
        while True:
            if peek() == ("word", "a"):
                take()
                p = RDF + "type"
            else:
                p = resource()
            out.append((s, p, *thing()))
            while peek()[1] == ",":
                take()
                out.append((s, p, *thing()))
            if peek()[1] != ";":
                return
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]"):
                return

    while k < len(got):
        kind, token = peek()
        if kind == "keyword":
            take()
            if token.lower().lstrip("@") == "prefix":
                prefix = take()[1].rstrip(":")
                prefixes[prefix] = resource()
            else:
                base = resource()
            if token[0] == "@":
                take(".")
            continue
        s = thing()[0]
        if peek()[1] != ".":
            predicates(s)
        take(".")
    return out, prefixes


def parse_document(text: str | bytes, name: str = "") -> tuple[list[tuple], dict[str, str]]:
    """The triples and prefixes of a document in whatever of the formats it is in."""
    text = text.decode("utf-8-sig") if isinstance(text, bytes) else text.lstrip("\ufeff")
    head = text.lstrip()[:400]
    if head.startswith("<?xml") or re.match(r"<(?:!--|!DOCTYPE|(?:\w+:)?RDF[\s>])", head):
        return parse_rdfxml(text)
    return parse_turtle(text)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The triples of whole documents, one task or more for each file; ``doc`` is the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["path"], pdf["content"], strict=True):
                triples, _ = parse_document(bytes(content), doc)
                yield pd.DataFrame([(doc, s, p, o, kind, dt, lang) for s, p, o, kind, dt, lang in triples], columns=["doc", "s", "p", "o", "kind", "datatype", "lang"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, TRIPLE)


def ntriples_text(triples) -> str:
    """Triples as N-Triples, in order and each once."""

    def term(x, kind, dt="", lang=""):
        if kind == "literal":
            quoted = x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
            return f'"{quoted}"' + (f"@{lang}" if lang else f"^^<{dt}>" if dt else "")
        return x if x.startswith("_:") else f"<{x}>"

    return "".join(sorted({f"{term(s, 'iri')} <{p}> {term(o, kind, dt, lang)} .\n" for s, p, o, kind, dt, lang in triples}))
