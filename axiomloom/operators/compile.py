"""From tables of terms to axioms: one pass that declares, one that relates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.delimited import split_delimited
from ..functions.identifiers import iri_to_obo, is_true
from ..schema import ANNOTATION_PROPERTY, CLASS, COMMENT, DATA_PROPERTY, DEFINITION, INDIVIDUAL, LABEL, OBJECT_PROPERTY
from .lookup import FOUND, lookup_labels

#: What a table's Type may say, without spaces and in lower case.
TYPES = {"class": CLASS, "dataproperty": DATA_PROPERTY, "objectproperty": OBJECT_PROPERTY, "annotationproperty": ANNOTATION_PROPERTY, "individual": INDIVIDUAL}
CHARACTERISTICS = {
    "functional": "FunctionalObjectProperty", "inverse functional": "InverseFunctionalObjectProperty", "reflexive": "ReflexiveObjectProperty", "irreflexive": "IrreflexiveObjectProperty",
    "symmetric": "SymmetricObjectProperty", "asymmetric": "AsymmetricObjectProperty", "transitive": "TransitiveObjectProperty",
}
#: Columns that list other terms: column, kinds it is for, axiom type by kind, whether the row's term is the second side.
LINKS = (
    ("parent", {CLASS: "SubClassOf", OBJECT_PROPERTY: "SubObjectPropertyOf", DATA_PROPERTY: "SubDataPropertyOf", ANNOTATION_PROPERTY: "SubAnnotationPropertyOf"}, False),
    ("subclass of", {CLASS: "SubClassOf"}, False),
    ("superclass of", {CLASS: "SubClassOf"}, True),
    ("subproperty of", {OBJECT_PROPERTY: "SubObjectPropertyOf", DATA_PROPERTY: "SubDataPropertyOf", ANNOTATION_PROPERTY: "SubAnnotationPropertyOf"}, False),
    ("superproperty of", {OBJECT_PROPERTY: "SubObjectPropertyOf", DATA_PROPERTY: "SubDataPropertyOf", ANNOTATION_PROPERTY: "SubAnnotationPropertyOf"}, True),
    ("equivalent to", {CLASS: "EquivalentClasses"}, False),
    ("disjoint with", {CLASS: "DisjointClasses", OBJECT_PROPERTY: "DisjointObjectProperties", DATA_PROPERTY: "DisjointDataProperties"}, False),
    ("inverse", {OBJECT_PROPERTY: "InverseObjectProperties"}, False),
    ("domain", {OBJECT_PROPERTY: "ObjectPropertyDomain", DATA_PROPERTY: "DataPropertyDomain"}, False),
    ("range", {OBJECT_PROPERTY: "ObjectPropertyRange", DATA_PROPERTY: "DataPropertyRange"}, False),
    ("instance of", {INDIVIDUAL: "ClassAssertion"}, False),
)


class TermTableError(ValueError):
    """Rows that describe no term."""


def term_rows(table: DataFrame, required=("id", "type")) -> DataFrame:
    """``table`` with trimmed cells, no nulls, without rows to ignore, and ``kind``; required columns and known types are checked."""
    names = {c: c.strip().lower() for c in table.columns}
    if missing := set(required) - set(names.values()):
        raise TermTableError(f"Missing required columns: {', '.join(sorted(missing))}")
    rows = table.select(*[F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(n) for c, n in names.items()])
    if "ignore" in rows.columns:
        rows = rows.where(~is_true(F.col("ignore")))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.replace(F.lower(F.col("type")), F.lit(" "), F.lit("")))
    return rows.withColumn("kind", kind)


def bad_rows(rows: DataFrame) -> DataFrame:
    """The rows whose type is blank or unknown, or whose id is blank."""
    return rows.where(F.col("kind").isNull() | (F.col("id") == ""))


def declared(rows: DataFrame) -> DataFrame:
    """``(id, kind)`` of the first pass."""
    return rows.where(F.col("kind").isNotNull()).select("id", "kind").distinct()


def notes(rows: DataFrame) -> DataFrame:
    """``(id, prop, value)``: labels, definitions, comments, and what columns named ``@property`` hold."""
    cols = set(rows.columns)
    parts = [rows.where("label <> ''").select("id", F.lit(LABEL).alias("prop"), F.regexp_replace("label", "^'|'$", "").alias("value"))] if "label" in cols else []
    parts += [rows.where("`text definition` <> ''").select("id", F.lit(DEFINITION).alias("prop"), F.col("text definition").alias("value"))] if "text definition" in cols else []
    listed = [("comments", COMMENT)] + [(c, c[1:].strip()) for c in sorted(cols) if c.startswith("@")]
    for c, prop in listed:
        if c in cols:
            values = F.explode(split_delimited(F.col(f"`{c}`")))
            parts.append(rows.where(F.col(f"`{c}`") != "").select("id", F.lit(prop).alias("prop"), values.alias("value")).select("id", "prop", F.regexp_replace("value", '^"|"$', "").alias("value")))
    return reduce(DataFrame.unionByName, parts) if parts else rows.select("id", F.lit("").alias("prop"), F.lit("").alias("value")).limit(0)


def links(rows: DataFrame) -> DataFrame:
    """``(axiom_type, a1, a2)``: what the columns that list other terms say, names as written."""
    parts = []
    for column, kinds, turned in LINKS:
        if column in rows.columns:
            axiom = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
            part = rows.where((F.col(f"`{column}`") != "") & F.col("kind").isin(*kinds)).select(axiom.alias("axiom_type"), "id", F.explode(split_delimited(F.col(f"`{column}`"))).alias("other"))
            parts.append(part.select("axiom_type", F.col("other" if turned else "id").alias("a1"), F.col("id" if turned else "other").alias("a2")))
    if "characteristics" in rows.columns:
        items = rows.where("characteristics <> ''").select("id", "kind", F.explode(F.filter(F.transform(F.split(F.lower("characteristics"), ","), lambda x: F.trim(x)), lambda x: x != "")).alias("item"))
        named = F.element_at(F.create_map(*[F.lit(x) for kv in CHARACTERISTICS.items() for x in kv]), F.col("item"))
        axiom = F.when((F.col("kind") == DATA_PROPERTY) & (F.col("item") == "functional"), "FunctionalDataProperty").when(F.col("kind") == OBJECT_PROPERTY, named)
        parts.append(items.select(axiom.alias("axiom_type"), F.col("id").alias("a1"), F.lit(None).cast("string").alias("a2")))
    return reduce(DataFrame.unionByName, parts) if parts else rows.select(F.lit("").alias("axiom_type"), F.col("id").alias("a1"), F.col("id").alias("a2")).limit(0)


def compiled(rows: DataFrame) -> DataFrame:
    """``(axiom_type, a1, a2, a3)``: declarations, annotations and links of term rows, names as written."""
    nothing = F.lit(None).cast("string")
    d = declared(rows).select(F.lit("Declaration").alias("axiom_type"), F.col("id").alias("a1"), F.col("kind").alias("a2"), nothing.alias("a3"))
    n = notes(rows).select(F.lit("AnnotationAssertion").alias("axiom_type"), F.col("id").alias("a1"), F.col("prop").alias("a2"), F.col("value").alias("a3"))
    k = links(rows).select("axiom_type", "a1", "a2", nothing.alias("a3"))
    return d.unionByName(n).unionByName(k).distinct()


_MARK = r"\{[^{}]+\}"


def expand_definitions(definitions: DataFrame, labels: DataFrame, prefixes: DataFrame, base: str) -> DataFrame:
    """``(id, text, expanded, missing)`` for ``definitions(id, text)``.

    ``{label}`` becomes ``'label' (ID)``, ``{$label}`` just ``(ID)``; quotes around the label are
    put right, a prefix before it stays and narrows the search. The ID is an OBO identifier,
    else a prefixed name, else the IRI. ``missing`` counts labels that name no or several
    entities; their places stay as they were. ``{}`` stays.
    """
    marked = definitions.select("id", "text", F.posexplode_outer(F.regexp_extract_all("text", F.lit(_MARK), F.lit(0))).alias("at", "mark"))
    inner = F.trim(F.regexp_replace("mark", r"^\{\s*\$?|\}$", ""))
    prefix = F.regexp_extract(inner, r"^([A-Za-z_][\w.-]*):", 1)
    label = F.trim(F.regexp_replace(F.regexp_replace(inner, r"^[A-Za-z_][\w.-]*:", ""), r"^\s*'|'\s*$", ""))
    marked = marked.withColumns({"quiet": F.regexp_like("mark", F.lit(r"^\{\s*\$")), "prefix": prefix, "label": label, "root": F.when(prefix == "", "").otherwise(F.concat(F.lit(base), prefix))})
    hits = lookup_labels(marked.where("mark is not null").select("label", "root"), labels).withColumnsRenamed({"label": "_label", "root": "_root"})
    joined = marked.join(hits, (F.col("label") == F.col("_label")) & (F.col("root") == F.col("_root")), "left")
    spaces = prefixes.select(F.col("prefix").alias("_p"), "namespace")
    short = joined.where(F.col("status") == FOUND).select("iri").distinct().join(spaces, F.startswith("iri", F.col("namespace")) & (F.col("namespace") != ""))
    short = short.groupBy("iri").agg(F.max_by(F.concat("_p", F.lit(":"), F.substring("iri", F.length("namespace") + 1, F.length("iri"))), F.struct(F.length("namespace"), "_p")).alias("curie")).withColumnRenamed("iri", "_iri")
    joined = joined.join(short, F.col("iri") == F.col("_iri"), "left")
    name = F.coalesce(iri_to_obo(F.col("iri"), base), F.col("curie"), F.col("iri"))
    shown = F.concat(F.when(F.col("prefix") == "", "").otherwise(F.concat("prefix", F.lit(":"))), F.lit("'"), "label", F.lit("' "))
    new = F.when(F.col("mark").isNull(), "").when(F.col("status") == FOUND, F.concat(F.when(F.col("quiet"), "").otherwise(shown), F.lit("("), name, F.lit(")"))).otherwise(F.col("mark"))
    lost = F.sum((F.col("mark").isNotNull() & (F.coalesce("status", F.lit("")) != FOUND)).cast("int"))
    told = joined.groupBy("id", "text").agg(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("new"), lost.alias("missing"))
    gaps = F.split("text", _MARK, -1)
    expanded = F.when(F.size(F.regexp_extract_all("text", F.lit(_MARK), F.lit(0))) == 0, F.col("text")).otherwise(F.array_join(F.zip_with(gaps, F.transform("new", lambda x: x["new"]), lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), ""))
    return told.select("id", "text", expanded.alias("expanded"), "missing")
