"""Names and table layouts of the ontology model."""

from __future__ import annotations

from pyspark.sql import types as T

OBO_BASE = "http://purl.obolibrary.org/obo/"
OWL = "http://www.w3.org/2002/07/owl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DC = "http://purl.org/dc/elements/1.1/"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OIO = "http://www.geneontology.org/formats/oboInOwl#"

LABEL, COMMENT = RDFS + "label", RDFS + "comment"
DEFINITION = OBO_BASE + "IAO_0000115"
IMPORTED_FROM = OBO_BASE + "IAO_0000412"
SOURCE = DC + "source"
IS_INFERRED = OIO + "is_inferred"
THING, NOTHING = OWL + "Thing", OWL + "Nothing"
#: Entities whose axioms say nothing.
TRIVIAL = (THING, NOTHING, OWL + "topObjectProperty", OWL + "bottomObjectProperty", OWL + "topDataProperty", OWL + "bottomDataProperty")

CLASS, OBJECT_PROPERTY, ANNOTATION_PROPERTY, DATA_PROPERTY, INDIVIDUAL = "class", "oprop", "aprop", "dprop", "indiv"
#: In the order in which a lookup by IRI alone prefers them.
KINDS = (CLASS, OBJECT_PROPERTY, ANNOTATION_PROPERTY, DATA_PROPERTY, INDIVIDUAL)

#: Annotation properties that search looks into.
SEARCHED = (
    LABEL,
    OIO + "hasSynonym",
    OIO + "hasExactSynonym",
    OIO + "hasNarrowSynonym",
    OIO + "hasBroadSynonym",
    OIO + "hasRelatedSynonym",
    SKOS + "prefLabel",
    SKOS + "altLabel",
    SKOS + "hiddenLabel",
)

#: How short names of the searched properties begin; fixed values.
PREFIXES = {"rdfs": RDFS, "oboInOwl": OIO, "skos": SKOS}

#: One row for each axiom. ``a1`` to ``a3`` are IRIs, literals or keys of class expressions, by ``axiom_type``.
AXIOM = T.StructType(
    [
        T.StructField("ontology_iri", T.StringType()),
        T.StructField("axiom_id", T.StringType()),
        T.StructField("axiom_type", T.StringType()),
        T.StructField("negative", T.BooleanType()),
        T.StructField("a1", T.StringType()),
        T.StructField("a2", T.StringType()),
        T.StructField("a3", T.StringType()),
        T.StructField("operands", T.ArrayType(T.StringType())),
        T.StructField("datatype", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("ax_annotations", T.ArrayType(T.StringType())),
        T.StructField("inferred", T.BooleanType()),
    ]
)

#: Class expressions by key: ``op`` is named, and, or, not, some, only, min, max, exactly, value, self or oneof.
EXPRESSION = T.StructType(
    [
        T.StructField("expr_id", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("iri", T.StringType()),
        T.StructField("prop", T.StringType()),
        T.StructField("filler", T.StringType()),
        T.StructField("card", T.IntegerType()),
        T.StructField("operands", T.ArrayType(T.StringType())),
    ]
)
