"""Sets of axioms: union, removal, merging with provenance, imports, single-entity modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpoints import settled
from ..schema import ANNOTATION_PROPERTY, IMPORTED_FROM, LABEL
from .closure import closure
from .relations import related

#: Axiom types that say what a property is like.
CHARACTERISTICS = (
    "FunctionalObjectProperty",
    "InverseFunctionalObjectProperty",
    "ReflexiveObjectProperty",
    "IrreflexiveObjectProperty",
    "SymmetricObjectProperty",
    "AsymmetricObjectProperty",
    "TransitiveObjectProperty",
    "FunctionalDataProperty",
)


class OntologyError(ValueError):
    """A request that the ontology can't fulfil."""


def union(*parts: DataFrame, key: str = "axiom_id") -> DataFrame:
    """The axioms of all ``parts``, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates([key])


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``left`` without one of equal ``keys`` in ``right`` (a set difference; nulls are equal).

    Both may be large: files that are small may hold many rows, so ``right`` isn't broadcast.
    """
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().hint("merge")
    on = [left[k].eqNullSafe(r[f"_{k}"]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, "left_anti")


def imports_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """``(ontology_iri, import_iri)``: everything that ``roots(ontology_iri)`` import over any number of steps, themselves included."""
    edges = imports.select(F.col("ontology_iri").alias("src"), F.col("import_iri").alias("dst"))
    found = closure(edges, roots.select(F.col("ontology_iri").alias("start")), include_start=True)
    return found.select(F.col("start").alias("ontology_iri"), F.col("node").alias("import_iri"))


def signature(axioms: DataFrame, expressions: DataFrame | None = None) -> DataFrame:
    """``(axiom_id, iri)``: the entities that each axiom names, in its class expressions too.

    A position that holds a key of an expression (``_:...``) stands for the names below it.
    """
    parts = F.array_distinct(F.filter(F.concat(F.array("a1", "a2", F.when(~F.col("axiom_type").isin("DataPropertyAssertion", "AnnotationAssertion"), F.col("a3"))), F.coalesce("operands", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    direct = axioms.select("axiom_id", F.explode(parts).alias("iri"))
    if expressions is None:
        return direct.where(~F.startswith("iri", F.lit("_:"))).distinct()
    below = expressions.select(F.col("expr_id").alias("src"), F.explode(F.filter(F.concat(F.array("iri", "prop", "filler"), F.coalesce("operands", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("dst"))
    named = closure(below).select(F.col("start").alias("expr"), F.col("node").alias("name"))
    nested = direct.where(F.startswith("iri", F.lit("_:"))).join(named, F.col("iri") == F.col("expr")).select("axiom_id", F.col("name").alias("iri"))
    return direct.unionByName(nested).where(~F.startswith("iri", F.lit("_:"))).distinct()


def remove_entities(axioms: DataFrame, entities: DataFrame, signatures: DataFrame, with_annotations: bool = True) -> DataFrame:
    """``axioms`` without those that name one of ``entities(iri)``.

    Annotation assertions go only if the entity is what they are about, and only
    ``with_annotations``; so annotations by a removed annotation property stay.
    """
    gone = entities.select("iri").distinct()
    named = signatures.join(gone, "iri", "left_semi").select("axiom_id").distinct()
    about = F.col("axiom_type") == "AnnotationAssertion"
    rest = axioms.where(~about).join(named, "axiom_id", "left_anti")
    notes = axioms.where(about)
    if with_annotations:
        notes = notes.join(gone, notes["a1"] == gone["iri"], "left_anti")
    return rest.unionByName(notes)


def merged(target: DataFrame, source: DataFrame, key: str = "axiom_id") -> DataFrame:
    """``target`` with the axioms of ``source`` that it lacks."""
    return target.unionByName(source.dropDuplicates([key]).join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def imported_from(declarations: DataFrame, source_iri: str | None) -> DataFrame:
    """``(subject, prop, value)``: for each declared entity, where it was merged from; nothing without a source."""
    rows = declarations.select(F.col("iri").alias("subject"), F.lit(IMPORTED_FROM).alias("prop"), F.lit(source_iri).alias("value")).distinct()
    return rows if source_iri else rows.limit(0)


def without_import(imports: DataFrame, ontology_iri: str, import_iri: str) -> DataFrame:
    """``imports`` without one declaration."""
    return imports.where(~((F.col("ontology_iri") == ontology_iri) & (F.col("import_iri") == import_iri)))


def with_import(imports: DataFrame, ontology_iri: str, import_iri: str) -> DataFrame:
    """``imports`` with one declaration; the same as before if it is there."""
    row = imports.sparkSession.createDataFrame([(ontology_iri, import_iri)], "ontology_iri string, import_iri string")
    return imports.select("ontology_iri", "import_iri").unionByName(row).distinct()


def updated_import(imports: DataFrame, ontology_iri: str, old_iri: str, new_iri: str) -> DataFrame:
    """``imports`` with an import's IRI replaced; an import that isn't there is an error."""
    hit = (F.col("ontology_iri") == ontology_iri) & (F.col("import_iri") == old_iri)
    if imports.where(hit).isEmpty():
        raise OntologyError(f"{ontology_iri} does not import {old_iri}.")
    return imports.withColumn("import_iri", F.when(hit, F.lit(new_iri)).otherwise(F.col("import_iri"))).distinct()


def single_entities(axioms: DataFrame, declarations: DataFrame, seeds: DataFrame) -> DataFrame:
    """The axioms of a module of ``seeds(iri)`` alone: declarations, characteristics and annotations.

    Annotation properties that these annotations use are taken in as well, with their own
    declarations and annotations, until no new one turns up; labels bring none.
    """
    notes = axioms.where(F.col("axiom_type") == "AnnotationAssertion")
    props = declarations.where((F.col("kind") == ANNOTATION_PROPERTY) & (F.col("iri") != LABEL)).select("iri").distinct()
    known = fresh = settled(seeds.select("iri").distinct())
    while True:
        used = notes.join(fresh, notes["a1"] == fresh["iri"], "left_semi").select(F.col("a2").alias("iri")).distinct().join(props, "iri", "left_semi")
        fresh = settled(used.join(known, "iri", "left_anti"))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    kinds = F.col("axiom_type").isin("Declaration", "AnnotationAssertion", *CHARACTERISTICS)
    return axioms.where(kinds).join(known, F.col("a1") == F.col("iri"), "left_semi")


def module(axioms: DataFrame, declarations: DataFrame, edges: DataFrame, signatures: DataFrame, include: list[tuple[DataFrame, set]], exclude: list[tuple[DataFrame, set]]) -> DataFrame:
    """A single-entity module: ``include`` and ``exclude`` are ``(seeds(iri), relations)``.

    Seeds and all that they are related to are taken in with the axioms that relate them;
    what is excluded, with all that it is related to, is removed afterwards.
    """
    seeds, saved = None, None
    for s, rels in include:
        entities, ids = related(edges, s, rels)
        seeds = entities if seeds is None else seeds.union(entities).distinct()
        saved = ids if saved is None else saved.union(ids).distinct()
    out = union(single_entities(axioms, declarations, seeds), axioms.join(saved, "axiom_id", "left_semi"))
    gone = None
    for s, rels in exclude:
        entities, _ = related(edges, s, rels)
        gone = entities if gone is None else gone.union(entities).distinct()
    return out if gone is None else remove_entities(out, gone, signatures)
