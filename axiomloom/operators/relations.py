"""Direct relations between entities as one edge table, and closures over chosen relations."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sized import dealt_by, unique
from .closure import closure

ANCESTORS, DESCENDANTS, EQUIVALENTS, DISJOINTS = "ancestors", "descendants", "equivalents", "disjoints"
DOMAINS, RANGES, INVERSES, TYPES, PROPERTY_ASSERTIONS = "domains", "ranges", "inverses", "types", "property assertions"
RELATIONS = (ANCESTORS, DESCENDANTS, EQUIVALENTS, DISJOINTS, DOMAINS, RANGES, INVERSES, TYPES, PROPERTY_ASSERTIONS)


def parse_relations(text: str) -> set[str]:
    """The relations of a comma list, in any case, blank items passed over; an unknown one is a ValueError."""
    asked = {x.strip().lower() for x in unicodedata.normalize("NFKC", text).split(",")} - {""}
    if unknown := asked - set(RELATIONS):
        raise ValueError(f"Unrecognized related axiom type: {', '.join(sorted(unknown))}")
    return asked


def pairwise(axioms: DataFrame, id_col: str = "axiom_id", operands: str = "operands") -> DataFrame:
    """``(axiom_id, a, b)`` with ``a <> b`` from axioms over several operands."""
    ends = axioms.select(id_col, F.explode(F.array_distinct(operands)).alias("a"))
    return ends.join(ends.withColumnRenamed("a", "b"), id_col).where("a <> b")


def edges_of(axioms: DataFrame) -> DataFrame:
    """``(src, dst, rel, axiom_id)`` from the axiom table: who is related to whom, seen from ``src``.

    ``dst`` is null where a relation adds its axiom and no entity (data ranges). Sides that
    are class expressions, whose keys start with ``_:``, aren't entities and are left out.
    """
    named = lambda c: c.isNotNull() & ~F.startswith(c, F.lit("_:"))
    a1, a2, a3 = F.col("a1"), F.col("a2"), F.col("a3")

    def rows(kinds, src, dst, rel, entity=True):
        part = axioms.where(F.col("axiom_type").isin(*kinds) & named(src))
        part = part.where(named(dst)) if entity else part
        return part.select(src.alias("src"), (dst if entity else F.lit(None).cast("string")).alias("dst"), F.lit(rel).alias("rel"), "axiom_id")

    up = ("SubClassOf", "SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf")
    parts = [rows(up, a1, a2, ANCESTORS), rows(up, a2, a1, DESCENDANTS)]
    for kinds, rel in ((("EquivalentClasses", "EquivalentObjectProperties", "EquivalentDataProperties"), EQUIVALENTS), (("DisjointClasses", "DisjointObjectProperties", "DisjointDataProperties"), DISJOINTS)):
        both = pairwise(axioms.where(F.col("axiom_type").isin(*kinds))).where(named(F.col("a")) & named(F.col("b")))
        parts.append(both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(rel).alias("rel"), "axiom_id"))
    parts += [
        rows(("ObjectPropertyDomain", "DataPropertyDomain"), a1, a2, DOMAINS),
        rows(("ObjectPropertyRange",), a1, a2, RANGES),
        rows(("DataPropertyRange",), a1, a2, RANGES, entity=False),
        rows(("InverseObjectProperties",), a1, a2, INVERSES),
        rows(("InverseObjectProperties",), a2, a1, INVERSES),
        rows(("ClassAssertion",), a1, a2, TYPES),
        rows(("ObjectPropertyAssertion",), a1, a2, PROPERTY_ASSERTIONS),
        rows(("ObjectPropertyAssertion",), a1, a3, PROPERTY_ASSERTIONS),
        rows(("ObjectPropertyAssertion",), a3, a2, PROPERTY_ASSERTIONS),
        rows(("ObjectPropertyAssertion",), a3, a1, PROPERTY_ASSERTIONS),
        rows(("DataPropertyAssertion",), a1, a2, PROPERTY_ASSERTIONS),
    ]
    # an axiom is up to four edges
    return unique(reduce(DataFrame.unionByName, parts), 4 * axioms.count())


def directly_related(edges: DataFrame, entities: DataFrame, rels) -> DataFrame:
    """``(iri, dst, rel, axiom_id)``: what ``entities(iri)`` are related to in one step of ``rels``."""
    part = edges.where(F.col("rel").isin(*rels))
    n = max(part.count(), entities.count())
    asked = dealt_by(entities.select("iri"), n, "iri")
    return dealt_by(part, n, "src").join(asked, F.col("iri") == F.col("src"), "left_semi").select(F.col("src").alias("iri"), "dst", "rel", "axiom_id")


def related(edges: DataFrame, seeds: DataFrame, rels) -> tuple[DataFrame, DataFrame]:
    """Entities and axioms that ``seeds(iri)`` reach by any number of steps of ``rels``: ``(iri)`` with the seeds, ``(axiom_id)``.

    The same relations hold at every step, whatever the kind of the entity reached.
    """
    part = edges.where(F.col("rel").isin(*rels)) if rels else edges.limit(0)
    reached = closure(part.select("src", "dst"), seeds.select(F.col("iri").alias("start")), include_start=True)
    entities = reached.select(F.col("node").alias("iri")).distinct()
    axioms = entities.join(part, F.col("iri") == F.col("src"), "inner").select("axiom_id").distinct()
    return entities, axioms
