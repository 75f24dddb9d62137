"""Resolving identifiers to entities: lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import expand_iri, is_label, is_obo_id, label_prefix, label_text, obo_to_iri
from ..schema import KINDS, LABEL, OBO_BASE
from .closure import first_kept_rows

FOUND, INVALID, AMBIGUOUS = "found", "invalid", "ambiguous"


def label_map(annotations: DataFrame) -> DataFrame:
    """``(label, iri)``, each pair once, from ``annotations(subject, prop, value)``."""
    return annotations.where((F.col("prop") == LABEL) & F.col("subject").isNotNull() & F.col("value").isNotNull()).select(F.col("value").alias("label"), F.col("subject").alias("iri")).distinct()


def ambiguous_labels(labels: DataFrame) -> DataFrame:
    """``(label, n_iris)`` for labels of more than one IRI."""
    return labels.groupBy("label").agg(F.countDistinct("iri").alias("n_iris")).where("n_iris > 1")


def lookup_labels(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """``requests(label, root)`` with ``iri`` and ``status``.

    A label is found if exactly one of its IRIs starts with ``root`` (empty: any), ambiguous
    if several do, invalid otherwise.
    """
    asked = requests.select("label", F.coalesce("root", F.lit("")).alias("root")).distinct()
    hits = asked.join(labels.distinct(), "label").where(F.startswith("iri", F.col("root")))
    counted = hits.groupBy("label", "root").agg(F.count("*").alias("n"), F.min("iri").alias("iri"))
    out = asked.join(counted, ["label", "root"], "left")
    status = F.when(F.col("n").isNull(), INVALID).when(F.col("n") > 1, AMBIGUOUS).otherwise(FOUND)
    return out.select("label", "root", F.when(F.col("n") == 1, F.col("iri")).alias("iri"), status.alias("status"))


def resolve(requests: DataFrame, labels: DataFrame, prefixes: DataFrame, base: str = OBO_BASE) -> DataFrame:
    """``requests(id)`` with ``iri`` and ``status``: as a label, else as an OBO identifier, else as a prefixed or full IRI.

    A label's prefix may be an OBO prefix or an IRI prefix; if both lead to an IRI and
    these differ, it is ambiguous.
    """
    asked = requests.select("id").distinct()
    quoted = asked.where(is_label(F.col("id"))).select("id", label_text(F.col("id")).alias("label"), label_prefix(F.col("id")).alias("prefix"))
    spaces = prefixes.select("prefix", "namespace").dropDuplicates(["prefix"])
    roots = quoted.join(spaces, "prefix", "left").select("id", "label", F.explode(F.array_distinct(F.when(F.col("prefix") == "", F.array(F.lit(""))).otherwise(F.filter(F.array(F.concat(F.lit(base), "prefix"), F.col("namespace")), lambda x: x.isNotNull())))).alias("root"))
    hits = roots.join(lookup_labels(roots, labels), ["label", "root"])
    named = hits.groupBy("id").agg(F.collect_set(F.when(F.col("status") == FOUND, F.col("iri"))).alias("iris"), F.max((F.col("status") == AMBIGUOUS).cast("int")).alias("vague"))
    named = named.select("id", F.when((F.size("iris") == 1), F.element_at("iris", 1)).alias("iri"), F.when(F.size("iris") > 1, AMBIGUOUS).when(F.size("iris") == 1, FOUND).when(F.col("vague") == 1, AMBIGUOUS).otherwise(INVALID).alias("status"))
    plain = expand_iri(asked.where(~is_label(F.col("id"))), "id", prefixes)
    iri = F.when(is_obo_id(F.col("id")), obo_to_iri(F.col("id"), base)).otherwise(F.col("iri"))
    return named.unionByName(plain.select("id", iri.alias("iri"), F.when(iri.isNull(), INVALID).otherwise(FOUND).alias("status")))


def existing(requests: DataFrame, declarations: DataFrame, kinds=KINDS) -> DataFrame:
    """``requests(iri)`` that are declared as one of ``kinds``, with the first such kind in the order of ``kinds``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    known = declarations.where(F.col("kind").isin(*kinds)).select("iri", "kind").distinct().withColumn("rank", rank)
    return first_kept_rows(requests.select("iri").distinct().join(known, "iri"), ["iri"], [F.col("rank")]).select("iri", "kind")
