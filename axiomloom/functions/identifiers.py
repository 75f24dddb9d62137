"""OBO identifiers, prefixed and full IRIs, labels: native column functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..schema import OBO_BASE

_OBO_ID = r"^[A-Za-z]+(?:_[A-Za-z]+)?:[0-9]+$"
_LABEL = r"^(?:[^':]*:)?'.+'$"
#: What RFC 3987 allows in an IRI reference, without percent signs that begin no escape.
_IRI = r"^(?:[^\x00-\x20<>\"{}|\\^`%]|%[0-9A-Fa-f]{2})*$"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?:[^\x00-\x20<>\"{}|\\^`%#]|%[0-9A-Fa-f]{2})*$"


class IdentifierError(ValueError):
    """An identifier that can't be read or resolved."""


def is_obo_id(col):
    """Column: whether ``col`` is an OBO identifier such as ``OBO:0001``."""
    return F.regexp_like(F.trim(col), F.lit(_OBO_ID))


def obo_to_iri(col, base: str = OBO_BASE):
    """Column: the IRI of an OBO identifier; null for anything else."""
    return F.when(is_obo_id(col), F.concat(F.lit(base), F.replace(F.trim(col), F.lit(":"), F.lit("_"))))


def iri_to_obo(col, base: str = OBO_BASE):
    """Column: the OBO identifier of an IRI under ``base``; null for anything else."""
    local = F.regexp_extract(col, "^" + re.escape(base).replace("/", "/") + "([A-Za-z]+(?:_[A-Za-z]+)?)_([0-9]+)$", 1)
    number = F.regexp_extract(col, "^" + re.escape(base) + "(?:[A-Za-z]+(?:_[A-Za-z]+)?)_([0-9]+)$", 1)
    return F.when((local != "") & (number != ""), F.concat(local, F.lit(":"), number))


def prefix_root(col, base: str = OBO_BASE):
    """Column: what the IRIs of an OBO prefix start with."""
    return F.concat(F.lit(base), col)


def is_label(col):
    """Column: whether ``col`` is a quoted label, with or without a prefix before it."""
    return F.regexp_like(col, F.lit(_LABEL)) & (F.length(col) >= 3)


def label_text(col):
    """Column: a label without its prefix and quotes."""
    return F.regexp_extract(col, r"^(?:[^':]*:)?'(.+)'$", 1)


def label_prefix(col):
    """Column: a label's prefix, empty without one."""
    return F.regexp_extract(col, r"^([^':]*):'.+'$", 1)


def is_iri_reference(col):
    """Column: whether ``col`` can be an IRI reference."""
    return F.regexp_like(col, F.lit(_IRI))


def is_absolute_iri(col):
    """Column: whether ``col`` is an absolute IRI (with a scheme, without a fragment)."""
    return F.regexp_like(col, F.lit(_ABSOLUTE))


def is_true(col):
    """Column: whether a table cell means yes."""
    return F.lower(F.trim(F.coalesce(col, F.lit("")))).isin("t", "true", "y", "yes")


def expand_iri(df, col: str, prefixes, out: str = "iri"):
    """``df`` with ``out``: a prefixed name by ``prefixes(prefix, namespace)``, any other IRI reference as it is, else null."""
    known = prefixes.select(F.col("prefix").alias("_prefix"), F.col("namespace").alias("_namespace")).dropDuplicates(["_prefix"])
    parted = df.withColumn("_key", F.when(F.contains(F.col(col), F.lit(":")), F.substring_index(F.col(col), ":", 1)))
    joined = parted.join(known, F.col("_key") == F.col("_prefix"), "left")
    rest = F.substring(F.col(col), F.length("_key") + 2, F.length(F.col(col)))
    iri = F.when(~is_iri_reference(F.col(col)), None).when(F.col("_namespace").isNotNull(), F.concat("_namespace", rest)).otherwise(F.col(col))
    return joined.withColumn(out, iri).drop("_key", "_prefix", "_namespace")
