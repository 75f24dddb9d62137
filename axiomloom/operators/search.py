"""Entity search: stemmed phrases and sub-phrases joined on equality."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.phrases import STOP_WORDS, depunctuate, phrase_words, sub_phrases
from ..functions.porter import stem_phrases
from ..schema import LABEL, PREFIXES, SEARCHED

FULL, PARTIAL = "Full", "Partial"


@F.pandas_udf(T.StringType())
def _decomposed(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))


def decomposed(col):
    """Column: ``col`` in compatibility decomposition; ASCII text, which that leaves as it is, stays in the JVM."""
    other = F.regexp_like(col, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _decomposed(F.when(other, col))).otherwise(col)


def normal(col):
    """Column: a phrase in the form in which phrases are compared, before stemming: ligatures taken apart, accents apart from letters, all spaces alike."""
    return F.regexp_replace(F.trim(depunctuate(decomposed(F.lower(col)))), r"\s+", " ")


def short_name(col):
    """Column: the prefixed name of a searched annotation property; any other IRI as it is."""
    out = col
    for prefix, space in PREFIXES.items():
        out = F.when(col.isin(*SEARCHED) & F.startswith(col, F.lit(space)), F.concat(F.lit(prefix + ":"), F.substring(col, len(space) + 1, 200))).otherwise(out)
    return out


def _stemmed(df: DataFrame, phrase: str, stem: bool) -> DataFrame:
    """``df`` with ``key``: ``phrase`` stemmed. Each different phrase passes the stemmer once."""
    if not stem:
        return df.withColumn("key", F.col(phrase))
    known = df.select(phrase).distinct().withColumn("key", stem_phrases(F.col(phrase)))
    return df.join(known, phrase)


def _keys(df: DataFrame, longest: int | None) -> DataFrame:
    """``df`` once for each key of its ``key`` column: the whole (``full``) and its sub-phrases."""
    w = phrase_words(F.col("key"))
    whole = F.struct(F.col("key").alias("gram"), F.lit(True).alias("full"))
    parts = F.transform(sub_phrases(w, STOP_WORDS, longest), lambda run: F.struct(F.array_join(run, " ").alias("gram"), F.lit(False).alias("full")))
    return df.withColumn("g", F.explode(F.concat(F.array(whole), parts))).select(*[c for c in df.columns if c != "key"], "g.gram", "g.full")


def build_index(annotations: DataFrame, props=SEARCHED, stem: bool = True) -> DataFrame:
    """``(gram, full, iri, prop, text)`` from ``annotations(subject, prop, value)``: one row for each key of each searched text."""
    texts = annotations.where(F.col("prop").isin(*props) & F.col("value").isNotNull()).select(F.col("subject").alias("iri"), "prop", F.col("value").alias("text")).distinct()
    return _keys(_stemmed(texts.withColumn("phrase", normal(F.col("text"))), "phrase", stem).drop("phrase"), None).where("gram <> ''")


def find_entities(terms: DataFrame, index: DataFrame, stem: bool = True, longest: int | None = None) -> DataFrame:
    """``(term, iri, prop, text, match)`` for ``terms(term)``.

    A term matches a text in full if both wholes have one key, in part if any key of one is
    a key of the other; each text once. Join and grouping are on keys, so both sides stay
    distributed. ``longest`` may give the index's longest key in words: longer sub-phrases of
    a term can't match.
    """
    asked = terms.select("term").distinct().withColumn("phrase", normal(F.col("term")))
    grams = _keys(_stemmed(asked, "phrase", stem).drop("phrase"), longest).where("gram <> ''").withColumnRenamed("full", "q_full")
    hits = grams.join(index, "gram")
    match = F.when(F.max((F.col("q_full") & F.col("full")).cast("int")) == 1, FULL).otherwise(PARTIAL)
    return hits.groupBy("term", "iri", "prop", "text").agg(match.alias("match"))


def decorated(matches: DataFrame, annotations: DataFrame, definition: str) -> DataFrame:
    """``matches`` with ``labels`` and ``definitions`` of each entity, several joined by commas in order."""

    def listed(prop, out):
        return annotations.where(F.col("prop") == prop).groupBy(F.col("subject").alias("iri")).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias(out))

    out = matches.join(listed(LABEL, "labels"), "iri", "left").join(listed(definition, "definitions"), "iri", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("labels", "definitions")})
