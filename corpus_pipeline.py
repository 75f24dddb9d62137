"""A training corpus from ``documents`` in five stages, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomloom.llm import bpe, langid, mixing, near_copies, pii
from axiomloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of the predicted language among the languages selected for a document.
LEAST_SHARE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known, without those that have no letters or are a jumble of languages."""
    found = langid.predict(docs.select(*COLUMNS), langid.train(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("share") >= LEAST_SHARE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of smallest id: SimHash and tables of distances to references find them, five-word shingles of Jaccard similarity 0.8 or more decide.

    A null id comes after all others; rows that are equal in the id are ordered by their
    other columns. Rows of one id with different texts are different documents.
    """
    found = near_copies.near_copies(docs, COLUMNS)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), *COLUMNS)
    first = found.where(~F.col("alone")).groupBy("component").agg(F.min(order).alias("row")).select(*[F.col(f"row.{c}") for c in COLUMNS])
    # rows without near copies stay where they are
    return found.where("alone").select(*COLUMNS).union(first)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    rows = pii.find_personal_data(docs, keep=("text", "lang", "source"))
    clean = pii.redact(F.col("text"), F.col("spans"))
    rows = rows.select("doc_id", clean.alias("clean"), "lang", "source")
    return rows.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs, keep=COLUMNS).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"kept.{c}") for c in COLUMNS])


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, with whether they decode to its text."""
    vocab = bpe.vocabulary(spark, *tokenizer())
    coded = bpe.encode_texts(docs, vocab, keep=("lang", "source", "n_chars"), exact="round_trip")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]
#: Language identification and SimHash can't be stated in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written beside the checkpoints and read again.

    What a stage has read, and its checkpoints, are deleted once its own result is there; the
    last result goes with the process.
    """
    from axiomloom.plans.checkpoints import own_folder, remove_folder, scratch

    at = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove_folder(spark, f"{at}/{k - 1}")
    return docs
