"""Document fingerprints as threshold-scaled sketches, on DataFrame functions only.

The sketch of a text is the set of all its shingle hashes below a fixed fraction of the
hash range (FracMinHash). The threshold doesn't depend on the text, so sketches of parts
merge by union, and the share of the smaller sketch that the other holds estimates
containment however unequal the two texts are.

A short text may have no hash below the threshold. Its sketch is empty, and stays so: its
smallest hash is kept in a column of its own, and only says whether two texts of which one
has an empty sketch share it.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, words

WIDTH = 5
#: One hash in so many is retained.
SCALE = 4
#: Rows of a range of ids, and how many ranges there are at most.
ROWS_PER_BUCKET, MOST_RANGES = 2000, 1 << 16


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``df`` with ``out`` (array of longs, ascending), the sketch of ``text_col``, and ``<out>_least``, its smallest shingle hash.

    Shingles are ``width`` consecutive words; a text of fewer words is one shingle. Texts
    without words (null ones too) have an empty sketch and no smallest hash; a text with
    words of which no hash is below the threshold has an empty sketch and a smallest hash.
    """
    h, z = f"{out}__words", f"{out}__hashes"
    df = df.withColumn(h, F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    # the hashes of a shingle's words side by side; at the end null ones, which a hash passes over
    aligned = F.arrays_zip(*[(F.col(h) if k == 0 else F.slice(F.col(h), k + 1, F.greatest(F.size(h), F.lit(1)))).alias(f"w{k}") for k in range(width)])
    rows = F.slice(aligned, F.lit(1), F.greatest(F.size(h) - (width - 1), F.lit(1)))
    df = df.withColumn(z, F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(F.transform(rows, lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(width)]))))
    below = -(1 << 63) + (1 << 64) // scale
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.filter(z, lambda x: x < F.lit(below)))))
    df = df.withColumn(f"{out}_least", F.array_min(z))
    return df.drop(h, z)


def sketch_text(sketch, least):
    """Column: the sketch as text, 16 hex digits for each hash; of an empty sketch ``-`` and the text's smallest hash, if it has words."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.when((F.size(sketch) == 0) & least.isNotNull(), F.concat(F.lit("-"), digits(least))).otherwise(F.array_join(F.transform(sketch, digits), ""))


def containment(a, b, least_a, least_b):
    """Column: the share of the smaller sketch that the larger holds.

    If a sketch is empty: 1 if neither text has words or both have the same smallest hash, else 0.
    """
    size = F.least(F.size(a), F.size(b))
    return F.when(size == 0, F.when(least_a.eqNullSafe(least_b), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.size(F.array_intersect(a, b)) / size)


def resemblance(a, b):
    """Column: the estimated Jaccard likeness; 1 for two empty sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _place(key, cuts: list[int]):
    """Column: how many of the ascending ``cuts`` are below ``key``; found in two steps of about ``sqrt(len(cuts))`` comparisons."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    chunks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    over = below(F.lit([c[-1] for c in chunks]).cast("array<bigint>"))
    inside = F.get(F.array(*[F.lit(c).cast("array<bigint>") for c in chunks]), over)
    return F.least(over * step + below(F.coalesce(inside, F.array().cast("array<bigint>"))), F.lit(len(cuts)))


def with_next(df: DataFrame, key: str, carry: list[str], tie: list) -> DataFrame:
    """``df`` with ``next_<c>`` for each ``c`` of ``carry``: the value in the next row by ``key``, after the last the first's.

    Nothing is ordered in one task: rows are dealt to ranges of ``key``, and the first row
    of each range also goes to the range before it. ``tie`` orders rows of equal keys; its
    first is a hash, by which a key that fills several ranges is split.
    """
    spark = df.sparkSession
    n = min(pieces(df.select(key).count(), ROWS_PER_BUCKET, spark), MOST_RANGES)
    found = df.select(F.percentile_approx(key, [k / n for k in range(1, n)], 4 * max(n, 2_500))).first()[0] or []
    times = Counter(found)
    cuts = sorted(times)
    parts = [*(times[c] for c in cuts), 1]  # of the ranges that end with each cut
    starts = [0, *accumulate(parts)][: len(parts)]
    df = df.withColumn("__hash", tie[0])
    longs = lambda values: F.lit(values).cast("array<bigint>")
    whole = F.col("__range") + 1
    split = F.floor((F.col("__hash") / F.lit(2.0**64) + 0.5) * F.element_at(longs(parts), whole))
    split = F.least(F.greatest(split, F.lit(0)), F.element_at(longs(parts), whole) - 1)
    own_cut = F.col(key) == F.element_at(longs([*cuts, 0]), whole)
    df = df.withColumn("__range", _place(F.col(key), cuts))
    df = df.withColumn("__place", F.element_at(longs(starts), whole) + F.when((whole <= len(cuts)) & own_cut, split).otherwise(0)).drop("__range")
    firsts = sorted((r["__place"], r["k"][0], r["k"][1]) for r in df.groupBy("__place").agg(F.min(F.struct(key, "__hash")).alias("k")).collect())  # one row for each range
    first, before = {}, {}
    for i, (p, *k) in enumerate(firsts):
        first[p], before[p] = k, firsts[i - 1][0]
    every = range(starts[-1] + 1)
    at = lambda values: F.element_at(longs(values), F.col("__place").cast("int") + 1)
    is_first = (F.col(key) == at([first.get(p, (0, 0))[0] for p in every])) & (F.col("__hash") == at([first.get(p, (0, 0))[1] for p in every]))
    own = F.struct(F.col("__place").alias("place"), F.lit(False).alias("ghost"))
    ghost = F.struct(at([before.get(p, 0) for p in every]).alias("place"), F.lit(True).alias("ghost"))
    df = df.withColumn("__to", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))))
    df = df.withColumns({"__place": F.col("__to.place"), "__ghost": F.col("__to.ghost")}).drop("__to")
    # one window for all of them, so that the texts are dealt out once
    w = Window.partitionBy("__place").orderBy("__ghost", key, "__hash", *tie[1:])
    df = df.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry})
    return df.where(~F.col("__ghost")).drop("__ghost", "__place", "__hash")


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, sketch, sketch_least)`` for each row of ``docs``."""
    return with_sketch(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "sketch").select("doc_id", "sketch", "sketch_least")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sketch beside that of its edited text and the next document's.

    Edited: the last ``floor(n / 2)`` code points are replaced by as many from the start of
    the next document by id (by all of it if it is shorter; after the last document comes
    the first). Null texts are empty. Null ids come last; rows of equal ids, and those
    without one, are ordered by the hash of their text, then by the text. Returns
    ``doc_id, n_chars, edited, sketch, edited_sketch, next_sketch`` and the sketches'
    ``_least`` for each row; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    rows = with_sketch(rows, "text", "sketch")
    rows = with_next(rows, "key", ["text", "sketch", "sketch_least"], [F.xxhash64("text"), F.col("text")])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half)))
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select("doc_id", "n_chars", "edited", *[c for k in ("sketch", "edited_sketch", "next_sketch") for c in (k, f"{k}_least")])
