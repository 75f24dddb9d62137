"""Mixing sources to target weights by Pareto order sampling, on DataFrame functions only.

Each source gets a target number of words: a share of all words by weight, stopped at
``MAX_REPEAT`` times what the source has; what is cut off is shared again by weight. A
source whose target is ``f`` times its size takes ``floor(f)`` whole copies of every
document for certain. The rest, a fraction ``r`` of the source's words, is an
unequal-probability sample: a document's inclusion probability is ``r`` scaled by the
document's weight over the source's word-weighted mean weight, at most 1; its rank is
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the id, or of the text where there
is no id (Rosen's Pareto order sampling), and the documents of lowest rank are taken until
the words reach the target; the document at the edge is taken if that comes nearer.

The edge of a hot source is found by narrowing, not by ordering the source in one task:
words are summed in ``CELLS`` cells of the rank's quantile, the cell with the edge is cut
in ``CELLS`` cells again, and only that last cell is ordered, rows of one rank, id and size
as one. Where several such rows meet the edge, they are numbered by parts and taken one by one.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
CELLS = 512
SEED = "mix-1"
#: Words at which a document has half of the full weight in the sampled fraction.
HALF_WEIGHT_WORDS = 20
#: Parts in which rows that tie at the edge are numbered.
PARTS = 1024
_NO_ID = -(1 << 63)


def word_count(text):
    """Column: the number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``place``, from 0, in ``order``: sorted by ranges, each range numbered from where the one before ends."""
    ranges = cut(df.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["count"]) for r in ranges.groupBy("__range").count().collect())  # one row for each partition
    before = dict(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for k, n in before.items() for x in (k, n)]), F.col("__range")) if before else F.lit(0)
    return ranges.withColumn("place", start + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1).drop("__range")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row for each source.

    Sources in the order of their code points, null last, have the weights in turn. The
    level, words for each unit of weight, is raised until no further source's cap is below
    its share: each round is one sum over the sources, and no task holds them all.
    """
    s = numbered(sizes.select("source", "source_size"), F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    s = cut(s.withColumn("cap", F.col("source_size") * max_repeat))
    big = lambda x: F.col(x).cast("decimal(38,0)") if isinstance(x, str) else F.lit(str(x)).cast("decimal(38,0)")
    capped, known = F.lit(False), -1
    while True:
        r = s.agg(F.sum(big("source_size")).alias("all"), F.sum(F.when(capped, big("cap"))).alias("gone"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count(F.when(capped, 1)).alias("n")).first()
        words, weight = int((r["all"] or 0) - (r["gone"] or 0)), int(r["weight"] or 0)
        if r["n"] == known or not weight:
            break
        known = r["n"]
        capped = big("cap") * big(weight) < big(words) * F.col("weight")
    if not weight:
        return s.select("source", "source_size", F.col("cap").cast("double").alias("target"))
    fair = F.lit(float(words)) * F.col("weight").cast("double") / F.lit(float(weight))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), fair).alias("target"))


def _uniform(id_col, text):
    """Column: a number in (0, 1) from the id alone, or from the text of a row without id: 48 bits of an MD5."""
    own = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.lit(":"), own)), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def _edge(parts: DataFrame, keys: list[str], cell) -> DataFrame:
    """``keys``, the cell in which the running words pass ``need``, and what is still needed there.

    ``parts`` has ``keys``, ``need`` and ``size``; ``cell`` numbers its rows' cells. A key
    whose cells never pass has no row.
    """
    sums = parts.groupBy(*keys, cell.alias("cell")).agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    running = F.sum("words").over(Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", running)
    passed = sums.where(F.col("upto") > F.col("need"))
    return passed.groupBy(*keys).agg(F.min(F.struct("cell", (F.col("need") - (F.col("upto") - F.col("words"))).alias("need"))).alias("e")).select(*keys, "e.cell", "e.need")


def _one_by_one(ties: DataFrame) -> DataFrame:
    """``ties`` with ``extra`` 1 for ``most`` rows of each source: rows are numbered in ``PARTS`` parts, the parts' counts added up."""
    ties = cut(ties.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))))
    counts = ties.groupBy("source", "part").count().withColumnRenamed("part", "p").withColumnRenamed("source", "s3")
    before = F.sum("count").over(Window.partitionBy("s3").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("s3", "p", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("size"))
    ties = ties.withColumn("number", number).join(counts, F.col("source").eqNullSafe(F.col("s3")) & (F.col("part") == F.col("p")))
    return ties.withColumn("extra", F.when(F.col("before") + F.col("number") <= F.col("most"), 1).otherwise(0))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for each row of ``docs``, then ``kept``, a struct of ``keep``, if any is asked for.

    ``copies`` is how often the mix takes the document (0 to ``max_repeat``), ``taken`` the
    words that makes. Every row is a document of its own: rows without an id draw by their
    text, and rows equal in rank, id and size are taken one by one until the target is met
    (which of them is open, how many is not). Null texts have no words; documents without
    words take ``floor(target / source_size)`` copies and no words. A source without any
    words has target 0. An empty table gives an empty result. Clashing names of other
    columns don't matter: only the three named columns and ``keep`` are read.
    """
    held = [F.struct(*keep).alias("kept")] if keep else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), _uniform(F.col(id_col), F.col(text_col)).alias("u"), *held)
    whole = base.withColumn("doc_weight", F.col("size") / (F.col("size") + F.lit(HALF_WEIGHT_WORDS)))
    # what is kept is read once, at the end; all sums are over the rest
    base = cut(whole.drop("kept"))
    # integer sums only, so that results don't depend on the order of addition
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("doc_weight") * F.col("size") * 1024).cast("long")).alias("weighted"))
    totals = cut(sizes)
    targets = source_targets(totals.select("source", "source_size"), weights, max_repeat)
    plan = totals.withColumnRenamed("source", "s").select("s", "weighted").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(factor)).withColumn("need", F.col("target") - F.floor(factor) * F.col("source_size"))
    plan = plan.withColumn("rate", F.when(F.col("weighted") > 0, F.col("need") * 1024 / F.col("weighted")).otherwise(F.lit(0.0)))
    plan = cut(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "need", "rate"))
    few = plan.count() <= 10_000  # sources; so few rows can be broadcast
    small = F.broadcast if few else (lambda df: df)
    p = F.least(F.lit(1.0), F.col("rate") * F.col("doc_weight"))
    # rank / (1 + rate-free rank): increases with the Pareto rank and lies in [0, 1]
    odds = F.col("u") / (1 - F.col("u")) * ((1 - p) / p)
    rank = F.when(p <= 0, F.lit(1.0)).otherwise(odds / (1 + odds))
    ranked = lambda rows: rows.join(small(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rank", rank)
    fine = F.floor(F.col("rank") * CELLS * CELLS)
    coarse_of, fine_of = F.least(F.floor(fine / CELLS), F.lit(CELLS - 1)), F.pmod(fine, F.lit(CELLS))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID).cast("long"))
    open_rows = ranked(base).where((F.col("size") > 0) & (F.col("need") > 0)).select("source", own_id.alias("doc_id"), "size", "need", "rank")
    e1 = cut(_edge(open_rows, ["source"], coarse_of).select(F.col("source").alias("s1"), F.col("cell").alias("cell1"), F.col("need").alias("need1")))
    inside = open_rows.withColumn("coarse", coarse_of).join(small(e1), F.col("source").eqNullSafe(F.col("s1")) & (F.col("coarse") == F.col("cell1")))
    # rows that tie are one from here on; ``size`` is the words of all of them
    inside = inside.groupBy("source", "rank", "doc_id", F.col("size").alias("each")).agg(F.count("*").alias("n"), F.first("need1").alias("need"), F.sum("size").alias("size"))
    inside = cut(inside)
    e2 = cut(_edge(inside, ["source"], fine_of).select(F.col("source").alias("s2"), F.col("cell").alias("cell2"), F.col("need").alias("need2")))
    last = inside.withColumn("fine", fine_of).join(small(e2), F.col("source").eqNullSafe(F.col("s2")) & (F.col("fine") == F.col("cell2")))
    last = last.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "each")))
    # of the rows that tie, so many are taken that the next would lead further away
    most = F.floor((F.col("need2") - (F.col("upto") - F.col("size"))) / F.col("each") + 0.5)
    goal = last.withColumn("most", F.least(F.col("n"), F.greatest(most, F.lit(0))).cast("long")).where("most > 0")
    cutoff = goal.groupBy("source").agg(F.max(F.struct("rank", "doc_id", F.col("each").alias("size"), "most", "n")).alias("upto"))
    bounds = e1.join(e2.withColumnRenamed("s2", "x"), F.col("s1").eqNullSafe(F.col("x")), "left").drop("x")
    bounds = bounds.join(cutoff.withColumnRenamed("source", "x"), F.col("s1").eqNullSafe(F.col("x")), "left").select("s1", "cell1", "cell2", F.struct("upto.rank", "upto.doc_id", "upto.size").alias("upto"), F.col("upto.most").alias("most"), F.col("upto.n").alias("n"))
    bounds = cut(bounds)
    rows = ranked(whole if keep else base).withColumn("coarse", coarse_of).withColumn("fine", fine_of)
    rows = rows.join(small(bounds), F.col("source").eqNullSafe(F.col("s1")), "left")
    own = F.struct(F.col("rank"), own_id.alias("doc_id"), F.col("size"))
    at_edge = (F.col("coarse") == F.col("cell1")) & (F.col("fine") == F.col("cell2"))
    inside_edge = F.when(F.col("cell1").isNull(), F.lit(True)).when(F.col("coarse") != F.col("cell1"), F.col("coarse") < F.col("cell1")).when(F.col("cell2").isNull(), F.lit(True)).when(~at_edge, F.col("fine") < F.col("cell2")).otherwise(F.coalesce(own <= F.col("upto"), F.lit(False)))
    rows = rows.withColumn("extra", F.when((F.col("size") > 0) & (F.col("need") > 0) & inside_edge, 1).otherwise(0))
    if bounds.where("most < n").limit(1).count():
        tied = F.coalesce((F.col("most") < F.col("n")) & (own == F.col("upto")) & at_edge, F.lit(False))
        rows = rows.where(~tied).unionByName(_one_by_one(rows.where(tied)), allowMissingColumns=True)
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["kept"] if keep else []))
