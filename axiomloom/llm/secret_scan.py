"""Secrets by patterns and by character Markov models, on DataFrame functions only.

Three base patterns find spans that always stay. Besides, every long token of letters and
digits is scored by the log-likelihood ratio of two first-order Markov models of
characters: one of random strings, one of ordinary identifiers. Both are trained from
labelled samples: random are the secrets that the base patterns find and generated
strings; ordinary are all words without digits of all documents, and identifiers with
numbers composed of words. The least ratio of a secret is set on samples held out from
training: the largest that misses few random ones and lets hardly an ordinary one pass.
Words are counted before their characters are. Only the counts of character pairs, at most
``2 * 67 ** 2`` rows, and of ratios, at most ``2 * 400``, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import by_start, clear_of, find_spans, let, listed, tagged

KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The same pattern with the value as group 1.
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
# Runs are maximal, so asking for the least length in the pattern finds the same runs.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Tokens that are scored: at least 16 signs, with a letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Generated random strings, pairs that a character's own frequency counts as, identifiers composed for each document.
RANDOM_STRINGS, SMOOTH, COMPOSED = 4000, 5.0, 3
#: Shares of held-out random samples that may be missed, and of ordinary ones that may pass; one sample in HELD_OUT is held out.
MISSED, FALSE_ALARMS, HELD_OUT = 0.02, 0.001, 5
#: Steps of the ratio in which the least one is sought, from 0.
STEP, STEPS = 0.02, 200
_SIZE = len(ALPHABET) + 1


def _pairs(token):
    """Column: the numbers of a token's character pairs in the model's table."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    n = F.length(token)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (at(i) * _SIZE + at(i + 1)).cast("int")))


def ratio_table(counts: dict[str, dict[int, float]]) -> list[float]:
    """The log-likelihood ratio of each character pair from the pair counts of ``random`` and ``ordinary``.

    A model's probability of a character after another leans, with the weight of ``SMOOTH``
    pairs, on that of the character anywhere, as far as the sample has the first of the
    two; after characters that it hardly has, all are equally likely.
    """
    logs = {}
    for kind in ("random", "ordinary"):
        own = counts.get(kind, {})
        rows, ends = [0.0] * _SIZE, [0.5] * _SIZE
        for k, n in own.items():
            rows[k // _SIZE] += n
            ends[k % _SIZE] += n
        total = sum(ends)
        seen = [n / (n + 10 * SMOOTH) for n in rows]
        lean = lambda a, b: seen[a] * ends[b] / total + (1 - seen[a]) / _SIZE  # noqa: E731, B023
        logs[kind] = [math.log((own.get(a * _SIZE + b, 0.0) + SMOOTH * lean(a, b)) / (rows[a] + SMOOTH)) for a in range(_SIZE) for b in range(_SIZE)]
    return [a - b for a, b in zip(logs["random"], logs["ordinary"], strict=True)]


def mean_ratio(token, table: list[float]):
    """Column: the mean log-likelihood ratio of ``token``'s character pairs, random against ordinary."""
    held = F.lit(table)
    pairs = _pairs(token)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, k: acc + F.element_at(held, k + 1))
    return total / F.greatest(F.size(pairs), F.lit(1))


def identifiers(text):
    """Column: ``COMPOSED`` identifiers made of neighbouring words of ``text`` and numbers, at places that a hash chooses; none without words."""
    own = F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.regexp_like(w, F.lit("[0-9]")))

    def one(all_words, k):
        draw = F.xxhash64(F.size(all_words), F.element_at(all_words, 1), k)
        word = lambda j: F.element_at(all_words, (F.pmod(draw + j, F.size(all_words)) + 1).cast("int"))
        number = F.pmod(F.shiftright(draw, 7), F.lit(10_000)).cast("string")
        parts = F.array(word(0), word(1), word(2))
        title = lambda ws: F.array_join(F.transform(ws, F.initcap), "")
        forms = F.array(
            F.concat(F.lower(F.array_join(parts, "_")), F.lit("_"), number), F.upper(F.concat(F.array_join(parts, "_"), F.lit("_"), number)), F.concat(title(parts), number),
            F.lower(F.concat(F.array_join(parts, "-"), F.lit("-"), number)), F.concat(F.lower(word(0)), number, title(F.array(word(1), word(2)))), F.concat(F.lit("20"), F.lpad(F.substring(number, 1, 2), 2, "0"), F.lit("-"), F.lpad(F.pmod(draw, F.lit(12)).cast("string"), 2, "0"), F.lit("_"), F.lower(F.array_join(F.array(word(0), word(1)), "_"))),
        )
        return F.element_at(forms, (F.pmod(F.shiftright(draw, 21), F.lit(6)) + 1).cast("int"))

    return let(own, lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.lit(COMPOSED)), lambda k: one(w, k))).otherwise(F.array().cast("array<string>")))


def labelled(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``(kind, token, n, held_out)``: the labelled samples of ``found(values)`` and of all ``docs(text)``, each different one once with its count."""
    spark = found.sparkSession
    digest, long = F.sha2(F.col("id").cast("string"), 256), F.pmod("id", F.lit(25)).cast("int") + 16
    made = spark.range(RANDOM_STRINGS).select(F.substring(F.when(F.pmod("id", F.lit(4)) == 0, digest).otherwise(F.translate(F.base64(F.unhex(digest)), "+/", "")), F.lit(1), long).alias("token"))
    random = found.select(F.explode("values").alias("token")).union(made).select(F.lit("random").alias("kind"), "token")
    plain = F.filter(F.split("text", r"[^A-Za-z0-9+/_=-]+"), lambda w: ~F.regexp_like(w, F.lit("[0-9]")))
    ordinary = docs.select(F.explode(F.concat(plain, identifiers(F.col("text")))).alias("token")).select(F.lit("ordinary").alias("kind"), "token")
    counted = random.union(ordinary).where(F.length("token") > 1).groupBy("kind", "token").agg(F.count("*").alias("n"))
    return counted.withColumn("held_out", F.pmod(F.xxhash64("token", F.lit(9)), F.lit(HELD_OUT)) == 0)


def train(samples: DataFrame) -> list[float]:
    """The table from the samples that aren't held out; each different token counts by the square root of its number."""
    pairs = samples.where(~F.col("held_out")).select("kind", F.sqrt("n").alias("n"), F.explode(_pairs(F.col("token"))).alias("pair"))
    counts: dict[str, dict[int, float]] = {}
    for r in pairs.groupBy("kind", "pair").agg(F.round(F.sum("n"), 3).alias("n")).collect():  # at most 2 * 67 ** 2 rows
        counts.setdefault(r["kind"], {})[r["pair"]] = r["n"]
    return ratio_table(counts)


def held_out_ratios(samples: DataFrame, table: list[float]) -> dict[str, list[int]]:
    """For each kind, how many different held-out samples could be candidates, and how many of them reach each step of the ratio."""
    token = F.col("token")
    fit = samples.where(F.col("held_out") & (F.length(token) >= 16) & F.regexp_like(token, F.lit("[0-9]")) & F.regexp_like(token, F.lit("[A-Za-z]")))
    step = F.least(F.greatest(F.floor(mean_ratio(token, table) / STEP), F.lit(-1)), F.lit(STEPS - 1))
    reach = {k: [0] * (STEPS + 1) for k in ("random", "ordinary")}
    for r in fit.groupBy("kind", step.alias("step")).count().collect():  # at most 2 * (STEPS + 1) rows
        for i in range(r["step"] + 2):
            reach[r["kind"]][i] += r["count"]
    return reach


def least_ratio(reach: dict[str, list[int]], missed: float = MISSED, false_alarms: float = FALSE_ALARMS) -> float:
    """The largest ratio that all but ``missed`` of the held-out random samples reach, raised until at most ``false_alarms`` of the ordinary ones do."""
    (randoms, *random), (others, *ordinary) = reach["random"], reach["ordinary"]
    most = max((i for i, n in enumerate(random) if n >= randoms * (1 - missed)), default=0)
    return next((i * STEP for i in range(most, STEPS) if ordinary[i] <= others * false_alarms), STEP * STEPS)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", missed: float = MISSED, false_alarms: float = FALSE_ALARMS) -> DataFrame:
    """``(doc_id, base, spans)`` for each row: tagged spans of the base patterns, and these with the added ones of kind ``random``.

    Both are ordered by start, then kind as in ``KINDS``; places are code points. Null and
    empty texts have none. An added span overlaps no base span. Repeated rows give
    repeated results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    text = F.col("text")
    found = rows.withColumns(
        {
            "assign": F.filter(find_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)) >= 6),
            "access": find_spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
            "hex": find_spans(text, HEX),
            "token": find_spans(text, TOKEN),
        }
    )
    values = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["hit"], ASSIGN_VALUE, 1)), F.transform("access", lambda s: s["hit"]), F.transform("hex", lambda s: s["hit"]))
    found = found.withColumn("base", F.concat(*[tagged(k, i, F.col(k)) for i, k in enumerate(BASE_KINDS)])).withColumn("values", values)
    found = found.withColumn("open", clear_of(F.col("token"), F.col("base")))
    found = cut(found.select("doc_id", "base", "values", "open"))
    samples = cut(labelled(found, rows))
    table = train(samples)
    least = least_ratio(held_out_ratios(samples, table), missed, false_alarms)
    sure = F.filter("open", lambda s: mean_ratio(s["hit"], table) >= least)
    return found.select("doc_id", by_start(F.col("base")).alias("base"), by_start(F.concat("base", tagged("random", 3, sure))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from ``find_secrets``'s."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
