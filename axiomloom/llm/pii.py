"""Personal data by weak supervision, on DataFrame functions only.

Four base patterns find spans that always stay. A wider pattern finds candidates that the
base ones leave out (numbers and addresses in other notations). Labelers vote on each
candidate and each base span, +1, -1 or 0 (no opinion): the shape of the notation, the
number's check digit, gazetteers of name endings and of number prefixes, and the words
before it. Expectation-maximisation over the counted vote patterns estimates each
labeler's reliability and each pattern's probability of being personal data (Dawid and
Skene, 1979). A logistic span classifier is then trained on these probabilities; it sees
the kind, the votes, and what the labelers don't vote on: how many digits the span has,
what parts them, and what stands before it. Candidates of which it is sure are added.

Only the counts of vote patterns and features, at most ``4 * 3 ** 4 * 6 * 5 * 5`` rows, reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import between, by_kind, clear_of, cut_text, digits, find_spans, let, listed, luhn, scan, tagged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# A match starts where its first run of signs starts, or where the match before ended: any
# other start in the run would meet the same end. So no run is tried again at each sign.
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Other notations: name (at) host (dot) ending; 1[.]2[.]3[.]4; grouped numbers without "+".
WIDE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?)[A-Za-z0-9-]++)++"
    r"|(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+"
    r"|(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z])"
)
#: Endings of host names, and first digits of card numbers.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au", "jp", "br", "mx")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36)"
FOR_WORDS = r"(?i)\b(?:e-?mails?|mail|contact|contacto|kontakt|courriel|correo|phone|tel|telefon|t[eé]l[eé]phone|tel[eé]fono|mobile|call|fax|whatsapp|ip|host|server|addr(?:ess)?|card|visa|mastercard|amex|karte|carte|tarjeta)\b[^A-Za-z0-9]{0,4}$"
AGAINST_WORDS = r"(?i)\b(?:isbn|issn|doi|order|invoice|ref|id|version|v|part|model|chapter|figure|table|page|pages|pp|vol|no|nr|items?|bestellung|commande|pedido)\b[^A-Za-z0-9]{0,4}$"
BEFORE = 24
SURE, RIDGE = 0.9, 1e-3
LABELERS = ("shape", "check", "gazetteer", "context")
#: How many values each trait has.
TRAITS = (6, 5, 5)


def _base(text) -> dict:
    """Columns: the base spans of each kind."""
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@")), BEFORE),
        "ip": F.filter(find_spans(text, IP, F.contains(text, F.lit(".")), BEFORE), lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))),
        "card": F.filter(find_spans(text, CARD, F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")), BEFORE), lambda s: F.length(digits(s["hit"])).between(16, 19) & luhn(digits(s["hit"]))),
        "phone": F.filter(find_spans(text, PHONE, F.contains(text, F.lit("+")), BEFORE), lambda s: F.length(digits(s["hit"])).between(8, 15)),
    }


def _votes(kind, hit, before):
    """Columns: each labeler's vote."""
    number = digits(hit)
    n = F.length(number)
    shape = F.when(kind == "email", F.when(F.regexp_like(hit, F.lit(r"[@\[\(\{]")), 1).otherwise(0)).when(kind == "ip", 1).when(kind == "card", F.when(n.between(15, 19), 1).otherwise(-1)).when(F.startswith(hit, F.lit("+")), 1).when(F.regexp_like(hit, F.lit(r"^\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}$")), 1).when(F.regexp_like(hit, F.lit(r"^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$")), 0).otherwise(-1)
    check = F.when(kind == "card", F.when(luhn(number), 1).otherwise(-1)).when(kind == "ip", F.when(F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda p: p != ""), lambda p: p.cast("int") <= 255), 1).otherwise(-1)).when(kind == "phone", F.when(n.between(8, 15), 0).otherwise(-1)).otherwise(0)
    ending = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    names = F.when(kind == "email", F.when(ending.isin(*ENDINGS), 1).otherwise(-1)).when(kind == "card", F.when(F.regexp_like(number, F.lit(CARD_PREFIX)), 1).otherwise(-1)).when(kind == "ip", F.when(F.regexp_like(hit, F.lit(r"^(?:0|127|255)\b")), -1).otherwise(0)).otherwise(0)
    context = F.when(F.regexp_like(before, F.lit(AGAINST_WORDS)), -1).when(F.regexp_like(before, F.lit(FOR_WORDS)), 1).otherwise(0)
    return [v.cast("int") for v in (shape, check, names, context)]


def _traits(hit, before):
    """Columns: what the classifier sees beside the votes: digits by threes, what parts them, what the sign before is."""
    count = F.least(F.floor(F.length(digits(hit)) / 3), F.lit(5))
    part = F.when(F.contains(hit, F.lit("(")) | F.contains(hit, F.lit("[")) | F.contains(hit, F.lit("{")), 4).when(F.contains(hit, F.lit(" ")), 3).when(F.contains(hit, F.lit("-")), 2).when(F.contains(hit, F.lit(".")), 1).otherwise(0)
    sign = F.when(F.regexp_like(before, F.lit(r"[:=]\x20*$")), 4).when(F.regexp_like(before, F.lit(r"\p{L}\x20*$")), 3).when(F.regexp_like(before, F.lit(r"[0-9]\x20*$")), 2).when(F.regexp_like(before, F.lit(r"[^\s]\s*$")), 1).otherwise(0)
    return [t.cast("int") for t in (count, part, sign)]


def _judged(spans, kind_of):
    """Column: spans with their kind, votes and traits."""

    def one(s):
        kind = kind_of(s)
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*_votes(kind, s["hit"], s["before"])).alias("votes"), F.array(*_traits(s["hit"], s["before"])).alias("traits"))

    return F.transform(spans, one)


def _wide_kind(s):
    return F.when(F.regexp_like(s["hit"], F.lit(r"[\[\(\{]at[\]\)\}]")), "email").when(F.contains(s["hit"], F.lit("[.]")), "ip").when(F.length(digits(s["hit"])) == 15, "card").otherwise("phone")


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]], float]:
    """Dawid and Skene's EM over ``(votes, count)``: each pattern's probability, each labeler's (right if true, right if false), the prior.

    Starts from the majority vote, so that "true" keeps its meaning; no counts give no patterns and a prior of one half.
    """
    width = len(counts[0][0]) if counts else len(LABELERS)
    post = {v: min(0.95, max(0.05, 0.5 + 0.25 * sum(v))) for v, _ in counts}
    right, prior = [(0.7, 0.7)] * width, 0.5
    for _ in range(rounds):
        yes = sum(n * post[v] for v, n in counts)
        total = sum(n for _, n in counts)
        prior = (yes + 1) / (total + 2)
        right = []
        for k in range(width):
            tp, fn, tn, fp = 2.0, 1.0, 2.0, 1.0
            for v, n in counts:
                if v[k] > 0:
                    tp, fp = tp + n * post[v], fp + n * (1 - post[v])
                elif v[k] < 0:
                    fn, tn = fn + n * post[v], tn + n * (1 - post[v])
            right.append((tp / (tp + fn), tn / (tn + fp)))
        for v, _ in counts:
            odds = math.log(prior / (1 - prior))
            for (a, b), x in zip(right, v, strict=True):
                odds += math.log(a / (1 - b)) if x > 0 else math.log((1 - a) / b) if x < 0 else 0
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, right, prior


def one_hot(kind: str, votes, traits) -> list[float]:
    """The classifier's features: votes, kind, traits."""
    return [float(v) for v in votes] + [float(kind == k) for k in KINDS] + [float(x == v) for x, width in zip(traits, TRAITS, strict=True) for v in range(width)]


def span_classifier(rows: list[tuple[list[float], float, float]], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Weights of a logistic model (the last is the constant) from ``(features, probability, count)``, by gradient descent."""
    if not rows:
        return []
    x = np.array([[*f, 1.0] for f, *_ in rows])
    p, n = np.array([p for _, p, _ in rows]), np.array([n for *_, n in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        miss = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p) * n / n.sum()
        w -= rate * (miss @ x + RIDGE * w)
    return w.tolist()


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, base, spans)`` for each row: tagged spans of the base patterns, and these with the added ones.

    Both are ordered by kind as in ``KINDS``, then start; places are code points. Null and
    empty texts have none. An added span overlaps no base span. Rows are treated each by
    itself, so repeated rows give repeated results.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c for c in keep if c not in ("doc_id",)], text.alias("__text"))
    text = F.col("__text")
    found = rows.withColumns({f"__{k}": v for k, v in _base(text).items()} | {"__wide": find_spans(text, WIDE, context=BEFORE)})
    base = F.concat(*[tagged(k, i, F.col(f"__{k}")) for i, k in enumerate(KINDS)])
    judged = F.concat(*[_judged(F.col(f"__{k}"), lambda s, k=k: F.lit(k)) for k in KINDS])
    found = found.withColumn("__base", base).withColumn("__judged", judged)
    found = found.withColumn("__open", _judged(clear_of(F.col("__wide"), F.col("__base")), _wide_kind))
    names = [c for c in rows.columns if c != "__text"]
    found = found.select(*names, "__base", "__judged", "__open")
    # spans are written and read again; beside columns to keep, whose size is that of the texts, they are found again instead
    found = found if keep else cut(found)
    seen = found.select(F.explode(F.concat("__judged", "__open")).alias("s")).groupBy("s.kind", "s.votes", "s.traits").count().collect()  # bounded, see above
    counts = sorted((tuple(r["votes"]), r["kind"], tuple(r["traits"]), float(r["count"])) for r in seen)
    by_votes: dict[tuple[int, ...], float] = {}
    for v, *_, n in counts:
        by_votes[v] = by_votes.get(v, 0.0) + n
    post, _, _ = reliabilities(sorted(by_votes.items()))
    w = span_classifier([(one_hot(kind, v, t), post[v], n) for v, kind, t, n in counts])
    if w:
        m, shift = len(LABELERS), len(LABELERS) + len(KINDS)
        of_kind = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, w[m + i])])
        of_trait = [F.array(*[F.lit(x) for x in w[shift + sum(TRAITS[:i]) : shift + sum(TRAITS[: i + 1])]]) for i in range(len(TRAITS))]

        def sure(s):
            z = F.lit(w[-1]) + F.element_at(of_kind, s["kind"])
            for i in range(m):
                z = z + F.lit(w[i]) * s["votes"][i]
            for i, table in enumerate(of_trait):
                z = z + F.element_at(table, s["traits"][i] + 1)
            return z > math.log(SURE / (1 - SURE))

        rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
        added = F.transform(F.filter("__open", sure), lambda s: F.struct(F.element_at(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    else:
        added = F.array().cast("array<struct<rank:int,kind:string,start:int,end:int>>")
    return found.select(*names, by_kind(F.col("__base")).alias("base"), by_kind(F.concat("__base", added)).alias("spans"))


def redact(text, spans):
    """Column: ``text`` with each of ``spans`` (tagged; they may overlap) replaced by ``[KIND]``; null for a null text."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def emit(at, s, pieces):
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(F.array(between(pieces, at, s["start"]), mark))

    def marked(pieces):
        parts = scan(ordered, F.lit(0), "int", lambda at, s: F.greatest(at, s["end"]), lambda at, s: emit(at, s, pieces), "array<string>")
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), between(pieces, last, F.length(text)))

    return F.when(F.size(spans) > 0, let(cut_text(text), marked)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from ``find_personal_data``'s."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
