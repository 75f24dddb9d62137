"""Regular-expression matches with their places, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,end:int,hit:string,before:string>>"
#: Hits whose places are added up at a time: appending to an array copies it.
CHUNK = 256
#: Code points of the pieces in which a text is cut to take parts from.
PIECE = 512


def let(value, body):
    """Column: ``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items, begin, state_type: str, move, emit, out_type: str):
    """Column: what ``emit(state, item)``, an array, gives for each of ``items``, one after another.

    ``begin`` is the first state, ``move(state, item)`` the next one. Runs over ``CHUNK`` items
    at a time, so that the work follows the number of items.
    """
    part = lambda all_items, c: F.slice(all_items, c * CHUNK + 1, F.lit(CHUNK))
    starts_type, none = f"array<struct<c:int,state:{state_type}>>", F.array().cast(out_type)

    def step(acc, item):
        return F.struct(move(acc["state"], item).cast(state_type).alias("state"), F.concat(acc["out"], emit(acc["state"], item).cast(out_type)).alias("out"))

    def places(all_items):
        def chunk(acc, c):
            after = F.aggregate(part(all_items, c), acc["state"], lambda state, item: move(state, item).cast(state_type))
            return F.struct(after.alias("state"), F.concat(acc["out"], F.array(F.struct(c.alias("c"), acc["state"].alias("state"))).cast(starts_type)).alias("out"))

        chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_items), F.lit(1)) - 1) / CHUNK).cast("int"))
        starts = F.aggregate(chunks, F.struct(begin.cast(state_type).alias("state"), F.array().cast(starts_type).alias("out")), chunk, lambda acc: acc["out"])
        return F.flatten(F.transform(starts, lambda s: F.aggregate(part(all_items, s["c"]), F.struct(s["state"].alias("state"), none.alias("out")), step, lambda acc: acc["out"])))

    return let(items, places)


def cut_text(text):
    """Column: ``text`` in pieces of ``PIECE`` code points, for ``between``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(pieces, start, end):
    """Column: the code points from ``start`` to ``end`` of the text that was cut in ``pieces``; the work follows what is returned."""
    first = F.floor(start / PIECE).cast("int")
    own = F.array_join(F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(1))), "")
    return F.when(end > start, F.substring(own, start - first * PIECE + 1, end - start)).otherwise("")


def find_spans(text, pattern: str, guard=None, context: int = 0):
    """Column: all matches of ``pattern`` in ``text``, leftmost and non-overlapping, as ``array<struct<start, end, hit, before>>``.

    Places are code points, ``end`` exclusive; ``before`` has the ``context`` code points
    before the match. The matches and the gaps between them are cut out separately; running
    sums of their lengths give the places. ``pattern`` must not match the empty string.
    ``guard`` is a cheap condition that holds wherever there can be a match. The groups in
    ``pattern`` that repeat should be possessive: Java's matcher recurses for others, which
    a very long text exhausts.
    """
    none = F.array().cast(NO_SPANS)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))  # one more gap than hits
    tail = (lambda *parts: F.right(F.concat(*parts), F.lit(context))) if context else (lambda *parts: F.lit(""))

    def move(state, pair):
        width = F.length(pair["gap"]) + F.coalesce(F.length(pair["hit"]), F.lit(0))
        return F.struct((state["at"] + width).alias("at"), tail(state["tail"], pair["gap"], F.coalesce(pair["hit"], F.lit(""))).alias("tail"))

    def emit(state, pair):
        start = state["at"] + F.length(pair["gap"])
        own = F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), pair["hit"].alias("hit"), tail(state["tail"], pair["gap"]).alias("before"))
        return F.when(pair["hit"].isNull(), none).otherwise(F.array(own).cast(NO_SPANS))

    found = scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), "struct<at:int,tail:string>", move, emit, NO_SPANS)
    there = F.regexp_like(text, F.lit(pattern)) if guard is None else guard & F.regexp_like(text, F.lit(pattern))
    return F.when(there, found).otherwise(none)


def digits(hit):
    """Column: the ASCII digits of ``hit``."""
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number):
    """Column: whether a string of ASCII digits passes the Luhn check."""
    n = F.length(number)

    def step(acc, i):
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step)
    return F.when(n == 0, F.lit(False)).otherwise(F.pmod(total, F.lit(10)) == 0)


def tagged(kind: str, rank: int, spans):
    """Column: ``spans`` as ``array<struct<rank, kind, start, end>>``."""
    return F.transform(spans, lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def clear_of(spans, base):
    """Column: those of ``spans`` (as ``find_spans`` gives them) that share no place with any of ``base``.

    In the order of starts, a span is clear if no base span before it ends after its start,
    and none after it starts before its end: one scan for each.
    """
    kind = f"array<struct<start:int,rank:int,end:int,own:{NO_SPANS[6:-1]}>>"
    none = F.array().cast(kind)
    held = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("rank"), s["end"].alias("end"), F.lit(None).cast(NO_SPANS[6:-1]).alias("own"))).cast(kind)
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("rank"), s["end"].alias("end"), s.alias("own"))).cast(kind)
    ahead = scan(F.array_sort(F.concat(held, own)), F.lit(0), "int", lambda at, x: F.when(x["rank"] == 0, F.greatest(at, x["end"])).otherwise(at), lambda at, x: F.when((x["rank"] == 1) & (x["start"] < at), none).otherwise(F.array(x)), kind)
    back = scan(F.reverse(ahead), F.lit(2**31 - 1), "int", lambda at, x: F.when(x["rank"] == 0, F.least(at, x["start"])).otherwise(at), lambda at, x: F.when((x["rank"] == 0) | (x["end"] > at), none).otherwise(F.array(x)), kind)
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(F.transform(F.reverse(back), lambda x: x["own"]))


def listed(spans):
    """Column: tagged spans as ``kind:start:end``, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans):
    """Column: tagged spans by start, then rank."""
    moved = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(moved)


def by_kind(spans):
    """Column: tagged spans by rank, then start."""
    moved = F.transform(spans, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(moved)
