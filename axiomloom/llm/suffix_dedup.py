"""Removal of passages that repeat: every byte covered by a string of ``LENGTH`` bytes that a smaller id has too.

The strings are found with sorted suffixes, of which only those are built that can repeat:

1. Anchors. Each string of ``LENGTH`` bytes has an anchor: of its ``ANCHOR``-byte pieces
   the one of least hash, the leftmost of equal ones. Equal strings have equal anchors at
   equal places, and about 16 strings in a row share one. Documents are dealt to groups by
   id; a group sends the short codes of its anchors to buckets by hash, one row to each, and
   each bucket tells each group which of them are in other documents too.
2. Suffixes. For these anchors a group sends the passage that their strings cover, once
   for each different passage, with its smallest id. A bucket joins equal passages (by
   polynomial hash, verified byte by byte). Where an anchor has several passages, the
   suffixes that begin its strings are sorted: a merge sort whose comparisons find the
   common extension of two suffixes by binary search over prefix polynomial hashes, so in
   logarithmic time; neighbours that agree over ``LENGTH`` bytes are verified byte by byte.
   Each string so learns the smallest id that has it.
3. Removal. The answers go back to the groups, which mark the covered bytes.

An anchor with over ``HOT`` different passages (a common line in changing surroundings)
would gather in one bucket; its strings are sent one by one instead, by their own hash.
Copies of a whole document are found by digest first and take no part in the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces

LENGTH, ANCHOR, HOT = 50, 20, 1000
#: Text of a group of documents, and text for each bucket of passages and of anchors' codes; an anchor's code takes a few bytes.
GROUP_BYTES, BUCKET_BYTES, CODE_BYTES = 4 << 20, 8 << 20, 64 << 20
_U = np.uint64
_MASK = _U(0xFFFFFFFF)
_rng = np.random.default_rng(50)
_TABLE = _rng.integers(0, 1 << 64, 256, dtype=_U)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_MIX = _U(0x9E3779B97F4A7C15)
#: Bytes that are hashed at a time, so that only prefix hashes and anchors are held for a whole group.
_BLOCK = 1 << 18
_LOW_BITS = 12


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[_U(1)], np.full(max(n - 1, 0), _U(base))]), dtype=_U)


_INVERSE = pow(_BASE, -1, 1 << 64)
_FORWARD, _BACKWARD = _powers(_BASE, _BLOCK + LENGTH), _powers(_INVERSE, _BLOCK + LENGTH)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


class Text:
    """Bytes with prefix polynomial hashes modulo 2**64 over random byte values."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        n = len(data)
        self.prefix = np.zeros(n + 1, _U)
        for a in range(0, n, _BLOCK):
            own = self.data[a : a + _BLOCK]
            np.cumsum(_TABLE[own] * (_FORWARD[: len(own)] * _U(pow(_BASE, a, 1 << 64))), out=self.prefix[a + 1 : a + 1 + len(own)])
            self.prefix[a + 1 : a + 1 + len(own)] += self.prefix[a]
        # the inverse power of a place is that of its low bits times that of the rest
        self.far = _powers(pow(_INVERSE, 1 << _LOW_BITS, 1 << 64), (n >> _LOW_BITS) + 1)

    def back(self, at):
        return self.far[at >> _LOW_BITS] * _BACKWARD[at & ((1 << _LOW_BITS) - 1)]

    def hashes(self, at, length):
        """Hashes of the strings of ``length`` that begin at ``at``."""
        return (self.prefix[at + length] - self.prefix[at]) * self.back(at)

    def pieces(self, length: int, start: int, end: int) -> np.ndarray:
        """Hashes of the strings of ``length`` at the places from ``start`` to ``end``, as far as there are any."""
        end = min(end, len(self.data) - length + 1)
        if end <= start:
            return np.zeros(0, _U)
        return (self.prefix[start + length : end + length] - self.prefix[start:end]) * (_BACKWARD[: end - start] * _U(pow(_INVERSE, start, 1 << 64)))

    def common(self, x: np.ndarray, y: np.ndarray, most: int = LENGTH) -> np.ndarray:
        """The common extension of the suffixes at ``x`` and ``y``, up to ``most``, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
        for _ in range(most.bit_length()):
            mid = (low + high + 1) >> 1
            same = self.hashes(x, mid) == self.hashes(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for the suffixes at ``x`` and ``y``, cut to ``LENGTH``."""
        same = self.common(x, y)
        ends = same == LENGTH
        at = np.where(ends, 0, same)
        return np.where(ends, 0, np.sign(self.data[x + at].astype(np.int16) - self.data[y + at]))

    def equal(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the strings at ``x`` and ``y`` of each ``length`` agree byte by byte."""
        out = np.ones(len(x), bool)
        for start in range(0, len(x), 1 << 15):
            s = slice(start, start + (1 << 15))
            n = length[s]
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            differ = self.data[x[s][row] + step] != self.data[y[s][row] + step]
            out[start + row[differ]] = False
        return out


def sort_suffixes(text: Text, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes ``at`` by group, then by their first ``LENGTH`` bytes: merge sort of all groups at once.

    ``group`` must be ascending. In each round every suffix finds its rank among those of
    the run beside its own by binary search.
    """
    n = len(at)
    order = np.arange(n)
    if not n:
        return order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    slot, width = np.arange(n), 1
    while width < size.max():
        live = np.flatnonzero(end - begin > width)
        own = slot[live]
        run = (own - begin[live]) // width
        low = np.minimum(begin[live] + (run ^ 1) * width, end[live])
        high = np.minimum(low + width, end[live])
        later = (run & 1) == 1
        left, right = low.copy(), high.copy()
        open_ = np.flatnonzero(left < right)
        while len(open_):
            mid = (left[open_] + right[open_]) >> 1
            c = text.compare(at[order[own[open_]]], at[order[mid]])
            go = (c > 0) | ((c == 0) & later[open_])
            left[open_] = np.where(go, mid + 1, left[open_])
            right[open_] = np.where(go, right[open_], mid)
            open_ = open_[left[open_] < right[open_]]
        to = begin[live] + (run >> 1) * 2 * width + (own - begin[live] - run * width) + (left - low)
        new = order.copy()
        new[to] = order[own]
        order = new
        width *= 2
    return order


def string_classes(text: Text, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each suffix, equal for those of one group that agree over ``LENGTH`` bytes. ``group`` must be ascending."""
    order = sort_suffixes(text, at, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero(group[a] == group[b])
    near = near[text.common(at[a[near]], at[b[near]]) == LENGTH]
    true = text.equal(at[a[near]], at[b[near]], np.full(len(near), LENGTH))
    joined = np.zeros(len(order), bool)
    joined[near + 1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(~joined)
    if not true.all():  # equal hashes of different strings: such classes are told apart by their bytes
        known: dict = {}
        for i in np.flatnonzero(np.isin(number, number[b[near[~true]]])):
            number[i] = -1 - known.setdefault((group[i], text.data[at[i] : at[i] + LENGTH].tobytes()), len(known))
    return number


def passage_classes(text: Text, key: np.ndarray, at: np.ndarray, length: np.ndarray, extra: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, first)``: passages by key and class, in a class by ``least``; ``first`` marks each class's first. Classes agree in ``extra`` and every byte."""
    own = _mixed(text.hashes(at, length) ^ (extra.astype(_U) * _MIX))
    while True:
        order = np.lexsort((least, own, key))
        k, o = key[order], own[order]
        first = np.ones(len(order), bool)
        first[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        same = (length[head] == length[order]) & (extra[head] == extra[order])
        later = np.flatnonzero(same & ~first)
        same[later] = text.equal(at[head[later]], at[order[later]], length[order[later]])
        if same.all():
            return order, first
        own[order[~same]] += _MIX


class Group:
    """The documents of one group: their strings, anchors and passages."""

    def __init__(self, table: pa.Table, copies: set[tuple[int, bytes]], code_buckets: int, buckets: int, code_bytes: int):
        ids, texts = table.column("key").to_pylist(), table.column("data").to_pylist()
        rows = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.rows, self.keys = rows, np.array([ids[i] for i in rows], np.int64)
        sizes = np.array([len(texts[i]) for i in rows], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts, self.buckets, self.shift = self.ends - sizes, _U(buckets), _U(64 - 8 * code_bytes)
        # by text, not by id alone: of the rows of one id (or of none) some may be copies and others not
        copied = {k for k, _ in copies}
        self.copy = np.array([ids[i] in copied and (ids[i], hashlib.sha256(texts[i]).digest()) in copies for i in rows], bool)
        self.text = Text(b"".join([texts[i] for i in rows]))
        # strings that begin at a place: not in copies, none over a document's end
        use = np.flatnonzero((sizes >= LENGTH) & ~self.copy)
        begin, end = self.starts[use], self.ends[use] - LENGTH + 1
        found = [self._anchors(begin, end, a, a + _BLOCK) for a in range(0, len(self.text.data), _BLOCK)]
        self.anchor, self.hash, self.first, count = (np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.int64, _U, np.int64, np.int64)))
        # an anchor whose strings begin in two blocks is one
        new = np.ones(len(self.anchor), bool)
        new[1:] = self.anchor[1:] != self.anchor[:-1]
        heads = np.flatnonzero(new)
        self.count = np.add.reduceat(count, heads) if len(heads) else count
        self.anchor, self.hash, self.first = self.anchor[heads], self.hash[heads], self.first[heads]
        self.row = np.searchsorted(self.ends, self.anchor, side="right")
        bucket, code = (self.hash % _U(code_buckets)).astype(np.int64), self.hash >> self.shift
        order = np.lexsort((code, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (bucket[order[1:]] != bucket[order[:-1]]) | (code[order[1:]] != code[order[:-1]])
        self.order, self.fresh, self.bucket = order, fresh, bucket
        self.unique = order[fresh]
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(fresh) - 1

    def _anchors(self, begin: np.ndarray, end: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of the strings that begin from ``a`` to ``b``: place, hash, the first of its strings, how many in a row."""
        lo, hi = np.searchsorted(end, a, side="right"), np.searchsorted(begin, b)
        first, last = np.maximum(begin[lo:hi], a), np.minimum(end[lo:hi], b)
        size = last - first
        begins = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if not len(begins):
            return np.zeros(0, np.int64), np.zeros(0, _U), begins, begins
        h = _mixed(self.text.pieces(ANCHOR, a, b + LENGTH - ANCHOR))
        low = (h & ~_MASK) | np.arange(len(h), dtype=_U)
        reach = 1
        while reach * 2 <= LENGTH - ANCHOR + 1:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        rest = LENGTH - ANCHOR + 1 - reach
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        place = (low[begins - a] & _MASK).astype(np.int64)
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        return place[heads] + a, h[place[heads]], begins[heads], np.diff(np.concatenate([heads, [len(place)]]))

    def codes(self, code_bytes: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Buckets with, for each, the codes of its anchors and a byte for each: 0 for one passage in one document, or at most 255 passages."""
        if not len(self.order):
            return np.zeros(0, np.int64), [], []
        own = _mixed(self.text.hashes(self.first, self.count + LENGTH - 1)) ^ (self.anchor - self.first).astype(_U)
        at = np.flatnonzero(self.fresh)
        by_passage = np.lexsort((own, self.inverse))
        i, o = self.inverse[by_passage], own[by_passage]
        other = np.ones(len(i), bool)
        other[1:] = (i[1:] != i[:-1]) | (o[1:] != o[:-1])
        passages = np.bincount(i, other, minlength=len(at)).astype(np.int64)
        low = np.full(len(at), 1 << 62)
        high = np.full(len(at), -(1 << 62))
        np.minimum.at(low, self.inverse, self.keys[self.row])
        np.maximum.at(high, self.inverse, self.keys[self.row])
        number = np.where(low == high, 0, np.minimum(passages, 255)).astype(np.uint8)
        code = (self.hash[self.unique] >> self.shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :code_bytes]
        buckets, begin = np.unique(self.bucket[self.unique], return_index=True)
        cuts = [*begin.tolist(), len(self.unique)]
        return buckets, [np.ascontiguousarray(code[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], [number[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def passages(self, flags: dict[int, bytes]) -> dict:
        """The passages of anchors that are in other documents, by bucket and class, from the buckets' flags (1 shared, 2 hot)."""
        known = np.concatenate([np.frombuffer(flags[b], np.uint8) for b in np.unique(self.bucket[self.unique]).tolist()]) if len(self.unique) else np.zeros(0, np.uint8)
        flag = known[self.inverse] if len(known) else known
        plain, hot = np.flatnonzero(flag == 1), np.flatnonzero(flag == 2)
        n = self.count[hot]
        begin = np.repeat(self.first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = _mixed(self.text.hashes(begin, LENGTH) + _MIX)
        key = np.concatenate([self.hash[plain], one])
        at = np.concatenate([self.first[plain], begin])
        count = np.concatenate([self.count[plain], np.ones(len(begin), np.int64)])
        offset = np.concatenate([self.anchor[plain] - self.first[plain], np.full(len(begin), 255)])
        owner = self.keys[np.concatenate([self.row[plain], np.repeat(self.row[hot], n)]).astype(np.int64)]
        bucket = (key % self.buckets).astype(np.int64)
        order, first = passage_classes(self.text, key, at, count + LENGTH - 1, offset, owner)
        number = np.cumsum(first) - 1
        heads = order[first]
        by_bucket = np.argsort(bucket[heads], kind="stable")
        place = np.empty(len(heads), np.int64)
        place[by_bucket] = np.arange(len(heads))
        member = np.empty(len(order), np.int64)
        member[order] = place[number] if len(order) else number
        heads = heads[by_bucket]
        return {"key": key[heads], "at": at[heads], "count": count[heads], "offset": offset[heads], "owner": owner[heads], "bucket": bucket[heads], "of": member, "of_at": at, "of_count": count, "of_owner": owner}


_BLOBS = ("flags", "keys", "owners", "shape", "passages")
CODES = "gid long, bucket long, codes binary, numbers binary"
FLAGS = "gid long, bucket long, flags binary"
PASSAGES = "gid long, bucket long, flags binary, keys binary, owners binary, shape binary, passages binary"
ANSWERS = "gid long, bucket long, flags binary, least binary, runs binary"
REMOVED = "row_id long, kept binary, removed array<struct<start:long,end:long>>"


def answer_codes(table: pa.Table, code_bytes: int) -> pa.Table:
    """For each group, which of its codes are in other documents: 0 no, 1 yes, 2 with over ``HOT`` passages."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, code_bytes) for x in table.column("codes").to_pylist()]
    number = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("numbers").to_pylist()]).astype(np.int64)
    wide = np.zeros((len(number), 8), np.uint8)
    wide[:, :code_bytes] = np.concatenate(raw)
    code = wide.view("<u8").ravel()
    order = np.argsort(code, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = code[order[1:]] != code[order[:-1]]
    at = np.flatnonzero(first)
    groups = np.diff(np.concatenate([at, [len(order)]]))
    shared = (groups > 1) | (np.maximum.reduceat(number[order], at) > 0)
    hot = np.add.reduceat(np.maximum(number[order], 1), at) > HOT
    flag = np.empty(len(order), np.uint8)
    flag[order] = np.repeat(np.where(shared, np.where(hot, 2, 1), 0).astype(np.uint8), groups)
    cuts = np.cumsum([0, *(len(x) for x in raw)]).tolist()
    return pa.table({"gid": table.column("gid"), "bucket": table.column("bucket"), "flags": pa.array([flag[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def answer_passages(table: pa.Table) -> pa.Table:
    """For each group's passages, the smallest id with the passage, and the runs of strings that a still smaller id has."""
    column = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    keys, owners, shapes = column("keys", _U), column("owners", np.int64), column("shape", np.uint8)
    sizes = [len(x) for x in keys]
    key, owner = np.concatenate(keys), np.concatenate(owners)
    shape = np.concatenate(shapes).reshape(-1, 2).astype(np.int64)
    count, offset = shape[:, 0], shape[:, 1]
    length = count + LENGTH - 1
    text = Text(b"".join(table.column("passages").to_pylist()))
    at = np.cumsum(length) - length
    least, runs = owner.copy(), np.zeros((0, 3), np.int32)
    if len(key):
        order, first = passage_classes(text, key, at, length, offset, owner)
        number = np.cumsum(first) - 1
        heads = order[first]
        best = owner[heads]
        least[order] = best[number]
        k = key[heads]
        several = np.zeros(len(k), bool)
        several[1:] = k[1:] == k[:-1]
        several[:-1] |= several[1:]
        own = np.flatnonzero(several)
        n = count[heads[own]]
        of = np.repeat(own, n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = at[heads[of]] + step
        # equal strings have the anchor at the same place, so only those are sorted together
        apart = np.lexsort((offset[heads[of]] - step, k[of]))
        of, step, begin = of[apart], step[apart], begin[apart]
        side = offset[heads[of]] - step
        change = np.ones(len(of), bool)
        change[1:] = (k[of[1:]] != k[of[:-1]]) | (side[1:] != side[:-1])
        cls = string_classes(text, begin, np.cumsum(change))
        by_class = np.argsort(cls, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], cls[by_class[1:]] != cls[by_class[:-1]]])) if len(cls) else np.zeros(0, np.int64)
        smallest = np.empty(len(of), np.int64)
        if len(cls):
            smallest[by_class] = np.repeat(np.minimum.reduceat(best[of[by_class]], edge), np.diff(np.concatenate([edge, [len(of)]])))
        hit = np.flatnonzero(smallest < best[of])
        hit = hit[np.lexsort((step[hit], of[hit]))]
        c, s = of[hit], step[hit]
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1] + 1)
        a = np.flatnonzero(fresh)
        last = np.concatenate([a[1:], [len(hit)]]) - 1 if len(a) else a
        per = {"c": c[a], "from": s[a], "to": s[last] if len(a) else s[a]}
        # runs go to the members of the class that own its smallest id
        members = order[owner[order] == best[number]]
        of_member = number[owner[order] == best[number]]
        lo, hi = np.searchsorted(per["c"], of_member), np.searchsorted(per["c"], of_member, side="right")
        take = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        runs = np.stack([np.repeat(members, hi - lo), per["from"][take], per["to"][take]], 1).astype(np.int64)
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
    cuts = np.cumsum([0, *sizes])
    edges = np.searchsorted(runs[:, 0], cuts)
    out_least = [least[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    out_runs = [(runs[a:b] - np.array([start, 0, 0])).astype(np.int32).tobytes() for start, a, b in zip(cuts, edges, edges[1:], strict=False)]
    return pa.table({"gid": table.column("gid"), "bucket": table.column("bucket"), "flags": table.column("flags"), "least": pa.array(out_least, pa.binary()), "runs": pa.array(out_runs, pa.binary())})


def _copies(side: pa.Table) -> set[tuple[int, bytes]]:
    own = side.filter(pc.is_null(side.column("bucket")))
    return set(zip(own.column("copy").to_pylist(), own.column("flags").to_pylist(), strict=True))


def _split(side: pa.Table) -> pa.Table:
    return side.filter(pc.is_valid(side.column("bucket")))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, kept, removed)`` for each row of ``docs``.

    ``removed`` lists the maximal runs of removed bytes (``start``, ``end`` exclusive) of the
    whole text as UTF-8, ``kept`` is what is left. A byte goes if a string of ``LENGTH``
    bytes over it also begins in a document of smaller id; strings are judged on the
    input. Null texts are empty. A null id counts as larger than all others; rows of equal
    ids don't remove each other's bytes. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    base = base.withColumn("key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    known = cut(base.select("key", F.sha2("data", 256).alias("digest"), F.octet_length("data").cast("long").alias("n_bytes")))
    total = known.agg(F.sum("n_bytes")).first()[0] or 0
    groups, buckets = pieces(total, GROUP_BYTES, spark), pieces(total, BUCKET_BYTES, spark)
    code_buckets = min(buckets, pieces(total, CODE_BYTES, spark))
    # with 10 bits over the number of bytes, hardly an anchor shares its code by chance
    code_bytes = min(8, -(-(total.bit_length() + 10) // 8))
    # rows without an id share a key, so their texts deal them
    gid = lambda digest: F.pmod(F.when(F.col("key") == (1 << 63) - 1, F.xxhash64(digest, F.lit(50))).otherwise(F.xxhash64("key", F.lit(50))), F.lit(groups))
    first = cut(known.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = known.join(first, "digest").where(F.col("key") > F.col("first")).select("key", "digest").distinct()
    copies = cut(copies.withColumn("gid", gid(F.col("digest"))))
    base = base.withColumn("gid", gid(F.sha2("data", 256)))
    none = lambda name: F.lit(None).cast("binary").alias(name)
    copy_rows = copies.select("gid", F.lit(None).cast("long").alias("bucket"), F.col("key").alias("copy"), F.unhex("digest").alias("flags"), none("least"), none("runs"))

    def send_codes(_, left, right):
        b, codes, numbers = Group(left, _copies(right), code_buckets, buckets, code_bytes).codes(code_bytes) if left.num_rows else (np.zeros(0, np.int64), [], [])
        own = left.column("gid")[0].as_py() if left.num_rows else 0
        return pa.table({"gid": pa.array([own] * len(b), pa.int64()), "bucket": pa.array(b), "codes": pa.array(codes, pa.binary()), "numbers": pa.array(numbers, pa.binary())})

    def send_passages(_, left, right):
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(["gid", "bucket", *_BLOBS], [pa.int64(), pa.int64(), *[pa.binary()] * 5], strict=True)})
        g, side = Group(left, _copies(right), code_buckets, buckets, code_bytes), _split(right)
        flags = dict(zip(side.column("bucket").to_pylist(), side.column("flags").to_pylist(), strict=True))
        p = g.passages(flags)
        to = sorted({*flags, *p["bucket"].tolist()})
        cuts = [*np.searchsorted(p["bucket"], to).tolist(), len(p["bucket"])]
        data = g.text.data.tobytes()
        ends = p["at"] + p["count"] + LENGTH - 1
        shape = np.stack([p["count"], p["offset"]], 1).astype(np.uint8)
        parts = list(zip(cuts, cuts[1:], strict=False))
        texts = [b"".join([data[a:b] for a, b in zip(p["at"][i:j].tolist(), ends[i:j].tolist(), strict=True)]) for i, j in parts]
        own = left.column("gid")[0].as_py()
        return pa.table(
            {
                "gid": pa.array([own] * len(to), pa.int64()), "bucket": pa.array(to, pa.int64()), "flags": pa.array([flags.get(b, b"") for b in to], pa.binary()),
                "keys": pa.array([p["key"][i:j].tobytes() for i, j in parts], pa.binary()), "owners": pa.array([p["owner"][i:j].tobytes() for i, j in parts], pa.binary()),
                "shape": pa.array([shape[i:j].tobytes() for i, j in parts], pa.binary()), "passages": pa.array(texts, pa.binary()),
            }
        )

    def remove(_, left, right):
        kept, removed, ids = [], [], []
        if left.num_rows:
            g, side = Group(left, _copies(right), code_buckets, buckets, code_bytes), _split(right)
            at = side.column("bucket").to_pylist()
            order = sorted(range(len(at)), key=at.__getitem__)
            column = lambda name: [side.column(name)[i].as_py() for i in order]
            p = g.passages(dict(zip(side.column("bucket").to_pylist(), side.column("flags").to_pylist(), strict=True)))
            least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in column("least"))])
            runs, base_at = [np.zeros((0, 3), np.int64)], 0
            for x, y in zip(column("runs"), column("least"), strict=True):
                r = np.frombuffer(x, np.int32).reshape(-1, 3).astype(np.int64)
                runs.append(r + np.array([base_at, 0, 0]))
                base_at += len(y) // 8
            run = np.concatenate(runs)
            n = len(g.text.data)
            mark = np.zeros(n + 1, np.int32)
            of = p["of"]
            whole = p["of_owner"] > least[of] if len(of) else np.zeros(0, bool)
            np.add.at(mark, p["of_at"][whole], 1)
            np.add.at(mark, p["of_at"][whole] + p["of_count"][whole] + LENGTH - 1, -1)
            rest = np.flatnonzero(~whole)
            lo, hi = np.searchsorted(run[:, 0], of[rest]), np.searchsorted(run[:, 0], of[rest], side="right")
            take = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            begin = np.repeat(p["of_at"][rest], hi - lo)
            np.add.at(mark, begin + run[take, 1], 1)
            np.add.at(mark, begin + run[take, 2] + LENGTH, -1)
            np.cumsum(mark, out=mark)
            gone = mark[:-1] > 0
            data, row_ids = g.text.data, left.column("row_id").to_pylist()
            for k, i in enumerate(g.rows):
                a, b = int(g.starts[k]), int(g.ends[k])
                own = gone[a:b] if not g.copy[k] or b - a < LENGTH else np.ones(b - a, bool)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                ids.append(row_ids[i])
                removed.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                kept.append(data[a:b][~own].tobytes() if len(edge) else data[a:b].tobytes())
        return pa.table({"row_id": pa.array(ids, pa.int64()), "kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    left = base.select("gid", "key", F.col("doc_id").alias("row_id"), "data")
    by_group = left.groupBy("gid")
    codes = by_group.cogroup(copy_rows.groupBy("gid")).applyInArrow(send_codes, CODES)
    flags = codes.groupBy("bucket").applyInArrow(lambda t: answer_codes(t, code_bytes), FLAGS)
    back = flags.select("gid", "bucket", F.lit(None).cast("long").alias("copy"), "flags", none("least"), none("runs")).union(copy_rows)
    passages = by_group.cogroup(back.groupBy("gid")).applyInArrow(send_passages, PASSAGES)
    answers = passages.groupBy("bucket").applyInArrow(answer_passages, ANSWERS)
    back = answers.select("gid", "bucket", F.lit(None).cast("long").alias("copy"), "flags", "least", "runs").union(copy_rows)
    done = by_group.cogroup(back.groupBy("gid")).applyInArrow(remove, REMOVED)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return done.select(F.col("row_id").alias("doc_id"), (F.octet_length("kept").cast("long") + gone).alias("n_bytes"), "kept", "removed")
