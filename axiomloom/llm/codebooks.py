"""Vectors as codes of 16 bytes: one codebook for each part, trained by Yinyang Lloyd rounds in whole numbers.

A pass assigns every part of every row to its codebook's nearest entry. The first pass looks
at all entries; it keeps, besides the codes, one lower bound for each group of entries: the
distance to the nearest entry of the group, the assigned one aside. Entries are clustered
into groups once, one group for each ten. When entries move, a group's bound falls by its
largest move, and the next pass scans only groups whose bound is not above the distance
to the entry assigned before. Distances that decide anything are whole numbers
(squares), bounds are rounded down, so a tie is always seen and goes to the lower index.

Each pass is one map over the rows, its result in the checkpoint folder; sums and counts
of each entry (16 * 64 rows) are added up by part and entry, and only these reach the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_totals, cut, finite_vector, list_matrix, small

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a group, about.
GROUP = 10
#: Rows that a worker looks at once.
_ROWS = 2048
#: By how much of itself a bound is widened against rounding.
_SLACK = 1e-5


def entry_groups(book: np.ndarray) -> np.ndarray:
    """The group of each entry of one codebook: a few Lloyd rounds over the entries, from evenly spaced ones."""
    n = max(1, len(book) // GROUP)
    points = book.astype(np.float64)
    centres = points[np.arange(n) * len(book) // n]
    for _ in range(5):
        group = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([points[group == g].mean(0) if (group == g).any() else centres[g] for g in range(n)])
    return group


def moved(before: list[np.ndarray], after: list[np.ndarray], groups: list[np.ndarray]) -> list[np.ndarray]:
    """For each part, each group's largest move, rounded up."""
    out = []
    for old, new, group in zip(before, after, groups, strict=True):
        far = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
        out.append(np.array([far[group == g].max(initial=0.0) for g in range(group.max() + 1)]) * (1 + _SLACK))
    return out


def assign(x: np.ndarray, book: np.ndarray, group: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One part's ``(code, squared distance, bound of each group, distances looked at)`` for the rows ``x``; without ``code`` all entries are scanned."""
    n, rows = group.max() + 1, np.arange(len(x))
    square = lambda a, b: ((a - b) ** 2).sum(-1)
    if code is None:
        best, near, lower = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), np.full((len(x), n), -1.0)
        looked = 0
    else:
        # the own entry's new distance is exact; a group's bound leaves it out
        best, near, lower, looked = code.copy(), square(x, book[code]), bound - drift[None], len(x)
    start, first = near.copy(), best.copy()
    reach = np.sqrt(near.astype(np.float64)) * (1 + _SLACK)
    scan = lower * (1 - _SLACK) <= reach[:, None]
    nearest, second = np.full((len(x), n), np.inf), np.full((len(x), n), np.inf)
    at = np.full((len(x), n), -1, np.int64)
    for g in range(n):
        own, entries = np.flatnonzero(scan[:, g]), np.flatnonzero(group == g)
        if not len(own) or not len(entries):
            continue
        d = square(x[own, None], book[None, entries])
        looked += d.size
        order = np.argsort(d, axis=1, kind="stable")[:, :2]  # stable: the lower index first
        k = np.arange(len(own))
        least, who = d[k, order[:, 0]], entries[order[:, 0]]
        nearest[own, g], at[own, g] = least, who
        if len(entries) > 1:
            second[own, g] = d[k, order[:, 1]]
        wins = (least < near[own]) | ((least == near[own]) & (who < best[own]))
        near[own] = np.where(wins, least, near[own])
        best[own] = np.where(wins, who, best[own])
    # a scanned group's bound is its nearest entry's distance, or the second's where the nearest is the row's own
    exact = np.sqrt(np.where(at == best[:, None], second, nearest)) * (1 - _SLACK)
    lower = np.where(scan, exact, lower)
    if code is not None:  # the entry that was left out of its group's bound before counts again
        left = np.flatnonzero(best != first)
        lower[left, group[first[left]]] = np.minimum(lower[left, group[first[left]]], np.sqrt(start[left].astype(np.float64)) * (1 - _SLACK))
    return best, near, np.minimum(lower, np.finfo(np.float32).max), looked


def _down(bound: np.ndarray) -> np.ndarray:
    """``bound`` in four bytes, rounded down."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def _pass(books: list[np.ndarray], groups: list[np.ndarray], drift: list[np.ndarray] | None):
    """Rows ``(..., x, state)`` with their codes, bounds and error anew; ``state`` is null before the first pass."""
    sizes = [int(g.max()) + 1 for g in groups]
    ends = np.cumsum([0, *sizes]).tolist()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                x = list_matrix(part.column("x"))
                length = x.shape[1] // PARTS
                codes, bounds, error = np.empty((len(x), PARTS), np.uint8), np.empty((len(x), ends[-1]), np.float32), np.zeros(len(x), np.int64)
                if drift is not None:
                    before = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), PARTS)
                    held = list_matrix(part.column("bounds"))
                for p in range(PARTS):
                    old = (None, None, None) if drift is None else (before[:, p].astype(np.int64), held[:, ends[p] : ends[p + 1]].astype(np.float64), drift[p])
                    best, near, lower, _ = assign(x[:, p * length : (p + 1) * length], books[p], groups[p], *old)
                    codes[:, p], bounds[:, ends[p] : ends[p + 1]] = best, _down(lower)
                    error += near
                columns = [part.column(c) for c in ("vec_id", "label", "x")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(bounds), pa.list_(pa.float32())), pa.array(error)], names=["vec_id", "label", "x", "code", "bounds", "error"])

    return run


def _sum_batches(batches):
    """Per partition, each part's and entry's sums of components and, last, its count."""
    held = None
    for batch in batches:
        x = list_matrix(batch.column(0))
        length = x.shape[1] // PARTS
        if held is None:
            held = np.zeros((PARTS, 256, length + 1), np.int64)
        codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(x), PARTS)
        for p in range(PARTS):
            np.add.at(held[p, :, :length], codes[:, p], x[:, p * length : (p + 1) * length])
            held[p, :, length] += np.bincount(codes[:, p], minlength=256)
    if held is not None:
        part, entry = np.nonzero(held[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(list(held[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "values"])


def updated(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """``books`` with each used entry at the floor of the mean of its parts in ``rows(x, code)``."""
    after = [b.copy() for b in books]
    parts = rows.select("x", "code").mapInArrow(_sum_batches, "part long, entry long, values array<long>")
    for r in array_totals(parts, ["part", "entry"]).collect():  # one row for each entry at most
        *sums, count = r["values"]
        after[r["part"]][r["entry"]] = [s // count for s in sums]
    return after


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` for each row of ``vectors``, and the codebooks ``[part][entry, place]``.

    Components are ``floor(scale * component)``; ``code`` has a byte for each part, ``error`` is
    the squared distance to the entries that it names. Codebooks begin as the parts of the
    64 rows of smallest id (null ids last, repeated ids by their components); fewer rows
    make fewer entries. An entry that no part is nearest to stays where it is. Rows whose vector
    is null or holds a null or non-finite component are left out; repeated rows count and
    are returned as often as they come; other columns are ignored. An empty table gives an
    empty result and empty codebooks. Vectors must have one length, a multiple of 16, and
    components below 2^29 after scaling whose squared distances fit a long: else ValueError.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(finite_vector(F.col("v")))
    rows = cut(rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x")))
    short, long, least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if short is None:
        empty = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return empty, [np.zeros((0, 0), np.int64)] * PARTS
    if short != long or long % PARTS or not long:
        raise ValueError(f"Vectors must have one length, a multiple of {PARTS}; there are lengths from {short} to {long}.")
    far = max(abs(least), abs(most))
    if far >= 1 << 29 or (2 * far) ** 2 * long >= 1 << 62:
        raise ValueError("Components are too large: a squared distance might not fit 64 bits.")
    first = np.array([r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()], np.int64)
    books = [p.copy() for p in np.split(first, PARTS, axis=1)]
    groups, drift = [entry_groups(b) for b in books], None
    kinds = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, x array<long>, code binary, bounds array<float>, error long"
    for _ in range(rounds):
        rows = cut(rows.mapInArrow(_pass(books, groups, drift), kinds))
        after = updated(rows, books)
        books, drift = after, moved(books, after, groups)
    rows = rows.mapInArrow(_pass(books, groups, drift), kinds)
    return cut(rows.select("vec_id", "label", "code", "error")), books


def coded(vectors: DataFrame, label_col: str = "label", **columns) -> DataFrame:
    """:func:`encode` with ``label_error``, the error summed over the rows of a label (nulls together), and ``codebooks_sha256``."""
    rows, books = encode(vectors, label_col=label_col, **columns)
    sums = cut(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")))
    sums = small(sums).withColumnRenamed("label", "other_label")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("other_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
