"""Exact largest inner products of stated queries by norm-sorted, SVD-rotated partial sums.

Vectors are turned to whole numbers first, so that a score is a whole number and ties are
exact. Both sides are rotated by the right singular vectors of all vectors (the eigenvectors of the
second moments, summed in one pass), which leaves inner products as they are and moves
most of their size into the first coordinates. Candidates are cut into blocks of descending
length; queries are dealt to blocks of their own, and each pair of blocks is a cell:

1. The block of the longest candidates meets all queries. A query's ``k``-th score there
   is its floor.
2. A block is only sent to query blocks where ``|q| |x|`` of its longest row can reach a floor.
3. In a cell, candidates come by descending length, a chunk at a time. A chunk ends the cell
   when its longest row can't reach any query's ``k``-th score. Else coordinates are added up
   in steps; a pair goes when its partial sum and ``|q rest| |x rest|`` (Cauchy and Schwarz)
   together stay below the query's ``k``-th score. What is left is scored in whole numbers.

Rounding can't lose a pair: bounds are widened by ``SLACK`` of ``|q| |x|``, far above the error
of the rotated sums, and only whole-number scores are compared with each other. The
rotation only decides how early pairs go. Lengths of vectors whose rotations would take over
``ROTATED`` numbers together are not rotated.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import array_totals, by_cells, cut, finite_vector, list_matrix, shuffle_width, whole_cells

TOP, EVERY, SCALE = 5, 50, 256
#: Bytes of a block of candidates and of queries as doubles, at most about; the fewest candidates that a block is cut down to.
BLOCK_BYTES, QUERY_BYTES, LEAST_ROWS = 1 << 24, 1 << 22, 512
#: Queries and candidates that are compared at once, and the share of live pairs under which they are scored one by one.
_QUERIES, _CHUNK, SPARSE = 512, 1024, 0.02
SLACK = 1e-9
ROTATED = 1 << 22
#: Squared lengths from which on a score might not fit a long.
_LONGEST = float(1 << 62)


def _moment_batches(batches):
    """Per partition and length, the second moments: one row for each coordinate."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        widths = np.array(batch.column(0).value_lengths().to_pylist(), np.int64)
        for width in np.unique(widths).tolist():
            x = list_matrix(batch.column(0).filter(pa.array(widths == width))).astype(np.float64)
            held[width] = held.get(width, 0) + x.T @ x
    for width, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(width, width)), pa.array(np.arange(width)), pa.array(list(m), pa.list_(pa.float64()))], names=["width", "at", "values"])


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For the most frequent lengths of ``rows(x)``, the right singular vectors of their rows by falling singular value, as columns."""
    taken, room = [], ROTATED
    for r in rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(8).collect():
        if 1 < r["width"] and r["width"] ** 2 <= room:
            taken.append(r["width"])
            room -= r["width"] ** 2
    found: dict[int, np.ndarray] = {w: np.zeros((w, w)) for w in taken}
    parts = rows.where(F.size("x").isin(taken)).select("x").mapInArrow(_moment_batches, "width long, at long, values array<double>")
    for r in array_totals(parts, ["width", "at"]).collect() if taken else []:  # ROTATED numbers at most
        found[r["width"]][r["at"]] = r["values"]
    return {w: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for w, m in found.items()}


def _steps(width: int) -> list[int]:
    """Ends of the steps in which ``width`` coordinates are added up."""
    return sorted({math.ceil(width * k / 8) for k in range(1, 9)} - {0})


class Comparison:
    """Queries of one length against candidates of the same length, taken chunk after chunk."""

    def __init__(self, q: np.ndarray, q_row: np.ndarray, floor: np.ndarray, k: int, turn: np.ndarray | None):
        self.q, self.q_row, self.k, self.turn = q, q_row, k, turn
        self.least = floor.astype(np.float64)  # -inf where nothing is known yet
        self.floor = self.least.copy()
        self.rotated, self.rest, self.norm = self._prepared(q)
        self.best = [np.zeros(0, np.int64)] * 5  # query's place, score, id, whether it is null, row

    def _prepared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rotated coordinates, lengths of what is left after each step, lengths."""
        y = x.astype(np.float64)
        y = y if self.turn is None else y @ self.turn
        squares = np.cumsum(y[:, ::-1] ** 2, axis=1)[:, ::-1]
        ends = _steps(x.shape[1])
        rest = np.sqrt(np.stack([squares[:, h] if h < x.shape[1] else np.zeros(len(x)) for h in ends], 1)) if ends else np.zeros((len(x), 0))
        return y, rest, np.sqrt(squares[:, 0]) if ends else np.zeros(len(x))

    def add(self, x: np.ndarray, row: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> bool:
        """Compares the next candidates, whose lengths only fall from call to call; false once no later one can count."""
        y, rest, norm = self._prepared(x)
        reach = self.norm * (norm.max() * (1 + SLACK))
        live = np.flatnonzero(reach >= self.least)
        if not len(live):
            return False
        found = [self._survivors(live[s : s + _QUERIES], x, y, rest, norm) for s in range(0, len(live), _QUERIES)]
        at, of, score = (np.concatenate(c) for c in zip(*found, strict=True))
        other = self.q_row[at] != row[of]
        at, of, score = at[other], of[other], score[other]
        self.best = [np.concatenate(c) for c in zip(self.best, [at, score, ids[of], absent[of], row[of]], strict=True)]
        self._trim()
        return True

    def _survivors(self, live, x, y, rest, norm):
        least = self.least[live, None]
        slack = SLACK * self.norm[live, None] * norm[None]
        sums, begin, done = np.zeros((len(live), len(x))), 0, 0
        alive = np.ones(sums.shape, bool)
        for step, end in enumerate(_steps(x.shape[1])):
            sums += self.rotated[live, begin:end] @ y[:, begin:end].T
            alive &= sums + self.rest[live, step, None] * rest[None, :, step] + slack >= least
            begin, done = end, np.count_nonzero(alive)
            if done <= SPARSE * alive.size:
                break
        at, of = np.nonzero(alive)
        score = np.empty(len(at), np.int64)
        for s in range(0, len(at), 1 << 16):
            score[s : s + (1 << 16)] = np.einsum("ij,ij->i", self.q[live[at[s : s + (1 << 16)]]], x[of[s : s + (1 << 16)]])
        enough = score >= self.least[live[at]]
        return live[at[enough]], of[enough], score[enough]

    def _trim(self) -> None:
        """Keeps each query's ``k`` best and raises what its further ones must reach."""
        at, score, ids, absent, row = self.best
        order = np.lexsort((row, ids, absent, -score, at))
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        place = np.arange(len(at)) - np.repeat(first, sizes)
        self.best = [c[order][place < self.k] for c in (self.best[0], score, ids, absent, row)]
        last = self.best[0][at_last := np.flatnonzero(place[place < self.k] == self.k - 1)]
        self.least[last] = np.maximum(self.floor[last], self.best[1][at_last])


def _cell_batches(k: int, turns: dict[int, np.ndarray]):
    def run(batches):
        for t in whole_cells(batches, 1 << 13):
            cell = t.column("cell").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
            for i, j in zip(edges, edges[1:]):
                yield from one(t.slice(i, j - i).combine_chunks())

    def one(t):
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        widths = np.array(t.column("x").combine_chunks().value_lengths().to_pylist(), np.int64)
        for width in np.unique(widths[asks]).tolist():
            q, x = (t.filter(pa.array((widths == width) & side)) for side in (asks, ~asks))
            if not len(x):
                continue
            least = q.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            comparison = Comparison(list_matrix(q.column("x")), q.column("row").to_numpy(), np.where(np.isnan(least), -np.inf, least), k, turns.get(width))
            order = np.argsort(-x.column("size").to_numpy(), kind="stable")
            ids, absent = x.column("vec_id").fill_null(0).to_numpy(), x.column("vec_id").is_null().to_numpy(zero_copy_only=False)
            row, vectors, begin, many = x.column("row").to_numpy(), list_matrix(x.column("x")), 0, 64
            while begin < len(order):  # few at first, so that most meet a floor
                own = order[begin : begin + many]
                if not comparison.add(vectors[own], row[own], ids[own], absent[own]):
                    break
                begin, many = begin + many, min(2 * many, _CHUNK)
            at, score, best, absent, _ = comparison.best
            yield pa.RecordBatch.from_arrays([pa.array(comparison.q_row[at]), q.column("vec_id").combine_chunks().take(pa.array(at)), pa.array(best, mask=absent.astype(bool)), pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, asks: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(query_row, query_id, rank, vec_id, score)``: for each row of ``vectors`` of which ``asks`` is true, the ``k`` other rows of largest inner product, all if there are fewer.

    Components are ``floor(scale * component)``. Rows are compared with rows of their own
    length only (empty vectors score 0). Vectors that are null or hold a null or non-finite
    component take no part, as query or candidate. Ties go to the smaller id, a null id
    after all others. A row is compared with every row but itself: repeated rows are found
    and, as queries, answered one by one (``query_row`` tells them apart, ``rank`` begins at 1).
    Other columns are ignored; an empty table gives an empty result. Vectors so long that
    a score might not fit a long (squared length of 2^62 or more) are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).alias("v")).where(finite_vector(F.col("v")))
    rows = rows.select("vec_id", "asks", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.sqrt(square)))
    n, n_asks, width, size = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x")), F.max("size")).first()
    if (size or 0) ** 2 >= _LONGEST:
        raise ValueError("Vectors are too long: a score might not fit 64 bits.")
    turns = rotations(rows)
    each = lambda most: max(1, most // (8 * max(width or 1, 1)))  # noqa: E731 -- rows in so many bytes
    query_blocks = max(1, math.ceil(n_asks / each(QUERY_BYTES)))
    # several cells for each task, but none of few candidates, as the queries are sent to each
    spread = min(2 * shuffle_width(spark) / query_blocks, n / LEAST_ROWS)
    blocks = max(1, math.ceil(n / each(BLOCK_BYTES)), math.ceil(spread))
    ranged = rows.repartitionByRange(blocks, F.size("x"), F.desc("size"), F.xxhash64("row"))
    candidates = cut(ranged.select(F.spark_partition_id().cast("long").alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "x", "size"))
    queries = rows.where("asks").select(F.pmod(F.xxhash64("row"), F.lit(query_blocks)).alias("query_block"), "asks", "row", "vec_id", "x", "size")
    longest = cut(candidates.groupBy("block").agg(F.max("size").alias("longest")))
    first = candidates.groupBy(F.size("x")).agg(F.min("block").alias("block")).select("block").distinct()
    every_query_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))

    def compared(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = cut(pairs.select("block", "query_block", (F.col("block") * query_blocks + F.col("query_block")).alias("cell")))
        names = ("cell", "asks", "row", "vec_id", "x", "size", "least")
        sent = candidates.join(pairs, "block").withColumn("least", F.lit(None).cast("long")).select(*names).union(asked.join(pairs, "query_block").select(*names))
        return cut(by_cells(sent, n * query_blocks, each(4 * BLOCK_BYTES)).mapInArrow(_cell_batches(k, turns), "query_row long, query_id long, vec_id long, score long"))

    seeds = compared(first.withColumn("query_block", every_query_block), queries.withColumn("least", F.lit(None).cast("long")))
    floors = seeds.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asked = cut(queries.join(floors, "row", "left"))
    need = F.when((F.col("least") > 0) & (F.col("size") > 0), F.col("least") / F.col("size")).otherwise(0.0)
    needs = asked.groupBy("query_block").agg(F.min(need).alias("need"))
    pairs = longest.join(first, "block", "left_anti").withColumn("query_block", every_query_block).join(needs, "query_block").where(F.col("longest") * (1 + SLACK) >= F.col("need"))
    found = seeds.union(compared(pairs, asked))
    by_score = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")
