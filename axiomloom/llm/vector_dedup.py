"""Near-duplicate vectors by collision-counting projections.

Vectors of one label and length are projected on many random directions. Directions are
taken in tables of ``depth + 1``: ``depth`` of them, cut into slabs of ``SLAB``, name a
block; along the last one the block is sorted, and each vector looks at the window of
``WINDOW`` around itself. Two vectors collide in a table if they share its block and lie
in each other's window. Pairs that collide in a calibrated number of tables are verified
by their cosine. ``depth`` follows the logarithm of the number of vectors, so that a block
stays small; the number of tables is the least for which a pair right at the threshold
reaches the required count with probability ``RECALL``.

No pair is written out. A pair belongs to the table in which it reaches the required
count; there each side's links are counted, and edges that join what isn't joined yet
are passed on for the classes. Equal vectors are one node that knows how many it stands for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_cells, cut, dealt, whole_cells
from .components import connected_components, join_labels

COSINE, RECALL, COUNT = 0.98, 0.99, 2
SLAB, WINDOW, TILE, SEED = 1.2, 0.6, 4096, 10
#: Vectors of one label for each block, at most about.
BLOCK = 64
#: Rows of a partition of cells, about; rows that a worker takes at once, unless one cell has more.
ROWS, _CELL_ROWS = 1 << 17, 1 << 15
_CHUNK = 1 << 17


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def slab_chance(distance: float) -> float:
    """Probability that two points at ``distance`` fall in one slab of ``SLAB`` of a random projection."""
    r = SLAB / distance
    return 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def calibrate(n: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """``(depth, tables, chance)`` for ``n`` vectors: see the module's text; ``chance`` is that of a collision in one table at the threshold."""
    far, near = math.sqrt(2), math.sqrt(2 - 2 * cosine)
    depth = max(1, math.ceil(math.log(max(n / BLOCK, 2)) / -math.log(slab_chance(far))))
    p = slab_chance(near) ** depth * (2 * _normal(WINDOW / near) - 1)
    tables = COUNT
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COUNT)) > 1 - RECALL:
        tables += 1
    return depth, tables, p


class Projections:
    """The blocks and window places of vectors in every table."""

    def __init__(self, width: int, depth: int, tables: int):
        rng = np.random.default_rng([SEED, width])
        self.lines = rng.standard_normal((width, tables * (depth + 1)))
        self.shift = rng.random((tables, depth)) * SLAB
        self.odd = rng.integers(0, 1 << 62, (tables, depth), dtype=np.int64) * 2 + 1
        self.depth, self.tables = depth, tables

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(blocks, places)``, both [vector, table]."""
        z = (unit @ self.lines).reshape(len(unit), self.tables, self.depth + 1)
        cells = np.floor((z[:, :, : self.depth] + self.shift) / SLAB).astype(np.int64)
        return (cells * self.odd).sum(2), z[:, :, self.depth]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _key_batches(depth: int, tables: int):
    def run(batches):
        made: dict[int, Projections] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                widths = np.array(part.column(1).value_lengths().to_pylist())
                for width in np.unique(widths).tolist():
                    own = part.filter(pa.array(widths == width))
                    x = _matrix(own.column(1))
                    made.setdefault(width, Projections(width, depth, tables))
                    blocks, _ = made[width](x / np.linalg.norm(x, axis=1, keepdims=True))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(list(blocks), pa.list_(pa.int64()))], names=[*own.schema.names, "blocks"])

    return run


def _pair_batches(depth: int, tables: int, cosine: float):
    """Of each cell, the links of each node and joining edges: rows ``(a, b, n)`` with ``b`` null for counts."""

    def run(batches):
        for t in whole_cells(batches, _CELL_ROWS):
            widths = np.array(t.column("vector").combine_chunks().value_lengths().to_pylist())
            for width in np.unique(widths).tolist():
                own = t.filter(pa.array(widths == width))
                yield from links(*(own.column(k).to_numpy() for k in ("cell", "table", "side", "whole", "node")), _matrix(own.column("vector")), own.column("many").to_numpy(), own.column("code").to_numpy())

    def links(cell, table, side, whole, node, x, many, code):
        norm = np.linalg.norm(x, axis=1)
        # a node is here once for each of its cells: project it once
        _, at, of = np.unique(node, return_index=True, return_inverse=True)
        blocks, places = Projections(x.shape[1], depth, tables)(x[at] / norm[at, None])
        order = np.lexsort((node, places[of, table], cell))
        cell, table, side, whole, of = cell[order], table[order], side[order], whole[order], of[order]
        place = places[of, table]
        x, norm, many, node, code = x[at], norm[at], many[at], node[at], code[at]
        links_of, label = np.zeros(len(node), np.int64), np.arange(len(node))
        a, b = [], []
        i, step = np.arange(len(cell)), 0
        while len(i):
            step += 1
            i = i[i + step < len(cell)]
            i = i[(cell[i + step] == cell[i]) & (place[i + step] - place[i] <= WINDOW)]
            live = i[whole[i] | (side[i] != side[i + step])]
            for start in range(0, len(live), _CHUNK):
                s = live[start : start + _CHUNK]
                p, q, own = of[s], of[s + step], table[s]
                hits = ((blocks[p] == blocks[q]) & (np.abs(places[p] - places[q]) <= WINDOW)).cumsum(1)
                k = np.arange(len(s))
                good = np.flatnonzero((hits[k, own] == COUNT) & (np.where(own > 0, hits[k, np.maximum(own - 1, 0)], 0) == COUNT - 1))
                p, q = p[good], q[good]
                near = (np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine) & (code[p] == code[q])
                p, q = p[near], q[near]
                links_of += np.bincount(p, many[q], minlength=len(node)).astype(np.int64) + np.bincount(q, many[p], minlength=len(node)).astype(np.int64)
                new = label[p] != label[q]
                if new.any():
                    a.append(node[p[new]])
                    b.append(node[q[new]])
                    label = join_labels(label, p[new], q[new])
        some = np.flatnonzero(links_of)
        ends = [np.concatenate([node[some], *a]), np.concatenate([np.zeros(len(some), np.int64), *b]), np.concatenate([links_of[some], *(np.zeros(len(e), np.int64) for e in a)])]
        absent = np.arange(len(ends[0])) < len(some)
        yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1], mask=absent), pa.array(ends[2])], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Rows are compared only within one label and one length of vector. Rows with a null
    label or vector, a null or non-finite component, or norm zero link with nothing: they
    are their own component. ``n_links`` counts the other rows linked directly, repeated
    rows each; ``component_id`` is the smallest id reachable. A null id takes part but names
    no component (null only if all ids are) and isn't kept. An empty table gives an empty
    result.
    """
    # the components as they are: four bytes each where the table has floats; sums and cosines are in double precision
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"), F.col(label_col).alias("label"))
    fine = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine)
    zero = F.lit(0.0).cast(kind[6:-1])
    valid = rows.where("fine").withColumn("vector", F.transform("vector", lambda x: x + zero))  # -0.0 is 0.0
    nodes = valid.groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("many")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes)
    labels = cut(nodes.groupBy("label").agg(F.count("*").alias("size")).withColumn("code", F.monotonically_increasing_id()))
    depth, tables, _ = calibrate(labels.agg(F.max("size")).first()[0] or 0, cosine)
    few = labels.count() <= 10_000  # so few labels can be broadcast
    coded = nodes.join(F.broadcast(labels) if few else labels, "label").select("node", "vector", "many", "code")
    keyed = coded.mapInArrow(_key_batches(depth, tables), f"node long, vector {kind}, many long, code long, blocks array<long>")
    keyed = keyed.select("node", "vector", "many", "code", F.posexplode("blocks").alias("table", "block"))
    keyed = keyed.withColumn("bucket", F.xxhash64("code", F.size("vector"), "table", "block")).drop("block")
    cells = dealt(keyed, "bucket", "node", TILE).select("cell", F.col("table").cast("long"), "side", "whole", "node", "vector", "many", "code")
    found = cut(by_cells(cells, nodes.count() * tables, ROWS).mapInArrow(_pair_batches(depth, tables, cosine), "a long, b long, n long"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    known = nodes.select("node", "least_id", "many").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known.join(counts, F.col("node") == F.col("a"), "left").select("node", "least_id", "many", "root", F.coalesce("others", F.lit(0)).alias("others")))
    least = cut(known.groupBy("root").agg(F.min("least_id").alias("component_id")))
    known = cut(known.join(least, "root").select("node", (F.col("many") - 1 + F.col("others")).alias("links"), "component_id"))
    known = known.join(nodes.select("node", "label", "vector"), "node").drop("node")
    single = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = valid.select("vec_id", "label", "vector").join(known, ["label", "vector"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    both = linked.union(single)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
