"""SimHash fingerprints and near-duplicate classes through pivot distance tables.

Each different fingerprint has a distance table: its Hamming distances to reference
fingerprints, computed once and kept. By the triangle inequality two fingerprints within
``LINK_BITS`` bits differ by at most that in every coordinate. The references are

* ``PIVOTS`` fixed random fingerprints, the zero fingerprint, and the 64 unit fingerprints
  ``1 << b``. The distance to a unit is that to zero plus or minus 1, so over a block of
  bits these coordinates agree only where the block does. At most three of five blocks
  differ in a link, so two have equal coordinates: ten candidate lists, each keyed by the
  coordinates of two blocks (25 or 26 bits), hold every link in a shared bucket;
* inside a bucket, rows are ordered by the first random reference's coordinate, and a pair is
  discarded as soon as its largest coordinate difference exceeds ``LINK_BITS``. What
  survives is verified on the fingerprints themselves.

Buckets above ``TILE`` distinct fingerprints are dealt out as pairs of tiles, each pair to
its own cell, and workers take cell after cell, so no task has to hold a bucket or a
partition. Only edges that join what a cell has not joined yet are passed on; classes come
from :mod:`components`. :mod:`near_copies` uses wider fingerprints for larger distances.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_cells, cut, dealt, whole_cells
from .components import connected_components, join_labels

LINK_BITS = 3
WIDTH = 3
PIVOTS = 16
TILE = 8192
#: Rows of a partition of candidates, about.
ROWS = 1 << 20
#: Bits of each block, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles whose bits a worker holds at once, unless one text has more.
_STEP = 1 << 16


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """XXH64 (seed 42) of each ``width``-word shingle of ``text``, A-Z lower-cased; shorter texts are one shingle, empty ones none."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return []
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return [digest(g, 42) for g in grams]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``sizes`` hashes: the bits set in over half of the run; zero for empty runs."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(counts * 2 > sizes[full, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        found, hashes, sizes, held = [], [], [], 0
        for k in range(batch.num_rows):
            own = shingle_hashes(texts[k].as_py())
            sizes.append(len(own))
            hashes += own
            held += len(own)
            if held >= _STEP or k == batch.num_rows - 1:
                found.append(majority(np.array(hashes, np.uint64), np.array(sizes)))
                hashes, sizes, held = [], [], 0
        fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long. Null or wordless texts have fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def references() -> np.ndarray:
    """The reference fingerprints: random ones, zero, units."""
    units = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.concatenate([np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype=np.uint64), np.zeros(1, np.uint64), units])


def distances(fp: np.ndarray) -> np.ndarray:
    """``[fingerprint, reference]``: Hamming distances."""
    return np.bitwise_count(fp[:, None] ^ references()[None, :]).astype(np.uint8)


def candidate_keys(table: np.ndarray) -> np.ndarray:
    """``[fingerprint, list]``: for each two blocks, the coordinates of their units less that of zero as one number, with the list's number above."""
    nearer = table[:, PIVOTS + 1 :] < table[:, PIVOTS, None]
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    edges, keys = np.cumsum([0, *BLOCKS]), []
    for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2)):
        of = np.concatenate([np.arange(edges[a], edges[a + 1]), np.arange(edges[b], edges[b + 1])])
        keys.append((nearer[:, of] * weight[: len(of)]).sum(1, dtype=np.uint64) | np.uint64(k << 32))
    return np.stack(keys, 1)


def _table_batches(batches):
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in distances(fp)], pa.binary())], names=["fp", "distances"])


def _candidate_batches(batches):
    for batch in batches:
        table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        keys = candidate_keys(table)
        lists = keys.shape[1]
        fp = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lists)
        near = [x for r in table for x in [r[:PIVOTS].tobytes()] * lists]
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(fp), pa.array(near, pa.binary())], names=["bucket", "fp", "coords"])


def bucket_links(key: np.ndarray, fp: np.ndarray, coords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each key as all pairs at ``LINK_BITS`` or fewer bits would; ``coords`` has their distances to the random references."""
    order = np.lexsort((fp, coords[:, 0], key))
    key, fp, coords = key[order], fp[order], coords[order].astype(np.int8)
    first = coords[:, 0]
    nodes, at = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    a, b = [], []
    i, step = np.arange(len(fp)), 0
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else i
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    while len(i):
        step += 1
        if step % 8 == 0:  # buckets whose rows all hang together have nothing more to say
            own = label[at]
            open_ = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
            i = i[np.repeat(open_, sizes)[i]]
        i = i[i + step < len(fp)]
        i = i[(key[i + step] == key[i]) & (first[i + step] - first[i] <= LINK_BITS)]
        live = i[at[i] != at[i + step]]
        live = live[label[at[live]] != label[at[live + step]]]
        for k in range(1, coords.shape[1]):
            if not len(live):
                break
            live = live[np.abs(coords[live + step, k] - coords[live, k]) <= LINK_BITS]
        live = live[np.bitwise_count(fp[live] ^ fp[live + step]) <= LINK_BITS]
        if len(live):
            a.append(fp[live])
            b.append(fp[live + step])
            label = join_labels(label, at[live], at[live + step])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _cell_links(batches):
    for t in whole_cells(batches):
        coords = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(t.num_rows, -1)
        a, b = bucket_links(t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64), coords)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: links that join the distinct fingerprints ``nodes(fp)`` as all links would."""
    tables = cut(nodes.select("fp").mapInArrow(_table_batches, "fp long, distances binary"))
    lists = math.comb(len(BLOCKS), 2)
    keyed = tables.mapInArrow(_candidate_batches, "bucket long, fp long, coords binary")
    cells = dealt(keyed, "bucket", "fp", TILE).select("cell", "fp", "coords")
    return by_cells(cells, tables.count() * lists, ROWS).mapInArrow(_cell_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable through links of ``LINK_BITS`` or fewer
    differing bits, the row's own id included. Equal fingerprints (so all empty and null
    texts, of fingerprint zero) are one node. Repeated rows give repeated result rows; a
    row with a null id takes part in linking but never names a component (the component
    is null only if all of its ids are). Other columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    found = cut(fingerprints(docs, id_col, text_col))
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    nodes = cut(nodes)
    roots = connected_components(fingerprint_links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    ids = cut(ids)
    named = cut(named.join(ids, "root").select("fp", "component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")
