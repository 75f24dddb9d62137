"""Classes of near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

:mod:`simhash` links at a few bits, which hold few such pairs: at 64 bits they differ in
about ten. So this takes ``BITS`` bits of the shingles' set, in the same way:

1. Texts with the same shingles are one node, so large groups of exact copies cost nothing further.
2. Each node has a distance table, computed once and kept: the Hamming distances of its
   fingerprint to reference fingerprints (``reference_distances``). Two random fingerprints of
   ``BITS`` bits are about equally far from any whole reference, so such distances exclude nothing
   at ``link_bits``. The references are therefore many and short: each has random bits
   in a segment of ``SEGMENT`` bits, and distances are counted there. By the triangle inequality
   two fingerprints differ in a segment by at least the difference of their coordinates;
   segments share no bits, so the sum of the differences is at most the distance (``reach``).
3. Candidate lists are keyed by the coordinates of some unit references (see :mod:`simhash`:
   they tell bits), drawn at random. A bit of a pair at similarity ``s`` differs with
   probability ``acos(2 s / (1 + s)) / pi`` at most, so the number of lists after which such a
   pair has been in a shared bucket with probability ``RECALL`` is known (``calibrate``). The
   number of units in a key follows the logarithm of the number of nodes, so that buckets stay
   small; the lists so grow with its power 0.24.
4. In a bucket the tables alone are compared. A pair is discarded if the sum of its coordinates'
   differences exceeds ``link_bits``, which no pair to be linked does; a node that is left
   without a partner goes no further. Fingerprints are read only for what survives, and
   pairs within ``link_bits`` are linked.
5. What hangs together is gathered with the hashes of its shingles, in rows of at most
   ``PIECE`` hashes, and compared exactly, large gatherings as pairs of tiles of about ``TILE``
   sets of ``UNIT`` bytes; so neither a row nor a cell grows with the length of texts, but for
   the set of a single text. Only what passes is a link in the result; classes are the
   components of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_cells, cut, dealt, small, tidied, whole_cells
from .components import connected_components, join_labels
from .simhash import majority, shingle_hashes

WIDTH, LEAST, RECALL = 5, 0.8, 0.995
BITS, TILE, CELL = 256, 1024, 4096
#: Bits of a segment; a distance there is 0 to 3, two bits of a kept table.
SEGMENT = 3
#: Hashes of a row; bytes of a set that count as one; rows of such pieces that a worker takes at once, unless a cell has more.
PIECE, UNIT, _PIECES = 1024, 4096, 2048
#: Shingles whose bits a worker holds at once, unless one text has more.
_STEP = 1 << 15
#: Rows of a partition of candidates, about.
ROWS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def calibrate(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int, int]:
    """``(units in a key, lists, link_bits)`` for ``n`` nodes: see the module's text. ``link_bits`` is what all but 1 in 4,000 pairs at ``least`` have."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    units = min(60, max(12, math.ceil(math.log2(max(n, 2))) + 3))
    lists = math.ceil(math.log(1 - recall) / math.log1p(-((1 - p) ** units)))
    return units, lists, math.floor(BITS * p + 3.5 * math.sqrt(BITS * p * (1 - p)))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of ``text``, ascending."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """``[set, word]``: the fingerprints, ``BITS`` bits each; zero for an empty set."""
    hashes, sizes = np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    out = []
    for k in range(BITS // 64):
        h = (hashes ^ (hashes >> np.uint64(31))) * np.array([(int(_MIX) + 2 * k) % (1 << 64)], np.uint64)
        out.append(majority((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), sizes))
    return np.stack(out, 1)


def set_name(own: np.ndarray) -> int:
    """The name of a set of hashes, as a signed number; equal sets have equal names."""
    name = xxhash.xxh64_intdigest(own.tobytes(), 42)
    return name - (1 << 64) if name >> 63 else name


def reference_distances(prints: np.ndarray) -> np.ndarray:
    """``[fingerprint, segment]``: Hamming distances to the reference of each segment of ``SEGMENT`` bits, the last maybe shorter."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    return np.add.reduceat(bits ^ np.random.default_rng(BITS).integers(0, 2, BITS, dtype=np.uint8), np.arange(0, BITS, SEGMENT), axis=1)


def packed(table: np.ndarray) -> np.ndarray:
    """``table``, four distances in a byte."""
    full = np.zeros((len(table), -(-table.shape[1] // 4) * 4), np.uint8)
    full[:, : table.shape[1]] = table
    return (full.reshape(len(full), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(2, dtype=np.uint8)


def unpacked(rows: np.ndarray) -> np.ndarray:
    """The table that :func:`packed` made ``rows`` of, with zeros after it."""
    return (rows[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(rows), -1).astype(np.int8)


def reach(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which the fingerprints of rows ``i`` and ``j`` differ at least."""
    return np.abs(table[i] - table[j]).sum(1, dtype=np.int16)


def _node_batches(batches):
    """``(key, node, print)`` of each text."""
    for batch in batches:
        texts = batch.column(1)
        nodes, found, sets, held = [], [], [], 0
        for k in range(batch.num_rows):
            own = shingle_set(texts[k].as_py())
            nodes.append(set_name(own))
            sets.append(own)
            held += len(own)
            if held >= _STEP or k == batch.num_rows - 1:
                found += [r.tobytes() for r in wide_fingerprints(sets)]
                sets, held = [], 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["key", "node", "print"])


def _prints(column) -> np.ndarray:
    """``[row, word]``: the fingerprints of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _table_batches(batches):
    """The columns of each node, the fingerprint last, and its distance table."""
    for batch in batches:
        table = packed(reference_distances(_prints(batch.column(batch.num_columns - 1))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in table], pa.binary())], names=[*batch.schema.names, "distances"])


def candidate_keys(prints: np.ndarray, units: int, lists: int) -> np.ndarray:
    """``[fingerprint, list]``: the bits of each list's units as one number, mixed with the list's number."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(len(prints), -1), axis=1)
    rng = np.random.default_rng([80, units])
    out = np.empty((len(prints), lists), np.uint64)
    weight = np.uint64(1) << np.arange(units, dtype=np.uint64)
    for k in range(lists):
        own = bits[:, rng.choice(BITS, units, replace=False)] @ weight
        out[:, k] = (own ^ np.uint64((k + 1) * int(_MIX) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def _key_batches(units: int, lists: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                keys = candidate_keys(_prints(part.column(1)), units, lists)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), lists)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], names=["cell", "node"])

    return run


def _company(batches):
    """The rows whose cell has another row."""
    for t in whole_cells(batches):
        cell = t.column(0).to_numpy()
        next_same = cell[1:] == cell[:-1]
        some = np.concatenate([next_same, [False]]) | np.concatenate([[False], next_same])
        if some.any():
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()


def _within_reach(link_bits: int):
    """The rows that the distance tables leave with a partner in their cell."""

    def run(batches):
        for t in whole_cells(batches):
            cell, rows = t.column(0).to_numpy(), t.column(2).to_pylist()
            table = unpacked(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1))
            left = np.zeros(len(cell), bool)
            i, step = np.arange(len(cell)), 0
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(cell)]]))
            while len(i):
                step += 1
                if step % 8 == 0:  # cells of which every row is left have nothing more to say
                    i = i[np.repeat(~np.logical_and.reduceat(left, starts), sizes)[i]]
                i = i[i + step < len(cell)]
                i = i[cell[i + step] == cell[i]]
                live = i[~(left[i] & left[i + step])]
                live = live[reach(table, live, live + step) <= link_bits]
                left[live] = left[live + step] = True
            if left.any():
                yield from t.select([0, 1]).filter(pa.array(left)).combine_chunks().to_batches()

    return run


def _print_links(link_bits: int):
    def run(batches):
        for t in whole_cells(batches):
            cell, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            prints = _prints(t.column(2))
            nodes, at = np.unique(node, return_inverse=True)
            label, a, b = np.arange(len(nodes)), [], []
            i, step = np.arange(len(cell)), 0
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(cell)]]))
            while len(i):
                step += 1
                if step % 8 == 0:  # cells whose rows all hang together have nothing more to say
                    own = label[at]
                    open_ = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
                    i = i[np.repeat(open_, sizes)[i]]
                i = i[i + step < len(cell)]
                i = i[cell[i + step] == cell[i]]
                live = i[label[at[i]] != label[at[i + step]]]
                live = live[np.bitwise_count(prints[live] ^ prints[live + step]).sum(1, dtype=np.int64) <= link_bits]
                if len(live):
                    a.append(node[live])
                    b.append(node[live + step])
                    label = join_labels(label, at[live], at[live + step])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def set_links(sets: list[np.ndarray], least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets whose links join them as all pairs of a Jaccard similarity of at least ``least`` would."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(np.bincount(of))])
    posted = owner[np.argsort(of, kind="stable")]
    at = np.concatenate([[0], np.cumsum(size)])
    label, place = np.arange(n), np.arange(n)
    a, b = [], []
    for i in range(n - 1):
        live = (place > i) & (label != label[i]) & (size >= least * size[i] - 1e-9) & (size[i] >= least * size - 1e-9)
        if not live.any():
            continue
        mine = of[at[i] : at[i + 1]]
        long = begin[mine + 1] - begin[mine]
        take = np.repeat(begin[mine], long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        both = np.bincount(posted[take], minlength=n)
        hit = np.flatnonzero(live & (both * (1 + least) >= least * (size + size[i]) - 1e-9))
        if len(hit):
            a.append(np.full(len(hit), i))
            b.append(hit)
            label = join_labels(label, a[-1], hit)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _piece_batches(batches):
    """``(node, root, part, units, piece)`` of ``(root, text)``: each text's distinct shingle hashes as rows of ``PIECE`` hashes, an empty one for none."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary())
    for batch in batches:
        rows, held = [], 0
        for k, (root, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            own = shingle_set(text.as_py())
            node = set_name(own)
            for part, start in enumerate(range(0, max(len(own), 1), PIECE)):
                piece = own[start : start + PIECE].tobytes()
                rows.append((node, root, part, max(0.0 if part else 1.0, len(piece) / UNIT), piece))
                held += len(piece)
            if held > 1 << 22 or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "root", "part", "units", "piece"])
                rows, held = [], 0


def _cell_links(batches):
    """The links of each cell, whose rows come sorted by cell and node."""
    for t in whole_cells(batches, _PIECES):
        cell, node, pieces = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
        first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])]))  # of each set
        ends = [*first.tolist(), len(cell)]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(cell[first]) != 0])).tolist()  # of each cell, among sets
        for i, j in zip(starts, [*starts[1:], len(first)], strict=True):
            if j - i > 1:
                sets = [np.frombuffer(b"".join(p.as_py() for p in pieces[ends[k] : ends[k + 1]]), np.uint64) for k in range(i, j)]
                a, b = set_links(sets)
                own = node[first[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])


def near_copies(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``(*keep, component, alone)`` for each row of ``docs``; only the text is looked at.

    Rows are near copies if they have the same component, which is not an id: a hash, never
    null; ``alone`` are those without any. Texts of fewer than five words are one shingle;
    all null texts and those without words are one class. Repeated rows give repeated result rows; ids,
    whether null or repeated, play no part. An empty table gives an empty result.
    """
    # a text has a key, so that its shingles needn't be hashed again to find what is known of it
    text = F.col(text_col).cast("string")
    key = F.xxhash64(text, F.lit("text")).alias("__key")
    texts = docs.select(key, text.alias("__text"))
    named = texts.mapInArrow(tidied(_node_batches), "key long, node long, print binary")
    named = cut(named.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.min("print").alias("print")))
    nodes = named.groupBy("node").agg(F.min("key").alias("key"), F.sum("copies").alias("copies"), F.min("print").alias("print"))
    nodes = cut(nodes.mapInArrow(tidied(_table_batches), "node long, key long, copies long, print binary, distances binary"))
    n = nodes.count()
    units, lists, link_bits = calibrate(n)
    keyed = by_cells(nodes.select("node", "print").mapInArrow(tidied(_key_batches(units, lists)), "cell long, node long"), n * lists, ROWS)
    shared = cut(keyed.mapInArrow(tidied(_company), "cell long, node long").withColumnRenamed("cell", "key"), shuffles_go=True)
    cells = dealt(shared, "key", "node", CELL).select("cell", "node").join(nodes, "node").select("cell", "node", "distances")
    left = cut(by_cells(cells, shared.count(), ROWS).mapInArrow(tidied(_within_reach(link_bits)), "cell long, node long"), shuffles_go=True)
    cells = left.join(nodes, "node").select("cell", "node", "print")
    candidates = by_cells(cells, left.count(), ROWS).mapInArrow(tidied(_print_links(link_bits)), "a long, b long")
    # settled first: a task that finds links and joins them at once would hold two Python workers
    gathered = connected_components(cut(candidates, shuffles_go=True))
    # the roots themselves aren't listed
    gathered = cut(gathered.union(gathered.select("root", "root").distinct()).join(nodes, "node").select("key", "root"))
    # only texts of what is gathered are hashed again, of each node one; copies of it have equal pieces, of which one stays
    pieces = texts.join(small(gathered), F.col("__key") == F.col("key")).select("root", "__text")
    pieces = pieces.mapInArrow(tidied(_piece_batches), "node long, root long, part int, units double, piece binary")
    pieces = cut(pieces.groupBy("node", "part").agg(F.min("root").alias("root"), F.min("units").alias("units"), F.min("piece").alias("piece")), shuffles_go=True)
    cells = dealt(pieces, "root", "node", TILE, F.col("units")).select("cell", "node", "piece")
    links = cut(by_cells(cells, pieces.count(), ROWS // PIECE, "node").mapInArrow(tidied(_cell_links), "a long, b long"), shuffles_go=True)
    classes = connected_components(links)
    classes = cut(classes.union(classes.select("root", "root").distinct()))
    # texts of which there are several rows, or near copies
    several = nodes.select("node", "copies").join(classes, "node", "left").where("copies > 1 or root is not null")
    several = cut(several.select("node", F.coalesce("root", "node").alias("class")))
    several = cut(named.select("key", "node").join(several, "node").select("key", "class"))
    rows = docs.select(*keep, key).join(small(several), F.col("__key") == F.col("key"), "left")
    return rows.select(*keep, F.coalesce("class", "__key").alias("component"), F.col("class").isNull().alias("alone"))
