"""Near copies of the pipeline: five-word shingles and a Jaccard similarity of at least 0.8, against all pairs."""

import os
import sys

import corpus_pipeline
import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from axiomloom.llm import near_copies  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    return corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()


def edited(rng, words, changes):
    out = list(words)
    for k in rng.choice(len(out), changes, replace=False):
        out[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


def test_edited_copies(spark):
    """Copies with edits, on both sides of the limit: as all pairs give them, whole groups dealt as tiles too."""
    rng = np.random.default_rng(8)
    texts = ["", None, "one two", "one two three"]
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(40, 300))]
        texts += [" ".join(words)] + [edited(rng, words, int(n)) for n in rng.integers(0, max(2, len(words) // 30), 12)]
    texts += ["a common line of seven words here " + " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want = {c for c in brute.components(list(range(len(texts))), brute.near_pairs(texts))}
    assert 60 < len(want) < len(texts) - 20
    for tile in (near_copies.TILE, 5):
        old, near_copies.TILE = near_copies.TILE, tile
        try:
            assert sorted(r.doc_id for r in kept(spark, rows)) == sorted(want)
        finally:
            near_copies.TILE = old


def test_recall(spark):
    """Pairs right at the limit: nearly all are found, by the number of lists that the calibration gives for as many nodes."""
    rng = np.random.default_rng(81)
    rows, n = [], 400
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 225)]
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(words[:25] + [f"v{k}x{x}" for x in range(25)] + words[25:] if k % 2 else words[22:] + [f"v{k}x{x}" for x in range(22)]), "en", "s", 1)]
    near = {i // 2 for i, _ in brute_by_pairs(rows)}
    kept_ids = {r.doc_id for r in kept(spark, rows)}
    assert len(near) > 300 and sum(2 * k + 1 not in kept_ids for k in near) >= 0.99 * len(near)
    assert all(2 * k + 1 in kept_ids for k in set(range(n)) - near)


def brute_by_pairs(rows):
    """The near pairs among rows 2k and 2k + 1."""
    return [(2 * k, 2 * k + 1) for k in range(len(rows) // 2) if brute.near_pairs([rows[2 * k][1], rows[2 * k + 1][1]])]


def test_table(spark, sf_dir):
    rows = sorted(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()))
    comps = brute.components([r[0] for r in rows], brute.near_pairs([r[1] for r in rows]))
    assert sorted(map(tuple, kept(spark, rows))) == [r for r, c in zip(rows, comps, strict=True) if r[0] == c]
    assert kept(spark, []) == []


def test_reference_distances():
    """Distance tables discard no pair within reach, nearly all others, and come back from their bytes."""
    rng = np.random.default_rng(82)
    far = rng.integers(0, 1 << 64, (4000, near_copies.BITS // 64), dtype=np.uint64)
    flips = np.zeros((2000, near_copies.BITS), np.uint8)
    for row, k in zip(flips, rng.integers(0, 80, 2000), strict=True):
        row[rng.choice(near_copies.BITS, k, replace=False)] = 1
    prints = np.concatenate([far, far[:2000] ^ np.packbits(flips, axis=1).view(np.uint64)])
    table = near_copies.reference_distances(prints)
    kept = near_copies.unpacked(near_copies.packed(table))
    assert (kept[:, : table.shape[1]] == table).all() and not kept[:, table.shape[1] :].any()
    link_bits = near_copies.calibrate(len(prints))[2]
    near, i = near_copies.reach(kept, np.arange(2000), np.arange(4000, 6000)), np.arange(0, 4000, 2)
    assert (near <= np.bitwise_count(prints[:2000] ^ prints[4000:]).sum(1)).all()
    assert (near_copies.reach(kept, i, i + 1) > link_bits).mean() > 0.98


def test_tables_discard():
    """A cell's rows go on exactly if their tables leave them a partner in it."""
    import pyarrow as pa

    rng = np.random.default_rng(83)
    prints = rng.integers(0, 1 << 64, (300, near_copies.BITS // 64), dtype=np.uint64)
    prints[1::10] = prints[::10] ^ rng.integers(0, 1 << 20, (30, 1), dtype=np.uint64)
    rows = [r.tobytes() for r in near_copies.packed(near_copies.reference_distances(prints))]
    cell = np.repeat(np.arange(15), 20)
    batch = pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.arange(300)), pa.array(rows, pa.binary())], names=["cell", "node", "distances"])
    got = [r["node"] for b in near_copies._within_reach(58)([batch]) for r in b.to_pylist()]
    table = near_copies.reference_distances(prints).astype(int)
    want = [i for i in range(300) if any(i != j and cell[i] == cell[j] and np.abs(table[i] - table[j]).sum() <= 58 for j in range(300))]
    assert got == want and set(range(0, 300, 10)) <= set(want) and len(want) < 150
