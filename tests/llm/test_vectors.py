"""Top inner products, vector codes and whitening against plain versions, on the small table and on rows made to be awkward."""

import hashlib

import duckdb
import numpy as np
import pytest

from axiomloom.llm import codebooks, queries, topk, whitening

KIND = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def table(sf_dir):
    return duckdb.connect().execute(f"select vec_id, embedding, label from '{sf_dir}/embeddings.parquet' order by vec_id").fetchall()


def fine(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]


def odd_rows(rng, n=300, width=16, copies=90):
    """Hot copies, ties, repeated rows and ids, null ids and labels, vectors that take no part."""
    x = np.round(rng.normal(size=(n, width)) * rng.choice([0.2, 1, 3], size=(n, 1)), 2)
    x[:copies] = x[0]
    x[copies : copies + 5] = 0.0
    rows = [(int(i), x[i].tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [rows[50], rows[100], (50, x[200].tolist(), 1), (None, x[0].tolist(), None), (None, x[5].tolist(), 2)]
    bad = [float("nan")] + [0.0] * (width - 1)
    return rows + [(1000, None, 1), (1050, bad, 1), (1100, [None] + bad[1:], 2), (1150, [float("-inf")] + bad[1:], None)]


def plain_top(rows, k=5, every=50, scale=256):
    rows = [(i, np.floor(np.array(v, float) * scale).astype(int)) for i, v, _ in fine(rows)]
    out = []
    for a, (i, q) in enumerate(rows):
        if i is not None and i % every == 0:
            scored = sorted((-int(q @ x), j is None, j or 0) for b, (j, x) in enumerate(rows) if a != b and len(x) == len(q))
            out += [(i, n, None if absent else j, -s) for n, (s, absent, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    rows = sorted(fine(rows), key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[1], float) * scale).tolist()))
    x = np.floor(np.array([r[1] for r in rows], float) * scale).astype(np.int64)
    books = [p.copy() for p in np.split(x[:entries], parts, axis=1)]

    def nearest():
        d = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(np.split(x, parts, axis=1), books)]
        return np.stack([m.argmin(1) for m in d], 1), sum(m.min(1) for m in d)

    for _ in range(rounds):
        code, _ = nearest()
        for p, (part, book) in enumerate(zip(np.split(x, parts, axis=1), books)):
            for e in range(len(book)):
                if (own := part[code[:, p] == e]).size:
                    book[e] = [int(s) // len(own) for s in own.sum(0)]
    code, error = nearest()
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], bytes(c.astype(np.uint8)).hex(), int(e), by[r[2]], digest) for r, c, e in zip(rows, code, error)), key=str)


def plain_whitening(rows, components=16):
    """``n, deviations, explained, whitened`` by a full eigendecomposition."""
    x = np.floor(np.array([r[1] for r in fine(rows)], float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (n * fit - sums) / n
    v, u = np.linalg.eigh(c.T @ c / n)
    v, u = v[::-1][:components], u[:, ::-1][:, :components]
    return n, [sum(int(k) ** 2 for k in n * r - sums) for r in x], v / (c**2).sum() * n, ((n * x - sums) / n) @ u / np.sqrt(v)


def tuples(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def top(spark, rows, **options):
    vectors = spark.createDataFrame(rows, KIND)
    return tuples(topk.top_products(vectors, vectors["vec_id"] % 50 == 0, **options).select("query_id", "rank", "vec_id", "score"))


def codes(spark, rows):
    found = codebooks.coded(spark.createDataFrame(rows, KIND))
    return sorted(((r["vec_id"], bytes(r["code"]).hex(), r["error"], int(r["label_error"]), r["codebooks_sha256"]) for r in found.collect()), key=str)


def test_top_products_of_the_table(spark, sf_dir, table):
    assert tuples(queries.op11_exact_top_products(spark, sf_dir)) == plain_top(table)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_products_of_odd_rows(spark, seed):
    rows = odd_rows(np.random.default_rng(seed))
    rows += [(5000, [1.0, 2.0], 1), (5001, [2.0, 1.0], 1), (5050, [], 1), (5051, [], 1)]  # other lengths meet their like only
    assert top(spark, rows) == plain_top(rows)


def test_top_products_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 40 * 8 * 16)
    monkeypatch.setattr(topk, "QUERY_BYTES", 3 * 8 * 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=16) * rng.lognormal(0, 1.5)).tolist(), 0) for i in range(600)]
    assert top(spark, rows) == plain_top(rows)


def test_pruning_leaves_most_out():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 32)) * np.linspace(3, 0.1, 32) * 256).astype(np.int64)
    x = x[np.argsort(-(x**2).sum(1))]
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    c = topk.Comparison(x[:20], np.arange(20), np.full(20, -np.inf), 5, turn)
    scored = []
    own = c._survivors
    c._survivors = lambda *a: scored.append(len((out := own(*a))[0])) or out
    for s in range(0, 3000, 500):
        if not c.add(x[s : s + 500], np.arange(s, s + 500), np.arange(s, s + 500), np.zeros(500, np.int64)):
            break
    assert sum(scored[1:]) < 0.1 * 20 * 2500
    exact = x[:20] @ x.T
    exact[np.arange(20), np.arange(20)] = -(1 << 60)
    assert np.sort(c.best[1].reshape(20, 5), axis=1).tolist() == np.sort(exact, axis=1)[:, -5:].tolist()


def test_too_long_vectors_are_an_error(spark):
    with pytest.raises(ValueError, match="too long"):
        top(spark, [(0, [1e9, 0.0], 1), (50, [1.0, 1.0], 1)])


def test_codes_of_the_table(spark, sf_dir, table):
    assert tuples(queries.op12_vector_codes(spark, sf_dir).select("vec_id", "code", "error", "label_error", "codebooks_sha256")) == plain_codes(table)


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_of_odd_rows(spark, seed):
    rows = odd_rows(np.random.default_rng(seed), width=32)
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, rows[:5]) == plain_codes(rows[:5])


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(5)
    # few different components, so that ties are common
    x = rng.integers(-6, 7, (4000, 4))
    book = x[:64].copy()
    group = codebooks.entry_groups(book)
    code, near, bound, all_of_them = codebooks.assign(x, book, group, None, None, None)
    for _ in range(4):
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (near == d.min(1)).all()
        after = np.array([x[code == e].sum(0) // (code == e).sum() if (code == e).any() else book[e] for e in range(64)])
        drift = codebooks.moved([book], [after], [group])[0]
        book = after
        code, near, bound, looked = codebooks.assign(x, book, group, code, codebooks._down(bound).astype(float), drift)
    assert looked < all_of_them


def test_codes_need_parts_of_one_length(spark):
    with pytest.raises(ValueError, match="multiple of 16"):
        codes(spark, [(0, [1.0] * 17, 1)])
    with pytest.raises(ValueError, match="too large"):
        codes(spark, [(0, [1e12] * 16, 1)])


def check_whitening(got, rows, want):
    n, deviations, explained, whitened = want
    kept = fine(rows)
    assert len(got) == len(kept) and {r["n"] for r in got} == {n}
    key = lambda i, d: (i is None, i or 0, d)
    got = sorted(got, key=lambda r: key(r["vec_id"], int(r["deviation"])))
    order = sorted(range(len(kept)), key=lambda k: key(kept[k][0], deviations[k]))
    assert [(r["vec_id"], int(r["deviation"])) for r in got] == [(kept[k][0], deviations[k]) for k in order]
    w = np.array([r["whitened"] for r in got])
    assert np.array(got[0]["explained"]) == pytest.approx(explained, rel=1e-9) and got[0]["identity_error"] < 1e-9
    assert np.abs(np.abs(w) - np.abs(whitened[order])).max() < 1e-6
    for c in range(w.shape[1]):  # one sign for all rows
        assert np.abs(w[:, c] - whitened[order][:, c]).max() < 1e-6 or np.abs(w[:, c] + whitened[order][:, c]).max() < 1e-6


def test_whitening_of_the_table(spark, sf_dir, table):
    check_whitening(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).collect(), table, plain_whitening(table))
    rows = queries.op13_embedding_whitening(spark, sf_dir).collect()
    assert len(rows) == 16 * len(table) and {r["component"] for r in rows} == set(range(1, 17)) and max(r["identity_error"] for r in rows) < 1e-4


def test_whitening_of_odd_rows(spark):
    rows = odd_rows(np.random.default_rng(6), width=24)
    check_whitening(whitening.whiten(spark.createDataFrame(rows, KIND)).collect(), rows, plain_whitening(rows))


def test_whitening_without_spread(spark):
    rows = [(1, [0.5] * 4, 1), (2, [0.5] * 4, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got] == [(1, 0, [], [])] * 2
    line = [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)]  # one direction only: Lanczos breaks down and restarts
    got = whitening.whiten(spark.createDataFrame(line, KIND)).collect()
    assert all(len(r["whitened"]) == 1 and r["explained"] == pytest.approx([1.0]) for r in got)


def test_lanczos_restarts_find_repeated_eigenvalues():
    rng = np.random.default_rng(7)
    values = np.array([9.0] * 5 + [4.0] * 3 + [1.0] * 12 + [0.0] * 40)
    u = np.linalg.qr(rng.normal(size=(60, 60)))[0]
    matrix = (u * values) @ u.T
    passes = []
    found, vectors = whitening.block_lanczos(lambda b: passes.append(b.shape) or matrix @ b, 60, 10, spare=0)
    assert found == pytest.approx(values[:10], abs=1e-9) and np.abs(matrix @ vectors - vectors * found).max() < 1e-9
    big = np.diag(np.concatenate([[50.0, 40.0, 30.0], np.linspace(1, 0, 997)]))
    passes.clear()
    found, _ = whitening.block_lanczos(lambda b: passes.append(b.shape) or big @ b, 1000, 3)
    assert found == pytest.approx([50.0, 40.0, 30.0]) and len(passes) < 40


def test_vectors_of_empty_tables_and_extra_columns(spark):
    none = spark.createDataFrame([], KIND)
    assert top(spark, []) == [] and codes(spark, []) == [] and whitening.whiten(none).collect() == []
    rows = [r for r in odd_rows(np.random.default_rng(8), n=220) if r[0] is None or r[0] < 1000]
    clashing = "row long, x string, size int, block int, cell int, least long, code string, error int, bounds string, place int, values string, deviation int"
    extra = [(*r, 1, "a", 2, 3, 4, 5, "b", 6, "c", 7, "d", 8) for r in rows]
    wide = spark.createDataFrame(extra, f"{KIND}, {clashing}")
    assert tuples(topk.top_products(wide, wide["vec_id"] % 50 == 0).select("query_id", "rank", "vec_id", "score")) == plain_top(rows)
    assert sorted(((r["vec_id"], bytes(r["code"]).hex()) for r in codebooks.coded(wide).collect()), key=str) == sorted([r[:2] for r in plain_codes(rows)], key=str)
    check_whitening(whitening.whiten(wide).collect(), rows, plain_whitening(rows))
