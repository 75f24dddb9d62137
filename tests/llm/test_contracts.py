"""The registered queries against brute force over the small tables."""

import base64
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from axiomloom.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def docs(sf_dir):
    return duckdb.connect().execute(f"select doc_id, text, lang, source from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def run(spark, sf_dir, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def by_id(rows, key="doc_id"):
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_repeats(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op1_suffix_array_dedup"))
    want = brute.repeats([(i, t) for i, t, *_ in docs])
    assert sum(w[2] for w in want) > 0
    for w in want:
        r = got[w[0]]
        assert (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w


def test_mixing(spark, sf_dir, docs):
    rows = run(spark, sf_dir, "op2_source_mixing")
    got = by_id(rows)
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    per = {}
    for i, _, _, s in docs:
        per[s] = per.get(s, 0) + size[i]
    want, taken, largest = brute.targets(per), {}, {}
    for i, _, _, s in docs:
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == per[s] and r["taken"] == r["copies"] * size[i] and 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), size[i])
    for s in per:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = by_id(run(spark, sf_dir, "op2_source_mixing"))
    assert again == got


def test_bpe(spark, sf_dir, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(run(spark, sf_dir, "op3_byte_bpe"))
    for i, t, *_ in docs:
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))


def test_simhash(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op4_simhash_near_dedup"))
    fps = [brute.simhash(t) for _, t, *_ in docs]
    want = brute.components([i for i, *_ in docs], brute.near_fingerprints(fps))
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i, *_ in docs] == [(f"{f:016x}", c) for f, c in zip(fps, want, strict=True)]


def test_personal_data(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op5_personal_data"))
    for i, t, *_ in docs:
        want = brute.personal(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == brute.sha(brute.listed(want))
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}


def test_language(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op6_language_id"))
    held = [(got[i]["lang_pred"] == lang) for i, _, lang, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.97
    for i, *_ in docs:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1


def test_fingerprints(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op7_document_fingerprints"))
    seen, edited, other = {}, [], []
    for k, (i, t, *_) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        h = len(t) // 2
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == brute.sha(t[: len(t) - h] + nxt[:h])
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        edited.append(r["near_edited"])
        other.append(r["near_next"])
    assert np.median(edited) > 0.4 and np.median(other) < 0.05


def test_quality(spark, sf_dir):
    con = duckdb.connect()
    labels = con.execute(f"select doc_id, quality, toxic from '{sf_dir}/labels.parquet'").fetchall()
    got = by_id(run(spark, sf_dir, "op8_ordinal_quality"))
    good = [got[i]["expected_grade"] for i, q, x in labels if q == 1 and x == 0]
    bad = [got[i]["expected_grade"] for i, q, x in labels if x == 1]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    for r in got.values():
        assert r["expected_grade"] == pytest.approx(r["p_not_toxic"] + r["p_good"]) and r["p_good"] <= r["p_not_toxic"]


def test_secrets(spark, sf_dir, docs):
    got = by_id(run(spark, sf_dir, "op9_secret_scan"))
    for i, t, *_ in docs:
        want = brute.secrets(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == brute.sha(brute.listed(want))
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}


def test_vectors(spark, sf_dir):
    rows = duckdb.connect().execute(f"select vec_id, embedding, label from '{sf_dir}/embeddings.parquet' order by 1").fetchall()
    got = by_id(run(spark, sf_dir, "op10_embedding_near_dedup"), "vec_id")
    x = np.array([r[1] for r in rows], float)
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= 0.98
    labels = np.array([r[2] for r in rows])
    near &= labels[:, None] == labels[None]
    np.fill_diagonal(near, False)
    comp = brute.components([r[0] for r in rows], np.argwhere(np.triu(near)).tolist())
    for k, (i, *_) in enumerate(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum(), comp[k], comp[k] == i)
