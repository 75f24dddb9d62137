"""The corpus pipeline, stage by stage, against plain versions of each stage."""

import base64
import os
import re
import sys

import corpus_pipeline

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from axiomloom.llm import langid, pii  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        results.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert dict(docs.dtypes) == dict(spark.read.parquet(f"{sf_dir}/documents.parquet").dtypes)

    before, after = results[0]
    model = langid.train(before)
    keep = []
    for r in before.collect():
        lang, _, found = langid.identify(r.text, *model)
        if lang != "und" and found[0][1] >= corpus_pipeline.LEAST_SHARE:
            keep.append(r)
    assert sorted(map(tuple, keep)) == sorted(map(tuple, after.collect()))
    assert after.count() > 0.9 * before.count()

    before, after = results[1]
    rows = sorted(before.collect())
    comps = brute.components([r.doc_id for r in rows], brute.near_pairs([r.text for r in rows]))
    assert sorted(map(tuple, after.collect())) == [tuple(r) for r, c in zip(rows, comps, strict=True) if r.doc_id == c]

    before, after = results[2]
    spans = {r.doc_id: [x for x in r.spans.split(",") if x] for r in pii.digest(pii.find_personal_data(before)).collect()}
    now = {r.doc_id: r for r in after.collect()}
    assert len(now) == before.count()
    for r in before.collect():
        found = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[r.doc_id]))
        out, at = "", 0
        for a, b, k in found:
            if a >= at:
                out += r.text[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        out += r.text[at:]
        assert now[r.doc_id].text == out and now[r.doc_id].n_chars == len(out)
        assert not any(brute.personal(out)) or spans[r.doc_id]

    before, after = results[3]
    size = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in before.collect()}
    per, taken, largest = {}, {}, {}
    for s, n in size.values():
        per[s] = per.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id][1]
    for s, t in brute.targets(per).items():
        assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1e-6

    before, after = results[4]
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in before.collect())
    assert want == sorted((r.doc_id, r.ids) for r in after.collect()) and all(r.round_trip for r in after.collect())


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "source_mixing", "byte_bpe"]
    from pathlib import Path

    from axiomloom.plans.checkpoints import own_folder

    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    own = Path(own_folder(spark).removeprefix("file:"))
    assert [sorted(x.name for x in p.iterdir() if x.is_dir()) for p in own.glob("pipeline-*")][-1] == ["4"]


def test_empty_table(spark, sf_dir):
    """Stages over no rows, and over rows that have only nulls."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None)] * 3):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, docs, sf_dir).count() == (0 if not rows or name == "source_mixing" else 1 if name == "simhash_near_dedup" else 3), name
        assert corpus_pipeline.identify_languages(spark, docs, sf_dir).count() == 0
