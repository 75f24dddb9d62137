"""The pipeline's stages over rows with null and repeated ids: each row is a document of its own."""

from collections import Counter

import corpus_pipeline
import pytest

from axiomloom.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def say(k, n=40):
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [(1, say(1)), (None, say(1)), (None, say(2)), (None, say(2)), (None, say(3)), (4, say(4)), (4, say(5)), (4, say(4)), (None, "mail ann@host.org now please"), (7, "mail bob@host.org now, at once"), (7, "call +1 (555) 123-4567 now, at once"), (8, None)]
    return [(i, t, "en", "ab"[k % 2], len(t or "")) for k, (i, t) in enumerate(texts)]


def test_drop_near_copies_rows(spark, rows):
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    want = [(1, say(1)), (None, say(2)), (None, say(3)), (4, say(4)), (4, say(5)), (None, "mail ann@host.org now please"), (7, "mail bob@host.org now, at once"), (7, "call +1 (555) 123-4567 now, at once"), (8, None)]
    assert got == Counter(want)


def test_redact_personal_data_rows(spark, rows):
    got = Counter(map(tuple, corpus_pipeline.redact_personal_data(spark, spark.createDataFrame(rows, SCHEMA), "").collect()))
    clean = {"mail ann@host.org now please": "mail [EMAIL] now please", "mail bob@host.org now, at once": "mail [EMAIL] now, at once", "call +1 (555) 123-4567 now, at once": "call [PHONE] now, at once"}
    want = [(i, clean.get(t, t), lang, s, None if t is None else len(clean.get(t, t))) for i, t, lang, s, _ in rows]
    assert got == Counter(want)


def test_mix_sources_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs, "").collect()))
    assert set(got) <= set(rows) and any(r[0] is None for r in got)
    assert got.total() == sum(r.copies for r in mixing.mix(docs).collect())
    twice, have = Counter((r.doc_id, r.source, r.size) for r in mixing.mix(docs).collect() for _ in range(r.copies)), Counter()
    for (i, t, _, s, _), n in got.items():
        have[i, s, len((t or "").split())] += n
    assert have == twice


def test_identify_languages_losses(spark, sf_dir):
    """Only texts without a known language, or of several of which none has half, may be lost; a low share of all candidates is no reason."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    every = docs.select(*corpus_pipeline.COLUMNS).collect()
    # short pieces of the texts: some are in one language, at under half of the mixture of all
    every += [(100_000 + 1000 * k + i, r.text[i : i + 12], r.lang, r.source, 12) for k, r in enumerate(every[:60]) for i in range(0, min(240, len(r.text or "")), 12)]
    table = spark.createDataFrame(every, SCHEMA)
    old, langid.train = langid.train, lambda _: model
    try:
        got = {r.doc_id for r in corpus_pipeline.identify_languages(spark, table, "").collect()}
    finally:
        langid.train = old
    low = 0
    for i, text, *_ in every:
        pred, score, found = langid.identify(text, *model)
        assert (i in got) == (pred != langid.UNKNOWN and (len(found) == 1 or found[0][1] >= 0.5)), i
        low += pred != langid.UNKNOWN and len(found) == 1 and score < 0.5
    assert low
