"""Language identification as a mixture: which languages, and in what proportions, made a text.

Training counts hashed byte trigrams of labelled texts for each language. A document's
n-grams are then explained by a mixture of the languages' multinomials; its proportions
are found by expectation-maximisation, and the set of languages by penalised likelihood:
starting with the best single language, the next by proportion joins as long as the gain
in log-likelihood exceeds ``PENALTY * log(n)``. The prediction is the selected language of
the largest proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the trigrams, texts sampled for each language (expected number).
BUCKET_BITS, SAMPLE_DOCS = 15, 4000
PENALTY, MIN_SHARE, ROUNDS, SMOOTH = 12.0, 0.1, 25, 0.05
UNKNOWN = "und"
_BLOCK = 1 << 20
#: Bytes that aren't ASCII letters nor part of a longer character become a space.
_KEEP = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of ``text``'s hashed byte trigrams, lower case, other signs than letters as one space."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()) + b" "
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for start in range(0, max(len(data) - 2, 0), _BLOCK):
        x = np.frombuffer(data[start : start + _BLOCK + 2], np.uint8).astype(np.uint32)
        h = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        total += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS)
    return total


def has_letter(text: str | None) -> bool:
    """Whether any character of ``text`` is a letter."""
    return bool(text) and any(map(str.isalpha, text))


def _count_batches(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for scalar, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            if has_letter(text := scalar.as_py()):
                sums[lang] = sums.get(lang, 0) + trigram_counts(text)
    for lang, n in sums.items():
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(n[own])], names=["lang", "bucket", "n"])


def held_out(id_col):
    """Column: whether a document is kept from training: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS):
    """``(languages, log probabilities [bucket, language])`` from the labelled documents that aren't held out.

    Of each language about ``sample_docs`` whole documents are read, chosen by a hash of the
    id; all if it has fewer. Without any labelled document there are no languages.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return [], np.zeros((1 << BUCKET_BITS, 0), np.float32)
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_003)) / 1_000_003
    counted = rows.where(draw < rate).select("text", "lang").mapInArrow(_count_batches, "lang string, bucket int, n long")
    counted = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BUCKET_BITS rows for each language
    langs = sorted(sizes)
    table = np.full((1 << BUCKET_BITS, len(langs)), SMOOTH)
    np.add.at(table, (counted["bucket"].to_numpy(np.int64), np.searchsorted(langs, counted["lang"].to_numpy(str)) if len(counted) else np.zeros(0, int)), counted["n"].to_numpy(float))
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def proportions(like: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """The mixture's proportions and log-likelihood; ``like`` [n-gram, language] up to a factor of each row, ``n`` counts."""
    total, share = n.sum(), np.full(like.shape[1], 1 / like.shape[1])
    for _ in range(ROUNDS):
        part = like * share
        new = (n / part.sum(1)) @ part / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(n @ np.log(like @ share))


def identify(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float, list[tuple[str, float]]]:
    """``(language, score, selected languages with proportions)``; the score is the language's share in the mixture of all languages."""
    if not langs or not has_letter(text):
        return UNKNOWN, 0.0, []
    counts = trigram_counts(text)
    own = np.flatnonzero(counts)
    if not len(own):
        return UNKNOWN, 0.0, []
    n, logs = counts[own].astype(np.float64), table[own].astype(np.float64)
    single = n @ logs
    top = logs.max(1)
    like = np.exp(logs - top[:, None])
    full, _ = proportions(like, n)
    chosen, share = [int(np.argmax(single))], np.ones(1)
    best = float(single[chosen[0]] - n @ top)
    for k in np.argsort(-full, kind="stable"):
        if k in chosen or full[k] < MIN_SHARE:
            continue
        new, value = proportions(like[:, [*chosen, k]], n)
        if value - best <= PENALTY * np.log(n.sum() + 1) or new[-1] < MIN_SHARE:
            break
        chosen, share, best = [*chosen, int(k)], new, value
    order = np.argsort(-share, kind="stable")
    found = [(langs[chosen[i]], float(share[i])) for i in order]
    return found[0][0], float(min(1.0, max(0.0, full[chosen[order[0]]]))), found


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, lang_pred, score, share, languages)`` for each row; only the text is looked at.

    ``share`` is the prediction's proportion in the selected set, 1 if it is alone there.
    ``und`` with score and share 0 if the text is null or has no letter, or if nothing was learned.
    ``languages`` lists the selected set with proportions, as ``en:0.71 fr:0.29``.
    """
    langs, table = model
    # its size is 2**BUCKET_BITS float32 for each language
    held = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches):
        langs, table = held.value
        for batch in batches:
            found = [identify(t.as_py(), langs, table) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2][0][1] if f[2] else 0.0 for f in found], pa.float64()), pa.array([" ".join(f"{g}:{s:.2f}" for g, s in f[2]) for f in found], pa.string())],
                names=[*batch.schema.names[1:], "lang_pred", "score", "share", "languages"],
            )

    rows = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"), *[c for c in keep if c != "doc_id"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, share double, languages string")
