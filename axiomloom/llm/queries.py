"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codebooks, langid, mixing, pii, quality, secret_scan, simhash, sketch, suffix_dedup, topk, vector_dedup, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(_table(spark, sf_dir, "documents"))
    gone = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", gone.cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def tokenizer():
    """Path and pattern of the tokenizer that the query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.vocabulary(spark, *tokenizer())
    coded = bpe.encode_texts(_table(spark, sf_dir, "documents"), vocab, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.edited_fingerprints(_table(spark, sf_dir, "documents"))
    part = lambda k: (F.col(k), F.col(f"{k}_least"))
    like = lambda k: sketch.containment(F.col("sketch"), F.col(k), F.col("sketch_least"), F.col(f"{k}_least"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.sketch_text(*part("sketch")).alias("fingerprint"), sketch.sketch_text(*part("edited_sketch")).alias("edited_fingerprint"),
        like("edited_sketch").alias("near_edited"), like("next_sketch").alias("near_next"),
    )


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"), (F.col("tails")[1] >= 0.5).alias("kept"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % topk.EVERY == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.coded(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.col("label_error").cast("long").alias("label_error"), "codebooks_sha256")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    component = (F.col("place") + 1).cast("int")
    return each.select("vec_id", component.alias("component"), "n", F.col("deviation").cast("long").alias("deviation"), "whitened", F.element_at("explained", component).alias("explained"), "identity_error")


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_source_mixing, op3_byte_bpe, op4_simhash_near_dedup, op5_personal_data, op6_language_id, op7_document_fingerprints, op8_ordinal_quality, op9_secret_scan, op10_embedding_near_dedup, op11_exact_top_products, op12_vector_codes, op13_embedding_whitening)}
#: The contracts that DuckDB can state. Of the others, hashes (XXH64), tokenising and trained models have no SQL; tests/llm holds them against brute force.
ORACLE_SQL = {
    "op2_source_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
b AS (SELECT *, size / (size + 20) AS doc_weight, (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(trunc(doc_weight * size * 1024)::BIGINT)::BIGINT AS weighted FROM b GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1)::INT % 3] AS weight, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source COLLATE "C" NULLS LAST) AS k FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw,
 sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lm FROM o),
f AS (SELECT min(k) AS k FROM l WHERE lw * weight <= cap * lm),
t AS (SELECT l.*, coalesce(least(l.cap::DOUBLE, x.lw::DOUBLE * l.weight::DOUBLE / x.lm::DOUBLE), l.cap::DOUBLE) AS target FROM l LEFT JOIN l x ON x.k = (SELECT k FROM f)),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
 CASE WHEN source_size > 0 THEN target - floor(target / source_size) * source_size ELSE target END AS need, weighted FROM t),
r AS (SELECT b.*, p.source_size, p.target, p.whole, p.need, least(1.0, CASE WHEN p.weighted > 0 THEN p.need * 1024 / p.weighted ELSE 0.0 END * doc_weight) AS pi FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
q AS (SELECT *, CASE WHEN pi <= 0 THEN 1.0 ELSE (u / (1 - u) * ((1 - pi) / pi)) / (1 + u / (1 - u) * ((1 - pi) / pi)) END AS rank FROM r),
c AS (SELECT *, sum(CASE WHEN size > 0 AND need > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY (size > 0 AND need > 0) DESC, rank, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target, (whole::BIGINT + e) * size AS taken, whole::BIGINT + e AS copies
FROM (SELECT *, CASE WHEN size > 0 AND need > 0 AND (upto <= need OR upto - need <= need - (upto - size)) THEN 1 ELSE 0 END AS e FROM c)""",
    "op1_suffix_array_dedup": """
WITH b AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, p, md5_number(substr(h, 2 * p::BIGINT + 1, 100)) AS s FROM b, range(0, length(h) // 2 - 49) t(p) WHERE length(h) >= 100),
m AS (SELECT s, min(k) AS k FROM w GROUP BY s HAVING min(k) < max(k)),
g AS (SELECT w.doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY w.doc_id ORDER BY p), -1000) > 50 AS fresh FROM w JOIN m ON w.s = m.s WHERE m.k < w.k),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
x AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM r GROUP BY ALL),
y AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
k AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM y GROUP BY doc_id),
t AS (SELECT y.doc_id, string_agg(substr(h, 2 * before::BIGINT + 1, 2 * (a - before)::BIGINT), '' ORDER BY a) AS head FROM y JOIN b ON y.doc_id = b.doc_id GROUP BY y.doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0)::BIGINT + 1))) AS kept_sha256 FROM b LEFT JOIN k ON b.doc_id = k.doc_id LEFT JOIN t ON b.doc_id = t.doc_id""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND n > 0 AND isfinite(n)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
c AS (SELECT a AS s, b AS t FROM l UNION SELECT c.s, l.b FROM c JOIN l ON c.t = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(t) FROM c WHERE c.s = v.vec_id), v.vec_id)) AS component_id,
 v.vec_id = least(v.vec_id, coalesce((SELECT min(t) FROM c WHERE c.s = v.vec_id), v.vec_id)) AS kept FROM v""",
    "op11_exact_top_products": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.r <> v.r AND len(q.x) = len(v.x) WHERE q.vec_id % 50 = 0),
t AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5""",
    "op12_vector_codes": """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, vec_id, label, x FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
p AS (SELECT r, k, x[k * len(x) // 16 + 1:(k + 1) * len(x) // 16] AS y FROM v, range(16) t(k)),
c0 AS (SELECT k, r - 1 AS e, y::BIGINT[] AS c FROM p WHERE r <= 64),
a1 AS (SELECT r, k, min(d * 64 + e)::BIGINT % 64 AS e, min(d * 64 + e)::BIGINT // 64 AS d FROM (SELECT r, p.k, e, list_inner_product(y, y) - 2 * list_inner_product(y, c::DOUBLE[]) + list_inner_product(c::DOUBLE[], c::DOUBLE[]) AS d FROM p JOIN c0 c ON p.k = c.k) GROUP BY r, k),
c1 AS (SELECT k, e, list(c ORDER BY j) AS c FROM (SELECT k, e, j, (s - ((s % n) + n) % n) // n AS c FROM (SELECT a.k, a.e, j, sum(y[j]::BIGINT)::BIGINT AS s, count(*) AS n FROM a1 a JOIN p ON a.r = p.r AND a.k = p.k, range(1, len(y) + 1) t(j) GROUP BY ALL)) GROUP BY k, e
 UNION ALL SELECT k, e, c FROM c0 b WHERE NOT EXISTS (SELECT 1 FROM a1 a WHERE a.k = b.k AND a.e = b.e)),
a2 AS (SELECT r, k, min(d * 64 + e)::BIGINT % 64 AS e, min(d * 64 + e)::BIGINT // 64 AS d FROM (SELECT r, p.k, e, list_inner_product(y, y) - 2 * list_inner_product(y, c::DOUBLE[]) + list_inner_product(c::DOUBLE[], c::DOUBLE[]) AS d FROM p JOIN c1 c ON p.k = c.k) GROUP BY r, k),
c2 AS (SELECT k, e, list(c ORDER BY j) AS c FROM (SELECT k, e, j, (s - ((s % n) + n) % n) // n AS c FROM (SELECT a.k, a.e, j, sum(y[j]::BIGINT)::BIGINT AS s, count(*) AS n FROM a2 a JOIN p ON a.r = p.r AND a.k = p.k, range(1, len(y) + 1) t(j) GROUP BY ALL)) GROUP BY k, e
 UNION ALL SELECT k, e, c FROM c1 b WHERE NOT EXISTS (SELECT 1 FROM a2 a WHERE a.k = b.k AND a.e = b.e)),
a3 AS (SELECT r, k, min(d * 64 + e)::BIGINT % 64 AS e, min(d * 64 + e)::BIGINT // 64 AS d FROM (SELECT r, p.k, e, list_inner_product(y, y) - 2 * list_inner_product(y, c::DOUBLE[]) + list_inner_product(c::DOUBLE[], c::DOUBLE[]) AS d FROM p JOIN c2 c ON p.k = c.k) GROUP BY r, k),
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY k) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) FROM c2) AS codebooks_sha256 FROM v JOIN f ON v.r = f.r""",
}
