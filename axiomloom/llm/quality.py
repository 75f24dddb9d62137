"""Quality scores from graded ratings by an ordinal cumulative-link (proportional odds) model.

``P(grade > k) = logistic(w . x - cut_k)`` with one weight vector ``w`` over hashed text
features for all grades and ascending thresholds ``cut_k``. The features say which words
and which habits of writing a text has; each counts once. The grades here come from the
``labels`` table: 0 toxic, 1 of low quality, 2 good.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 18
#: Rated documents that training reads (expected number), the features that it takes of them at most in all, and in how many documents a feature must occur.
SAMPLE_DOCS, SAMPLE_FEATURES, MIN_DOCS = 6000, 4_000_000, 5
#: Cells of the sample's draw in which features are added up before they are taken.
DRAWS = 1000
GRADES, ROUNDS, RIDGE, RATE = 3, 150, 1e-3, 0.05
_EDGE = ".,;:!?()[]{}\"'*#$%&|-_=<>/\\"


def features(text: str | None) -> list[int]:
    """The hashed features of ``text``, each once: words, signs at word ends, and how often capitals, repeats and signs occur."""
    tokens = (text or "").split()
    seen = {t.strip(_EDGE).lower() for t in set(tokens)}
    seen.discard("")
    n = len(tokens)
    if n:
        upper = sum(map(str.isupper, tokens))
        same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
        ends = [t[-2:] for t in tokens if len(t) > 1 and not t[-1].isalnum() and not t[-2].isalnum()]
        bars = sum(not any(map(str.isalnum, t)) for t in tokens)
        lines = text.split("\n")
        habits = {"upper": upper / n, "same": same / n, "ends": len(ends) / n, "bars": bars / n, "again": 1 - len(set(lines)) / len(lines), "kinds": len(set(tokens)) / n}
        seen |= {f"\0{k} {min(int(v * 10), 9)}" for k, v in habits.items()} | {f"\0end {e}" for e in set(ends)}
        seen.add(f"\0size {n.bit_length()}")
    return sorted({crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in seen})


def _feature_batches(batches):
    for batch in batches:
        own = [np.array(features(t.as_py()), np.int32) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["grade", "draw", "n", "x"])


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(rated, grade)`` from quality and toxic marks: 0 if toxic, 1 if not good, 2 otherwise. Rows with a null are left out; of several ratings the lowest holds."""
    rated = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return rated.groupBy(F.col(id_col).alias("rated")).agg(F.min(grade).alias("grade"))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def tails(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` [row, k] for scores ``w . x``."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))


def gradient(w: np.ndarray, c: np.ndarray, row: np.ndarray, at: np.ndarray, grade: np.ndarray, ridge: float = RIDGE) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood with its ridge, and its slopes by ``w`` and ``c``.

    ``row[k]`` has feature ``at[k]``. ``c`` is the first threshold and the logarithms of the
    gaps between the others, so that they stay in order.
    """
    n, i = len(grade), np.arange(len(grade))
    gaps = np.exp(c[1:])
    cuts = c[0] + np.concatenate([[0], np.cumsum(gaps)])
    score = np.bincount(row, w[at], minlength=n)
    p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -50, 50)))
    edge = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
    hit = np.maximum(edge[i, grade] - edge[i, grade + 1], 1e-9)
    slope = edge * (1 - edge)
    up = np.zeros_like(edge)
    up[i, grade] += slope[i, grade] / hit
    up[i, grade + 1] -= slope[i, grade + 1] / hit
    by_score, by_cut = -up.sum(1) / n, up[:, 1:-1].sum(0) / n
    loss = -np.log(hit).mean() + ridge / 2 * float(w @ w)
    return loss, np.bincount(at, by_score[row], minlength=len(w)) + ridge * w, np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])


def fit(rows: list, grade: np.ndarray, levels: int = GRADES, ridge: float = RIDGE) -> OrdinalModel:
    """The model of maximum penalised likelihood, by full-batch Adam. Without rows all grades are equally likely; with one grade only, the thresholds alone follow it."""
    if not len(grade):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1)))
    at = np.concatenate([np.asarray(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    often = np.bincount(at, minlength=1 << BITS) >= MIN_DOCS
    at, row = at[often[at]], row[often[at]]
    share = np.array([np.clip((grade > k).mean(), 1e-3, 1 - 1e-3) for k in range(levels - 1)])
    used, at = np.unique(at, return_inverse=True)
    first = -np.log(share / (1 - share))
    x = [np.zeros(len(used)), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])]
    m, v = [np.zeros_like(p) for p in x], [np.zeros_like(p) for p in x]
    for t in range(1, ROUNDS + 1):
        _, *slopes = gradient(*x, row, at, grade, ridge)
        for k, g in enumerate(slopes):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            x[k] = x[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = x[0]
    return OrdinalModel(weights, x[1][0] + np.concatenate([[0], np.cumsum(np.exp(x[1][1:]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_features: int = SAMPLE_FEATURES) -> OrdinalModel:
    """The model from about ``sample_docs`` rated documents, chosen by a hash of the id; from all if fewer are rated.

    Of the chosen, in the order of that hash, so many are taken that they have at most
    ``sample_features`` features in all: four bytes for each reach the driver, however long
    the texts are.
    """
    rated = grades(labels, id_col)
    n = rated.count()
    if not n:
        return fit([], np.zeros(0, int))
    draw = F.pmod(F.xxhash64("rated", F.lit("quality")), F.lit(1_000_003))
    most = int(1_000_003 * min(1.0, sample_docs / n)) + 1
    chosen = rated.withColumn("draw", F.floor(draw * DRAWS / most)).where(draw < most)
    # about sample_docs rows of three numbers, so small enough to broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("rated"))
    found = cut(rows.select("grade", "draw", "text").mapInArrow(_feature_batches, "grade int, draw long, n long, x binary"))
    upto, last = 0, -1
    for cell, size in sorted((r["draw"], r["n"]) for r in found.groupBy("draw").agg(F.sum("n").alias("n")).collect()):  # at most DRAWS rows
        upto += size
        if upto > sample_features:
            break
        last = cell
    taken = found.where(F.col("draw") <= last).select("grade", "x").collect()
    taken.sort(key=lambda r: (r["grade"], bytes(r["x"])))
    return fit([np.frombuffer(r["x"], np.int32) for r in taken], np.array([r["grade"] for r in taken], int))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, tails)`` for each row; ``tails[k]`` is ``P(grade > k)``. A null text is an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS float32

    def run(batches):
        model = held.value
        for batch in batches:
            total = np.array([float(model.weights[features(t.as_py())].sum(dtype=np.float64)) for t in batch.column(1)], float)
            p = model.tails(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, expected_grade double, tails array<double>")
