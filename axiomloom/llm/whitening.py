"""Whitened vectors: principal components by block Lanczos whose only access to the data is a distributed pass.

The covariance is never formed. A pass sends a block of directions to every partition and
adds up ``(x - mean) ((x - mean)' V)`` over all rows; its result has a column for each
direction. The driver keeps the basis, at most one vector for each dimension, and makes
each new block orthogonal to all of it, twice. Where a block loses rank (breakdown) its lost
directions restart at random, orthogonal to the basis. The projected eigenproblem gives the
components; what a further product with the matrix would leave of each (the residual, known from
the passes) says when they have converged. The shares that components explain are of the trace, which comes
from the rows' squared deviations and not from eigenvalues.

Vectors are whole numbers here, so sums, means times ``n``, deviations and the trace are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_totals, cut, finite_vector, list_matrix

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Directions of a block beyond the wanted components; residual, as a share of the largest eigenvalue, under which one has converged.
SPARE, CONVERGED = 4, 1e-14
#: A direction is lost if less than this share of it is left outside the basis; a component is none if it explains less of the trace.
LOST, LEAST_SHARE = 1e-10, 1e-13
_ROWS = 4096


def _deviations(column, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums`` in whole numbers; an error where it might not fit."""
    x = list_matrix(column)
    if x.size and (float(np.abs(x).max()) * n >= 1 << 62):
        raise OverflowError("Too many vectors, or too large ones: n * x does not fit 64 bits.")
    return n * x - sums[None]


def _pass_batches(n: int, sums: np.ndarray, block: np.ndarray):
    """Per partition, ``(x - mean) ((x - mean)' block)`` summed over its rows: a row for each dimension."""

    def run(batches):
        total = np.zeros(block.shape)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                c = _deviations(batch.column(0).slice(start, _ROWS), n, sums) / n
                total += c.T @ (c @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "values"])

    return run


def _matrix(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """``parts(at, values)`` added up by ``at``, as the rows of a matrix."""
    out = np.zeros(shape)
    for r in array_totals(parts, ["at"]).collect():  # one row for each dimension
        out[r["at"]] = r["values"]
    return out


def orthogonal_block(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal columns that span ``block`` outside ``basis``; lost directions restart at random, as far as there are dimensions left."""
    found = basis
    for column in block.T:
        for attempt in range(20):
            size = np.linalg.norm(column)
            rest = column
            for _ in range(2):
                rest = rest - found @ (found.T @ rest)
            left = np.linalg.norm(rest)
            if size > 0 and left > LOST * size:
                rest = rest / left
                rest = rest - found @ (found.T @ rest)
                found = np.column_stack([found, rest / np.linalg.norm(rest)])
                break
            if found.shape[1] == len(basis):
                return found[:, basis.shape[1] :]
            column = rng.standard_normal(len(basis))
    return found[:, basis.shape[1] :]


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``wanted`` largest eigenpairs of the symmetric ``size`` by ``size`` matrix that ``product`` multiplies blocks with.

    Ends when their residuals are below ``CONVERGED`` of the largest value or, if rounding
    keeps them above, when the basis spans everything.
    """
    rng = np.random.default_rng(13)
    wanted, width = min(wanted, size), min(size, wanted + spare)
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    block = rng.standard_normal((size, width))
    while True:
        block = orthogonal_block(block, basis, rng)
        image = product(block)
        basis, images = np.column_stack([basis, block]), np.column_stack([images, image])
        inner = basis.T @ images
        values, turned = np.linalg.eigh((inner + inner.T) / 2)
        values, turned = values[::-1][:wanted], turned[:, ::-1][:, :wanted]
        vectors = basis @ turned
        residual = np.linalg.norm(images @ turned - vectors * values[None], axis=0)
        if basis.shape[1] == size or (basis.shape[1] >= wanted and (residual <= CONVERGED * max(values[0], 0.0)).all()):
            return values, vectors / np.linalg.norm(vectors, axis=0)
        block = image


class Whitening:
    """Mean, components and shares of a table of whole-number vectors, fitted on each different one once."""

    def __init__(self, n: int, sums: np.ndarray, trace: float, values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums, trace, values, vectors
        self.identity_error = 0.0

    def project(self, column) -> np.ndarray:
        return (_deviations(column, self.n, self.sums) / self.n) @ (self.vectors / np.sqrt(self.values)[None])


def _sum_batches(batches):
    total = None
    for batch in batches:
        if batch.num_rows:
            own = list_matrix(batch.column(0)).sum(0)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total], pa.list_(pa.int64()))], names=["at", "values"])


def _deviation_array(d: np.ndarray) -> pa.Array:
    """Each row's sum of squares as decimal(38,0), exact."""
    most = float(np.abs(d).max()) if d.size else 0.0
    whole = (d * d).sum(1).tolist() if most * most * max(d.shape[1], 1) < 1 << 62 else [sum(int(c) ** 2 for c in row) for row in d]
    return pa.array([Decimal(w) for w in whole], pa.decimal128(38, 0))


def _trace_batches(n: int, sums: np.ndarray):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                yield pa.RecordBatch.from_arrays([_deviation_array(_deviations(batch.column(0).slice(start, _ROWS), n, sums))], names=["deviation"])

    return run


def _mean_batches(model: Whitening):
    """Per partition, the sums of whitened coordinates."""

    def run(batches):
        total = np.zeros(len(model.values))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                total += model.project(batch.column(0).slice(start, _ROWS)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total], pa.list_(pa.float64()))], names=["at", "values"])

    return run


def _covariance_batches(model: Whitening, mean: np.ndarray):
    """Per partition, the sums of products of whitened coordinates less their mean."""

    def run(batches):
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                w = model.project(batch.column(0).slice(start, _ROWS)) - mean[None]
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "values"])

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The :class:`Whitening` of ``vectors(x)``, whole numbers of one length; None for an empty table."""
    different = cut(vectors.select("x").distinct())
    n, short, long = different.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if short != long or not long:
        raise ValueError(f"Vectors must have one length, above 0; there are lengths from {short} to {long}.")
    totals = array_totals(different.mapInArrow(_sum_batches, "at long, values array<long>"), ["at"]).first()
    sums = np.array(totals["values"], np.int64)
    spread = different.mapInArrow(_trace_batches(n, sums), "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0]
    trace = float(Decimal(spread) / Decimal(n) ** 3)
    if not trace:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((long, 0)))
    product = lambda block: _matrix(different.mapInArrow(_pass_batches(n, sums, block), "at long, values array<double>"), block.shape) / n
    values, directions = block_lanczos(product, long, components)
    some = values > LEAST_SHARE * trace
    # either sign would do: the largest coordinate is positive, so that reruns agree
    directions = directions[:, some]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])[None]
    model = Whitening(n, sums, trace, values[some], directions)
    k = len(model.values)
    mean = _matrix(different.mapInArrow(_mean_batches(model), "at long, values array<double>"), (1, k))[0] / n
    covariance = _matrix(different.mapInArrow(_covariance_batches(model, mean), "at long, values array<double>"), (k, k)) / n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def _whiten_batches(model: Whitening):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                d = _deviations(part.column(1), model.n, model.sums)
                yield pa.RecordBatch.from_arrays([part.column(0), _deviation_array(d), pa.array(list(model.project(part.column(1))), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, x)``: ``floor(scale * component) + offset``; rows whose vector is null or holds a null or non-finite component are left out."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite_vector(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset).alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, **columns) -> DataFrame:
    """``(vec_id, n, deviation, whitened, explained, identity_error)`` for each row of ``vectors`` that :func:`whole_vectors` keeps.

    ``whitened`` has the row's coordinate for each component and ``explained`` each component's
    share of the variance, both by falling share; directions that explain nothing are
    none, so a table whose vectors are all equal has empty arrays. ``deviation`` is the exact sum of
    ``(n * x - sum)^2`` (a decimal). Equal vectors count once in the fit and are returned as often as
    they come, null ids too; other columns are ignored. An empty table gives an empty
    result; vectors of several lengths or of none are a ValueError.
    """
    rows = cut(whole_vectors(vectors, **columns))
    model = fit(rows, components)
    kinds = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        model = Whitening(0, np.zeros(0, np.int64), 1.0, np.zeros(0), np.zeros((0, 0)))
    found = rows.mapInArrow(_whiten_batches(model), kinds)
    shares = F.lit([float(v) for v in model.values / (model.trace or 1.0)]).cast("array<double>") if len(model.values) else F.array().cast("array<double>")
    return found.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
