"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import keep_until_exit


#: Spark's switch for deleting a query's shuffle files when it ends.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, shuffles_go: bool = False) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so that its lineage ends there. What is left of it goes with the process, or with :func:`scratch`.

    With ``shuffles_go`` the shuffle files that made it are deleted at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    keep_until_exit(spark)
    if not shuffles_go:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned under the switch
    finally:
        spark.conf.set(_SHUFFLES_GO, before)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def pieces(total: float, each: float, spark: SparkSession) -> int:
    """How many pieces of about ``each`` units ``total`` units make, at least two for each shuffle partition."""
    return max(2 * shuffle_width(spark), math.ceil(total / each))


def by_cells(df: DataFrame, rows: int, each: int, *then: str) -> DataFrame:
    """``df`` dealt by ``cell`` and sorted by it and ``then`` in each partition; of about ``each`` rows, but in the session's width at least, which adaptive execution may coalesce."""
    width = math.ceil(rows / each)
    dealt_out = df.repartition(width, "cell") if width > shuffle_width(df.sparkSession) else df.repartition("cell")
    return dealt_out.sortWithinPartitions("cell", *then)


def whole_cells(batches: Iterable[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """The rows of ``batches``, sorted by their first column, as tables of whole cells: about ``rows`` rows, or one larger cell."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            cell = table.column(0).to_numpy()
            last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
            if last:
                yield table.slice(0, last)
                held = table.slice(last).combine_chunks().to_batches()
                n -= last
    if held:
        yield pa.Table.from_batches(held)


def tidied(run):
    """``run``, a function over batches, that hands Arrow's unused memory back at its end: workers live on and are several to an executor."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def small(settled: DataFrame, most: int = 200_000) -> DataFrame:
    """``settled``, a checkpointed table of a few numbers a row, marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffle."""
    return F.broadcast(settled) if settled.count() <= most else settled


def words(text):
    """Column: the words ``[^\\x20\\x09-\\x0D]+`` of ``text``, in order; no empty ones."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def dealt(keyed: DataFrame, key: str, item, tile_rows: int, weight=None) -> DataFrame:
    """``keyed`` with ``cell``, ``side`` and ``whole``: rows that share a ``key`` meet in a cell, large keys as pairs of tiles.

    A key of at most ``tile_rows`` rows, or of that ``weight`` in all, is one cell (``whole``). A larger one is dealt by a
    hash of ``item`` to tiles of about that size (``side``), and each pair of tiles is a cell,
    so every two rows of a key meet in exactly one cell in which their sides differ, or in
    the one of their own tile (``whole``).
    """
    large = keyed.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("count")).where(F.col("count") > tile_rows)
    large = cut(large.select(key, F.ceil(F.col("count") / tile_rows).alias("tiles")))
    rows = keyed.join(small(large), key, "left")
    side = F.coalesce(F.pmod(F.xxhash64(item, F.lit(7)), F.col("tiles")), F.lit(0).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tiles"), F.lit(1).cast("long")) - 1))
    rows = rows.withColumn("side", side).withColumn("other", other)
    cell = F.when(F.col("tiles").isNull(), F.col(key)).otherwise(F.xxhash64(key, F.least("side", "other"), F.greatest("side", "other")))
    return rows.withColumn("cell", cell).withColumn("whole", F.col("side") == F.col("other")).drop("tiles", "other")


def finite_vector(vector):
    """Column: whether ``vector`` is there and all its components are numbers, neither null nor infinite; never null."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def list_matrix(column) -> np.ndarray:
    """``[row, component]``: an Arrow column of lists of one length, without nulls."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), len(values) // len(flat) if len(flat) else 0)


def _add_batches(keys: int, kind):
    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
            for name, values in zip(names, batch.column(keys), strict=True):
                own = values.values.to_numpy(zero_copy_only=False)
                held[name] = held[name] + own if name in held else own.copy()
        if held:
            columns = [pa.array([name[k] for name in held], pa.int64()) for k in range(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.list_(kind))], names=[*(f"k{k}" for k in range(keys)), "values"])

    return run


def array_totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, values)``: the arrays ``values`` (of longs or doubles, one length for each key) of each key added up place by place; ``keys`` are longs.

    A task holds one array for each of its keys, however many rows it adds.
    """
    kind = pa.int64() if parts.schema["values"].dataType.simpleString() == "array<bigint>" else pa.float64()
    rows = parts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "values").repartition(*[F.col(f"k{i}") for i in range(len(keys))])
    schema = ", ".join([*(f"k{i} long" for i in range(len(keys))), f"values {parts.schema['values'].dataType.simpleString()}"])
    return rows.mapInArrow(_add_batches(len(keys), kind), schema).toDF(*keys, "values")
