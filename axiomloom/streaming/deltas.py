"""Types of individuals kept up to date as assertions stream in.

The class hierarchy is closed once, outside of the stream, so a batch of new assertions
costs one join with it. Results are appended as one folder for each batch: a batch that is
run again after a failure overwrites its own folder, which makes the sink exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.closure import closure
from ..plans.checkpoints import settled


def stream_types(assertions: DataFrame, told: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes the told and inherited classes of ``assertions(ind, cls)``, a streaming DataFrame, to ``out``.

    ``told(src, dst)`` is the hierarchy at the start. :func:`current_types` reads the result.
    """
    up = settled(closure(told).select(F.col("start").alias("cls"), F.col("node").alias("sup")))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("ind", "cls").distinct()
        rows = rows.union(rows.join(up, "cls").select("ind", F.col("sup").alias("cls"))).distinct()
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return assertions.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_types(spark: SparkSession, out: str) -> DataFrame:
    """``(ind, cls)`` of all batches so far, each pair once."""
    return spark.read.parquet(out).select("ind", "cls").distinct()


def stream_counts(events: DataFrame, time_col: str, key_col: str, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """``(start, key, n)``: how many rows each key has in each window of event time; rows later than ``late`` are left out."""
    counted = events.withWatermark(time_col, late).groupBy(F.window(time_col, window), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "key", "n")
