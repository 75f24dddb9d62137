"""A label map kept current while label annotations come and go.

Each label has a state of its own: how often each of its IRIs is annotated with it. Changes
are counted, not replayed, so their order within or between batches doesn't matter: a
removal that comes before its addition leaves a count below zero until that comes.
Only pairs that appear or disappear are passed on, with the number of IRIs that the label
then has, so a label that many entities share costs as much as its changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state needs; it spills to disk and keeps its changes in the checkpoint folder.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "label string, iri string, present boolean, n_iris long"
ADD, REMOVE = "add", "remove"


class LabelCounts(StatefulProcessor):
    """Of one label, how often each IRI has it, and how many IRIs do."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getMapState("times", "iri string", "n long")
        self.iris = handle.getValueState("iris", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 -- Spark's names
        change: dict[str, int] = {}
        for row in rows:
            change[row["iri"]] = change.get(row["iri"], 0) + row["n"]
        held = self.iris.get()
        n_iris, turned = (held[0] if held is not None else 0), []
        for iri, n in change.items():
            before = self.times.getValue((iri,))[0] if self.times.containsKey((iri,)) else 0
            after = before + n
            if after:
                self.times.updateValue((iri,), (after,))
            elif before:
                self.times.removeKey((iri,))
            if (before > 0) != (after > 0):
                n_iris += 1 if after > 0 else -1
                turned.append((iri, after > 0))
        self.iris.update((n_iris,))
        for iri, present in turned:
            yield Row(label=key[0], iri=iri, present=present, n_iris=n_iris)

    def close(self) -> None:
        pass


def label_changes(changes: DataFrame) -> DataFrame:
    """``(label, iri, present, n_iris)`` whenever an IRI begins or ends to have a label, from a stream of ``changes(change, label, iri)``: ``add`` or ``remove``.

    Rows with a null label or IRI, or another change, are passed over.
    """
    told = changes.where(F.col("change").isin(ADD, REMOVE) & F.col("label").isNotNull() & F.col("iri").isNotNull())
    counted = told.select("label", "iri", F.when(F.col("change") == ADD, F.lit(1)).otherwise(F.lit(-1)).cast("long").alias("n"))
    return counted.groupBy("label").transformWithState(LabelCounts(), CHANGE, "Update", "None")


def stream_labels(changes: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that keeps the label map of ``changes`` under ``out``: a folder for each batch, overwritten if it runs again."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return label_changes(changes).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_labels(spark: SparkSession, out: str) -> DataFrame:
    """``(label, iri)`` as of the last batch; what :func:`~axiomloom.operators.lookup.label_map` gives of the annotations left."""
    last = spark.read.parquet(out).groupBy("label", "iri").agg(F.max_by("present", "batch").alias("present"))
    return last.where("present").select("label", "iri")


def current_ambiguous(spark: SparkSession, out: str) -> DataFrame:
    """``(label, n_iris)`` of the labels that several IRIs have, as of the last batch."""
    last = spark.read.parquet(out).groupBy("label").agg(F.max_by("n_iris", "batch").alias("n_iris"))
    return last.where("n_iris > 1")
