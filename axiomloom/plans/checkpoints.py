"""Where iterative operators cut their lineage: tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: This process's folder under each checkpoint folder, removed when the process ends.
_OWN = f"axiomloom-{uuid.uuid4().hex}"
_used: dict[str, SparkSession] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset and all runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share: a local one can't hold their intermediate results.")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="axiomloom-"))
    return spark.sparkContext.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes ``folder``, wherever Spark's file systems have it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove() -> None:
    for folder, spark in _used.items():
        try:
            remove_folder(spark, folder)
        except Exception:  # noqa: BLE001, S110 -- the session may be gone; what is left is only disk space
            pass


def keep_until_exit(spark: SparkSession) -> None:
    """Makes sure that there is a checkpoint folder, and that this process's part of it goes when the process ends."""
    checkpoint_folder(spark)
    own_folder(spark)
    at = spark.sparkContext.getCheckpointDir()  # a folder of this application's own
    if at:
        _used[at] = spark


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Inside, checkpoints go to a folder that is deleted at the end; what is read from them must be written by then."""
    before, folder = spark.sparkContext.getCheckpointDir(), f"{own_folder(spark)}/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield
    finally:
        # Spark adds a folder of its own to the one that it is told
        spark.sparkContext.setCheckpointDir(before.rpartition("/")[0] if before else checkpoint_folder(spark))
        remove_folder(spark, folder)


def own_folder(spark: SparkSession) -> str:
    """This process's folder beside the checkpoints; it goes when the process ends."""
    own = f"{checkpoint_folder(spark)}/{_OWN}"
    if not _used:
        atexit.register(_remove)
    _used[own] = spark
    return own


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, written to the checkpoint folder and read back.

    Lineage ends at the files, which every executor can read again, and their size is known
    to the planner, so small intermediate results are broadcast without a hint.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
