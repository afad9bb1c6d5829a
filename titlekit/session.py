"""Where a job may keep the tables it has to write down half-way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder, which goes when the process ends; a cluster session
    without it is refused, because a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="titlekit-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder (the folder itself is made by the writer)."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so later uses do not compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer tasks than there are cores, dealt out to all of them.

    For heavy work on a few small files; a large table has more read tasks than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitioned(df: DataFrame, key: str) -> DataFrame:
    """Compute ``df`` and cache it partitioned by ``key``; groupings and joins by the key then need no shuffle.

    Lost parts are computed again from the source. The caller drops the cache with ``unpersist``. It is filled here,
    because Spark only relies on the partitioning of a cached table that it has already computed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(parts, key).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept
