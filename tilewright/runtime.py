"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a batch of rows that a Python worker is sent, but for a single larger row.
BATCH_BYTES = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULTS = ("-1", "-1b", "2147483647", "2147483647b", "67108864", "67108864b")
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a source checkout, and bound the bytes of Arrow batches.

    Spark bounds a batch by 10,000 rows or 64 MB, of which a task holds several; a session that sets the bytes itself keeps them.
    """
    if spark.conf.get(_BYTES) in _DEFAULTS:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset in local mode (tests) a local folder is made and set; on a cluster ValueError is
    raised, as every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tilewright/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage by a written table in the shared folder, which survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_written"] = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames made by :func:`cut`, which nothing that is still to run may read."""
    for df in frames:
        if path := df.__dict__.pop("_written", None):
            drop_scratch(df.sparkSession, path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
