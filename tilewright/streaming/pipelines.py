"""Streams of work items and of rows. Offsets and checkpoints take the place of leases: an item is done once its batch is."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import linalg
WORK_ITEM = "PatchSize int, PatchStride int, PoolSize int, PoolStride int, Bias double, column_block int, num_column_blocks int"
SOLVE_ITEM = "train string, test string"


def produce(items: DataFrame, path: str, column_blocks: int | None = None) -> None:
    """Writes hyper-parameter rows as JSON work items, one for each column block if asked for."""
    if column_blocks:
        items = items.withColumn("num_column_blocks", F.lit(column_blocks)).withColumn("column_block", F.explode(F.sequence(F.lit(0), F.lit(column_blocks - 1))))
    items.write.mode("append").json(path)


def consume(spark: SparkSession, path: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], available: bool = True):
    """Calls ``work(items, batch)`` for each batch of new items; work that is repeated after a failure must be
    idempotent (write by batch id, or only blocks that are missing)."""
    stream = spark.readStream.schema(schema).json(path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available else stream).start()


def featurize_and_forward(spark: SparkSession, path: str, out: str, checkpoint: str, featurize: Callable[[dict], tuple[str, str]]):
    """The first consumer: featurizes each item by a function that returns the keys of what it wrote, and emits a solve item."""

    def work(items: DataFrame, batch: int) -> None:
        done = [featurize(r.asDict()) for r in items.toLocalIterator()]
        spark.createDataFrame(done, SOLVE_ITEM).coalesce(1).write.mode("overwrite").json(f"{out}/batch={batch}")

    return consume(spark, path, WORK_ITEM, checkpoint, work)


def solve_and_record(spark: SparkSession, path: str, out: str, checkpoint: str, solve: Callable[[str, str], dict]):
    """The second consumer: solves each (train, test) and records its metrics."""

    def work(items: DataFrame, batch: int) -> None:
        rows = [(r["train"], r["test"], {k: float(v) for k, v in solve(r["train"], r["test"]).items()}) for r in items.toLocalIterator()]
        spark.createDataFrame(rows, "train string, test string, metrics map<string, double>").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return consume(spark, f"{path}/batch=*", SOLVE_ITEM, checkpoint, work)


def running_gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v) of X'X of a batch's rows, for the named columns: a d x d sum for each task."""
    return linalg.gram(rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("features")))


class Accumulator:
    """Sums of a matrix kept from run to run: each batch adds its part under its id, so a repeated batch adds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, part: DataFrame, batch: int) -> None:
        """Stores (i, j, v) of one batch, replacing what an earlier try of the batch stored."""
        part.select("i", "j", "v").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def total(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy("i", "j").agg(F.sum("v").alias("v"))

    def dense(self, d: int) -> np.ndarray:
        out = np.zeros((d, d))
        for r in self.total().collect():
            out[r["i"], r["j"]] = r["v"]
        return out
