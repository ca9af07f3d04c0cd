"""Records of experiments: results tables, models and logs."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(record: dict) -> dict:
    """A nested record as one level; of equal keys the last wins."""
    out: dict = {}
    for k, v in record.items():
        out |= flatten(v) if isinstance(v, dict) else {k: v}
    return out


def label(name: Column, spaces: bool = True) -> Column:
    """Underscores as blanks, or back."""
    return F.translate(name, "_", " ") if spaces else F.translate(name, " ", "_")


def flatten_maps(*maps: Column) -> Column:
    """Maps as one; of equal keys the last wins."""

    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    return functools.reduce(over, maps)


def aligned(rows: DataFrame, header: list[str], missing: str = "N/A") -> DataFrame:
    """The header's columns as text; those that are missing or null as a mark."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) if c in rows.columns else F.lit(missing).alias(c) for c in header])


def append(rows: DataFrame, header: list[str], path: str) -> None:
    aligned(rows, header).write.mode("append").parquet(path)


def clear(spark: SparkSession, header: list[str], path: str) -> None:
    spark.createDataFrame([], ", ".join(f"`{c}` string" for c in header)).write.mode("overwrite").parquet(path)


def identified(rows: DataFrame, columns: list[str], commit: str = "") -> DataFrame:
    """Adds ``experiment_hash`` (md5 of the record as JSON), ``commit`` and ``timestamp``."""
    return rows.withColumn("experiment_hash", F.md5(F.to_json(F.struct(*columns)).cast("binary"))).withColumn("commit", F.lit(commit)).withColumn("timestamp", F.current_timestamp())


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rebuilt(spark: SparkSession, json_path: str, schema: str, keep: Column, path: str) -> DataFrame:
    """The results table again, of the stored records that pass a filter."""
    rows = spark.read.schema(schema).json(json_path).where(keep)
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def model_key(name: str, **metrics: float) -> str:
    """A key with its metrics, such as ``model_train_0.9692``."""
    return "_".join([name, *(f"{k}_{v:.4f}" for k, v in metrics.items())])


def save_model(model: DataFrame, predictions: DataFrame, root: str, name: str, **metrics: float) -> str:
    key = model_key(name, **metrics)
    model.write.mode("overwrite").parquet(f"{root}/{key}/model")
    predictions.write.mode("overwrite").parquet(f"{root}/{key}/predictions")
    return key


def save_features(rows: DataFrame, root: str) -> None:
    """A table with ``is_train`` as its two parts."""
    rows.write.mode("overwrite").partitionBy("is_train").parquet(root)


def load_features(spark: SparkSession, root: str) -> DataFrame:
    """Both parts; the flag is that of their folders."""
    return spark.read.parquet(root).withColumn("is_train", F.col("is_train").cast("boolean"))


def episode_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").csv(path)


def parse_config(text: str) -> dict:
    return flatten(json.loads(text))
