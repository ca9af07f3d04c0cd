"""Operators on sequences of frames and on orders of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import seeded


def frame_stack(df: DataFrame, episode: str | None, order: str, value: str, size: int = 4) -> DataFrame:
    """Keeps the rows with ``size - 1`` rows before them, and adds ``stack``, those and its own value in order.

    Stacks do not cross episodes; with ``episode`` None all rows are one sequence, in one task.
    """
    w = (Window.partitionBy(episode) if episode else Window).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("stack", F.collect_list(value).over(w)).where(F.size("stack") == size)


def lag_stack(df: DataFrame, episode: str, order: str, value: str, size: int = 4) -> DataFrame:
    """Adds ``lags``: the current value and the ``size - 1`` before it, padded on the left by the episode's first."""
    w = Window.partitionBy(episode).orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("lags", F.array(*[F.coalesce(F.lag(value, k).over(w), first) if k else F.col(value) for k in range(size - 1, -1, -1)]))


def stride(df: DataFrame, place: str, step: int) -> DataFrame:
    """Every step-th frame."""
    return df.where(F.col(place) % step == 0)


def offsets(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """Adds ``start``, the sum of the counts before each row; for tables of classes, which are small."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def top_by(df: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """The n rows of the largest value; ties by another column. Each task keeps n rows."""
    return df.orderBy(F.desc(value), tie).limit(n)


def sample_without(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows at random, the same for the same seed: the first ones of a seeded order. Each task keeps n rows."""
    return df.orderBy(seeded.order(seed, id_col), id_col).limit(n)


def sample_with(df: DataFrame, id_col: str, place: str, n: int, total: int, seed: int) -> DataFrame:
    """n draws with replacement from rows at dense places 0 .. total - 1: (draw, ...)."""
    draw = F.conv(F.substring(seeded.order(seed, "id"), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(draw * total).alias(place))
    return draws.join(df, place)
