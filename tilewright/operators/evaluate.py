"""Predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """The class of the largest score; of equal ones the lowest."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """The min(k, C) classes of the largest scores, best first; of equal ones the lower first."""
    ranked = F.array_sort(F.transform(scores, lambda s, c: F.struct((-s).alias("s"), c.cast("int").alias("c"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["c"])


def accuracy(predicted: Column, label: Column) -> Column:
    return F.avg((predicted == label).cast("double"))


def top_k_accuracy(scored: DataFrame, ks: list[int], *by: str) -> DataFrame:
    """(by, k, acc) for rows (by, label, scores)."""
    each = scored.select(*by, "label", "scores", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.array_contains(F.transform(F.slice(F.array_sort(F.transform("scores", lambda s, c: F.struct((-s).alias("s"), c.cast("int").alias("c")))), F.lit(1), F.col("k")), lambda x: x["c"]), F.col("label"))
    return each.groupBy(*by, "k").agg(F.avg(hit.cast("double")).alias("acc"))


def long_scores(scored: DataFrame) -> DataFrame:
    """(i, label, class, score)."""
    return scored.select("i", "label", F.posexplode("scores").alias("class", "score"))


def augmented(scores: DataFrame, source: str) -> DataFrame:
    """(source, class, score): the mean score over the copies of each source."""
    return scores.groupBy(source, "class").agg(F.avg("score").alias("score"))


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def split_tail(df: DataFrame, order: str, share: float = 0.9) -> DataFrame:
    """Adds ``is_train``: by position, the first floor(share n) rows. Ids that are dense positions need no sort."""
    from tilewright.operators.layouts import dense_index

    placed = dense_index(df, order, "_place")
    n = placed.count()
    return placed.withColumn("is_train", F.col("_place") < int(n * share)).drop("_place")


def split_files(names: DataFrame, n: int) -> DataFrame:
    """The first n file names for training, the next n for testing."""
    r = F.row_number().over(Window.orderBy("name"))
    return names.withColumn("r", r).where(F.col("r") <= 2 * n).select("name", (F.col("r") <= n).alias("is_train"))


def running_means(log: DataFrame, episode: str, order: str, value: str, last: int = 100) -> DataFrame:
    """Adds ``run_avg`` over all rows so far, and ``avg_last`` over the last so many."""
    w = Window.partitionBy(episode).orderBy(order)
    return log.withColumn("run_avg", F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("avg_last", F.avg(value).over(w.rowsBetween(1 - last, 0)))


def agreement(frames: DataFrame, episode: str, model: str, expert: str) -> DataFrame:
    """(episode, agreement): the share of frames in which two actions are equal."""
    return frames.groupBy(episode).agg(F.avg((F.col(model) == F.col(expert)).cast("double")).alias("agreement"))


def reward_statistics(log: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> tuple[DataFrame, DataFrame]:
    """(key, mean, std of the population) and the histogram (bin, n) of values in [low, high)."""
    stats = log.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    width = (high - low) / bins
    hist = log.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(F.floor((F.col(value) - low) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return stats, hist


def objective(model: DataFrame, predicted: DataFrame, labels: DataFrame, reg: float) -> DataFrame:
    """0.5 tr(w'Kw) + 0.5 reg |w|^2 - tr(y'w), for (i, class, w), K w as (i, class, v) and one-hot labels (i, class)."""
    m = model.join(predicted, ["i", "class"], "left").join(labels.select("i", "class", F.lit(1.0).alias("y")), ["i", "class"], "left")
    return m.agg((0.5 * F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))) + 0.5 * reg * F.sum(F.col("w") * F.col("w")) - F.sum(F.col("w") * F.coalesce("y", F.lit(0.0)))).alias("obj"))


def agreement_over_episodes(each: DataFrame, episode: str) -> DataFrame:
    """Adds ``mean``, over all episodes, and ``running``, over those so far, to :func:`agreement`'s rows, of which there is one for each
    episode."""
    every = Window.orderBy(episode)
    return each.withColumn("running", F.avg("agreement").over(every.rowsBetween(Window.unboundedPreceding, 0))).withColumn("mean", F.avg("agreement").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def test_saved(model: DataFrame, rows: DataFrame, source: str | None = None, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """(k, acc) of a saved model (j, label, w) on rows (i, features, label); with ``source`` the scores of its copies are averaged first.

    The model is d x C and goes to every task.
    """
    from tilewright.operators.solvers import scores

    got = model.select("j", "label", "w").toPandas()
    w = got.pivot(index="j", columns="label", values="w").to_numpy()
    scored = scores(rows, {"w": w})
    if source:
        mean = augmented(long_scores(scored).join(rows.select("i", source), "i"), source)
        packed = mean.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("class", "score"))), lambda s: s["score"]).alias("scores"))
        scored = packed.join(rows.groupBy(source).agg(F.min(F.col("label").cast("int")).alias("label")), source)
    return top_k_accuracy(scored, list(ks))
