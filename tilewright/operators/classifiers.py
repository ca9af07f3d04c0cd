"""Linear classifiers by Spark's own optimisers, and sweeps over feature settings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators import evaluate, linalg, solvers


def _vectors(matrix: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return matrix.select("i", array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"))


def logistic(matrix: DataFrame, reg: float = 1e-3, steps: int = 50) -> DataFrame:
    """(i, label, pred) of a multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression

    rows = _vectors(matrix)
    fitted = LogisticRegression(featuresCol="x", labelCol="label", regParam=reg, maxIter=steps).fit(rows)
    return fitted.transform(rows).select("i", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def support_vectors(matrix: DataFrame, reg: float = 1e-3, steps: int = 20) -> DataFrame:
    """(i, label, pred) of linear support vector machines, one against the rest."""
    from pyspark.ml.classification import LinearSVC, OneVsRest

    rows = _vectors(matrix).persist()
    fitted = OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=steps), featuresCol="x", labelCol="label").fit(rows)
    return fitted.transform(rows).select("i", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"))


def sweep_features(matrix: DataFrame, settings: list[float], featurize: Callable[[DataFrame, float], DataFrame], reg: float) -> DataFrame:
    """(setting, train_acc): features for each setting, ridge on them, and its accuracy."""
    found = []
    for s in settings:
        x = featurize(matrix, s).join(matrix.select("i", "label"), "i").persist()
        acc = solvers.scores(x, {"w": solvers.ridge(x, reg)}).agg(evaluate.accuracy(evaluate.argmax(F.col("scores")), F.col("label"))).first()[0]
        found.append((float(s), float(acc)))
        x.unpersist()
    return matrix.sparkSession.createDataFrame(found, "setting double, train_acc double")


def coords_multiplier(coords: DataFrame, n: int, reg: float) -> Callable[[np.ndarray], np.ndarray]:
    """(K + reg I) p for a sparse K by coordinates: a join and a sum for each product; p is n x C on the driver."""
    kept = coords.persist()
    spark = coords.sparkSession

    def multiply(p: np.ndarray) -> np.ndarray:
        x = spark.createDataFrame([(int(j), int(c), float(p[j, c])) for j, c in zip(*np.nonzero(p), strict=True)], "j int, class int, w double")
        out = reg * p
        for r in linalg.matvec(kept, F.broadcast(x)).collect():
            out[r["i"], r["class"]] += r["v"]
        return out

    return multiply


def median_pair_distance(matrix: DataFrame, seed: int = 0) -> DataFrame:
    """(median) of the distances of pairs drawn at random: each row with the next one of a seeded permutation."""
    from tilewright.functions.vectors import l2
    from tilewright.operators.blocks import shuffled

    placed = shuffled(matrix.select("i", l2(F.col("features")).alias("a")), "i", seed)
    after = placed.select((F.col("place") - 1).alias("place"), F.col("a").alias("b"))
    d = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    found = placed.join(after, "place").select(d.alias("d"))
    return matrix.sparkSession.createDataFrame([(linalg.median(found, "d"),)], "median double")
