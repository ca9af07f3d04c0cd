"""Kernels and distances, made of one linear kernel wherever that is enough."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import seeded
from tilewright.operators import linalg


def with_norms(kernel: DataFrame, row_norms: DataFrame, col_norms: DataFrame) -> DataFrame:
    """Adds ``x2`` and ``y2``, the squared norms of each cell's row and column."""
    return kernel.join(row_norms.select("i", F.col("v").alias("x2")), "i").join(col_norms.select(F.col("i").alias("j"), F.col("v").alias("y2")), "j")


def squared_distance(kernel: DataFrame, row_norms: DataFrame, col_norms: DataFrame) -> DataFrame:
    """(i, j, v): |x|^2 - 2 x.y + |y|^2, never below 0."""
    return with_norms(kernel, row_norms, col_norms).select("i", "j", F.greatest(F.lit(0.0), F.col("x2") - 2 * F.col("v") + F.col("y2")).alias("v"))


def rbf(kernel: DataFrame, row_norms: DataFrame, col_norms: DataFrame, gamma: float, num_features: int = 1) -> DataFrame:
    """exp(-gamma |x - y|^2 / num_features) from a linear kernel."""
    return squared_distance(kernel, row_norms, col_norms).withColumn("v", F.exp(-gamma * F.col("v") / num_features))


def quadratic(kernel: DataFrame, gamma: float) -> DataFrame:
    """(1 + gamma x.y)^2."""
    return kernel.withColumn("v", F.pow(1 + gamma * F.col("v"), F.lit(2.0)))


def elementwise_exp(kernel: DataFrame) -> DataFrame:
    return kernel.withColumn("v", F.exp("v"))


def diagonal_shift(kernel: DataFrame, offset: float) -> DataFrame:
    return kernel.withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + offset).otherwise(F.col("v")))


def of_rows(rows: DataFrame, cols: DataFrame | None, kind: str, gamma: float = 1.0, num_features: int = 1) -> DataFrame:
    """A kernel of row matrices: linear, rbf, quadratic, or the squared distance; with ``cols`` None the lower triangle of the rows' own.

    It is made tile by tile, with the norms of a tile's own rows, so cells are never shuffled.
    """
    finish = tile_function(kind, gamma, num_features)
    return linalg.self_product_rows(rows, finish=finish) if cols is None else linalg.cross_product_rows(rows, cols, finish=finish)


def tile_function(kind: str, gamma: float = 1.0, num_features: int = 1) -> linalg.Finish | None:
    """What makes a kernel's tile of a tile of products and the squared norms of its rows and columns."""

    def squared(p: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
        return np.maximum(x2[:, None] - 2 * p + y2[None], 0)

    kinds = {"linear": None, "quadratic": lambda p, x2, y2: (1 + gamma * p) ** 2, "distance": squared, "rbf": lambda p, x2, y2: np.exp(-gamma * squared(p, x2, y2) / num_features)}
    if kind not in kinds:
        raise ValueError(f"no kernel {kind!r}: {', '.join(kinds)}")
    return kinds[kind]


def blocks_of_rows(rows: DataFrame, kind: str, shard: int, gamma: float = 1.0, num_features: int = 1, only: set[tuple[int, int]] | None = None) -> DataFrame:
    """The lower tiles, bi >= bj, of the kernel of a row matrix with dense ids, or ``only`` those of some places."""
    from tilewright.operators.layouts import rows_to_blocks

    d = rows.select(F.size("features").alias("d")).first()["d"]
    tiles = rows_to_blocks(rows, shard, d)
    return linalg.product_blocks(tiles, tiles, True, tile_function(kind, gamma, num_features), only)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def random_fourier(matrix: DataFrame, n_features: int, gamma: float, seed: int = 0) -> DataFrame:
    """sqrt(2 / D) cos(W x + b): components whose products approach the rbf kernel. W and b are of a fixed size."""
    d = matrix.select(F.size("features").alias("d")).first()["d"]
    w, b = np.sqrt(2 * gamma) * seeded.normals((d, n_features), seed, "w"), 2 * np.pi * seeded.uniforms((n_features,), seed, "b")
    return map_rows(matrix, lambda x: np.sqrt(2 / n_features) * np.cos(x @ w + b))


def map_rows(matrix: DataFrame, f) -> DataFrame:
    """A function of matrices of rows applied to each batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = f(linalg._matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=["i", "features"])

    return matrix.select("i", "features").mapInArrow(run, "i long, features array<double>")


def landmarks(matrix: DataFrame, m: int, seed: int = 0) -> np.ndarray:
    """The first m rows of a seeded order: a bounded sample."""
    rows = matrix.orderBy(seeded.order(seed, "i"), "i").limit(m).collect()
    return np.array([r["features"] for r in rows])


def nystroem(matrix: DataFrame, marks: np.ndarray, gamma: float) -> DataFrame:
    """The lift of rows to K(x, Z) K(Z, Z)^(-1/2), whose products approach the rbf kernel."""

    def k(x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] - 2 * x @ marks.T + (marks * marks).sum(1)[None]
        return np.exp(-gamma * np.maximum(d, 0))

    values, vectors = np.linalg.eigh(k(marks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T
    return map_rows(matrix, lambda x: k(x) @ root)


def low_rank_inverse(z: np.ndarray, reg: float):
    """A function that multiplies by (Z Z' + reg I)^-1, by the Woodbury identity: (x - U'U x) / reg with L U = Z', L L' = Z'Z + reg I."""
    low = np.linalg.cholesky(z.T @ z + reg * np.eye(z.shape[1]))
    u = np.linalg.solve(low, z.T)
    return lambda x: (x - u.T @ (u @ x)) / reg
