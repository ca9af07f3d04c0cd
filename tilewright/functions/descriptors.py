"""Dense gradient descriptors, Fisher vectors and network layers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import seeded
from tilewright.functions.images import pooled, smooth
from tilewright.operators.linalg import _matrix
from tilewright.operators.solvers import posteriors

ANGLES, BINS, SHARPNESS = 8, 4, 9


def edge_filters(sigma: float) -> np.ndarray:
    """Derivatives down and across of a Gaussian of 2 ceil(sigma) pixels to each side, of absolute sum 2."""
    r = int(2 * np.ceil(sigma))
    g = np.exp(-np.add.outer(np.arange(-r, r + 1) ** 2, np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    both = np.stack(np.gradient(g / g.sum()))
    return 2 * both / np.abs(both).sum((1, 2), keepdims=True)


def grid_starts(n: int, patch: int, step: int) -> np.ndarray:
    """Places every ``step`` pixels, what is left over being shared by both sides."""
    return np.arange((n - patch) % step // 2, n - patch + 1, step)


def dense_sift(x: np.ndarray, patch: int = 16, step: int = 4, sigma: float = 0.8, clip: float = 0.2, least: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """n x 128 descriptors of one h x w image, and the corners (y, x) of their patches, down the columns of a centred grid.

    A descriptor has for each of 8 directions the gradients weighted into 4 x 4 bins, rows of bins first. Those of a norm
    below ``least`` are divided by it and clipped; others are normalised, clipped and normalised again.
    """
    f = edge_filters(sigma)
    r = f.shape[1] // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x.astype(float), r), f.shape[1:])
    gy, gx = np.einsum("yxij,kij->kyx", view, f[:, ::-1, ::-1])
    size, way = np.hypot(gx, gy), np.arctan2(gy, gx)
    by_angle = np.stack([np.maximum(np.cos(way - 2 * np.pi * k / ANGLES), 0) ** SHARPNESS * size for k in range(ANGLES)])
    width = patch / BINS
    weight = np.maximum(1 - np.abs(np.arange(patch)[None] - ((np.arange(BINS) + 0.5) * width - 0.5)[:, None]) / width, 0)
    ys, xs = (grid_starts(n, patch, step) for n in x.shape)
    parts = np.lib.stride_tricks.sliding_window_view(by_angle, (patch, patch), axis=(1, 2))[:, ys][:, :, xs]
    d = np.einsum("ayxij,pi,qj->xyapq", parts, weight, weight).reshape(-1, BINS * BINS * ANGLES)
    n = np.linalg.norm(d, axis=1, keepdims=True)
    clipped = np.minimum(d / np.maximum(n, least), clip)
    again = clipped / np.maximum(np.linalg.norm(clipped, axis=1, keepdims=True), 1e-300)
    return np.where(n >= least, again, clipped), np.stack([np.tile(ys, len(xs)), np.repeat(xs, len(ys))], 1)


def sift_table(images: DataFrame, h: int, w: int, patch: int = 16, step: int = 4, sigmas: tuple[float, ...] = (0.8,)) -> DataFrame:
    """(i, pos, y, x, features) of grey images (i, features): a row for each grid position of each smoothing scale, with its corner.

    A patch of the image's own size is the whole image as one patch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for key, x in zip(b.column(0).to_pylist(), _matrix(b.column(1)), strict=True):
                    d, at = (np.concatenate(z) for z in zip(*(dense_sift(x.reshape(h, w), patch, step, s) for s in sigmas), strict=True))
                    y0, x0 = at.T.astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(d), pa.int64()), pa.array(range(len(d)), pa.int32()), pa.array(y0), pa.array(x0), pa.array(list(d), pa.list_(pa.float64()))], names=["i", "pos", "y", "x", "features"])

    return images.select("i", "features").mapInArrow(run, "i long, pos int, y int, x int, features array<double>")


def sample_descriptors(descriptors: DataFrame, per_image: int, total: int, seed: int) -> DataFrame:
    """At most so many descriptors of each image, and of those so many in all, by seeded orders."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("i").orderBy(seeded.order(seed, "i", "pos"), "pos"))
    return descriptors.withColumn("r", r).where(F.col("r") <= per_image).drop("r").orderBy(seeded.order(seed + 1, "i", "pos"), "i", "pos").limit(total)


def fisher_vectors(descriptors: DataFrame, shares: np.ndarray, means: np.ndarray, variances: np.ndarray, improved: bool = False) -> DataFrame:
    """(i, features) for descriptors (i, pos, features): derivatives by share, mean and deviation, of length K + 2 K D.

    ``improved``: by mean and deviation only, with the normalisers 1 / sqrt(share) and 1 / sqrt(2 share), of length 2 K D.
    Tasks send sums of each image, which add up; nothing gathers an image's descriptors.
    """
    k, d = means.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, x = b.column(0).to_numpy(), _matrix(b.column(1))
                q = posteriors(x, shares, means, variances)
                z = (x[:, None] - means[None]) / np.sqrt(variances)[None]
                g = np.concatenate([q - shares, (q[:, :, None] * z).reshape(len(x), -1), (q[:, :, None] * (z * z - 1)).reshape(len(x), -1), np.ones((len(x), 1))], 1)
                each, back = np.unique(ids, return_inverse=True)
                total = np.zeros((len(each), g.shape[1]))
                np.add.at(total, back, g)
                n = total.shape[1]
                yield pa.RecordBatch.from_pydict({"i": np.repeat(each, n), "k": np.tile(np.arange(n, dtype=np.int32), len(each)), "v": total.ravel()})

    cells = descriptors.select("i", "features").mapInArrow(sums, "i long, k int, v double").groupBy("i", "k").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("g"))
    last = F.element_at("g", -1)
    root = np.sqrt(shares)
    scale = np.concatenate([np.zeros(0) if improved else 1 / root, np.repeat(1 / root, d), np.repeat(1 / np.sqrt(2 * shares), d)])
    part = F.slice("g", k + 1, 2 * k * d) if improved else F.slice("g", 1, k + 2 * k * d)
    return rows.select("i", F.zip_with(part, F.array(*[F.lit(float(s)) for s in scale]), lambda v, s: v * s / last).alias("features"))


def fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two feature tables side by side, each over its norm."""
    from tilewright.functions.vectors import l2

    return a.select("i", l2(F.col("features")).alias("a")).join(b.select("i", l2(F.col("features")).alias("b")), "i").select("i", F.concat("a", "b").alias("features"))


def network(layers: list[tuple], upto: str | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A forward pass for :func:`images.map_images` with weights of the caller's, up to a named layer.

    Layers: (name, "conv", weights n x c x s x s, bias, pad), (name, "dense", weights d x m, bias), (name, "relu"),
    (name, "prelu", slope), (name, "pool", size, stride, kind), (name, "flatten"), (name, "softmax").
    """

    def run(x: np.ndarray) -> np.ndarray:
        for name, kind, *args in layers:
            if kind == "conv":
                w, bias, pad = args
                p = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
                view = np.lib.stride_tricks.sliding_window_view(p, w.shape[2:], axis=(2, 3))
                x = np.einsum("nchwij,kcij->nkhw", view, w) + bias[:, None, None]
            elif kind == "dense":
                x = x.reshape(len(x), -1) @ args[0] + args[1]
            elif kind == "relu":
                x = np.maximum(x, 0)
            elif kind == "prelu":
                x = np.where(x > 0, x, args[0] * x)
            elif kind == "pool":
                x = pooled(x, *args)
            elif kind == "flatten":
                x = x.reshape(len(x), -1)
            elif kind == "softmax":
                e = np.exp(x - x.max(-1, keepdims=True))
                x = e / e.sum(-1, keepdims=True)
            else:
                raise ValueError(f"no layer {kind!r}")
            if name == upto:
                break
        return x

    return run


#: The layers of the two published networks whose names callers ask for; weights are the caller's.
SMALL_NET = [("conv0", "conv"), ("relu0", "relu"), ("pool0", "pool"), ("conv1", "conv"), ("relu1", "relu"), ("pool1", "pool"), ("conv2", "conv"), ("relu2", "relu"), ("pool2", "pool"), ("conv3", "conv"), ("fc0", "dense"), ("prelu", "prelu")]


def deep_net() -> list[tuple[str, str]]:
    """13 convolutions in 5 blocks, each with a relu and each block with a pool, then three dense layers."""
    out: list[tuple[str, str]] = []
    for block, n in enumerate((2, 2, 3, 3, 3), 1):
        for k in range(1, n + 1):
            out.append((f"conv{block}_{k}", "conv"))
        out.append((f"pool{block}", "pool"))
    return out + [("fc1", "dense"), ("fc2", "dense"), ("fc3", "dense"), ("probs", "softmax")]
