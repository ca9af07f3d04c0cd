"""Features of images.

An image table has (id, px), px being flat in channels, rows, columns; its shape (c, h, w) is an argument. Pixel tables
have a row for each pixel: (id, c, y, x, v).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import seeded
from tilewright.operators.linalg import _matrix


def pixels(images: DataFrame, shape: tuple[int, int, int], id_col: str = "i", vector_col: str = "features") -> DataFrame:
    c, h, w = shape
    k = F.col("k")
    cells = images.select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("k", "v"))
    return cells.select("id", F.floor(k / (h * w)).cast("int").alias("c"), F.floor(k % (h * w) / w).cast("int").alias("y"), (k % w).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def map_images(images: DataFrame, shape: tuple[int, int, int], f: Callable[[np.ndarray], np.ndarray], id_col: str = "i", vector_col: str = "features") -> DataFrame:
    """A function of batches n x c x h x w to vectors; (i, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                y = f(_matrix(part.column(1)).reshape(-1, *shape))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y.reshape(len(y), -1)), pa.list_(pa.float64()))], names=["i", "features"])

    return images.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("features")).mapInArrow(run, "i long, features array<double>")


def density(px: DataFrame, h: int, w: int, cell_h: int = 10, cell_w: int = 10) -> DataFrame:
    """(id, c, cy, cx, v): the mean over each cell; rows and columns beyond whole cells are dropped."""
    whole = px.where((F.col("y") < h // cell_h * cell_h) & (F.col("x") < w // cell_w * cell_w))
    return whole.groupBy("id", "c", F.floor(F.col("y") / cell_h).cast("int").alias("cy"), F.floor(F.col("x") / cell_w).cast("int").alias("cx")).agg((F.sum("v") / (cell_h * cell_w)).alias("v"))


def grey(px: DataFrame, weights: tuple[float, ...] = (0.2125, 0.7154, 0.0721)) -> DataFrame:
    """(id, c = 0, y, x, v): the weighted sum of the channels; one channel stays as it is."""
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("c") + 1)
    single = F.max("c") == 0
    return px.groupBy("id", "y", "x").agg(F.when(single, F.sum("v")).otherwise(F.sum(F.col("v") * weight)).alias("v")).select("id", F.lit(0).alias("c"), "y", "x", "v")


def threshold(cells: DataFrame, above: float = 0.15) -> DataFrame:
    return cells.withColumn("v", F.col("v") > above)


def cell_means(cell_h: int = 10, cell_w: int = 10) -> Callable[[np.ndarray], np.ndarray]:
    """As :func:`density`, for :func:`map_images`: nothing is shuffled."""

    def run(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        whole = x[:, :, : h // cell_h * cell_h, : w // cell_w * cell_w]
        return whole.reshape(n, c, h // cell_h, cell_h, w // cell_w, cell_w).mean((3, 5))

    return run


def part_statistics(size: int, step: int = 1, joint: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """For :func:`map_images`: mean and population deviation of square parts on a grid, of each channel or, ``joint``, of all together."""

    def run(x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, (size, size), axis=(2, 3))[:, :, ::step, ::step]
        axes = (1, 4, 5) if joint else (4, 5)
        return np.stack([view.mean(axes), view.std(axes)], -1)

    return run


def patches(px: DataFrame, shape: tuple[int, int, int], size: int, stride: int = 1) -> DataFrame:
    """(id, py, px, c, dy, dx, v): the pixels of all overlapping patches. A pixel finds its patches; nothing is joined."""
    _, h, w = shape

    def starts(at: str, n: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - (size - 1)) / stride).cast("int"))
        high = F.least(F.lit((n - size) // stride), F.floor(F.col(at) / stride).cast("int"))
        return F.when(low <= high, F.sequence(low, high))

    rows = px.withColumn("py", F.explode(starts("y", h))).withColumn("px", F.explode(starts("x", w)))
    return rows.select("id", "py", "px", "c", (F.col("y") - F.col("py") * stride).alias("dy"), (F.col("x") - F.col("px") * stride).alias("dx"), "v")


def patch_statistics(parts: DataFrame) -> DataFrame:
    """(id, py, px, m, s): the mean and population deviation of each patch."""
    return parts.groupBy("id", "py", "px").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))


def local_statistics(px: DataFrame, h: int, w: int, size: int, step: int) -> DataFrame:
    """(id, c, gy, gx, m, s) of square parts on a grid: local colour statistics."""
    return patches(px, (1, h, w), size, step).groupBy("id", "c", F.col("py").alias("gy"), F.col("px").alias("gx")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))


def empirical_filters(parts: DataFrame, n: int, upsample: int, tol: float, seed: int) -> DataFrame:
    """The n of n * upsample sampled patches with the largest variance above ``tol``: (id, py, px, patch, var)."""
    order = F.array_sort(F.collect_list(F.struct("c", "dy", "dx", "v")))
    flat = parts.groupBy("id", "py", "px").agg(F.transform(order, lambda s: s["v"]).alias("patch"), F.var_pop("v").alias("var"))
    some = flat.orderBy(F.xxhash64("id", "py", "px", F.lit(seed)), "id", "py", "px").limit(n * upsample)
    return some.where(F.col("var") > tol).orderBy(F.desc("var"), "id", "py", "px").limit(n)


def gaussian_filters(n: int, c: int, size: int, bandwidth: float, seed: int = 0) -> np.ndarray:
    return seeded.normals((n, c, size, size), seed, "filter") * bandwidth


def gabor_filters(n: int, c: int, size: int, seed: int = 0) -> np.ndarray:
    """Random orientations, wave lengths and phases under a Gaussian window."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size] - (size - 1) / 2
    out = np.empty((n, c, size, size))
    for k in range(n):
        theta, wave, phase = rng.uniform(0, np.pi), rng.uniform(2, size), rng.uniform(0, 2 * np.pi)
        u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
        out[k] = np.exp(-(u * u + 0.25 * v * v) / (2 * (size / 4) ** 2)) * np.cos(2 * np.pi * u / wave + phase)
    return out


def conv_shape(n: int, h: int, w: int, filters: int, size: int, stride: int, pool: int, pool_stride: int, ceil_mode: bool = False) -> tuple[int, int, int, int]:
    """The shape of :func:`convolve`'s features."""

    def side(k: int) -> int:
        k = (k - size) // stride + 1
        return (-(-(k - pool) // pool_stride) if ceil_mode else (k - pool) // pool_stride) + 1

    return n, 2 * filters, side(h), side(w)


def smallest_pools(spark, side: int, low: int = 50, want: int = 2, stride: int = 14) -> DataFrame:
    """(patch, pool): for each patch size the smallest pool, from ``low``, whose output is want x want."""
    p = spark.range(1, side).select(F.col("id").cast("int").alias("patch")).withColumn("pool", F.explode(F.sequence(F.lit(low), F.lit(side))))
    out = F.floor((F.lit(side) - F.col("patch") + 1 - F.col("pool")) / stride) + 1
    return p.where(out == want).groupBy("patch").agg(F.min("pool").alias("pool"))


def pooled(x: np.ndarray, pool: int, stride: int, kind: str = "avg", ceil_mode: bool = False) -> np.ndarray:
    """Pooling of n x c x h x w; with ceil_mode the last windows are cut short."""
    f = {"avg": np.mean, "max": np.max}[kind]
    side = [(-(-(k - pool) // stride) if ceil_mode else (k - pool) // stride) + 1 for k in x.shape[2:]]
    out = np.empty((*x.shape[:2], *side))
    for i in range(side[0]):
        for j in range(side[1]):
            out[:, :, i, j] = f(x[:, :, i * stride : i * stride + pool, j * stride : j * stride + pool], axis=(2, 3))
    return out


def convolve(filters: np.ndarray, bias: float, pool: int, pool_stride: int, stride: int = 1, pad: int = 0, kind: str = "avg", ceil_mode: bool = False, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A function for :func:`map_images`: correlation, relu(c - bias) and relu(-c - bias), pooling, channels side by side."""
    n, c, s, _ = filters.shape
    flat = filters.reshape(n, -1)

    def run(x: np.ndarray) -> np.ndarray:
        x = prepare(x) if prepare else x
        if pad:
            x = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)))
        view = np.lib.stride_tricks.sliding_window_view(x, (s, s), axis=(2, 3))[:, :, ::stride, ::stride]
        h, w = view.shape[2:4]
        rows = view.transpose(0, 2, 3, 1, 4, 5).reshape(-1, c * s * s)
        y = (rows @ flat.T).reshape(len(x), h, w, n).transpose(0, 3, 1, 2)
        return pooled(np.concatenate([np.maximum(y - bias, 0), np.maximum(-y - bias, 0)], 1), pool, pool_stride, kind, ceil_mode)

    return run


def sample_patches(images: DataFrame, shape: tuple[int, int, int], size: int, per_image: int, seed: int) -> DataFrame:
    """(i, k, features): random patches of each image, the same for the same seed and image id."""
    c, h, w = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ks, out = [], [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v).reshape(c, h, w)
                for k in range(per_image):
                    y0, x0 = (int(seeded.uniform(seed, key, k, a) * (n - size + 1)) for a, n in (("y", h), ("x", w)))
                    ids.append(key)
                    ks.append(k)
                    out.append(x[:, y0 : y0 + size, x0 : x0 + size].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=["i", "k", "features"])

    return images.select("i", "features").mapInArrow(run, "i long, k int, features array<double>")


def augment(images: DataFrame, shape: tuple[int, int, int], size: int, copies: int, seed: int) -> DataFrame:
    """(i, copy, features): random crops, flipped at random, with their source's id."""
    c, h, w = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ks, out = [], [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v).reshape(c, h, w)
                for k in range(copies):
                    y0, x0 = (int(seeded.uniform(seed, key, k, a) * (n - size + 1)) for a, n in (("y", h), ("x", w)))
                    part = x[:, y0 : y0 + size, x0 : x0 + size]
                    ids.append(key)
                    ks.append(k)
                    out.append((part[:, :, ::-1] if seeded.uniform(seed, key, k, "flip") < 0.5 else part).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int32()), pa.array(out, pa.list_(pa.float64()))], names=["i", "copy", "features"])

    return images.select("i", "features").mapInArrow(run, "i long, copy int, features array<double>")


def whitening(matrix: DataFrame, eps: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(means, Z) of ZCA: fitted by one pass of sums, a d x d eigenproblem on the driver."""
    from tilewright.operators.solvers import covariance

    mean, cov = covariance(matrix)
    values, vectors = np.linalg.eigh(cov)
    return mean, vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + eps)) @ vectors.T


def whiten(matrix: DataFrame, fitted: tuple[np.ndarray, np.ndarray], times: int = 1) -> DataFrame:
    from tilewright.operators.kernels import map_rows

    mean, z = fitted
    z = np.linalg.matrix_power(z, times)
    return map_rows(matrix, lambda x: (x - mean) @ z)


def resize(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned, of n x c x h x w."""
    sy, sx = ((np.arange(n) + 0.5) * k / n - 0.5 for n, k in ((h, x.shape[2]), (w, x.shape[3])))
    sy, sx = np.clip(sy, 0, x.shape[2] - 1), np.clip(sx, 0, x.shape[3] - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[2] - 1), np.minimum(x0 + 1, x.shape[3] - 1)
    fy, fx = (sy - y0)[:, None], sx - x0
    top = x[:, :, y0][:, :, :, x0] * (1 - fx) + x[:, :, y0][:, :, :, x1] * fx
    low = x[:, :, y1][:, :, :, x0] * (1 - fx) + x[:, :, y1][:, :, :, x1] * fx
    return top * (1 - fy) + low * fy


def colour_bins(px: DataFrame, bins: int, half_open: bool = False) -> DataFrame:
    """Adds ``bin``: values 0 .. 255 in equal bins of floor(255 / bins); the last is closed at 255, unless ``half_open``,
    where values beyond the whole bins have none."""
    width = 255 // bins
    b = F.floor(F.col("v") / width).cast("int")
    return px.withColumn("bin", F.when(b < bins, b) if half_open else F.least(b, F.lit(bins - 1)))


def edges(x: np.ndarray, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> np.ndarray:
    """Edges of images of h x w, the last axes: smoothed gradients, thinned across their direction, strong ones and weak ones that touch them."""
    s = smooth(x, sigma)
    gy, gx = np.gradient(s, axis=(-2, -1))
    size = np.hypot(gy, gx)
    way = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    edge = [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)]
    p = np.pad(size, edge)
    h, w = x.shape[-2:]
    at = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    thin = np.zeros_like(size, bool)
    for k, (dy, dx) in at.items():
        a, b = (p[..., 1 + t * dy : 1 + t * dy + h, 1 + t * dx : 1 + t * dx + w] for t in (1, -1))
        thin |= (way == k) & (size >= a) & (size >= b)
    strong, weak = thin & (size >= high), thin & (size >= low)
    while True:
        q = np.pad(strong, edge)
        near = np.any([q[..., i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0) & weak
        if (near == strong).all():
            return strong
        strong = near


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """A separable Gaussian over the last two axes, edges repeated."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r, r)
        x = np.moveaxis(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), 2 * r + 1, axis=axis) @ k, -1, -1)
    return x


def blobs(x: np.ndarray, sigmas: tuple[float, ...] = (1.0, 1.6, 2.56, 4.1), least: float = 0.05) -> list[tuple[int, int, float]]:
    """(y, x, radius) of the local maxima, over place and scale, of differences of Gaussians; radius is sigma sqrt(2)."""
    _, y, z, r = blobs_of(x[None], sigmas, least)
    return list(zip(y.tolist(), z.tolist(), r.tolist(), strict=True))


def blobs_of(x: np.ndarray, sigmas: tuple[float, ...] = (1.0, 1.6, 2.56, 4.1), least: float = 0.05) -> tuple[np.ndarray, ...]:
    """:func:`blobs` of n x h x w, as columns (image, y, x, radius) in the order of images and then of scales."""
    s = [smooth(x, k) for k in sigmas]
    d = np.stack([(a - b) * k for a, b, k in zip(s, s[1:], sigmas, strict=False)], 1)
    p = np.pad(d, [(0, 0), (1, 1), (1, 1), (1, 1)], constant_values=-np.inf)
    for axis in (1, 2, 3):
        n = d.shape[axis]
        p = np.maximum.reduce([p.take(range(t, t + n), axis) for t in range(3)])
    i, k, y, z = np.nonzero((d == p) & (d > least))
    return i, y, z, (np.array(sigmas) * np.sqrt(2))[k]


def blob_grid(bins: int, cell: int = 10) -> Callable[[np.ndarray], np.ndarray]:
    """For :func:`map_images`: by channel and colour bin, the radius of blobs of the bin's edges in the cells of a grid."""

    def run(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        out = np.zeros((n, c, bins, -(-h // cell), -(-w // cell)))
        width = 255 // bins
        together = max(1, (1 << 20) // (8 * h * w))  # images of a step, by what their smoothing holds
        for ch in range(c):
            for b in range(bins):
                inside = (x[:, ch] >= b * width) & ((x[:, ch] < (b + 1) * width) | (b == bins - 1))
                some = np.flatnonzero(inside.any((1, 2)))
                for at in range(0, len(some), together):
                    which = some[at : at + together]
                    i, y, z, r = blobs_of(edges(inside[which].astype(float)).astype(float))
                    out[which[i], ch, b, y // cell, z // cell] = r  # of several in a cell the last
        return out.reshape(n, -1)

    return run


def edge_share(cell: int = 10, above: float = 0.15) -> Callable[[np.ndarray], np.ndarray]:
    """For :func:`map_images`: whether the share of edge pixels in each whole cell is above a threshold."""

    def run(x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        e = np.array([[edges(x[i, k]) for k in range(c)] for i in range(n)], dtype=float)[:, :, : h // cell * cell, : w // cell * cell]
        return (e.reshape(n, c, h // cell, cell, w // cell, cell).mean((3, 5)) > above).astype(float)

    return run


def frame_features(patches: np.ndarray, batch: int = 64, batches: int = 8, pool: int = 150, bias: float = 0.0) -> tuple[Callable[[np.ndarray], np.ndarray], int]:
    """A convolution of frames by ``batch`` x ``batches`` empirical filters, its defaults being those of game frames (patches of
    10 x 10, pools of 150), and how many filters there are. ``patches`` is n x c x s x s; those of the largest variance are taken."""
    n = min(len(patches), batch * batches)
    best = np.argsort(-patches.reshape(len(patches), -1).var(1), kind="stable")[:n]
    return convolve(patches[best], bias, pool, pool), n


def featurize_missing(store, header, images: DataFrame, shape: tuple[int, int, int], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Features of dense images (i, features) for the row blocks of a stored matrix that aren't whole yet, added to the store; returns those
    blocks (bi). A run that stopped goes on from what it has written."""
    from tilewright.operators.layouts import rows_to_blocks
    from tilewright.runtime import cut

    wanted = cut(store.missing(header).select("bi").distinct(), "missing")
    rows = images.withColumn("bi", F.floor(F.col("i") / header.shard_0).cast("int")).join(F.broadcast(wanted), "bi", "left_semi")
    store.put(header, rows_to_blocks(map_images(rows, shape, f), header.shard_0, header.shard_1))
    return wanted
