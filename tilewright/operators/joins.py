"""Joins of frames, classes and blobs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_in_window(points: DataFrame, frame: str, height: int, width: int) -> DataFrame:
    """(frame, y, x, c1, dy, dx, c2, n): pairs of a frame's points whose offsets lie in [-h/2, h/2) x [-w/2, w/2).

    The frame is cut into cells of half a window; a point meets those of the cells around its own, so a frame with many
    points is spread over its cells and only neighbours meet. Points that coincide are counted first.
    """
    h, w = height // 2, width // 2
    points = points.groupBy(frame, "y", "x", "c").agg(F.count(F.lit(1)).alias("m"))
    a = points.select(frame, "y", "x", F.col("c").alias("c1"), F.col("m").alias("m1"), F.floor(F.col("y") / h).alias("cy"), F.floor(F.col("x") / w).alias("cx"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = points.select(frame, F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("c").alias("c2"), F.col("m").alias("m2"), near.alias("s"))
    b = b.select(frame, "y2", "x2", "c2", "m2", (F.floor(F.col("y2") / h) + F.col("s.i")).alias("cy"), (F.floor(F.col("x2") / w) + F.col("s.j")).alias("cx"))
    met = a.join(b, [frame, "cy", "cx"]).withColumns({"dy": F.col("y2") - F.col("y"), "dx": F.col("x2") - F.col("x")})
    inside = F.col("dy").between(-h, h - 1) & F.col("dx").between(-w, w - 1)
    return met.where(inside).groupBy(frame, "y", "x", "c1", "dy", "dx", "c2").agg(F.sum(F.col("m1") * F.col("m2")).alias("n"))


def offset_index(pairs: DataFrame, shape: tuple[int, int], window: tuple[int, int], colours: int) -> DataFrame:
    """Adds ``index`` to :func:`pairs_in_window`'s rows: the place of (y, x, c1, dy + h/2, dx + w/2, c2) in the flat tensor of all pairs of a
    frame, of h x w windows; colours are numbers below ``colours``. The rows are the tensor's only cells that aren't 0."""
    at = F.lit(0).cast("long")
    for value, size in (("y", shape[0]), ("x", shape[1]), ("c1", colours), (F.col("dy") + window[0] // 2, window[0]), (F.col("dx") + window[1] // 2, window[1]), ("c2", colours)):
        at = at * size + (F.col(value) if isinstance(value, str) else value)
    return pairs.withColumn("index", at)


#: Pairs that a task of :func:`all_pairs` holds at once, about.
PAIRS = 1 << 18
_NONE = -(1 << 40)


def all_pairs(points: DataFrame, frame: str) -> DataFrame:
    """(frame, c1, c2, dy, dx, n): offsets of all pairs of a frame's points, counted on distinct points; places are integers.

    A task counts the pairs of a few frames at a time, or of a part of a frame with many points, so its memory is that of a frame's counts and of
    ``PAIRS`` pairs, whatever the number of frames. Points without a frame have no pairs.
    """
    kinds = {f.name: f.dataType for f in points.schema}
    dealt = points.where(F.col(frame).isNotNull()).repartition(frame)
    p = dealt.groupBy(frame, "y", "x", "c").agg(F.count(F.lit(1)).alias("m")).select(F.col(frame).alias("f"), F.col("y").cast("long"), F.col("x").cast("long"), "c", "m")
    ddl = f"f {kinds[frame].simpleString()}, c1 {kinds['c'].simpleString()}, c2 {kinds['c'].simpleString()}, dy long, dx long, n long"
    found = p.sortWithinPartitions("f").mapInArrow(_count_pairs, ddl)
    return found.select(F.col("f").alias(frame), "c1", "c2", F.col("dy").cast(kinds["y"]).alias("dy"), F.col("dx").cast(kinds["x"]).alias("dx"), "n")


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of points (f, y, x, c, m) in the order of f."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        f = batch.column(0)
        if last is not None and f[0].as_py() != last:
            yield from _frame_pairs(held)
            held = []
        # the last frame may go on in the next batch
        code = f.dictionary_encode().indices.to_numpy()
        whole = int(np.searchsorted(code, code[-1]))
        if whole:
            yield from _frame_pairs([*held, batch.slice(0, whole)])
            held = []
        held.append(batch.slice(whole))
        last = f[batch.num_rows - 1].as_py()
    if held:
        yield from _frame_pairs(held)


def _frame_pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held).combine_chunks()
    frames, colours = (t.column(k).chunk(0).dictionary_encode(null_encoding="encode") for k in (0, 3))
    f, c = (d.indices.to_numpy().astype(np.int64) for d in (frames, colours))
    y, x = (t.column(k).fill_null(_NONE).to_numpy() for k in (1, 2))
    m = t.column(4).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    size = np.diff(np.concatenate([starts, [len(f)]]))
    at = 0
    while at < len(starts):
        total = np.cumsum(size[at:] ** 2)
        n = max(1, int(np.searchsorted(total, PAIRS, "right")))
        lo, hi = starts[at], starts[at + n - 1] + size[at + n - 1]
        first, each = np.repeat(starts[at : at + n], size[at : at + n]), np.repeat(size[at : at + n], size[at : at + n])
        step, parts = max(1, PAIRS // int(each.max())) if n == 1 else hi - lo, []
        for s in range(0, hi - lo, step):
            k = each[s : s + step]
            a = np.repeat(np.arange(lo + s, lo + s + len(k)), k)
            b = np.repeat(first[s : s + step], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            dy, dx = (np.where((v[a] == _NONE) | (v[b] == _NONE), _NONE, v[b] - v[a]) for v in (y, x))
            parts.append(_summed([f[a], c[a], c[b], dy, dx], m[a] * m[b]))
            if len(parts) == 8:
                parts = [_summed([np.concatenate(v) for v in zip(*(q[0] for q in parts), strict=True)], np.concatenate([q[1] for q in parts]))]
        (g, c1, c2, dy, dx), m_ = parts[0] if len(parts) == 1 else _summed([np.concatenate(v) for v in zip(*(q[0] for q in parts), strict=True)], np.concatenate([q[1] for q in parts]))
        names = [frames.dictionary.take(pa.array(g)), *(colours.dictionary.take(pa.array(v)) for v in (c1, c2))]
        yield pa.RecordBatch.from_arrays([*names, *(pa.array(v, mask=v == _NONE) for v in (dy, dx)), pa.array(m_)], names=["f", "c1", "c2", "dy", "dx", "n"])
        at += n


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of keys with the sums of n."""
    low, span = [int(k.min()) for k in keys], [int(k.max()) - int(k.min()) + 1 for k in keys]
    if math.prod(span) < 1 << 62:
        code = np.zeros(len(n), np.int64)
        for k, a, s in zip(keys, low, span, strict=True):
            code = code * s + (k - a)
        order = np.argsort(code, kind="stable")
    else:
        order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return [k[new] for k in keys], np.add.reduceat(n[order], new)


def class_index(classes: DataFrame, name: str) -> DataFrame:
    """(name, class): a class's place in the order of names, for lists of classes, which are small."""
    from pyspark.sql import Window

    return classes.select(name).distinct().withColumn("class", (F.row_number().over(Window.orderBy(name)) - 1).cast("int"))


def one_hot(labels: DataFrame, n_classes: int) -> DataFrame:
    """(i, class, v): a 1 for the label and 0 for the others."""
    return labels.select("i", "label", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class")).select("i", "class", (F.col("label") == F.col("class")).cast("double").alias("v"))


def label_subset(df: DataFrame, below: int) -> DataFrame:
    """The rows of the first classes."""
    return df.where(F.col("label") < below)


def labels_of_block(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids, "i", "left_semi")


def resume(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The work that is left."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
