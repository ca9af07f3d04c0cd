"""Products, sums and differences of matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import panels
from tilewright.operators.layouts import BLOCK_DDL, blocks_batch, tiles_of

#: A tile of a kernel from one of X Y' and the squared norms of the rows of X and of Y.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _matrix(column) -> np.ndarray:
    """A list column of equal lengths as a matrix, by its flat buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def gram(matrix: DataFrame) -> DataFrame:
    """(i, j, v) of X'X: each task sums the products of its batches, and the tasks' d x d sums are added up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            d = len(total)
            at = np.indices((d, d)).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"i": at[0], "j": at[1], "v": total.ravel()})

    return matrix.select("features").mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def cross_labels(matrix: DataFrame, n_classes: int | None = None) -> DataFrame:
    """(j, label, v) of X' onehot(y), for rows (i, features, label); classes are 0 .. n_classes - 1, absent ones 0."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x, y = _matrix(b.column(0)), b.column(1).to_numpy()
                for c in np.unique(y).tolist():
                    total[c] = total.get(c, 0.0) + x[y == c].sum(0)
        for c, v in total.items():
            yield pa.RecordBatch.from_pydict({"j": np.arange(len(v), dtype=np.int32), "label": np.full(len(v), c, np.int32), "v": v})

    sums = matrix.select("features", F.col("label").cast("int")).mapInArrow(partial, "j int, label int, v double").groupBy("j", "label").agg(F.sum("v").alias("v"))
    if n_classes is None:
        n_classes = (matrix.agg(F.max("label")).first()[0] or 0) + 1
    full = sums.select("j").distinct().select("j", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("label"))
    return full.join(sums, ["j", "label"], "left").select("j", "label", F.coalesce("v", F.lit(0.0)).alias("v"))


def product_coords(x: DataFrame, y: DataFrame, lower: bool = False) -> DataFrame:
    """X Y' of coordinate matrices, by a join on the inner index and a sum; lower: only i >= j, for equal inputs."""
    a, b = x.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("a")), y.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("b"))
    met = a.join(b, "k")
    if lower:
        met = met.where("i >= j")
    return met.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def product_blocks(x: DataFrame, y: DataFrame, lower: bool = False, finish: Finish | None = None, only: set[tuple[int, int]] | None = None) -> DataFrame:
    """X Y' of block matrices, products being added over inner blocks.

    The output tiles (bi, bj) have the row blocks of X by the row blocks of Y; lower: only bi >= bj; ``only``: those of these places. Tiles
    are written once, and tasks read those of the output tiles that they make, a few row blocks of X being held and those of Y
    read past them. ``finish`` makes the tile of a kernel of a product tile and the squared norms of its rows and columns.
    """
    parts = [_tile_parts(x)]
    parts.append(parts[0] if y is x else _tile_parts(y))
    sides = [_row_blocks(p) for p in parts]
    first = [[min(bi for bi, _ in s) for s in side] for side in sides]
    last = [[max(bi for bi, _ in s) for s in side] for side in sides]
    pairs = [(p, q) for p in range(len(sides[0])) for q in range(len(sides[1])) if not lower or last[0][p] >= first[1][q]]
    if only is not None:
        pairs = [(p, q) for p, q in pairs if any((i, j) in only for i, _ in sides[0][p] for j, _ in sides[1][q])]

    def multiply(work: list[tuple[int, int]], sides: list) -> Iterator[pa.RecordBatch]:
        held = None
        for p, q in work:
            if held is None or held[0] != p:
                held = (p, [(bi, _tiles_of(t)) for bi, t in sides[0][p]])
            out: list[tuple] = []
            size = 0
            for bj, t in sides[1][q]:
                y = None
                for bi, x in held[1]:
                    if (lower and bi < bj) or (only is not None and (bi, bj) not in only):
                        continue
                    y = _tiles_of(t) if y is None else y
                    both = x.keys() & y.keys()
                    if both:
                        total = sum(x[k] @ y[k].T for k in both)
                        if finish:
                            total = finish(total, *(sum((z * z).sum(1) for z in side.values()) for side in (x, y)))
                        out.append((bi, bj, *total.shape, np.ascontiguousarray(total).ravel()))
                        size += total.size
                        if size >= panels.CELLS:
                            yield blocks_batch(out)
                            out, size = [], 0
            if out:
                yield blocks_batch(out)

    return panels.tasks(x.sparkSession, panels.runs(pairs), multiply, BLOCK_DDL, sides)


def _tile_parts(blocks: DataFrame) -> list[panels.Part]:
    """Tiles as parts with the key (bi, bj)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch]]:
        for b in batches:
            for r, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                yield key, b.slice(r, 1)

    return panels.write(blocks.select("bi", "bj", "n_rows", "n_cols", "data"), "tiles", split)


def _row_blocks(parts: list[panels.Part]) -> list[list[tuple[int, list[panels.Part]]]]:
    """Lists of row blocks that follow each other, (bi, its tiles), which a task holds together."""
    rows: dict[int, list[panels.Part]] = {}
    for p in parts:
        rows.setdefault(p.key[0], []).append(p)
    each = max(1, min(16, -(-len(rows) // 16)))
    blocks = sorted(rows.items())
    return [blocks[at : at + each] for at in range(0, len(blocks), each)]


def _tiles_of(parts: list[panels.Part]) -> dict[int, np.ndarray]:
    """The tiles of a row block by their column block."""
    return {bj: t for p in parts for _, bj, t in tiles_of([p.read()])}


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


#: Columns of cells from a tile of X Y' and the squared norms of the rows of X and of Y.
Values = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def _values(finish: Finish | None) -> Values:
    return lambda p, x2, y2: [finish(p, x2, y2) if finish else p]


def _cell_tiles(work: list[tuple[int, int]], sides: list, values: Values, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray | None]]:
    """(ids of rows, ids of columns, tiles, which cells count) by pieces of the pairs of sides; lower: the cells i >= j of either order of a pair."""
    for (p, q), (i, x, j, y) in zip(work, panels.pairs_of(work, *sides), strict=True):
        for a, u, b, v in ((i, x, j, y), (j, y, i, x)) if lower and p != q else ((i, x, j, y),):
            if lower and a.max() < b.min():
                continue
            whole, v2, step = not lower or a.min() >= b.max(), _norms(v), max(1, panels.CELLS // len(b))
            for at in range(0, len(a), step):
                s, z = a[at : at + step], u[at : at + step]
                yield s, b, values(z @ v.T, _norms(z), v2), None if whole else s[:, None] >= b[None]


def _lower_pairs(parts: list[panels.Part]) -> tuple[list[list[tuple[int, int]]], list]:
    side = panels.sides(parts)
    return panels.runs([(p, q) for p in range(len(side)) for q in range(p + 1)]), [side, side]


def _cells(spark: SparkSession, work: list, sides: list, values: Values, lower: bool, names: list[str]) -> DataFrame:
    def run(work: list[tuple[int, int]], sides: list) -> Iterator[pa.RecordBatch]:
        for i, j, tiles, keep in _cell_tiles(work, sides, values, lower):
            cols = [np.repeat(i, len(j)), np.tile(j, len(i)), *(t.ravel() for t in tiles)]
            if keep is not None:
                keep = keep.ravel()
                cols = [c[keep] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["i", "j", *names])

    return panels.tasks(spark, work, run, ", ".join(["i long, j long", *(f"{n} double" for n in names)]), sides)


def self_product_rows(matrix: DataFrame, block: int = panels.PART_ROWS, finish: Finish | None = None) -> DataFrame:
    """(i, j, v), i >= j, of X X' (or a kernel of it) of a row matrix with any ids: n^2 / 2 cells, the size of the result. Tasks read
    the rows of two sides from files, so what is written besides the result is the matrix, once."""
    return _cells(matrix.sparkSession, *_lower_pairs(panels.of_rows(matrix, block)), _values(finish), True, ["v"])


def norms_of_pairs(matrix: DataFrame, block: int = panels.PART_ROWS) -> DataFrame:
    """(i, j, x2, y2), i >= j: the squared norms of both rows of each cell of X X', from the rows that make the cell."""
    return _cells(matrix.sparkSession, *_lower_pairs(panels.of_rows(matrix, block)), lambda p, x2, y2: list(np.broadcast_arrays(x2[:, None], y2[None])), True, ["x2", "y2"])


def difference_rows(matrix: DataFrame, f: Finish | None, g: Finish | None, block: int = panels.PART_ROWS) -> DataFrame:
    """(mean, max, frobenius) of the absolute differences of the cells i >= j of two kernels of a row matrix, as :func:`difference` of their
    cells. Tasks send four sums of the cells that they make; no cell is written or sent."""

    def sums(work: list[tuple[int, int]], sides: list) -> Iterator[pa.RecordBatch]:
        n, total, most, square = 0, 0.0, -np.inf, 0.0
        for _, _, (a, b), keep in _cell_tiles(work, sides, lambda *t: [k(*t) if k else t[0] for k in (f, g)], True):
            e = np.abs(a - b)
            e = e.ravel() if keep is None else e[keep]
            if len(e):
                n, total, most, square = n + len(e), total + e.sum(), np.maximum(most, e.max()), square + e @ e
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [float(total)], "m": [float(most)], "q": [float(square)]})

    work, sides = _lower_pairs(panels.of_rows(matrix, block))
    parts = panels.tasks(matrix.sparkSession, work, sums, "n long, s double, m double, q double", sides)
    return parts.agg((F.sum("s") / F.sum("n")).alias("mean"), F.max("m").alias("max"), F.sqrt(F.sum("q")).alias("frobenius"))


def cross_product_rows(a: DataFrame, b: DataFrame, block: int = panels.PART_ROWS, finish: Finish | None = None) -> DataFrame:
    """(i, j, v) of A B' (or a kernel of it) of two row matrices with any ids."""
    sides = [panels.sides(panels.of_rows(d, block)) for d in (a, b)]
    pairs = [(p, q) for p in range(len(sides[0])) for q in range(len(sides[1]))]
    return _cells(a.sparkSession, panels.runs(pairs), sides, _values(finish), False, ["v"])


def nearest_rows(a: DataFrame, b: DataFrame, k: int, block: int = panels.PART_ROWS, places: int = 9) -> DataFrame:
    """(i, j, v): for each row of A the k rows of B of the least squared distance, rounded; ties to the smaller id.

    A task keeps the k best of its rows of A over the rows of B that it reads, so what is ranked after it is k rows for each row and task.
    """
    from pyspark.sql import Window

    sides = [panels.sides(panels.of_rows(d, block)) for d in (a, b)]
    pairs = [(p, q) for p in range(len(sides[0])) for q in range(len(sides[1]))]

    def best(work: list[tuple[int, int]], sides: list) -> Iterator[pa.RecordBatch]:
        for p, run in groupby(work, lambda w: w[0]):
            ids = None
            for i, x, j, y in panels.pairs_of(list(run), *sides):
                if ids is None:
                    ids, x2, bound = i, _norms(x), np.full(len(i), np.inf)
                    row, at, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                y2, step = _norms(y), max(1, 8 * panels.CELLS // len(j))
                for lo in range(0, len(i), step):
                    z = slice(lo, lo + step)
                    d = np.round(np.maximum(x2[z, None] - 2 * (x[z] @ y.T) + y2[None], 0), places)
                    own = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                    r, c = np.nonzero(d <= np.minimum(bound[z], own)[:, None])
                    row, at, v = np.concatenate([row, r + lo]), np.concatenate([at, j[c]]), np.concatenate([v, d[r, c]])
                order = np.lexsort((at, v, row))
                row, at, v = row[order], at[order], v[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                bound[row[place == k - 1]] = v[place == k - 1]
                row, at, v = (c[place < k] for c in (row, at, v))
            yield pa.RecordBatch.from_pydict({"i": ids[row], "j": at, "v": v})

    found = panels.tasks(a.sparkSession, panels.runs(pairs), best, "i long, j long, v double", sides)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("v", "j"))).where(F.col("r") <= k).drop("r")


def matvec(k: DataFrame, x: DataFrame) -> DataFrame:
    """(i, class, v) of K w: K by coordinates, w as (j, class, w)."""
    return k.join(x, "j").groupBy("i", "class").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def square_norms(matrix: DataFrame) -> DataFrame:
    """(i, v): each row's sum of squares."""
    return matrix.select("i", F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x).alias("v"))


def square_norms_coords(coords: DataFrame) -> DataFrame:
    return coords.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("v"))


def row_means(matrix: DataFrame) -> DataFrame:
    """(i, mean, norm) of each row."""
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return matrix.select("i", (total / F.size("features")).alias("mean"), F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


def add(*matrices: DataFrame) -> DataFrame:
    """The sum of coordinate matrices."""
    total = matrices[0].select("i", "j", "v")
    for m in matrices[1:]:
        total = total.unionByName(m.select("i", "j", "v"))
    return total.groupBy("i", "j").agg(F.sum("v").alias("v"))


def diagonal(coords: DataFrame) -> DataFrame:
    """(mean, max) of the diagonal."""
    return coords.where("i = j").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mean, max, frobenius) of the absolute differences of two coordinate matrices, absent cells being 0."""
    d = a.select("i", "j", F.col("v").alias("a")).join(b.select("i", "j", F.col("v").alias("b")), ["i", "j"], "full_outer")
    e = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return d.agg(F.avg(e).alias("mean"), F.max(e).alias("max"), F.sqrt(F.sum(e * e)).alias("frobenius"))


def frobenius(coords: DataFrame) -> DataFrame:
    return coords.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def sparsity(coords: DataFrame) -> DataFrame:
    """The share of zeros among the cells given."""
    return coords.agg(F.avg((F.col("v") == 0).cast("double")).alias("sparsity"))


def bandwidth(matrix: DataFrame) -> DataFrame:
    """(median, max) of the squared row norms over the number of columns: a scale for kernels."""
    s = matrix.select((F.aggregate("features", F.lit(0.0), lambda t, x: t + x * x) / F.size("features")).alias("s"))
    return s.agg(F.max("s").alias("max")).select(F.lit(median(s, "s")).cast("double").alias("median"), "max")


def median(df: DataFrame, col: str, bins: int = 4096, few: int = 10_000) -> float | None:
    """The exact median of a column without nulls: passes that count values by bins of a range, each the bin or bins of the middle
    ranks of the one before, until few values are left or all are the same. A pass gives the driver one row for each bin."""
    v = F.col(col).cast("double")
    got = df.agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("z")).first()
    n, a, z, below = got["n"], got["a"], got["z"], 0
    if not n:
        return None
    ranks = ((n - 1) // 2, n // 2)
    left = n
    while left > few and a < z:
        k = F.least(F.floor((v - a) / (z - a) * bins), F.lit(bins - 1))
        rows = df.where(v.between(a, z)).groupBy(k.alias("k")).agg(F.count(v).alias("n"), F.min(v).alias("a"), F.max(v).alias("z")).orderBy("k").collect()
        at, kept = below, []
        for r in rows:
            if at <= ranks[1] and at + r["n"] > ranks[0]:
                kept.append((at, r))
            at += r["n"]
        below, a, z, left = kept[0][0], kept[0][1]["a"], kept[-1][1]["z"], sum(r["n"] for _, r in kept)
        if len(kept) > 1:  # the middle ranks are the last value of one bin and the first one of another
            return (kept[0][1]["z"] + kept[-1][1]["a"]) / 2
    if a == z:
        return a
    values = sorted(r[0] for r in df.where(v.between(a, z)).select(v).collect())
    return (values[ranks[0] - below] + values[ranks[1] - below]) / 2


def sampled_difference(a: DataFrame, b: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(bi, bj, max, frobenius) of the differences of n tiles, the same for the same seed, of two block matrices of equal tiles.

    The sample is drawn from the places alone, and only its tiles are read on. Tiles that would be made for it alone needn't all be:
    :func:`sampled_places` draws from a grid.
    """
    some = sampled_places(a.select("bi", "bj").join(b.select("bi", "bj"), ["bi", "bj"]), n, seed)
    met = a.select("bi", "bj", F.col("data").alias("a")).join(F.broadcast(some), ["bi", "bj"]).join(b.select("bi", "bj", F.col("data").alias("b")), ["bi", "bj"])
    d = met.select("bi", "bj", F.zip_with("a", "b", lambda x, y: F.abs(x - y)).alias("d"))
    return d.select("bi", "bj", F.array_max("d").alias("max"), F.sqrt(F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x)).alias("frobenius"))


def sampled_places(grid: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(bi, bj) of the n places of a grid that a seed draws first."""
    from tilewright.functions import seeded

    return grid.select("bi", "bj").orderBy(seeded.order(seed, "bi", "bj"), "bi", "bj").limit(n)
