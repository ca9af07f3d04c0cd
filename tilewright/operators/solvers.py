"""Least squares, kernel and softmax solvers.

Sums over rows are distributed; what a driver solves is of the size of the columns (d x d) or of one block, never of the
rows. Models that are iterated over rows of a kernel stay on the driver as n x C numbers, as their blocks are sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import linalg, panels

#: The regularisers of a sweep.
SWEEP = (1e-7, 1e-5, 1e-3, 1e-1, 1.0, 1e1, 1e2, 1e3, 1e5)


@dataclass
class NormalEquations:
    """X'X, X'onehot(y), and the number of rows: additive over rows, so parts can be summed in any order."""

    xtx: np.ndarray
    xty: np.ndarray
    n: int

    def __add__(self, other: NormalEquations) -> NormalEquations:
        c = max(self.xty.shape[1], other.xty.shape[1])
        a, b = (np.pad(m.xty, ((0, 0), (0, c - m.xty.shape[1]))) for m in (self, other))
        return NormalEquations(self.xtx + other.xtx, a + b, self.n + other.n)

    def solve(self, reg: float) -> np.ndarray | None:
        """The weights d x C, or None where the system is singular to working precision."""
        a = self.xtx + reg * np.eye(len(self.xtx))
        if np.linalg.cond(a) > 1e15:
            return None
        return np.linalg.solve(a, self.xty)

    def pseudo_solve(self) -> np.ndarray:
        return np.linalg.pinv(self.xtx) @ self.xty


def normal_equations(matrix: DataFrame, n_classes: int | None = None, weight: str | None = None) -> NormalEquations:
    """One pass over rows (i, features, label[, weight]); tasks send their d x (d + C) sums once.

    Weighted: X'WX and X'W onehot(y).
    """
    cols = ["features", F.col("label").cast("int").alias("label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xtx, xty, n = None, {}, 0
        for b in batches:
            if b.num_rows:
                x, y, w = linalg._matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
                xw = x * w[:, None]
                xtx = xw.T @ x if xtx is None else xtx + xw.T @ x
                n += len(x)
                for c in np.unique(y).tolist():
                    xty[c] = xty.get(c, 0.0) + xw[y == c].sum(0)
        if xtx is not None:
            rows = [(-1, xtx.ravel()), *xty.items()]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64())), pa.array([n] * len(rows), pa.int64())], names=["c", "v", "n"])

    parts = matrix.select(*cols).mapInArrow(partial, "c int, v array<double>, n long")
    # sums of arrays, by position, before anything reaches the driver
    cells = parts.select("c", "n", F.posexplode("v").alias("k", "x")).groupBy("c", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = cells.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n")).collect()
    by = {r["c"]: np.array(r["v"]) for r in got}
    if -1 not in by:
        raise ValueError("no rows")
    xtx = by.pop(-1)
    d = int(round(len(xtx) ** 0.5))
    c = n_classes or max(by) + 1
    xty = np.zeros((d, c))
    for k, v in by.items():
        xty[:, k] = v
    return NormalEquations(xtx.reshape(d, d), xty, max(r["n"] for r in got if r["c"] == -1))


def weights_frame(spark: SparkSession, w: np.ndarray) -> DataFrame:
    """A model d x C as (j, label, w)."""
    return spark.createDataFrame([(j, c, float(w[j, c])) for j in range(w.shape[0]) for c in range(w.shape[1])], "j int, label int, w double")


def ridge(matrix: DataFrame, reg: float, n_classes: int | None = None, weight: str | None = None) -> np.ndarray:
    """(X'X + reg I)^-1 X' onehot(y)."""
    w = normal_equations(matrix, n_classes, weight).solve(reg)
    if w is None:
        raise np.linalg.LinAlgError("the system is singular")
    return w


def scores(matrix: DataFrame, models: dict[object, np.ndarray]) -> DataFrame:
    """(i, label, model, scores): X w of several models in one pass; models are broadcast, d x C each."""
    keys, sent = list(models), matrix.sparkSession.sparkContext.broadcast(list(models.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = linalg._matrix(b.column(1))
                for k, w in enumerate(sent.value):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k] * b.num_rows, pa.int32()), pa.array(list(x @ w), pa.list_(pa.float64()))], names=["i", "label", "m", "scores"])

    out = matrix.select("i", "features", F.col("label").cast("int")).mapInArrow(run, "i long, label int, m int, scores array<double>")
    return out.withColumn("model", F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("m") + 1)).drop("m")


def sweep(train: DataFrame, test: DataFrame | None = None, regs: tuple[float, ...] = SWEEP, n_classes: int | None = None) -> DataFrame:
    """(reg, train_acc, test_acc, status): sums once, a small solve for each regulariser; status I where it is singular."""
    from tilewright.operators.evaluate import argmax

    spark = train.sparkSession
    eq = normal_equations(train, n_classes)
    solved = {r: w for r in regs if (w := eq.solve(r)) is not None}
    table = spark.createDataFrame([(k, r, "" if r in solved else "I") for k, r in enumerate(regs)], "place int, reg double, status string")
    for name, part in (("train_acc", train), ("test_acc", test)):
        if part is None or not solved:
            table = table.withColumn(name, F.lit(None).cast("double"))
            continue
        hit = (argmax(F.col("scores")) == F.col("label")).cast("double")
        acc = scores(part, solved).groupBy(F.col("model").alias("reg")).agg(F.avg(hit).alias(name))
        table = table.join(acc, "reg", "left")
    return table.select("place", "reg", "train_acc", "test_acc", "status")


def sweep_metrics(train: DataFrame, test: DataFrame, regs: tuple[float, ...] = SWEEP, n_classes: int | None = None) -> DataFrame:
    """(reg, train_top1, train_top5, test_top1, test_top5, seconds, status): the record of a sweep; seconds are those of each solve."""
    import time

    from tilewright.operators.evaluate import top_k_accuracy

    spark, eq = train.sparkSession, normal_equations(train, n_classes)
    solved, took = {}, []
    for k, r in enumerate(regs):
        began = time.perf_counter()
        w = eq.solve(r)
        took.append((k, r, time.perf_counter() - began, "" if w is not None else "I"))
        if w is not None:
            solved[r] = w
    table = spark.createDataFrame(took, "place int, reg double, seconds double, status string")
    for name, part in (("train", train), ("test", test)):
        acc = top_k_accuracy(scores(part, solved), [1, 5], "model").withColumnRenamed("model", "reg")
        both = acc.groupBy("reg").agg(F.max(F.when(F.col("k") == 1, F.col("acc"))).alias(f"{name}_top1"), F.max(F.when(F.col("k") == 5, F.col("acc"))).alias(f"{name}_top5"))
        table = table.join(both, "reg", "left")
    return table.select("place", "reg", "train_top1", "train_top5", "test_top1", "test_top5", "seconds", "status")


def best_of_sweep(results: DataFrame) -> DataFrame:
    """The row of the highest test accuracy, else train accuracy; of equal ones the first in the sweep's order."""
    return results.orderBy(F.coalesce("test_acc", "train_acc").desc_nulls_last(), "place").limit(1)


def dual(kernel: np.ndarray, y: np.ndarray, reg: float, total_features: float = 1.0, n_classes: int | None = None) -> np.ndarray:
    """(K / total_features + reg I)^-1 onehot(y), for kernels that fit the driver; others go to :func:`block_coordinate`."""
    c = n_classes or int(y.max()) + 1
    return np.linalg.solve(kernel / total_features + reg * np.eye(len(kernel)), np.eye(c)[y])


def leave_one_out(matrix: DataFrame, reg: float = 0.0, n_classes: int | None = None) -> DataFrame:
    """(i, label, scores) without the row's own part, in closed form: (s - h y) / (1 - h) with h = x'(X'X + reg I)^-1 x."""
    eq = normal_equations(matrix, n_classes)
    inverse = np.linalg.inv(eq.xtx + reg * np.eye(len(eq.xtx)))
    sent = matrix.sparkSession.sparkContext.broadcast((inverse, inverse @ eq.xty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inv, w = sent.value
        for b in batches:
            if b.num_rows:
                x, y = linalg._matrix(b.column(1)), b.column(2).to_numpy()
                h = np.einsum("ij,jk,ik->i", x, inv, x)[:, None]
                s = (x @ w - h * np.eye(w.shape[1])[y]) / (1 - h)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(list(s), pa.list_(pa.float64()))], names=["i", "label", "scores"])

    return matrix.select("i", "features", F.col("label").cast("int")).mapInArrow(run, "i long, label int, scores array<double>")


def rank_one(inverse: np.ndarray, x: np.ndarray, sign: float) -> np.ndarray:
    """The inverse of A + sign x x' from that of A."""
    u = inverse @ x
    return inverse - sign * np.outer(u, u) / (1 + sign * x @ u)


class BlockKernel:
    """A symmetric kernel as tiles (bi, bj, n_rows, n_cols, data), all of them or the lower ones, in a table partitioned by column block.

    Vectors and models are n x C arrays on the driver, which are broadcast: their size bounds n, the kernel's doesn't.
    """

    #: Blocks of rows that block descent asks for at once.
    together = 1

    def __init__(self, blocks: DataFrame, shard: int, lower: bool = False):
        self.blocks, self.shard, self.lower = blocks, shard, lower
        self.n_blocks = (blocks.agg(F.max("bi")).first()[0] or 0) + 1

    def _products(self, tiles: DataFrame, x: np.ndarray, only: int | None = None) -> dict[int, np.ndarray]:
        """For each block of rows the sum of its tiles' products with x; each task adds up its own and sends one for each block.

        Tiles whose part of x is zero give nothing. A lower tile also stands for its mirror image.
        """
        sent, shard, lower = self.blocks.sparkSession.sparkContext.broadcast(x), self.shard, self.lower

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                cols = [b.column(b.schema.get_field_index(c)) for c in ("bi", "bj", "n_rows", "n_cols")]
                data = b.column(b.schema.get_field_index("data"))
                for r in range(b.num_rows):
                    bi, bj, n, m = (c[r].as_py() for c in cols)
                    k = data[r].values.to_numpy(zero_copy_only=False).reshape(n, m)
                    for to, by, tile in ((bi, bj, k), (bj, bi, k.T)) if lower and bi != bj else ((bi, bj, k),):
                        part = sent.value[by * shard : by * shard + tile.shape[1]]
                        if (only is None or to == only) and part.any():
                            sums[to] = sums.get(to, 0.0) + tile @ part
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.ravel() for v in sums.values()], pa.list_(pa.float64()))], names=["b", "v"])

        out: dict[int, np.ndarray] = {}
        for r in tiles.mapInArrow(run, "b int, v array<double>").toLocalIterator():
            v = np.array(r["v"]).reshape(-1, x.shape[1])
            out[r["b"]] = out[r["b"]] + v if r["b"] in out else v
        sent.unpersist()
        return out

    def multiply(self, x: np.ndarray) -> np.ndarray:
        """K x."""
        out = np.zeros_like(x, dtype=np.float64)
        for b, v in self._products(self.blocks, x).items():
            out[b * self.shard : b * self.shard + len(v)] = v
        return out

    def tile(self, b: int) -> np.ndarray:
        """A diagonal tile."""
        r = self.blocks.where((F.col("bi") == b) & (F.col("bj") == b)).first()
        return np.array(r["data"]).reshape(r["n_rows"], r["n_cols"])

    def diagonal(self) -> np.ndarray:
        """The diagonal, a part of it from each diagonal tile."""
        n = F.col("n_cols")
        own = F.transform(F.sequence(F.lit(1), F.col("n_rows")), lambda k: F.element_at("data", ((k - 1) * n + k).cast("int")))
        rows = self.blocks.where("bi = bj").select("bi", own.alias("d")).orderBy("bi").collect()
        return np.concatenate([r["d"] for r in rows])

    def panel_product(self, b: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """K[b, :] x by the tiles of one block of rows (where only lower ones are there, also of its column), and the diagonal tile."""
        tiles = self.blocks.where((F.col("bi") == b) | (F.col("bj") == b)) if self.lower else self.blocks.where(F.col("bi") == b)
        own = self.tile(b)
        return self._products(tiles, x, b).get(b, np.zeros((len(own), x.shape[1]))), own

    def panel_products(self, group: list[int], x: np.ndarray) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """K[b, :] x of each of some blocks of rows, and the tiles of all pairs of them."""
        if len(set(group)) > 1:
            raise ValueError("one block at a time")
        kx, own = self.panel_product(group[0], x)
        return {group[0]: kx}, {(group[0], group[0]): own}


def _kernel_tile(finish: linalg.Finish | None, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = x @ y.T
    return finish(p, linalg._norms(x), linalg._norms(y)) if finish else p


class RowKernel:
    """A kernel of a row matrix (i, features) with dense ids, whose tiles are made from its rows where they are used: the rows are stored once, in files that
    tasks read; the n^2 cells nowhere. It takes the place of :class:`BlockKernel` where a stored kernel wouldn't fit.

    The products of a linear kernel are X (X' x), of two passes over the rows. Those of other kernels make each tile once a product, in
    memory that is bounded by the sides of a tile. Vectors are n x C arrays on the driver.
    """

    def __init__(self, matrix: DataFrame, shard: int, kind: str = "linear", gamma: float = 1.0, num_features: int = 1):
        from tilewright.operators.kernels import tile_function

        self.spark, self.shard, self.finish = matrix.sparkSession, shard, tile_function(kind, gamma, num_features)
        self._tile = partial(_kernel_tile, self.finish)
        self.parts = panels.of_rows(matrix)
        self.n = sum(p.n for p in self.parts)
        self.sides = panels.sides(self.parts)
        self.n_blocks, self.together = -(-self.n // shard), max(1, 2048 // shard)

    def _inner(self, x: np.ndarray) -> np.ndarray:
        """X' x."""

        def sums(work: list[int], shared: tuple) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for k in work:
                i, rows = panels.load(shared[0][k])
                total = total + rows.T @ shared[1][i]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()])], names=["v"])

        got = panels.gather(self.spark, panels.runs(list(range(len(self.sides))), 64), sums, "v binary", (self.sides, x))
        return sum(np.frombuffer(r["v"]).reshape(-1, x.shape[1]) for r in got)

    def _work(self, x: np.ndarray) -> tuple[list, Callable, object]:
        """The tasks of K x: each gives (ids, values) of the rows of its sides."""
        tile = self._tile
        if self.finish is None:
            shared, columns = self._inner(x), None
        else:
            shared, columns = x, list(range(len(self.sides)))

        def run(work: list[int], shared: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            sides, z = shared
            for k in work:
                i, rows = panels.load(sides[k])
                if columns is None:
                    yield i, rows @ z
                    continue
                total = np.zeros((len(i), z.shape[1]))
                for q in columns:
                    j, other = panels.load(sides[q])
                    step = max(1, 8 * panels.CELLS // len(j))
                    for at in range(0, len(i), step):
                        total[at : at + step] += tile(rows[at : at + step], other) @ z[j]
                yield i, total

        return [[k] for k in range(len(self.sides))], run, (self.sides, shared)

    def multiply(self, x: np.ndarray) -> np.ndarray:
        """K x."""
        work, run, shared = self._work(x)

        def packed(work: list[int], shared: tuple) -> Iterator[pa.RecordBatch]:
            for i, v in run(work, shared):
                yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([np.ascontiguousarray(v).tobytes()])], names=["i", "v"])

        out = np.zeros((self.n, x.shape[1]))
        for r in panels.gather(self.spark, work, packed, "i binary, v binary", shared):
            out[np.frombuffer(r["i"], np.int64)] = np.frombuffer(r["v"]).reshape(-1, x.shape[1])
        return out

    def scores(self, x: np.ndarray) -> DataFrame:
        """(i, class, s) of K x, which doesn't pass the driver."""
        work, run, shared = self._work(x)
        c = x.shape[1]

        def cells(work: list[int], shared: tuple) -> Iterator[pa.RecordBatch]:
            for i, v in run(work, shared):
                yield pa.RecordBatch.from_pydict({"i": np.repeat(i, c), "class": np.tile(np.arange(c, dtype=np.int32), len(i)), "s": v.ravel()})

        return panels.tasks(self.spark, work, cells, "i long, class int, s double", shared)

    def diagonal(self) -> np.ndarray:
        tile = self._tile

        def own(work: list[int], sides: list) -> Iterator[pa.RecordBatch]:
            for k in work:
                i, x = panels.load(sides[k])
                d = np.concatenate([np.diagonal(tile(x[at : at + 64], x[at : at + 64])) for at in range(0, len(i), 64)])
                yield pa.RecordBatch.from_arrays([pa.array([i.tobytes()]), pa.array([d.tobytes()])], names=["i", "v"])

        out = np.zeros(self.n)
        for r in panels.gather(self.spark, [[k] for k in range(len(self.sides))], own, "i binary, v binary", self.sides):
            out[np.frombuffer(r["i"], np.int64)] = np.frombuffer(r["v"])
        return out

    def panel_products(self, group: list[int], x: np.ndarray) -> tuple[dict[int, np.ndarray], dict[tuple[int, int], np.ndarray]]:
        """K[b, :] x of each of some blocks of rows, and the tiles of all pairs of them."""
        blocks = sorted(set(group))
        spans = [(b * self.shard, min(self.n, (b + 1) * self.shard)) for b in blocks]
        ids, found = panels.load([p for p in self.parts if any(p.key[0] < hi and p.key[1] >= lo for lo, hi in spans)])
        z = found[np.searchsorted(ids, np.concatenate([np.arange(*s) for s in spans]))]
        tile = self._tile

        def sums(work: list[int], shared: tuple) -> Iterator[pa.RecordBatch]:
            sides, z, x = shared
            total = np.zeros((len(z), x.shape[1]))
            for k in work:
                j, other = panels.load(sides[k])
                step = max(1, 8 * panels.CELLS // len(j))
                for at in range(0, len(z), step):
                    total[at : at + step] += tile(z[at : at + step], other) @ x[j]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        got = panels.gather(self.spark, panels.runs(list(range(len(self.sides))), 64), sums, "v binary", (self.sides, z, x))
        kx, own = sum(np.frombuffer(r["v"]).reshape(len(z), -1) for r in got), self._tile(z, z)
        place, at = {}, 0
        for b, (lo, hi) in zip(blocks, spans, strict=True):
            place[b] = slice(at, at + hi - lo)
            at += hi - lo
        return {b: kx[s] for b, s in place.items()}, {(b, c): own[s, t] for b, s in place.items() for c, t in place.items()}


def dual_blocks(kernel: BlockKernel | RowKernel, y: np.ndarray, reg: float, precondition: Callable[[np.ndarray], np.ndarray] | None = None, max_iter: int = 500, tol: float = 1e-11) -> np.ndarray:
    """(K + reg I)^-1 y by conjugate gradients, each step a product of the kernel; the diagonal preconditions by default."""
    how = precondition or jacobi(kernel.diagonal() + reg)
    return conjugate_gradient(lambda p: kernel.multiply(p) + reg * p, y, how, max_iter, tol)


def block_coordinate(kernel: BlockKernel | RowKernel, y: np.ndarray, reg: float, epochs: int = 10, seed: int = 0, shuffle: bool = True, with_replacement: bool = False, warm_start: np.ndarray | None = None, start_epoch: int = 0, start_block: int = 0, momentum: float = 0.0, on_block: Callable[..., None] | None = None, limit: float = 1e3) -> np.ndarray:
    """Solves (K + reg I) x = y by exact steps in one block of rows after the other (Gauss-Seidel).

    A kernel may give the products of several blocks at once; steps are then corrected by what the blocks before them changed, so they are those of
    one block after the other. ``momentum`` adds that share of an epoch's change to the next start. A residual that has grown ``limit`` times raises.
    ``start_epoch`` and ``start_block`` resume a run from its ``warm_start`` with the same order of blocks.
    """
    x = np.zeros_like(y, dtype=np.float64) if warm_start is None else warm_start.astype(np.float64).copy()
    before, first = x.copy(), None
    for epoch in range(epochs):
        rng = np.random.default_rng((seed, epoch))
        order = rng.integers(0, kernel.n_blocks, kernel.n_blocks) if with_replacement else rng.permutation(kernel.n_blocks) if shuffle else np.arange(kernel.n_blocks)
        if epoch < start_epoch:
            continue
        if momentum and epoch > start_epoch:
            x, before = x + momentum * (x - before), x.copy()
        todo = [b for k, b in enumerate(order.tolist()) if epoch > start_epoch or k >= start_block]
        for at in range(0, len(todo), kernel.together):
            group = todo[at : at + kernel.together]
            products, tiles = kernel.panel_products(group, x)
            changes: dict[int, np.ndarray] = {}  # of this group, which its products don't have yet
            for b in group:
                own = tiles[b, b]
                part = slice(b * kernel.shard, b * kernel.shard + len(own))
                kx = products[b] + sum(tiles[b, c] @ d for c, d in changes.items())
                residual = y[part] - kx - reg * x[part]
                size = float(np.linalg.norm(residual))
                first = first or max(size, 1e-300)
                if not size <= limit * first:
                    raise FloatingPointError("the residual diverges")
                step = np.linalg.solve(own + reg * np.eye(len(own)), residual)
                x[part] += step
                changes[b] = changes.get(b, 0.0) + step
                if on_block:
                    on_block(model=x, y=y, reg=reg, block=b, epoch=epoch)
    return x


def conjugate_gradient(multiply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, precondition: Callable[[np.ndarray], np.ndarray] = lambda r: r, max_iter: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Preconditioned conjugate gradients with a step of its own for each right-hand side."""
    x, r = np.zeros_like(b, dtype=np.float64), b.astype(np.float64).copy()
    z = precondition(r)
    p, rz = z.copy(), (r * z).sum(0)
    goal = tol * np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    for _ in range(max_iter):
        if (np.linalg.norm(r, axis=0) <= goal).all():
            break
        ap = multiply(p)
        alpha = rz / np.where((d := (p * ap).sum(0)) != 0, d, 1)
        x, r = x + alpha * p, r - alpha * ap
        z = precondition(r)
        new = (r * z).sum(0)
        p, rz = z + new / np.where(rz != 0, rz, 1) * p, new
    return x


def jacobi(diagonal: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda r: r / diagonal[:, None]


def softmax_regression(matrix: DataFrame, reg: float, steps: int = 50, rate: float = 1.0, n_classes: int | None = None, blocks: int = 1) -> np.ndarray:
    """Softmax regression by steps in the fixed metric X'X / n + reg I, on all features or on blocks of them in turn."""
    eq = normal_equations(matrix, n_classes)
    d, c = eq.xty.shape
    w, sc = np.zeros((d, c)), matrix.sparkSession.sparkContext
    rows = matrix.select("features", F.col("label").cast("int")).persist()
    parts = np.array_split(np.arange(d), blocks)
    for step in range(steps):
        sent = sc.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d, c))
            for b in batches:
                if b.num_rows:
                    x, y = linalg._matrix(b.column(0)), b.column(1).to_numpy()
                    s = x @ sent.value
                    p = np.exp(s - s.max(1, keepdims=True))
                    total += x.T @ (p / p.sum(1, keepdims=True) - np.eye(c)[y])
            yield pa.RecordBatch.from_arrays([pa.array(range(d * c), pa.int32()), pa.array(total.ravel())], names=["k", "g"])

        g = np.zeros(d * c)
        for r in rows.mapInArrow(gradient, "k int, g double").groupBy("k").agg(F.sum("g").alias("g")).collect():
            g[r["k"]] = r["g"]
        g = g.reshape(d, c) / eq.n + reg * w
        at = parts[step % blocks]
        w = w.copy()
        w[at] -= rate * np.linalg.solve(eq.xtx[np.ix_(at, at)] / eq.n + reg * np.eye(len(at)), g[at])
        sent.unpersist()
    rows.unpersist()
    return w


def gaussian_mixture(rows: DataFrame, k: int, steps: int = 20, floor: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, means, variances) of a diagonal mixture of vectors (i, features): EM whose sums are K x (1 + 2 D)."""
    from tilewright.operators.kernels import landmarks

    means = landmarks(rows, k, seed)
    d, sc = means.shape[1], rows.sparkSession.sparkContext
    shares, variances = np.full(k, 1 / k), np.ones((k, d))
    kept = rows.select("features").persist()
    for _ in range(steps):
        sent = sc.broadcast((shares, means, variances))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, 1 + 2 * d))
            for b in batches:
                if b.num_rows:
                    x = linalg._matrix(b.column(0))
                    q = posteriors(x, *sent.value)
                    total += np.concatenate([q.sum(0)[:, None], q.T @ x, q.T @ (x * x)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

        s = np.zeros(k * (1 + 2 * d))
        for r in kept.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            s[r["k"]] = r["v"]
        s = s.reshape(k, -1)
        n = np.maximum(s[:, :1], 1e-12)
        shares, means = (n / n.sum()).ravel(), s[:, 1 : 1 + d] / n
        variances = np.maximum(s[:, 1 + d :] / n - means**2, floor)
    kept.unpersist()
    return shares, means, variances


def posteriors(x: np.ndarray, shares: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    d = x[:, None] - means[None]
    log = np.log(shares) - 0.5 * (np.log(2 * np.pi * variances).sum(1) + (d * d / variances).sum(2))
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def principal_components(matrix: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, d x k axes) from one pass of sums; each axis has its largest component positive."""
    stats = covariance(matrix)
    values, vectors = np.linalg.eigh(stats[1])
    axes = vectors[:, np.argsort(-values)[:k]]
    return stats[0], axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def covariance(matrix: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariance, from X'X with a column of ones."""
    eq = normal_equations(matrix.select("i", F.concat("features", F.array(F.lit(1.0))).alias("features"), F.lit(0).alias("label")))
    n = eq.xtx[-1, -1]
    mean = eq.xtx[-1, :-1] / n
    return mean, eq.xtx[:-1, :-1] / n - np.outer(mean, mean)


def nearest_neighbours(distances: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(i, label): the majority label of the k nearest columns of each row; ties to the smaller label."""
    from pyspark.sql import Window

    near = distances.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("v", "j"))).where(F.col("r") <= k)
    votes = near.join(labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("i").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def intercepts(mean_labels: np.ndarray, mean_scores: np.ndarray) -> np.ndarray:
    """What brings the mean of X w to the mean of onehot(y), by class."""
    return mean_labels - mean_scores


def gamma_lambda_grid(linear: np.ndarray, norms: np.ndarray, y: np.ndarray, gammas: list[float], regs: list[float]) -> list[tuple[float, float, float]]:
    """(gamma, reg, train accuracy) of dual rbf models, all from one linear kernel that fits the driver."""
    d = np.maximum(norms[:, None] - 2 * linear + norms[None], 0)
    out = []
    for g in gammas:
        k = np.exp(-g * d)
        out += [(g, r, float(((k @ dual(k, y, r)).argmax(1) == y).mean())) for r in regs]
    return out


def grid_by_rows(matrix: DataFrame, gammas: list[float], regs: list[float], landmarks: int = 96, tol: float = 1e-9, max_iter: int = 1000) -> list[tuple[float, float, float]]:
    """As :func:`gamma_lambda_grid` for rows (i, features, label) with dense ids, of any number: conjugate gradients whose products make the kernel's tiles
    from the rows, for all regularisers of a gamma at once, preconditioned by a low-rank kernel of landmarks. The driver has n x C
    numbers for each regulariser and n for each landmark. Raises where a system isn't solved to ``tol`` within ``max_iter`` steps."""
    from tilewright.operators import kernels

    y = label_array(matrix)
    hot, marks, out = np.eye(int(y.max()) + 1)[y], kernels.landmarks(matrix, landmarks), []
    c = hot.shape[1]
    for g in gammas:
        kernel = RowKernel(matrix, 128, "rbf", g)
        values, vectors = np.linalg.eigh(kernels.tile_function("rbf", g)(marks @ marks.T, linalg._norms(marks), linalg._norms(marks)))
        lifted = kernels.map_rows(matrix, lambda x, v=values, w=vectors, g=g: kernels.tile_function("rbf", g)(x @ marks.T, linalg._norms(x), linalg._norms(marks)) @ (w / np.sqrt(np.maximum(v, 1e-10 * v.max()))))
        f = np.empty((len(y), len(marks)))
        for p in panels.of_rows(lifted):
            i, x = panels.load([p])
            f[i] = x
        inner = f.T @ f

        def precondition(r: np.ndarray, f=f, inner=inner) -> np.ndarray:
            return np.concatenate([(r[:, k * c : k * c + c] - f @ np.linalg.solve(inner + q * np.eye(len(inner)), f.T @ r[:, k * c : k * c + c])) / q for k, q in enumerate(regs)], 1)

        shift, both = np.repeat(regs, c), np.tile(hot, len(regs))
        a = conjugate_gradient(lambda p, kernel=kernel, shift=shift: kernel.multiply(p) + shift * p, both, precondition, max_iter, tol)
        scores = kernel.multiply(a)
        if np.abs(scores + shift * a - both).max() > 1e-6:
            raise np.linalg.LinAlgError("the systems aren't solved: allow more steps")
        out += [(g, q, float((scores[:, k * c : k * c + c].argmax(1) == y).mean())) for k, q in enumerate(regs)]
    return out


def label_array(matrix: DataFrame) -> np.ndarray:
    """The labels of rows with dense ids, in their order, by Arrow."""
    t = matrix.select(F.col("i").cast("long").alias("i"), F.col("label").cast("int").alias("label")).toArrow()
    return t.column("label").to_numpy()[np.argsort(t.column("i").to_numpy())]
