import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.operators import evaluate, kernels, layouts, linalg, solvers
from tilewright.runtime import cut


def data(spark, n=60, d=5, c=3, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, d)), rng.integers(0, c, n)
    x[:, 0] += y
    return x, y, spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "i long, features array<double>, label int").repartition(3)


def test_normal_equations_add_up_and_weigh(spark):
    x, y, df = data(spark)
    eq = solvers.normal_equations(df)
    assert np.allclose(eq.xtx, x.T @ x) and np.allclose(eq.xty, x.T @ np.eye(3)[y]) and eq.n == 60
    two = solvers.normal_equations(df.where("i < 20"), 3) + solvers.normal_equations(df.where("i >= 20"), 3)
    assert np.allclose(two.xtx, eq.xtx) and np.allclose(two.xty, eq.xty)
    w = np.arange(60) / 60
    got = solvers.normal_equations(df.withColumn("w", F.col("i") / 60), weight="w")
    assert np.allclose(got.xtx, x.T @ np.diag(w) @ x) and np.allclose(got.xty, x.T @ np.diag(w) @ np.eye(3)[y])


def test_sweep_marks_singular_systems(spark):
    x, y, df = data(spark)
    twice = df.withColumn("features", F.concat("features", F.slice("features", 1, 1)))
    rows = {r["reg"]: r for r in solvers.sweep(twice, regs=(0.0, 0.1)).collect()}
    assert rows[0.0]["status"] == "I" and rows[0.0]["train_acc"] is None and rows[0.1]["status"] == ""
    w = np.linalg.solve(x.T @ x + 0.1 * np.eye(5), x.T @ np.eye(3)[y])
    acc = solvers.sweep(df, df, regs=(0.1,)).first()
    assert np.isclose(acc["train_acc"], ((x @ w).argmax(1) == y).mean()) and acc["test_acc"] == acc["train_acc"]


def test_leave_one_out_is_a_refit(spark):
    x, y, df = data(spark, 12)
    got = {r["i"]: r["scores"] for r in solvers.leave_one_out(df, 0.3).collect()}
    for i in range(12):
        k = np.arange(12) != i
        w = np.linalg.solve(x[k].T @ x[k] + 0.3 * np.eye(5), x[k].T @ np.eye(3)[y[k]])
        assert np.allclose(got[i], x[i] @ w)


def test_rank_one_updates_are_inverses():
    rng = np.random.default_rng(0)
    c, x = rng.normal(size=(6, 6)), rng.normal(size=6)
    a = c @ c.T + np.eye(6)
    for sign in (1.0, -0.1):
        assert np.allclose(solvers.rank_one(np.linalg.inv(a), x, sign), np.linalg.inv(a + sign * np.outer(x, x)))


@settings(max_examples=4, deadline=None)
@given(n=st.integers(2, 12), s=st.integers(1, 5), seed=st.integers(0, 99))
def test_block_descent_and_conjugate_gradients_solve(spark, n, s, seed):
    rng = np.random.default_rng(seed)
    c, y = rng.normal(size=(n, n)), rng.normal(size=(n, 2))
    k = c @ c.T / n + np.eye(n)
    exact = np.linalg.solve(k + 0.5 * np.eye(n), y)
    z = solvers.conjugate_gradient(lambda p: k @ p + 0.5 * p, y, solvers.jacobi(np.diag(k) + 0.5), 200, 1e-12)
    assert np.allclose(z, exact, atol=1e-6)
    coords = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(n)], "i long, j int, v double")
    kernel = solvers.BlockKernel(cut(layouts.coords_to_blocks(coords, n, n, s, s)), s)
    assert np.allclose(solvers.block_coordinate(kernel, y, 0.5, epochs=25, seed=seed), exact, atol=1e-3)


def test_kernels_have_their_properties(spark):
    x, y, df = data(spark, 20)
    rows = df.select("i", "features")
    rbf = {(r["i"], r["j"]): r["v"] for r in kernels.of_rows(rows, None, "rbf", 0.7).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert len(rbf) == 210 and all(np.isclose(v, np.exp(-0.7 * d[k])) for k, v in rbf.items()) and all(np.isclose(rbf[i, i], 1) for i in range(20))
    quad = {(r["i"], r["j"]): r["v"] for r in kernels.of_rows(rows, None, "quadratic", 0.5).collect()}
    assert all(np.isclose(v, (1 + 0.5 * x[i] @ x[j]) ** 2) for (i, j), v in quad.items())
    with pytest.raises(ValueError):
        kernels.of_rows(rows, None, "liner")
    marks = kernels.landmarks(rows, 20)
    lift = {r["i"]: np.array(r["features"]) for r in kernels.nystroem(rows, marks, 0.7).collect()}
    assert all(np.isclose(lift[i] @ lift[j], np.exp(-0.7 * d[i, j]), atol=1e-4) for i in range(20) for j in range(20))
    z = np.random.default_rng(1).normal(size=(8, 3))
    v = np.arange(8.0)
    assert np.allclose(kernels.low_rank_inverse(z, 0.4)(v), np.linalg.solve(z @ z.T + 0.4 * np.eye(8), v))


def test_top_k_rules_on_ties(spark):
    df = spark.createDataFrame([(0, [5.0, 5.0, 6.0], 1), (1, [1.0, 1.0, 1.0], 0)], "i long, scores array<double>, label int")
    got = df.select(evaluate.argmax(F.col("scores")).alias("a"), evaluate.top_k(F.col("scores"), 2).alias("t"), evaluate.top_k(F.col("scores"), 9).alias("all")).collect()
    assert [(r["a"], r["t"], r["all"]) for r in got] == [(2, [2, 0], [2, 0, 1]), (0, [0, 1], [0, 1, 2])]
    acc = {r["k"]: r["acc"] for r in evaluate.top_k_accuracy(df, [1, 3]).collect()}
    assert acc == {1: 0.5, 3: 1.0}


def test_softmax_and_mixture_fit(spark):
    x, y, df = data(spark, 90)
    w = solvers.softmax_regression(df, 1e-2, 40)
    s = x @ w
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert np.abs(x.T @ (p - np.eye(3)[y]) / 90 + 1e-2 * w).max() < 1e-2
    assert solvers.softmax_regression(df, 1e-2, 2, blocks=2).shape == (5, 3)
    shares, means, var = solvers.gaussian_mixture(df.select("i", "features"), 2, 5)
    assert np.isclose(shares.sum(), 1) and np.allclose(shares @ means, x.mean(0), atol=1e-6)
    mean, axes = solvers.principal_components(df, 2)
    top = np.linalg.svd(x - x.mean(0))[2][:2]
    assert np.allclose(np.abs(axes.T @ top.T), np.eye(2), atol=1e-6) and np.allclose(mean, x.mean(0))


def test_shuffled_labels_are_not_learnt(spark):
    x, y, df = data(spark, 300)
    real = solvers.sweep(df, regs=(0.1,)).first()["train_acc"]
    mixed = df.withColumn("label", F.pmod(F.xxhash64("i"), F.lit(3)).cast("int"))
    assert real > solvers.sweep(mixed, regs=(0.1,)).first()["train_acc"]


def test_objective_and_neighbours(spark):
    k = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, v double")
    a = spark.createDataFrame([(0, 0, 0.5), (1, 0, -1.0)], "i long, class int, w double")
    y = spark.createDataFrame([(1, 0)], "i long, class int")
    kw = linalg.matvec(k, a.select(F.col("i").alias("j"), "class", "w"))
    m, v = np.array([0.5, -1.0]), np.array([[2.0, 1], [1, 3]])
    assert np.isclose(evaluate.objective(a, kw, y, 0.2).first()["obj"], 0.5 * m @ v @ m + 0.1 * m @ m + 1.0)
    d = spark.createDataFrame([(9, 0, 1.0), (9, 1, 2.0), (9, 2, 3.0)], "i long, j long, v double")
    labels = spark.createDataFrame([(0, 4), (1, 2), (2, 2)], "i long, label int")
    assert solvers.nearest_neighbours(d, labels, 3).first()["label"] == 2 and solvers.nearest_neighbours(d, labels, 2).first()["label"] == 2


def test_block_kernel_is_the_dense_one(spark):
    x, y, df = data(spark, 37)
    k = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    for lower, tiles in ((True, kernels.blocks_of_rows(df, "rbf", 8, 0.3)), (False, layouts.coords_to_blocks(spark.createDataFrame([(i, j, float(k[i, j])) for i in range(37) for j in range(37)], "i long, j int, v double"), 37, 37, 8, 8))):
        stored = solvers.BlockKernel(cut(tiles), 8, lower)
        v = np.random.default_rng(0).normal(size=(37, 2))
        v[16:24] = 0  # a block that gives nothing
        assert np.allclose(stored.multiply(v), k @ v) and np.allclose(stored.diagonal(), np.diag(k))
        part, own = stored.panel_product(2, v)
        assert np.allclose(part, k[16:24] @ v) and np.allclose(own, k[16:24, 16:24])
    want = np.linalg.solve(k + 0.5 * np.eye(37), np.eye(3)[y])
    assert np.allclose(solvers.dual_blocks(stored, np.eye(3)[y], 0.5), want, atol=1e-6)
    assert np.allclose(solvers.block_coordinate(solvers.BlockKernel(cut(kernels.blocks_of_rows(df, "rbf", 8, 0.3)), 8, True), np.eye(3)[y], 0.5, epochs=25), want, atol=1e-3)


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    for values in ([4.0], [1.0, 2.0], [2.0] * 9, rng.normal(size=501).tolist(), rng.exponential(size=500).tolist(), [0.0] * 100 + [5.0] * 100, [1e9, -1e9, 3.0, 3.0, 4.0], [0.0] * 7 + [1.0] * 8 + [9e9]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert linalg.median(df, "v", bins=4, few=3) == np.median(values)
    assert linalg.median(df.limit(0), "v") is None


def test_nearest_rows_and_grids(spark):
    x, y, df = data(spark, 50)
    d = np.round(((x[:, None] - x[None, :20]) ** 2).sum(2), 9)
    got = sorted((r["i"], r["j"]) for r in linalg.nearest_rows(df, df.where("i < 20"), 3, block=7).collect())
    assert got == sorted((i, int(j)) for i in range(50) for j in np.argsort(d[i], kind="stable")[:3])
    for g, r, acc in solvers.gamma_lambda_grid(x @ x.T, (x * x).sum(1), y, [0.1, 2.0], [0.1, 5.0]):
        k = np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(2))
        assert acc == ((k @ np.linalg.solve(k + r * np.eye(50), np.eye(3)[y])).argmax(1) == y).mean()


def test_linear_classifiers_learn(spark):
    from tilewright.operators import classifiers

    x, y, _ = data(spark, 120)
    x[:, 0] = 4 * y + 0.1 * x[:, 1]
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(120)], "i long, features array<double>, label int")
    for out in (classifiers.logistic(df), classifiers.support_vectors(df.where("label < 2"))):
        rows = out.collect()
        assert np.mean([r["label"] == r["pred"] for r in rows]) > 0.95
    sweep = classifiers.sweep_features(df, [0.0, 1.0], lambda m, s: m.select("i", F.transform("features", lambda v: v * s).alias("features")), 0.1).collect()
    assert sweep[1]["train_acc"] > sweep[0]["train_acc"]


def test_kernels_of_stored_rows_multiply_and_descend_as_stored_tiles_do(spark):
    x, y, df = data(spark, 70)
    df = df.repartition(4, "features")
    v = np.random.default_rng(2).normal(size=(70, 3))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for kind, full in (("linear", x @ x.T), ("rbf", np.exp(-0.3 * d))):
        k = solvers.RowKernel(df, 8, kind, 0.3)
        assert np.allclose(k.multiply(v), full @ v) and np.allclose(k.diagonal(), np.diag(full))
        got = {(r["i"], r["class"]): r["s"] for r in k.scores(v).collect()}
        assert len(got) == 210 and all(np.isclose(s, (full @ v)[i]) for i, s in got.items())
    k.together = 4
    stored = solvers.BlockKernel(cut(kernels.blocks_of_rows(df, "rbf", 8, 0.3)), 8, True)
    for how in ({}, {"with_replacement": True}, {"momentum": 0.1, "start_block": 3}):
        a, b = (solvers.block_coordinate(z, np.eye(3)[y], 0.5, epochs=2, **how) for z in (k, stored))
        assert np.allclose(a, b, atol=1e-10)


def test_grid_of_rows_is_that_of_the_matrix(spark):
    x, y, df = data(spark, 60)
    want = solvers.gamma_lambda_grid(x @ x.T, (x * x).sum(1), y, [0.1, 1.0], [1e-2, 1.0])
    assert np.allclose(solvers.grid_by_rows(df, [0.1, 1.0], [1e-2, 1.0], landmarks=20), want)
