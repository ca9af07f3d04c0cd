import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import kernels, layouts, linalg, panels


def rows(spark, n=90, d=4, seed=0, parts=5):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "i long, features array<double>").repartition(parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_rows_in_any_order_are_all_there_without_a_shuffle(spark):
    x, df = rows(spark)
    df = df.withColumn("i", F.col("i") * 7 % 1000)
    ids = np.arange(90) * 7 % 1000
    got = kernels.of_rows(df, None, "linear")
    assert "Exchange" not in plan(got)
    cells = {(r["i"], r["j"]): r["v"] for r in got.collect()}
    full = x @ x.T
    want = {(int(ids[a]), int(ids[b])): full[a, b] for a in range(90) for b in range(90) if ids[a] >= ids[b]}
    assert cells.keys() == want.keys() and all(np.isclose(v, want[k]) for k, v in cells.items())
    other = kernels.of_rows(df.where("i < 200"), df.where("i >= 200"), "rbf", 0.3)
    assert "Exchange" not in plan(other) and other.count() == (ids < 200).sum() * (ids >= 200).sum()


def test_tiles_are_written_once_and_made_where_they_are_asked_for(spark):
    x, df = rows(spark)
    t = layouts.rows_to_blocks(df, 8, 3)
    found = linalg.product_blocks(t, t, lower=True)
    assert "Exchange" not in plan(found)
    full = x @ x.T
    got = {(r["bi"], r["bj"]): np.array(r["data"]).reshape(r["n_rows"], r["n_cols"]) for r in found.collect()}
    assert len(got) == 78 and all(np.allclose(v, full[i * 8 : i * 8 + 8, j * 8 : j * 8 + 8]) for (i, j), v in got.items())
    some = {(r["bi"], r["bj"]) for r in linalg.product_blocks(t, t, only={(3, 1), (11, 11), (99, 0)}).collect()}
    assert some == {(3, 1), (11, 11)}


def test_nearest_rows_keep_ties_to_the_smaller_id(spark):
    x, df = rows(spark, 70, 2)
    df = df.withColumn("features", F.transform("features", lambda v: F.round(v)))
    z = np.round(x)
    found = linalg.nearest_rows(df.where("i >= 60"), df.where("i < 60"), 4, block=6)
    assert "BroadcastExchange" not in plan(found)
    d = ((z[60:, None] - z[None, :60]) ** 2).sum(2)
    want = {(i + 60, int(j)) for i in range(10) for j in np.lexsort((np.arange(60), d[i]))[:4]}
    assert {(r["i"], r["j"]) for r in found.collect()} == want
    assert linalg.nearest_rows(df.where("i < 3"), df.where("i < 2"), 4).count() == 6


def test_sides_join_parts_up_to_a_number_of_rows(spark):
    parts = panels.of_rows(rows(spark, 90, 4)[1], 7)
    assert sum(p.n for p in parts) == 90 and max(p.n for p in parts) <= 7
    sides = panels.sides(parts, 20, 2)
    assert sum(len(s) for s in sides) == len(parts) and max(sum(p.n for p in s) for s in sides) <= 20
    assert panels.of_rows(rows(spark, 90, 4)[1].where("i < 0")) == [] and kernels.of_rows(rows(spark)[1].where("i < 0"), None, "linear").count() == 0


def test_norms_of_pairs_are_those_of_the_rows_without_a_join(spark):
    x, df = rows(spark)
    found = linalg.norms_of_pairs(df, 20)
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    n = (x * x).sum(1)
    got = {(r["i"], r["j"]): (r["x2"], r["y2"]) for r in found.collect()}
    assert len(got) == 90 * 91 // 2 and all(i >= j and np.allclose(v, (n[i], n[j])) for (i, j), v in got.items())


def test_difference_of_kernels_sends_sums_only(spark):
    x, df = rows(spark)
    fs = [kernels.tile_function(k, 0.5) for k in ("linear", "quadratic")]
    found = linalg.difference_rows(df, *fs, block=20)
    assert "Join" not in plan(found)
    k = x @ x.T
    d = np.abs(k - (1 + 0.5 * k) ** 2)[np.tril_indices(90)]
    cells = kernels.of_rows(df, None, "linear")
    for r in (found.first(), linalg.difference(cells, kernels.quadratic(cells, 0.5)).first()):
        assert np.allclose([r["mean"], r["max"], r["frobenius"]], [d.mean(), d.max(), np.sqrt((d * d).sum())])


def test_sampled_difference_makes_the_tiles_that_are_drawn(spark):
    from tilewright.operators import blocks

    x, df = rows(spark)
    places = {(r["bi"], r["bj"]) for r in linalg.sampled_places(blocks.grid(spark, (90, 90), (8, 8), True), 5, 3).collect()}
    some, every = ([kernels.blocks_of_rows(df, k, 8, only=o) for k in ("linear", "quadratic")] for o in (places, None))
    a, b = (sorted(tuple(np.round(r, 9)) for r in linalg.sampled_difference(*t, 5, 3).collect()) for t in (some, every))
    assert a == b and some[0].count() == 5


def test_gram_matrix_is_stored_as_its_factor(spark):
    from tilewright.runtime import scratch
    from tilewright.sources.matrix_store import Header, MatrixStore

    x, df = rows(spark, 50)
    store, h = MatrixStore(spark, scratch(spark, "store")), Header("xxt", 50, 50, 8, 8, True, 0.5)
    store.write_header(h)
    store.put_factor(h, layouts.rows_to_blocks(df, 8, 4))
    full = x @ x.T + 0.5 * np.eye(50)
    assert np.allclose(store.local(h), full) and store.missing(h).count() == 0 and store.coords(h).count() == 2500
    assert {r["j"]: r["v"] for r in store.point(h, 13).collect()} == {j: pytest.approx(v) for j, v in enumerate(full[13])}
    with pytest.raises(ValueError):
        store.delete_block(h, 1, 0)
