import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.operators import blocks, layouts, linalg
from tilewright.runtime import scratch
from tilewright.sources.matrix_store import Header, MatrixStore


def matrix(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, features array<double>")


def dense(coords, shape):
    out = np.zeros(shape)
    for r in coords.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("shape,shards", [((10, 7), (4, 3)), ((1, 1), (4, 3)), ((8, 6), (4, 3))])
def test_layouts_round_trip(spark, shape, shards):
    x = np.arange(shape[0] * shape[1], dtype=float).reshape(shape)
    rows = matrix(spark, x)
    t = layouts.rows_to_blocks(rows, *shards)
    assert {(r["bi"], r["bj"]) for r in t.collect()} == {(r["bi"], r["bj"]) for r in blocks.grid(spark, shape, shards).collect()}
    assert (dense(layouts.blocks_to_coords(t, *shards), shape) == x).all()
    again = {r["i"]: r["features"] for r in layouts.blocks_to_rows(t, shards[0]).collect()}
    assert [again[i] for i in range(shape[0])] == x.tolist()
    c = layouts.rows_to_coords(rows)
    assert (dense(layouts.blocks_to_coords(layouts.coords_to_blocks(c.where("v <> 0"), *shape, *shards), *shards), shape) == x).all()
    wide = {r["i"]: r["features"] for r in layouts.coords_to_rows(c, shape[1]).collect()}
    assert [wide[i] for i in range(shape[0])] == x.tolist()


@settings(max_examples=5, deadline=None)
@given(n=st.integers(1, 9), m=st.integers(1, 9), d=st.integers(1, 7), s=st.integers(1, 4))
def test_blocked_product_is_the_dense_one(spark, n, m, d, s):
    rng = np.random.default_rng((n, m, d, s))
    x, y = rng.normal(size=(n, d)), rng.normal(size=(m, d))
    p = linalg.product_blocks(layouts.rows_to_blocks(matrix(spark, x), s, 3), layouts.rows_to_blocks(matrix(spark, y), s, 3))
    assert np.allclose(dense(layouts.blocks_to_coords(p, s, s), (n, m)), x @ y.T)


def test_products_agree(spark):
    x = np.random.default_rng(0).normal(size=(9, 5))
    rows = matrix(spark, x)
    c = layouts.rows_to_coords(rows)
    assert np.allclose(dense(linalg.gram(rows), (5, 5)), x.T @ x)
    full = np.tril(x @ x.T)
    assert np.allclose(dense(linalg.product_coords(c, c, lower=True), (9, 9)), full)
    assert np.allclose(dense(linalg.self_product_rows(rows, 4), (9, 9)), full)
    assert np.allclose(dense(linalg.cross_product_rows(rows, rows, 4), (9, 9)), x @ x.T)
    d = linalg.difference(c, linalg.add(c, c)).first()
    assert np.isclose(d["max"], np.abs(x).max()) and np.isclose(d["frobenius"], np.linalg.norm(x))


def test_symmetric_store_mirrors_and_shifts(spark):
    a = np.random.default_rng(1).normal(size=(5, 5))
    a = a + a.T
    store, h = MatrixStore(spark, scratch(spark, "t")), Header("k", 5, 5, 2, 2, True, 0.5)
    store.write_header(h)
    every = layouts.rows_to_blocks(matrix(spark, a), 2, 2)
    store.put(h, every.where("bi <= bj"))  # upper tiles are turned into lower ones
    assert not store.missing(h).count()
    assert np.allclose(store.local(h), a + 0.5 * np.eye(5))
    up, low = dense(store.block(h, 0, 1), (2, 2)), dense(store.block(h, 1, 0), (2, 2))
    assert np.allclose(up, low.T) and np.allclose(up, a[:2, 2:4])
    assert np.allclose(dense(store.block(h, 1, 1), (2, 2)), a[2:4, 2:4] + 0.5 * np.eye(2))
    whole = a + 0.5 * np.eye(5)
    for i in range(5):
        assert {r["j"]: r["v"] for r in store.point(h, i).collect()} == pytest.approx(dict(enumerate(whole[i])))
        assert all(np.isclose(store.point(h, i, j).first()["v"], whole[i, j]) for j in (0, 4))
    # a row is read from its own row and column of tiles alone
    assert "bi#" in store.point(h, 4)._jdf.queryExecution().executedPlan().toString() and "PartitionFilters: [(" in store.point(h, 4)._jdf.queryExecution().executedPlan().toString()


def test_store_resumes_deletes_and_reshards(spark):
    x = np.random.default_rng(2).normal(size=(7, 6))
    store = MatrixStore(spark, scratch(spark, "t"))
    h = store.shard("m", matrix(spark, x), 3, 4)
    store.delete_block(h, 1, 1)
    assert [tuple(r) for r in store.missing(h).select("bi", "bj").collect()] == [(1, 1)]
    store.put(h, layouts.rows_to_blocks(matrix(spark, x), 3, 4).where("bi = 1 and bj = 1"))
    assert not store.missing(h).count() and np.allclose(store.local(h), x)
    c = store.column_sharded(h, 2)
    assert np.allclose(store.local(c), x) and store.grid(c).count() == 3
    assert np.isclose(store.point(h, 4, 5).first()["v"], x[4, 5])
    with pytest.raises(IndexError):
        store.point(h, 7)
    with pytest.raises(ValueError):
        store.column_sharded(h, 3)
    with pytest.raises(Exception, match="wrong shape"):
        store.put(h, layouts.rows_to_blocks(matrix(spark, x), 2, 4))
    store.delete("m")
    assert store.header("m") is None and store.header(c.key) == c
    again = store.shard("m", matrix(spark, x), 2, 2)
    assert store.header("m") == again != h and store.matrices("m").count() == 2


def test_index_algebra(spark):
    g = blocks.grid(spark, (10, 7), (4, 3))
    stored = g.where((F.col("bi") + F.col("bj")) % 3 != 0)
    have, lack = blocks.existing(g, stored), blocks.missing(g, stored)
    assert have.count() + lack.count() == g.count() and not have.join(lack, ["bi", "bj"]).count()
    assert blocks.symmetric_difference(g.select("bi", "bj"), stored.select("bi", "bj")).count() == lack.count()
    with pytest.raises(Exception, match="out of range"):
        blocks.locate(spark.createDataFrame([(10, 0)], "i int, j int"), (10, 7), (4, 3)).collect()
    pairs = [(r["a"], r["b"], r["job"], r["batch"]) for r in blocks.pairs(spark, 4, 3, 2).orderBy("a", "b").collect()]
    assert [p[:2] for p in pairs] == [(a, b) for a in range(4) for b in range(a, 4)] and [p[2] for p in pairs] == [k // 3 for k in range(10)] and [p[3] for p in pairs] == [k // 6 for k in range(10)]
    keys = spark.createDataFrame([("4_8_4_0_3_3_0",), ("x",), (None,)], "k string").select(blocks.parse_block_key(F.col("k")).alias("p")).collect()
    assert keys[0]["p"]["end_0"] == 8 and keys[1]["p"] is None and keys[2]["p"] is None
    f = spark.createDataFrame([("conv_6_1_15_6_1.5(root)",)], "k string").select(blocks.parse_feature_key(F.col("k")).alias("p")).first()["p"]
    assert (f["patch"], f["pool"], f["bias"], f["root"]) == (6, 15, 1.5, "root")


def test_permutation_and_dense_places(spark):
    ids = spark.range(1000).select((F.col("id") * 7).alias("i"))
    a = {r["i"]: r["place"] for r in blocks.shuffled(ids, "i", 1).collect()}
    assert sorted(a.values()) == list(range(1000)) and a == {r["i"]: r["place"] for r in blocks.shuffled(ids.repartition(5), "i", 1).collect()}
    assert [r["k"] for r in layouts.dense_index(ids.repartition(5), "i", "k").orderBy("i").collect()] == list(range(1000))
