"""Algebra of block indices: grids, lookup, presence, chunks and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import seeded


def n_blocks(n: int, shard: int) -> int:
    return -(-n // shard)


def _axis(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("b"))


def grid(spark: SparkSession, shape: tuple[int, int], shards: tuple[int, int], symmetric: bool = False) -> DataFrame:
    """Every block with its row and column range (bi, bj, r0, r1, c0, c1), the last ones clipped; symmetric: bi >= bj."""
    (n, m), (s0, s1) = shape, shards
    cols = F.explode(F.sequence(F.lit(0), F.lit(n_blocks(m, s1) - 1)))
    g = _axis(spark, n_blocks(n, s0)).select(F.col("b").alias("bi"), cols.alias("bj"))
    if symmetric:
        g = g.where("bi >= bj")
    r0, c0 = F.col("bi").cast("long") * s0, F.col("bj").cast("long") * s1
    return g.select("bi", "bj", r0.alias("r0"), F.least(r0 + s0, F.lit(n)).alias("r1"), c0.alias("c0"), F.least(c0 + s1, F.lit(m)).alias("c1"))


def locate(cells: DataFrame, shape: tuple[int, int], shards: tuple[int, int]) -> DataFrame:
    """Adds the block and the offset in it of each (i, j); a cell out of range raises an error."""
    (n, m), (s0, s1) = shape, shards
    inside = F.col("i").between(0, n - 1) & F.col("j").between(0, m - 1)
    bad = F.raise_error(F.lit("the index is out of range"))
    return cells.select("*", F.when(inside, F.floor(F.col("i") / s0).cast("int")).otherwise(bad.cast("int")).alias("bi"), F.floor(F.col("j") / s1).cast("int").alias("bj"), (F.col("i") % s0).cast("int").alias("oi"), (F.col("j") % s1).cast("int").alias("oj"))


def existing(grid_: DataFrame, stored: DataFrame) -> DataFrame:
    """The blocks of the grid that are stored."""
    return grid_.join(stored.select("bi", "bj").distinct(), ["bi", "bj"], "left_semi")


def missing(grid_: DataFrame, stored: DataFrame) -> DataFrame:
    """The blocks of the grid that are not: what a run that resumes has to do."""
    return grid_.join(stored.select("bi", "bj").distinct(), ["bi", "bj"], "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def complete_rows(grid_: DataFrame, stored: DataFrame) -> DataFrame:
    """Row blocks of which every column block is stored."""
    want = grid_.groupBy("bi").agg(F.count(F.lit(1)).alias("n"))
    have = existing(grid_, stored).groupBy("bi").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["bi", "n"], "left_semi").select("bi")


def incomplete_rows(grid_: DataFrame, stored: DataFrame) -> DataFrame:
    return grid_.select("bi").distinct().join(complete_rows(grid_, stored), "bi", "left_anti")


def chunk(position: Column, n: int) -> Column:
    """The chunk, of n items each, of a position from 0."""
    return F.floor(position / n).cast("int")


def chunk_ranges(spark: SparkSession, size: int, chunks: int) -> DataFrame:
    """Near-equal ranges (k, start, stop) of ceil(size / chunks) items; there can be fewer than asked for."""
    step = -(-size // chunks)
    return _axis(spark, -(-size // step)).select(F.col("b").alias("k"), (F.col("b") * step).cast("long").alias("start"), F.least(F.col("b") * step + step, F.lit(size)).cast("long").alias("stop"))


def pairs(spark: SparkSession, n: int, inner: int, outer: int) -> DataFrame:
    """Unordered pairs a <= b of n blocks in lexical order, in chunks of ``inner``, those in chunks of ``outer``."""
    rest = F.explode(F.sequence(F.col("b"), F.lit(n - 1)))
    p = _axis(spark, n).select(F.col("b").alias("a"), rest.alias("b"))
    # the position follows from the pair: a full rows of the triangle stand before it
    at = F.col("a") * n - (F.col("a") * (F.col("a") - 1) / 2).cast("long") + F.col("b") - F.col("a")
    return p.withColumn("at", at.cast("long")).select("a", "b", chunk(F.col("at"), inner).alias("job"), chunk(F.col("at"), inner * outer).alias("batch"))


def matvec_chunks(spark: SparkSession, rows: int, cols: int, k: int) -> DataFrame:
    """Work items of a product by a vector: (bi, chunk, first, last) column blocks in chunks of k."""
    each = F.explode(F.sequence(F.lit(0), F.lit(-(-cols // k) - 1)))
    return _axis(spark, rows).select(F.col("b").alias("bi"), each.alias("chunk")).select("bi", "chunk", (F.col("chunk") * k).alias("first"), (F.least(F.col("chunk") * k + k, F.lit(cols)) - 1).alias("last"))


def block_rows(blocks: DataFrame, shard: int, n: int) -> DataFrame:
    """The row ids of each block."""
    lo = F.col("bi").cast("long") * shard
    return blocks.select("bi", F.explode(F.sequence(lo, F.least(lo + shard, F.lit(n)) - 1)).alias("i"))


def block_key(r0: str, r1: str, s0: int, c0: str, c1: str, s1: int, replica: int = 0) -> Column:
    return F.format_string("%d_%d_%d_%d_%d_%d_%d", F.col(r0), F.col(r1), F.lit(s0), F.col(c0), F.col(c1), F.lit(s1), F.lit(replica))


_KEY = r"^(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)$"


def parse_block_key(key: Column) -> Column:
    """A struct of the key's numbers; null where the key is none."""
    names = ("start_0", "end_0", "shard_0", "start_1", "end_1", "shard_1", "replica")
    return F.when(key.rlike(_KEY), F.struct(*[F.regexp_extract(key, _KEY, k + 1).cast("long").alias(x) for k, x in enumerate(names)]))


def progress(expected: DataFrame, stored: DataFrame, contains: str = "") -> DataFrame:
    """(key, have, want) of each matrix whose key holds a substring; ``expected``: key, want; ``stored``: key, bi, bj."""
    have = stored.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("have"))
    return expected.where(F.col("key").contains(contains)).join(have, "key", "left").select("key", F.coalesce("have", F.lit(0).cast("long")).alias("have"), "want")


def pair_train_test(keys: DataFrame) -> DataFrame:
    """(train_key, test_key): keys that are the same but for the word of their split."""
    train = keys.where(F.col("key").contains("train")).select(F.col("key").alias("train_key"), F.regexp_replace("key", "train", "").alias("stem"))
    test = keys.where(F.col("key").contains("test")).select(F.col("key").alias("test_key"), F.regexp_replace("key", "test", "").alias("stem"))
    return train.join(test, "stem").drop("stem")


def parse_feature_key(key: Column) -> Column:
    """The hyper-parameters in ``name_patch_stride_pool_poolstride_bias(root)``; null parts where they are missing."""
    parts = F.split(F.regexp_extract(key, r"^([^(]*)", 1), "_")
    numbers = [F.try_element_at(parts, F.lit(-k)).try_cast("double").alias(n) for k, n in ((5, "patch"), (4, "patch_stride"), (3, "pool"), (2, "pool_stride"), (1, "bias"))]
    return F.struct(*numbers, F.regexp_extract(key, r"\((.*)\)$", 1).alias("root"))


def content_hash(values: Column) -> Column:
    """sha1 of an array's canonical text: a key of a matrix that has none."""
    return F.sha1(F.array_join(F.transform(values, lambda x: x.cast("double").cast("string")), ",").cast("binary"))


def derived_key(kind: str, *args: object) -> str:
    """Lineage as a key, such as ``rbf(XXT(k), 0.1)``."""
    return f"{kind}({', '.join(map(str, args))})"


def shuffled(df: DataFrame, id_col: str, seed: int, name: str = "place") -> DataFrame:
    """A reproducible permutation: ranks by a seeded order, ties by id. Ranks are found within 65,536 ranges of it."""
    keyed = df.withColumn("_h", seeded.order(seed, id_col)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) - 1
    return keyed.withColumn("_r", rank).join(F.broadcast(before), "_b").withColumn(name, F.col("_base") + F.col("_r")).drop("_h", "_b", "_r", "_base")
