"""Row, coordinate and block layouts of a matrix, and the ways between them.

Rows: ``i, features ARRAY<DOUBLE>``. Coordinates: ``i, j, v``, absent cells being 0. Blocks: ``bi, bj, n_rows, n_cols,
data ARRAY<DOUBLE>`` in row-major order; blocks at the edges are ragged. Row ids are dense positions from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_DDL = "bi int, bj int, n_rows int, n_cols int, data array<double>"


def rows(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A table's vectors as a row matrix, in doubles."""
    return df.select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("features"))


def rows_to_coords(matrix: DataFrame) -> DataFrame:
    return matrix.select("i", F.posexplode("features").alias("j", "v"))


def coords_to_rows(coords: DataFrame, n_cols: int) -> DataFrame:
    """Rows of n_cols components; cells without an entry are 0."""
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    packed = coords.groupBy("i").agg(cells.alias("m"))
    return packed.select("i", F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0))).alias("features"))


def dense_index(df: DataFrame, order: str, name: str = "i") -> DataFrame:
    """Adds positions from 0 by an ordering column: a range sort, and running counts of its partitions (one number each)."""
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    kept = ranged.persist()
    counts = sorted((r["_p"], r["count"]) for r in kept.groupBy("_p").count().collect())
    base, at = {}, 0
    for p, n in counts:
        base[p] = at
        at += n
    from pyspark.sql import Window

    starts = df.sparkSession.createDataFrame(list(base.items()), "_p int, _base long")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return kept.withColumn("_k", place).join(F.broadcast(starts), "_p").withColumn(name, F.col("_base") + F.col("_k")).drop("_p", "_k", "_base")


def rows_to_blocks(matrix: DataFrame, shard_0: int, shard_1: int) -> DataFrame:
    """Tiles of shard_0 x shard_1. A task gets the rows of whole tiles, so each is cut once and shuffled once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i = t.column("i").to_numpy()
        order = np.argsort(i)
        x = t.column("features").combine_chunks().flatten().to_numpy().reshape(len(i), -1)[order]
        bi, out = int(i[0] // shard_0), []
        for bj in range(-(-x.shape[1] // shard_1)):
            tile = x[:, bj * shard_1 : (bj + 1) * shard_1]
            out.append((bi, bj, *tile.shape, tile.ravel()))
        yield blocks_batch(out)

    return matrix.withColumn("b", F.floor(F.col("i") / shard_0)).groupBy("b").applyInArrow(cut, BLOCK_DDL)


def blocks_batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 5
    kinds = [pa.int32()] * 4 + [pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["bi", "bj", "n_rows", "n_cols", "data"])


def coords_to_blocks(coords: DataFrame, n_rows: int, n_cols: int, shard_0: int, shard_1: int) -> DataFrame:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j, v = (t.column(c).to_numpy() for c in ("i", "j", "v"))
        bi, bj = int(i[0] // shard_0), int(j[0] // shard_1)
        tile = np.zeros((min(shard_0, n_rows - bi * shard_0), min(shard_1, n_cols - bj * shard_1)))
        tile[i - bi * shard_0, j - bj * shard_1] = v
        yield blocks_batch([(bi, bj, *tile.shape, tile.ravel().tolist())])

    keyed = coords.select("i", "j", F.col("v").cast("double").alias("v"), F.floor(F.col("i") / shard_0).alias("a"), F.floor(F.col("j") / shard_1).alias("b"))
    return keyed.groupBy("a", "b").applyInArrow(fill, BLOCK_DDL)


def blocks_to_coords(blocks: DataFrame, shard_0: int, shard_1: int) -> DataFrame:
    cells = blocks.select("bi", "bj", "n_cols", F.posexplode("data").alias("k", "v"))
    i = F.col("bi").cast("long") * shard_0 + F.floor(F.col("k") / F.col("n_cols"))
    return cells.select(i.alias("i"), (F.col("bj") * shard_1 + F.col("k") % F.col("n_cols")).alias("j"), "v")


def blocks_to_rows(blocks: DataFrame, shard_0: int) -> DataFrame:
    """Joins a row's tiles again, in column order."""
    k = F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))
    parts = blocks.select("bi", "bj", "n_cols", "data", k.alias("k"))
    parts = parts.select((F.col("bi").cast("long") * shard_0 + F.col("k")).alias("i"), "bj", F.slice("data", F.col("k") * F.col("n_cols") + 1, F.col("n_cols")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("bj", "part")))
    return parts.groupBy("i").agg(F.flatten(F.transform(ordered, lambda s: s["part"])).alias("features"))


def symmetric_view(lower: DataFrame, diag_offset: float = 0.0) -> DataFrame:
    """The whole of a symmetric matrix of which coordinates i >= j are stored, with a shift of its diagonal. A cell gives
    both of its places, so the lower half is made or read once."""
    own, mirror = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    at = F.explode(F.when(F.col("i") == F.col("j"), F.array(own)).otherwise(F.array(own, mirror)))
    both = lower.where("i >= j").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v").select(at.alias("at"), "v")
    return both.select("at.i", "at.j", "v").withColumn("v", F.when(F.col("i") == F.col("j"), F.col("v") + diag_offset).otherwise(F.col("v")))


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    for b in batches:
        bi, bj, n, m = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bi", "bj", "n_rows", "n_cols"))
        data = b.column(b.schema.get_field_index("data"))
        for r in range(b.num_rows):
            yield bi[r], bj[r], data[r].values.to_numpy(zero_copy_only=False).reshape(n[r], m[r])


def lower_tiles(blocks: DataFrame) -> DataFrame:
    """Tiles with bi < bj as their transposes, others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, t in tiles_of(batches):
            yield blocks_batch([(max(bi, bj), min(bi, bj), *(t.T if bi < bj else t).shape, np.ascontiguousarray(t.T if bi < bj else t).ravel())])

    return blocks.select("bi", "bj", "n_rows", "n_cols", "data").mapInArrow(run, BLOCK_DDL)


def column_panels(blocks: DataFrame, shard_1: int, cols: int) -> DataFrame:
    """Full-height tiles of so many columns, a divisor of ``shard_1``: each tile is cut once, and its parts are stacked by row block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bi, bj, t in tiles_of(batches):
            yield blocks_batch([(bi, bj * (shard_1 // cols) + k, len(t), t[:, a : a + cols].shape[1], np.ascontiguousarray(t[:, a : a + cols]).ravel()) for k, a in enumerate(range(0, t.shape[1], cols))])

    parts = blocks.select("bi", "bj", "n_rows", "n_cols", "data").mapInArrow(cut, BLOCK_DDL)
    ordered = F.array_sort(F.collect_list(F.struct("bi", "data")))
    panels = parts.groupBy("bj").agg(F.sum("n_rows").cast("int").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.flatten(F.transform(ordered, lambda s: s["data"])).alias("data"))
    return panels.select(F.lit(0).alias("bi"), "bj", "n_rows", "n_cols", "data")
