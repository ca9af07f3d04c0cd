"""Connected components of links, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.runtime import cut, partitions, release

#: Edges to a file: rounds over few links are a few tasks each, whatever the session's number of partitions.
EDGES = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b), of any type that has an order: label is the smallest node that it reaches.

    A large star hangs every larger neighbour of a node to the smallest of its neighbours and itself, a small star the
    node and its smaller neighbours to the smallest of these. Both keep components and never add edges; rounds grow as the
    logarithm of the nodes (14 for a path of 4,096 in the order 0, n, n - 1, ..., 1), also where no node's label is
    ever next to it. Minima combine before their shuffles, and are written before they are joined, so that the joins stand on plain
    exchanges, of which a hub's can be split. Each round is written to the shared folder.
    Links of a node to itself, repeated links, and links with a null at an end, which are left out, do no harm.
    """
    ends = links.where("a is not null and b is not null")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    files = -(-max(1, ends.count()) // EDGES)

    def kept(df: DataFrame, name: str) -> DataFrame:
        return cut(df.coalesce(files) if files < partitions(df.sparkSession) else df, name)

    edges = kept(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(edges):
        # large star: (a, b), a > b, becomes (a, the least around b)
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = kept(around.groupBy(F.col("a").alias("b")).agg(F.least(F.col("a"), F.min("b")).alias("low")), "lows")
        large = kept(edges.join(lows, "b").select("a", F.col("low").alias("b")).distinct(), "edges")
        release(edges, lows)
        # small star: (a, b) becomes (b, the least below a), and a keeps that one
        lows = kept(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
        hung = large.join(lows, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        edges = kept(hung.distinct(), "edges")
        release(large, lows)
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether every edge hangs its larger node to a root, and each to one."""
    twice = edges.groupBy("a").count().where("count > 1").select("a")
    deep = edges.select(F.col("b").alias("a")).distinct().join(edges, "a", "left_semi")
    return not twice.unionByName(deep).limit(1).count()
