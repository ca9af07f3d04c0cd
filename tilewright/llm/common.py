"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Out:
    """Collects rows and gives them out as record batches of a bounded number of bytes."""

    def __init__(self, schema: pa.Schema, limit: int = 8 << 20):
        self.schema, self.limit = schema, limit
        self.cols: list[list] = [[] for _ in schema]
        self.held = 0

    def add(self, *row, size: int = 64) -> bool:
        for c, v in zip(self.cols, row, strict=True):
            c.append(v)
        self.held += size
        return self.held >= self.limit

    def take(self) -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
        self.cols, self.held = [[] for _ in self.schema], 0
        return got


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null texts as empty ones; other columns, whatever their names, are left out."""
    return df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


NO_ID = -(1 << 63)


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut points that part the values of a long column about evenly, nulls as the smallest; reads this column alone.

    A value that fills several ranges is there as often.
    """
    if n < 2:
        return []
    got = df.select(F.percentile_approx(F.coalesce(key, F.lit(NO_ID)), [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"]
    return sorted(int(x) for x in got or [])


def range_index(key: str, bounds: list[int], spread: Column) -> Column:
    """The range of a key, as a balanced tree of comparisons; ``spread``, a hash, parts a key that fills several ranges among them, in its order."""
    cuts = sorted(Counter(bounds).items())
    first = [0]
    for _, m in cuts:
        first.append(first[-1] + m)
    value = F.coalesce(key, F.lit(NO_ID))
    # the hash as a number from 0 to 1
    share = (spread / F.lit(2.0**64)) + F.lit(0.5)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            if lo < len(cuts) and cuts[lo][1] > 1:
                own = F.least(F.floor(share * cuts[lo][1]), F.lit(cuts[lo][1] - 1)).cast("int") + first[lo]
                return F.when(value == cuts[lo][0], own).otherwise(F.lit(first[lo]))
            return F.lit(first[lo])
        mid = (lo + hi) // 2
        return F.when(value > cuts[mid][0], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def by_range(df: DataFrame, key: str, spread: str, n: int) -> tuple[DataFrame, int]:
    """Rows range-partitioned by a long key and, within it, by a hash; partition i holds range i (column ``_range``), sorted by both within partitions."""
    bounds = range_bounds(df, key, n)
    out = df.withColumn("_range", range_index(key, bounds, F.col(spread)))
    return out.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions(key, spread), len(bounds) + 1


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI in the shared folder."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Staged:
    """Writes a file under a temporary name and moves it to its own name when it is whole.

    A task that is run again makes the same bytes and replaces the file, so a lost executor leaves nothing half-written
    under a final name.
    """

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temporary = f"{base}/{name}", f"{base}/_{name}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.sink = self.fs.open_output_stream(self.temporary)
        return self.sink

    def __exit__(self, kind, *_):
        if not self.sink.closed:
            self.sink.close()
        if kind is None:
            self.fs.move(self.temporary, self.final)
        else:
            self.fs.delete_file(self.temporary)
