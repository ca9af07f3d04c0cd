"""Matrices as files of the shared folder that tasks read by parts, for products of each part with each other.

A product of n rows with n rows needs each row about n / p times, for parts of p rows. Were the parts sent to their places by a shuffle, it
would write n / p copies of the matrix; here it is written once, by the tasks that have its rows, and read past the tasks' own part.
What the driver keeps is the list of the parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.runtime import scratch

#: Most rows and bytes of a part, and of parts that a task joins for one side of a product.
PART_ROWS, SIDE_ROWS, PART_BYTES = 512, 2560, 4 << 20
#: Cells of a batch of results.
CELLS = 1 << 17
#: Tasks of a product, about.
TASKS = 384

_INDEX = "key binary, path string, batch int, n int"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass(frozen=True)
class Part:
    """A record batch of a file: its key, its place and its number of rows."""

    key: object
    path: str
    batch: int
    n: int

    def read(self) -> pa.RecordBatch:
        fs, path = _file_system(self.path)
        with fs.open_input_file(path) as f:
            return pa.ipc.open_file(f).get_batch(self.batch)


def write(df: DataFrame, name: str, split: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[object, pa.RecordBatch]]]) -> list[Part]:
    """Writes the keyed record batches that ``split`` makes of each partition, a file for each, and lists them. A task that runs again
    writes another file; listed are those of the tasks that count."""
    import pickle

    folder = scratch(df.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, rows, sink, out = f"{folder}/{uuid.uuid4().hex}.arrow", [], None, None
        fs, path = _file_system(uri)
        for key, batch in split(batches):
            if out is None:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(path)
                out = pa.ipc.new_file(sink, batch.schema)
            out.write_batch(batch)
            rows.append((pickle.dumps(key), uri, len(rows), batch.num_rows))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["key", "path", "batch", "n"])

    return [Part(pickle.loads(bytes(r["key"])), r["path"], r["batch"], r["n"]) for r in df.mapInArrow(run, _INDEX).collect()]


def tasks(spark: SparkSession, work: list, f: Callable[[list], Iterator[pa.RecordBatch]], ddl: str, shared: object = None) -> DataFrame:
    """A task for each list of ``work``, which is broadcast: f(its list, shared)."""
    return _sent(spark, work, f, ddl, shared)[0]


def gather(spark: SparkSession, work: list, f: Callable[[list], Iterator[pa.RecordBatch]], ddl: str, shared: object = None) -> list:
    """The rows of :func:`tasks`; what was broadcast for them is deleted, so steps that follow each other leave nothing."""
    df, sent = _sent(spark, work, f, ddl, shared)
    try:
        return df.collect()
    finally:
        sent.destroy()


def _sent(spark: SparkSession, work: list, f: Callable[[list], Iterator[pa.RecordBatch]], ddl: str, shared: object):
    sent = spark.sparkContext.broadcast((work, shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                yield from f(sent.value[0][k], sent.value[1])

    return spark.range(0, len(work), 1, max(1, len(work))).mapInArrow(run, ddl), sent


# --- rows ---------------------------------------------------------------------------------------------------------------


def of_rows(matrix: DataFrame, rows: int = PART_ROWS) -> list[Part]:
    """Parts of so many rows at most, as each task has them; a part's key is (its smallest id, its largest)."""

    def keyed(held: list[pa.RecordBatch]) -> tuple[object, pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        i = b.column(0).to_numpy()
        return (int(i.min()), int(i.max())), b

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.RecordBatch]]:
        held: list[pa.RecordBatch] = []
        n, most = 0, rows
        for b in batches:
            if not b.num_rows:
                continue
            most = max(1, min(rows, PART_BYTES // max(1, 8 * len(b.column(1)[0].values))))
            at = 0
            while at < b.num_rows:
                take = min(most - n, b.num_rows - at)
                held.append(b.slice(at, take))
                n, at = n + take, at + take
                if n == most:
                    yield keyed(held)
                    held, n = [], 0
        if held:
            yield keyed(held)

    kept = matrix.select(F.col("i").cast("long").alias("i"), F.col("features").cast("array<double>").alias("features"))
    return write(kept, "rows", split)


def load(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the rows of parts, in the order of ids."""
    got = [p.read() for p in parts]
    i = np.concatenate([b.column(0).to_numpy() for b in got])
    x = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in got])
    if len(i) > 1 and (np.diff(i) < 0).any():
        order = np.argsort(i, kind="stable")
        i, x = i[order], x[order]
    return i, x


def sides(parts: list[Part], rows: int = SIDE_ROWS, least: int = 16) -> list[list[Part]]:
    """Parts that follow each other, joined to so many rows at most, and fewer where that left less than ``least`` sides."""
    total = sum(p.n for p in parts)
    most = max(1, min(rows, -(-total // least)))
    out: list[list[Part]] = []
    n = most
    for p in sorted(parts, key=lambda p: (p.path, p.batch)):
        if n + p.n > most:
            out.append([])
            n = 0
        out[-1].append(p)
        n += p.n
    return out


def runs(pairs: list, n: int = TASKS) -> list[list]:
    """Lists of pairs that follow each other, about n of them."""
    size = max(1, -(-len(pairs) // n))
    return [pairs[at : at + size] for at in range(0, len(pairs), size)]


def pairs_of(work: list[tuple[int, int]], a: list[list[Part]], b: list[list[Part]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, x, j, y) for pairs of a side of a and one of b; a side that stays from one pair to the next is read once."""
    held = None
    for p, q in work:
        if held is None or held[0] != p:
            held = (p, *load(a[p]))
        yield (*held[1:], *(load(b[q])))
