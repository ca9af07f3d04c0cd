"""Operator 3: exact top-k search over a bit-sliced index.

Vectors are quantised to integers. A block of the index holds, for each component, one bitmap over the block's rows for
each bit of the (offset) value. A query's inner products with all rows of a block are made as bitmaps too: for each set
bit of a query's component, the component's slices are added at that shift by a carry-save adder; a negative component
adds the complemented slices. The largest scores are then taken from the most significant slice downward, and rows that
are equal in all slices are told apart by their ids.

Every query meets every block. Queries are written in blocks of a fixed size to the shared folder. Index rows stay in their
tasks, where their slices are made once; a task holds the slices of up to ``HELD`` rows (some 100 MB at 64 components of 12 bits),
reads the query blocks past them one by one, and gives the k best of its rows for each query, so its memory grows with neither side.
Only these results are shuffled. A source of fewer partitions than the session has cores is dealt out first.

Edge cases: vectors that are null or hold null or non-finite components take no part, neither do rows without an id;
vectors meet only those of the same length, and empty vectors none; rows that repeat an id are candidates each and stand
apart only from queries of that id; fewer candidates than k give fewer rows; an empty table gives none; extra columns
are not read. A component beyond 32 bits after scaling raises ValueError.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import file_system
from tilewright.runtime import scratch, ship

BLOCK, QUERIES, HELD = 32768, 512, 1 << 20


class BitSliced:
    """The bit-sliced index of a block: values is rows x components."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order].astype(np.int64)
        n, self.dims = values.shape
        self.low = int(values.min())
        self.bits = max(1, int(values.max() - self.low).bit_length())
        self.words = -(-n // 64)
        offset = np.zeros((self.words * 64, self.dims), np.uint64)
        offset[:n] = (values - self.low).astype(np.uint64)
        self.valid = self._pack(np.arange(self.words * 64) < n)
        self.slices = np.empty((self.dims, self.bits, self.words), np.uint64)
        for d in range(self.dims):
            for b in range(self.bits):
                self.slices[d, b] = self._pack((offset[:, d] >> np.uint64(b)) & np.uint64(1))

    @staticmethod
    def _pack(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags.astype(bool), bitorder="little").view("<u8")

    def scores(self, query: list[int]) -> tuple[np.ndarray, int]:
        """Slices of non-negative numbers and what to add to each: the inner products."""
        top = (1 << self.bits) - 1
        width = max(1, (sum(map(abs, query)) * top).bit_length()) + 1
        s, c = (np.zeros((width + 1, self.words), np.uint64) for _ in range(2))
        for d, q in enumerate(query):
            y = self.slices[d] if q >= 0 else ~self.slices[d]
            m, shift = abs(q), 0
            while m:
                if m & 1:
                    lo, hi = shift, shift + self.bits
                    # where the operand has slices
                    a, k = s[lo:hi], c[lo:hi]
                    x = a ^ k
                    carry = (a & k) | (x & y)
                    # above it: a half adder
                    ah, kh = s[hi:width], c[hi:width]
                    high = ah & kh
                    s[hi:width] = ah ^ kh
                    s[lo:hi] = x ^ y
                    c[lo + 1 : hi + 1] = carry
                    c[lo] = 0
                    c[hi + 1 : width + 1] = high
                m, shift = m >> 1, shift + 1
        total, carry = np.empty((width, self.words), np.uint64), np.zeros(self.words, np.uint64)
        for i in range(width):
            x = s[i] ^ c[i]
            total[i] = x ^ carry
            carry = (s[i] & c[i]) | (x & carry)
        return total, self.low * sum(query) + sum(q * top for q in query if q < 0)

    def top(self, query: list[int], k: int, own: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows whose id is not ``own``."""
        slices, add = self.scores(query)
        equal, sure = self.valid.copy(), np.zeros(self.words, np.uint64)
        lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        for i in range(lo, hi):
            equal[i // 64] &= ~np.uint64(1 << (i % 64))
        for x in slices[::-1]:
            both = equal & x
            n = int(np.bitwise_count(sure | both).sum())
            if n > k:
                equal = both
            elif n < k:
                sure, equal = sure | both, equal & ~x
            else:
                sure, equal = sure | both, np.zeros_like(equal)
                break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(rows) < k:
            tied = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, tied[: k - len(rows)]])
        bit = (slices[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
        values = [int(sum(int(v) << i for i, v in enumerate(col))) + add for col in bit.T]
        return list(zip(values, self.ids[rows].tolist(), strict=True))


def _vectors(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integers) of the vectors of one length, by batches of (id, vector)."""
    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls as NaN
        sizes = np.diff(offsets)
        for dims in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dims)
            x = flat[offsets[at][:, None] + np.arange(dims)]
            good = np.isfinite(x).all(1)
            at, x = at[good], np.floor(scale * x[good])
            if len(at):
                if np.abs(x).max() >= 2**31:
                    raise ValueError(f"vector {ids[at[np.abs(x).max(1).argmax()]]} is beyond 32 bits")
                yield ids[at], x.astype("<i4")


def _grouped(vectors: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same vectors, so many of a length together."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for ids, x in vectors:
        for s in range(0, len(ids), rows):
            mine = held[x.shape[1]]
            mine.append((ids[s : s + rows], x[s : s + rows]))
            if sum(len(i) for i, _ in mine) >= rows:
                i, v = (np.concatenate(y) for y in zip(*mine, strict=True))
                yield i[:rows], v[:rows]
                held[x.shape[1]] = [(i[rows:], v[rows:])] if len(i) > rows else []
    for mine in held.values():
        if mine:
            yield tuple(np.concatenate(y) for y in zip(*mine, strict=True))


def _asked(rows: DataFrame, scale: float) -> list[str]:
    """Files of query blocks (dims, ids, data) in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _grouped(_vectors(batches, scale), QUERIES):
            yield pa.RecordBatch.from_pydict({"dims": pa.array([x.shape[1]], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()]), "data": pa.array([x.tobytes()])})

    path = scratch(rows.sparkSession, "queries")
    rows.mapInArrow(run, "dims int, ids binary, data binary").write.parquet(path)
    fs, base = file_system(path)
    return sorted(f"{path}/{f.base_name}" for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".parquet"))


def _queries(files: list[str]) -> Iterator[tuple[list[int], list[list[int]]]]:
    for path in files:
        fs, base = file_system(path)
        with fs.open_input_file(base) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1):
                for dims, ids, data in zip(*(b.column(c).to_pylist() for c in ("dims", "ids", "data")), strict=True):
                    yield np.frombuffer(ids, "<i8").tolist(), np.frombuffer(data, "<i4").reshape(-1, dims).tolist()


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): the k rows of the largest integer inner products with each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where("id is not null and v is not null")
    files = _asked(rows.where(F.col("id") % every == 0), scale)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[BitSliced]] = defaultdict(list)
        n = 0

        def ask() -> Iterator[pa.RecordBatch]:
            for ids, queries in _queries(files):
                out = []
                for key, query in zip(ids, queries, strict=True):
                    got = [x for block in held.get(len(query), ()) for x in block.top(query, k, key)]
                    out += [(key, v, s) for s, v in sorted(got, key=lambda x: (-x[0], x[1]))[:k]]
                if out:
                    q, v, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), id_col: pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

        for ids, x in _grouped(_vectors(batches, scale), BLOCK):
            held[x.shape[1]].append(BitSliced(ids, x))
            n += len(ids)
            if n >= HELD:
                yield from ask()
                held.clear()
                n = 0
        if n:
            yield from ask()

    found = rows.mapInArrow(run, f"query_id long, `{id_col}` long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
