"""Operator 5: deletion of later copies of repeated line runs, by a suffix array over line ids.

A document is its sequence of lines, and a line's id is a 128-bit hash of its text. A run of lines counts if its lines have
``min_chars`` characters or more together. Deleted is every line in a run that counts and that also starts at an earlier
place: in a document with a smaller id, or earlier in the same one. The bound so stands on the maximal repeated run, however many
lines it has, and the first copy of everything stays.

Suffixes of the line sequences are sorted by prefix doubling: the rank of a place at depth h is the number of places whose run of h
lines is smaller, which is the start of its interval of the suffix array whose common prefix has h lines or more. Two ranks, h lines
apart, make the rank at depth 2h. Each round adds up the rank pairs, numbers the distinct ones in their order by a range
sort, and brings ranks back; places whose interval has no other place, and those in no longer run that counts, leave.

A maximal repeated run that counts is the union of the shortest runs that count from each of its lines on and up to each of its
lines: a line with enough characters after it within the run begins one of the first kind, any other is in the one of the second
kind that ends with the run. Whether a run counts depends on its text alone, so these runs, two for each line at most, are found
beforehand, and doubling stops at the longest of them that still repeats. A run of m lines, h <= m < 2h, is in the interval of common
prefix m that its two ends of h lines name: the ranks at its start and h lines before its stop. The interval's first place
keeps its copy; the others lose theirs.

Counts and first places combine before their shuffles, and the joins that bring ranks back have one row for each interval, written
first, so adaptive execution can split the rows of a hot line.

Edge cases: a null text is an empty one, of one empty line; lines end at line feeds alone; rows that repeat both id and
text are one document and lose the same lines; rows that repeat an id with different texts are ordered by the texts'
hashes; rows without an id come last; an empty table gives an empty result; extra columns are kept; a very long text is one row,
whose lines are rows of their own from the first step on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.common import Out
from tilewright.runtime import cut, partitions, release, ship

MIN_CHARS = 60
_NO_ID = (1 << 63) - 1
_PLACE = ("d", "t", "p")


def shortest_runs(sizes: list[int], least: int) -> Iterator[tuple[int, int]]:
    """Of lines of these sizes, the shortest runs of a size of ``least`` or more from each line on and up to each line, as (start, stop)."""
    n, total, stop, stops = len(sizes), 0, 0, []
    for p in range(n):
        while stop < n and (stop <= p or total < least):
            total += sizes[stop]
            stop += 1
        if total < least:
            break
        yield p, stop
        stops.append(stop)
        total -= sizes[p]
    total = start = 0
    for p in range(n):
        total += sizes[p]
        while start < p and total - sizes[start] >= least:
            total -= sizes[start]
            start += 1
        if total >= least and stops[start] != p + 1:
            yield start, p + 1


def _levels(runs: list[tuple[int, int]], n: int) -> np.ndarray:
    """For each line the logarithm, rounded down, of the longest of the runs that it is in (-1: in none)."""
    out = np.full(n, -1)
    if runs:
        start, stop = np.array(runs).T
        level = np.array([(z - a).bit_length() - 1 for a, z in runs])
        for k in np.unique(level):
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, start[level == k], 1)
            np.add.at(edges, stop[level == k], -1)
            out[np.cumsum(edges[:-1]) > 0] = k
    return out


def _lines(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(d, t, p, c, e, level, runs): place and 128-bit id of each line, its level, and the lengths of the shortest runs that start there."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    schema = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("p", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("level", pa.int32()), ("runs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for b in batches:
            for d, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                lines = text.as_py().split("\n")
                found = list(shortest_runs([len(x) for x in lines], least))
                starts: dict[int, list[int]] = {}
                for a, z in found:
                    starts.setdefault(a, []).append(z - a)
                for p, (line, level) in enumerate(zip(lines, _levels(found, len(lines)).tolist(), strict=True)):
                    c, e = np.frombuffer(hashlib.blake2b(line.encode(), digest_size=16).digest(), "<i8").tolist()
                    if out.add(d, t, p, c, e, level, starts.get(p)):
                        yield out.take()
        yield out.take()

    return texts.mapInArrow(run, "d long, t long, p long, c long, e long, level int, runs array<long>")


def _intervals(places: DataFrame, names: list[str]) -> DataFrame:
    """(names, first): the names that more than one place has, with the first place; written."""
    place = F.struct(*_PLACE)
    found = places.groupBy(*names).agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"), F.max(place).alias("last"))
    return cut(found.where("first <> last").drop("last"), "intervals")


def _ranked(intervals: DataFrame, names: list[str]) -> DataFrame:
    """(names, rank, first): intervals with the number of places in those of smaller names; written.

    Sorted by range; a task adds up the sizes of its range, and one sum for each range goes by the driver.
    """
    spark = intervals.sparkSession
    ordered = intervals.repartitionByRange(partitions(spark), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            sizes = b.column(b.schema.get_field_index("size")).to_numpy()
            ends = before + np.cumsum(sizes)
            yield b.append_column("start", pa.array(ends - sizes)).append_column("part", pa.array(np.full(b.num_rows, part, np.int32)))
            before = int(ends[-1]) if len(ends) else before

    schema = intervals.withColumn("start", F.lit(0).cast("long")).withColumn("part", F.lit(0)).schema
    found = cut(ordered.mapInArrow(run, schema), "ranges")
    sums = {r["part"]: r["n"] for r in found.groupBy("part").agg(F.sum("size").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, offset long"))
    out = cut(found.join(offsets, "part").select(*names, (F.col("start") + F.col("offset")).alias("rank"), "first"), "ranks")
    release(found, intervals)
    return out


def _copies(at: DataFrame, h: int) -> DataFrame:
    """(d, t, p, m): the runs of h to 2h - 1 lines that also start at an earlier place, by the ranks ``at`` depth h; written."""
    runs = at.where("runs is not null").withColumn("m", F.explode("runs")).where((F.col("m") >= h) & (F.col("m") < 2 * h)).select(*_PLACE, "m", "rank", "first")
    later = F.struct(*_PLACE) > F.col("first")
    found = runs.where((F.col("m") == h) & later).select(*_PLACE, "m")
    if h > 1:
        ends = at.select("d", "t", F.col("p").alias("q"), F.col("rank").alias("last_rank"))
        both = runs.where(F.col("m") > h).drop("first").withColumn("q", F.col("p") + F.col("m") - h).join(ends, ["d", "t", "q"])
        both = cut(both.select(*_PLACE, "m", "rank", "last_rank"), "runs")
        names = ["m", "rank", "last_rank"]
        found = found.unionByName(both.join(_intervals(both, names), names).where(later).select(*_PLACE, "m"))
    return cut(found, "copies")


def deleted(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, lines): by id (the largest long for none) and xxhash64 of the text, the numbers of its deleted lines."""
    ship(docs.sparkSession)
    places = cut(_lines(docs, min_chars, id_col, text_col), "lines")
    names, h, copies = ["c", "e"], 1, None
    while True:
        ranks = _ranked(_intervals(places, names), names)
        at = places.join(ranks, names).select(*_PLACE, "rank", "first", "level", "runs")
        # rows that repeat a document give its places once
        at = cut(at.dropDuplicates(_PLACE) if h == 1 else at, "suffixes")
        release(places, ranks)
        found = _copies(at, h)
        copies = found if copies is None else copies.unionByName(found)
        longer = at.where(F.col("level") >= (2 * h).bit_length() - 1)
        if not longer.limit(1).count():
            break
        after = longer.select("d", "t", (F.col("p") - h).alias("p"), F.col("rank").alias("next_rank"))
        places = cut(longer.join(after, list(_PLACE)).select(*_PLACE, "rank", "next_rank", "level", "runs").withColumnRenamed("rank", "own_rank"), "pairs")
        release(at)
        names, h = ["own_rank", "next_rank"], 2 * h
    release(at)
    # of each run only the lines beyond those that begin before it, so that no line comes twice
    doc = Window.partitionBy("d", "t").orderBy("p", "stop")
    stops = copies.select(*_PLACE, (F.col("p") + F.col("m")).alias("stop")).distinct()
    start = F.greatest("p", F.coalesce(F.max("stop").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    gone = stops.select("d", "t", start.alias("p"), "stop").where("p < stop").select("d", "t", F.explode(F.sequence(F.col("p").cast("int"), (F.col("stop") - 1).cast("int"))).alias("p"))
    return gone.groupBy("d", "t").agg(F.collect_set("p").alias("lines"))


def without_copies(docs: DataFrame, drop_emptied: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, their texts without the deleted lines, and ``n_lines`` and ``n_deleted``.

    ``drop_emptied`` leaves out the documents that had text and have none left. Where the columns have one of the new
    names, the new column takes its place.
    """
    new = f"_{'_'.join(docs.columns)}_"  # clashes with no column
    found = deleted(docs, id_col=id_col, text_col=text_col, **options).select(F.col("d").alias(f"{new}d"), F.col("t").alias(f"{new}t"), F.col("lines").alias(f"{new}lines"))
    key = (F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)) == found[f"{new}d"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == found[f"{new}t"])
    kept = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    joined = docs.join(found, key, "left").select(*[docs[c] for c in kept], f"{new}lines")
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, cut_, stay = [], [], [], []
            for text, gone in zip(b.column(at), b.column(b.num_columns - 1).to_pylist(), strict=True):
                text = text.as_py()
                lines = (text or "").split("\n")
                sizes.append(len(lines))
                cut_.append(len(gone or ()))
                if gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(text)
                stay.append(not (drop_emptied and gone and not text.strip()))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(kept))] + [pa.array(sizes, pa.int64()), pa.array(cut_, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_lines", "n_deleted"]).filter(pa.array(stay, pa.bool_()))

    ddl = docs.select(*kept).withColumn(text_col, F.col(text_col).cast("string")).withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_deleted", F.lit(0).cast("long")).schema
    return joined.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, ddl)
