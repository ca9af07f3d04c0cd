"""Operator 4: exact removal of byte strings that also start in an earlier document, by sorted suffixes.

Every string of ``length`` bytes that starts in a document with a smaller id has all of its bytes removed. Suffixes are
compared on their first ``length`` bytes only, so the suffix array is needed up to that depth; and a repeated string
repeats its anchor, the leftmost of its ``SEED``-byte substrings with the lowest hash, so suffixes need to be sorted only
around anchors that more than one document has:

1. Anchors. Tasks exchange the hashes of their anchors; those of one document alone are done with.
2. Contexts. The strings of one anchor are neighbours: together they are the suffix at the first one's start up to the
   last one's end. These contexts, turned so that they begin with the anchor, are sorted into a run by each task,
   equal ones collapse to the smallest id, and runs are front-coded, cut at common splitters, exchanged, and merged by a
   loser tree that never compares a known prefix again. A context that an earlier document has is removed whole.
3. Strings. Where an anchor has several contexts, their strings can be equal though the contexts differ. The strings of
   the contexts that remain are sorted, exchanged and merged in the same way.

Answers go back as bits for the rows of a run (some ``CHUNK`` bytes of neighbouring texts) in their sorted order, which each reading
makes again, so what is removed follows from equal bytes alone; one file for each partition of the source and step, in the shared folder.
Runs are merged by as many tasks as have some ``BUCKET`` bytes of text each.
A scan is read four times and never shuffled. Equal strings collapse in the runs before any exchange, and splitters
may fall between strings with a common anchor, so a passage that a third of all rows share loads no task more than others.

Edge cases: null and empty texts give no bytes; texts shorter than ``length`` lose nothing; rows of equal id do not
remove from each other, whatever their texts; rows without an id are neither changed nor earlier than any row; an empty
table gives an empty result; extra columns are not read. A source whose partitions are not the same in each reading
(any but a scan of files) is written to the shared folder first.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import suffixes
from tilewright.llm.common import Out, Staged, file_system, text_of
from tilewright.runtime import cut, partitions, scratch, ship

SEED = 32
#: Bytes of text in a run.
CHUNK = 16 << 20
#: Bytes of text to a task that merges runs.
BUCKET = 6 << 20
_BLOCK = 1 << 17
_NO_ID = (1 << 63) - 1
_SAMPLE_RUNS, _SAMPLES = 2000, 128
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(23)).astype(np.uint32)
_R = 0x9E3779B1


def _rolled(b: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k bytes, by doubling."""
    powers, m = {1: _TABLE[b]}, 1
    while 2 * m <= k:
        x = powers[m]
        powers[2 * m] = x[:-m] * np.uint32(pow(_R, m, 1 << 32)) + x[m:]
        m *= 2
    h, done = powers[m], m
    while done < k:
        m = 1 << ((k - done).bit_length() - 1)
        n = len(b) - done - m + 1
        h = h[:n] * np.uint32(pow(_R, m, 1 << 32)) + powers[m][done : done + n]
        done += m
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def _kind(length: int) -> np.dtype:
    """Numbers that hold offsets within a string and its context."""
    return np.dtype(np.uint8 if length < 256 else "<u2" if length < 65536 else "<u4")


def _context_width(length: int) -> int:
    """Bytes of a context's row: the string from its anchor on, what can be before, and the lengths of both."""
    return -(-(2 * length - min(SEED, length) + 2 * _kind(length).itemsize) // 8) * 8


class Chunk:
    """Neighbouring texts as one array of bytes, with the anchors of their strings.

    ``anchor``, ``low`` and ``high``: the anchor's place and the first and last string that it is the anchor of.
    """

    def __init__(self, run: int, ids: list[int | None], texts: list[bytes], length: int, find: bool = True):
        self.run, self.length, self.kind = run, length, _kind(length)
        self.ids = np.array([_NO_ID if i is None else i for i in ids], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n, seed = len(self.data), min(SEED, length)
        self.seed, self.wide = seed, length - seed + 1
        if not find:
            return
        whole = np.zeros(max(0, n - length + 1), bool)
        for a, z, i in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), self.ids.tolist(), strict=True):
            if i != _NO_ID:
                whole[a : max(a, z - length + 1)] = True
        parts = []
        for s in range(0, len(whole), _BLOCK):
            e = min(s + _BLOCK, len(whole))
            h = _rolled(self.data[s : e + length - 1], seed)
            x = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
            m = 1
            while 2 * m <= self.wide:
                x = np.minimum(x[:-m], x[m:])
                m *= 2
            if m < self.wide:
                x = np.minimum(x[: len(x) - (self.wide - m)], x[self.wide - m :])
            a = np.where(whole[s:e], (x & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
            low = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            high = np.concatenate([low[1:], [len(a)]]) - 1
            real = a[low] >= 0
            parts.append(np.stack([a[low][real], low[real], high[real]]) + s)
        self._set(*(np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)))

    def _set(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.anchor, self.low, self.high = anchor, low, high
        self.doc = self.ids[np.searchsorted(self.starts, low, "right") - 1]

    def packed(self) -> bytes:
        """The anchors, to be found again by :meth:`unpack`."""
        return len(self.low).to_bytes(8, "little") + (self.anchor - self.low).astype(self.kind).tobytes() + (self.high - self.low).astype(self.kind).tobytes() + suffixes.squeeze(self.low)

    def unpack(self, raw: bytes) -> None:
        n = int.from_bytes(raw[:8], "little")
        size = self.kind.itemsize * n
        low = suffixes.expand(raw[8 + 2 * size :]).astype(np.int64)
        self._set(low + np.frombuffer(raw, self.kind, n, 8), low, low + np.frombuffer(raw, self.kind, n, 8 + size))

    def keys(self) -> np.ndarray:
        """64-bit hashes of the anchors' own bytes."""
        width = -(-self.seed // 8) * 8
        rows = np.zeros((len(self.anchor), width), np.uint8)
        rows[:, : self.seed] = np.lib.stride_tricks.sliding_window_view(self.data, self.seed)[self.anchor] if len(self.anchor) else 0
        return suffixes.hashes(rows)

    def pick(self, which: np.ndarray) -> None:
        self.anchor, self.low, self.high, self.doc = (x[which] for x in (self.anchor, self.low, self.high, self.doc))

    def contexts(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The contexts as rows: from the anchor to the end, the part before the anchor, and the lengths of both."""
        a, lo, hi = self.anchor[which], self.low[which], self.high[which]
        right, left = self.length, self.wide - 1
        rows = np.zeros((len(a), _context_width(right)), np.uint8)
        if len(a):
            padded = np.concatenate([self.data, np.zeros(right + left, np.uint8)])
            seen = np.lib.stride_tricks.sliding_window_view(padded, right)
            after, before = hi + self.length - a, a - lo
            rows[:, :right] = seen[a] * (np.arange(right) < after[:, None])
            if left:
                seen = np.lib.stride_tricks.sliding_window_view(padded, left)
                rows[:, right : right + left] = seen[lo] * (np.arange(left) < before[:, None])
            rows[:, right + left : right + left + 2 * self.kind.itemsize] = np.stack([after, before], 1).astype(self.kind).view(np.uint8)
        return rows

    def strings(self, which: np.ndarray, most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of some anchors (the first so many of each) as rows, with their places and documents."""
        lo, n = self.low[which], np.minimum(self.high[which] - self.low[which] + 1, most)
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        rows = np.zeros((len(at), -(-self.length // 8) * 8), np.uint8)
        if len(at):
            rows[:, : self.length] = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at]
        return rows, at, np.repeat(self.doc[which], n)


def _chunks(batches: Iterator[pa.RecordBatch], length: int, size: int, find: bool) -> Iterator[Chunk]:
    part, k, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = text.as_buffer()
            if held and held + len(raw) > size:
                yield Chunk(part << 24 | k, ids, texts, length, find)
                k, ids, texts, held = k + 1, [], [], 0
            ids.append(key)
            texts.append(raw.to_pybytes())
            held += len(raw)
    if ids:
        yield Chunk(part << 24 | k, ids, texts, length, find)


def _mark(c: Chunk) -> bytes:
    return xxhash.xxh3_128_digest(c.ids.tobytes() + c.starts.tobytes())


class Mail:
    """Data for each run, in one file in the shared folder for each partition of the source.

    A file is the runs' numbers and sizes, and then their data.
    """

    def __init__(self, folder: str):
        self.folder, self.held, self.read = folder, {}, (-1, {})

    def _write(self, part: int, runs: dict[int, bytes]) -> None:
        with Staged(self.folder, f"part-{part:08x}") as f:
            f.write(np.array([len(runs), *runs, *map(len, runs.values())], "<u8").tobytes())
            for data in runs.values():
                f.write(data)

    def put(self, run: int, data: bytes) -> None:
        """Keeps a run's data until :meth:`flush`."""
        self.held[run] = data

    def flush(self) -> None:
        if self.held:
            self._write(next(iter(self.held)) >> 24, self.held)
        self.held = {}

    def runs(self, part: int) -> dict[int, tuple[int, int]]:
        """Start and size of the data of each run of a partition; the index read last is kept."""
        if self.read[0] != part:
            fs, base = file_system(self.folder)
            path = f"{base}/part-{part:08x}"
            at: dict[int, tuple[int, int]] = {}
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                with fs.open_input_file(path) as f:
                    n = int(np.frombuffer(f.read(8), "<u8")[0])
                    runs, sizes = np.frombuffer(f.read(16 * n), "<u8").astype(np.int64).reshape(2, n)
                ends = 8 + 16 * n + np.cumsum(sizes)
                at = dict(zip(runs.tolist(), zip((ends - sizes).tolist(), sizes.tolist(), strict=True), strict=True))
            self.read = (part, at)
        return self.read[1]

    def fetch(self, run: int) -> bytes:
        """The run's data, or nothing where it has none."""
        start, size = self.runs(run >> 24).get(run, (0, 0))
        if not size:
            return b""
        fs, base = file_system(self.folder)
        with fs.open_input_file(f"{base}/part-{run >> 24:08x}") as f:
            f.seek(start)
            return f.read(size)

    def send(self, rows: DataFrame, n: int) -> None:
        """Writes (run, bucket, data) rows, which are a few bits for each row of a run, to a file for each partition of the source."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, made = None, 0
            runs: dict[int, list[bytes]] = {}

            def give() -> int:
                if runs:
                    self._write(last, {k: b"".join(v) for k, v in runs.items()})
                    runs.clear()
                    return 1
                return 0

            for b in batches:
                for key, bucket, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if key >> 24 != last:
                        made += give()
                        last = key >> 24
                    runs.setdefault(key, []).extend([np.array([bucket, len(data)], "<u4").tobytes(), data])
            made += give()
            yield pa.RecordBatch.from_pydict({"n": pa.array([made], pa.int64())})

        part = F.shiftright("run", 24)
        rows.repartition(n, part).sortWithinPartitions("run", "bucket").mapInArrow(run, "n long").agg(F.sum("n")).collect()

    def parts(self, run: int) -> Iterator[tuple[int, bytes]]:
        raw, at = self.fetch(run), 0
        while at < len(raw):
            bucket, n = np.frombuffer(raw, "<u4", 2, at).tolist()
            yield bucket, raw[at + 8 : at + 8 + n]
            at += 8 + n

    def states(self, run: int, cuts: list[int]) -> np.ndarray:
        """Two bits for each row of a sorted run that splitters cut so."""
        out = np.zeros((2, cuts[-1] if cuts else 0), bool)
        for bucket, data in self.parts(run):
            a, z = cuts[bucket], cuts[bucket + 1]
            out[:, a:z] = np.unpackbits(np.frombuffer(data, np.uint8).reshape(2, -1), axis=1, count=z - a)
        return out


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _cuts(rows: np.ndarray, splitters: np.ndarray) -> list[int]:
    """Where splitters cut sorted rows."""
    return [0, *np.searchsorted(suffixes.as_strings(rows), splitters).tolist(), len(rows)] if len(rows) else []


_ROWS = "run long, bucket int, data binary"
_ROW_SCHEMA = pa.schema([("run", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])


def _by_key(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes as buckets and 32 more bits of them, in ascending order, with their places and where new ones begin.

    A clash makes a candidate that the sorted suffixes tell apart.
    """
    full = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
    o = np.argsort(full)
    full = full[o]
    return full, o, np.concatenate([[True], full[1:] != full[:-1]]) if len(full) else np.empty(0, bool)


def _entries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A run's hashes in a bucket, and which of them several of its documents have."""
    n = 4 + int.from_bytes(raw[:4], "little")
    keys = suffixes.expand(raw[4:n])
    return keys, np.unpackbits(np.frombuffer(raw, np.uint8, offset=n), count=len(keys)).astype(bool)


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as disjoint ones that do not touch, in order."""
    if not len(begin):
        return begin, end
    o = np.argsort(begin, kind="stable")
    begin, end = begin[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.concatenate([new[1:], [True]])]


class Dedup:
    """The passes over one source."""

    def __init__(self, docs: DataFrame, length: int, chunk: int):
        self.spark, self.length, self.chunk = docs.sparkSession, length, chunk
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(partitions(self.spark), -(-size // BUCKET))
        self.docs, self.folder = docs, scratch(self.spark, "suffixes")
        self.marks, self.shared, self.found, self.context_mail, self.states, self.string_mail = (Mail(f"{self.folder}/{x}") for x in ("marks", "shared", "candidates", "contexts", "states", "strings"))

    def _pass(self, work: Callable[[Chunk, Out], Iterator[pa.RecordBatch] | None], ddl: str, schema: pa.Schema, find: bool, mail: tuple[Mail, ...] = ()) -> DataFrame:
        """``mail`` is what ``work`` puts data into."""
        length, size = self.length, self.chunk

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = Out(schema)
            for c in _chunks(batches, length, size, find):
                yield from work(c, out) or ()
                yield out.take()
            for m in mail:
                m.flush()

        return self.docs.mapInArrow(run, ddl)

    def anchors(self) -> list[np.ndarray]:
        """Step 1; returns splitters for contexts and for strings."""
        buckets, marks = self.buckets, self.marks

        def send(c: Chunk, out: Out) -> None:
            h = c.keys()
            # the smallest hashes are a sample of the run
            some = np.argpartition(h, min(_SAMPLES, len(h)) - 1)[:_SAMPLES] if len(h) else np.empty(0, np.int64)
            marks.put(c.run, _mark(c) + c.contexts(some).tobytes() + c.strings(some, 1)[0].tobytes())
            full, o, new = _by_key(h, buckets)
            first = np.flatnonzero(new)
            if not len(first):
                return
            doc = c.doc[o]
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            full = full[new]
            cuts = np.searchsorted(full >> np.uint64(32), np.arange(buckets + 1))
            for i in range(buckets):
                a, z = cuts[i], cuts[i + 1]
                if a < z:
                    keys = suffixes.squeeze(full[a:z] & np.uint64(0xFFFFFFFF))
                    out.add(c.run, i, len(keys).to_bytes(4, "little") + keys + np.packbits(several[a:z]).tobytes())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = []
            for b in batches:
                for r, i, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    got.append((r, i, *_entries(d)))
            if not got:
                return
            every = np.concatenate([v for _, _, v, _ in got])
            every.sort()
            twice = every[1:][every[1:] == every[:-1]]
            shared = np.sort(np.concatenate([twice, *(v[s] for _, _, v, s in got)]))
            out = Out(_ROW_SCHEMA)
            for r, i, v, _ in got:
                flags = _has(shared, v)
                if flags.any() and out.add(r, i, np.packbits(flags).tobytes(), size=len(v) // 8):
                    yield out.take()
            yield out.take()

        sent = self._pass(send, _ROWS, _ROW_SCHEMA, True, (marks,))
        self.shared.send(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, _ROWS), buckets)
        return self._splitters()

    def _splitters(self) -> list[np.ndarray]:
        """From the samples of a bounded number of runs, spread over all."""
        fs, base = file_system(self.marks.folder)
        names = sorted((f.base_name for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("part-")), key=lambda x: xxhash.xxh3_64_intdigest(x))
        widths = [_context_width(self.length), -(-self.length // 8) * 8]
        got: list[list[np.ndarray]] = [[], []]
        runs = (run for name in names for run in self.marks.runs(int(name[5:], 16)))
        for run in itertools.islice(runs, _SAMPLE_RUNS):
            raw = self.marks.fetch(run)[16:]
            n = len(raw) // sum(widths)
            got[0].append(np.frombuffer(raw, np.uint8, n * widths[0]).reshape(n, -1))
            got[1].append(np.frombuffer(raw, np.uint8, n * widths[1], n * widths[0]).reshape(n, -1))
        out = []
        for rows, width in zip(got, widths, strict=True):
            x = np.sort(suffixes.as_strings(np.concatenate([*rows, np.empty((0, width), np.uint8)])))
            x = x[(np.arange(1, self.buckets) * len(x)) // self.buckets] if len(x) else x
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
        return out

    @staticmethod
    def _emit(c: Chunk, out: Out, rows: np.ndarray, docs: np.ndarray, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, docs, _ = suffixes.sorted_run(rows, docs)
        cuts = _cuts(rows, splitters)
        for i in range(len(cuts) - 1):
            if cuts[i] < cuts[i + 1]:
                raw = suffixes.front_code(rows[cuts[i] : cuts[i + 1]], docs[cuts[i] : cuts[i + 1]])
                if out.add(c.run, i, raw, size=len(raw)):
                    yield out.take()

    def _merge(self, sent: DataFrame, splitters: np.ndarray, seed: int) -> DataFrame:
        """(run, bucket, data): for the rows that a run sent to a bucket, in their order, bits that say which of them an earlier
        document has elsewhere, and, if ``seed``, bits that say which share their first so many bytes with another row."""
        ranges = len(splitters) + 1

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, parts, bucket = [], [], 0
            for b in batches:
                for r, i, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    bucket = i
                    names.append(r)
                    parts.append(suffixes.decode(d))
            if not names:
                return
            width = len(parts[0][0][0])
            order, known = (np.array(x) for x in suffixes.merge([x for x, _, _ in parts], [p for _, p, _ in parts]))
            # the place of each taken row in the concatenation of the runs
            base = np.concatenate([[0], np.cumsum([len(d) for _, _, d in parts])])
            by_run = np.argsort(order, kind="stable")  # a run's rows are taken in their order
            doc = np.empty(len(order), np.int64)
            doc[by_run] = np.concatenate([d for _, _, d in parts])
            new = known < width
            new[0] = True
            first = np.flatnonzero(new)
            cls = np.cumsum(new) - 1
            state = np.zeros((2, len(doc)), bool)
            state[0] = np.minimum.reduceat(doc, first)[cls] < doc
            if seed:
                group = np.concatenate([[0], np.cumsum(known[1:] < seed)])
                several = np.bincount(group, new) > 1
                head = np.flatnonzero(np.concatenate([[True], np.diff(group) > 0]))
                # a group at the edge of the range may go on in the next one
                for edge, g in ((bucket - 1, 0), (bucket, group[-1])):
                    if 0 <= edge < len(splitters):
                        at = head[g]
                        row = parts[order[at]][0][_place(order, by_run, at, base)]
                        if splitters[edge].ljust(width, b"\0")[:seed] == row[:seed]:
                            several[g] = True
                state[1] = several[group]
            back = state[:, by_run]
            out = Out(_ROW_SCHEMA)
            for k, r in enumerate(names):
                mine = back[:, base[k] : base[k + 1]]
                if mine.any() and out.add(r, bucket, np.packbits(mine, axis=1).tobytes(), size=mine.size // 8):
                    yield out.take()
            yield out.take()

        return sent.repartitionById(ranges, F.col("bucket")).mapInArrow(meet, _ROWS)

    def contexts(self, splitters: np.ndarray) -> None:
        """Step 2."""
        sent, me = self.spark.sparkContext.broadcast(splitters), self._slim()

        def send(c: Chunk, out: Out) -> Iterator[pa.RecordBatch]:
            me.check(c)
            full, o, new = _by_key(c.keys(), me.buckets)
            flags = np.zeros(int(new.sum()), bool)
            cuts = np.searchsorted(full[new] >> np.uint64(32), np.arange(me.buckets + 1))
            for i, raw in me.shared.parts(c.run):
                flags[cuts[i] : cuts[i + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=cuts[i + 1] - cuts[i])
            which = np.zeros(len(o), bool)
            which[o] = flags[np.cumsum(new) - 1] if len(o) else False
            c.pick(which)
            me.found.put(c.run, c.packed())
            return Dedup._emit(c, out, c.contexts(), c.doc, sent.value)

        self.context_mail.send(self._merge(self._pass(send, _ROWS, _ROW_SCHEMA, True, (me.found,)), splitters, min(SEED, self.length)), self.buckets)

    def check(self, c: Chunk) -> None:
        if self.marks.fetch(c.run)[:16] != _mark(c):
            raise RuntimeError("the source gave other partitions than in the first pass")

    def strings(self, of_contexts: np.ndarray, of_strings: np.ndarray) -> None:
        """Step 3."""
        sent, me = self.spark.sparkContext.broadcast((of_contexts, of_strings)), self._slim()

        def send(c: Chunk, out: Out) -> Iterator[pa.RecordBatch]:
            me.check(c)
            c.unpack(me.found.fetch(c.run))
            rows, docs, place = suffixes.sorted_run(c.contexts(), c.doc)
            earlier, several = me.context_mail.states(c.run, _cuts(rows, sent.value[0]))[:, place]
            gone = (c.doc > docs[place]) | earlier
            unsure = ~gone & several
            me.states.put(c.run, np.packbits(gone).tobytes() + np.packbits(unsure).tobytes())
            rows, _, docs = c.strings(unsure)
            return Dedup._emit(c, out, rows, docs, sent.value[1])

        self.string_mail.send(self._merge(self._pass(send, _ROWS, _ROW_SCHEMA, False, (me.states,)), of_strings, 0), self.buckets)

    def result(self, splitters: np.ndarray, id_col: str) -> DataFrame:
        schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

        sent, me = self.spark.sparkContext.broadcast(splitters), self._slim()

        def give(c: Chunk, out: Out) -> Iterator[pa.RecordBatch]:
            me.check(c)
            c.unpack(me.found.fetch(c.run))
            gone, unsure = (np.unpackbits(x, count=len(c.low)).astype(bool) for x in np.frombuffer(me.states.fetch(c.run), np.uint8).reshape(2, -1))
            rows, at, docs = c.strings(unsure)
            rows, least, place = suffixes.sorted_run(rows, docs)
            at = at[(docs > least[place]) | me.string_mail.states(c.run, _cuts(rows, sent.value))[0][place]]
            n = len(c.data)
            begin, end = _union(np.concatenate([c.low[gone], at]), np.concatenate([c.high[gone], at]) + c.length)
            # spans that touch across a document's end are two
            inner = np.unique(c.starts[1:-1])
            k = np.searchsorted(begin, inner) - 1
            inner = inner[(k >= 0) & (inner < end[k])] if len(begin) else inner[:0]
            step = np.zeros(n + 1, np.int8)
            step[begin], step[end] = 1, -1
            covered = np.cumsum(step[:n], dtype=np.int8).astype(bool)
            begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
            owner = np.searchsorted(c.starts, begin, "right") - 1
            cuts = np.searchsorted(owner, np.arange(len(c.ids) + 1))
            kept = c.data[~covered].tobytes()
            ends = c.starts - np.concatenate([[0], np.cumsum(end - begin)])[np.searchsorted(end, c.starts, "right")]
            for k, key in enumerate(c.ids.tolist()):
                a, z = int(c.starts[k]), int(c.starts[k + 1])
                spans = [{"start": x - a, "stop": y - a} for x, y in zip(begin[cuts[k] : cuts[k + 1]].tolist(), end[cuts[k] : cuts[k + 1]].tolist(), strict=True)]
                if out.add(None if key == _NO_ID else key, z - a, spans, kept[ends[k] : ends[k + 1]], size=z - a):
                    yield out.take()

        return self._pass(give, f"`{id_col}` long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary", schema, False)

    def _slim(self) -> Dedup:
        """What tasks need of it."""
        out = object.__new__(Dedup)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("spark", "docs")}
        return out


def _place(order: np.ndarray, by_run: np.ndarray, at: int, base: np.ndarray) -> int:
    """Which row of its run the row taken at a place is."""
    r = order[at]
    return int(np.searchsorted(by_run[base[r] : base[r + 1]], at))


def deduplicate(docs: DataFrame, length: int = 50, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, spans, kept) of each row: the maximal removed byte spans (start, stop), and the bytes that remain."""
    ship(docs.sparkSession)
    source = text_of(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    if not docs.inputFiles() or "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        source = cut(source, "source")
    d = Dedup(source, length, chunk)
    of_contexts, of_strings = d.anchors()
    d.contexts(of_contexts)
    d.strings(of_contexts, of_strings)
    return d.result(of_strings, id_col)
