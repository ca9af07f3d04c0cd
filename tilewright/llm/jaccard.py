"""Operator 8: similarity join of documents by the Jaccard coefficient of their word n-grams.

Documents of equal n-gram sets are one class, named by the 128-bit hash of the set, and classes are what is joined; copies never
make pairs.

1. Each document's distinct n-grams are 64-bit hashes. N-grams that recur within a task are counted, the counts are added
   up, and the ``FREQUENT`` most frequent n-grams are broadcast. The rare-first order has the others first, by
   hash, and these last, by count. It is one number for each n-gram, of which 48 bits are sent; where n-grams share a number, sets
   count as multisets of numbers, which have no fewer in common, so the filters lose nothing.
2. A class sends the first n - ceil(t n) + 1 n-grams of its order (with its size and their positions) to the tasks of
   those n-grams. Two classes that reach t share one of them. Pairs there pass the length and the positional filter.
   A group of up to ``SMALL`` classes gives all of its pairs; a larger one gives pairs with one of its classes
   only, and is kept.
3. Pairs are made distinct, each with its first common n-gram, and pass the suffix filter: n-grams before that one are in one
   set alone, and those behind it are parted into ranges of the order, about two n-grams to a range; differences between
   the ranges' exact counts bound the symmetric difference from below. Each pair that is left is verified once on the
   whole sets.
4. Links give components. Of the groups kept in step 2, only pairs between classes that are still in different
   components can add anything. Members in a group's largest component don't meet each other; the rest is parted into
   blocks by the group's real size, whose tasks filter and verify their pairs, each at its first common n-gram, and give the links that
   join components, never more than a block has members. So every pair of a group is either verified or already
   connected: :func:`join` finds all components, not all links. :func:`pairs` verifies all pairs of the kept groups,
   and gives every link.

N-grams of a known count are salted by class before they are sent, as many salts as keep a group to some ``SALT`` classes; the groups
of all their salts are kept. What is counted is what recurs ``REPORT`` times in 6 million n-grams of a task, so a
group that is not salted has at most a few rows for each of so many n-grams of the corpus. Tasks of step 2 are as many as keep
each to some ``ENTRIES`` entries.

Edge cases: null and empty texts have no n-grams, class or link; texts of fewer words than an n-gram are one n-gram of all
their words; repeated rows are one class; rows with a null id take part, as copies of no id; an empty table gives an empty
result; extra columns are not read; very long texts are one row each, and batches of texts are bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Out, text_of
from tilewright.llm.components import components
from tilewright.runtime import cut, partitions, release, ship

FREQUENT = 200_000
#: How often a task must meet an n-gram to report it.
REPORT = 3
SMALL, SALT = 8, 256
#: Entries of prefixes to a task.
ENTRIES = 2_000_000
#: Most candidates whose ids are broadcast to the scan that fetches their texts; beyond it the scan is joined by a shuffle.
BROADCAST_IDS = 1 << 18
#: Bytes of sets that a task of the verification keeps for the pairs that follow.
KEPT_SETS = 64 << 20

_A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
_hash = xxhash.xxh3_64_intdigest
_NO_ID = -(1 << 63)


def ascii_lower_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """The sorted distinct hashes of runs of n words; of all words where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash, words), np.uint64, len(words))
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    for i in range(m):
        h = h * _A + w[i : len(w) - m + 1 + i]
    h = (h ^ (h >> _S)) * _M
    h ^= h >> _S
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def class_of(h: np.ndarray) -> bytes:
    """The name of a set: 16 bytes."""
    return xxhash.xxh3_128_digest(h.tobytes())


class Rule:
    """The threshold p/100, by whole numbers."""

    def __init__(self, percent: int):
        self.p = percent

    def prefix(self, n: int) -> int:
        return n + (-self.p * n) // 100 + 1

    def passes(self, na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
        """The length filter, and the positional filter for a pair's first common n-gram."""
        need = -((-self.p * (na + nb)) // (100 + self.p))
        return (100 * np.minimum(na, nb) >= self.p * np.maximum(na, nb)) & (np.minimum(na - pa_, nb - pb) >= need)

    def allowed(self, na, nb):
        """The largest symmetric difference of a link."""
        return na + nb + 2 * ((-self.p * (na + nb)) // (100 + self.p))

    def linked(self, common, na, nb):
        return 100 * common >= self.p * (na + nb - common)


class Order:
    """Rare-first order: n-grams that are not among the frequent ones by hash, then the frequent ones by count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        rank = np.empty(len(hashes), np.uint64)
        rank[np.lexsort((hashes, counts))] = np.arange(len(hashes), dtype=np.uint64)
        by = np.argsort(hashes)
        self.hashes, self.counts, self.ranks = hashes[by], counts[by].astype(np.int64), rank[by]
        self.shift = np.uint64(63 - max(1, len(hashes)).bit_length())
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hashes >> np.uint64(42)] = True

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted 48-bit numbers of a set, and the counts of its n-grams in that order (0: not a frequent one)."""
        o, c = h >> np.uint64(1), np.zeros(len(h), np.int64)
        some = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            same = self.hashes[at] == h[some]
            some, at = some[same], at[same]
            o[some] = np.uint64(1 << 63) | (self.ranks[at] << self.shift)
            c[some] = self.counts[at]
        o >>= np.uint64(16)
        if len(some):
            by = np.argsort(o, kind="stable")
            o, c = o[by], c[by]
        return o, c


def ranges(o: np.ndarray) -> np.ndarray:
    """How many of a set's numbers are in each of its ranges: a power of two of them, half the set's size or more."""
    bits = min(max(len(o).bit_length() - 1, 3), 14)
    return np.bincount(o >> np.uint64(48 - bits), minlength=1 << bits).astype("<u2")


def packed_ranges(o: np.ndarray) -> bytes:
    """:func:`ranges`, compressed: most are numbers below 8."""
    return zstandard.ZstdCompressor(1).compress(ranges(o).tobytes())


def unpacked_ranges(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u2")


def least_differences(one: np.ndarray, others: np.ndarray, key: int, place: int, places: np.ndarray) -> np.ndarray:
    """Lower bounds on the symmetric differences of a set and others, by their ranges, of which there are as many, and the number and
    places of their first common n-gram."""
    r = (key >> (49 - len(one).bit_length())) + 1
    d = others.astype(np.int32) - one.astype(np.int32)
    # of the range of the first common one only what stands behind it, which is known by its places
    return place + places + np.abs(d[:, :r].sum(1) - places + place) + np.abs(d[:, r:]).sum(1)


def _folded(x: np.ndarray, n: int) -> np.ndarray:
    """Ranges as n ranges, for rows of a power of two times as many."""
    return x if x.shape[-1] == n else x.reshape(*x.shape[:-1], n, -1).sum(-1)


def _bucket(key: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    return (((key ^ (salt * _M)) * _A) >> np.uint64(33)) % np.uint64(n)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, text, t), t being a hash of the text."""
    return text_of(docs, "id", "text").withColumn("t", F.xxhash64("text"))


def _scan(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """One pass: a row (kind 0) for each document with its class, and what tasks report (kind 1)."""
    schema = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("id", pa.int64()), ("t", pa.int64()), ("c", pa.binary()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, counts = Out(schema), [], 0, []
        seen: set[bytes] = set()

        def squeeze() -> None:
            nonlocal size
            h = np.concatenate(held)
            h.sort()
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            k = np.diff(edge)
            counts.append((h[edge[:-1][k >= REPORT]], k[k >= REPORT]))
            held.clear()
            size = 0

        for b in batches:
            for key, text, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = shingles(ascii_lower_words(text.as_py()), n)
                c = class_of(h) if len(h) else None
                if len(h) and c not in seen:
                    seen.add(c)
                    held.append(h)
                    size += len(h)
                    if size > 6_000_000:
                        squeeze()
                if out.add(0, None, key, t, c, len(h), None, size=100):
                    yield out.take()
        if held:
            squeeze()
        if counts:
            h, k = (np.concatenate(x) for x in zip(*counts, strict=True))
            part = _bucket(h, np.zeros(len(h), np.uint64), parts)
            for i in range(parts):
                if (mine := part == i).any():
                    out.add(1, i, None, None, None, None, h[mine].astype("<u8").tobytes() + k[mine].astype("<u8").tobytes(), size=16 * int(mine.sum()))
        yield out.take()

    return _texts(docs).mapInArrow(run, "kind byte, bucket int, id long, t long, c binary, n long, data binary")


def _frequent(scan: DataFrame, parts: int) -> Order:
    """The most frequent n-grams of those reported, at most ``FREQUENT``."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.frombuffer(x.as_py(), "<u8").reshape(2, -1) for b in batches for x in b.column(1)]
        if got:
            h, k = np.concatenate(got, axis=1)
            h, back = np.unique(h, return_inverse=True)
            k = np.bincount(back, k, len(h)).astype(np.int64)
            top = np.lexsort((h, -k))[:FREQUENT]
            yield pa.RecordBatch.from_pydict({"h": h[top].view("<i8"), "k": k[top]})

    rows = scan.where("kind = 1").select("bucket", "data").repartitionById(parts, F.col("bucket")).mapInArrow(add_up, "h long, k long")
    got = rows.orderBy(F.desc("k"), "h").limit(FREQUENT).toArrow()
    return Order(got.column("h").to_numpy().view(np.uint64), got.column("k").to_numpy())


def _salts(counts: np.ndarray) -> np.ndarray:
    return (-(-np.maximum(counts, 1) // SALT)).astype(np.uint64)


_PAIRS = "kind byte, a binary, b binary, key long, n long, pos long, pos_b long"
_PAIR_SCHEMA = pa.schema([("kind", pa.int8()), ("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("pos_b", pa.int64())])


def _names(classes: np.ndarray) -> pa.Array:
    """Rows of two unsigned 64-bit numbers as 16 bytes each."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(classes), [None, pa.py_buffer(np.ascontiguousarray(classes).astype(">u8").tobytes())]).cast(pa.binary())


def _candidates(docs: DataFrame, order, rule: Rule, n: int, buckets: int) -> DataFrame:
    """Pairs (kind 0: a, b, key, pos, pos_b) of the prefix join, and the members of its large groups (kind 1: a, key, n, pos)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = order.value, set()
        keys, counts, which, at, classes, sizes = [], [], [], [], [], []
        held = 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal held
            c, size = np.frombuffer(b"".join(classes), ">u8").astype(np.uint64).reshape(-1, 2), np.array(sizes, np.int64)
            h, k, w, p = np.concatenate(keys), np.concatenate(counts), np.repeat(np.arange(len(c)), which), np.concatenate(at)
            salts = _salts(k)
            salt = c[w, 0] % salts
            part = _bucket(h, salt, buckets).astype(np.int64)
            o = np.lexsort((h, part))
            cuts = np.searchsorted(part[o], np.arange(buckets + 1))
            ids, blobs = [], []
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                mine = o[cuts[i] : cuts[i + 1]]
                own, idx = np.unique(w[mine], return_inverse=True)
                ids.append(i)
                blobs.append(_packed(h[mine], salt[mine], salts[mine], idx, p[mine], c[own], size[own]))
            for x in (keys, counts, which, at, classes, sizes):
                x.clear()
            held = 0
            for i in range(0, len(ids), 64):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(ids[i : i + 64], pa.int32()), "data": pa.array(blobs[i : i + 64], pa.binary())})

        for b in batches:
            for text in b.column(1):
                h = shingles(ascii_lower_words(text.as_py()), n)
                if not len(h) or (c := class_of(h)) in seen:
                    continue
                seen.add(c)
                (first, k), length = ranks.of(h), rule.prefix(len(h))
                keys.append(first[:length])
                counts.append(k[:length])
                which.append(length)
                at.append(np.arange(length))
                classes.append(c)
                sizes.append(len(h))
                held += length
                if held > 3_000_000:
                    yield from give()
        if held:
            yield from give()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, salt, salts, cls, size, pos, names = _gathered(x.as_py() for b in batches for x in b.column(1))
        if not len(key):
            return
        # a group begins with the class of the fewest n-grams rarer than its own, which most of the others are likest to
        o = np.lexsort((cls, size, pos, salt, key))
        key, salt, salts, cls, size, pos = (x[o] for x in (key, salt, salts, cls, size, pos))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        keep = np.concatenate([[True], new[1:] | (cls[1:] != cls[:-1])])
        # a group of one class has nothing to give, unless it has other salts
        group = np.cumsum(new[keep]) - 1
        key, salt, salts, cls, size, pos = (x[keep] for x in (key, salt, salts, cls, size, pos))
        m = np.bincount(group)[group]
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])[group]
        some = (m > 1) | (salts > 1)
        key, salts, cls, size, pos, group, m, first = (x[some] for x in (key, salts, cls, size, pos, group, m, first))
        first = (np.cumsum(some) - 1)[first]
        row = np.arange(len(key))
        lefts, rights = [], []
        for d in range(1, SMALL):
            i = row[:-d] if d < len(row) else row[:0]
            i = i[(group[i] == group[i + d]) & ((m[i] <= SMALL) | (d == 1))]
            lefts.append(i)
            rights.append(i + d)
        star = row[(m > SMALL) & (row > first)]
        i, j = np.concatenate([*lefts, first[star]]), np.concatenate([*rights, star])
        good = rule.passes(size[i], pos[i], size[j], pos[j]) & (cls[i] != cls[j])
        i, j = i[good], j[good]
        # of the places where two classes meet here, the first one
        i, j = np.where(cls[i] < cls[j], i, j), np.where(cls[i] < cls[j], j, i)
        o = np.lexsort((pos[j], pos[i], cls[j], cls[i]))
        i, j = i[o], j[o]
        i, j = (x[np.concatenate([[True], (cls[i][1:] != cls[i][:-1]) | (cls[j][1:] != cls[j][:-1])])] if len(i) else x for x in (i, j))
        for s in range(0, len(i), 50_000):
            g, k = i[s : s + 50_000], j[s : s + 50_000]
            yield _pair_batch(0, len(g), a=_names(names[cls[g]]), b=_names(names[cls[k]]), key=key[g], pos=pos[g], pos_b=pos[k])
        big = np.flatnonzero((m > SMALL) | (salts > 1))
        for s in range(0, len(big), 50_000):
            g = big[s : s + 50_000]
            yield _pair_batch(1, len(g), a=_names(names[cls[g]]), key=key[g], n=size[g], pos=pos[g])

    sent = text_of(docs, "id", "text").mapInArrow(send, "bucket int, data binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, _PAIRS)


def _pair_batch(kind: int, rows: int, **cols) -> pa.RecordBatch:
    out = []
    for f in _PAIR_SCHEMA:
        x = cols.get(f.name)
        out.append(pa.array(np.full(rows, kind, np.int8)) if f.name == "kind" else pa.nulls(rows, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x).astype(np.int64)))
    return pa.RecordBatch.from_arrays(out, schema=_PAIR_SCHEMA)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4")


def _packed(key, salt, salts, idx, pos, classes, sizes) -> bytes:
    """Entries of a bucket, its keys in 48 bits each."""
    arrays = [np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]), _narrow(idx), _narrow(pos), classes.astype("<u8"), _narrow(sizes)]
    salted = np.flatnonzero(salts > 1)
    arrays += [salted.astype("<u4"), salt[salted].astype("<u4"), salts[salted].astype("<u4")]
    head = np.array([x for a in arrays for x in (len(a), a.itemsize)], "<u4").tobytes()
    return head + b"".join(a.tobytes() for a in arrays)


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    head, at, got = np.frombuffer(raw, "<u4", 16).reshape(8, 2), 64, []
    for i, (n, width) in enumerate(head.tolist()):
        width = {0: 6, 3: 16}.get(i, width)
        got.append(np.frombuffer(raw, np.uint8, n * width, at))
        at += n * width
    keys = np.zeros((head[0, 0], 8), np.uint8)
    keys[:, :6] = got[0].reshape(-1, 6)
    idx, pos, classes, sizes, salted, salt_of, salts_of = (got[i].view({2: "<u2", 4: "<u4", 8: "<u8"}[int(head[i, 1])]) for i in range(1, 8))
    salt, salts = np.zeros(len(keys), np.uint64), np.ones(len(keys), np.uint64)
    salt[salted], salts[salted] = salt_of, salts_of
    return keys.view("<u8").ravel(), salt, salts, idx, sizes[idx].astype(np.int64), pos.astype(np.int64), classes.reshape(-1, 2)


def _gathered(blobs: Iterator[bytes]) -> tuple[np.ndarray, ...]:
    """The entries of a task's blobs, classes by their numbers in the sorted list of names that comes last."""
    got, at = [], 0
    for raw in blobs:
        *cols, names = _unpacked(raw)
        cols[3] = cols[3].astype(np.int64) + at
        at += len(names)
        got.append((*cols, names))
    if not got:
        return (*(np.empty(0, np.int64) for _ in range(6)), np.empty((0, 2), np.uint64))
    key, salt, salts, idx, size, pos, names = (np.concatenate(x) for x in zip(*got, strict=True))
    o = np.lexsort((names[:, 1], names[:, 0]))
    fresh = np.concatenate([[True], (names[o][1:] != names[o][:-1]).any(1)])
    number = np.empty(len(names), np.int64)
    number[o] = np.cumsum(fresh) - 1
    return key, salt, salts, number[idx], size, pos, names[o][fresh]


class Sets:
    """Sets of n-grams of texts, some ``KEPT_SETS`` bytes of which are kept."""

    def __init__(self, n: int):
        self.n, self.held, self.kept = n, 0, {}

    def of(self, name: bytes, text: pa.StringScalar) -> np.ndarray:
        h = self.kept.get(name)
        if h is None:
            h = shingles(ascii_lower_words(text.as_py()), self.n)
            if self.held + h.nbytes > KEPT_SETS:
                self.kept.clear()
                self.held = 0
            self.kept[name] = h
            self.held += h.nbytes
        return h

    @staticmethod
    def linked(rule: Rule, p: np.ndarray, q: np.ndarray) -> bool:
        both = np.concatenate([p, q])
        both.sort(kind="stable")
        return rule.linked(int((both[1:] == both[:-1]).sum()), len(p), len(q))


def _fetched(docs: DataFrame, names: DataFrame, classes: DataFrame, order, n: int, keep_texts: bool) -> DataFrame:
    """(c, n, ranges, text) of some classes (c), each once; by a scan of the documents, as most have no part in any pair.

    A class is found by the id and the hash of one of its texts, so texts aren't shuffled while these can be broadcast; rows that repeat
    both give a class once for each task.
    """
    wanted = cut(names.distinct().join(classes, "c").select("c", "id", "t"), "wanted")
    of_id = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    schema = pa.schema([("c", pa.binary()), ("n", pa.int64()), ("ranges", pa.binary()), ("text", pa.string())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ranks, seen = Out(schema), order.value, set()
        for x in batches:
            for text, c in zip(x.column(0), x.column(1).to_pylist(), strict=True):
                if c in seen:
                    continue
                t = text.as_py()
                h = shingles(ascii_lower_words(t), n)
                if len(h) and class_of(h) == c:
                    seen.add(c)
                    r = packed_ranges(ranks.of(h)[0])
                    if out.add(c, len(h), r, t if keep_texts else None, size=len(t) + len(r)):
                        yield out.take()
        yield out.take()

    rows = _texts(docs).withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    found = cut(rows.join(of_id, ["id", "t"]).select("text", "c").mapInArrow(texts, "c binary, n long, ranges binary, text string"), "texts")
    if found.groupBy("c").count().where("count > 1").limit(1).count():  # rows that repeat an id and its text
        once = cut(found.dropDuplicates(["c"]), "texts")
        release(found)
        found = once
    release(wanted)
    return found


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, order, rule: Rule, n: int) -> DataFrame:
    """The linked ones (a, b) of pairs (a, b, key, pos, pos_b)."""
    first = F.min(F.struct("pos", "pos_b", "key")).alias("at")
    pairs = cut(pairs.groupBy("a", "b").agg(first).select("a", "b", "at.*"), "pairs")
    found = _fetched(docs, pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))), classes, order, n, True)

    def suffix_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            key, p, q, na, nb = (x.column(x.schema.get_field_index(c)).to_numpy().tolist() for c in ("key", "pos", "pos_b", "na", "nb"))
            ra, rb = (x.column(x.schema.get_field_index(c)) for c in ("ra", "rb"))
            good = []
            for i in range(x.num_rows):
                one, other = (unpacked_ranges(y[i].as_py()) for y in (ra, rb))
                m = min(len(one), len(other))
                good.append(least_differences(_folded(one, m), _folded(other, m)[None], key[i], p[i], np.array([q[i]]))[0] <= rule.allowed(na[i], nb[i]))
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    a, b = (found.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("ranges").alias(f"r{x}")) for x in "ab")
    left = cut(pairs.join(b, "b").join(a, "a").select("a", "b", "key", "pos", "pos_b", "na", "nb", "ra", "rb").mapInArrow(suffix_filter, "a binary, b binary"), "pairs")

    # texts travel to the comparisons, as they are shorter than their sets of hashes
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for x in batches:
            ca, cb, ta, tb = (x.column(x.schema.get_field_index(c)) for c in ("a", "b", "ta", "tb"))
            good = [sets.linked(rule, sets.of(ca[i].as_py(), ta[i]), sets.of(cb[i].as_py(), tb[i])) for i in range(x.num_rows)]
            yield x.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # only the texts of what passed are shuffled
    needed = cut(left.select(F.col("a").alias("c")).union(left.select(F.col("b").alias("c"))).distinct(), "needed")
    texts = found.join(F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed, "c", "left_semi")
    ta, tb = (texts.select(F.col("c").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    links = cut(left.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary"), "links")
    release(pairs, found, left, needed)
    return links


class Bags:
    """Some sets of numbers, for counts of what one has in common with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, sets)])
        distinct, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mask = np.zeros(len(distinct), bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.ends[i] : self.ends[i + 1]]
        self.mask[own] = True
        start, size = self.ends[others], self.ends[others + 1] - self.ends[others]
        stop = np.cumsum(size)
        at = np.repeat(start - stop + size, size) + np.arange(size.sum())
        upto = np.concatenate([[0], np.cumsum(self.mask[self.ids[at]])])
        self.mask[own] = False
        return upto[stop] - upto[stop - size]


_MEMBER = "key long, s int, t int, side int, a binary, comp binary, n long, pos long, ranges binary"


class Block:
    """The members of a group that meet: those of one salt with those of another, or with each other."""

    def __init__(self, batches: Iterator[pa.RecordBatch], rule: Rule):
        self.rows, self.rule = pa.Table.from_batches(list(batches)), rule
        self.side, self.size, self.pos = (self.rows.column(c).to_numpy() for c in ("side", "n", "pos"))
        self.key = self.rows.column("key")[0].as_py()
        self.comp = self.rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        self.ranges = [unpacked_ranges(x) for x in self.rows.column("ranges").to_pylist()]
        self.width = np.array([len(x) for x in self.ranges])
        self.tables: dict[int, np.ndarray] = {}

    def table(self, w: int) -> np.ndarray:
        """The ranges of the members that have w or more, as w ranges."""
        if w not in self.tables:
            self.tables[w] = np.zeros((len(self.ranges), w), np.uint16)
            for k, x in enumerate(self.ranges):
                if w <= len(x):
                    self.tables[w][k] = _folded(x, w)
        return self.tables[w]

    def pairs(self, apart: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """For each member the members that it may be linked with by all filters, of those that are ``apart`` from it."""
        lo, hi = (np.flatnonzero(self.side & k) for k in (1, 2))
        o = hi[np.argsort(self.size[hi], kind="stable")]
        ordered = self.size[o]
        for i in lo.tolist():
            n = self.size[i]
            j = o[np.searchsorted(ordered, -((-self.rule.p * n) // 100)) : np.searchsorted(ordered, 100 * n // self.rule.p, "right")]
            j = j[apart(i, j) & ((self.side[i] != 3) | (j > i))]
            j = j[self.rule.passes(self.size[j], self.pos[j], n, self.pos[i])]
            shared = np.minimum(self.width[j], self.width[i])
            found = []
            for w in np.unique(shared).tolist():
                t, k = self.table(w), j[shared == w]
                found.append(k[least_differences(t[i], t[k], self.key, int(self.pos[i]), self.pos[k]) <= self.rule.allowed(int(n), self.size[k])])
            if found:
                yield i, np.concatenate(found)

    def candidates(self) -> pa.Table:
        """The members that are in a pair."""
        some = np.zeros(len(self.side), bool)
        for i, j in self.pairs(lambda i, j: self.comp[j] != self.comp[i]):
            some[j] = True
            some[i] |= len(j) > 0
        return self.rows.filter(pa.array(some))

    def links(self, order: Order, n: int, every: bool) -> pa.Table:
        """The links at whose first common n-gram the members meet here; unless ``every``, only those that join components."""
        names = self.rows.column("a").to_pylist()
        sets = [shingles(ascii_lower_words(t.as_py()), n) for t in self.rows.column("text")]
        whole, before = Bags(sets), Bags([order.of(h)[0][:k] for h, k in zip(sets, self.pos.tolist(), strict=True)])
        label, out = np.arange(int(self.comp.max()) + 1), []
        for i, j in self.pairs(lambda i, j: label[self.comp[j]] != label[self.comp[i]]):
            j = j[before.common(i, j) == 0]
            j = j[self.rule.linked(whole.common(i, j), int(self.size[i]), self.size[j])]
            for k in j.tolist():
                x, y = label[self.comp[i]], label[self.comp[k]]
                if every or x != y:
                    out.append((min(names[i], names[k]), max(names[i], names[k])))
                if not every:
                    label[label == y] = x
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _remaining(docs: DataFrame, members: DataFrame, comps: DataFrame | None, classes: DataFrame, order, rule: Rule, n: int) -> DataFrame:
    """The links (a, b) of kept groups between classes in different components, as far as they join these; without ``comps`` all links.

    The members of a group's largest component take the first salts, the others those that follow; two members meet in the block of
    their salts unless both are of the first. A block gives its members that are in a pair by the filters, and these
    meet once more, with their texts, where their pairs are verified. So rows grow as the groups do, not as their pairs.
    """
    if comps is None:
        known = cut(members.withColumn("comp", F.col("a")), "members")
    else:
        known = cut(members.join(comps.select(F.col("node").alias("a"), F.col("label").alias("comp")), "a", "left").withColumn("comp", F.coalesce("comp", "a")), "members")
    sizes = known.groupBy("key", "comp").count()
    keys = sizes.groupBy("key").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all")).where("top.count < all")
    salts = lambda k: F.ceil(k / SALT).cast("int")
    keys = cut(keys.select("key", F.col("top.comp").alias("main"), salts(F.col("top.count")).alias("d"), salts(F.col("all") - F.col("top.count")).alias("m")), "keys")
    rows = cut(known.join(keys, "key"), "members")
    sets = _fetched(docs, rows.select(F.col("a").alias("c")), classes, order, n, False)
    release(known, keys)
    rows = rows.join(sets.select(F.col("c").alias("a"), "ranges"), "a").withColumn("h", F.xxhash64("a"))
    main = F.col("comp") == F.col("main")
    rows = rows.withColumn("salt", F.when(main, F.pmod("h", "d")).otherwise(F.col("d") + F.pmod("h", "m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(main, F.col("d")).otherwise(F.lit(0)), F.col("d") + F.col("m") - 1)))
    side = F.when(F.col("salt") == F.col("other"), 3).when(F.col("salt") < F.col("other"), 1).otherwise(2)
    met = rows.select("key", F.least("salt", "other").alias("s"), F.greatest("salt", "other").alias("t"), side.alias("side"), "a", "comp", "n", "pos", "ranges")

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Block(batches, rule).candidates().to_batches()

    found = cut(met.groupBy("key", "s", "t").applyInArrow(some, _MEMBER), "block-members")
    texts = _fetched(docs, found.select(F.col("a").alias("c")), classes, order, n, True).select(F.col("c").alias("a"), "text")

    every = comps is None

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Block(batches, rule).links(order.value, n, every).to_batches()

    return found.join(texts, "a").groupBy("key", "s", "t").applyInArrow(verified, "a binary, b binary")


def _classes(clean: DataFrame, rule: Rule, n: int) -> tuple:
    """The documents' rows, the classes, the order, the pairs of classes that met, and the members of the groups that were kept."""
    spark = clean.sparkSession
    scan = cut(_scan(clean, n, partitions(spark)), "scan")
    rows = scan.where("kind = 0").select("id", "c", "n")
    named = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "t"))).alias("named")
    found = scan.where("kind = 0 and n > 0").groupBy("c").agg(named, F.min("t").alias("t"), F.first("n").alias("n"))
    classes = cut(found.select("c", "n", F.col("named.id").alias("least"), F.coalesce("named.id", F.lit(_NO_ID)).alias("id"), F.coalesce("named.t", "t").alias("t")), "classes")
    order = spark.sparkContext.broadcast(_frequent(scan, partitions(spark)))
    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * rule.p / 100) + 1)).first()[0] or 0
    met = cut(_candidates(clean, order, rule, n, max(partitions(spark), -(-int(entries) // ENTRIES))), "candidates")
    return rows, classes, order, met.where("kind = 0").select("a", "b", "key", "pos", "pos_b"), met.where("kind = 1").select("a", "key", "n", "pos")


def pairs(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: ``class_id`` of :func:`join` for every two classes that are linked, each pair once.

    All pairs of the kept groups are made and verified here, so the work grows with the pairs that there are.
    """
    ship(docs.sparkSession)
    rule, clean = Rule(percent), text_of(docs, id_col, text_col)
    _, classes, order, met, members = _classes(clean, rule, n)
    links = _verify(clean, met, classes, order, rule, n)
    links = links.unionByName(_remaining(clean, members, None, classes, order, rule, n)).distinct()
    return links.select(F.hex("a").alias("a"), F.hex("b").alias("b"))


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, class_id, component_id) of each row.

    Rows of equal class_id (hexadecimal; null without n-grams) have equal n-gram sets; component_id is the smallest id reachable by links, a row's
    own included.
    """
    ship(docs.sparkSession)
    rule, clean = Rule(percent), text_of(docs, id_col, text_col)
    rows, classes, order, met, members = _classes(clean, rule, n)
    links = _verify(clean, met, classes, order, rule, n)
    comps = components(links)
    if members.limit(1).count():
        comps = cut(comps, "components")
        more = cut(_remaining(clean, members, comps, classes, order, rule, n), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            comps = components(links)
    named = classes.join(comps, classes["c"] == comps["node"], "left").select("c", "least", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = cut(named.join(least, "label").select("c", "component_id"), "classes")
    out = rows.join(of_class, "c", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.hex("c").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
