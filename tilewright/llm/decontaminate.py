"""Operator 10: benchmark decontamination by a broadcast hash set of normalised windows.

Words are the runs of ASCII letters and digits and of bytes above 0x7F, letters A-Z in lower case. An item's windows
are its runs of 13 consecutive words; an item of fewer words, but not none, is one window. The windows of the benchmark
are broadcast as sorted 64-bit hashes beside the normalised text itself (flat arrays, some 30 bytes a word); documents are scanned
once by a narrow map, window hashes are looked up by binary search, and every hit is verified against the text.

A benchmark of more than ``BROADCAST_BYTES`` of text (at most 500 MB of arrays, if all words had one letter) isn't broadcast. Documents
are then scanned once with a bitmap of ``BITMAP`` bits, whatever the benchmark's size, that says which windows it can't have; the
windows that are left are joined with the benchmark's by length and hash, written first and verified by their words there.

Edge cases: null texts have no words; items without words have no windows; items that repeat a text count each under
their own id; repeated document rows are judged each; items with a null id take no part; empty tables give no hits;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Out, text_of
from tilewright.runtime import cut, ship

WINDOW = 13
BROADCAST_BYTES = 32 << 20
#: Bits of the map of a larger benchmark's windows, a power of two, and the parts in which it is made.
BITMAP, BITMAP_PARTS = 1 << 29, 64

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def _rolled(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words, given by their hashes."""
    n = len(words) - length + 1
    x = (words + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[i : i + n]
    return h ^ h >> np.uint64(32)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class _Windows:
    """The distinct windows of one length: sorted hashes, a place of each in the text, and the items of each."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray, items: np.ndarray, text):
        o = np.lexsort((items, hashes))
        hashes, places, items = hashes[o], places[o], items[o]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        # equal hashes of different words, if ever, stand apart
        again = np.flatnonzero(~new)
        if any(text(places[i]) != text(places[i - 1]) for i in again.tolist()):
            words = [text(p) for p in places.tolist()]
            o = np.array(sorted(range(len(words)), key=lambda i: (hashes[i], words[i], items[i])))
            hashes, places, items = hashes[o], places[o], items[o]
            new = np.array([i == 0 or hashes[i] != hashes[i - 1] or words[o[i]] != words[o[i - 1]] for i in range(len(o))])
        self.hashes, self.places = hashes[new], places[new].astype(np.int32)
        own = np.concatenate([[True], items[1:] != items[:-1]]) | new  # an item counts once for a window
        self.items = items[own].astype(np.int32)
        self.of = np.concatenate([np.searchsorted(np.flatnonzero(own), np.flatnonzero(new)), [len(self.items)]]).astype(np.int32)
        bits = min(22, max(8, int(len(hashes) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.hashes >> self.shift] = True

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes are there, and where first."""
        some = np.flatnonzero(self.maybe[h >> self.shift])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        same = self.hashes[at] == h[some]
        return some[same], at[same]


class WindowSet:
    """The windows of some items, as flat arrays over their normalised text."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        texts = [words_of(t) for _, t in items]
        owned = [k for k, w in enumerate(texts) if w]
        self.keys = np.array([items[k][0] for k in owned], np.int64)
        flat = [w for k in owned for w in texts[k]]
        self.text = b" ".join(flat)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1)]).astype(np.uint32)
        hashes, sizes = _word_hashes(flat), np.array([len(texts[k]) for k in owned], np.int64)
        first = np.cumsum(sizes) - sizes
        self.windows: dict[int, _Windows] = {}
        for n in sorted({min(window, z) for z in sizes.tolist()}):
            which = np.flatnonzero((sizes >= window) if n == window else (sizes == n))
            counts = sizes[which] - n + 1
            places = np.repeat(first[which] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            self.windows[n] = _Windows(_rolled(hashes, n)[places], places, np.repeat(which, counts), lambda p, n=n: self._words(p, n))

    def _words(self, place: int, n: int) -> bytes:
        return self.text[int(self.at[place]) : int(self.at[place + n]) - 1]

    def nbytes(self) -> int:
        return len(self.text) + self.at.nbytes + self.keys.nbytes + sum(x.nbytes for w in self.windows.values() for x in (w.hashes, w.places, w.items, w.of, w.maybe))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurring window, and the items with such windows."""
        hit, found = np.zeros(len(words), bool), set()
        hashes = _word_hashes(words) if self.windows else None
        for n, w in self.windows.items():
            if len(words) < n:
                continue
            met = set()
            for i, k in zip(*(x.tolist() for x in w.candidates(_rolled(hashes, n))), strict=True):
                own, h = b" ".join(words[i : i + n]), w.hashes[k]
                while k < len(w.hashes) and w.hashes[k] == h:
                    if self._words(w.places[k], n) == own:
                        hit[i : i + n] = True
                        met.add(k)
                    k += 1
            for k in met:
                found.update(self.keys[w.items[w.of[k] : w.of[k + 1]]].tolist())
        return hit, found


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_RUNS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; what stands before, between and after them stays, a run of hit words leaves a blank."""
    raw, out, at, gone = text.encode(), [], 0, False
    for m, h in zip(_RUNS.finditer(raw), hit.tolist(), strict=True):
        if h:
            if not gone:
                out.append(raw[at : m.start()])
            at, gone = m.end(), True
        elif gone:
            out.append(b" ")
            at, gone = m.start(), False
    out.append(raw[at:])
    return b"".join(out).decode()


def _small(benchmark: DataFrame, item_col: str, item_text: str, most: int, window: int) -> tuple[DataFrame, WindowSet | None]:
    """The items, and their windows if these may be broadcast."""
    items = text_of(benchmark, item_col, item_text).where("id is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most:
        return items, None
    return items, WindowSet(sorted((r["id"], r["text"]) for r in items.collect()), window)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with all their columns; words in occurring windows are cut from their texts.

    A narrow pass; with a benchmark that isn't broadcast, spans are found first and joined to their rows.
    """
    spark = ship(docs.sparkSession)
    _, windows = _small(benchmark, item_col, item_text, broadcast_bytes, window)
    at, docs_columns = docs.columns.index(text_col), docs.columns
    if windows is None:
        row = f"_{'_'.join(docs.columns)}_"  # clashes with no column
        named = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
        found = find(named, benchmark, window, broadcast_bytes, row, text_col, item_col, item_text).where(F.size("spans") > 0)
        source = named.join(found.select(row, F.col("spans").alias(f"{row}spans")), row, "left").drop(row)
        sent = None
    else:
        source, sent = docs, spark.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, stay = [], []
            spans = b.column(b.num_columns - 1).to_pylist() if sent is None else None
            for k, text in enumerate(b.column(at)):
                t = text.as_py()
                words = words_of(t or "")
                if spans is None:
                    hit, _ = sent.value.scan(words)
                else:
                    hit = np.zeros(len(words), bool)
                    for s in spans[k] or ():
                        hit[s["start"] : s["stop"]] = True
                n = int(hit.sum())
                stay.append(not n or 20 * n < len(words))
                texts.append(without(t, hit) if n and stay[-1] else t)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns).filter(pa.array(stay, pa.bool_()))

    return source.mapInArrow(run, docs.schema)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, n_words, spans, items): the word spans (start, stop) that benchmark windows cover, and the items' ids."""
    spark = ship(docs.sparkSession)
    items, windows = _small(benchmark, item_col, item_text, broadcast_bytes, window)
    source = text_of(docs, id_col, text_col)
    if windows is None:
        return _joined(source, items, window, id_col)
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.int64()))])
    sent = spark.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                hit, found = sent.value.scan(words)
                if out.add(key, len(words), [{"start": a, "stop": z} for a, z in _spans(hit)], sorted(found)):
                    yield out.take()
        yield out.take()

    return source.mapInArrow(run, f"`{id_col}` long, n_words long, spans array<struct<start: long, stop: long>>, items array<long>")


_WINDOW = pa.schema([("row", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])
_WINDOW_DDL = "row long, place long, n int, h long, words binary"


def _bitmap(windows: DataFrame) -> list[bytes]:
    """The map of the hashes of windows, in parts of a fixed size: two bits for each hash."""
    part = BITMAP // BITMAP_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for b in batches:
            bits = b.column(0).to_numpy()
            for k in np.unique(bits // part).tolist():
                maps.setdefault(k, np.zeros(part, bool))[bits[bits // part == k] % part] = True
        for k, x in maps.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(x).tobytes()])})

    probes = F.array(F.col("h").bitwiseAND(BITMAP - 1), F.shiftrightunsigned("h", 32).bitwiseAND(BITMAP - 1))
    bits = windows.select(F.explode(probes).alias("bit")).distinct()
    found = bits.repartition(BITMAP_PARTS, F.floor(F.col("bit") / part)).mapInArrow(run, "part int, bits binary")
    out = [np.zeros(part // 8, np.uint8) for _ in range(BITMAP_PARTS)]
    for r in found.toLocalIterator():
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return [x.tobytes() for x in out]


def _probes(h: np.ndarray) -> np.ndarray:
    return np.concatenate([h & np.uint64(BITMAP - 1), (h >> np.uint64(32)) & np.uint64(BITMAP - 1)]).astype(np.int64)


def _joined(docs: DataFrame, items: DataFrame, window: int, id_col: str) -> DataFrame:
    """As :func:`find`, for a benchmark of any size; the rows need a name of their own for their spans to meet again."""
    spark = docs.sparkSession

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(_WINDOW)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    n = min(window, len(words))
                    for i, h in enumerate(_rolled(_word_hashes(words), n).view(np.int64).tolist()):
                        if out.add(key, i, n, h, b" ".join(words[i : i + n]), size=100):
                            yield out.take()
        yield out.take()

    of_items = cut(items.mapInArrow(cut_up, _WINDOW_DDL).select(F.col("row").alias("item"), "n", "h", "words").distinct(), "windows")
    lengths = sorted(r["n"] for r in of_items.select("n").distinct().collect())  # at most as many as a window has words
    sent = spark.sparkContext.broadcast(np.frombuffer(b"".join(_bitmap(of_items)), np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bits = Out(_WINDOW), sent.value
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                hashes = _word_hashes(words)
                out.add(key, len(words), None, None, None)
                for n in lengths if words else ():
                    if len(words) < n:
                        continue
                    h = _rolled(hashes, n)
                    at = _probes(h)
                    there = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).reshape(2, -1).all(0)
                    for i in np.flatnonzero(there).tolist():
                        if out.add(key, i, n, int(h[i].view(np.int64)), b" ".join(words[i : i + n]), size=100):
                            yield out.take()
                if out.held > out.limit:
                    yield out.take()
        yield out.take()

    named = cut(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    scanned = cut(named.select("row", "text").mapInArrow(run, _WINDOW_DDL), "windows")
    # a window's items are added up first, so a passage of many items and documents is one row on that side
    owners = cut(of_items.groupBy("n", "h", "words").agg(F.array_sort(F.collect_set("item")).alias("items")), "windows")
    hits = scanned.where("n is not null").join(owners, ["n", "h", "words"])
    hits = cut(hits.select("row", F.col("place").alias("start"), (F.col("place") + F.col("n")).alias("stop"), "items"), "hits")
    spans = hits.select("row", "start", "stop").distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    found = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.lit([]).cast("array<struct<start: long, stop: long>>")
    merged = F.aggregate(
        "spans",
        none,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(acc, F.array(x))),
    )
    words = scanned.where("n is null").select("row", F.col("place").alias("n_words"))
    out = named.select("row", F.col("id").alias(id_col)).join(words, "row").join(spans.withColumn("spans", merged), "row", "left").join(found, "row", "left")
    return out.select(id_col, "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.lit([]).cast("array<long>")).alias("items"))


def judge(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (some word is hit, and a twentieth of the words at least) to :func:`find`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
