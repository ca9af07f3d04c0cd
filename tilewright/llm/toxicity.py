"""Operator 6: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams (orders 4 to 6, lower case, white space as single blanks), known
by 64-bit hashes. From a bounded sample of labelled texts the log-count ratio r of each n-gram is
log((p + 1) / (|p| + 2)) - log((q + 1) / (|q| + 2)), with p and q the toxic and the clean texts that have it; an n-gram
takes part if its counts differ by ``MIN_Z`` standard deviations. A logistic regression is trained on the features
x * r, its classes weighted by their shares of all labelled rows. Scores are a narrow map with the model broadcast.

The sample is bounded by ``SAMPLE`` texts of either class, those of the smallest hash of their id (one text for an id); everything
else covers all rows. The test of significance is part of the model: ratios of n-grams below it are mostly chance. A feature that
passes it is in some 16 texts of the sample at least, which bounds their number by that of the sample's n-grams.

Edge cases: a null or empty text has no features and is scored by the intercept; without labelled rows of both classes
the score is the share of toxic ones (0.5 where there are none); a document that is labelled more than once is toxic if
any of its labels says so; null labels are left out; repeated documents are scored each; an empty table gives none;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Out, text_of
from tilewright.runtime import cut, ship

ORDERS = (4, 5, 6)
#: Most labelled texts of either class that the model is fitted on.
SAMPLE = 3000
MIN_Z = 4.0
RIDGE, STEPS = 1.0, 150
BUCKETS = 16

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


def hashes(text: str) -> Iterator[np.ndarray]:
    """The hashes of a text's n-grams, with repeats, an array for each order and stretch of the text."""
    return hashes_of(np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), "<u4").astype(np.uint64))


def hashes_of(chars: np.ndarray) -> Iterator[np.ndarray]:
    last = max(ORDERS)
    for at in range(0, len(chars), _CHUNK):
        part = chars[at : at + _CHUNK + last - 1]
        h = part
        for n in range(2, last + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _STEP + part[n - 1 :]
            if n in ORDERS:
                # n-grams of a shorter order at the end of a stretch that is not the last belong to the next one too
                yield ((h[:_CHUNK] + np.uint64(n)) * _MIX) ^ (h[:_CHUNK] >> np.uint64(31))


def distinct(text: str) -> np.ndarray:
    found = list(hashes(text))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


@dataclass
class Model:
    """Sorted feature hashes, their weights (coefficient times r), the intercept, and the ratios r."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    ratios: np.ndarray | None = None

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.features >> np.uint64(44)] = True

    def present(self, text: str) -> np.ndarray:
        """The numbers of the model's features that the text has."""
        found = [h[self.maybe[h >> np.uint64(44)]] for h in hashes(text)] if len(self.features) else []
        if not found or not len(h := np.unique(np.concatenate(found))):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        return at[self.features[at] == h]

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _log_count_ratios(sample: DataFrame, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that take part and their ratios: tasks count what they have, buckets of hashes add the counts up."""
    dtype = np.dtype([("h", "<u8"), ("p", "<u4"), ("q", "<u4")])

    def add_up(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        h, back = np.unique(h, return_inverse=True)
        out = np.empty(len(h), dtype)
        out["h"], out["p"], out["q"] = h, np.bincount(back, p, len(h)), np.bincount(back, q, len(h))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def squeeze() -> None:
            x = np.concatenate(held)
            held[:] = [add_up(x["h"], x["p"], x["q"])]

        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                h = distinct(text.as_py())
                x = np.zeros(len(h), dtype)
                x["h"], x["p"], x["q"] = h, toxic, 1 - toxic
                held.append(x)
                if sum(map(len, held)) > 4_000_000:
                    squeeze()
        if held:
            squeeze()
            part = held[0]["h"] >> np.uint64(64 - (BUCKETS - 1).bit_length())
            cuts = np.searchsorted(part, np.arange(BUCKETS + 1))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(BUCKETS), pa.int32()), "counts": pa.array([held[0][cuts[k] : cuts[k + 1]].tobytes() for k in range(BUCKETS)], pa.binary())})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_py(), dtype) for b in batches for x in b.column(1)]
        if not parts:
            return
        x = np.concatenate(parts)
        x = add_up(x["h"], x["p"], x["q"])
        p, q = x["p"] / n_pos, x["q"] / n_neg
        z = np.abs(p - q) / np.sqrt(p / n_pos + q / n_neg)
        x = x[z >= MIN_Z]
        r = np.log((x["p"] + 1) / (n_pos + 2)) - np.log((x["q"] + 1) / (n_neg + 2))
        yield pa.RecordBatch.from_pydict({"h": np.ascontiguousarray(x["h"]).view("<i8"), "r": r.astype(np.float64)})

    counts = sample.select("text", "toxic").mapInArrow(count, "bucket int, counts binary")
    chosen = counts.repartitionById(BUCKETS, F.col("bucket")).mapInArrow(choose, "h long, r double")
    rows = chosen.toArrow()
    h, r = rows.column("h").to_numpy().view(np.uint64), rows.column("r").to_numpy()
    order = np.argsort(h)
    return h[order], r[order]


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times r, by gradient steps scaled per feature (Adam)."""
    n, d = len(y), len(r)
    w, b = np.zeros(d), float(np.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1)))
    x, weight = r[cols], weight / weight.sum() * n
    m, v, rate = np.zeros(d + 1), np.zeros(d + 1), 0.05
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, x * w[cols], n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g = np.append(np.bincount(cols, x * error[rows], d) + RIDGE * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w * r, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from the documents that ``labels`` marks; the caller leaves out the rows that it holds out."""
    spark = ship(docs.sparkSession)
    marked = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    rate = pos / (pos + neg) if pos + neg else 0.5
    nothing = Model(np.empty(0, np.uint64), np.empty(0), float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
    if not pos or not neg:
        return nothing
    chosen = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(sample) for k in (0, 1)]
    ids = spark.createDataFrame([tuple(r) for c in chosen for r in c.collect()], "id long, toxic int")
    # one text for an id, so that what is gathered is bounded by the sample; written, as three passes read it
    found = text_of(docs, id_col, text_col).join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    found = cut(found.select("id", "text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return nothing
    features, ratios = _log_count_ratios(found, n[1], n[0])
    if not len(features):
        return nothing
    sent = spark.sparkContext.broadcast(Model(features, ratios, 0.0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            got = [model.present(t.as_py()).astype("<i4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.binary())], names=["id", "toxic", "features"])

    rows = sorted((r["id"], r["toxic"], bytes(r["features"])) for r in found.mapInArrow(vectors, "id long, toxic int, features binary").collect())
    cols = [np.frombuffer(x, "<i4") for _, _, x in rows]
    y = np.array([t for _, t, _ in rows])
    share = {1: pos / max(1, (y == 1).sum()), 0: neg / max(1, (y == 0).sum())}
    weights, intercept = _fit(np.repeat(np.arange(len(y)), [len(c) for c in cols]), np.concatenate(cols), y, ratios, np.where(y == 1, share[1], share[0]))
    return Model(features, weights, intercept, ratios)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of each row, a narrow map over whole texts."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = sent.value, Out(schema)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out.add(key, m.score(text.as_py())):
                    yield out.take()
        yield out.take()

    return text_of(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [sent.value.score(t.as_py() or "") < threshold for t in b.column(at)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str):
    """Whether a row is one of those never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
