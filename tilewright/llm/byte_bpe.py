"""Operator 1: byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own. A segment tree over the byte positions of the match keeps, at its
root, the leftmost pair of the lowest rank; a merge changes the live neighbours' leaves and their O(log n) ancestors, so
a match of n bytes takes O(n log n) however long it is.

Edge cases: a null text is an empty one, which has no ids and decodes to no bytes; repeated rows are encoded
each; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.llm.common import Out, text_of
from tilewright.runtime import ship

#: Most matches whose ids a Python worker keeps, and the longest that it keeps.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 64

_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one match."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, n - 2).bit_length()
    shift = size.bit_length()
    low = (1 << shift) - 1
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for v in range(size - 1, 0, -1):
        a, b = tree[2 * v], tree[2 * v + 1]
        tree[v] = a if a < b else b
    end, after, before = list(range(1, n + 2)), list(range(1, n + 2)), list(range(-1, n + 1))

    def put(i: int, key: int) -> None:
        v = size + i
        tree[v] = key
        while v > 1:
            other = tree[v ^ 1]
            v >>= 1
            best = key if key < other else other
            if tree[v] == best:
                return
            tree[v] = key = best

    def pair(i: int, stop: int) -> int:
        r = get(piece[i:stop]) if stop - i <= longest else None
        return _NONE if r is None else r << shift | i

    while (top := tree[1]) != _NONE:
        i = top & low
        j = after[i]
        stop, k = end[j], after[j]
        end[i], after[i], before[k] = stop, k, i
        if j < n - 1:
            put(j, _NONE)
        put(i, pair(i, end[k]) if k < n else _NONE)
        if (p := before[i]) >= 0:
            put(p, pair(p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class ByteBPE(dict):
    """An encoder and decoder; as a dictionary it maps short matches to their ids as little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall

    def __missing__(self, match: str) -> bytes:
        raw = match.encode()
        ids = np.array(merge(raw, self.ranks, self.longest), "<u4").tobytes()
        if len(raw) <= CACHE_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    """The worker's coder for a rank file, loaded once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded) of each row: ids as little-endian unsigned 32-bit integers, decoded as bytes.

    A narrow map: no shuffle, so a row's cost follows its own length. ``ranks_path`` must be readable by the workers.
    """
    ship(docs.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = coder(ranks_path, pattern), Out(schema)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = bpe.encode(text.as_py())
                back = bpe.decode(ids)
                if out.add(key, len(ids) // 4, ids, back, size=len(ids) + len(back)):
                    yield out.take()
        yield out.take()

    return text_of(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids binary, decoded binary")
