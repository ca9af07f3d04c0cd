"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that never compares a known prefix again."""

from __future__ import annotations

import numpy as np
import zstandard

_A, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _kind(width: int) -> np.dtype:
    """Numbers that hold the common-prefix lengths of rows of a width."""
    return np.dtype(np.uint8 if width < 256 else "<u2" if width < 65536 else "<u4")


def as_strings(rows: np.ndarray) -> np.ndarray:
    """A matrix of bytes as an array of fixed-width strings, which compare as bytes."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix whose width is a multiple of 8."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for word in np.ascontiguousarray(rows).view("<u8").reshape(len(rows), rows.shape[1] // 8).T:
        h = (h ^ word) * _A
        h ^= h >> np.uint64(29)
    h *= _M
    return h ^ (h >> np.uint64(32))


def sorted_run(rows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, the smallest document of each, and for each row given its place among them."""
    if not len(rows):
        return rows, docs, np.empty(0, np.int64)
    text = as_strings(rows)
    o = np.argsort(text, kind="stable")
    text, docs = text[o], docs[o]
    new = np.concatenate([[True], text[1:] != text[:-1]])
    first = np.flatnonzero(new)
    place = np.empty(len(o), np.int64)
    place[o] = np.cumsum(new) - 1
    return rows[o[first]], np.minimum.reduceat(docs, first), place


def front_code(rows: np.ndarray, docs: np.ndarray) -> bytes:
    """A sorted run as common-prefix lengths, the rest of each row, and the documents, compressed."""
    n, width = rows.shape
    differ = np.ones((n, width), bool)
    differ[1:] = rows[1:] != rows[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), width).astype(_kind(width))
    prefix[:1] = 0
    rest = rows[np.arange(width) >= prefix[:, None]]
    body = prefix.tobytes() + np.ascontiguousarray(docs.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() + rest.tobytes()
    return np.array([n, width], "<u8").tobytes() + zstandard.ZstdCompressor(1).compress(body)


def decode(raw: bytes) -> tuple[list[bytes], list[int], np.ndarray]:
    """The rows, common-prefix lengths and documents of a front-coded run."""
    n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    body = zstandard.ZstdDecompressor().decompress(raw[16:])
    kind = _kind(width)
    prefix, at = np.frombuffer(body, kind, n).tolist(), kind.itemsize * n
    docs = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()
    rows, last, at = [], b"", at + 8 * n
    add = rows.append
    for h in prefix:
        end = at + width - h
        last = last[:h] + body[at:end]
        add(last)
        at = end
    return rows, prefix, docs


def squeeze(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as compressed differences."""
    d = np.diff(values.astype(np.int64), prepend=0).astype("<u4")
    return np.array([len(d)], "<u4").tobytes() + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes())


def expand(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4:]), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


def merge(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int]]:
    """The runs in the order in which their next rows are taken, and each row's common prefix with the row before.

    A loser stands in the tree with the length of its common prefix with the row that beat it. Of two contenders whose
    lengths, both against the last row taken, differ, the longer is the smaller string; only where they are equal are
    bytes compared, from there on.
    """
    k = len(runs)
    size = 1 << max(0, k - 1).bit_length()
    lengths = [len(r) for r in runs] + [0] * (size - k)
    at = [0] * size
    current: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (size - k)
    stream, known = [0] * (2 * size), [-1] * (2 * size)

    def compare(a: bytes, b: bytes, start: int) -> tuple[bool, int]:
        """Whether a <= b, and their common prefix."""
        n = len(a)
        if a == b:
            return True, n
        x, y = int.from_bytes(a[start:], "big"), int.from_bytes(b[start:], "big")
        return x < y, start + ((n - start) * 8 - (x ^ y).bit_length()) // 8

    winners = list(range(size))
    level = size
    while level > 1:
        half, new = level // 2, []
        for i in range(half):
            a, b = winners[2 * i], winners[2 * i + 1]
            ca, cb = current[a], current[b]
            if cb is None:
                win, lose, h = a, b, -1
            elif ca is None:
                win, lose, h = b, a, -1
            else:
                less, h = compare(ca, cb, 0)
                win, lose = (a, b) if less else (b, a)
            stream[half + i], known[half + i] = lose, h
            new.append(win)
        winners, level = new, half
    w, last = winners[0], 0
    order: list[int] = []
    out: list[int] = []
    take, note = order.append, out.append
    for _ in range(sum(lengths)):
        take(w)
        note(last)
        i = at[w] + 1
        at[w] = i
        if i < lengths[w]:
            mine = current[w] = runs[w][i]
            h = prefixes[w][i]
        else:
            mine = current[w] = None
            h = -1
        node = (size + w) >> 1
        while node:
            g = known[node]
            if g > h:
                known[node] = h
                stream[node], w = w, stream[node]
                h = g
                mine = current[w]
            elif g == h and h >= 0:
                other = current[stream[node]]
                n = len(mine)
                if mine == other:
                    known[node] = n
                else:
                    x, y = int.from_bytes(mine[h:], "big"), int.from_bytes(other[h:], "big")
                    known[node] = h + ((n - h) * 8 - (x ^ y).bit_length()) // 8
                    if x > y:
                        stream[node], w = w, stream[node]
                        mine = other
            node >>= 1
        last = h
    return order, out
