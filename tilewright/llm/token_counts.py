"""Operator 7: token counts by a Viterbi search that keeps only counts.

For a unigram vocabulary, an Aho-Corasick automaton enumerates the pieces that occur in a text, and a dynamic program
over the positions carries the best score and its number of pieces, without any path. The rules are those of the
tokenizers library's Unigram model behind its Metaspace pre-tokenizer: blanks become U+2581 and each begins a unit; of
equal scores at a position, the piece that begins first (the longest) stays; a character without a piece of its own
costs the lowest score less 10; neighbouring unknown characters count as one token, or, with ``byte_fallback``, each as
its UTF-8 bytes, for which the vocabulary must have the 256 byte pieces.

Edge cases: null and empty texts count 0; repeated rows are counted each; an empty table gives none; extra columns are
not read; a unit of any length takes time linear in its length and its matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.llm.common import Out, text_of
from tilewright.runtime import ship

CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
BLANK = "▁"


class Counter(dict):
    """Counts the tokens of units; as a dictionary it keeps those of short units."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_fallback: bool = False):
        super().__init__()
        if byte_fallback and not {f"<0x{k:02X}>" for k in range(256)} <= {p for p, _ in pieces}:
            raise ValueError("byte_fallback needs the 256 byte pieces")
        self.bytes = byte_fallback
        self.machine = ahocorasick.Automaton()
        for i, (piece, value) in enumerate(pieces):
            if piece and not (self.machine.exists(piece)) or piece and i == unknown:
                self.machine.add_word(piece, (len(piece), value))
        self.machine.make_automaton()
        self.unknown = min((v for _, v in pieces), default=0.0) - 10.0

    def count(self, unit: str) -> int:
        n = len(unit)
        best: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        tail = [False] * (n + 1)  # whether the best way to a position ends in an unknown character
        known = [False] * n
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, value) in self.machine.iter(unit):
            ends[end].append((length, value))
            if length == 1:
                known[end] = True
        for end in range(n):
            ways = sorted(ends[end], reverse=True)
            if not known[end]:
                ways.append((0, self.unknown))
            top, at = None, end + 1
            for length, value in ways:
                start = end + 1 - (length or 1)
                total = best[start] + value
                if top is None or total > top:
                    top = total
                    tail[at] = not length
                    if not length and self.bytes:
                        pieces[at] = pieces[start] + len(unit[start].encode())
                    else:
                        pieces[at] = pieces[start] + (0 if not length and tail[start] else 1)
            best[at] = top
        return pieces[n]

    def __missing__(self, unit: str) -> int:
        n = self.count(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[unit] = n
        return n

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        head, *rest = text.replace(" ", BLANK).split(BLANK)
        # the first unit gets a blank unless the text begins with one
        return (self[BLANK + head] if head else 0) + sum(map(self.__getitem__, [BLANK + u for u in rest]))


def unigrams(model_path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file, by that library."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


_LOADED: dict[tuple[str, bool], Counter] = {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = False) -> DataFrame:
    """(id_col, n_tokens) of each row, a narrow map over whole texts."""
    ship(docs.sparkSession)
    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (model_path, byte_fallback) not in _LOADED:
            _LOADED[model_path, byte_fallback] = Counter(unigrams(model_path), byte_fallback=byte_fallback)
        counter, out = _LOADED[model_path, byte_fallback], Out(schema)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if out.add(key, counter.tokens(text.as_py())):
                    yield out.take()
        yield out.take()

    return text_of(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long")
