"""Operator 2: token ids in Arrow IPC files of fixed-size lists.

The documents are put into ascending id order by range partitions. Each partition writes two Arrow IPC files into the
shared folder: ``tokens-<shard>.arrow`` holds its ids as equal-length sequences (``ids``: fixed_size_list of
uint16, or uint32 for vocabularies beyond it; ``mask``: fixed_size_list<bool>, false for the padding of the shard's last
sequence), and
``docs-<shard>.arrow`` where each document starts. The buffers of a batch of fixed-size lists are one flat array, so a
reader maps the file and takes any sequence, or any span of ids, without copying or parsing.

Texts are encoded without special tokens: a special token's spelling in a text, such as ``<|endoftext|>``, is ordinary text. Words
are encoded once and kept where the tokenizer's file says that it splits and drops what :class:`WordEncoder` relies on; with any
other tokenizer whole texts are encoded.

Edge cases: a null or empty text is the end id alone; repeated ids are separate documents, in the order of their texts'
hashes, and of the texts where these are equal; rows without an id come first; an id, or none, that fills several shards is
parted by these hashes; an empty table writes no shard; extra columns are not read; a very long text is one row, in as many batches
as it needs.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Out, Staged, by_range, file_system, text_of
from tilewright.runtime import partitions, scratch, ship

CACHE_ENTRIES = 1_200_000
_BEFORE_MARKS = re.compile(rb"(?<=[a-z])(?=[.,!?;:])").sub
#: Sequences in a record batch.
BATCH = 256

_DOCS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


#: What a tokenizer's file must say for its texts to be encoded word by word (fixed values of the format).
_TRAITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordEncoder(dict):
    """Encodes by the tokenizers library; by words where the vocabulary's pieces mark their ends by </w>.

    Such a tokenizer lowers letters, splits at white space, which it drops, and between a letter and a mark such as a comma;
    so what lies between such places has its ids on its own. As a dictionary, this maps such words to ids that it has seen.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_words = all(said.get(k) == v for k, v in _TRAITS.items()) and said["model"].get("type") == "BPE" and said["model"].get("end_of_word_suffix") == "</w>" and all(t["special"] for t in said["added_tokens"])
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)  # the pieces that end a word
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        words = [_BEFORE_MARKS(b" ", t.encode().lower()).split() for t in texts]
        out, get, late = [], self.__getitem__, []
        for k, ws in enumerate(words):
            try:
                out.append(b"".join(map(get, ws)))
            except KeyError:  # some word is new
                out.append(b"")
                late.append(k)
        if late:
            seen = {w for k in late for w in words[k]}
            new = [w for w in seen if w not in self]
            if len(self) + len(new) > CACHE_ENTRIES:
                self.clear()
                new = list(seen)
            self._learn([w.decode() for w in new])
            for k in late:
                out[k] = b"".join(map(get, words[k]))
        return out

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        for k in range(0, len(letters), 2000):
            part = letters[k : k + 2000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(part):  # some of these letters aren't one word to the tokenizer
                words = words + part
                continue
            raw = ids.tobytes()
            self.update(zip([w.encode() for w in part], [raw[a:z] for a, z in zip([0, *stops], stops, strict=False)], strict=True))
        rest = [w for w in words if w.encode() not in self]
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[w.encode()] = np.array(e.ids, "<u4").tobytes()


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _sequences(ids: np.ndarray, length: int) -> pa.RecordBatch:
    n = -(-len(ids) // length)
    flat, mask = np.zeros(n * length, ids.dtype), np.zeros(n * length, bool)
    flat[: len(ids)], mask[: len(ids)] = ids, 1
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], names=["ids", "mask"])


def _schema(length: int, size: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if size <= 1 << 16 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, length: int = 1024, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files below ``folder`` and returns the manifest (shard, n_docs, n_tokens, start), a row for each shard.

    ``start`` is the number of ids in the shards before. The manifest is as long as the number of partitions, so it is
    gathered to the driver for its running sum.
    """
    spark = ship(docs.sparkSession)
    ranged, _ = by_range(text_of(docs, id_col, text_col).withColumn("_hash", F.xxhash64("text")), "id", "_hash", shards or partitions(spark))
    ranged = ranged.sortWithinPartitions("id", "_hash", "text").select("_range", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, n_docs, at = encoder(tokenizer_path), None, 0, 0
        end, tail, held, block = np.array([end_id], "<u4").tobytes(), [], 0, BATCH * length
        tokens = index = sinks = None
        kind = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        for b in batches:
            if not b.num_rows:
                continue
            if shard is None:
                shard = b.column(0)[0].as_py()
                sinks = [Staged(folder, f"tokens-{shard:06d}.arrow"), Staged(folder, f"docs-{shard:06d}.arrow")]
                tokens, index = pa.ipc.new_file(sinks[0].__enter__(), _schema(length, enc.size)), pa.ipc.new_file(sinks[1].__enter__(), _DOCS)
            keys, texts = b.column(1).to_pylist(), b.column(2)
            for k in range(0, b.num_rows, 512):
                rows = []
                for key, ids in zip(keys[k : k + 512], enc.encode_all(texts[k : k + 512].to_pylist()), strict=True):
                    ids += end
                    rows.append((key, at, len(ids) // 4))
                    at += len(ids) // 4
                    tail.append(ids)
                    held += len(ids) // 4
                n_docs += len(rows)
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_DOCS))
                if held >= block:
                    ids = np.frombuffer(b"".join(tail), "<u4").astype(kind)
                    full = held // block * block
                    for i in range(0, full, block):
                        tokens.write_batch(_sequences(ids[i : i + block], length))
                    tail, held = [ids[full:].astype("<u4").tobytes()], held - full
        if shard is not None:
            if held:
                tokens.write_batch(_sequences(np.frombuffer(b"".join(tail), "<u4").astype(kind), length))
            tokens.close()
            index.close()
            for s in sinks:
                s.__exit__(None)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [n_docs], "n_tokens": [at]}, schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = sorted(map(tuple, ranged.mapInArrow(run, "shard int, n_docs long, n_tokens long").collect()))
    starts, at = [], 0
    for shard, n_docs, n in rows:
        starts.append((shard, n_docs, n, at))
        at += n
    return spark.createDataFrame(starts, "shard int, n_docs long, n_tokens long, start long")


class Shard:
    """Random access to a shard by memory mapping (or by ranged reads where the store is not a local one)."""

    def __init__(self, folder: str, shard: int):
        fs, base = file_system(folder)
        local = fs.type_name == "local"
        opened = [(pa.memory_map(p) if local else fs.open_input_file(p)) for p in (f"{base}/tokens-{shard:06d}.arrow", f"{base}/docs-{shard:06d}.arrow")]
        self.tokens, self.docs = map(pa.ipc.open_file, opened)
        self.length = self.tokens.schema.field("ids").type.list_size
        self._batch: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def batch(self, i: int) -> np.ndarray:
        """The ids of a batch's sequences as one flat array, a view of the file."""
        if self._batch[0] != i:
            self._batch = (i, self.tokens.get_batch(i).column(0).values.to_numpy(zero_copy_only=True))
        return self._batch[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The k-th sequence's ids and mask, views of the file."""
        got, at = self.tokens.get_batch(k // BATCH), k % BATCH * self.length
        return got.column(0).values.to_numpy(zero_copy_only=True)[at : at + self.length], got.column(1).values[at : at + self.length]

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids of the shard from a position on."""
        block, parts = BATCH * self.length, []
        while n:
            i, at = divmod(start, block)
            parts.append(self.batch(i)[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, "<u4")])


def read(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of each document, read from the files; ids as little-endian 32-bit integers."""
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        for b in batches:
            for shard, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(folder, shard)
                for i in range(s.docs.num_record_batches):
                    for key, start, n in zip(*(c.to_pylist() for c in s.docs.get_batch(i).columns), strict=True):
                        if out.add(key, base + start, n, s.span(start, n).astype("<u4").tobytes(), size=4 * n):
                            yield out.take()
        yield out.take()

    n = max(1, manifest.count())
    return manifest.select("shard", "start").repartitionById(n, F.col("shard")).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> tuple[DataFrame, str]:
    """Writes the files into a fresh folder of the shared one; returns what :func:`read` gives, and the folder."""
    folder = scratch(docs.sparkSession, "token-files")
    key = options.get("id_col", "doc_id")
    return read(write(docs, tokenizer_path, folder, **options), folder, key), folder
