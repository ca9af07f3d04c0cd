"""Operator 9: a deterministic, sharded WARC writer and its reader.

Records are range-sorted by page id; each range is written by one task as a sequence of files, and a new file begins
when the one before has reached its size in compressed bytes. Headers and digests are made anew from the payload, and
record ids and gzip members hold nothing but the data, so the same rows in the same ranges give the same bytes. A file
is written under a temporary name and moved when it is whole; the manifest, moved last, commits the archive.

Of equal payloads, the record of the smallest page id is the response and the others are revisits that refer to it.
Payloads below ``min_bytes`` are all responses.

A record's id is made of its page id and payload digest, and a number where both are the same again, so it is unique.

Edge cases: a null html is an empty payload; repeated page ids are separate records, in the order of their payloads' hashes, and of
those of equal payload the first by url is the response; a page without an id is a response that nothing refers to; an id, or none,
that fills several ranges is parted by these hashes; an empty table makes an archive without files; extra columns are not read; a record is
in memory as a whole, once.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import Out, Staged, file_system, range_bounds, range_index
from tilewright.runtime import cut, partitions, scratch, ship

#: A fixed date: the table has none, and a clock would make runs differ.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, again: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the payload's digest and length, and no payload.

    ``again`` counts the records before it of the same page id and payload.
    """
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}:{digest}{f':{again}' if again else ''}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int) -> bytes:
    """A gzip member without name or time."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + z.compress(raw) + z.flush() + (zlib.crc32(raw) & 0xFFFFFFFF).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def members(source) -> Iterator[bytes]:
    """The members of a gzip file, one after the other, each whole in memory."""
    z, parts, data = zlib.decompressobj(31), [], source.read(1 << 20)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []
            if data:
                continue
        data = source.read(1 << 20)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's headers, its HTTP head and its payload; raises ValueError if the block's digest does not hold."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"a broken record: {lines[:3]}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


_FILES = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def write(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, min_bytes: int = 0, level: int = 4, shards: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archive below ``folder``; returns its manifest (file, n_records, n_bytes), a row for each file.

    The earliest page of each digest is found on (id, digest) rows, by an aggregation that combines before its shuffle.
    What later pages refer to goes to the writers as rows of its own that sort before the page, so that the payloads are
    shuffled once, into their ranges. The manifest is as long as the number of files, so it is gathered to the driver, and
    ``manifest.json`` is the archive's commit.
    """
    spark = ship(pages.sparkSession)
    clean = pages.select(
        pages[id_col].cast("long").alias("id"),
        F.regexp_replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    clean = clean.withColumn("hash", F.xxhash64("payload"))
    keyed = clean.where((F.octet_length("payload") >= min_bytes) & F.col("id").isNotNull()).select("id", "hash", F.unhex(F.sha1("payload")).alias("digest"))
    # written first, so that the join stands on two plain exchanges, of which a hot payload's can be split
    first = cut(keyed.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "digests")
    marks = keyed.join(first, "digest").select("id", "hash", F.lit(0).alias("kind"), F.lit("").alias("url"), F.col("digest").alias("payload"), "refers_to").distinct()
    bounds = range_bounds(clean, "id", shards or partitions(spark))
    every = clean.select("id", "hash", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to")).unionByName(marks)
    rows = every.withColumn("range", range_index("id", bounds, F.col("hash"))).repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("id", "hash", "kind", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int, int]] = []
        last, firsts, seen, staged, sink, name, n, size = (), {}, {}, None, None, "", 0, 0
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("id", "hash", "kind", "url", "payload", "refers_to", "range")]
            for i in range(b.num_rows):
                key, mark, kind, url, payload, refers_to, part = (c[i].as_py() for c in cols)
                if (key, mark) != last:
                    last, firsts, seen = (key, mark), {}, {}
                if not kind:
                    firsts[payload] = refers_to
                    continue
                sha = hashlib.sha1(payload).digest()
                target, again = firsts.get(sha), seen.get(sha, 0)
                if target == key and not again:
                    target = None
                seen[sha] = again + 1
                raw = member(record(key, again, url, payload, base64.b32encode(sha).decode(), target), level)
                if sink is not None and size + len(raw) > roll_bytes:
                    staged.__exit__(None)
                    made.append((name, n, size))
                    sink = None
                if sink is None:
                    name = f"pages-{part:06d}-{len(made):05d}.warc.gz"
                    staged, n, size = Staged(folder, name), 0, 0
                    sink = staged.__enter__()
                sink.write(raw)
                n, size = n + 1, size + len(raw)
        if sink is not None:
            staged.__exit__(None)
            made.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True) if made else [[]] * 3, _FILES, strict=True)], schema=_FILES)

    files = sorted(map(tuple, rows.mapInArrow(run, "file string, n_records long, n_bytes long").collect()))
    with Staged(folder, "manifest.json") as f:
        f.write(json.dumps([dict(zip(_FILES.names, x, strict=True)) for x in files], indent=0).encode())
    return spark.createDataFrame(files, "file string, n_records long, n_bytes long")


def read(spark: SparkSession, folder: str, id_col: str = "page_id") -> DataFrame:
    """(id_col, url, record_type, payload, payload_bytes, payload_digest, refers_to) of each record, a task for each file of the manifest.

    Digests are verified; a revisit has no payload, and the length and digest of the one that it refers to. An archive
    without a manifest was not committed and can't be read.
    """
    fs, base = file_system(folder)
    with fs.open_input_file(f"{base}/manifest.json") as f:
        files = [(k, x["file"]) for k, x in enumerate(json.loads(f.read()))]
    schema = pa.schema([(id_col, pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        found = urn.strip("<>").split(":")[2] if urn else ""
        return int(found) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(schema)
        fs, base = file_system(folder)
        for b in batches:
            for name in b.column(b.schema.get_field_index("file")).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for raw in members(source):
                        fields, http, payload = parse(raw)
                        digest, whole = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "response"
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        if whole and (n != len(payload) or digest != base32_sha1(payload)):
                            raise ValueError(f"a broken payload: {fields['WARC-Record-ID']}")
                        if out.add(number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], payload if whole else None, n, digest, number(fields.get("WARC-Refers-To")), size=len(payload)):
                            yield out.take()
        yield out.take()

    at = spark.createDataFrame(files, "k int, file string")
    return at.repartitionById(max(1, len(files)), F.col("k")).mapInArrow(run, f"`{id_col}` long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, **options) -> tuple[DataFrame, str]:
    """Writes the archive into a fresh folder of the shared one; returns what :func:`read` gives, and the folder."""
    folder = scratch(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder, options.get("id_col", "page_id")), folder
