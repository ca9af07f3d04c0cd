"""A corpus pipeline over ``documents``: five stages, each over all that the one before has kept.

Parameters: documents that score 0.5 or more for toxicity go (the model learns from the labels that op6 learns from);
later copies of maximal runs of lines, of 60 characters or more together, are deleted, and documents that this leaves
without text go; of documents whose five-word shingles have a Jaccard coefficient of 0.8 or more, directly or through
others, the one of the smallest id stays; documents of which a twentieth of the words are in 13-word windows of the
benchmark go, and such words are cut from the others; what is left is encoded by byte-level BPE, and decoded again.

Edge cases: null and empty texts pass every stage; rows that repeat an id stay or go together, but for their own toxicity
and contamination; rows without an id are never copies of others; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, decontaminate, jaccard, line_dedup, toxicity
from tilewright.runtime import scratch, ship, table

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars after a change of texts."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(ship(spark), sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id"))))


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.without_copies(docs, drop_emptied=True), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.join(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    copies = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, table(ship(spark), sf_dir, "benchmark")), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    out = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminated),
    ("byte_bpe", encoded),
]

#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written to the shared folder and read again."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
