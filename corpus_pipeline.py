"""A pipeline for training text over documents: five stages, each written before the next one reads it.

Quality classifier: documents scored below 0.5 go. N-gram Jaccard join: of each group of near duplicates the one with the smallest id stays. Repeats:
bytes that an earlier document of those left holds as well, in 50 or more at a stretch, are cut out, and documents that nothing is left
of go. Personal data: spans are replaced by the name of their kind. Packing: pieces of at most 2048 tokens are placed in sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from firstlook.llm.jaccard_join import without_near_copies
from firstlook.llm.packing import pack_documents
from firstlook.llm.pii import fit_tagger, redact
from firstlook.llm.quality_classifier import score_quality
from firstlook.llm.queries import quality_model
from firstlook.llm.suffix_dedup import without_repeats
from firstlook.plans.written import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more. The model learns from the data set's documents and labels, outside the held-out fold."""
    return score_quality(_documents(docs), quality_model(spark, sf_dir)).filter("score >= 0.5").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates, a null id being larger than all others.

    Equal rows stay once. Documents without words are near duplicates of nothing.
    """
    return without_near_copies(_documents(docs)).select(*COLUMNS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated bytes; characters that are cut in two go as well, and so do documents of which nothing is left."""

    def whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [k.decode("utf-8", "ignore") for k in batch["kept"].to_pylist()]
            left = pa.array([bool(t) or not n for t, n in zip(texts, batch["n_removed"].to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()), "lang": batch["lang"], "source": batch["source"],
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }).filter(left)

    kept = without_repeats(_documents(docs).drop("n_chars"), 50, rest=True)
    return kept.select("doc_id", "n_removed", "kept", "rest.lang", "rest.source").mapInArrow(whole_characters, SCHEMA)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with [EMAIL], [IP], [CARD] and [PHONE] in place of personal data; the tagger learns from the documents at hand."""
    rows = _documents(docs)
    return redact(rows, fit_tagger(rows)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence."""
    return pack_documents(_documents(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", no_repeats),
    ("PII", no_personal_data),
    ("best-fit packing", packed),
]
#: No stage can be said in SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of a data set; all but the last are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
