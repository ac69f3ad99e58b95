"""Corpus pipeline: quality classifier, near-dedup, decontamination, personal data, SentencePiece codec.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet into the
folder named by spark.checkpoint.dir and reads it again for the next stage. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import decontam, minhash, pii, quality, sentencepiece_codec
from textmill.llm.common import materialise, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.mask(docs)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.encode_decode(docs, path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("pii", stage_pii),
    ("sentencepiece", stage_sentencepiece),
]

#: No SQL expresses the sampled signatures, the fitted models or the agenda; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
