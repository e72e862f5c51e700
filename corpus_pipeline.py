"""The corpus pipeline: documents through five operators, each stage a Parquet table for the next.

Stages take (spark, docs, sf_dir) and return a table; all but the last keep the columns of documents.
A label table beside the documents trains the toxicity stage. SQL can express neither the trees nor
the encoder, so the whole has no SQL; tests hold it against a brute-force version stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, exact_dedup, minhash_dedup, source_mix, toxicity
from quire.llm.shared import forget, written
from quire.plans.registry import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees reject go."""
    return toxicity.not_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies stays: five-word shingles, similarity 0.8."""
    return minhash_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with its count and the digest of what they decode to."""
    import public_tokenizers

    return byte_bpe.encoded_corpus(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_texts),
]

#: None: SQL can express neither the first nor the last stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
