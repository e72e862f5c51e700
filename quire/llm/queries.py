"""The thin queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import byte_bpe, exact_dedup, minhash_dedup, pii_surrogates, quality_rules, source_mix, suffix_dedup, token_rollup, toxicity, warc
from quire.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("op6_quality_rules", quality_rules.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@REGISTRY.query("op1_exact_dedup", exact_dedup.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document, found through the extendible-hash index."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("bucket_depth", "chain")


@REGISTRY.query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@REGISTRY.query("op5_source_mix", source_mix.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


@REGISTRY.query("op8_warc", warc.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture, written to archives and read back."""
    return warc.page_captures(table(spark, sf_dir, "pages"))


@REGISTRY.query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity scores of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@REGISTRY.query("op4_token_rollup", token_rollup.ORACLE)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after a load, a revision, a pruning, its reversal and their replays."""
    return token_rollup.corpus_totals(table(spark, sf_dir, "documents"))


@REGISTRY.query("bpe_token_rollup")
def bpe_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under the same versions and the byte-level BPE."""
    import public_tokenizers

    return token_rollup.all_totals(table(spark, sf_dir, "documents"), "byte-bpe-50k/1", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@REGISTRY.query("op10_minhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a similarity of 0.85 or more."""
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"), percent=85, width=3)


@REGISTRY.query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of documents before it."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), texts=False)


@REGISTRY.query("op9_pii_surrogates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii_surrogates.surrogates(table(spark, sf_dir, "documents"))
