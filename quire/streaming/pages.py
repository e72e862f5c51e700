"""The same operators on streams: pages are transformed row by row as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_text
from quire.operators.chunking import chunks


def chunk_stream(docs: DataFrame, markdown: str = "text", target: int = 900, overlap: int = 120) -> DataFrame:
    """Chunks of a stream of documents; chunking is stateless, so no watermark is needed."""
    return chunks(docs, markdown, target, overlap)


def first_seen(docs: DataFrame, time: str, text: str = "text", delay: str = "1 hour") -> DataFrame:
    """Documents whose normalised text was not seen within the watermark; state stays bounded by it."""
    rows = docs.withColumn("content_sha256", F.sha2(normalize_text(F.col(text)), 256))
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_sha256"])


def counts(events: DataFrame, time: str, keys: list[str], width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows per window and key, final once the watermark has passed."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return rows.groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n_rows"))
