"""First, last, largest and best rows of groups, running counters, gaps: rules with explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = list[Column]


def keep_first(rows: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """One row per key: the first in order. Rows of a key meet, but only the best so far is kept in
    memory, since Spark limits the rank inside each map task before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order."""
    return keep_first(rows, keys, [F.desc(c) for c in order])


def best_per_group(rows: DataFrame, keys: list[str], rank: list[Column], out: list[str]) -> DataFrame:
    """The columns ``out`` of the row with the greatest rank, as an aggregate: partial sums first."""
    best = F.max_by(F.struct(*out), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def running_counter(rows: DataFrame, keys: list[str], order: Order, name: str) -> DataFrame:
    """1, 2, 3 and so on within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def repaired_sizes(entries: DataFrame, archive: str = "arc", end: str = "archive_size") -> DataFrame:
    """Entries whose stored size (modulo 65,536) is replaced by the gap to the next offset where the
    gap is larger by a multiple of 65,536; entries without an offset stay as they are."""
    there = F.col("data_offset") > 0
    following = F.lead("data_offset").over(Window.partitionBy(archive, there).orderBy("data_offset", "entry_index"))
    gap = F.coalesce(following, F.col(end)) - F.col("data_offset")
    larger = there & (gap > F.col("size")) & ((gap - F.col("size")) % 65536 == 0)
    return entries.withColumn("size", F.when(larger, gap).otherwise(F.col("size")))


def block_extents(positions: DataFrame, archive: str = "arc", end: str = "archive_size") -> DataFrame:
    """Start positions with the end of each block: the next start or the end of the archive."""
    following = F.lead("start").over(Window.partitionBy(archive).orderBy("start"))
    return positions.withColumn("end", F.coalesce(following, F.col(end)))
