"""Candidate decodings scored against trusted copies: report rows joined with entries and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.binary import common_prefix, first_difference
from quire.functions.decode import candidate_rows
from quire.functions.text import basename
from quire.operators.ordered import best_per_group, keep_first

OUTPUT = ["filename", "status", "best_variant", "best_prefix_match", "best_first_diff", "best_len", "best_sha256", "remote_len", "remote_sha256", "arc", "detail"]
STATUSES = ("exact_match", "best_candidate", "missing_local_entry", "remote_error", "no_candidates")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a report that matter, by header; other columns are ignored."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("filename", "status", "remote_url")])


def mismatches(report: DataFrame, limit: int | None = None, order: str = "filename") -> DataFrame:
    """Report rows to score; a limit takes the first in order, and 0 takes none."""
    rows = report.where("status = 'mismatch'")
    return rows if limit is None else rows.orderBy(order).limit(limit)


def first_entries(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Of the entries that are asked for, the first of each name by archive and position."""
    wanted = names.select(F.lower(basename(F.col("filename"))).alias("key")).distinct()
    rows = entries.withColumn("key", F.lower("filename")).join(wanted, "key", "left_semi")
    paths = [F.col("path")] if "path" in entries.columns else []
    return keep_first(rows, ["key"], [F.col("arc"), *paths, F.col("entry_index")])


def best_candidates(scored: DataFrame, keys: list[str], out: list[str]) -> DataFrame:
    """Per key the candidate with the longest prefix, then an exact one, the longest, the earliest."""
    rank = [F.col("prefix_match"), F.col("exact_match").cast("int"), F.col("payload_len"), -F.col("place")]
    return best_per_group(scored, keys, rank, out)


def scores(payload: str, trusted: str) -> dict[str, F.Column]:
    """prefix_match, first_diff and exact_match of two binary columns."""
    a, b = F.col(payload), F.col(trusted)
    return {"prefix_match": common_prefix(a, b), "first_diff": first_difference(a, b), "exact_match": a == b}


def score_report(report: DataFrame, entries: DataFrame, remote: DataFrame, limit: int | None = None) -> DataFrame:
    """The scoring report. ``entries``: arc, entry_index, filename, raw. ``remote``: remote_url,
    content, error."""
    rows = mismatches(report, limit).select("filename", "remote_url", F.lower(basename(F.col("filename"))).alias("key"))
    local = first_entries(entries, rows)
    found = rows.join(local.select("key", "arc", "raw"), "key", "left")
    missing = found.where("arc IS NULL").select("filename", F.lit("missing_local_entry").alias("status"), F.lit("no entry of that name").alias("detail"))
    fetched = found.where("arc IS NOT NULL").join(remote.select("remote_url", "content", "error"), "remote_url", "left")
    failed = fetched.where("content IS NULL").select("filename", F.lit("remote_error").alias("status"), "arc", F.coalesce("error", F.lit("no trusted copy")).alias("detail"))
    made = candidate_rows(fetched.where("content IS NOT NULL").select("filename", "arc", "content", "raw"))
    scored = made.withColumns(scores("payload", "content")).withColumn("payload_len", F.octet_length("payload"))
    scored = scored.withColumn("remote_len", F.octet_length("content")).withColumn("remote_sha256", F.sha2("content", 256))
    best = best_candidates(scored, ["filename", "arc"], ["variant", "prefix_match", "first_diff", "payload_len", "sha256", "exact_match", "remote_len", "remote_sha256"])
    best = best.select(
        "filename",
        "arc",
        F.when(F.col("exact_match"), "exact_match").otherwise("best_candidate").alias("status"),
        F.col("variant").alias("best_variant"),
        F.col("prefix_match").alias("best_prefix_match"),
        F.col("first_diff").alias("best_first_diff"),
        F.col("payload_len").alias("best_len"),
        F.col("sha256").alias("best_sha256"),
        "remote_len",
        "remote_sha256",
        F.lit("").alias("detail"),
    )
    return best.unionByName(missing, allowMissingColumns=True).unionByName(failed, allowMissingColumns=True).select(*OUTPUT)


def status_counts(scored: DataFrame) -> DataFrame:
    status = F.col("status")
    return scored.agg(F.count_if(status == "exact_match").alias("exact"), F.count_if(status == "best_candidate").alias("best_candidate"), F.count_if(status.isin(*STATUSES[2:])).alias("errors"))


def probe(entries: DataFrame, name: str) -> DataFrame:
    """Every candidate of every entry of that name, in all archives."""
    from quire.functions.decode import candidate_name

    rows = candidate_rows(entries.where(F.lower("filename") == name.lower()))
    return rows.withColumn("file_name", candidate_name(F.col("filename"), F.col("variant")))
