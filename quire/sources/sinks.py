"""Sinks: JSON lines, CSV reports, manifests, and one file per row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One JSON object per line, nulls included, text unescaped; with an order, the files in order of
    their names hold the rows in it, sorted by ranges and not in one task."""
    rows = rows.orderBy(*order) if order else rows
    rows.write.option("ignoreNullFields", "false").json(path)


def write_lines(rows: DataFrame, path: str, order: list[str], column: str = "line") -> None:
    """A text column as lines; the files in order of their names hold the rows in order."""
    rows.orderBy(*order).select(column).write.text(path)


def _with_places(rows: DataFrame) -> DataFrame:
    """Rows read from files with ``place``, their number in the order of files and lines.

    Rows are numbered inside each file; how many rows the files before it have comes from their
    counts, one row a file."""
    columns = rows.columns
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_id"))
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select(F.col("_file").alias("_f"), F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_file").orderBy("_id"))
    return rows.withColumn("_number", number).join(starts, F.col("_file") == F.col("_f")).select(*columns, (F.col("_before") + F.col("_number")).alias("place"))


def read_ordered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON lines with their places."""
    return _with_places(spark.read.schema(schema).json(path))


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their places."""
    return _with_places(spark.read.text(path).withColumnRenamed("value", "line"))


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV with a header; null is the empty field."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def manifest_json(manifest: DataFrame) -> str:
    """A one-row table as indented JSON."""
    row = manifest.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
    return json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)


def write_text(text: str, spark, path: str) -> None:
    """A small driver-side text to any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def safe_path(name: str) -> str:
    """A relative path without steps out of the folder."""
    parts = [p for p in name.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    return "/".join(parts) or "Untitled"


def clashing_names(rows: DataFrame, name: str) -> DataFrame:
    """Names that more than one row would be written under."""
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> None:
    """A file per row under a folder that all executors mount; clashing names are an error."""
    import os

    clash = clashing_names(rows, name).first()
    if clash is not None:
        raise ValueError(f"several rows would be written to {clash[0]}")

    def put(part) -> None:
        for row in part:
            path = os.path.join(folder, safe_path(row[0]))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            data = row[1].encode() if isinstance(row[1], str) else bytes(row[1] or b"")
            with open(f"{path}.part", "wb") as file:
                file.write(data)
            os.replace(f"{path}.part", path)

    rows.select(name, content).foreachPartition(put)


def zip_folder(folder: str) -> str:
    """A folder that the driver mounts, packed beside it; the name has the time in UTC."""
    import shutil
    from datetime import UTC, datetime

    return shutil.make_archive(f"{folder}-{datetime.now(UTC):%Y%m%dT%H%M%SZ}", "zip", folder)
