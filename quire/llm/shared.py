"""What the operators of this subpackage have in common."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules: ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Salts that split a hot key: a key with a third of all rows puts 1/192 of them in a task.
SALTS = 64

_written: list[tuple[SparkSession, str]] = []
_path_by_table: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, as in tests on a local master, a temporary folder stands in; on a cluster
    that is an error, since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = context.getCheckpointDir()
    if known is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        known = context.getCheckpointDir()
    return known


def path_of(spark: SparkSession, path: str):
    """A path as Hadoop sees it, and its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _clean() -> None:
    for spark, path in _written:
        try:
            where, system = path_of(spark, path)
            system.delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(_clean)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    This cuts the lineage: a lost executor costs no recomputation of what is written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _path_by_table[table] = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``written`` returned, where nothing reads it any more."""
    for table in tables:
        if table is not None and (path := _path_by_table.pop(table, None)):
            where, system = path_of(table.sparkSession, path)
            system.delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_hot_key(rows: DataFrame, facts: DataFrame, key: list[str], by: str, salts: int = SALTS, keep_salt: bool = False) -> DataFrame:
    """Left join of rows with facts (one row per key) where a key may hold a third of all rows.

    Rows get a salt from ``by``; the distinct (key, salt) pairs, at most ``salts`` a key, take up
    the facts first, so that the wide join runs on (key, salt) and no task gets a whole hot key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(by)), F.lit(salts)).cast("int"))
    pairs = salted.select(*key, "_salt").distinct()
    joined = salted.join(pairs.join(facts, key, "left"), [*key, "_salt"], "left")
    return joined if keep_salt else joined.drop("_salt")


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _pieces(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
    for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
        yield table.slice(s, e - s)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], whole: bool = True, together: bool = True) -> Iterator[pa.Table]:
    """Sorted batches cut where one of the keys, which are never null, changes.

    Tables hold one run each, or with ``together`` several, numbered in a column ``run``. Without
    ``whole`` a long run comes in several pieces, so that no run need fit into memory."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if not whole:
            yield from _pieces(table, _starts(table, keys))
            continue
        ends = (held[0].slice(0, 1), table.slice(0, 1), table.slice(table.num_rows - 1, 1)) if held else ()
        if ends and all(len({e.column(k)[0].as_py() for e in ends}) == 1 for k in keys):
            held.append(table)
            continue
        table = pa.concat_tables([*held, table])
        starts = _starts(table, keys)
        held = [table.slice(starts[-1])]
        yield from _closed(table.slice(0, starts[-1]), starts[:-1], together)
    if held:
        yield from _closed(pa.concat_tables(held), np.zeros(1, np.int64), together)


def _closed(table: pa.Table, starts: np.ndarray, together: bool) -> Iterator[pa.Table]:
    if not table.num_rows:
        return
    if not together:
        yield from _pieces(table, starts)
    else:
        number = np.zeros(table.num_rows, np.int64)
        number[starts[1:]] = 1
        yield table.append_column("run", pa.array(number.cumsum()))
