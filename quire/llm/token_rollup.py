"""Token counts as delta-maintained rollups.

A change feed says what became of a document's count under a tokenizer version: ``before`` and
``after`` states, null where there was or is none. Each change is signed rows (minus the state
before, plus the one after), added up by source, language and tokenizer before any shuffle; a batch
is that small table of additive deltas, and totals are the sum of all committed batches.

A batch commits by an object of its own name that is written last and names its finished folder.
The name is the batch's identity: committing it again, after a crash or a replay, changes nothing.
Executors lost while the deltas are computed only repeat their tasks. ``compact`` folds the
committed batches into one base whose manifest lists them, so replays stay harmless and reading
stays cheap. One writer at a time may commit a given batch.

Defined results: null source, language or tokenizer form groups of their own; groups whose
documents and tokens are all gone vanish from the totals; a null text counts as empty, and texts of
any length count whole; rows that repeat a document count each, and sums know no ties; empty feeds
commit and change nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe
from quire.llm.shared import WORD_CLASS, fresh_path, text_or_empty

STATE = "struct<source:string,lang:string,tokenizer:string,tokens:bigint>"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]

#: Tokenizer versions that SQL can count.
TOKENIZERS = {
    "words/1": lambda text: F.regexp_count(text, F.lit(f"{WORD_CLASS}+")),
    "codepoints/1": lambda text: F.length(text),
    "letter-runs/2": lambda text: F.regexp_count(text, F.lit(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]")),
}


def state(tokenizer: str, tokens: Column) -> Column:
    """The state of a documents row under a tokenizer."""
    return F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), tokens.cast("bigint").alias("tokens"))


def inserts(docs: DataFrame, tokenizers: dict = TOKENIZERS, provisional: Column | None = None) -> DataFrame:
    """Changes that add every row's count; ``provisional`` stands in for counts not yet made."""
    states = [state(name, provisional if provisional is not None else count(text_or_empty())) for name, count in tokenizers.items()]
    return docs.select(F.lit(None).cast(STATE).alias("before"), F.explode(F.array(*states)).alias("after"))


def bpe_inserts(docs: DataFrame, tokenizer: str, ranks_path: str, pattern: str) -> DataFrame:
    """Changes that add every row's count of byte-level BPE tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe.encoder(ranks_path, pattern)
        for batch in batches:
            counts = pa.array([len(byte_bpe.encode_text(t.as_py().decode("utf-8", "replace"), encoding)) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), counts], ["source", "lang", "tokens"])

    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "source string, lang string, tokens long")
    return counted.select(F.lit(None).cast(STATE).alias("before"), state(tokenizer, F.col("tokens")).alias("after"))


def revisions(docs: DataFrame, old: Column, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """Changes from an old count to the true one."""
    pairs = [F.struct(state(name, old).alias("before"), state(name, count(text_or_empty())).alias("after")) for name, count in tokenizers.items()]
    return docs.select(F.explode(F.array(*pairs)).alias("change")).select("change.before", "change.after")


def deletes(docs: DataFrame, tokenizers: dict = TOKENIZERS) -> DataFrame:
    """Changes that take every row's count away."""
    return inserts(docs, tokenizers).select(F.col("after").alias("before"), F.lit(None).cast(STATE).alias("after"))


def changes_between(old: DataFrame, new: DataFrame) -> DataFrame:
    """The feed that turns one ledger (doc_id, source, lang, tokenizer, tokens) into another."""
    pack = F.struct(*KEYS, "tokens").cast(STATE)
    a = old.select(F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_t"), pack.alias("before"))
    b = new.select(F.col("doc_id").alias("_jd"), F.col("tokenizer").alias("_u"), pack.alias("after"))
    joined = a.join(b, F.col("_id").eqNullSafe(F.col("_jd")) & F.col("_t").eqNullSafe(F.col("_u")), "full")
    return joined.where(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas by key, partial sums first."""
    rows = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")))
    flat = changes.select(F.explode(rows).alias("r")).where("r.s IS NOT NULL").select("r.sign", "r.s.*")
    return flat.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("n_tokens"))


class Rollup:
    """Totals under ``path``: ``data`` holds folders of deltas, ``batch/<id>`` names a batch's folder,
    ``base/<n>`` the folder of a compaction's totals and the batches in them.

    A name counts once it is written, a single small object, so a half-written or half-copied folder
    never does, on object stores either. An empty object is a commit that did not end."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(where) if x.getLen()) if self._fs.exists(where) else []

    def _read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Write one small object; an error if another writer has finished it meanwhile."""
        where = self._path(f"{self.path}/{name}")
        empty = self._fs.exists(where) and not self._fs.getFileStatus(where).getLen()
        stream = self._fs.create(where, empty)
        stream.write(text.encode())
        stream.close()

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _base(self) -> tuple[str | None, set[str]]:
        bases = self._names("base")
        if not bases:
            return None, set()
        found = json.loads(self._read(f"base/{bases[-1]}"))
        return found["data"], set(found["batches"])

    def _listed(self) -> tuple[str | None, set[str], list[str]]:
        """One look at the folders: the base, the batches that it holds, and the batches beside it.

        Batches are listed first: one that a compaction absorbs in between is then in the newer base
        as well, and is left out of the list."""
        names = self._names("batch")
        base, absorbed = self._base()
        return base, absorbed, [b for b in names if b not in absorbed]

    def committed(self) -> set[str]:
        """The ids of all batches that count."""
        _, absorbed, batches = self._listed()
        return absorbed | set(batches)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, with nothing changed, if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if batch_id in self.committed():
            return False
        data = f"data/{batch_id}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/{data}")
        if batch_id in self.committed():
            self._drop(data)
            return False
        self._put(f"batch/{batch_id}", data)
        return True

    def totals(self, listed: tuple[str | None, set[str], list[str]] | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of what is left."""
        base, _, batches = listed or self._listed()
        paths = [f"{self.path}/{x}" for x in (*(self._read(f"batch/{b}") for b in batches), *([base] if base else []))]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        total = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return total.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold the batches committed so far into a new base, then drop their folders.

        Totals, manifest and what is dropped come from one listing, so a batch that commits meanwhile
        stays a batch. Of two compactions at a time one fails: a base's name is its number."""
        listed, name = self._listed(), f"{len(self._names('base')):08d}"
        old, absorbed, batches = listed
        data = f"data/base-{uuid.uuid4().hex}"
        self.totals(listed).write.parquet(f"{self.path}/{data}")
        folders = [self._read(f"batch/{b}") for b in batches]
        self._put(f"base/{name}", json.dumps({"data": data, "batches": sorted(absorbed | set(batches))}))
        for gone in (*(f"batch/{b}" for b in batches), *folders, *([old] if old else [])):
            self._drop(gone)


def _revised(docs: DataFrame) -> Rollup:
    """Loaded with the stated n_chars as provisional counts and revised to true counts, with replays."""
    rollup = Rollup(docs.sparkSession, fresh_path(docs.sparkSession, "token-rollup"))
    stated = F.coalesce(F.col("n_chars").cast("bigint"), F.lit(0))
    load, revise = inserts(docs, provisional=stated), revisions(docs, stated)
    rollup.commit("load-1", load)
    rollup.commit("load-1", load)
    rollup.commit("revise-1", revise)
    rollup.compact()
    rollup.commit("revise-1", revise)
    return rollup


def corpus_totals(docs: DataFrame) -> DataFrame:
    """A corpus taken through its life: loaded with the stated n_chars as provisional counts, revised
    to true counts, rid of wordless documents and given them back, with batches replayed in between."""
    rollup, wordless = _revised(docs), docs.where(~text_or_empty().rlike(WORD_CLASS))
    rollup.commit("prune-1", deletes(wordless))
    rollup.commit("prune-1", deletes(wordless))
    rollup.commit("restore-1", inserts(wordless))
    return rollup.totals()


def all_totals(docs: DataFrame, tokenizer: str, ranks_path: str, pattern: str) -> DataFrame:
    """The totals of every document, wordless ones too, with BPE tokens as one more version."""
    rollup, more = _revised(docs), bpe_inserts(docs, tokenizer, ranks_path, pattern)
    rollup.commit("bpe-1", more)
    rollup.commit("bpe-1", more)
    return rollup.totals()


ORACLE = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS t FROM documents
), c AS (
  SELECT source, lang, 'words/1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM d
  UNION ALL SELECT source, lang, 'codepoints/1', length(t) FROM d
  UNION ALL SELECT source, lang, 'letter-runs/2', len(regexp_extract_all(t, '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]')) FROM d
)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL"""
