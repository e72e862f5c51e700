"""Exact dedup through an extendible-hash index on shared files.

A text's key is the first 64 bits of the SHA-256 of its normalised bytes. Three tables in the shared
folder make the index; Spark tasks write them and commit, so a lost executor's part is made again
alone:

* the heap: a row per document, with the number (``ref``) of an equal text that its map task has met,
  and the text itself in the row that met it first. So a group of copies costs a task one text however
  large it is; a task compares bytes with the texts that it still holds, which a bound limits.
* the buckets: the owners of key ranges, cut by the leading bits, read the heap's texts and insert them
  into their part of the directory. A bucket that holds more than ``capacity`` keys splits on the next
  bit, and where its depth equals the directory's the directory doubles. Equal keys share a chain, whose
  members are told apart by comparing bytes. A row of the table is a ref with its bucket, its chain's
  member and the first ref of that member, which stands for the text.
* the directory is what the buckets' depths and prefixes say. ``probe`` makes a range's directory again
  from the stored texts, looks up the keys of further documents and lets the chains decide by bytes.

There are many ranges to a task, dealt in order, so tasks are about equally large; a task holds the
texts of one range at a time. Groups are added up by ref before text, and rows find their group by ref:
no key in a shuffle has more rows than a map task.

Defined results: null counts as the empty text, and all empty or white-space texts are equal; very
long texts are hashed and compared whole; of equal texts the row with most code points stays, on ties
the one with the smallest doc_id (null last), and of rows that repeat both one; an empty table gives
an empty result; other columns are ignored by ``exact_groups`` and carried unchanged, whatever their
names, by ``exact_dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from quire.llm.shared import SPACE, written

#: Keys a bucket may hold before it splits.
CAPACITY = 256
#: Bytes of texts that the range of an owner is meant to have.
OWNER_BYTES = 4 << 20
#: Bytes of texts that a task is meant to own, and the least ranges of a task.
TASK_BYTES, LEAST_RANGES = 64 << 20, 16
#: Bytes of texts that a map task holds to find its copies.
HELD_BYTES = 32 << 20
KEY_BITS = 64


class Bucket:
    """Keys that agree on their first ``depth`` bits; a key's chain holds its distinct bodies."""

    __slots__ = ("chains", "depth", "prefix")

    def __init__(self, depth: int, prefix: int) -> None:
        self.depth, self.prefix, self.chains = depth, prefix, {}


class Directory:
    """An extendible-hash directory over the key bits that follow ``skip`` fixed ones.

    ``hash_bits`` is the width of a key; at that depth a bucket no longer splits."""

    def __init__(self, capacity: int = CAPACITY, skip: int = 0, hash_bits: int = 64) -> None:
        self.capacity, self.skip, self.bits, self.depth = capacity, skip, hash_bits, 0
        self.slots = [Bucket(0, 0)]

    def _slot(self, key: int) -> int:
        return (key >> (self.bits - self.skip - self.depth)) & ((1 << self.depth) - 1)

    def find(self, key: int) -> Bucket:
        return self.slots[self._slot(key)]

    def lookup(self, key: int, body: bytes) -> object | None:
        """The entry of an equal body under this key."""
        return next((held for known, held in self.find(key).chains.get(key, ()) if known == body), None)

    def insert(self, key: int, body: bytes, entry: object) -> object:
        """The entry of an equal body under this key, else ``entry``, newly chained."""
        bucket = self.find(key)
        chain = bucket.chains.setdefault(key, [])
        for known, held in chain:
            if known == body:
                return held
        chain.append((body, entry))
        while len(bucket.chains) > self.capacity and self.skip + bucket.depth < self.bits:
            self._split(bucket)
            bucket = self.find(key)
        return entry

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        halves = [Bucket(bucket.depth + 1, bucket.prefix * 2 + bit) for bit in (0, 1)]
        shift = self.bits - self.skip - bucket.depth - 1
        for key, chain in bucket.chains.items():
            halves[(key >> shift) & 1].chains[key] = chain
        width = 1 << (self.depth - bucket.depth)
        first = bucket.prefix * width
        for i in range(width):
            self.slots[first + i] = halves[i >= width // 2]

    def buckets(self) -> Iterator[Bucket]:
        seen = None
        for bucket in self.slots:
            if bucket is not seen:
                seen = bucket
                yield bucket


def normalised(data: bytes) -> bytes:
    return data.translate(None, SPACE)


def _key(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - bits)


class _Held:
    """The texts that a map task still holds, by key, with their numbers."""

    def __init__(self, bits: int, most: int) -> None:
        self.bits, self.most, self.size, self.texts = bits, most, 0, {}

    def ref(self, body: bytes, new: int) -> tuple[int, int, bool]:
        """The key, the number of an equal text or else ``new``, and whether it is new."""
        key = _key(hashlib.sha256(body).digest(), self.bits)
        for known, number in self.texts.get(key, ()):
            if known == body:
                return key, number, False
        if self.size > self.most:
            self.texts.clear()
            self.size = 0
        self.texts.setdefault(key, []).append((body, new))
        self.size += len(body)
        return key, new, True


def make_heap(docs: DataFrame, columns: list[str], key_bits: int = KEY_BITS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The heap of documents with these columns, named c0, c1, ..., which hold doc_id and text.

    Beside them: rid (a number of the row), n (code points), key, ref, size and ``text``, the bytes of
    the original text in the first row of a ref, else null. A text among the columns is stored once."""
    at = columns.index("text") if "text" in columns else None
    kept = docs.select(*[(F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = kept.withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    names = [f"c{i}" for i in range(len(columns))]
    source = rows.select(*names, "id", "n", *([] if at is not None else ["text"]))
    from_ = names[at] if at is not None else "text"
    made = [StructField(c, LongType()) for c in ("rid", "key", "ref", "size")] + [StructField("text", BinaryType()) if at is None else StructField("new", BooleanType())]
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema if f.name in (*names, "id", "n")] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rid = _Held(key_bits, held_bytes), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for value in batch.column(from_):
                data = value.as_buffer()
                data = b"" if data is None else data.to_pybytes()
                body = normalised(data)
                key, ref, new = held.ref(body, rid)
                for column, x in zip(out, (rid, key - (1 << 64) if key >> 63 else key, ref, len(data), new if at is not None else data if new else None), strict=True):
                    column.append(x)
                rid += 1
            same = [batch.column(c) for c in (*names, "id", "n")]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary() if at is None else pa.bool_()), strict=True))], schema.names)

    heap = written(source.mapInArrow(run, schema), "exact-heap")
    return heap if at is None else heap.withColumn("text", F.when(F.col("new"), F.coalesce(from_, F.lit("")).cast("binary")))


_BUCKETS = "ref long, text_ref long, owner long, bucket_depth int, bucket long, key long, chain int, digest binary"
_BUCKET_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


class _Text:
    """What a chain holds beside a text's bytes: the refs that have it, and its place."""

    __slots__ = ("chain", "depth", "digest", "prefix", "refs")

    def __init__(self, digest: bytes) -> None:
        self.digest, self.refs = digest, []


@dataclass
class Index:
    """The stored index: the heap, the buckets' table and how keys are cut into ranges."""

    heap: DataFrame
    buckets: DataFrame
    depth: int
    parts: int
    capacity: int
    key_bits: int

    def owner(self) -> Column:
        """The range of a key: its leading ``depth`` bits."""
        return F.shiftrightunsigned("key", self.key_bits - self.depth) if self.depth else F.lit(0).cast("long")

    def dealt(self, texts: DataFrame) -> DataFrame:
        """Rows (ref, key, probing, text) dealt to owners in key order, a range's stored texts first."""
        rows = texts.select("ref", "key", "probing", "text", self.owner().alias("owner"))
        part = F.shiftright(F.col("owner") * self.parts, self.depth).cast("int")
        return rows.repartitionById(self.parts, part).sortWithinPartitions("owner", "probing", "ref")

    def owned(self, texts: DataFrame) -> DataFrame:
        """The work of the owners: stored texts are inserted; of those that probe, the refs are added to
        an equal stored text's, if there is one. A row for each ref that has a text."""
        depth, capacity, bits = self.depth, self.capacity, self.key_bits

        def range_rows(owner: int, directory: Directory) -> list[tuple]:
            out = []
            for bucket in directory.buckets():
                for key, chain in bucket.chains.items():
                    for place, (_, text) in enumerate(chain):
                        known = text.refs[0]
                        out += [(ref, known, owner, depth + bucket.depth, bucket.prefix, key - (1 << 64) if key >> 63 else key, place, text.digest) for ref in text.refs]
            return out

        def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 10_000):
                columns = zip(*rows[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _BUCKET_TYPES, strict=True)], [x.split()[0] for x in _BUCKETS.split(", ")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, directory = None, Directory(capacity, depth, bits)
            for batch in batches:
                for ref, key, probing, data, owner in zip(*(batch.column(c) for c in ("ref", "key", "probing", "text", "owner")), strict=True):
                    if owner.as_py() != now:
                        yield from batches_of(range_rows(now, directory))
                        now, directory = owner.as_py(), Directory(capacity, depth, bits)
                    body, number = normalised(data.as_py()), key.as_py() & (1 << bits) - 1
                    if probing.as_py():
                        text = directory.lookup(number, body)
                    else:
                        text = directory.insert(number, body, _Text(hashlib.sha256(body).digest()))
                    if text is not None:
                        text.refs.append(ref.as_py())
            yield from batches_of(range_rows(now, directory))

        return self.dealt(texts).mapInArrow(run, _BUCKETS)


def _texts(heap: DataFrame, probing: bool) -> DataFrame:
    return heap.where("text IS NOT NULL").select("ref", "key", F.lit(probing).alias("probing"), "text")


def build_index(heap: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES, key_bits: int = KEY_BITS) -> Index:
    """The index of a heap, its buckets written to the shared folder."""
    total = heap.where("text IS NOT NULL").agg(F.sum("size")).first()[0] or 0
    parts = max(int(heap.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    ranges = max(-(-total // owner_bytes), LEAST_RANGES * parts)
    depth = min((ranges - 1).bit_length(), key_bits)
    index = Index(heap, heap, depth, min(parts, 1 << depth), capacity, key_bits)
    index.buckets = written(index.owned(_texts(heap, False)), "exact-buckets")
    return index


def probe(index: Index, docs: DataFrame) -> DataFrame:
    """doc_id, and for further documents whose text the index has, the ref that stands for it."""
    heap = make_heap(docs.select("doc_id", "text"), [], index.key_bits)
    new = heap.select("rid", F.col("id").alias("doc_id"), F.col("ref").alias("own"))
    # Refs of the probes are told from stored ones by their sign.
    probes = _texts(heap, True).withColumn("ref", -1 - F.col("ref"))
    found = index.owned(_texts(index.heap, False).unionByName(probes)).where("ref < 0").select((-1 - F.col("ref")).alias("own"), "text_ref")
    return new.join(found, "own", "left").select("doc_id", "text_ref")


def _groups(index: Index) -> DataFrame:
    """text_ref, with the row that stays (first_rid, keep_id) and the number of rows."""
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "rid")
    by_ref = index.heap.groupBy("ref").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    found = by_ref.join(index.buckets.select("ref", "text_ref"), "ref").groupBy("text_ref").agg(F.min("best").alias("best"), F.sum("rows").alias("group_size"))
    return found.select("text_ref", F.col("best.rid").alias("first_rid"), F.col("best.id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, owner_bytes: int = OWNER_BYTES, key_bits: int = KEY_BITS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket_depth, chain."""
    index = build_index(make_heap(docs, [], key_bits, held_bytes), capacity, owner_bytes, key_bits)
    facts = index.buckets.select("ref", "text_ref", "digest", "bucket_depth", "chain").join(_groups(index), "text_ref").drop("text_ref")
    found = index.heap.select("rid", "id", "ref").join(facts, "ref")
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("first_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "bucket_depth",
        "chain",
    )


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents without copies, all their columns unchanged."""
    index = build_index(make_heap(docs, docs.columns), capacity)
    rows = index.heap.select("rid", *[f"c{i}" for i in range(len(docs.columns))])
    stay = _groups(index).select(F.col("first_rid").alias("rid"))
    return rows.join(stay, "rid", "left_semi").drop("rid").toDF(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT h, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY h
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)"""
