"""WARC: write captures as archives, read them back, assemble transactions.

``write_archives`` turns pages into a request, a response or revisit, and a metadata record each.
Every record is a gzip member of its own, as readers that seek expect, and archives begin with a
warcinfo record. Spark's text writer stores them, so archives go to any file system Spark knows and a
failed task leaves no half file: a row is a whole archive of about ``archive_bytes``, and a file has one
row. The writer ends a row with a separator, which can't be empty: it is the last byte of the last
member, the highest of its length and so zero below 16 MiB (a longer record is followed by an empty
member, whose length is zero). ``read_records`` parses archives record by record out of a streaming
decompressor; bodies are delimited by Content-Length alone, so HTML that contains record headers
does no harm.
``assemble`` joins the records of a capture through WARC-Concurrent-To, which may point either way
and, for one more step, through another record of the capture; it gives one nested row per capture.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a
response and the others revisit it. Equal payloads may be a third of all pages: the lookups of a
digest and of a revisited record are salted (``with_hot_key``).

Defined results: a null html is an empty payload; very long pages are stored whole, in an archive that
is larger by as much; a null url becomes ``urn:unknown``; a null page_id counts as larger than any; on
ties, a row that repeats page_id and payload is a further capture, which revisits the first if the
payload is long enough; an empty table gives no archives and an empty result; columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import fresh_path, path_of, with_hot_key, written

LEAST_PAYLOAD = 100
#: Compressed bytes after which an archive ends.
ARCHIVE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(_ID_SPACE, '/'.join(map(str, parts)))}"


def _one_line(text: str) -> str:
    return "".join("%%%02X" % ord(c) if ord(c) <= 32 or ord(c) == 127 else c for c in text)


def capture_records(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, first_id: int | None, first_url: str | None, revisit: bool) -> list[bytes]:
    """The three records of one capture."""
    uri = _one_line(url) if url else "urn:unknown"
    main = _urn(page_id, copy, digest)
    host = uri.split("://", 1)[-1].split("/", 1)[0]
    get = f"GET {uri} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(first_id, 1, digest)}>"), ("WARC-Refers-To-Date", DATE)]
        about += [("WARC-Refers-To-Target-URI", _one_line(first_url) if first_url else "urn:unknown")]
    request = _urn(page_id, copy, digest, "request")
    fields = f"page-id: {'' if page_id is None else page_id}\r\n".encode()
    return [
        _record("request", request, [("WARC-Target-URI", uri), ("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/http; msgtype=request")], get),
        _record("revisit" if revisit else "response", main, about, http if revisit else http + payload),
        _record("metadata", _urn(page_id, copy, digest, "metadata"), [("WARC-Concurrent-To", f"<{request}>"), ("Content-Type", "application/warc-fields")], fields),
    ]


def _member(record: bytes) -> bytes:
    """A record as a gzip member, ending in a zero byte."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(record) + squeeze.flush()
    return out if out[-1] == 0 else out + _member(b"")


def _info(name: str) -> bytes:
    return _record("warcinfo", _urn("warcinfo", name), [("Content-Type", "application/warc-fields")], b"software: quire\r\nformat: WARC File Format 1.1\r\n")


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and ``_k``, a key of page_id and payload that is never null: the digest's
    32 bytes, then the page_id's digits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("_k", F.concat(F.unhex(F.sha2("payload", 256)), F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")))


def decide(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """For each page_id and payload (``_k``): first_id, whether its first copy revisits, and later ones."""
    seen = _keyed(pages).select("_k", "page_id", "url", (F.octet_length("payload") >= least).alias("long_enough"))
    seen = written(seen, "warc-digests").withColumn("digest", F.substring("_k", 1, 32))
    # The first row of a digest by page_id; of rows that repeat it, the first url (as copies are numbered).
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    firsts = seen.where("long_enough").groupBy("digest").agg(F.min(order).alias("_first"))
    found = with_hot_key(seen.drop("url").distinct(), firsts, ["digest"], "_k")
    main = F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return found.select("_k", F.col("_first.page_id").alias("first_id"), F.col("_first.url").alias("first_url"), (F.col("long_enough") & ~main).alias("revisit"), F.col("long_enough").alias("again"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of all pages under ``path`` as ``part-*.warc.gz``.

    The payloads are shuffled once: the join and the count of copies share the key."""
    joined = _keyed(pages).join(decide(pages, least), "_k")
    copy = F.row_number().over(Window.partitionBy("_k").orderBy("url"))
    revisit = F.when(F.col("copy") == 1, F.col("revisit")).otherwise(F.col("again"))
    rows = joined.withColumn("copy", copy).select("page_id", "copy", "url", "payload", F.lower(F.hex(F.substring("_k", 1, 32))).alias("digest"), "first_id", "first_url", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [column[i].as_py() for column in batch.columns]
                if not members:
                    members = [_member(_info(f"{row[0]}/{row[1]}/{row[4]}"))]
                members += map(_member, capture_records(*row))
                size += sum(map(len, members[-3:]))
                if size >= archive_bytes:
                    yield archive()
                    members, size = [], 0
        if members:
            yield archive()

    archives = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)
    where, system = path_of(pages.sparkSession, path)
    for file in system.listStatus(where):
        name = file.getPath().getName()
        if name.endswith(".txt"):
            if not file.getLen():
                system.delete(file.getPath(), False)
            else:
                system.rename(file.getPath(), path_of(pages.sparkSession, f"{path}/{name[:-4]}.warc.gz")[0])


class _Stream:
    """Lines and runs of bytes out of archive bytes, decompressed as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 18) -> None:
        self.data, self.at, self.step, self.held, self.from_ = data, 0, step, bytearray(), 0
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.from_ > self.step:
            del self.held[: self.from_]
            self.from_ = 0
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.step]
        self.at += len(part)
        while part:
            if self.gz is None:
                self.held += part
                break
            self.held += self.gz.decompress(part)
            part = self.gz.unused_data
            if part:
                self.gz = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n", self.from_)) < 0:
            if not self._more():
                return None
        found = bytes(self.held[self.from_ : end])
        self.from_ = end + 2
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.from_ < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        found = bytes(self.held[self.from_ : self.from_ + n])
        self.from_ += n
        return found


def parse(data: bytes) -> Iterator[tuple[str, str, dict[str, list[str]], bytes]]:
    """(type, record id, headers, block) of each record of one archive."""
    stream = _Stream(data)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        headers: dict[str, list[str]] = {}
        last = None
        while line := stream.line():
            if line[:1] in b" \t" and last:
                headers[last][-1] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers.setdefault(last, []).append(value.strip())
        block = stream.take(int(headers["content-length"][0]))
        yield headers["warc-type"][0].lower(), headers["warc-record-id"][0].strip("<>"), headers, block


_RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_bytes long, fields string, payload binary"


def _record_row(kind: str, record_id: str, headers: dict[str, list[str]], block: bytes) -> tuple:
    first = lambda name: (headers.get(name) or [None])[0]
    refers, payload, size, fields = first("warc-refers-to"), None, None, None
    digest = (first("warc-payload-digest") or "").partition(":")[2].lower() or None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, size, digest = body, len(body), hashlib.sha256(body).hexdigest()
        else:
            lengths = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(lengths[0]) if lengths else None
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    to = [x.strip("<>") for x in headers.get("warc-concurrent-to", [])]
    return kind, record_id, to, refers.strip("<>") if refers else None, first("warc-target-uri"), digest, size, fields, payload


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record; a response's digest and length are computed from its bytes.

    ``payloads=False`` leaves the bytes themselves out, where only their digests are wanted."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_RECORD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for record in parse(content.as_py()):
                    row = _record_row(*record)
                    rows.append(row if payloads else (*row[:-1], None))
                    held += len(record[3])
                    if len(rows) >= 3000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its id, type, and request, response and metadata as nested columns."""
    edges = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    edges = edges.union(edges.select("b", "a"))
    mains = records.where("type IN ('response', 'revisit')")
    ids = mains.select(F.col("record_id").alias("b"), F.col("record_id").alias("capture"))
    edges = written(edges.join(ids, "b", "left"), "warc-edges")
    near = edges.where("capture IS NOT NULL").select("a", "capture")
    far = edges.where("capture IS NULL").select("a", "b").join(near.withColumnRenamed("a", "b"), "b").select("a", "capture")
    steps = near.select("a", F.struct(F.lit(1).alias("steps"), "capture").alias("to")).union(far.select("a", F.struct(F.lit(2).alias("steps"), "capture").alias("to")))
    member = steps.groupBy("a").agg(F.min("to")["capture"].alias("capture"))
    parts = records.where("type IN ('request', 'metadata')").select("record_id", "type", "target_uri", "fields")
    parts = parts.join(member, parts.record_id == member.a)
    pick = lambda kind, *columns: F.min(F.when(F.col("type") == kind, F.struct(*columns))).alias(kind)
    about = parts.groupBy("capture").agg(pick("request", "record_id", "target_uri"), pick("metadata", "record_id", "fields"))
    main = mains.select(F.col("record_id").alias("capture"), "type", F.struct("record_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload").alias("response"))
    return main.join(about, "capture", "left")


def page_captures(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write all pages, read the archives back, and give each page's capture as stored."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least)
    records = written(read_records(spark, path, payloads=False), "warc-records")
    where, system = path_of(spark, path)
    system.delete(where, True)
    page = F.regexp_extract("metadata.fields", r"(?m)^page-id: (-?\d+)", 1)
    page = page.try_cast("long")
    captures = assemble(records).select("capture", page.alias("page_id"), F.col("type").alias("record_type"), "response.payload_bytes", "response.payload_digest", F.col("response.refers_to").alias("_ref"))
    captures = written(captures, "warc-captures")
    targets = captures.where("record_type = 'response'").select(F.col("capture").alias("_ref"), F.col("page_id").alias("refers_to"))
    revisits = with_hot_key(captures.where("record_type = 'revisit'"), targets, ["_ref"], "capture")
    both = captures.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {LEAST_PAYLOAD} GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> coalesce(first_id, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> coalesce(first_id, page_id) THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
