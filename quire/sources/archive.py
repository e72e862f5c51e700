"""Archives as tables: directory archives, and block archives whose names are inferred.

``entries_of`` reads the directory of one archive through a function that gives byte ranges. Two ways
lead to it: ``archives`` takes whole files from any store that Spark reads (up to 2 GiB each) and cuts
their entries out in the same scan, without a shuffle; the data source ``archive`` takes files on a mounted
file system, reads directories only and then byte ranges, so that one archive becomes many
partitions. Both test names before any payload is read or decoded. Archives are told apart by their
paths, as two folders may hold archives of one name."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quire.functions.binary import sniffed, starts
from quire.functions.decode import BLOCK_MAGIC, BadReference, decoded, parse_block
from quire.functions.text import extension

# Fixed values of the formats: magics, the directory's start and the width of its entries.
DIRECTORY_MAGIC, BLOCKS_MAGIC = b"BAY POD\x02", b"POD BAY\x01"
DIRECTORY_AT, ENTRY_SIZE = 16, 16

ENTRY = "path string, arc string, entry_index int, filename string, data_offset bigint, size bigint"
ARC_NAME = "^(.*/)?([^/]*?)(\\.[^./]*)?$"
#: Of more archives than these, small ones share a range.
FEW_ARCHIVES = 64
#: Bytes of a batch of entries.
BATCH_BYTES = 16 << 20

#: ``size`` bytes of an archive from an offset on.
Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Entry:
    """One entry: its place in the directory, its name, where it lies."""

    index: int
    name: str
    offset: int
    size: int


def archive_name(path: Column) -> Column:
    return F.regexp_extract(path, ARC_NAME, 2)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, arc, content, archive_size) of the archives under a path, by name in any case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[aA][rR][cC]").option("recursiveFileLookup", "true").load(path)
    return files.select("path", archive_name(F.col("path")).alias("arc"), "content", F.col("length").alias("archive_size"))


def container_kind(content: Column) -> Column:
    """``directory``, ``blocks`` or ``unknown`` by the magic."""
    return F.when(starts(content, DIRECTORY_MAGIC), "directory").when(starts(content, BLOCKS_MAGIC), "blocks").otherwise("unknown")


def _number(data: bytes, at: int, width: int) -> int:
    return int.from_bytes(data[at : at + width], "little")


def directory_entries(read: Read, total: int) -> list[Entry]:
    """Entries of a directory archive; names that are not ASCII get a number.

    Sizes are stored modulo 65,536: one is the gap to the next offset where that differs from it by a
    multiple of 65,536. Entries without an offset keep theirs."""
    head = read(0, DIRECTORY_AT)
    table = read(DIRECTORY_AT, _number(head, 9, 3) * ENTRY_SIZE)
    names = read(DIRECTORY_AT + _number(head, 9, 3) * ENTRY_SIZE + 1, max(_number(head, 13, 3), 1 << 16))
    rows = [table[i : i + ENTRY_SIZE] for i in range(0, len(table) - ENTRY_SIZE + 1, ENTRY_SIZE)]
    offsets = sorted((_number(row, 9, 4), i) for i, row in enumerate(rows) if any(row[9:13]))
    ends = {i: end for (_, i), end in zip(offsets, [*(at for at, _ in offsets[1:]), total], strict=False)}
    out = []
    for i, row in enumerate(rows):
        at, stored, name_at = _number(row, 9, 4), _number(row, 13, 2), _number(row, 1, 3)
        name, gap = names[name_at : name_at + row[5]], ends.get(i, at) - at
        size = gap if gap > stored and (gap - stored) % 65536 == 0 else stored
        out.append(Entry(i, name.decode("ascii") if name.isascii() else f"file_{i:05d}", at, size))
    return out


@dataclass
class Block:
    """One block of a block archive: where it lies and what it decodes to."""

    index: int
    start: int
    size: int
    payload: bytes | None


def scan_blocks(data: bytes) -> list[Block]:
    """Every place where the block magic stands, up to the next or the end."""
    found = [m.start() for m in re.finditer(b"(?=%s)" % re.escape(BLOCK_MAGIC), data)]
    out = []
    for i, (start, end) in enumerate(zip(found, [*found[1:], len(data)], strict=True)):
        raw = data[start:end]
        try:
            parsed = parse_block(raw)
            payload = parsed[0] if parsed else None
        except BadReference:
            payload = raw[11:] or raw
        out.append(Block(i, start, end - start, payload))
    return out


def named_blocks(arc: str, blocks: list[Block]) -> list[Entry]:
    """Blocks with inferred names, without empty ones and work-unit descriptions.

    The last work unit that names a file names the largest page (the first of equally large ones);
    other pages are numbered, style sheets derive from it, everything else is numbered by type."""
    kinds = {b.index: sniffed(b.payload) for b in blocks if b.payload}
    units = [re.search(rb"(?i)<filename>([^<]+)</filename>", b.payload) for b in blocks if b.payload and kinds[b.index] == ".xml"]
    main = next((name for m in reversed(units) if m and (name := m[1].decode("ascii", "replace").strip())), None)
    pages = [b for b in blocks if kinds.get(b.index) == ".htm"]
    largest = max(pages, key=lambda b: len(b.payload), default=None)
    stem, base, count, out = os.path.splitext(main)[0] if main else arc.lower(), arc.lower(), {}, []
    for b in blocks:
        kind = kinds.get(b.index)
        if kind in (None, ".xml"):
            continue
        n = count[kind] = count.get(kind, 0) + 1
        names = {".htm": main if main and b is largest else f"{stem}_{n}.htm", ".wcf": f"{base}.wcf", ".css": f"{stem}s.htm"}
        out.append(Entry(b.index, names.get(kind, f"{base}_{n}{kind}"), b.start, b.size))
    return out


def entries_of(arc: str, read: Read, total: int) -> list[Entry]:
    """The entries of one archive; unknown containers have none. Of a directory archive no payload is
    read; a block archive has to be read whole, as its names lie in it."""
    magic = read(0, 8)
    if magic == BLOCKS_MAGIC:
        return named_blocks(arc, scan_blocks(read(0, total)))
    return directory_entries(read, total) if magic == DIRECTORY_MAGIC else []


def _has(extensions: list[str] | None, name: str) -> bool:
    """Whether a name has one of the extensions, in any case; all have if none are given."""
    return not extensions or os.path.splitext(name)[1].lower() in extensions


def _from_files(files: DataFrame, extensions: list[str] | None, payload: bool) -> DataFrame:
    """Entries, cut out of the files' content in the scan; batches are bounded by bytes."""
    schema = pa.schema([("path", pa.string()), ("arc", pa.string()), ("entry_index", pa.int32()), ("filename", pa.string()), ("data_offset", pa.int64()), ("size", pa.int64())] + [("raw", pa.binary())] * payload)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, arc, value in zip(batch.column("path").to_pylist(), batch.column("arc").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(value.as_buffer() or b"")
                for e in entries_of(arc, lambda at, n, data=data: bytes(data[at : at + n]), len(data)):
                    row = (path, arc, e.index, e.name, e.offset, e.size)
                    if not _has(extensions, e.name):
                        continue
                    if payload:
                        raw = bytes(data[e.offset : e.offset + e.size]) if e.offset else b""
                        if not raw:
                            continue
                        row, held = (*row, raw), held + len(raw)
                    rows.append(row)
                    if held > BATCH_BYTES or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    known = files.where(container_kind(F.col("content")) != "unknown").select("path", "arc", "content")
    return known.mapInArrow(run, ENTRY + (", raw binary" if payload else ""))


def list_entries(files: DataFrame) -> DataFrame:
    """Entries of all archives without payloads; unknown containers have none."""
    return _from_files(files, None, False)


def skipped_archives(files: DataFrame) -> DataFrame:
    """(path, arc, magic) of files that are no known container."""
    return files.where(container_kind(F.col("content")) == "unknown").select("path", "arc", F.hex(F.substring("content", 1, 8)).alias("magic"))


def wanted_extensions(values: list[str] | str | None, default: tuple[str, ...] = ()) -> list[str]:
    """Suffixes in lower case with a leading dot; nothing given means the default."""
    items = values.split(",") if isinstance(values, str) else values or []
    found = {v if v.startswith(".") else f".{v}" for v in (i.strip().lower() for i in items) if v}
    return sorted(found or set(default))


def with_raw(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Entries with their raw bytes; those without offset, size or bytes are left out.

    Extensions are tested on the directory, before any bytes are cut out."""
    return _from_files(files, extensions, True)


def read_raw(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """The same of all archives under a path: by the data source, which reads only the entries with
    these extensions, where the path is mounted, else from whole files."""
    mounted = path.removeprefix("file://")
    if not os.path.exists(mounted):
        return with_raw(archives(spark, path), extensions)
    register(spark)
    source = spark.read.format("archive").option("payload", "true").option("extensions", ",".join(extensions or ()))
    return source.load(mounted).where(F.octet_length("raw") > 0)


def extracted(raw: DataFrame) -> DataFrame:
    """Raw entries with decoded payloads; of entries with the same name in an archive the last stays."""
    from quire.operators.ordered import last_wins

    rows = decoded(raw).where("error IS NOT NULL OR octet_length(payload) > 0")
    return last_wins(rows, ["path", "filename"], ["entry_index"])


def extract(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Entries of archives with decoded payloads."""
    return extracted(with_raw(files, extensions))


def extract_totals(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """n_files, n_skipped and n_bytes per archive and, with nulls for path and arc, over all."""
    entries = list_entries(files).select("path", "arc", "entry_index")
    rows = decoded(with_raw(files, extensions)).where("octet_length(payload) > 0").select("path", "entry_index", F.octet_length("payload").alias("n"))
    both = entries.join(rows, ["path", "entry_index"], "left").groupBy("path", "arc")
    counts = both.agg(F.count_if(F.col("n").isNotNull()).alias("n_files"), F.count_if(F.col("n").isNull()).alias("n_skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_files", "n_skipped", "n_bytes")]
    return counts.unionByName(counts.agg(*sums), allowMissingColumns=True)


def extension_histogram(entries: DataFrame) -> DataFrame:
    return entries.groupBy(extension(F.col("filename")).alias("ext")).agg(F.count(F.lit(1)).alias("n_files"))


class _Range(InputPartition):
    """Entries of one archive or, of small ones, of several."""

    def __init__(self, parts: list[tuple[str, list[Entry]]]) -> None:
        self.parts = parts

    @property
    def entries(self) -> list[Entry]:
        return [e for _, entries in self.parts for e in entries]


def _arc_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def file_entries(path: str) -> list[Entry]:
    """The entries of an archive on a mounted file system."""
    with open(path, "rb") as file:

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(n)

        return entries_of(_arc_of(path), read, os.path.getsize(path))


class ArchiveReader(DataSourceReader):
    """Plans byte ranges of the entries that filters on extension, name and archive leave."""

    def __init__(self, path: str, payload: bool, range_bytes: int, extensions: list[str]) -> None:
        self.path, self.payload, self.range_bytes, self.extensions = path, payload, range_bytes, extensions
        self.names: set[str] | None = None
        self.arcs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("filename",), ("arc",)):
                held = "names" if f.attribute == ("filename",) else "arcs"
                known = getattr(self, held)
                setattr(self, held, values if known is None else known & values)
            else:
                yield f

    def _files(self) -> list[str]:
        if os.path.isfile(self.path):
            return [self.path]
        return sorted(os.path.join(d, f) for d, _, names in os.walk(self.path) for f in names if f.lower().endswith(".arc"))

    def partitions(self) -> list[InputPartition]:
        """Ranges of at most ``range_bytes`` and an entry. An archive's end closes one; where archives are
        many, only from a quarter of that on."""
        out: list[InputPartition] = []
        parts, size, files = [], 0, self._files()
        least = self.range_bytes // 4 if len(files) > FEW_ARCHIVES else 0
        for path in files:
            if self.arcs is not None and _arc_of(path) not in self.arcs:
                continue
            held = []
            for e in file_entries(path):
                if (self.names is not None and e.name not in self.names) or not _has(self.extensions, e.name):
                    continue
                held.append(e)
                size += e.size
                if size >= self.range_bytes:
                    out.append(_Range([*parts, (path, held)]))
                    parts, held, size = [], [], 0
            if held:
                parts.append((path, held))
            if parts and size >= least:
                out.append(_Range(parts))
                parts, size = [], 0
        return [*out, _Range(parts)] if parts else out

    def read(self, partition: _Range) -> Iterator[tuple]:
        for path, entries in partition.parts:
            with open(path, "rb") as file:
                for e in entries:
                    row = (path, _arc_of(path), e.index, e.name, e.offset, e.size)
                    if self.payload:
                        file.seek(e.offset)
                        row += (file.read(e.size) if e.offset and e.size else b"",)
                    yield row


class ArchiveSource(DataSource):
    """``spark.read.format("archive").option("payload", "true").option("extensions", ".htm").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def _payload(self) -> bool:
        return str(self.options.get("payload", "false")).lower() == "true"

    def schema(self) -> str:
        return ENTRY + (", raw binary" if self._payload() else "")

    def reader(self, schema: object) -> ArchiveReader:
        extensions = wanted_extensions(self.options.get("extensions", ""))
        return ArchiveReader(self.options["path"], self._payload(), int(self.options.get("rangeBytes", 32 << 20)), extensions)


def register(spark: SparkSession) -> None:
    """Make the format known and let its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
