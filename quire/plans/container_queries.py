"""Queries of containers, decoding, page repairs, reports and sinks over data made of the driver tables.

Archives, blocks and pages are laid out by SQL functions from whole tables, and the library reads them;
the SQL beside each query says what has to come out, from the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import decode, html
from quire.functions.text import let
from quire.operators import chunking, corpora, indexes, lookup, scoring
from quire.plans.registry import Registry, dealt, table
from quire.plans.scratch import scratch_path
from quire.sources import archive, sinks

REGISTRY = Registry()
MAGIC = decode.BLOCK_MAGIC.hex().upper()

#: Bytes of a chunk before encoding, by form: as they are, as runs, as copies.
PLAIN_BYTES, RUN_BYTES, COPY_BYTES = 16384, 8000, 12000


def low_first(value: Column, width: int) -> Column:
    """Hex digits of an integer's bytes, lowest first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)])


def chunks_of(digits: Column, n_bytes: int) -> Column:
    """Hex digits cut into pieces of so many bytes; none of nothing."""
    count = F.ceil(F.length(digits) / (2 * n_bytes)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(digits, i * 2 * n_bytes + 1, F.lit(2 * n_bytes)))
    return F.when(count > 0, pieces).otherwise(F.array().cast("array<string>"))


def block(digits: Column, n_bytes: int, encoded=None) -> Column:
    """A block of hex digits: a magic, chunks with signed sizes, an end mark. Without an encoding the
    chunks are raw, which a negative size says."""

    def framed(data: Column) -> Column:
        size = (F.length(data) / 2).cast("long")
        return F.concat(low_first(size if encoded else 65536 - size, 2), data)

    def chunk(piece: Column) -> Column:
        return let(encoded(piece), framed) if encoded else framed(piece)

    return F.concat(F.lit(MAGIC), F.array_join(F.transform(chunks_of(digits, n_bytes), chunk), ""), F.lit("0000"))


def as_runs(digits: Column) -> Column:
    """Each byte as a run of three, sixteen to a control word; one match takes all of a full word."""
    names = "abcdefghijklmnop"
    whole = F.length(digits) - F.length(digits) % 32
    full = F.regexp_replace(F.substring(digits, F.lit(1), whole), "".join(f"(?<{n}>..)" for n in names), "FFFF" + "".join(f"00${{{n}}}" for n in names))
    rest = F.substring(digits, whole + 1, F.lit(32))
    return F.concat(full, F.regexp_replace(F.regexp_replace(rest, "(..)", "00$1"), "(.{1,64})", "FFFF$1"))


def as_copies(digits: Column) -> Column:
    """Each three bytes and a copy of them, four times to a control word: digits of twelve bytes or more times that."""
    return F.regexp_replace(digits, "(.{6})" * 4, "1111$13000$23000$33000$43000")


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, arc, name and raw bytes (hex) of documents as archive entries, in four forms."""
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    digits, form = F.hex(text.cast("binary")), F.col("doc_id") % 4
    padded = F.concat(digits, F.repeat(F.lit("20"), ((12 - F.octet_length(text) % 12) % 12).cast("int")))
    raw = F.when(form == 0, digits).when(form == 1, block(digits, PLAIN_BYTES)).when(form == 2, block(digits, RUN_BYTES, as_runs)).otherwise(block(padded_if(text, padded), COPY_BYTES, as_copies))
    ext = F.element_at(F.array(F.lit(".TXT"), F.lit(".htm"), F.lit(".GIF")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 50 == 0, F.unhex(F.lit("E9"))).otherwise(F.concat(F.lit("D"), key, ext).cast("binary"))
    arc = F.concat(F.lit("A"), F.floor(F.col("doc_id") / 100).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", arc.alias("arc"), F.hex(name).alias("name"), raw.alias("raw"))


def padded_if(text: Column, padded: Column) -> Column:
    """An empty text stays empty."""
    return F.when(text == "", "").otherwise(padded)


def document_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory archives of all documents, a hundred doc_ids in each."""
    order, whole = Window.partitionBy("arc").orderBy("doc_id"), Window.partitionBy("arc")
    size, name_size = (F.length("raw") / 2).cast("long"), (F.length("name") / 2).cast("long")
    rows = document_entries(spark, sf_dir).withColumns({"size": size, "name_size": name_size, "i": F.row_number().over(order), "n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumns({"names": F.sum("name_size").over(whole), "name_at": F.sum("name_size").over(order) - F.col("name_size"), "before": F.sum("size").over(order) - F.col("size")})
    at = 17 + 16 * F.col("n") + F.col("names") + F.col("before")
    entry = F.concat(F.lit("00"), low_first(F.col("name_at"), 3), F.lit("00"), low_first(F.col("name_size"), 1), F.lit("000000"), low_first(at, 4), low_first(F.col("size") % 65536, 2), F.lit("00"))
    made = rows.groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("i", entry.alias("entry"), "name", "raw"))).alias("es"), F.max("n").alias("n"), F.max("names").alias("names"))
    joined = lambda field: F.array_join(F.transform("es", lambda e: e[field]), "")
    content = F.concat(F.lit(archive.DIRECTORY_MAGIC.hex()), F.lit("00"), low_first(F.col("n"), 3), F.lit("00"), low_first(F.col("names"), 3), joined("entry"), F.lit("00"), joined("name"), joined("raw"))
    return as_files(made.select("arc", F.unhex(content).alias("content")))


def as_files(rows: DataFrame) -> DataFrame:
    """(arc, content) in the shape of ``archives``."""
    return rows.select(F.concat(F.lit("/made/"), "arc", F.lit(".arc")).alias("path"), "arc", "content", F.octet_length("content").cast("long").alias("archive_size"))


ENTRIES = f"""
raws AS (
  SELECT doc_id, 'A' || (doc_id // 100) AS arc, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS len, doc_id % 4 AS form,
    CASE WHEN doc_id % 50 = 0 THEN 1 ELSE length('D' || doc_id) + 4 END AS name_size
  FROM documents
), sized AS (
  SELECT *, CASE WHEN len = 0 THEN 0 ELSE len + (12 - len % 12) % 12 END AS padded, CASE form WHEN 0 THEN len WHEN 1 THEN 11 + len + 2 * ceil(len / {PLAIN_BYTES})::BIGINT
    WHEN 2 THEN 11 + 2 * ceil(len / {RUN_BYTES})::BIGINT + 2 * len + 2 * ceil(len / 16)::BIGINT END AS size_ FROM raws
), whole AS (
  SELECT *, coalesce(size_, 11 + 2 * ceil(padded / {COPY_BYTES})::BIGINT + padded // 12 * 22)::BIGINT AS size FROM sized
), entries AS (
  SELECT doc_id, arc, t, h, len, padded, form, size, (row_number() OVER w - 1)::INTEGER AS entry_index,
    (17 + 16 * count(*) OVER (PARTITION BY arc) + sum(name_size) OVER (PARTITION BY arc) + sum(size) OVER w - size)::BIGINT AS data_offset
  FROM whole WINDOW w AS (PARTITION BY arc ORDER BY doc_id)
), named AS (
  SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'file_' || lpad(entry_index::VARCHAR, 5, '0') ELSE 'D' || doc_id || ['.TXT', '.htm', '.GIF'][doc_id % 3 + 1] END AS filename FROM entries
), payloads AS (
  SELECT *, CASE WHEN form > 0 AND len = 0 THEN unhex('{MAGIC}0000') WHEN form < 2 THEN encode(t) WHEN form = 2 THEN unhex(regexp_replace(h, '(..)', '\\1\\1\\1', 'g'))
    ELSE unhex(regexp_replace(h || repeat('20', (padded - len)::BIGINT), '(.{{6}})', '\\1\\1', 'g')) END AS payload FROM named
)"""


@REGISTRY.query("archive_entries", f"WITH {ENTRIES} SELECT arc, entry_index, filename, data_offset, size FROM named")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.list_entries(document_archives(spark, sf_dir)).drop("path")


@REGISTRY.query("archive_payloads", f"WITH {ENTRIES} SELECT arc, entry_index, filename, form > 0 AND len > 0 AS unwrapped, sha256(payload) AS payload_sha256 FROM payloads WHERE octet_length(payload) > 0")
def archive_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry cut out, decompressed and hashed; equal names occur in no archive."""
    rows = archive.extract(document_archives(spark, sf_dir))
    return rows.select("arc", "entry_index", "filename", "unwrapped", F.sha2("payload", 256).alias("payload_sha256"))


@REGISTRY.query("archive_totals", f"WITH {ENTRIES} SELECT arc, count(*) FILTER (WHERE octet_length(payload) > 0) AS n_files, count(*) FILTER (WHERE octet_length(payload) = 0) AS n_skipped, sum(octet_length(payload))::BIGINT AS n_bytes FROM payloads GROUP BY ROLLUP (arc)")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.extract_totals(document_archives(spark, sf_dir)).drop("path")


@REGISTRY.query("wanted_entries", f"WITH {ENTRIES} SELECT arc, filename, sha256(unhex(CASE WHEN form = 0 THEN h END)) AS raw_sha256, size FROM named WHERE filename LIKE '%.htm' AND size > 0")
def wanted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes of the entries with one extension; hashed where they are the text itself."""
    rows = archive.with_raw(document_archives(spark, sf_dir), archive.wanted_extensions("HTM"))
    plain = ~F.startswith(F.hex("raw"), F.lit(MAGIC))
    return rows.select("arc", "filename", F.when(plain, F.sha2("raw", 256)).alias("raw_sha256"), "size")


@REGISTRY.query("ext_histogram", f"WITH {ENTRIES} SELECT CASE WHEN doc_id % 50 = 0 THEN '' ELSE ['.txt', '.htm', '.gif'][doc_id % 3 + 1] END AS ext, count(*) AS n_files FROM named GROUP BY 1")
def ext_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.extension_histogram(archive.list_entries(document_archives(spark, sf_dir)))


@REGISTRY.query("archive_files", f"WITH {ENTRIES} SELECT arc, count(*) AS n_entries, sum(size)::BIGINT AS n_bytes FROM named WHERE size > 0 GROUP BY arc")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written as files by the file sink, found again by name, and read as byte ranges."""
    folder = scratch_path(spark, "archives").removeprefix("file://")
    made = document_archives(spark, sf_dir).withColumn("name", F.concat("arc", F.when(F.length("arc") % 2 == 0, ".arc").otherwise(".ARC")))
    sinks.write_files(made, folder, "name", "content")
    return archive.read_raw(spark, folder).groupBy("arc").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(F.octet_length("raw")).alias("n_bytes"))


#: Parts as blocks: two pages, an image and a style sheet in turn, and a work unit in front that names a file.
BLOCKS = """
items AS (
  SELECT p_partkey // 20 AS k, p_partkey AS pos, CASE p_partkey % 4 WHEN 2 THEN '.gif' WHEN 3 THEN '.css' ELSE '.htm' END AS kind,
    CASE p_partkey % 4 WHEN 2 THEN 'GIF89a' || p_name WHEN 3 THEN '.p {' || p_name || '}' ELSE '<html>' || p_name || '</html>' END AS t FROM part
  UNION ALL SELECT DISTINCT p_partkey // 20, -1, '.xml', '<workunit><filename>M' || (p_partkey // 20) || CASE WHEN p_partkey // 20 % 3 = 0 THEN '' ELSE '.HTM' END || '</filename></workunit>' FROM part WHERE p_partkey // 20 % 5 > 0
), blocks AS (
  SELECT *, 'B' || k AS arc, strlen(t) AS len, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::INTEGER AS entry_index, row_number() OVER (PARTITION BY k, kind ORDER BY pos) AS n,
    (8 + sum(strlen(t) + 13) OVER (PARTITION BY k ORDER BY pos) - strlen(t) - 13)::BIGINT AS data_offset,
    row_number() OVER (PARTITION BY k, kind ORDER BY strlen(t) DESC, pos) AS by_size FROM items
)"""


def part_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block archives of all parts."""
    k = F.floor(F.col("p_partkey") / 20).cast("long")
    form = F.col("p_partkey") % 4
    text = F.when(form == 2, F.concat(F.lit("GIF89a"), "p_name")).when(form == 3, F.concat(F.lit(".p {"), "p_name", F.lit("}"))).otherwise(F.concat(F.lit("<html>"), "p_name", F.lit("</html>")))
    parts = table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_partkey").alias("at"), text.alias("t"))
    name = F.concat(F.lit("M"), F.col("k").cast("string"), F.when(F.col("k") % 3 == 0, "").otherwise(".HTM"))
    units = parts.select("k").distinct().where("k % 5 > 0").select("k", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("<workunit><filename>"), name, F.lit("</filename></workunit>")).alias("t"))
    digits = block(F.hex(F.col("t").cast("binary")), PLAIN_BYTES)
    made = parts.unionByName(units).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", digits.alias("raw")))).alias("bs"))
    content = F.concat(F.lit(archive.BLOCKS_MAGIC.hex()), F.array_join(F.transform("bs", lambda b: b["raw"]), ""))
    return as_files(made.select(F.concat(F.lit("B"), F.col("k").cast("string")).alias("arc"), F.unhex(content).alias("content")))


BLOCK_NAMES = """SELECT *, CASE WHEN kind = '.htm' AND k % 5 > 0 AND by_size = 1 THEN 'M' || k || CASE WHEN k % 3 = 0 THEN '' ELSE '.HTM' END WHEN kind = '.htm' THEN CASE WHEN k % 5 > 0 THEN 'M' || k ELSE lower(arc) END || '_' || n || '.htm'
  WHEN kind = '.css' THEN CASE WHEN k % 5 > 0 THEN 'M' || k ELSE lower(arc) END || 's.htm' ELSE lower(arc) || '_' || n || kind END AS filename FROM blocks WHERE kind <> '.xml'"""


@REGISTRY.query("block_names", f"WITH {BLOCKS} SELECT arc, entry_index, filename, data_offset, (len + 13)::BIGINT AS size FROM ({BLOCK_NAMES})")
def block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.list_entries(part_blocks(spark, sf_dir)).drop("path")


@REGISTRY.query("block_payloads", f"WITH {BLOCKS} SELECT arc, filename, arg_max(entry_index, entry_index) AS entry_index, arg_max(sha256(t), entry_index) AS payload_sha256 FROM ({BLOCK_NAMES}) GROUP BY arc, filename")
def block_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the style sheets, which share a name, the last stays."""
    return archive.extract(part_blocks(spark, sf_dir)).select("arc", "filename", "entry_index", F.sha2("payload", 256).alias("payload_sha256"))


#: What makes a chunk that does not decode: a control word of copies, and one from before the start.
BAD = "FFFF30FF"
FRAMED = f"""
framed AS (
  SELECT doc_id, '{BAD}' || hex(encode(coalesce(text, ''))) AS h, (4 + strlen(coalesce(text, '')))::BIGINT AS len FROM documents
)"""


@REGISTRY.query("raw_repairs", f"""WITH {FRAMED}, n AS (SELECT *, len > {decode.RAW_BLOCK} AS long FROM framed)
SELECT doc_id, 'mixed_no_repair' AS variant, sha256(unhex(CASE WHEN long THEN h ELSE h || '0000' END)) AS sha256 FROM n
UNION ALL SELECT doc_id, 'mixed_drop2_relaxed', sha256(unhex(h || '0000')) FROM n WHERE long""")
def raw_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind a chunk that does not decode, framed by marks after each 16 KiB and ended by zeros:
    the strict repair gives the text, the relaxed one the text and the zeros. Equal results of the
    variants are one candidate. Texts whose last 16 KiB leave no room for the zeros are not framed so."""
    digits = F.concat(F.lit(BAD), F.hex(F.coalesce("text", F.lit("")).cast("binary")))
    framed = F.concat(F.array_join(chunks_of(digits, decode.RAW_BLOCK), "ABCD"), F.lit("0000"))
    raw = F.unhex(F.concat(F.lit(MAGIC), F.lit("0400"), framed))
    rows = decode.candidate_rows(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")))
    return rows.where("variant IN ('mixed_no_repair', 'mixed_drop2_relaxed')").select("doc_id", "variant", "sha256")


def part_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with all that is set right: metadata, loose header cells, a list of images, a
    list of one numbered item, a popup, rows run together."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    meta = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value, F.lit('">'))
    lit = F.lit
    head = F.concat(meta("TPS_System", size), meta("tps_group", F.lit(" 06 ")), meta("tps_section", F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("")), meta("tps_system", F.lit("later")), meta("tps_section_title", F.col("p_type")), meta("tps_ss_title", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand"))))
    body = F.concat(
        lit("<h1> "), "p_name", lit(" </h1><script>no()</script><table><th>Brand</th><th>Size</th><tr><td>"), "p_brand", lit("</td><td>"), size, lit("</td></tr></table>"),
        lit('<ul> <img src="i'), key, lit('.gif"> </ul><ol start="'), size, lit('"><li>'), "p_type", lit('</li></ol><p>See <span class="x popup">'), "p_brand", lit("</span> now</p><p>"),
        "p_name", lit(" | "), "p_brand", lit(" || "), "p_type", lit(" | "), size, lit("</p>"),
    )
    # A byte that is no UTF-8 goes.
    page = F.concat(F.concat(lit("<html><head>"), head, lit("</head><body>")).cast("binary"), F.unhex(lit("FF")), F.concat(body, lit("</body></html>")).cast("binary"))
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", page.alias("html"))


def part_markdown(image: str) -> str:
    """The Markdown of a part's page in SQL, without its last LF; the image is an SQL expression."""
    return f"""concat_ws(chr(10) || chr(10), '# ' || p_name, '| Brand | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | ' || p_size || ' |', {image},
  '**' || p_size || '.** ' || p_type, 'See ' || p_brand || ' now', '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_type || ' | ' || p_size || ' |')"""


@REGISTRY.query("mended_pages", f"SELECT p_partkey, {part_markdown("'![](i' || p_partkey || '.gif)'")} || chr(10) AS markdown FROM part")
def mended_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.pages(part_html(spark, sf_dir), fields=("markdown",))


@REGISTRY.query("page_sections", """SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size || '06-' || p_brand ELSE 'Uncategorized' END AS section_code, p_type AS section_title,
  CASE WHEN p_size % 4 = 0 THEN 'General' ELSE p_brand END AS subsection_title, '' AS book, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_brand END AS title FROM part""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html.pages(part_html(spark, sf_dir), fields=("meta", "heading"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in html.page_section().items()], html.page_title(F.lit("none")).alias("title"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those pages as the files of two archives, the second paired with the first."""
    arc = F.when(F.col("p_partkey") % 5 == 0, "EEP").otherwise("SEP")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".htm"))
    return part_html(spark, sf_dir).select(arc.alias("arc"), F.concat(arc, F.lit("/"), name).alias("path"), F.col("html").alias("content"))


PART_FIELDS = """
about AS (
  SELECT *, 'p' || p_partkey || '.htm' AS file, CASE WHEN p_size % 4 = 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_size % 3 > 0 THEN p_size || '06-' || p_brand ELSE 'Uncategorized' END AS code,
    CASE WHEN p_size % 4 = 0 THEN 'General' ELSE p_brand END AS sub FROM part
)"""


@REGISTRY.query("vault_notes", f"""WITH {PART_FIELDS}
SELECT file AS source_file, 'P' || p_partkey || '.md' AS md_name, concat_ws(chr(10), '---', 'title: "' || title || '"', 'source_file: "' || file || '"', 'arc: ""', 'section_code: "' || code || '"', 'section_title: "' || p_type || '"', 'subsection_title: "' || sub || '"', '---',
  {part_markdown("'![](../assets/i' || p_partkey || '.gif)'")} || chr(10)) AS note FROM about WHERE p_partkey % 5 > 0""")
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.vault_pages(part_files(spark, sf_dir), "SEP").select("source_file", "md_name", "note")


@REGISTRY.query("part_chunks", f"""WITH {PART_FIELDS}, made AS (
  SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'EEP' ELSE 'SEP' END AS own, CASE WHEN p_partkey % 5 = 0 THEN 'wiring-' ELSE 'manual-' END || file || '-001' AS chunk_id, {part_markdown("NULL")} AS body FROM about
)
SELECT chunk_id, 'SEP' AS arc, own AS source_arc, own || '/' || file AS source_path, title, code AS section_code, p_type AS section_title, sub AS subsection_title, 1 AS chunk_index, 1 AS chunk_count, len(regexp_extract_all(body, '\\S+'))::INTEGER AS chunk_words,
  sha256(concat_ws(chr(10), '---', 'arc: "SEP"', 'source_arc: "' || own || '"', 'source_file: "' || file || '"', 'source_type: "htm"', 'title: "' || title || '"', 'section_code: "' || code || '"', 'section_title: "' || p_type || '"',
    'subsection_title: "' || sub || '"', 'chunk_id: "' || chunk_id || '"', 'chunk_index: 1', 'chunk_count: 1', 'chunk_words: ' || len(regexp_extract_all(body, '\\S+')), '---', '', '# ' || title, '', '> Source: ' || own || '/' || file,
    '> Section: ' || code || ' - ' || p_type, '> Subsection: ' || sub, '> Chunk: 1/1', '', body, '')) AS content_sha256 FROM made""")
def part_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of an archive and its paired one: pages of one chunk, without their images."""
    rows = corpora.chunk_export(part_files(spark, sf_dir), "SEP", "EEP")
    return rows.drop("source_file", "source_type", "text", "file_name")


@REGISTRY.query("probe_candidates", f"WITH {ENTRIES} SELECT arc, entry_index, 'default' AS variant, 'file_00000__default' AS file_name, sha256(t) AS sha256 FROM named WHERE filename = 'file_00000' AND form = 0 AND len > 0")
def probe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decoding of every entry of one name, in all archives; those that are no blocks have one."""
    rows = scoring.probe(archive.with_raw(document_archives(spark, sf_dir)), "FILE_00000")
    return rows.where(~F.startswith(F.hex("payload"), F.lit(MAGIC))).select("arc", "entry_index", "variant", "file_name", "sha256")


@REGISTRY.query("skipped_archives", "SELECT 'N' || n_nationkey AS arc, hex(encode(left(n_name, 8))) AS magic FROM nation")
def skipped_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("arc"), F.col("n_name").cast("binary").alias("content"))
    return archive.skipped_archives(as_files(odd).unionByName(part_blocks(spark, sf_dir))).drop("path")


@REGISTRY.query("root_index", "SELECT '# SEP Manual Bundle' || chr(10) || chr(10) || 'Pages: ' || (SELECT count(*) FROM part) || chr(10) || 'Assets copied: ' || (SELECT count(*) FROM supplier) || chr(10) AS markdown")
def root_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.root_index(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), "SEP")


@REGISTRY.query("fenced_units", """SELECT p_partkey, generate_subscripts(u, 1) - 1 AS place, unnest(u) AS unit FROM (SELECT p_partkey, ['# ' || p_name, 'intro ' || p_brand || chr(10) || '```x' || chr(10) || 'code' || chr(10) || chr(10) || '# ' || p_type || chr(10) || '```',
  'after', '## End', 'last ' || p_size || chr(10) || '```' || chr(10) || 'open' || chr(10) || chr(10) || 'end'] AS u FROM part)""")
def fenced_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, a fence with an empty line and a heading inside, and one that never closes."""
    text = F.concat(F.lit("# "), "p_name", F.lit("\r\nintro "), "p_brand", F.lit(" \n```x\ncode\n\n# "), "p_type", F.lit("\n```\nafter\n## End\n\n\n\nlast "), F.col("p_size").cast("string"), F.lit("\n```\nopen\n\nend\n"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text")).select("p_partkey", F.posexplode(chunking.semantic_units(F.col("text"), 300)).alias("place", "unit"))


#: Labelled documents as a probe report: a third match; of the others, by doc_id, copies that are equal,
#: longer or gone, and entries that are missing.
REPORT = """
report AS (
  SELECT doc_id, 'D' || doc_id || '.TXT' AS filename FROM labels WHERE quality = 0 OR toxic = 1
), found AS (
  SELECT r.filename, d.doc_id, d.text AS t, d.doc_id % 4 AS form FROM report r LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 <> 3 AND strlen(text) > 0) d USING (doc_id)
)"""


def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    status = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "mismatch").otherwise("match")
    return table(spark, sf_dir, "labels").select(name.alias("filename"), status.alias("status"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("remote_url"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    entries = docs.where("doc_id % 4 <> 3 AND octet_length(text) > 0").select(F.lit("DOC").alias("arc"), F.col("doc_id").alias("entry_index"), name.alias("filename"), F.col("text").cast("binary").alias("raw"))
    copy = F.when(F.col("doc_id") % 4 == 0, F.col("text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("x"))).cast("binary")
    remote = docs.select(F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("remote_url"), copy.alias("content"), F.when(copy.isNull(), "gone").alias("error"))
    # The report goes through its sink and is read back by header.
    path = scratch_path(spark, "report")
    sinks.write_report(label_report(spark, sf_dir).withColumn("note", F.lit('a "quoted", note')), path)
    return scoring.score_report(scoring.read_report(spark, path), entries, remote)


@REGISTRY.query("score_report", f"""WITH {REPORT}
SELECT filename, CASE WHEN doc_id IS NULL THEN 'missing_local_entry' WHEN form = 2 THEN 'remote_error' WHEN form = 0 THEN 'exact_match' ELSE 'best_candidate' END AS status,
  CASE WHEN form < 2 THEN 'default' END AS best_variant, CASE WHEN form < 2 THEN strlen(t)::INTEGER END AS best_prefix_match, NULL::INTEGER AS best_first_diff, CASE WHEN form < 2 THEN strlen(t)::INTEGER END AS best_len,
  CASE WHEN form < 2 THEN sha256(t) END AS best_sha256, CASE WHEN form < 2 THEN (strlen(t) + form)::INTEGER END AS remote_len, CASE WHEN form < 2 THEN sha256(t || CASE WHEN form = 1 THEN 'x' ELSE '' END) END AS remote_sha256,
  CASE WHEN doc_id IS NOT NULL THEN 'DOC' END AS arc, CASE WHEN doc_id IS NULL THEN 'no entry of that name' WHEN form = 2 THEN 'gone' ELSE '' END AS detail FROM found""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir)


@REGISTRY.query("score_counts", f"WITH {REPORT} SELECT count(*) FILTER (WHERE form = 0) AS exact, count(*) FILTER (WHERE form = 1) AS best_candidate, count(*) FILTER (WHERE form = 2 OR doc_id IS NULL) AS errors FROM found")
def score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.status_counts(scored_documents(spark, sf_dir))


@REGISTRY.query("ordered_lines", "SELECT doc_id, lang, sha256(coalesce(text, 'null')) AS text_sha256, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS place FROM documents")
def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in order as JSON lines, and read back with their places."""
    path = scratch_path(spark, "lines")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, order=["lang", "doc_id"])
    lines = sinks.read_ordered_jsonl(spark, path, "doc_id long, lang string, text string")
    return lines.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("null")), 256).alias("text_sha256"), "place")


@REGISTRY.query("index_lines", """WITH links AS (SELECT upper(left(p_name, 1)) AS letter, 1 AS part, lower(p_name) AS title_key, 'P' || p_partkey || '.HTM' AS source_file, '- [[P' || p_partkey || '|' || p_name || ']]' AS line FROM part),
lines AS (SELECT * FROM links UNION ALL SELECT DISTINCT letter, 0, '', '', '## ' || letter FROM links)
SELECT line, row_number() OVER (ORDER BY letter, part, title_key, source_file) AS place FROM lines""")
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alphabetical index written as ordered lines, and read back with their places."""
    from quire.plans.table_queries import part_pages

    path = scratch_path(spark, "index")
    sinks.write_lines(indexes.alphabetical_lines(part_pages(spark, sf_dir)), path, indexes.INDEX_ORDER)
    return sinks.read_ordered_lines(spark, path)


@REGISTRY.query("vault_manifest", "SELECT 'PAG' AS arc, 'EEP' AS wiring_arc, false AS copy_all_wiring_assets, count(*) AS page_count, 0::BIGINT AS asset_count, 0::BIGINT AS wiring_asset_count FROM pages")
def vault_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.plans.page_queries import page_files

    files = page_files(spark, sf_dir)
    links, index = corpora.page_links(files, "PAG", "EEP"), lookup.file_index(files)
    return corpora.vault_manifest(corpora.vault_pages(files, "PAG", "EEP", links), lookup.copied_assets(index, links, "PAG"), lookup.copied_wiring(index, links, "EEP"), "PAG", "EEP", False)


#: Nations as archives that are present: manuals by key, wiring archives in two regions, recalls in one.
PRESENT = f"""
listed(place, arc, label, index_file) AS (VALUES {", ".join(f"({i}, '{a}', '{label}', {'NULL' if page is None else chr(39) + page + chr(39)})" for i, (a, label, page) in enumerate(lookup.CATALOGUE))}),
pairs(arc, wiring) AS (VALUES {", ".join(f"('{m}', '{w}')" for m, w in lookup.SERVER_WIRING.items())}),
manuals AS (SELECT arc, n_nationkey % 2 = 0 AND index_file IS NOT NULL AS has_page FROM nation JOIN listed ON place = n_nationkey WHERE n_regionkey <> 1),
wires AS (SELECT wiring AS arc FROM nation JOIN (SELECT *, row_number() OVER (ORDER BY arc) - 1 AS i FROM pairs) ON i = n_nationkey WHERE n_regionkey IN (0, 2)),
recalls AS (SELECT 'R' || lpad(n_nationkey::VARCHAR, 2, '0') AS arc FROM nation WHERE n_regionkey = 3),
shown AS (SELECT place, arc, label, CASE WHEN has_page THEN index_file ELSE '' END AS page, w.arc AS wiring FROM manuals JOIN listed USING (arc) LEFT JOIN pairs USING (arc) LEFT JOIN wires w ON w.arc = pairs.wiring)""".replace("shown AS (SELECT place, arc,", "shown AS (SELECT place, listed.arc,")


def nation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    manuals = spark.createDataFrame([(i, a, page) for i, (a, _, page) in enumerate(lookup.CATALOGUE)], "n_nationkey int, arc string, page string")
    wires = spark.createDataFrame([(i, w) for i, (_, w) in enumerate(sorted(lookup.SERVER_WIRING.items()))], "n_nationkey int, arc string")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    page = F.when((F.col("n_nationkey") % 2 == 0) & F.col("page").isNotNull(), F.col("page")).otherwise("X.HTM")
    files = nations.where("n_regionkey <> 1").join(manuals, "n_nationkey").select("arc", F.concat("arc", F.lit("/"), page).alias("path"))
    files = files.unionByName(nations.where("n_regionkey IN (0, 2)").join(wires, "n_nationkey").select("arc", F.concat("arc", F.lit("/A.SVG")).alias("path")))
    recall = F.concat(F.lit("R"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    return lookup.file_index(files.unionByName(nations.where("n_regionkey = 3").select(recall.alias("arc"), F.concat(recall, F.lit("/X.HTM")).alias("path"))))


@REGISTRY.query("catalogue_page", f"""WITH {PRESENT}
SELECT (SELECT coalesce(string_agg(arc || ' ' || label || ' /' || arc || '/' || page || coalesce(' + Wiring (' || wiring || ')', ''), chr(10) ORDER BY place), '') FROM shown) AS manuals,
  (SELECT coalesce(string_agg(arc, chr(10) ORDER BY arc), '') FROM wires WHERE arc NOT IN (SELECT wiring FROM shown WHERE wiring IS NOT NULL)) AS unmatched_wiring,
  (SELECT coalesce(string_agg(arc, chr(10) ORDER BY arc), '') FROM recalls) AS recalls""")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.home_page(spark, nation_index(spark, sf_dir))
