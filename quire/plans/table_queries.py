"""Queries of joins, ordered rules, aggregates, indexes and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import binary as B
from quire.functions import text as T
from quire.operators import corpora, indexes, lookup, ordered, scoring
from quire.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("dedup_keep_first", "SELECT doc_id, content_sha256 FROM (SELECT doc_id, sha256(text) AS content_sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    # The first by one column is an aggregate, combined before the shuffle: a hot text is one row a task.
    return rows.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"))


@REGISTRY.query("candidate_dedup", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.keep_first(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey")


@REGISTRY.query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.last_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


PLACED = "SELECT doc_id, coalesce(source, '') AS arc, (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n + 16)::BIGINT AS data_offset, n::BIGINT AS true_size FROM (SELECT *, strlen(coalesce(text, '')) AS n FROM documents)"


@REGISTRY.query("size_repair", f"SELECT arc, doc_id, data_offset, true_size AS size FROM ({PLACED})")
def size_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes stored modulo 65,536 of documents laid end to end, and repaired."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("source").orderBy("doc_id")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("arc"), (F.sum(n).over(order) - n + 16).alias("data_offset"), (n % 65536).alias("size"), (F.sum(n).over(Window.partitionBy("source")) + 16).alias("archive_size"))
    fixed = ordered.repaired_sizes(rows.withColumn("entry_index", F.col("doc_id")))
    return fixed.select("arc", "doc_id", "data_offset", "size")


@REGISTRY.query("block_extents", 'SELECT source AS arc, doc_id AS "start", coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 1000000000) AS "end" FROM documents')
def block_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("arc"), F.col("doc_id").alias("start"), F.lit(1_000_000_000).cast("long").alias("archive_size"))
    return ordered.block_extents(rows).drop("archive_size")


@REGISTRY.query("running_counter", "SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id)::INTEGER AS n FROM documents")
def running_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.running_counter(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], [F.col("doc_id")], "n")


@REGISTRY.query("largest_per_group", "SELECT source, arg_max(doc_id, (strlen(text), -doc_id)) AS doc_id, max(strlen(text))::INTEGER AS n_bytes FROM documents GROUP BY source")
def largest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("n_bytes"))
    return ordered.best_per_group(rows, ["source"], [F.col("n_bytes"), -F.col("doc_id")], ["doc_id", "n_bytes"])


@REGISTRY.query("last_named", "SELECT user_id, arg_max(props, event_id) AS props FROM events WHERE event_type = 'click' GROUP BY user_id")
def last_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.best_per_group(table(spark, sf_dir, "events").where("event_type = 'click'"), ["user_id"], [F.col("event_id")], ["props"])


@REGISTRY.query("conditional_counts", "SELECT count(*) FILTER (WHERE toxic = 1) AS exact, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS best_candidate, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS errors FROM labels")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "exact_match").when(F.col("quality") == 1, "best_candidate").otherwise("no_candidates")
    return scoring.status_counts(table(spark, sf_dir, "labels").select(status.alias("status")))


@REGISTRY.query("status_left_join", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_local_entry' WHEN l.quality = 1 THEN 'exact_match' ELSE 'mismatch' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", F.when(F.col("_id").isNull(), "missing_local_entry").when(F.col("quality") == 1, "exact_match").otherwise("mismatch").alias("status"))


@REGISTRY.query("semi_filter", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@REGISTRY.query("anti_unmatched", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@REGISTRY.query("catalogue_join", "SELECT n_name, r_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalogue_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("_n"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(suppliers, "n_nationkey", "left").select("n_name", "r_name", F.coalesce("_n", F.lit(0)).alias("n_suppliers"))


@REGISTRY.query("wiring_pairs", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'EEX' ELSE w END AS wiring_arc FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EE2' WHEN 1 THEN 'EEA' WHEN 2 THEN 'EET' END AS w FROM customer)")
def wiring_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    manuals = F.element_at(F.array(*map(F.lit, ("SE2", "SCA", "SDZ", "VE2"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", manuals.alias("arc"))
    return lookup.with_wiring(rows, lookup.wiring_map(spark), override=F.when(F.col("c_custkey") % 5 == 0, "EEX")).select("c_custkey", "wiring_arc")


@REGISTRY.query("role_union", "SELECT doc_id AS id, 'manual' AS role, length(text)::INTEGER AS n_chars FROM documents UNION ALL SELECT item_id, 'wiring', length(text)::INTEGER FROM benchmark")
def role_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("DOC").alias("arc"), "text")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("EEB").alias("arc"), "text")
    return a.unionByName(b).select("id", corpora.role_of(F.col("arc"), "eeb").alias("role"), F.length("text").alias("n_chars"))


@REGISTRY.query("asset_union", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def asset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


#: Candidates of a text against a trusted copy: as it is, normalised, without its first character,
#: and with a tail. The copy is the text without blanks at its end and with one changed byte.
SCORED = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), base AS (
  SELECT doc_id, text AS t, CASE WHEN doc_id % 3 = 0 THEN rtrim(text) ELSE left(text, (length(text) // 2)::BIGINT) || '#' || substr(text, (length(text) // 2 + 2)::BIGINT) END AS r FROM texts
), c AS (
  SELECT doc_id, r, 0 AS place, 'default' AS variant, t AS p FROM base
  UNION ALL SELECT doc_id, r, 1, 'normalised', rtrim(t) FROM base
  UNION ALL SELECT doc_id, r, 2, 'headless', substr(t, 2) FROM base
  UNION ALL SELECT doc_id, r, 3, 'tailed', t || 'x' FROM base
), h AS (
  SELECT doc_id, place, variant, hex(encode(p)) AS p, hex(encode(r)) AS r FROM c
), f AS (
  SELECT *, (least(len(p), len(r)) // 2)::INTEGER AS m, list_position(list_transform(list_zip(string_split(left(p, least(len(p), len(r))), ''), string_split(left(r, least(len(p), len(r))), '')), lambda x: x[1] <> x[2]), true) AS spot FROM h
), s AS (
  SELECT doc_id, place, variant, CASE WHEN spot IS NULL OR m = 0 THEN m ELSE ((spot - 1) // 2)::INTEGER END AS prefix_match, CASE WHEN spot IS NULL OR m = 0 THEN NULL ELSE ((spot - 1) // 2)::INTEGER END AS first_diff, p = r AS exact_match, (len(p) // 2)::INTEGER AS payload_len FROM f
)
SELECT doc_id, arg_max(variant, (prefix_match, exact_match::INTEGER, payload_len, -place)) AS variant, arg_max(struct_pack(v := prefix_match), (prefix_match, exact_match::INTEGER, payload_len, -place)).v AS prefix_match,
  arg_max(struct_pack(v := first_diff), (prefix_match, exact_match::INTEGER, payload_len, -place)).v AS first_diff, arg_max(exact_match, (prefix_match, exact_match::INTEGER, payload_len, -place)) AS exact_match
FROM s GROUP BY doc_id"""


@REGISTRY.query("best_candidate", SCORED)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), half), F.lit("#"), F.substring("text", half + 2, F.length("text")))
    trusted = F.when(F.col("doc_id") % 3 == 0, F.rtrim("text")).otherwise(changed)
    made = [("default", F.col("text")), ("normalised", F.rtrim("text")), ("headless", F.substring("text", F.lit(2), F.length("text"))), ("tailed", F.concat("text", F.lit("x")))]
    options = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("variant"), c.cast("binary").alias("payload")) for i, (n, c) in enumerate(made)])
    rows = rows.select("doc_id", trusted.cast("binary").alias("trusted"), F.explode(options).alias("c")).select("doc_id", "trusted", "c.*")
    scored = rows.withColumns(scoring.scores("payload", "trusted")).withColumn("payload_len", F.octet_length("payload"))
    return scoring.best_candidates(scored, ["doc_id"], ["variant", "prefix_match", "first_diff", "exact_match"])


@REGISTRY.query("sniff_type", "SELECT page_id, CASE WHEN html ILIKE '<html%' THEN '.htm' WHEN html ILIKE '<svg%' THEN '.svg' WHEN html LIKE '; %' THEN '.wcf' ELSE '.bin' END AS ext FROM pages")
def sniff_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", B.sniff_extension(F.col("html").cast("binary")).alias("ext"))


@REGISTRY.query("little_endian", "SELECT p_partkey, p_partkey AS u32, (p_partkey % 65536)::BIGINT AS u16, CASE WHEN p_partkey % 65536 >= 32768 THEN p_partkey % 65536 - 65536 ELSE p_partkey % 65536 END AS s16 FROM part")
def little_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("p_partkey", 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)]))
    low = B.little_endian(data, 1, 2)
    return table(spark, sf_dir, "part").select("p_partkey", B.little_endian(data, 1, 4).alias("u32"), low.alias("u16"), B.signed16(low).alias("s16"))


@REGISTRY.query("tag_text", "SELECT page_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS title FROM pages WHERE regexp_matches(html, '<title>[^<]+</title>')")
def tag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", B.tag_text(F.col("html"), "TITLE").alias("title")).where("title IS NOT NULL")


PARTS = "SELECT p_partkey, p_name AS title, 'P' || p_partkey || '.HTM' AS source_file, 'P' || p_partkey AS stem, p_brand AS section_code, p_type AS section_title, CASE WHEN p_size % 4 = 0 THEN 'General' ELSE 'Size ' || (p_size % 4) END AS sub FROM part"
LINK = "'- [[' || stem || '|' || title || ']]'"


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the shape of vault pages."""
    key = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    sub = F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.concat(F.lit("Size "), (F.col("p_size") % 4).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(key, F.lit(".HTM")).alias("source_file"), F.concat(key, F.lit(".md")).alias("md_name"), F.col("p_brand").alias("section_code"), F.col("p_type").alias("section_title"), sub.alias("subsection_title"))


@REGISTRY.query("alpha_index", f"SELECT upper(left(title, 1)) AS letter, count(*) AS n_pages, string_agg({LINK}, chr(10) ORDER BY lower(title), source_file) AS links FROM ({PARTS}) GROUP BY 1")
def alpha_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.alphabetical_groups(part_pages(spark, sf_dir))


@REGISTRY.query("section_groups", f"SELECT section_code, section_title, sub AS subsection, count(*) AS n_pages, string_agg({LINK}, chr(10) ORDER BY lower(title), source_file) AS links FROM ({PARTS}) GROUP BY 1, 2, 3")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.section_groups(part_pages(spark, sf_dir))


SECTIONS = f"""
WITH g AS (SELECT section_code, section_title, sub, count(*) AS n, string_agg({LINK}, chr(10) ORDER BY lower(title), source_file) AS links FROM ({PARTS}) GROUP BY 1, 2, 3),
s AS (SELECT section_code, section_title, sum(n)::BIGINT AS n_pages, string_agg('## ' || sub || chr(10) || links, chr(10) || chr(10) ORDER BY sub) AS body FROM g GROUP BY 1, 2)"""


@REGISTRY.query("section_index", SECTIONS + " SELECT section_code, section_title, section_code || ' ' || section_title || '.md' AS file_name, n_pages, '# ' || section_code || ' - ' || section_title || chr(10) || chr(10) || body || chr(10) AS markdown FROM s")
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.section_indexes(part_pages(spark, sf_dir))


@REGISTRY.query("section_summary", SECTIONS + " SELECT '# Section Index' || chr(10) || chr(10) || string_agg('- [[' || section_code || ' ' || section_title || '|' || section_code || ' - ' || section_title || ']] (' || n_pages || ' pages)', chr(10) ORDER BY section_code, section_title) || chr(10) AS markdown FROM s")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.section_summary(part_pages(spark, sf_dir))


#: Files of an index made of customers: archive by nation, name by key; some names occur in two archives.
FILES = "SELECT 'E' || chr((65 + c_nationkey % 20)::INTEGER) || 'B' AS arc, 'EBB' || lpad((c_custkey % 997)::VARCHAR, 6, '0') || CASE WHEN c_custkey % 2 = 0 THEN '.SVG' ELSE '.htm' END AS name FROM customer"


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = F.concat(F.lit("E"), F.char(65 + F.col("c_nationkey") % 20), F.lit("B"))
    name = F.concat(F.lit("EBB"), F.lpad((F.col("c_custkey") % 997).cast("string"), 6, "0"), F.when(F.col("c_custkey") % 2 == 0, ".SVG").otherwise(".htm"))
    return table(spark, sf_dir, "customer").select(arc.alias("arc"), F.concat(arc, F.lit("/"), name).alias("path"))


INDEX = f"idx AS (SELECT DISTINCT arc, lower(name) AS k, arc || '/' || name AS path FROM ({FILES})), anyfile AS (SELECT k, arg_max(path, (arc, path)) AS path FROM idx GROUP BY k)"


@REGISTRY.query("file_index", f"WITH {INDEX} SELECT arc, k AS basename_lc, path FROM idx")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.file_index(customer_files(spark, sf_dir))


@REGISTRY.query("global_index", f"WITH {INDEX} SELECT k AS basename_lc, path FROM anyfile")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.global_index(lookup.file_index(customer_files(spark, sf_dir)))


@REGISTRY.query("index_sizes", f"WITH {INDEX} SELECT count(*) AS n_files, count(DISTINCT arc) AS n_arcs FROM idx")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.index_sizes(lookup.file_index(customer_files(spark, sf_dir)))


@REGISTRY.query("prefix_sheets", f"""WITH {INDEX}, q AS (SELECT s_suppkey, 'ebb' AS book, s_suppkey::VARCHAR AS cell, 'ebb' || CASE WHEN s_suppkey < 1000 THEN lpad(s_suppkey::VARCHAR, 3, '0') ELSE s_suppkey::VARCHAR END AS prefix FROM supplier)
SELECT s_suppkey, book, cell, prefix, list_sort(list(path) FILTER (WHERE path IS NOT NULL))[1] AS first_sheet, coalesce(len(list(path) FILTER (WHERE path IS NOT NULL)), 0)::INTEGER AS n_sheets
FROM q LEFT JOIN (SELECT * FROM anyfile WHERE k LIKE '%.svg') g ON starts_with(g.k, q.prefix) GROUP BY ALL""")
def prefix_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("ebb").alias("book"), F.col("s_suppkey").cast("string").alias("cell"))
    found = lookup.wiring_sheets(asked, lookup.file_index(customer_files(spark, sf_dir)))
    return found.select("s_suppkey", "book", "cell", "prefix", "first_sheet", (F.size("more_sheets") + F.col("first_sheet").isNotNull().cast("int")).alias("n_sheets"))


#: Requests of many forms for those files, by supplier key.
ASKED = """SELECT s_suppkey AS id, 'E' || chr((65 + s_nationkey % 20)::INTEGER) || 'B' AS arc, 'EBB' || lpad((s_suppkey % 1100)::VARCHAR, 6, '0') AS name FROM supplier"""


def supplier_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = F.concat(F.lit("E"), F.char(65 + F.col("s_nationkey") % 20), F.lit("B"))
    name = F.concat(F.lit("EBB"), F.lpad((F.col("s_suppkey") % 1100).cast("string"), 6, "0"))
    forms = [F.concat(F.lit("/"), arc, F.lit("/"), name, F.lit(".htm")), F.concat(F.lit("/"), F.lower(arc), F.lit("/"), F.lower(name), F.lit(".svg")), F.concat(F.lit("/"), name, F.lit(".SVG")), F.concat(F.lit("/"), arc), F.lit("/")]
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(*forms), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("request"))


@REGISTRY.query("route_requests", f"""WITH {INDEX}, arcs AS (SELECT DISTINCT arc FROM idx), a AS ({ASKED}),
q AS (SELECT id, id % 5 AS form, arc, CASE id % 5 WHEN 0 THEN name || '.htm' WHEN 1 THEN lower(name) || '.svg' WHEN 2 THEN name || '.SVG' ELSE '' END AS file,
  CASE id % 5 WHEN 0 THEN '/' || arc || '/' || name || '.htm' WHEN 1 THEN '/' || lower(arc) || '/' || lower(name) || '.svg' WHEN 2 THEN '/' || name || '.SVG' WHEN 3 THEN '/' || arc ELSE '/' END AS request FROM a),
j AS (SELECT q.*, e.path AS exact, l.path AS local, g.path AS anywhere, arcs.arc IS NOT NULL AS known FROM q
  LEFT JOIN idx e ON form < 2 AND e.path = q.arc || '/' || q.file LEFT JOIN idx l ON form < 2 AND l.arc = q.arc AND l.k = lower(q.file) LEFT JOIN anyfile g ON q.file <> '' AND g.k = lower(q.file) LEFT JOIN arcs ON arcs.arc = q.arc),
r AS (SELECT *, CASE WHEN form = 4 THEN 'home' WHEN exact IS NOT NULL THEN 'file' WHEN local IS NOT NULL THEN 'file_other_case' WHEN form < 2 AND known AND anywhere IS NOT NULL THEN 'redirect'
  WHEN form = 3 AND known THEN 'folder' WHEN anywhere IS NOT NULL THEN 'redirect_anywhere' ELSE 'missing' END AS rule FROM j)
SELECT id, request, rule, CASE rule WHEN 'home' THEN '/' WHEN 'file' THEN '/' || exact WHEN 'file_other_case' THEN '/' || local WHEN 'redirect' THEN '/' || anywhere WHEN 'folder' THEN '/' || arc || '/' WHEN 'redirect_anywhere' THEN '/' || anywhere END AS target FROM r""")
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolved_requests(supplier_requests(spark, sf_dir), lookup.file_index(customer_files(spark, sf_dir)))


@REGISTRY.query("frameset_sides", f"WITH {INDEX}, a AS ({ASKED}), q AS (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE name || '.HTM' END AS name FROM a) SELECT id, name, CASE WHEN name = '' THEN '/' ELSE '/' || coalesce(path, name) END AS url FROM q LEFT JOIN anyfile ON k = lower(name)")
def frameset_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("EBB"), F.lpad((F.col("s_suppkey") % 1100).cast("string"), 6, "0"), F.lit(".HTM"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(name).alias("name"))
    return lookup.resolved_sides(rows, lookup.file_index(customer_files(spark, sf_dir)))


@REGISTRY.query("arc_file_lookup", f"WITH {INDEX}, a AS ({ASKED}) SELECT id, a.arc, lower(name) || '.svg' AS name, path FROM a LEFT JOIN idx ON idx.arc = a.arc AND k = lower(name) || '.svg'")
def arc_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc = F.concat(F.lit("E"), F.char(65 + F.col("s_nationkey") % 20), F.lit("B"))
    name = F.concat(F.lit("ebb"), F.lpad((F.col("s_suppkey") % 1100).cast("string"), 6, "0"), F.lit(".svg"))
    return lookup.find_arc_files(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), arc.alias("arc"), name.alias("name")), lookup.file_index(customer_files(spark, sf_dir)))


@REGISTRY.query("visible_names", "SELECT p_partkey, p_name AS name FROM part WHERE p_partkey % 10 <> 0")
def visible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("."), "p_name")).otherwise(F.col("p_name"))
    return lookup.visible(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")))


@REGISTRY.query("mismatch_limit", "SELECT doc_id::VARCHAR AS filename FROM labels WHERE quality = 0 ORDER BY doc_id::VARCHAR LIMIT 25")
def mismatch_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: a report's first rows."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("filename"), F.when(F.col("quality") == 0, "mismatch").otherwise("ok").alias("status"))
    return scoring.mismatches(rows, 25).select("filename")


@REGISTRY.query("first_entries", "SELECT lower(name) AS key, arg_min(arc, (arc, c_custkey)) AS arc, arg_min(c_custkey, (arc, c_custkey)) AS entry_index FROM (SELECT c_custkey, c_mktsegment AS arc, 'F' || (c_custkey % 211) || '.HTM' AS name FROM customer) WHERE c_custkey % 211 < 100 GROUP BY 1")
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 211
    entries = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("arc"), F.col("c_custkey").alias("entry_index"), F.concat(F.lit("F"), n.cast("string"), F.lit(".HTM")).alias("filename"))
    names = table(spark, sf_dir, "customer").where(n < 100).select(F.concat(F.lit("x/f"), n.cast("string"), F.lit(".htm")).alias("filename"))
    return scoring.first_entries(entries, names).select("key", "arc", "entry_index")


@REGISTRY.query("text_letters", r"""
WITH t AS (
  SELECT upper(left(regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ''), 1)) AS c FROM documents
)
SELECT CASE WHEN regexp_matches(c, '^[\p{L}\p{N}]') THEN c ELSE '#' END AS letter, count(*) AS n_rows FROM t GROUP BY 1""")
def text_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its index letter."""
    return table(spark, sf_dir, "documents").groupBy(T.index_letter(F.col("text")).alias("letter")).agg(F.count(F.lit(1)).alias("n_rows"))
