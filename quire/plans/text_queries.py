"""Queries of text functions, units and chunks over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking
from quire.plans.registry import Registry, table

REGISTRY = Registry()
TARGET, OVERLAP = 300, 60

#: Normalised text, words, and units in DuckDB; the last are lines or sentences packed to TARGET words.
NORMAL = r"trim(regexp_replace(regexp_replace(replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
WORDS = r"len(regexp_extract_all({t}, '\S+'))::INTEGER"


def normal(t: str = "text") -> str:
    return NORMAL.format(t=t)


def words(t: str) -> str:
    return WORDS.format(t=t)


def filled(sql: str, target: int, overlap: int = 0) -> str:
    return sql.replace("{target}", str(target)).replace("{overlap}", str(overlap))


@REGISTRY.query("normalize_text", f"SELECT doc_id, {normal()} AS text FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@REGISTRY.query("word_count", f"SELECT doc_id, {words('text')} AS n_words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@REGISTRY.query("collapse_space", r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS text FROM pages")
def collapse_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.collapse(F.col("html")).alias("text"))


@REGISTRY.query("content_hash", "SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@REGISTRY.query("slug_names", "SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-_.'), ''), 'chunk') AS slug FROM pages")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@REGISTRY.query("safe_names", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')), ''), 'Untitled') AS name FROM pages""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_file_name(F.col("url")).alias("name"))


@REGISTRY.query("sentence_split", r"SELECT doc_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


@REGISTRY.query("line_split", "SELECT doc_id, generate_subscripts(s, 1) - 1 AS place, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text <> '')")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("place", "line"))


@REGISTRY.query("without_images", r"SELECT page_id, regexp_replace(md, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g') AS markdown FROM (SELECT page_id, '![' || trim(regexp_extract(html, '<title>([^<]*)', 1)) || '](a/' || page_id || '.png) ' || url AS md FROM pages)")
def without_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    markdown = F.concat(F.lit("!["), title, F.lit("](a/"), F.col("page_id").cast("string"), F.lit(".png) "), "url")
    return table(spark, sf_dir, "pages").select("page_id", T.without_images(markdown).alias("markdown"))


@REGISTRY.query("wikilinks", "SELECT p_partkey, '[[p' || p_partkey || '|' || p_name || ']] [web](http://x/y.md) ![i](a.md) [[p' || p_partkey || '#' || p_size || '|' || p_brand || ']]' AS markdown FROM part")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("["), "p_name", F.lit("](p"), key, F.lit(".md) [web](http://x/y.md) ![i](a.md) ["), "p_brand", F.lit("](dir/p"), key, F.lit(".MD#"), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", T.wikilinks(text).alias("markdown"))


@REGISTRY.query("section_codes", "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_size || p_brand || '-' || p_type ELSE 'Uncategorized' END AS section_code FROM part")
def section_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = T.section_code(F.col("p_size").cast("string"), F.col("p_brand"), F.when(F.col("p_size") % 3 > 0, F.col("p_type")).otherwise(" "))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("section_code"))


@REGISTRY.query("url_parts", r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment,
  coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), ''), regexp_extract(url, '[?&]ref=([^&#]+)', 1)) AS page FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in parts.items()], T.query_value(parts["query"], "page", "ref").alias("page"))


@REGISTRY.query("path_parts", r"SELECT page_id, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\.htm$', '') AS stem, '.htm' AS ext FROM (SELECT page_id, 'a/' || page_id || '/P' || page_id || '.1.htm' AS path FROM pages)")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    path = F.concat(F.lit("a/"), key, F.lit("/P"), key, F.lit(".1.htm"))
    return table(spark, sf_dir, "pages").select("page_id", T.basename(path).alias("name"), T.stem(path).alias("stem"), T.extension(path).alias("ext"))


@REGISTRY.query("zero_pad", "SELECT p_partkey, CASE WHEN len(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END AS cell, printf('%05d', p_partkey) AS five FROM part")
def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.zero_pad(F.col("p_partkey").cast("string"), 3).alias("cell"), F.format_string("%05d", "p_partkey").alias("five"))


@REGISTRY.query("strip_prolog", "SELECT page_id, '<svg>' || url || '</svg>' AS svg FROM pages")
def strip_prolog(spark: SparkSession, sf_dir: str) -> DataFrame:
    svg = F.concat(F.lit('<?xml version="1.0"?>\n <svg>'), "url", F.lit("</svg>"))
    return table(spark, sf_dir, "pages").select("page_id", T.strip_prolog(svg).alias("svg"))


UNITS = rf"""
norm AS (SELECT doc_id, lang, {normal("coalesce(text, '')")} AS t FROM documents),
pieces AS (
  SELECT doc_id, lang, i, trim(p) AS p FROM (
    SELECT doc_id, lang, generate_subscripts(s, 1) AS i, unnest(s) AS p FROM (
      SELECT doc_id, lang, CASE WHEN {words("t")} <= {{target}} THEN [t] WHEN contains(t, chr(10)) THEN string_split(t, chr(10))
        ELSE string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS s FROM norm WHERE t <> ''))
  WHERE trim(p) <> ''
),
numbered AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, p, {words("p")} AS w FROM pieces),
grouped AS (
  SELECT doc_id, any_value(lang) AS lang, list(p ORDER BY k) AS ps, list(w ORDER BY k) AS ws FROM numbered GROUP BY doc_id
),
packing AS (
  SELECT doc_id, 1 AS k, 1 AS g, ws[1] AS acc FROM grouped
  UNION ALL
  SELECT p.doc_id, p.k + 1, CASE WHEN p.acc + ws[p.k + 1] > {{target}} THEN p.g + 1 ELSE p.g END,
    CASE WHEN p.acc + ws[p.k + 1] > {{target}} THEN ws[p.k + 1] ELSE p.acc + ws[p.k + 1] END
  FROM packing p JOIN grouped USING (doc_id) WHERE p.k < len(ws)
),
units AS (
  SELECT doc_id, g AS u, trim(string_agg(p, chr(10) ORDER BY k), ' ' || chr(10)) AS unit, sum(w)::INTEGER AS w
  FROM packing JOIN numbered USING (doc_id, k) GROUP BY doc_id, g
)"""

CHUNKS = (
    UNITS
    + """,
folds AS (
  SELECT doc_id, lang, n, ws, us, list_transform(range(0, n + 1), lambda i: coalesce(list_sum(ws[1:i]), 0)::INTEGER) AS total
  FROM (SELECT u.doc_id, any_value(g.lang) AS lang, count(*) AS n, list(u.w ORDER BY u.u) AS ws, list(u.unit ORDER BY u.u) AS us FROM units u JOIN grouped g USING (doc_id) GROUP BY u.doc_id)
),
chain AS (
  SELECT doc_id, 1 AS c, 1 AS s, greatest(1, coalesce(list_max(list_filter(range(1, n + 1), lambda i: total[i + 1] <= {target})), 1)) AS e FROM folds
  UNION ALL
  SELECT doc_id, c + 1, s2, greatest(e + 1, coalesce(list_max(list_filter(range(s2, n + 1), lambda i: total[i + 1] - total[s2] <= {target})), e + 1))
  FROM (
    SELECT f.*, c, e, coalesce(list_max(list_filter(range(s, e + 1), lambda k: total[e + 1] - total[k] >= {overlap})), s) AS s2
    FROM chain JOIN folds f USING (doc_id) WHERE e < n)
),
made AS (
  SELECT doc_id, lang, c::INTEGER AS chunk_index, max(c) OVER (PARTITION BY doc_id)::INTEGER AS chunk_count, s::INTEGER AS start_unit, e::INTEGER AS end_unit,
    (total[e + 1] - total[s])::INTEGER AS chunk_words, array_to_string(us[s:e], chr(10) || chr(10)) AS body
  FROM chain JOIN folds USING (doc_id)
)"""
)


@REGISTRY.query("semantic_units", f"WITH RECURSIVE {filled(UNITS, TARGET)} SELECT doc_id, (u - 1)::INTEGER AS place, unit, w AS n_words FROM units")
def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exploded as an expression: of a column Spark first asks whether it is empty, which makes it twice.
    units = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.semantic_units(F.col("text"), TARGET)).alias("place", "unit"))
    return units.withColumn("n_words", T.word_count(F.col("unit")))


@REGISTRY.query("chunk_documents", f"WITH RECURSIVE {filled(CHUNKS, TARGET, OVERLAP)} SELECT doc_id, chunk_index, chunk_count, start_unit, end_unit, chunk_words, sha256(body) AS body_sha256 FROM made")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", TARGET, OVERLAP)
    return made.select("doc_id", "chunk_index", "chunk_count", "start_unit", "end_unit", "chunk_words", F.sha2("body", 256).alias("body_sha256"))


@REGISTRY.query("chunk_manifest", f"WITH RECURSIVE {filled(CHUNKS, 900, 120)} SELECT lang, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, sum(chunk_words)::BIGINT AS n_words, max(chunk_words) AS most_words FROM made GROUP BY lang")
def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    # The first chunk of a document counts it: no distinct count, no second shuffle.
    return made.groupBy("lang").agg(F.count_if(F.col("chunk_index") == 1).alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.sum("chunk_words").alias("n_words"), F.max("chunk_words").alias("most_words"))


RENDERED = (
    CHUNKS
    + r""",
shown AS (
  SELECT *, 'manual-' || file || '-' || printf('%03d', chunk_index) AS chunk_id FROM (SELECT *, 'D' || doc_id || '.htm' AS file FROM made)
)
SELECT chunk_id, 'DOC' AS arc, 'DOC' AS source_arc, file AS source_file, 'htm' AS source_type, 'DOC/' || file AS source_path, 'Document "' || doc_id || '"' AS title,
  lang AS section_code, 'General' AS section_title, 'General' AS subsection_title, chunk_index, chunk_count, chunk_words, text, sha256(text) AS content_sha256,
  'DOC-' || file || '-' || printf('%03d', chunk_index) || '.md' AS file_name
FROM (SELECT *, concat_ws(chr(10), '---', 'arc: "DOC"', 'source_arc: "DOC"', 'source_file: "' || file || '"', 'source_type: "htm"', 'title: "Document \"' || doc_id || '\""',
  'section_code: "' || lang || '"', 'section_title: "General"', 'subsection_title: "General"', 'chunk_id: "' || chunk_id || '"', 'chunk_index: ' || chunk_index,
  'chunk_count: ' || chunk_count, 'chunk_words: ' || chunk_words, '---', '', '# Document "' || doc_id || '"', '', '> Source: DOC/' || file, '> Section: ' || lang || ' - General',
  '> Subsection: General', '> Chunk: ' || chunk_index || '/' || chunk_count, '', body, '') AS text FROM shown)"""
)


def as_source_documents(docs: DataFrame) -> DataFrame:
    """Documents in the shape of converted source files."""
    key = F.col("doc_id").cast("string")
    return docs.select(
        F.lit("DOC").alias("arc"),
        F.concat(F.lit("D"), key, F.lit(".htm")).alias("source_file"),
        F.lit("htm").alias("source_type"),
        F.concat(F.lit('Document "'), key, F.lit('"')).alias("title"),
        F.col("lang").alias("section_code"),
        F.lit("General").alias("section_title"),
        F.lit("General").alias("subsection_title"),
        F.col("text").alias("markdown"),
    )


@REGISTRY.query("chunk_records", f"WITH RECURSIVE {filled(RENDERED, TARGET, OVERLAP)}")
def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_records(as_source_documents(table(spark, sf_dir, "documents")), F.lit("DOC"), F.lit("manual"), TARGET, OVERLAP)
