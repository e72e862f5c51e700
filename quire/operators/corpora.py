"""Source files to corpora: documents, training records, chunk exports, page vaults, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html
from quire.functions.batches import pieces
from quire.functions.text import basename, extension, normalize_text, quoted, stem, strip, strip_prolog, wikilinks, without_images
from quire.operators.chunking import chunk_records, chunk_settings
from quire.operators.lookup import copied_assets, copied_wiring, file_index, image_source, image_target, rewritten_links

TRAINING_EXTENSIONS = [".htm", ".html", ".pdf", ".txt", ".wcf", ".xml"]
CHUNK_EXTENSIONS = [".htm", ".html", ".pdf"]
PAGE_EXTENSIONS = (".htm", ".html")

#: Converts the bytes of a file to (title, markdown); raises if it can't.
Converter = Callable[[bytes], tuple[str, str]]
CONVERTERS: dict[str, Converter] = {}


def converter(*extensions: str) -> Callable[[Converter], Converter]:
    """Decorator that registers a converter for file extensions."""

    def keep(convert: Converter) -> Converter:
        CONVERTERS.update(dict.fromkeys(extensions, convert))
        return convert

    return keep


@converter(".txt", ".wcf", ".xml")
def plain_text(data: bytes) -> tuple[str, str]:
    return "", data.decode("utf-8", "replace")


@converter(".htm", ".html")
def page_text(data: bytes) -> tuple[str, str]:
    root = html.parse(data.decode("utf-8", "ignore"))
    heads = html.headings(root)
    return heads[4], html.markdown_of(html.body_of(root))


def converted(files: DataFrame, converters: dict[str, Converter] | None = None, about: bool = False) -> DataFrame:
    """files with converted_title, markdown and error in place of their content; with ``about`` also the
    meta and heading of pages, from the same parse."""
    known = dict(CONVERTERS if converters is None else converters)
    own = {ext for ext, convert in known.items() if convert is page_text}
    keep = [c for c in files.columns if c != "content"]
    fields = ("meta", "heading") if about else ()

    def one(ext: str, data: bytes | None) -> tuple:
        shown = (None,) * len(fields)
        try:
            if about and ext in PAGE_EXTENSIONS:
                *shown, markdown = html.page_fields(data or b"", (*fields, "markdown")) if ext in own else (*html.page_fields(data or b"", fields), None)
                if markdown is not None:
                    return shown[1][4], markdown, None, *shown
            if ext not in known:
                return None, None, f"no converter for {ext or 'files without extension'}", *shown
            return *known[ext](data or b""), None, *shown
        except Exception as error:  # noqa: BLE001  a record says which file failed and why
            return None, None, f"{type(error).__name__}: {error}", *shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            rows = [one(e.as_py(), d.as_py()) for e, d in zip(batch.column("ext"), batch.column("content"), strict=True)]
            types = (pa.string(), pa.string(), pa.string(), *html.arrow_types(fields))
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "converted_title", "markdown", "error", *fields])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema]
    return files.mapInArrow(run, ", ".join([*kept, "converted_title string, markdown string, error string", *html.ddl(fields)]))


def source_files(files: DataFrame, arc: str, extensions: list[str]) -> DataFrame:
    """(arc, source_file, ext, content) of an archive's files (arc, path, content) with an extension."""
    name = basename(F.col("path"))
    rows = files.where(F.upper("arc") == arc.upper()).select(F.lit(arc.upper()).alias("arc"), name.alias("source_file"), extension(name).alias("ext"), "content")
    return rows.where(F.col("ext").isin(extensions))


def _is_page() -> Column:
    return F.col("ext").isin(*PAGE_EXTENSIONS)


def source_columns() -> list[Column]:
    """source_path and source_type."""
    return [F.concat("arc", F.lit("/"), "source_file").alias("source_path"), F.regexp_replace("ext", "^\\.", "").alias("source_type")]


def training_corpus(files: DataFrame, arc: str, extensions: list[str] = TRAINING_EXTENSIONS, empty_pages: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, skips, manifest) of an archive's documents; records and skips make up the sources.

    Empty documents are skips; with ``empty_pages`` pages without text are records all the same."""
    chosen = source_files(files, arc, extensions)
    # Pages are parsed once, for metadata and text, in the map that converts the others.
    rows = converted(chosen, about=True).withColumn("text", normalize_text(F.coalesce("markdown", F.lit(""))))
    parts = html.page_section()
    pick = lambda name, other: F.when(_is_page(), parts[name]).otherwise(other).alias(name)
    plain_title = F.coalesce(F.when(strip(F.col("converted_title")) != "", strip(F.col("converted_title"))), stem(F.col("source_file")))
    good = F.col("error").isNull() & ((F.col("text") != "") | (_is_page() if empty_pages else F.lit(False)))
    records = rows.where(good).select(
        "arc",
        "source_file",
        *source_columns(),
        F.when(_is_page(), html.page_title(stem(F.col("source_file")))).otherwise(plain_title).alias("title"),
        pick("section_code", "Uncategorized"),
        pick("section_title", "General"),
        pick("subsection_title", "General"),
        strip(F.coalesce("converted_title", F.lit(""))).alias("markitdown_title"),
        "text",
        F.sha2("text", 256).alias("content_sha256"),
    )
    skips = rows.where(~good).select("arc", "source_file", F.coalesce("error", F.lit("empty conversion result")).alias("error"))
    return records, skips, training_manifest(records, skips, arc, extensions)


def svg_texts(files: DataFrame) -> DataFrame:
    """(arc, path, svg) of SVG files, without XML declaration; undecodable bytes become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "content"):
            text = [(x.as_py() or b"").decode("utf-8", "replace") for x in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("arc"), batch.column("path"), pa.array(text, pa.string())], ["arc", "path", "svg"])

    rows = files.where(extension(F.col("path")) == ".svg").select("arc", "path", "content")
    return rows.mapInArrow(run, "arc string, path string, svg string").withColumn("svg", strip_prolog(F.col("svg")))


def training_manifest(records: DataFrame, skips: DataFrame, arc: str, extensions: list[str]) -> DataFrame:
    """One row of counts; the skips, which may be many, are a table of their own."""
    both = records.select(F.lit(True).alias("good")).unionByName(skips.select(F.lit(False).alias("good")))
    return both.agg(
        F.lit(arc).alias("arc"),
        F.lit(sorted(extensions)).alias("source_extensions"),
        F.count(F.lit(1)).alias("source_count"),
        F.count_if("good").alias("record_count"),
        F.count_if(~F.col("good")).alias("skipped_count"),
    )


def source_documents(files: DataFrame, arc: str, extensions: list[str] = CHUNK_EXTENSIONS) -> DataFrame:
    """Documents with normalised Markdown; empty ones are left out."""
    return _all_documents(files, arc, extensions).where("markdown <> ''")


def _all_documents(files: DataFrame, arc: str, extensions: list[str]) -> DataFrame:
    """The same with empty ones. A test of the Markdown makes it twice, and an empty text has no chunk."""
    chosen = source_files(files, arc, extensions)
    paged = linked_pages(chosen.where(_is_page()), files, None)
    parts = html.page_section()
    pages_ = paged.select("arc", "source_file", "ext", html.page_title(stem(F.col("source_file"))).alias("title"), *[parts[c].alias(c) for c in ("section_code", "section_title", "subsection_title")], without_images(F.col("markdown")).alias("markdown"))
    other = converted(chosen.where(~_is_page())).where("error IS NULL")
    title = F.coalesce(F.when(F.col("converted_title") != "", F.col("converted_title")), stem(F.col("source_file")))
    rest = other.select("arc", "source_file", "ext", title.alias("title"), F.col("arc").alias("section_code"), F.lit("General").alias("section_title"), F.lit("General").alias("subsection_title"), without_images(F.col("markdown")).alias("markdown"))
    both = pages_.unionByName(rest).withColumn("markdown", normalize_text("markdown"))
    return both.select("arc", "source_file", F.regexp_replace("ext", "^\\.", "").alias("source_type"), "title", "section_code", "section_title", "subsection_title", "markdown")


def chunk_export(files: DataFrame, arc: str, wiring_arc: str | None = None, target: int = 900, overlap: int = 120, extensions: list[str] = CHUNK_EXTENSIONS) -> DataFrame:
    """Chunk records of an archive and of its paired wiring archive; a missing pair adds nothing."""
    target, overlap = chunk_settings(target, overlap)
    docs = _all_documents(files, arc, extensions)
    if wiring_arc:
        docs = docs.unionByName(_all_documents(files, wiring_arc, extensions))
    return chunk_records(docs, F.lit(arc.upper()), role_of(F.col("arc"), wiring_arc), target, overlap)


def role_of(arc: Column, wiring_arc: str | None) -> Column:
    """``wiring`` for documents of the paired archive, else ``manual``."""
    return F.when(arc == F.lit((wiring_arc or "").upper()), "wiring").otherwise("manual")


def chunk_manifest(records: DataFrame, settings: dict[str, int]) -> DataFrame:
    return records.agg(
        F.count_distinct("source_path").alias("document_count"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.sort_array(F.collect_set("source_arc")).alias("arcs"),
        *[F.lit(v).alias(k) for k, v in settings.items()],
    )


def page_links(files: DataFrame, arc: str, wiring_arc: str | None) -> DataFrame:
    """(arc, source_file, kind, raw, target, asset) of all references of an archive's pages."""
    return _links(source_files(files, arc, [".htm", ".html"]), files, wiring_arc)


def _links(chosen: DataFrame, files: DataFrame, wiring_arc: str | None) -> DataFrame:
    refs = html.pages(chosen, "content", fields=("refs",)).select("arc", "source_file", F.explode("refs").alias("r")).select("arc", "source_file", F.col("r.kind").alias("ref"), F.col("r.raw").alias("raw"))
    # Both kinds go one way, so that pages are parsed once; what the lookup says of an image is not used.
    linked = F.col("ref") == "href"
    refs = refs.distinct().withColumn("wiring_arc", F.lit(wiring_arc).cast("string"))
    name = basename(F.regexp_extract("raw", "^[^?#]*", 0))
    links = rewritten_links(refs, file_index(files), href="raw")
    return links.select(
        "arc",
        "source_file",
        "raw",
        F.when(linked, F.col("kind")).otherwise("image").alias("kind"),
        F.when(linked, F.col("target")).otherwise(image_source(F.col("raw"))).alias("target"),
        F.when(linked, F.col("asset")).otherwise(F.when(name != "", name)).alias("asset"),
    )


def with_targets(chosen: DataFrame, links: DataFrame) -> DataFrame:
    """Pages with a map column ``targets`` from raw references to rewritten ones."""
    distinct = links.groupBy("arc", "source_file", "raw").agg(F.min("target").alias("target"))
    maps = distinct.groupBy("arc", "source_file").agg(F.map_from_entries(F.collect_list(F.struct("raw", "target"))).alias("targets"))
    return chosen.join(maps, ["arc", "source_file"], "left")


def linked_pages(chosen: DataFrame, files: DataFrame, wiring_arc: str | None) -> DataFrame:
    """meta, heading and Markdown of pages, with their references rewritten as ``page_links`` says.

    Images need no lookup, so a page without links is parsed once and meets no other row. One that may
    have links is parsed for its references, and again when they are looked up."""
    fields, linked = ("meta", "heading", "markdown"), html.with_links(chosen, "content")
    looked_up = html.pages(with_targets(linked, _links(linked, files, wiring_arc)), "content", "targets", fields)
    return looked_up.unionByName(html.pages(chosen, "content", image_target, fields))


def vault_pages(files: DataFrame, arc: str, wiring_arc: str | None = None, links: DataFrame | None = None) -> DataFrame:
    """Pages of a vault: file names, titles, sections, Markdown with front matter and wiki links."""
    chosen = source_files(files, arc, [".htm", ".html"])
    paged = linked_pages(chosen, files, wiring_arc) if links is None else html.pages(with_targets(chosen, links), "content", "targets", ("meta", "heading", "markdown"))
    parts = html.page_section()
    rows = paged.select("arc", "source_file", html.page_title(stem(F.col("source_file"))).alias("title"), *[c.alias(n) for n, c in parts.items()], wikilinks(F.col("markdown")).alias("markdown"))
    head = F.concat_ws("\n", F.lit("---"), _field("title", quoted(F.col("title"))), _field("source_file", F.col("source_file")), _field("arc", F.col("book")), _field("section_code", F.col("section_code")), _field("section_title", quoted(F.col("section_title"))), _field("subsection_title", quoted(F.col("subsection_title"))), F.lit("---"), F.lit(""))
    return rows.withColumn("md_name", F.concat(F.upper(stem(F.col("source_file"))), F.lit(".md"))).withColumn("note", F.concat(head, "markdown"))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'{name}: "'), value, F.lit('"'))


def vault_manifest(pages: DataFrame, assets: DataFrame, wiring_assets: DataFrame, arc: str, wiring_arc: str | None, copy_all: bool) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    about = pages.agg(F.lit(arc).alias("arc"), F.lit(wiring_arc).cast("string").alias("wiring_arc"), F.lit(copy_all).alias("copy_all_wiring_assets"), F.count(F.lit(1)).alias("page_count"))
    # One-row tables side by side.
    return about.join(n(assets, "asset_count"), F.lit(True)).join(n(wiring_assets, "wiring_asset_count"), F.lit(True))


def build_vault(files: DataFrame, arc: str, wiring_arc: str | None = None, copy_all: bool = False) -> dict[str, DataFrame]:
    """pages, alphabetical index, section indexes, summary, assets, wiring assets and manifest.

    Pages and links are persisted, since all results share them: unpersist ``pages`` and ``links``
    when the results are written."""
    from quire.operators.indexes import alphabetical_index, root_index, section_indexes, section_summary

    index, links = file_index(files), page_links(files, arc, wiring_arc).persist()
    pages = vault_pages(files, arc, wiring_arc, links).persist()
    assets = copied_assets(index, links, arc)
    wiring = copied_wiring(index, links, wiring_arc, copy_all) if wiring_arc else assets.where("false")
    return {
        "pages": pages,
        "links": links,
        "alphabetical": alphabetical_index(pages),
        "sections": section_indexes(pages),
        "summary": section_summary(pages),
        "root": root_index(pages, assets, arc.upper()),
        "assets": assets,
        "wiring_assets": wiring,
        "manifest": vault_manifest(pages, assets, wiring, arc.upper(), wiring_arc, copy_all),
    }

