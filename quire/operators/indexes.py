"""Alphabetical and section indexes of pages, as ordered text built by aggregates.

``pages``: title, source_file, md_name, section_code, section_title, subsection_title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import index_letter, or_default, safe_file_name, wikilink


def _link() -> Column:
    return F.concat(F.lit("- "), wikilink(F.col("title"), F.col("md_name")))


def _in_order(*order: Column) -> Column:
    """Lines of a group in order, joined by LF."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], _link().alias("line"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["line"]), "\n")


def _texts(rows: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(rows), lambda x: x["line"]), "\n\n")


def alphabetical_groups(pages: DataFrame) -> DataFrame:
    """letter, n_pages and the ordered links of each letter."""
    return pages.groupBy(index_letter(F.col("title")).alias("letter")).agg(F.count(F.lit(1)).alias("n_pages"), _in_order(F.lower("title"), F.col("source_file")).alias("links"))


INDEX_ORDER = ["letter", "part", "title_key", "source_file"]


def alphabetical_lines(pages: DataFrame) -> DataFrame:
    """The alphabetical index as a table of lines, in the order of ``INDEX_ORDER``: a heading a letter,
    then its links. No letter is gathered into one row, so any number of pages will do."""
    links = pages.select(index_letter(F.col("title")).alias("letter"), F.lit(1).alias("part"), F.lower("title").alias("title_key"), "source_file", _link().alias("line"))
    heads = links.select("letter").distinct().select("letter", F.lit(0).alias("part"), F.lit("").alias("title_key"), F.lit("").alias("source_file"), F.concat(F.lit("## "), "letter").alias("line"))
    return heads.unionByName(links)


def alphabetical_index(pages: DataFrame) -> DataFrame:
    """One row: the index as Markdown."""
    groups = alphabetical_groups(pages).select(F.struct("letter", F.concat(F.lit("## "), "letter", F.lit("\n"), "links").alias("line")).alias("g"))
    return groups.agg(F.concat(F.lit("# Alphabetical Index\n\n"), _texts(F.collect_list("g")), F.lit("\n")).alias("markdown"))


def section_groups(pages: DataFrame) -> DataFrame:
    """section_code, section_title, subsection, n_pages and ordered links."""
    sub = or_default(F.col("subsection_title"), "General")
    return pages.groupBy("section_code", "section_title", sub.alias("subsection")).agg(F.count(F.lit(1)).alias("n_pages"), _in_order(F.lower("title"), F.col("source_file")).alias("links"))


def section_indexes(pages: DataFrame) -> DataFrame:
    """A row per section: its file name, page count and Markdown."""
    subs = section_groups(pages).withColumn("g", F.struct("subsection", F.concat(F.lit("## "), "subsection", F.lit("\n"), "links").alias("line")))
    made = subs.groupBy("section_code", "section_title").agg(F.sum("n_pages").alias("n_pages"), F.collect_list("g").alias("gs"))
    title = F.concat("section_code", F.lit(" - "), "section_title")
    name = F.concat(safe_file_name(F.concat("section_code", F.lit(" "), "section_title")), F.lit(".md"))
    return made.select("section_code", "section_title", name.alias("file_name"), "n_pages", F.concat(F.lit("# "), title, F.lit("\n\n"), _texts(F.col("gs")), F.lit("\n")).alias("markdown"))


def section_summary(pages: DataFrame) -> DataFrame:
    """One row: links to the section indexes with their page counts."""
    counts = pages.groupBy("section_code", "section_title").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat(safe_file_name(F.concat("section_code", F.lit(" "), "section_title")), F.lit(".md"))
    link = wikilink(F.concat("section_code", F.lit(" - "), "section_title"), name)
    line = F.concat(F.lit("- "), link, F.lit(" ("), F.col("n").cast("string"), F.lit(" pages)"))
    rows = F.collect_list(F.struct("section_code", "section_title", line.alias("line")))
    return counts.agg(F.concat(F.lit("# Section Index\n\n"), F.array_join(F.transform(F.sort_array(rows), lambda x: x["line"]), "\n"), F.lit("\n")).alias("markdown"))


def root_index(pages: DataFrame, assets: DataFrame, arc: str) -> DataFrame:
    """One row: the counts of a bundle as Markdown, without a date."""
    n_pages, n_assets = pages.agg(F.count(F.lit(1)).alias("p")), assets.agg(F.count(F.lit(1)).alias("a"))
    text = F.concat(F.lit(f"# {arc} Manual Bundle\n\nPages: "), F.col("p").cast("string"), F.lit("\nAssets copied: "), F.col("a").cast("string"), F.lit("\n"))
    return n_pages.join(n_assets, F.lit(True)).select(text.alias("markdown"))
