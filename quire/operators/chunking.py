"""Semantic units and overlapping chunks of Markdown, inside each row: no shuffle, no Python.

Time grows with the text: blocks are the matches of one pattern, pieces are packed by a pattern over
a string with a character for each word, and only the chunks of a text, which are few, are folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import SPACE, let, lines, normalize_text, quoted, rstrip, sentences, slug, strip, word_count

TARGET_WORDS, OVERLAP_WORDS, LEAST_WORDS = 900, 120, 300
_SPAN = "array<struct<s:int,e:int>>"


def chunk_settings(words: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> tuple[int, int]:
    """Settings within bounds: at least 300 words, an overlap from 0 to below the words."""
    words, overlap = max(words, LEAST_WORDS), max(overlap, 0)
    return words, overlap if overlap < words else max(1, words // 6)


def _span(s: Column, e: Column) -> Column:
    return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))


# Of lines joined by LF: a heading; a line that neither is one nor opens a fence; a fence with all up to
# the line that closes it, or to the end. Quantifiers are possessive, so matching takes no stack.
_HEADING = f"#{{1,6}}(?!\\n)[{SPACE}]"
_PLAIN = f"(?!```|{_HEADING})[^\\n]++(?:\\n|\\z)"
_FENCE = "```[^\\n]*+(?:\\n(?!```)[^\\n]*+)*+(?:\\n```[^\\n]*+)?+"
_BLOCK = f"(?m)^(?:{_HEADING}[^\\n]*+|(?=[^\\n])(?:{_PLAIN})*+(?:{_FENCE})?+)"
#: Stands between groups of pieces; as a line end it is in none.
_BETWEEN = "\x1e"


def blocks(markdown: Column) -> Column:
    """Blocks of normalised Markdown: a heading is one, empty lines end one, fences stay whole."""
    text = F.array_join(F.transform(lines(markdown), rstrip), "\n")
    return F.transform(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0)), strip)


def packed(pieces: Column, target: int) -> Column:
    """Pieces joined by LF into groups of at most ``target`` words; a larger piece stands alone.

    Each piece is as many characters as it has words, the last one of another kind, so a group is the
    longest match that ends a piece within ``target`` characters."""
    marks = F.array_join(F.transform(pieces, lambda p: F.concat(F.repeat(F.lit("w"), word_count(p) - 1), F.lit("."))), "")
    groups = F.regexp_extract_all(marks, F.lit(f"[w.]{{0,{target - 1}}}\\.|w*+\\."), F.lit(0))
    # One mark for each piece, with a bar after the last of a group.
    ends = F.regexp_extract_all(F.replace(F.array_join(groups, "|"), F.lit("w")), F.lit("\\.\\|?"), F.lit(0))
    text = F.array_join(F.zip_with(pieces, ends, lambda p, e: F.concat(p, F.when(e == ".", "\n").otherwise(_BETWEEN))), "")
    return F.transform(F.split(text, _BETWEEN), strip)


def split_block(block: Column, target: int) -> Column:
    """A block of more than ``target`` words cut at its lines, or at sentences if it is one line."""

    def parts(text: Column) -> Column:
        rows = F.when(F.instr(text, "\n") > 0, lines(text)).otherwise(sentences(text))
        pieces = F.filter(F.transform(rows, strip), lambda x: x != "")
        small = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
        return F.when(word_count(text) <= target, small).otherwise(let(pieces, lambda p: packed(p, target)))

    return let(normalize_text(block), parts)


def semantic_units(markdown: Column, target: int = TARGET_WORDS) -> Column:
    """The units that chunks are made of."""
    whole = F.flatten(F.transform(blocks(normalize_text(markdown)), lambda b: split_block(b, target)))
    return F.filter(whole, lambda u: strip(u) != "")


def chunk_spans(words: Column, target: int, overlap: int) -> Column:
    """1-based (s, e) of the units of each chunk, from the units' word counts.

    A chunk ends before the unit that would take it over ``target``; the next begins at the last
    unit from which its predecessor still has ``overlap`` words, at least one unit back, and always
    takes the unit that did not fit."""

    def fold(counts: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("s"), F.lit(0).alias("words"), F.array().cast(_SPAN).alias("out"))

        def tail(s: Column, before: Column) -> Column:
            """How many of the units from ``s`` to ``before`` are repeated, and their words."""
            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
            more = lambda acc, w: F.struct((acc["n"] + 1).alias("n"), (acc["words"] + w).alias("words"))
            backwards = F.reverse(F.slice(counts, s, before - s + 1))
            return F.aggregate(backwards, none, lambda acc, w: F.when((acc["n"] > 0) & (acc["words"] >= overlap), acc).otherwise(more(acc, w)))

        def step(acc: Column, w: Column) -> Column:
            i = acc["i"] + 1
            grown = F.struct(i.alias("i"), acc["s"].alias("s"), (acc["words"] + w).alias("words"), acc["out"].alias("out"))
            begun = lambda t: F.struct(i.alias("i"), (i - t["n"]).alias("s"), (t["words"] + w).alias("words"), F.concat(acc["out"], _span(acc["s"], i - 1)).alias("out"))
            return F.when((i > acc["s"]) & (acc["words"] + w > target), let(tail(acc["s"], i - 1), begun)).otherwise(grown)

        return F.aggregate(counts, start, step, lambda acc: F.concat(acc["out"], _span(acc["s"], acc["i"])))

    return F.when(F.size(words) > 0, let(words, fold)).otherwise(F.array().cast(_SPAN))


def with_units(docs: DataFrame, markdown: str = "text", target: int = TARGET_WORDS, column: str = "units") -> DataFrame:
    return docs.withColumn(column, F.coalesce(semantic_units(F.col(markdown), target), F.array().cast("array<string>")))


def chunk_structs(markdown: Column, target: int, overlap: int) -> Column:
    """The chunks of a text as structs (place, n, s, e, body): each later row carries its own body only."""

    def of(units: Column) -> Column:
        def cut(spans: Column) -> Column:
            def one(span: Column, i: Column) -> Column:
                body = strip(F.array_join(F.slice(units, span["s"], span["e"] - span["s"] + 1), "\n\n"))
                return F.struct((i + 1).alias("place"), F.size(spans).alias("n"), span["s"].alias("s"), span["e"].alias("e"), body.alias("body"))

            return F.transform(spans, one)

        return let(let(F.transform(units, word_count), lambda words: chunk_spans(words, target, overlap)), cut)

    return let(semantic_units(markdown, target), of)


def chunks(docs: DataFrame, markdown: str = "text", target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """All columns of docs but the text, with chunk_index, chunk_count, start_unit, end_unit,
    chunk_words and ``body`` of each chunk."""
    keep = [c for c in docs.columns if c != markdown]
    rows = docs.select(*keep, F.explode(chunk_structs(F.col(markdown), target, overlap)).alias("_chunk"))
    rows = rows.select(*keep, F.col("_chunk.place").alias("chunk_index"), F.col("_chunk.n").alias("chunk_count"), F.col("_chunk.s").alias("start_unit"), F.col("_chunk.e").alias("end_unit"), F.col("_chunk.body").alias("body"))
    return rows.withColumn("chunk_words", word_count("body"))


def chunk_records(docs: DataFrame, arc: Column, role: Column, target: int = TARGET_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Chunks rendered with their front matter, and the hash of the rendered text.

    ``docs``: arc, source_file, source_type, title, section_code, section_title, subsection_title,
    markdown; other columns are ignored."""
    fields = ["arc", "source_file", "source_type", "title", "section_code", "section_title", "subsection_title"]
    rows = chunks(docs.select(*fields, "markdown", arc.alias("_arc"), role.alias("_role")), "markdown", target, overlap)
    rows = rows.withColumn("chunk_id", F.format_string("%s-%s-%03d", "_role", "source_file", "chunk_index"))
    line = lambda name, value: F.concat(F.lit(f'{name}: "'), value, F.lit('"'))
    number = lambda name: F.concat(F.lit(f"{name}: "), F.col(name).cast("string"))
    head = [
        F.lit("---"),
        line("arc", F.col("_arc")),
        line("source_arc", F.col("arc")),
        line("source_file", F.col("source_file")),
        line("source_type", F.col("source_type")),
        line("title", quoted(F.col("title"))),
        line("section_code", F.col("section_code")),
        line("section_title", quoted(F.col("section_title"))),
        line("subsection_title", quoted(F.col("subsection_title"))),
        line("chunk_id", F.col("chunk_id")),
        *map(number, ("chunk_index", "chunk_count", "chunk_words")),
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("# "), "title"),
        F.lit(""),
        F.concat(F.lit("> Source: "), "arc", F.lit("/"), "source_file"),
        F.concat(F.lit("> Section: "), "section_code", F.lit(" - "), "section_title"),
        F.concat(F.lit("> Subsection: "), "subsection_title"),
        F.concat(F.lit("> Chunk: "), F.col("chunk_index").cast("string"), F.lit("/"), F.col("chunk_count").cast("string")),
        F.lit(""),
        F.col("body"),
        F.lit(""),
    ]
    made = rows.withColumn("text", F.concat_ws("\n", *head))
    name = F.format_string("%s-%03d.md", slug(F.concat("arc", F.lit("-"), "source_file")), "chunk_index")
    return made.select(
        "chunk_id",
        F.col("_arc").alias("arc"),
        F.col("arc").alias("source_arc"),
        "source_file",
        "source_type",
        F.concat("arc", F.lit("/"), "source_file").alias("source_path"),
        *fields[3:],
        "chunk_index",
        "chunk_count",
        "chunk_words",
        "text",
        F.sha2("text", 256).alias("content_sha256"),
        name.alias("file_name"),
    )
