"""The command line: ``python -m quire.cli COMMAND ...``; each command is a few calls of the library.

list, extract, probe and score take archives; vault, training and chunks take a table or folder of
extracted files; route and sheets answer requests from a file. Exit code 1: nothing matched."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import basename
from quire.operators import corpora, lookup, ordered, scoring
from quire.operators.chunking import OVERLAP_WORDS, TARGET_WORDS, chunk_settings
from quire.sources import archive, sinks


def extracted_files(spark: SparkSession, root: str) -> DataFrame:
    """(arc, path, content) of files under ``root/ARC/name``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    arc = F.upper(F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    return files.select(arc.alias("arc"), F.concat(arc, F.lit("/"), basename(F.col("path"))).alias("path"), "content")


def _show(rows: DataFrame) -> None:
    """Rows as tab-separated lines, streamed from the executors."""
    print("\t".join(rows.columns))
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def list_archives(spark: SparkSession, a: argparse.Namespace) -> int:
    entries = archive.list_entries(archive.archives(spark, a.input))
    _show(archive.extension_histogram(entries).orderBy("ext"))
    if a.ext:
        _show(entries.where(archive.extension(F.col("filename")).isin(archive.wanted_extensions(a.ext))))
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    files, ext = archive.archives(spark, a.input), archive.wanted_extensions(a.ext) if a.ext else None
    rows = archive.extracted(archive.read_raw(spark, a.input, ext)).where("error IS NULL")
    # Of archives of one name the last by path stays.
    rows = ordered.last_wins(rows, ["arc", "filename"], ["path"])
    sinks.write_files(rows.withColumn("name", F.concat("arc", F.lit("/"), "filename")), a.output, "name", "payload")
    _show(archive.extract_totals(files, ext))
    return 0


def probe(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = scoring.probe(archive.read_raw(spark, a.input), a.name)
    if rows.isEmpty():
        return 1
    # Of archives of one name the last by path stays.
    rows = ordered.last_wins(rows, ["arc", "entry_index", "file_name"], ["path"])
    sinks.write_files(rows.withColumn("out", F.concat("arc", F.lit("/"), "entry_index", F.lit("/"), "file_name")), a.output, "out", "payload")
    _show(rows.select("arc", "entry_index", "variant", F.octet_length("payload").alias("n_bytes"), "sha256"))
    return 0


def score(spark: SparkSession, a: argparse.Namespace) -> int:
    """Trusted copies are a Parquet table (remote_url, content, error)."""
    report = scoring.read_report(spark, a.report)
    if scoring.mismatches(report, a.limit).isEmpty():
        return 1
    scored = scoring.score_report(report, archive.read_raw(spark, a.input), spark.read.parquet(a.remote), a.limit)
    sinks.write_report(scored.coalesce(1), a.output)
    _show(scoring.status_counts(spark.read.csv(a.output, header=True)))
    return 0


def vault(spark: SparkSession, a: argparse.Namespace) -> int:
    files, wiring = extracted_files(spark, a.root), a.wiring_arc or lookup.WIRING_OF_MANUAL.get(a.arc.upper())
    made, out = corpora.build_vault(files, a.arc, wiring, a.copy_all), f"{a.output}/{a.arc.upper()}"
    sinks.write_files(made["pages"], f"{out}/pages", "md_name", "note")
    sinks.write_files(made["sections"], f"{out}/indexes/sections", "file_name", "markdown")
    for name, key in (("Alphabetical Index", "alphabetical"), ("Section Index", "summary"), ("Index", "root")):
        sinks.write_text(made[key].first()[0], spark, f"{out}/indexes/{name}.md")
    for folder, key, arc in (("assets", "assets", a.arc), ("wiring_assets", "wiring_assets", wiring or "")):
        named = files.where(F.col("arc") == arc.upper()).withColumn("name", basename(F.col("path")))
        sinks.write_files(named.join(made[key], "name", "left_semi"), f"{out}/{folder}", "name", "content")
    sinks.write_text(sinks.manifest_json(made["manifest"]), spark, f"{out}/manifest.json")
    for key in ("pages", "links"):
        made[key].unpersist()
    if a.zip:
        print(sinks.zip_folder(out))
    return 0


def training(spark: SparkSession, a: argparse.Namespace) -> int:
    ext = archive.wanted_extensions(a.ext, tuple(corpora.TRAINING_EXTENSIONS))
    records, skips, manifest = corpora.training_corpus(extracted_files(spark, a.root), a.arc, ext)
    sinks.write_jsonl(records, f"{a.output}/{a.arc.upper()}/training_corpus", order=["source_path"])
    sinks.write_jsonl(skips, f"{a.output}/{a.arc.upper()}/skipped", order=["source_file"])
    sinks.write_text(sinks.manifest_json(manifest), spark, f"{a.output}/{a.arc.upper()}/manifest.json")
    return 0


def chunks(spark: SparkSession, a: argparse.Namespace) -> int:
    ext, arc = archive.wanted_extensions(a.ext, tuple(corpora.CHUNK_EXTENSIONS)), a.arc.upper()
    wiring = None if a.no_wiring else lookup.WIRING_OF_MANUAL.get(arc)
    target, overlap = chunk_settings(a.target_words, a.overlap_words)
    out = f"{a.output}/{arc}"
    corpora.chunk_export(extracted_files(spark, a.root), arc, wiring, target, overlap, ext).write.parquet(f"{out}/records")
    # The records are read back, so that three sinks cost one pass over the pages.
    records = spark.read.parquet(f"{out}/records")
    sinks.write_jsonl(records.drop("file_name"), f"{out}/chunks", order=["source_path", "chunk_index"])
    sinks.write_files(records, f"{out}/notes", "file_name", "text")
    sinks.write_text(sinks.manifest_json(corpora.chunk_manifest(records, {"target_words": target, "overlap_words": overlap})), spark, f"{out}/manifest.json")
    return 0


def route(spark: SparkSession, a: argparse.Namespace) -> int:
    index = lookup.file_index(extracted_files(spark, a.root).select("arc", "path"))
    _show(lookup.resolved_requests(spark.read.text(a.requests).withColumnRenamed("value", "request"), index))
    return 0


def sheets(spark: SparkSession, a: argparse.Namespace) -> int:
    index = lookup.file_index(extracted_files(spark, a.root).select("arc", "path"))
    asked = spark.createDataFrame([(a.book, a.cell)], "book string, cell string")
    found = lookup.wiring_sheets(asked, index)
    _show(found)
    return int(found.where("first_sheet IS NOT NULL").isEmpty())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        one = commands.add_parser(name)
        one.set_defaults(run=run)
        for flags, options in arguments:
            one.add_argument(*flags, **options)

    opt = lambda *flags, **options: (flags, options)
    ext = opt("-e", "--ext", action="append")
    output = opt("-o", "--output", default="extracted")
    export = (opt("--arc", required=True), opt("--root", default="extracted"), opt("-o", "--output", required=True))
    command("list", list_archives, opt("input"), ext)
    command("extract", extract, opt("input"), output, ext)
    command("probe", probe, opt("input"), opt("name"), output)
    command("score", score, opt("input"), opt("report"), opt("remote"), output, opt("--limit", type=int))
    command("vault", vault, *export, opt("--wiring-arc"), opt("--copy-all", action="store_true"), opt("--zip", action="store_true"))
    command("training", training, *export, opt("--ext"))
    command("chunks", chunks, *export, opt("--ext"), opt("--no-wiring", action="store_true"), opt("--target-words", type=int, default=TARGET_WORDS), opt("--overlap-words", type=int, default=OVERLAP_WORDS))
    command("route", route, opt("--root", default="extracted"), opt("requests"))
    command("sheets", sheets, opt("--root", default="extracted"), opt("book"), opt("cell"))
    return top


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
