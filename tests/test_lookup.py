"""Lookups, routes, links, ordered rules, scoring, sinks and streams on small tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.operators import indexes, lookup, ordered, scoring
from quire.sources import sinks
from quire.streaming import pages as streams
from tests import encode as e


def index(spark):
    paths = ["SEB/A.HTM", "SEB/a.GIF", "EEB/EEB042001.SVG", "EEB/EEB042002.svg", "EEB/EEB1234001.svg", "SCY/A.htm", "SEB/SEBALPHAINDEX.HTM", "R12/x.htm", "EEQ/q.svg"]
    return lookup.file_index(spark.createDataFrame([(p.split("/")[0], p) for p in paths], "arc string, path string"))


def test_requests(spark):
    asked = ["/", "", "/SEB/A.HTM", "/seb/a.htm", "/SEB/q.SVG", "/SEB", "/seb/", "/nope/a.gif", "/Q.svg", "/nope/zip", "/SEB/A%2EHTM", "/SEB/A.HTM?x=1"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, request string")
    got = {asked[r.i]: (r.rule, r.target) for r in lookup.resolved_requests(rows, index(spark)).collect()}
    assert got["/"] == got[""] == ("home", "/") and got["/SEB/A.HTM"] == got["/SEB/A%2EHTM"] == got["/SEB/A.HTM?x=1"] == ("file", "/SEB/A.HTM")
    assert got["/seb/a.htm"] == ("file_other_case", "/SEB/A.HTM") and got["/SEB/q.SVG"] == ("redirect", "/EEQ/q.svg") and got["/SEB"] == ("folder", "/SEB/")
    assert got["/nope/a.gif"] == ("redirect_anywhere", "/SEB/a.GIF") and got["/Q.svg"] == ("redirect_anywhere", "/EEQ/q.svg") and got["/nope/zip"] == ("missing", None)


def test_sheets(spark):
    asked = spark.createDataFrame([(1, "eeb", "42"), (2, "EEB", "1234"), (3, "EEB", "7"), (4, "EEB", None)], "i int, book string, cell string")
    got = {r.i: (r.first_sheet, r.more_sheets) for r in lookup.wiring_sheets(asked, index(spark)).collect()}
    assert got == {1: ("EEB/EEB042001.SVG", ["EEB/EEB042002.svg"]), 2: ("EEB/EEB1234001.svg", []), 3: (None, []), 4: (None, [])}
    assert lookup.wiring_sheets(asked.limit(0), index(spark)).count() == 0


def test_home_page(spark):
    row = lookup.home_page(spark, index(spark)).first()
    assert row.manuals == "SEB 2014 Mustang /SEB/SEBALPHAINDEX.HTM + Wiring (EEB)\nSCY 2012–2014 Focus /SCY/" and row.unmatched_wiring == "EEQ" and row.recalls == "R12"


def test_links(spark):
    hrefs = ["a.htm", "A.HTM#s", "pic/a.gif?x", "EEB042001.svg", "http://h/a.htm", "//h/a", "mailto:a@b", "#top", "", " ", "x/EP_MAIN.asp?cell=042001", "ep_main.asp?CELL=9", "/t/2colframeset.asp?rightside=R.HTM&leftside=L.htm#f", "2colframeset.asp?leftside=L.htm", "2colframeset.asp", "gone.htm"]
    rows = spark.createDataFrame([(i, "SEB", "EEB", h) for i, h in enumerate(hrefs)], "i int, arc string, wiring_arc string, href string")
    got = {hrefs[r.i]: (r.kind, r.target) for r in lookup.rewritten_links(rows, index(spark)).collect()}
    assert got["a.htm"] == ("page", "a.md") and got["A.HTM#s"] == ("page", "A.md#s") and got["pic/a.gif?x"] == ("asset", "../assets/a.gif")
    assert got["EEB042001.svg"] == ("wiring", "../wiring_assets/EEB042001.svg") and got["x/EP_MAIN.asp?cell=042001"] == ("wiring_sheet", "../wiring_assets/EEB042001.svg")
    assert {got[h] for h in ("http://h/a.htm", "//h/a", "mailto:a@b")} == {("absolute", h) for h in ("http://h/a.htm", "//h/a", "mailto:a@b")}
    assert got["#top"] == ("other", "#top") and got[""] == got[" "] == ("empty", "") and got["gone.htm"] == ("other", "gone.htm")
    assert got["/t/2colframeset.asp?rightside=R.HTM&leftside=L.htm#f"] == ("frameset", "R.md#f") and got["2colframeset.asp?leftside=L.htm"] == ("frameset", "L.md") and got["2colframeset.asp"] == ("other", "2colframeset.asp")
    images = spark.createDataFrame([("x/a.gif?1",), ("x/",), ("",)], "s string").select(lookup.image_source(F.col("s"))).collect()
    assert [r[0] for r in images] == ["../assets/a.gif", "../assets/x", ""]


def test_lookups_join_by_hash(spark):
    requests = spark.createDataFrame([(1, "/a")], "i int, request string")
    plan = lookup.resolved_requests(requests, index(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ordered(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert {(r.k, r.v) for r in ordered.keep_first(rows, ["k"], [F.col("n")]).collect()} == {("a", "x"), ("b", "z")}
    assert {(r.k, r.v) for r in ordered.last_wins(rows, ["k"], ["n"]).collect()} == {("a", "y"), ("b", "z")}
    sizes = spark.createDataFrame([("A", 0, 16, 10), ("A", 1, 26, 4464), ("A", 2, 70026, 5), ("A", 3, 0, 9)], "arc string, entry_index int, data_offset bigint, size bigint").withColumn("archive_size", F.lit(70026 + 5 + 65536))
    assert {r.entry_index: r["size"] for r in ordered.repaired_sizes(sizes).collect()} == {0: 10, 1: 70000, 2: 65541, 3: 9}


def test_score_report(spark, tmp_path):
    text = b"the same text, the same text, the same text"
    good, other = e.block(e.chunk(e.compress(text))), e.block(e.raw_chunk(text[:20] + b"####"))
    report = tmp_path / "report.csv"
    report.write_text('extra,filename,status,remote_url\n1,p/A.HTM,mismatch,u1\n2,b.htm,mismatch,u2\n3,none.htm,mismatch,u3\n4,c.htm,ok,u4\n5,"d,.htm",mismatch,u5\n')
    entries = spark.createDataFrame([("X", 0, "a.htm", good), ("Y", 0, "A.HTM", other), ("X", 1, "b.htm", other), ("X", 2, "d,.htm", good)], "arc string, entry_index int, filename string, raw binary")
    remote = spark.createDataFrame([("u1", text, None), ("u2", text, None), ("u5", None, "timeout")], "remote_url string, content binary, error string")
    scored = scoring.score_report(scoring.read_report(spark, str(report)), entries, remote)
    got = {r.filename: r for r in scored.collect()}
    assert scored.columns == scoring.OUTPUT and set(got) == {"p/A.HTM", "b.htm", "none.htm", "d,.htm"}
    assert got["p/A.HTM"].status == "exact_match" and got["p/A.HTM"].arc == "X" and got["p/A.HTM"].best_first_diff is None
    assert got["b.htm"].status == "best_candidate" and got["b.htm"].best_prefix_match == 20 == got["b.htm"].best_first_diff
    assert got["none.htm"].status == "missing_local_entry" and (got["d,.htm"].status, got["d,.htm"].detail) == ("remote_error", "timeout")
    counts = scoring.status_counts(scored).first()
    assert (counts.exact, counts.best_candidate, counts.errors) == (1, 1, 2)
    assert scoring.mismatches(scoring.read_report(spark, str(report)), 0).count() == 0
    assert {r.file_name for r in scoring.probe(entries, "B.htm").collect()} >= {"b__default.htm"}
    sinks.write_report(scored.coalesce(1), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(scoring.OUTPUT) and len(lines) == 5


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/é.md", "text é"), ("../b.md", None)], "name string, body string")
    sinks.write_jsonl(rows.coalesce(1), str(tmp_path / "json"))
    lines = next((tmp_path / "json").glob("*.json")).read_text().splitlines()
    assert json.loads(lines[1]) == {"name": "../b.md", "body": None} and "é" in lines[0]
    sinks.write_files(rows, str(tmp_path / "files"), "name", "body")
    assert (tmp_path / "files/a/é.md").read_text() == "text é" and os.path.exists(tmp_path / "files/b.md")
    with pytest.raises(ValueError, match="several rows"):
        sinks.write_files(rows.union(rows), str(tmp_path / "files"), "name", "body")
    manifest = rows.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("none"))
    assert json.loads(sinks.manifest_json(manifest)) == {"n": 2, "none": None}
    sinks.write_text("x\n", spark, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == "x\n"


def test_indexes_of_nothing(spark):
    none = spark.createDataFrame([], "title string, source_file string, md_name string, section_code string, section_title string, subsection_title string")
    assert indexes.alphabetical_index(none).first()[0].startswith("# Alphabetical Index") and indexes.section_indexes(none).count() == 0
    assert indexes.section_summary(none).count() == 1


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two "), (3, "three")], "doc_id long, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name).collect()

    assert sorted((r.doc_id, r.body) for r in run(streams.chunk_stream(stream().select("doc_id", "text")), "chunked")) == [(1, "one two"), (2, "one two"), (3, "three")]
    assert len(run(streams.first_seen(stream(), "ts"), "seen")) == 2


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 60


def test_links_without_sheets_are_dealt(spark):
    from pyspark.sql import functions as F

    from quire.operators import lookup

    links = spark.range(400).selectExpr("if(id < 0, 'X', 'SEB') AS arc", "concat('P', id, '.HTM') AS href", "if(id < 0, 'X', 'EEB') AS wiring_arc")
    index = lookup.file_index(spark.range(400).selectExpr("if(id < 0, 'X', 'SEB') AS arc", "concat('SEB/P', id, '.htm') AS path"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = lookup.rewritten_links(links, index)
        assert {r.kind: r.n for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()} == {"page": 400}
        parts = rows.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("target"), F.max("kind")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r.n for r in parts) < 300
