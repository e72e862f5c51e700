"""Archives: both containers through SQL, through the data source, and their totals."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import binary as B
from quire.sources import archive as a
from tests import encode as e

BIG = e.random_bytes(random.Random(1), 70_000)
PAGE, LARGER = b"<html><body>one</body></html>", b"<html><body>a larger page</body></html>"
BLOCKS = [b"<workunit>\n<FileName> MAIN.HTM </FileName></workunit>", PAGE, LARGER, b"GIF89a....", b"GIF89a,,,,", b"; wires", b".p {color: red}", b"\x00\x01binary"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("arcs")
    entries = [(b"A.HTM", e.block(e.raw_chunk(b"<html>a</html>"))), (b"BIG.BIN", BIG), (b"caf\xe9.txt", b"plain"), (b"EMPTY.TXT", b""), (b"A.HTM", e.block(e.chunk(e.compress(b"second second second")))), (b"NOWHERE", b"x"), (b"BAD.BIN", e.block(e.chunk(e.ops([("lit", 1), ("copy", 99, 4)]))))]
    (path / "SEB.arc").write_bytes(e.directory_archive(entries, zero=frozenset([5])))
    (path / "EMP.ARC").write_bytes(e.directory_archive([]))
    (path / "BLK.arc").write_bytes(e.blocks_archive(BLOCKS))
    (path / "ONE.arc").write_bytes(e.blocks_archive([PAGE, b"%PDF-1"]))
    (path / "odd.arc").write_bytes(b"something else")
    (path / "note.txt").write_bytes(b"no archive")
    return str(path)


NAMES = {
    ("SEB", 0): "A.HTM", ("SEB", 1): "BIG.BIN", ("SEB", 2): "file_00002", ("SEB", 3): "EMPTY.TXT", ("SEB", 4): "A.HTM", ("SEB", 5): "NOWHERE", ("SEB", 6): "BAD.BIN",
    ("BLK", 1): "MAIN_1.htm", ("BLK", 2): "MAIN.HTM", ("BLK", 3): "blk_1.gif", ("BLK", 4): "blk_2.gif", ("BLK", 5): "blk.wcf", ("BLK", 6): "MAINs.htm", ("BLK", 7): "blk_1.bin",
    ("ONE", 0): "one_1.htm", ("ONE", 1): "one_1.pdf",
}


def test_entries(spark, folder):
    files = a.archives(spark, folder)
    rows = a.list_entries(files).collect()
    assert {(r.arc, r.entry_index): r.filename for r in rows} == NAMES
    assert next(r.size for r in rows if r.filename == "BIG.BIN") == len(BIG)
    assert [r.arc for r in a.skipped_archives(files).collect()] == ["odd"]


def test_extract(spark, folder):
    rows = {(r.arc, r.filename): r for r in a.extract(a.archives(spark, folder)).collect()}
    assert bytes(rows["SEB", "A.HTM"].payload) == b"second second second"
    assert bytes(rows["SEB", "BIG.BIN"].payload) == BIG and bytes(rows["SEB", "file_00002"].payload) == b"plain"
    assert bytes(rows["BLK", "MAIN.HTM"].payload) == LARGER and bytes(rows["ONE", "one_1.htm"].payload) == PAGE
    assert rows["SEB", "BAD.BIN"].error and ("SEB", "NOWHERE") not in rows and ("SEB", "EMPTY.TXT") not in rows
    only = a.extract(a.archives(spark, folder), [".htm"]).select("filename").collect()
    assert {r[0].lower()[-4:] for r in only} == {".htm"}


def test_totals(spark, folder):
    totals = {r.arc: r for r in a.extract_totals(a.archives(spark, folder)).collect()}
    assert totals["SEB"].n_files == 4 and totals["SEB"].n_skipped == 3
    assert totals[None].n_files == sum(t.n_files for k, t in totals.items() if k)
    hist = {r.ext: r.n_files for r in a.extension_histogram(a.list_entries(a.archives(spark, folder))).collect()}
    assert hist[".htm"] == 6 and hist[".gif"] == 2 and hist[""] == 2


def test_data_source(spark, folder):
    a.register(spark)
    rows = spark.read.format("archive").load(folder).collect()
    assert {(r.arc, r.entry_index): r.filename for r in rows} == NAMES
    both = spark.read.format("archive").option("payload", "true").option("rangeBytes", "50000").load(folder)
    assert both.rdd.getNumPartitions() > 3
    sql = {(r.arc, r.entry_index): bytes(r.raw) for r in a.with_raw(a.archives(spark, folder)).collect()}
    assert {(r.arc, r.entry_index): bytes(r.raw) for r in both.collect() if r.raw} == sql
    some = both.where((F.col("filename") == "A.HTM") & (F.col("arc") == "SEB"))
    assert some.count() == 2


def test_archives_of_one_name(spark, tmp_path):
    """Two folders hold archives of one name: each entry gets the bytes of its own."""
    for folder, text in (("x", b"first"), ("y", b"second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "SEB.arc").write_bytes(e.directory_archive([(b"A.TXT", text), (b"B.TXT", text * 2)]))
    for rows in (a.extract(a.archives(spark, str(tmp_path))), a.extracted(a.read_raw(spark, str(tmp_path)))):
        got = sorted((r.path.split("/")[-2], r.filename, bytes(r.payload)) for r in rows.collect())
        assert got == [("x", "A.TXT", b"first"), ("x", "B.TXT", b"firstfirst"), ("y", "A.TXT", b"second"), ("y", "B.TXT", b"secondsecond")]
    totals = a.extract_totals(a.archives(spark, str(tmp_path))).collect()
    assert sorted((r.n_files, r.n_bytes) for r in totals) == [(2, 15), (2, 18), (4, 33)]


def test_entries_are_cut_in_the_scan(spark, folder):
    plan = a.with_raw(a.archives(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_only_wanted_entries_are_read(spark, folder, monkeypatch):
    reader = a.ArchiveReader(folder, True, 1 << 20, [".htm"])
    names = [x.name for p in reader.partitions() for x in p.entries]
    assert names and all(n.lower().endswith(".htm") for n in names)
    rows = a.read_raw(spark, f"file://{folder}", [".htm"]).collect()
    assert sorted(r.filename for r in rows) == sorted(names)


def test_both_sniffers():
    import itertools

    for prefixes, fold, braced, ext in B.SIGNATURES:
        for prefix in prefixes:
            assert B.sniffed(prefix + b" {") == ext and (not fold or B.sniffed(prefix.upper()) == ext)
            assert not braced or b"{" in prefix or B.sniffed(prefix) != ext
    assert B.sniffed(b"") == ".bin" and len(list(itertools.chain(*(p for p, *_ in B.SIGNATURES)))) == 19


def test_wanted_extensions():
    assert a.wanted_extensions("htm, .PDF,,") == [".htm", ".pdf"]
    assert a.wanted_extensions(None, (".x",)) == [".x"] == a.wanted_extensions(" , ", (".x",))


def test_small_archives_share_ranges(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"A{i}.arc").write_bytes(e.directory_archive([(b"A.TXT", b"x" * 400), (b"B.TXT", b"%d" % i)]))
    reader = a.ArchiveReader(str(tmp_path), True, 20_000, [])
    ranges = reader.partitions()
    assert len(ranges) < 12 and sum(len(p.entries) for p in ranges) == 200
    rows = [r for p in ranges for r in reader.read(p)]
    assert sorted((r[1], r[6]) for r in rows if r[3] == "B.TXT") == sorted((f"A{i}", b"%d" % i) for i in range(100))
    assert sum(r[6] == b"x" * 400 for r in rows) == 100
