"""The command line from archives to corpora."""

import json
import zipfile

from quire import cli
from quire.operators import corpora
from tests import encode as e

HEAD = b'<html><head><meta name="tps_system" content="2"><meta name="tps_group" content="06"><meta name="tps_section" content="01"></head><body>'


def test_from_archive_to_corpora(spark, tmp_path, capsys):
    (tmp_path / "arcs").mkdir()
    entries = [(b"A.HTM", e.block(e.chunk(e.compress(HEAD + b'<h1>Alpha</h1><a href="b.htm">b</a><img src="P.GIF"></body></html>')))), (b"B.HTM", e.block(e.raw_chunk(HEAD + b"<h1>Beta</h1>text</body></html>"))), (b"P.GIF", e.block(e.raw_chunk(b"GIF89a")))]
    (tmp_path / "arcs/SEB.arc").write_bytes(e.directory_archive(entries))
    (tmp_path / "arcs/EEB.arc").write_bytes(e.directory_archive([(b"EEB042001.SVG", e.block(e.raw_chunk(b'<?xml version="1.0"?><svg/>')))]))
    root, out = str(tmp_path / "files"), str(tmp_path / "out")
    assert cli.main(["list", str(tmp_path / "arcs"), "-e", "htm"]) == 0 and "B.HTM" in capsys.readouterr().out
    assert cli.main(["extract", str(tmp_path / "arcs"), "-o", root]) == 0
    assert (tmp_path / "files/SEB/P.GIF").read_bytes() == b"GIF89a"
    assert cli.main(["probe", str(tmp_path / "arcs"), "none.htm", "-o", out]) == 1
    assert cli.main(["probe", str(tmp_path / "arcs"), "a.htm", "-o", out]) == 0
    assert cli.main(["vault", "--arc", "seb", "--root", root, "-o", f"{out}/v", "--zip"]) == 0
    assert "[[b]]" in (tmp_path / "out/v/SEB/pages/A.md").read_text() and (tmp_path / "out/v/SEB/assets/P.GIF").exists()
    assert "[[A|Alpha]]" in (tmp_path / "out/v/SEB/indexes/Alphabetical Index.md").read_text()
    assert json.loads((tmp_path / "out/v/SEB/manifest.json").read_text())["page_count"] == 2
    assert "pages/A.md" in zipfile.ZipFile(next((tmp_path / "out/v").glob("SEB-*.zip"))).namelist()
    assert cli.main(["training", "--arc", "SEB", "--root", root, "-o", f"{out}/t"]) == 0
    assert json.loads((tmp_path / "out/t/SEB/manifest.json").read_text())["record_count"] == 2
    assert cli.main(["chunks", "--arc", "SEB", "--root", root, "-o", f"{out}/c"]) == 0
    assert {p.name for p in (tmp_path / "out/c/SEB/notes").iterdir()} == {"SEB-A.HTM-001.md", "SEB-B.HTM-001.md"}
    (tmp_path / "asked.txt").write_text("/seb/a.htm\n/none\n")
    capsys.readouterr()
    assert cli.main(["route", "--root", root, str(tmp_path / "asked.txt")]) == 0 and "file_other_case\t/SEB/A.HTM" in capsys.readouterr().out
    assert cli.main(["sheets", "--root", root, "EEB", "42"]) == 0 and cli.main(["sheets", "--root", root, "EEB", "7"]) == 1
    assert [r.svg for r in corpora.svg_texts(cli.extracted_files(spark, root)).collect()] == ["<svg/>"]
