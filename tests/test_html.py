"""Pages: metadata, titles, structure, Markdown, tables, links, vaults."""

import pytest
from pyspark.sql import functions as F

from quire.functions import html as h
from quire.operators import corpora

META = '<head><meta NAME="TPS_System" content=" 2 "><meta name="tps_group" content="06"><meta name="tps_section" content="03A"><meta name="tps_system" content="9"><meta name="tps_section_title" content="Brakes"><meta name="tps_bookcode" content="SEB"><title>T</title></head>'


def md(text):
    return h.markdown_of(h.body_of(h.parse(text)))


def test_metadata_and_headings():
    root = h.parse(META + "<body><h1><img src=x></h1><h2> A <b>b</b>\n c</h2></body>")
    assert h.metadata(root)["tps_system"] == "2" and h.metadata(root)["tps_section_title"] == "Brakes"
    assert h.headings(root) == ["", "A b c", "", "", "T"]


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h2>Head</h2><p>One <b>two</b> <i>three</i></p>", "## Head\n\nOne **two** *three*\n"),
        ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n- b\n  - c\n"),
        ("<ol start=3><li>go <b>on</b></li></ol>", "**3.** go **on**\n"),
        ("<ol><li>a<li>b</ol>", "1. a\n2. b\n"),
        ("<ul> <img src='a.gif'> </ul>", "![](a.gif)\n"),
        ("<p>see <span class='x popup'>this</span><script>no()</script></p>", "see this\n"),
        ("<table><th>H1</th><th>H2</th><tr><td>1<td>2</tr></table>", "| H1 | H2 |\n| --- | --- |\n| 1 | 2 |\n"),
        ("<a href='x.md' title='t'>l</a> a<br>b", '[l](x.md "t") a\nb\n'),
        ("<pre>a\n  b</pre><blockquote><p>q</p></blockquote><hr>", "```\na\n  b\n```\n\n> q\n\n---\n"),
        ("", "\n"),
        ("<p>unclosed <b>bold", "unclosed **bold**\n"),
    ],
)
def test_markdown(html, markdown):
    assert md(html) == markdown


def test_references_end_in_a_semicolon():
    root = h.parse('<title>a&amp</title><h1>x &amp;&amp y&lt &lt; &#x27;&#x2 &ltz; &copy;&no; <script>a && b&lt;</script></h1><a href="?a=1&copy=2&amp;b">l</a>')
    assert h.headings(root) == ["x &&amp y&lt < '&#x2 &ltz; ©&no; a && b&lt;", "", "", "", "a&amp"]
    assert h.references(root) == [("href", "?a=1&copy=2&b")]


def test_titles_cut_inside_a_reference(spark):
    rows = h.pages(spark.createDataFrame([("<h1>by eroninnt&amp</h1>",)], "html string"), fields=("meta", "heading"))
    assert [r.title for r in rows.select(h.page_title(F.lit("P")).alias("title")).collect()] == ["by eroninnt&amp"]


def test_training_titles_cut_inside_a_reference(spark):
    files = spark.createDataFrame([("PAG", "PAG/P1.HTM", b"<h1>a &quot; b&quot</h1>")], "arc string, path string, content binary")
    assert [r.title for r in corpora.training_corpus(files, "PAG")[0].collect()] == ['a " b&quot']


def test_deep_pages():
    deep = lambda tag, n: f"<h1>t</h1>{f'<{tag}>' * n}x{f'</{tag}>' * n}"
    assert md(deep("div", 3000)) == "# t\n\nx\n" and md(deep("span", 20_000)) == "# t\n\nx\n"
    assert md("<ul><li>" * 400 + "x").endswith("- x\n")
    assert md("<blockquote>" * 1200 + "x").endswith("> x\n")


def test_every_page_is_a_training_record(spark, tmp_path):
    from quire.plans import page_queries

    pages = [(1, None), (2, ""), (3, "<title>only</title><body></body>"), (4, "<h1>deep</h1>" + "<div>" * 2000 + "x"), (5, "<h1>h</h1>text")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = page_queries.training_records(spark, str(tmp_path)).collect()
    assert {r.source_file: r.title for r in rows} == {"P1.HTM": "P1", "P2.HTM": "P2", "P3.HTM": "only", "P4.HTM": "deep", "P5.HTM": "h"}


def test_pipe_tables():
    assert h.normalize_pipe_tables("a | b || c | d") == "| a | b |\n| --- | --- |\n| c | d |"
    fine = "| a | b |\n|---|---|\n| c | d |"
    assert h.normalize_pipe_tables(fine) == fine
    assert h.normalize_pipe_tables("| only |") == "| only |"
    assert h.normalize_pipe_tables("x || y") == "x || y"
    assert h.normalize_pipe_tables("text\n| a |\n| b |\ntext") == "text\n| a |\n| --- |\n| b |\ntext"
    assert h.normalize_pipe_tables("a \\| b || c \\| d") == "a \\| b || c \\| d"
    assert h.normalize_pipe_tables("a | b || c | d || e | f").split("\n") == ["| a | b |", "| --- | --- |", "| c | d |", "| e | f |"]


def files(spark):
    page = lambda title, body: f'{META.replace("<title>T", f"<title>{title}")}<body>{body}</body>'.encode()
    rows = [
        ("SEB", "SEB/one.htm", page("One", '<h1>One "1"</h1><a href="TWO.HTM#x">two</a> <a href="http://x/y">web</a> <img src="pic/A.gif" alt=" a "> <a href="W1.svg">w</a>')),
        ("SEB", "SEB/TWO.htm", b"<body>\xff<p>second</p></body>"),
        ("SEB", "SEB/A.GIF", b"GIF89a"),
        ("SEB", "SEB/note.txt", b"plain note"),
        ("SEB", "SEB/x.pdf", b"%PDF"),
        ("SEB", "SEB/none.txt", b"  \n"),
        ("EEB", "EEB/W1.svg", b"<svg/>"),
        ("EEB", "EEB/W2.svg", b"<svg/>"),
        ("EEB", "EEB/p.htm", b"<body><h1>Wires</h1>wired</body>"),
    ]
    return spark.createDataFrame(rows, "arc string, path string, content binary")


def test_training_corpus(spark):
    records, skips, manifest = corpora.training_corpus(files(spark), "seb")
    got = {r.source_file: r for r in records.collect()}
    assert set(got) == {"one.htm", "TWO.htm", "note.txt"} and got["one.htm"].section_code == "206-03A"
    assert got["TWO.htm"].title == "TWO" and got["note.txt"].title == "note" and got["note.txt"].text == "plain note"
    assert {(r.source_file, r.error) for r in skips.collect()} == {("x.pdf", "no converter for .pdf"), ("none.txt", "empty conversion result")}
    m = manifest.first()
    assert (m.source_count, m.record_count, m.skipped_count) == (5, 3, 2)


def test_chunk_export(spark):
    rows = corpora.chunk_export(files(spark), "SEB", "EEB").collect()
    assert {(r.source_arc, r.chunk_id) for r in rows} == {("SEB", "manual-one.htm-001"), ("SEB", "manual-TWO.htm-001"), ("EEB", "wiring-p.htm-001")}
    text = next(r.text for r in rows if r.source_file == "one.htm")
    assert 'title: "One \\"1\\""' in text and "[two](TWO.md#x)" in text and "> Chunk: 1/1" in text and "![" not in text
    m = corpora.chunk_manifest(corpora.chunk_export(files(spark), "SEB", None), {"target_words": 900}).first()
    assert (m.document_count, m.chunk_count, m.arcs, m.target_words) == (2, 2, ["SEB"], 900)


def test_vault(spark):
    vault = corpora.build_vault(files(spark), "SEB", "EEB")
    pages = {r.md_name: r for r in vault["pages"].collect()}
    note = pages["ONE.md"].note
    assert note.startswith('---\ntitle: "One \\"1\\""\n') and "[[TWO#x|two]]" in note and "[web](http://x/y)" in note
    assert "![a](../assets/A.gif)" in note and "[w](../wiring_assets/W1.svg)" in note
    assert {r.name for r in vault["assets"].collect()} == {"A.GIF", "x.pdf"} and {r.name for r in vault["wiring_assets"].collect()} == {"W1.svg"}
    assert {r.name for r in corpora.build_vault(files(spark), "SEB", "EEB", copy_all=True)["wiring_assets"].collect()} == {"W1.svg", "W2.svg"}
    m = vault["manifest"].first()
    assert (m.page_count, m.asset_count, m.wiring_asset_count) == (2, 2, 1)
    assert vault["alphabetical"].first()[0] == '# Alphabetical Index\n\n## O\n- [[ONE|One "1"]]\n\n## T\n- [[TWO]]\n'
    assert "206-03A - Brakes" in vault["summary"].first()[0]


def test_rows_of_a_small_file_are_dealt(spark, tmp_path):
    from quire.plans import container_queries

    rows = spark.range(200).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "7 AS p_size", "1D AS p_retailprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = container_queries.part_html(spark, str(tmp_path))
    assert pages.count() == 200 and pages.select(F.spark_partition_id()).distinct().count() > 8


def test_batches_are_cut_by_bytes(spark):
    import pyarrow as pa

    from quire.functions.batches import pieces

    values = [b"x" * 3, None, b"x" * 4, b"x" * 9, b"", b"x", b"x"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "v": values})
    cut = list(pieces(iter([batch, batch.slice(0, 0)]), "v", 6))
    assert [p.column("i").to_pylist() for p in cut] == [[0, 1], [2], [3], [4, 5, 6]]
    # What a map of long texts makes comes in batches of some of them, not in one.
    files = spark.createDataFrame([("A", f"A/{i}.txt", b"y" * (1 << 20)) for i in range(12)], "arc string, path string, content binary").coalesce(1)
    sizes = corpora.converted(corpora.source_files(files, "A", [".txt"])).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sum(r.n for r in sizes.collect()) == 12


def test_training_runs_one_python_stage(spark):
    records, skips, _ = corpora.training_corpus(files(spark), "SEB")
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {r.source_file for r in records.collect()} == {"one.htm", "TWO.htm", "note.txt"}


def test_links_parse_pages_once(spark):
    links = corpora.page_links(files(spark), "SEB", "EEB")
    assert links._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.raw, r.kind, r.target, r.asset) for r in links.where("source_file = 'one.htm'").collect()}
    assert got == {("TWO.HTM#x", "page", "TWO.md#x", None), ("http://x/y", "absolute", "http://x/y", None), ("W1.svg", "wiring", "../wiring_assets/W1.svg", "W1.svg"), ("pic/A.gif", "image", "../assets/A.gif", "A.gif")}


def test_chunks_make_markdown_once(spark):
    rows = spark.createDataFrame([("A", "A/e.htm", b""), ("A", "A/p.htm", b"<p>text</p>")], "arc string, path string, content binary")
    made = corpora.chunk_export(rows, "A")
    tests = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert tests and not any("trim(" in line for line in tests)
    assert [r.source_file for r in made.collect()] == ["p.htm"] == [r.source_file for r in corpora.source_documents(rows, "A").collect()]


def test_plain_pages_as_the_parser_reads_them():
    pages = [
        '<META Name="A" name="b" CONTENT="&lt;&copy&amp;"><body><P>a<br/>b<BR>c &amp;amp; &copy</p>x',
        '<title>a &amp; b</title><script>x &amp; y</SCRIPT>t<style></style><p>z',
        '<ul><li>one<li>two<ul><li class="q" >in</ul><li/>three</ul><table><th>h<td>c<tr ><td>d</table>',
        '<p>plain</p><script>if (a<b) x()</script><b>bold</b><!-- c --><p a=1>rest</p >end',
        "no tag", "", "text <p>then</b></p></p>", "<p>cut <a href=", "<p/ ><p:x>y</p:x><div\tid='1'>z</div>",
    ]

    def tree(node):
        return node if isinstance(node, str) else (node.tag, node.attrs, [tree(c) for c in node.children])

    for page in pages:
        whole = h._Builder()
        whole.feed(page.replace("&", "&amp;"))
        whole.close()
        assert tree(h.parse(page)) == tree(whole.root)
    for page in pages[1:3]:
        assert h._Builder().read_plain(page) == len(page)


def test_images_as_their_column_function(spark):
    from quire.operators import lookup

    sources = ["x/a.gif?1", "x/", "", "a.gif", "http://h/p/b.png#f", "//h", "//h/", "c:d", "a/\n", "a\n", "a#b\n", "a#b\nc", "a# ", "a/\r\n", "a/b\r", "?q", "#f", "a//", "é.gif", "a\n/b\n", "x/\u0085", " p/q.gif "]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sources)], "i int, s string").select("i", lookup.image_source(F.col("s")).alias("t"))
    assert {sources[r.i]: r.t for r in rows.collect()} == {s: lookup.image_target(s) for s in sources}


def test_pages_without_links_are_parsed_once(spark):
    rows = [("A", f"A/{i}.htm", p) for i, p in enumerate([b'<p>x<img src="q/i.gif?1"></p>', b'<abbr>s</abbr><IMG SRC="j.gif">', b'<\xffa href="0.htm">l</a><img src="k.gif">', b'<A\xff href="1.htm">l</A>', None, b"<p>&lt;a &lt;b</p>"])]
    files = spark.createDataFrame(rows, "arc string, path string, content binary")
    assert [h.may_link(p) for _, _, p in rows] == [False, False, True, True, False, False]
    plan = corpora.linked_pages(corpora.source_files(files, "A", [".htm"]), files, None)._jdf.queryExecution().optimizedPlan()
    assert plan.children().size() == 2 and [("Join" in p, p.count("MapInArrow")) for p in (plan.children().apply(i).toString() for i in range(2))] == [(True, 4), (False, 1)]
    notes = {r.source_file: r.note.split("---\n")[-1] for r in corpora.vault_pages(files, "A").collect()}
    assert notes == {"0.htm": "x![](../assets/i.gif)\n", "1.htm": "s![](../assets/j.gif)\n", "2.htm": "[[0|l]]![](../assets/k.gif)\n", "3.htm": "[[1|l]]\n", "4.htm": "\n", "5.htm": "<a <b\n"}
