import io
import zipfile

from pyspark.sql import functions as F

from fathom.operators import intake
from fathom.sources import files, html, layout, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    p = lambda t, s="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return archive({"[Content_Types].xml": "<x/>", "word/document.xml": f"<w:document {W}><w:body>{p('intro')}{p('Part', 'Heading1')}{p('text')}{table}</w:body></w:document>"})


def pptx():
    shape = lambda t, y: f'<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f"<p:sld {A}><p:cSld><p:spTree>{shape('below', 9)}{shape('above', 1)}{shape('below', 10)}</p:spTree></p:cSld></p:sld>"
    return archive({"[Content_Types].xml": "<x/>", "ppt/presentation.xml": "<x/>", "ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": f"<p:sld {A}><p:cSld><p:spTree/></p:cSld></p:sld>"})


def test_office_documents():
    assert office.docx_segments(docx()) == [("heading", 1, office.BODY, "intro"), ("heading", 2, "Part", "Part\ntext\n| a | b |\n| --- | --- |")]
    assert office.pptx_segments(pptx()) == [("slide", 1, "above", "above\nbelow")]
    assert office.check_archive("docx", docx()) is None
    assert office.check_archive("docx", pptx()) == "missing member"
    assert office.check_archive("docx", archive({"[Content_Types].xml": "", "word/document.xml": "", "../x": ""})) == "unsafe path"
    assert office.check_archive("pptx", archive({"[Content_Types].xml": "", "ppt/presentation.xml": "0" * 9_000_000})) == "suspicious ratio"
    assert office.check_archive("docx", b"junk") == "no archive"


def test_pages():
    page = "<body><nav>menu</nav><article><h1>Top</h1><p>one <b>two</b></p><p>one two</p><script>x()</script><h2>Next</h2><ul><li>item</li></ul><table><tr><td>a</td><td>b</td></tr></table></article>out</body>"
    assert html.page_segments(page) == [(1, "Top", "Top\none two"), (2, "Next", "Next\nitem\na | b")]
    assert html.page_segments("<main>only text</main>") == [(1, html.BODY, "only text")]
    assert html.page_segments("") == [] and html.page_segments(None) == []
    clean = html.sanitize('<p onclick="x()"><a href="javascript:y">l</a><script>z</script><img src="data:q" alt="k"></p>')
    assert clean == '<p><a>l</a><img alt="k"></p>'


def test_decoding():
    assert [files.decode(b) for b in ("é".encode(), "é".encode("utf-16"), "中文文档".encode("gb18030"), b"\xef\xbb\xbfx", b"\xff", None)] == ["é", "é", "中文文档", "x", None, None]


def test_listing_validation_parsing_and_changes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("# T\nbody")
    (tmp_path / "b.html").write_text("<article><p>hello</p></article>")
    (tmp_path / "c.docx").write_bytes(docx())
    (tmp_path / "d.pdf").write_text("no")
    (tmp_path / "e.md").write_bytes(b"x\x00y")
    (tmp_path / "f.exe").write_text("x")
    checked = files.validated(files.listing(spark, str(tmp_path)))
    why = {r.file_name: r.reject_reason for r in checked.collect()}
    assert why == {"a.md": None, "b.html": None, "c.docx": None, "d.pdf": "no PDF header", "e.md": "binary content", "f.exe": "unsupported type"}
    assert {(r.location_type, r.text) for r in files.parsed(checked).collect()} >= {("heading", "# T\nbody"), ("web_section", "hello"), ("heading", "intro")}
    before = spark.createDataFrame(files.listing(spark, str(tmp_path), "*.md", content=False).collect())
    (tmp_path / "sub/a.md").write_text("# T\nlonger body")
    (tmp_path / "g.md").write_text("new")
    got = {r.path.rsplit("/", 1)[1]: r.change for r in files.changed(before, files.listing(spark, str(tmp_path), "*.md", content=False)).collect()}
    assert got == {"a.md": "modified", "g.md": "new"}


def test_layout_outputs(spark):
    rows = spark.createDataFrame([(1, "{0}------\nfirst\n{2}------\nthird"), (2, "no marks")], "id int, text string")
    assert sorted(map(tuple, layout.paged_markdown(rows, ["id"]).collect())) == [(1, 1, "first"), (1, 3, "third"), (2, 0, "no marks")]
    payload = '[{"page_idx":0,"text":"a"},{"page_idx":0,"list_items":["b","c"]},{"page_idx":1,"text":""},{"page_idx":2,"table_body":"t"}]'
    got = layout.content_list(spark.createDataFrame([(1, payload)], "id int, payload string"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a\nb\nc"), (1, 3, "t")]
    assert [r.o for r in spark.createDataFrame([("x" * 19,), ("x" * 20,), (None,)], "t string").select(layout.needs_ocr(F.col("t")).alias("o")).collect()] == [True, False, True]


def test_urls(spark):
    urls = ["https://a.example.com/x", "ftp://e.com", "http://127.0.0.1/", "http://localhost:8", "http://192.168.0.1", "https://u:p@e.com/", "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r.p for r in df.select(intake.web_url_problem(F.col("u")).alias("p")).collect()]
    assert got == [None, "scheme", "private host", "private host", "private host", "credentials", "scheme"]
    assert [r.t for r in df.limit(2).select(intake.trusted(F.col("u"), ["example.com"]).alias("t")).collect()] == [True, False]
