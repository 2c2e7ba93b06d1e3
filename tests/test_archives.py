"""Zipped documents made by hand, papers, and syncs of several tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators.commits import Commits
from vellum.sources import archives
from vellum.streaming import sync


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def epub():
    opf = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="text/two%20b.xhtml"/><item id="a" href="text/one.xhtml"/><item id="css" href="s.css"/></manifest>
    <spine><itemref idref="a"/><itemref idref="gone"/><itemref idref="b"/></spine></package>"""
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
    return zipped(**{"META-INF/container.xml": container, "OPS/book.opf": opf, "OPS/text/two b.xhtml": "<p>second &amp; last</p>", "OPS/text/one.xhtml": "<h1>First</h1><p>words</p>"})


def docx(author="Ada"):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"""<w:document {w}><w:body><w:p w:rsidR="00AB"><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
    <w:p><w:commentRangeStart w:id="1"/><w:r><w:t>It was </w:t></w:r><w:del w:author="{author}" w:date="2020"><w:r><w:t>not </w:t></w:r></w:del><w:ins w:author="{author}"><w:r><w:t>so</w:t></w:r></w:ins><w:r><w:footnoteReference w:id="2"/></w:r></w:p>
    <w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/></w:body></w:document>"""
    notes = f'<w:footnotes {w}><w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>a note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    types = '<Types><Override PartName="/docProps/core.xml" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>'
    return zipped(**{"[Content_Types].xml": types, "docProps/core.xml": f"<c>{author}</c>", "word/comments.xml": author, "word/document.xml": body, "word/footnotes.xml": notes})


BODY = [("body", "h2", "Title"), ("body", "p", "It was so[^2]"), ("body", "li", "item"), ("footnote 2", "p", "a note")]


def test_epub_follows_its_spine():
    assert archives.epub_blocks(epub()) == [("OPS/text/one.xhtml", "h1", "First"), ("OPS/text/one.xhtml", "p", "words"), ("OPS/text/two b.xhtml", "p", "second & last")]


def test_docx_loses_metadata_and_keeps_its_text():
    bare = archives.without_metadata(docx())
    assert archives.docx_blocks(docx()) == archives.docx_blocks(bare) == BODY
    with zipfile.ZipFile(io.BytesIO(bare)) as z:
        assert set(z.namelist()) == {"[Content_Types].xml", "word/document.xml", "word/footnotes.xml"}
        assert not any(b"Ada" in z.read(n) or b"docProps" in z.read(n) or b"rsid" in z.read(n) for n in z.namelist()) and b"/word/document.xml" in z.read("[Content_Types].xml")


def test_papers():
    html = '<p>As <cite class="ltx_cite ltx_citemacro_cite">[<a href="#bib.bib1">1</a>]</cite> says, <math alttext="x^2"><mi>x</mi></math>.<span class="ltx_note_content"><sup>1</sup>An aside.</span></p><ul><li id="bib.bib1" class="ltx_bibitem">Hart 1994</li></ul>'
    assert [b[2] for b in archives.paper_blocks(html.encode())] == ["As [1] says, $x^2$.1", "Hart 1994", "[^1]: An aside."]
    assert archives.paper_html(None) == ""


def test_archives_from_files(spark, tmp_path):
    for name, data in {"a/one.epub": epub(), "two.docx": docx(), "broken.docx": b"no zip", "empty.docx": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rsplit("/", 1)[1], r.line): (r.part, r.type, r.plain) if not r.error else r.error for r in archives.read_archives(spark, str(tmp_path), "*.docx", "docx").collect()}
    assert got == {("two.docx", k): b for k, b in enumerate(BODY, 1)} | {("broken.docx", None): "BadZipFile"}
    assert archives.read_archives(spark, str(tmp_path), "*.epub", "epub").count() == 3
    odd = spark.createDataFrame([("empty", b""), ("none", None), (None, epub())], "name string, data binary")
    assert sorted((r.path or "", r.error or r.plain) for r in archives.blocks(odd, F.col("name"), F.col("data"), "epub").collect()) == [("", "First"), ("", "second & last"), ("", "words"), ("empty", "BadZipFile")]


def test_one_sync_moves_all_tables_of_a_book_or_none(spark, tmp_path):
    path, keys = str(tmp_path / "db"), {"nodes": ["book", "node"], "library": ["book"]}
    nodes = spark.createDataFrame([("a", 1, "old a1"), ("a", 2, "old a2"), ("b", 1, "old b1"), ("d", 1, "d1")], "book string, node long, text string")
    library = spark.createDataFrame([("a", 10, "A"), ("b", 20, "B")], "book string, stamp long, title string")
    sync.create_store(spark, path, {"nodes": nodes, "library": library}, "book", buckets=8)
    change = lambda kind, book, base, row, deleted=False: (kind, book, base, deleted, json.dumps({"book": book, **row}))
    batch = [
        change("nodes", "a", 10, {"node": 1, "text": "new a1"}, None), change("nodes", "a", 10, {"node": 2}, True), change("nodes", "a", 10, {"node": 3, "text": "a3"}), change("library", "a", 10, {"stamp": 11, "title": "A2"}),
        change("nodes", "b", 19, {"node": 1, "text": "stale"}), change("library", "b", 19, {"stamp": 21, "title": "stale"}),
        change("nodes", "c", None, {"node": 1, "text": "c1"}), change("library", "c", None, {"stamp": 1, "title": "C"}), change("nodes", "c", None, {"text": "no key"}),
        change("nodes", "a", 10, {"book": "d", "node": 1, "text": "of another book"}), ("nodes", "a", 10, False, "no JSON"), ("nodes", "a", 10, False, None), change("pages", "a", 10, {"node": 1}), change(None, "a", 10, {"node": 1}),
    ]
    schema = "kind string, book string, base long, deleted boolean, row string"
    spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{path}/changes")
    before = Commits(spark, path).last()
    stream = spark.readStream.schema(schema).parquet(f"{path}/changes")
    sync.sync_stream(stream, path, keys, "book", "stamp", "library", f"{path}/checkpoint").awaitTermination()
    rows = lambda t: sorted(tuple(r) for r in sync.committed(spark, path, t).collect())
    assert rows("nodes") == [("a", 1, "new a1"), ("a", 3, "a3"), ("b", 1, "old b1"), ("c", 1, "c1"), ("d", 1, "d1")]
    assert rows("library") == [("a", 11, "A2"), ("b", 20, "B"), ("c", 1, "C")]
    lost = sorted((r.reason, r.kind or "", r.book) for r in sync.rejected(spark, path).collect())
    assert lost == [("book", "nodes", "a"), ("key", "nodes", "a"), ("key", "nodes", "a"), ("key", "nodes", "c"), ("kind", "", "a"), ("kind", "pages", "a"), ("stale", "library", "b"), ("stale", "nodes", "b")]
    # Folders of books that no change names are the same files; tables written without a commit aren't seen, and a batch counts once.
    after = Commits(spark, path).last()
    same = {b for b, f in before["tables"]["nodes"]["folders"].items() if after["tables"]["nodes"]["folders"].get(b) == f}
    touched = {str(r[0]) for r in spark.createDataFrame([(x,) for x in "abc"], "book string").select(sync._bucket(F.col("book"), 8)).collect()}
    assert same == set(before["tables"]["nodes"]["folders"]) - touched
    Commits(spark, path).write(nodes)
    sync.sync_store(spark.createDataFrame([change("nodes", "a", 11, {"node": 9})], schema), path, keys, "book", "stamp", "library", batch=0)
    assert len(rows("nodes")) == 5
    sync.sync_store(spark.createDataFrame([change("nodes", "a", 11, {"node": k}, True) for k in (1, 3)], schema), path, keys, "book", "stamp", "library", batch=1)
    assert rows("nodes") == [("b", 1, "old b1"), ("c", 1, "c1"), ("d", 1, "d1")]


def test_sync_of_nothing(spark, tmp_path):
    path = str(tmp_path / "db")
    schema = "kind string, book string, base long, deleted boolean, row string"
    sync.create_store(spark, path, {"library": spark.createDataFrame([], "book string, stamp long")}, "book")
    sync.sync_store(spark.createDataFrame([], schema), path, {"library": ["book"]}, "book", "stamp", "library")
    assert sync.committed(spark, path, "library").count() == 0 and sync.rejected(spark, path).count() == 0
    with pytest.raises(ValueError):
        sync.create_store(spark, path, {}, "book")
