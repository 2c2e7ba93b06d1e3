"""Zipped document sources, EPUB and DOCX, and papers in LaTeX-made HTML, each to ordered blocks."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators.convert import html_blocks

Block = tuple[str, str, str]  # part of the file, tag, text

#: The names of the formats' elements, and the parts of a DOCX that tell who wrote it and when.
_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_OPF = "{http://www.idpf.org/2007/opf}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
METADATA_PARTS = ("docProps/", "word/comments", "word/people", "customXml/")


def epub_blocks(content: bytes) -> list[Block]:
    """Blocks of the spine's documents in reading order; what the spine names but the file lacks is passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        held = set(z.namelist())
        root = ElementTree.fromstring(z.read("META-INF/container.xml")).find(f".//{_CONTAINER}rootfile").get("full-path")
        package = ElementTree.fromstring(z.read(root))
        items = {i.get("id"): i.get("href", "") for i in package.iter(f"{_OPF}item")}
        out: list[Block] = []
        for ref in package.iter(f"{_OPF}itemref"):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(items.get(ref.get("idref"), ""))))
            if name in held:
                out += [(name, tag, text) for tag, text in html_blocks(z.read(name).decode("utf-8", "replace"))]
        return out


def _runs(node: ElementTree.Element) -> str:
    """Text of a paragraph as it stands: insertions are in it, deletions and field codes are not."""
    if node.tag in (f"{_W}del", f"{_W}moveFrom", f"{_W}instrText"):
        return ""
    if node.tag == f"{_W}footnoteReference":
        return f"[^{node.get(f'{_W}id')}]"
    own = {f"{_W}t": node.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(node.tag, "")
    return own + "".join(map(_runs, node))


def _paragraphs(xml: bytes) -> Iterator[tuple[ElementTree.Element, str]]:
    for p in ElementTree.fromstring(xml).iter(f"{_W}p"):
        if text := " ".join(_runs(p).split()):
            yield p, text


def docx_blocks(content: bytes) -> list[Block]:
    """Paragraphs of the body, headings by their style and list items by their numbering, then the footnotes by their ids."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out: list[Block] = []
        for p, text in _paragraphs(z.read("word/document.xml")):
            style = p.find(f"{_W}pPr/{_W}pStyle")
            heading = re.fullmatch(r"Heading([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            item = p.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(("body", f"h{heading[1]}" if heading else "li" if item else "p", text))
        if "word/footnotes.xml" in z.namelist():
            for note in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{_W}footnote"):
                text = " ".join(" ".join(_runs(p) for p in note.iter(f"{_W}p")).split())
                if text:
                    out.append((f"footnote {note.get(f'{_W}id')}", "p", text))
        return out


def without_metadata(content: bytes) -> bytes:
    """A DOCX without its properties, comments and people, and without the names and dates of its changes."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            data = old.read(name)
            if name.startswith(METADATA_PARTS):
                continue
            if name == "[Content_Types].xml" or name.endswith(".rels"):
                data = re.sub(rb'<(?:Override|Relationship)\b[^>]*"/?(?:\.\./)?(?:docProps/|customXml/|(?:word/)?(?:comments|people))[^>]*/>', b"", data)
            elif name.startswith("word/") and name.endswith(".xml"):
                data = re.sub(rb'\s(?:w:author|w:date|w:initials|w:rsid\w*)="[^"]*"', b"", data)
                data = re.sub(rb"<w:comment(?:RangeStart|RangeEnd|Reference)\b[^>]*/>", b"", data)
            new.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def paper_html(html: str | None) -> str:
    """LaTeX-made HTML with bibliography items as paragraphs of their key, citations as links to them, notes apart and formulas as TeX.

    Notes move to the end in order, each with the number that stands in its place. Null is empty.
    """
    html = re.sub(r'<math\b[^>]*?\balttext="([^"]*)"[^>]*>.*?</math>', r"$\1$", html or "", flags=re.S)
    html = re.sub(r'<li\b[^>]*\bid="(bib\.bib\d+)"[^>]*class="ltx_bibitem"[^>]*>(.*?)</li>', r'<p id="\1">\2</p>', html, flags=re.S)
    html = re.sub(r'<cite\b[^>]*class="ltx_cite[^"]*"[^>]*>(.*?)</cite>', r"\1", html, flags=re.S)
    notes: list[str] = []

    def apart(m: re.Match) -> str:
        notes.append(re.sub(r"<[^>]+>", "", re.sub(r"<sup\b[^>]*>.*?</sup>", "", m[1], flags=re.S)).strip())
        return f"<sup>{len(notes)}</sup>"

    html = re.sub(r'<span\b[^>]*class="ltx_note_content"[^>]*>((?:(?!<span\b).)*?)</span>', apart, html, flags=re.S)
    return html + "".join(f'<p id="fn{k}">[^{k}]: {escape(n)}</p>' for k, n in enumerate(notes, 1))


def paper_blocks(content: bytes) -> list[Block]:
    return [("body", tag, text) for tag, text in html_blocks(paper_html(content.decode("utf-8", "replace")))]


#: Formats by name; a caller may add its own.
FORMATS: dict[str, Callable[[bytes], list[Block]]] = {"epub": epub_blocks, "docx": docx_blocks, "paper": paper_blocks}


def read_archives(spark: SparkSession, path: str, glob: str, kind: str) -> DataFrame:
    """blocks() of the files below path whose names fit glob; Spark passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return blocks(files.select("path", "content"), F.col("path"), F.col("content"), kind)


def blocks(files: DataFrame, name: Column, content: Column, kind: str) -> DataFrame:
    """(path, line, part, type, plain, error): a row for each block, from 1 on; a file that can't be read is one row with its error.

    A file is one row of at most 2 GB, and its blocks leave the task as they are made. Null contents give no rows.
    """
    parse = FORMATS[kind]
    names = ["path", "line", "part", "type", "plain", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch.path, batch.content, strict=True):
                try:
                    rows = [(path, k, *block, None) for k, block in enumerate(parse(bytes(data)), 1)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError) as e:
                    rows = [(path, None, None, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=names).astype({"line": "Int64"})

    held = files.select(name.cast("string").alias("path"), content.alias("content")).where("content IS NOT NULL")
    return held.mapInPandas(run, "path string, line long, part string, type string, plain string, error string")
