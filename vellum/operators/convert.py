"""HTML documents to ordered block nodes, and audits of references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCKS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre", "figure", "nav", "header", "footer", "section", "article", "div", "aside", "main", "form", "hr"]
_SILENT = {"script", "style", "title", "noscript"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "figcaption", "dt", "dd"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.kind, self.text, self.silent = "p", [], 0

    def close_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.rows.append((self.kind, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in _LEAVES or tag in BLOCKS:
            self.close_block()
            self.kind = tag if tag in _LEAVES else "p"
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in _LEAVES or tag in BLOCKS:
            self.close_block()
            self.kind = "p"

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def html_blocks(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of each leaf block in order; scripts and styles are left out, entities decoded."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.rows


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", per_chunk: int = 50) -> DataFrame:
    """(book, line, chunk, node_id, type, plain): the blocks of each page, numbered from 1, per_chunk to a chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k + 1, k // per_chunk, f"{i}_n{k + 1}", kind, text) for i, html in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for k, (kind, text) in enumerate(html_blocks(html))]
            yield pd.DataFrame(rows, columns=["book", "line", "chunk", "node_id", "type", "plain"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInPandas(run, "book long, line long, chunk long, node_id string, type string, plain string")


class _Top(HTMLParser):
    """The children of a body: a row each, with the citations and note markers within."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[str] = []
        self.silent = 0

    def _row(self, tag: str) -> dict:
        self.rows.append({"type": tag, "text": [], "references": [], "footnotes": []})
        return self.rows[-1]

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT or tag == "head":
            self.silent += 1
        elif not self.silent and tag == "body":
            self.rows, self.open = [], []
        elif not self.silent and tag != "html":
            row = self.rows[-1] if self.open else self._row(tag)
            have = dict(attrs)
            kinds = (have.get("class") or "").split()
            if tag == "a" and "in-text-citation" in kinds:
                row["references"] += (have.get("data-refs") or (have.get("href") or "").lstrip("#")).split(",")
            if tag == "sup" and "footnote-ref" in kinds and have.get("id"):
                row["footnotes"].append((have["id"], have.get("fn-count-id") or ""))
            if tag not in _VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT or tag == "head":
            self.silent = max(0, self.silent - 1)
        elif tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.silent and (self.open or data.strip()):
            (self.rows[-1] if self.open else self._row("p"))["text"].append(data.strip())


def top_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", per_chunk: int = 50) -> DataFrame:
    """(book, line, chunk, node_id, type, plain, references, footnotes): the children of each page's body, or of the page where it has none.

    Lines count from 1, per_chunk to a chunk; text of its own is a p. plain joins the trimmed pieces of text, scripts and styles are
    left out. Pages that are null or empty have no rows.
    """
    schema = "book long, line long, chunk long, node_id string, type string, plain string, references array<string>, footnotes array<struct<id: string, marker: string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, html in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                parser = _Top()
                parser.feed(html or "")
                parser.close()
                for k, r in enumerate(parser.rows):
                    notes = [{"id": i, "marker": m} for i, m in r["footnotes"]]
                    rows.append((book, k + 1, k // per_chunk, f"{book}_{k + 1}", r["type"], "".join(r["text"]), r["references"], notes))
            yield pd.DataFrame(rows, columns=["book", "line", "chunk", "node_id", "type", "plain", "references", "footnotes"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInPandas(run, schema)


_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])")


def text_pieces(text: str | None, ceiling: int) -> list[str]:
    """A text in pieces of at most ceiling characters, each as long as the next part allows.

    Parts are paragraphs; a paragraph above the ceiling gives its sentences, a sentence above it runs of that many characters.
    Spaces at the ends of pieces go; empty texts have no pieces.
    """
    parts: list[tuple[str, str]] = []  # what joins a part to the one before it, and the part
    for paragraph in re.split(r"\n\s*\n", text or ""):
        sentences = [paragraph] if len(paragraph) <= ceiling else _SENTENCE.split(paragraph)
        for k, sentence in enumerate(sentences):
            runs = [sentence[i : i + ceiling] for i in range(0, len(sentence), ceiling)]
            parts += [("" if j else " " if k else "\n\n", run) for j, run in enumerate(runs) if run.strip()]
    pieces: list[str] = []
    for joint, part in parts:
        if pieces and len(pieces[-1]) + len(joint) + len(part) <= ceiling:
            pieces[-1] += joint + part
        else:
            pieces.append(part)
    return [p.strip() for p in pieces]


def split_text(text: Column, ceiling: int) -> Column:
    """text_pieces() as an array; null texts have none."""
    return F.udf(lambda x: text_pieces(x, ceiling), "array<string>", useArrow=True)(text)


def inverted_text(index: Column) -> Column:
    """The text of an inverted index, a JSON object of words with their positions: the words in order of position, one space between. Null, and what is no such object, is null."""
    entries = F.map_entries(F.from_json(index, "map<string, array<int>>"))
    placed = F.flatten(F.transform(entries, lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
