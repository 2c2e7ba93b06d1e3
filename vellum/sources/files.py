"""File sources and sinks: CSV by header names, HTML, Markdown and OCR-JSON documents, directories, chunked JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from vellum.operators.convert import html_blocks


def read_csv(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Columns by header name, never by place: missing required ones raise, missing optional ones are null."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if lacking := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*required, *[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional])


def keyed_by_either(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per value of any of the key columns; of several, the last in order."""
    rows = df.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), *df.columns)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy(F.col(order).desc()))).where("_r = 1 AND key <> ''").drop("_r")


def markdown_to_html(text: str) -> str:
    """Headings, lists, quotes, code fences, tables and paragraphs; inline emphasis, code and links."""

    def inline(s: str) -> str:
        s = s.replace("&", "&amp;").replace("<", "&lt;")
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s)
        s = re.sub(r"\*(.+?)\*", r"<em>\1</em>", s)
        return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)

    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("```"):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            body = "\n".join(lines[i + 1 : end]).replace("&", "&amp;").replace("<", "&lt;")
            out.append(f"<pre>{body}</pre>")
            i = end + 1
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"[\s|:-]*-[\s|:-]*", lines[i + 1]):
            rows = [line]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(lines[i])
                i += 1
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{inline(c.strip())}</td>" for c in r.strip().strip("|").split("|")) + "</tr>" for r in rows) + "</table>")
            continue
        elif line.strip():
            kind, pattern = next(((k, p) for k, p in (("ul", r"\s*[-*+]\s+"), ("ol", r"\s*\d+\.\s+"), ("blockquote", r"\s*>\s?")) if re.match(p, line)), ("p", None))
            block = []
            while i < len(lines) and lines[i].strip() and (re.match(pattern, lines[i]) if pattern else not re.match(r"#{1,6}\s|```|\s*([-*+]|\d+\.|>)\s", lines[i]) or not block):
                block.append(inline(re.sub(pattern, "", lines[i], count=1) if pattern else lines[i]))
                i += 1
            out.append(f"<{kind}>" + "".join(f"<li>{b}</li>" for b in block) + f"</{kind}>" if kind in ("ul", "ol") else f"<{kind}>{' '.join(block)}</{kind}>")
            continue
        i += 1
    return "\n".join(out)


def ocr_to_markdown(pages: list[dict]) -> str:
    """Pages of {'lines': [...]} joined: a page's last hyphenated or unfinished line goes on with the next page's lower-case start."""
    text = ""
    for page in pages:
        body = "\n".join(page.get("lines") or [])
        if text.endswith("-") and body[:1].islower():
            text = text[:-1] + body
        elif text and body[:1].islower() and not re.search(r"[.!?:]$", text):
            text += " " + body
        else:
            text += ("\n\n" if text else "") + body
    return text


def read_documents(spark: SparkSession, path: str, glob: str, kind: str) -> DataFrame:
    """(path, line, type, plain): blocks of html, markdown or OCR-JSON files, one file to a row of binaryFile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content, strict=True):
                text = bytes(content).decode("utf-8", "replace")
                html = text if kind == "html" else markdown_to_html(text if kind == "markdown" else ocr_to_markdown(json.loads(text)))
                rows += [(name, k + 1, tag, plain) for k, (tag, plain) in enumerate(html_blocks(html))]
            yield pd.DataFrame(rows, columns=["path", "line", "type", "plain"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, line long, type string, plain string")


def directory_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(extension, files, bytes) of a directory tree, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_chunks(nodes: DataFrame, path: str, book: str = "book", chunk: str = "chunk") -> None:
    """A JSON folder for each book and chunk, and a manifest of lines and counts beside them."""
    nodes.withColumns({"_book": F.col(book), "_chunk": F.col(chunk)}).repartition("_book", "_chunk").write.mode("overwrite").partitionBy("_book", "_chunk").json(f"{path}/chunks")
    nodes.groupBy(book, chunk).agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/manifest")


def write_jsonl(df: DataFrame, path: str, exclude: Sequence[str] = ()) -> None:
    df.drop(*exclude).write.mode("overwrite").json(path)


def sampled_shares(df: DataFrame, columns: Sequence[str], fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """Byte shares of text columns on a sample, scaled to the exact row count."""
    exact = df.agg(F.count("*").alias("rows"))
    sums = df.sample(fraction, seed).agg(F.count("*").alias("sampled"), *[F.sum(F.coalesce(F.octet_length(c), F.lit(0))).alias(c) for c in columns])
    return exact.join(F.broadcast(sums)).select("rows", "sampled", *[(F.col(c) * F.col("rows") / F.greatest("sampled", F.lit(1))).alias(c) for c in columns])
