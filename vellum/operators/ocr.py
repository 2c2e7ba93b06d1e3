"""Scanned pages to a book's running text and its notes.

Pages are rows (book, page, markdown, footer). What a page can't tell alone is carried from page to page: a note cut off in mid
sentence, a paragraph that goes on, the count of notes so far. Each page is read by itself into paragraphs; a segmented scan over pages hands the
state on; only paragraphs that go over the turn of a page are put together from several rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.operators.scan import carried, ranged
from vellum.session import written

#: Forms of markers and of what opens a definition, the ends of sentences, and the least line that may go on after a gap.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
NOTE = r"\[\^(\d{1,3})\]"
OPENER = re.compile(rf"^\s*{NOTE}[:.]?(?:\s|$)")
FOOTER_NOTES = re.compile(r"(?m)^\s*(?:[¹²³⁰-⁹]|\$\^\{?\d+\}?\$|\[\^?\d+\]|\d{1,3}\.[ \t]+(?=[A-Z‘“\"']))")
MARKED_LINE = re.compile(r"^\s*\[\^?(\d{1,3})\][.:]?\s*(\S.*)$")
NUMBERED_LINE = re.compile(r"^\s*(\d{1,3})(\.?)\s+(\S.*)$")
TERMINAL = (".", "!", "?", ":", ";", '"', "'", "”", "’", ")", "]")
STOPS = (".", "!", "?", ":", ";", '"', ")", "]", "---")
LEAST_LINE = 20

_SUPER = re.compile(f"[{SUPERSCRIPTS}]+")
_LATEX = re.compile(r"\$\^\{?\s*(\d{1,3}(?:\s*,\s*\d{1,3})*)\s*\}?\$")
_CARET = re.compile(r"(?<!\[)\^(\d{1,3})(?![\w}])")
_NOTE = re.compile(NOTE)
_OPENING, _CLOSING, _LAST_NOTE = re.compile(rf"^\s*{NOTE}"), re.compile(rf"(?:\s*{NOTE})+\s*$"), re.compile(rf"{NOTE}\s*$")


def marked(text: str) -> str:
    """A page with its note markers, superscript, LaTeX or bare carets, as [^N]."""
    text = _SUPER.sub(lambda m: f"[^{m[0].translate(str.maketrans(SUPERSCRIPTS, '0123456789'))}]", text)
    if "^" not in text:
        return text
    text = _LATEX.sub(lambda m: "".join(f"[^{n}]" for n in re.findall(r"\d+", m[1])), text)
    return _CARET.sub(r"[^\1]", text)


def mid_sentence(text: str) -> bool:
    """Whether a note stops in mid sentence: it ends with a word in lower case, markers at its end aside."""
    bare = text.strip()
    if bare.endswith("]"):
        bare = _CLOSING.sub("", bare)
    if "<" in bare:
        bare = re.sub(r"<[^>]+>", "", bare)
    bare = bare.rstrip()
    return len(bare) > 1 and "a" <= bare[-1] <= "z" and "a" <= bare[-2] <= "z"


def goes_on(text: str) -> str | None:
    """How a paragraph may go on after a gap: "" after a broken word, " " after a line that doesn't end a sentence; null if it can't."""
    line = text.rsplit("\n", 1)[-1].rstrip()
    if not line or line.startswith("#") or line == "---" or line.lstrip().startswith("|"):
        return None
    if line.endswith("-") and not line.endswith("---"):
        return ""
    bare = _LAST_NOTE.sub("", line).rstrip() if line.endswith("]") else line
    return " " if len(line) > LEAST_LINE and not bare.endswith(STOPS) else None


def bottom_notes(text: str) -> str:
    """A page with the notes at its bottom as lines "[^N]: note".

    The last lines that open with numbers are notes if these ascend and some marker of the page names one of them; else
    the last ones as long as a marker names each.
    """
    lines = text.split("\n")
    named = {int(n) for line in lines if "[^" in line for n in _NOTE.findall(_OPENING.sub("", line))}
    block: list[tuple[int, int, str]] = []
    for k in range(len(lines) - 1, -1, -1):
        if not lines[k].strip():
            continue
        if m := MARKED_LINE.match(lines[k]):
            block.append((k, int(m[1]), m[2]))
        elif (m := NUMBERED_LINE.match(lines[k])) and (m[2] or m[3][0].isupper() or m[3][0] in "‘“'\""):
            block.append((k, int(m[1]), m[3]))
        else:
            break
    numbers = [n for _, n, _ in block]
    if len(block) < 2 or numbers != sorted(set(numbers), reverse=True) or not named.intersection(numbers):
        kept = next((i for i, n in enumerate(numbers) if n not in named), len(block))
        block = block[:kept]
    for k, n, note in block:
        lines[k] = f"[^{n}]: {note}"
    return "\n".join(lines)


def page_paragraphs(text: str, footer: str, style: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """(paragraph, whether it opens a note) of a page, and the numbers its markers name, in order of appearance."""
    text = text.strip("\n")
    if footer.strip() and FOOTER_NOTES.search(footer):
        text = f"{text}\n\n{footer.strip()}" if text.strip() else footer.strip()
    text = marked(text)
    if style == "page_bottom":
        text = bottom_notes(text)
        first = re.search(rf"(?m)^{NOTE}:", text)
        if first:  # every line of notes is a paragraph of its own
            text = text[: first.start()] + re.sub(rf"(?m)\n(?={NOTE}:)", "\n\n", text[first.start() :])
    paragraphs = [p.strip("\n") for p in re.split(r"\n\s*\n", text) if p.strip()]
    return [(p, bool(OPENER.match(p))) for p in paragraphs], list(dict.fromkeys(_NOTE.findall(text)))


_PAGE = "struct<paragraphs: array<struct<text: string, opens: boolean, mid: boolean, lower: boolean, joint: string>>, numbers: array<string>>"


def _read(text: Column, footer: Column, style: Column) -> Column:
    def each(texts: pd.Series, footers: pd.Series, styles: pd.Series) -> pd.DataFrame:
        rows = []
        for t, f, s in zip(texts, footers, styles, strict=True):
            paragraphs, numbers = page_paragraphs(t, f, s)
            # At the foot of a page all that follows a note belongs to it.
            foot = next((i for i, (_, o) in enumerate(paragraphs) if o), len(paragraphs)) if s == "page_bottom" else len(paragraphs)
            rows.append(([{"text": p, "opens": o, "mid": i >= foot or mid_sentence(p), "lower": i >= foot or p.lstrip()[:1].islower(), "joint": goes_on(p)} for i, (p, o) in enumerate(paragraphs)], numbers))
        return pd.DataFrame(rows, columns=["paragraphs", "numbers"])

    return F.pandas_udf(each, _PAGE)(text, footer, style)


def _open_after(paragraphs: Column, began: Column) -> Column:
    """Whether a note is open after a page's paragraphs, given whether one was before."""
    return F.aggregate(paragraphs, began, lambda was, p: (p["opens"] | (was & p["lower"])) & p["mid"])


def assemble(pages: DataFrame) -> DataFrame:
    """(book, kind, n, page, number, text): a book's text in paragraphs (kind body) and its notes (kind note), each numbered in order from 1.

    pages: (book, page, markdown, footer, style); style is page_bottom, where notes are lines at the foot of their page and numbered page by
    page, or any other, where a note is a paragraph that opens with its marker, and one that stops in mid sentence goes on with the next
    paragraph, over pages too, if that starts in lower case. Paragraphs go on over a gap after a broken word, or after a line of some
    length that ends no sentence, if the next starts in lower case; notes don't part them. Markers of page_bottom books are numbered
    anew through the book, in order of appearance. number is a note's own. page is where a paragraph or note begins.

    Null texts are empty; an empty page changes nothing; a null style is any other; a page number that repeats in a book is an error of its maker and of no defined order.
    """
    text, style = F.coalesce(F.col("markdown"), F.lit("")), F.coalesce(F.col("style"), F.lit(""))
    dealt = ranged(pages.select("book", "page", text.alias("text"), F.coalesce(F.col("footer"), F.lit("")).alias("footer"), style.alias("style")), "book", ["page"])
    read = dealt.select("book", "page", "_part", "_edge", (F.col("style") == "page_bottom").alias("anew"), _read(F.col("text"), F.col("footer"), F.col("style")).alias("_r"))
    read = written(read.select("book", "page", "_part", "_edge", "anew", "_r.paragraphs", "_r.numbers"), "pages-read")
    shut, opened = _open_after(F.col("paragraphs"), F.lit(False)), _open_after(F.col("paragraphs"), F.lit(True))
    # A page after which a note is open or not whatever was before it settles the state; others hand it on.
    first = carried(read, "book", ["page"], {"was_open": F.when(F.col("anew"), F.lit(False)).when(shut == opened, shut)}, {"counted": F.when(F.col("anew"), F.size("numbers")).otherwise(0)})

    begun = F.struct(F.coalesce(F.col("was_open"), F.lit(False)).alias("open"), F.array().cast("array<boolean>").alias("notes"))
    told = F.aggregate(
        "paragraphs", begun,
        lambda acc, p: F.struct(((p["opens"] | (acc["open"] & p["lower"])) & p["mid"]).alias("open"), F.concat(acc["notes"], F.array(p["opens"] | (acc["open"] & p["lower"]))).alias("notes")),
        lambda acc: acc["notes"],
    )
    anew = F.map_from_arrays("numbers", F.transform("numbers", lambda x, i: (F.col("counted") + i + 1).cast("string")))
    pieces = first.withColumn("_told", told).withColumn("_anew", F.when(F.col("anew"), anew))
    pieces = pieces.select("book", "page", "_part", "_edge", "_anew", F.transform("paragraphs", lambda p, i: F.struct(i.alias("i"), p["text"].alias("text"), p["opens"].alias("opens"), p["lower"].alias("lower"), p["joint"].alias("joint"), F.element_at("_told", i + 1).alias("note"))).alias("all"))
    body, notes = F.filter("all", lambda p: ~p["note"]), F.filter("all", lambda p: p["note"])
    pieces = pieces.select("book", "page", "_part", "_edge", "_anew", body.alias("body"), notes.alias("notes"))

    # Whether a paragraph goes on the one before it, and of a page's first, the one that the last page with text ended with.
    tail = F.when(F.size("body") > 0, F.struct(F.try_element_at("body", F.lit(-1))["joint"].alias("joint")))
    tied = carried(pieces, "book", ["page"], {"before": tail}, {"notes_before": F.size(F.filter("notes", lambda p: p["opens"]))})

    def flagged(parts: str, start: Column) -> Column:
        joint = lambda i: F.when(i == 0, start).otherwise(F.try_element_at(parts, i)["joint"])
        return F.transform(parts, lambda p, i: F.struct(p["text"].alias("text"), F.when(p["lower"] & joint(i).isNotNull() & ~p["text"].startswith("#"), joint(i)).alias("joint")))

    tied = tied.select("book", "page", "_part", "_edge", "_anew", "notes_before", "notes", flagged("body", F.col("before.joint")).alias("body"))
    counted = written(carried(tied, "book", ["page"], sums={"blocks": F.size(F.filter("body", lambda p: p["joint"].isNull()))}), "pages-tied")
    # A first piece that goes on nothing, as its book begins in lower case, still begins a block.
    number = lambda parts, upto, begun: F.size(F.filter(F.slice(parts, F.lit(1), upto + 1), begun))
    placed = counted.select("book", "page", "_anew", F.posexplode(F.transform("body", lambda p, i: F.struct(p["text"].alias("text"), p["joint"].alias("joint"), (F.col("blocks") + number("body", i, lambda q: q["joint"].isNull())).alias("n")))).alias("at", "p"))
    placed = placed.select("book", "page", "at", F.col("p.n").cast("long").alias("n"), "p.joint", F.col("p.text").alias("text"), "_anew").withColumn("kind", F.lit("body")).withColumn("number", F.lit(None).cast("string"))
    said = counted.select("book", "page", "_anew", F.posexplode(F.transform("notes", lambda p, i: F.struct(p["text"].alias("text"), p["opens"].alias("opens"), (F.col("notes_before") + number("notes", i, lambda q: q["opens"])).alias("n")))).alias("at", "p"))
    own = F.regexp_extract("p.text", rf"^\s*{NOTE}", 1)
    said = said.select("book", "page", "at", F.col("p.n").cast("long").alias("n"), F.when(~F.col("p.opens"), F.lit(" ")).alias("joint"), F.col("p.text").alias("text"), "_anew", F.lit("note").alias("kind"), F.when(F.col("p.opens"), own).alias("number"))
    said = said.withColumn("text", F.when(F.col("joint").isNull(), F.regexp_replace("text", rf"^\s*{NOTE}[:.]?\s*", "")).otherwise(F.col("text"))).withColumn("number", F.coalesce(F.try_element_at("_anew", F.col("number")), F.col("number")))
    rows = placed.unionByName(said)
    # Markers get their new numbers: what stands between two markers, and each marker's number through the page's map.
    between, marks = F.split("text", NOTE), F.regexp_extract_all("text", F.lit(NOTE), F.lit(1))
    joined = F.concat_ws("", F.flatten(F.zip_with(between, marks, lambda t, m: F.array(F.coalesce(t, F.lit("")), F.when(m.isNull(), "").otherwise(F.concat(F.lit("[^"), F.coalesce(F.try_element_at("_anew", m), m), F.lit("]")))))))
    rows = rows.withColumn("text", F.when(F.col("_anew").isNotNull() & (F.size(marks) > 0), joined).otherwise(F.col("text"))).drop("_anew")
    pieces_of = F.sort_array(F.collect_list(F.struct("page", "at", "joint", "text", "number")))
    whole = rows.groupBy("book", "kind", "n").agg(pieces_of.alias("_p"))
    glued = F.aggregate("_p", F.lit(""), lambda acc, p: F.when(p["joint"] == "", F.concat(F.regexp_replace(acc, r"-\s*$", ""), F.ltrim(p["text"]))).when(p["joint"] == " ", F.concat(F.rtrim(acc), F.lit(" "), F.ltrim(p["text"]))).otherwise(p["text"]))
    return whole.select("book", "kind", "n", F.col("_p")[0]["page"].alias("page"), F.col("_p")[0]["number"].alias("number"), glued.alias("text"))
