"""Bibliographies of documents: where the list of references stands, which of its paragraphs are entries, and what entries are known by.

A document's blocks are rows (doc, pos, tag, text) in the order of pos. Regions are found by running maxima over a document's blocks, runs
without a heading as islands between paragraphs that are no references; a document is one sort, which spills. Keys of entries are
made row by row in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType

from vellum.operators.references import authors, reference_keys, reference_year
from vellum.session import spread

#: Headings of reference lists, openings of journal matter that only looks like an entry, the label of a self-citation, particles that open an entry.
HEADINGS = ["references", "bibliography", "works cited", "sources", "literature cited", "reference list", "cited references", "list of references", "references cited", "citations", "cited works"]
CITE_LABEL = r"(?i)^\s*(?:how\s+)?to\s+cite\s+this\s+(?:article|paper|work)\b"
MATTER = [
    r"article\s+copyright\b",
    r"copyright\s*[:©]",
    r"©\s*\d{4}",
    r"orcid(?:\s+id)?\s*[:.]",
    r"(?:how\s+)?to\s+cite\s+this\s+(?:article|paper|work)\b",
    r"cite\s+this\s+(?:article|paper|work)\s+as\b",
    r"published\s+by\s+.{0,80}?\bon\s+\d{1,2}\s+\w+\s+\d{4}\s*$",
    r"(?:submitted|received|revised|accepted)\s+on\s+\d{1,2}\s+\w+\s+\d{4}\b",
    r"competing\s+interests?\s*[:.]",
    r"conflicts?\s+of\s+interest\s*[:.]",
    r"correspondence\s*[:.]",
    r"e-?mail\s*[:.]",
    r"received\s*[:.].{0,60}accepted\s*[:.]",
    r"this\s+is\s+an\s+open[- ]access\s+article\b",
]
PARTICLE = r"(?i:von|van|de|du|da|del|della|le|la|los|las|den|der|het|ten|ter)\s+\p{Lu}"
DASH = r"^\s*[-\u2012-\u2015\u2e3a\u2e3b]{1,3}[.,\s]"
#: Entries that a run without a heading needs, how near a year is to its entry's start, the least density of ordinals, and when entries are too long.
RUN, NEAR, DENSITY, LONG, TIMES = 3, 80, 0.5, 500, 3

_LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)]


def _has(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def split_paragraphs(blocks: DataFrame) -> DataFrame:
    """blocks with line: a paragraph of several lines, two of which look like entries, becomes a row for each line; others have line 0."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: F.btrim(t, F.lit(" \t\r"))), lambda t: t != "")
    entries = F.size(F.filter(lines, lambda t: t.rlike(r"^\p{Lu}") & t.rlike(r"\d{4}")))
    crammed = (F.col("tag") == "p") & F.contains("text", F.lit("\n")) & (F.size(lines) >= 2) & (entries >= 2)
    return blocks.select("*", F.posexplode(F.when(crammed, lines).otherwise(F.array("text"))).alias("line", "_one")).drop("text").withColumnRenamed("_one", "text")


def entry_like(text: Column, after_label: Column) -> Column:
    """Whether a paragraph may be an entry: it has a year, is no journal matter and no self-citation, and begins as entries do."""
    ordinal = r"^\s*\d{1,4}[.)]\s+"
    shapes = [r"^\s*\[\d+\]", rf"^\s*{PARTICLE}", DASH, r"^\s*\p{Lu}", ordinal + r"\p{Lu}[\p{L}'’-]+,\s", ordinal + r"(?s:\p{Lu}.{0,60}?\(\d{4}[a-z]?\))", ordinal + r"\p{Ll}[\w'’-]*(?:\s+[\w'’-]+){0,3}[.,]\s+\(?(?:19|20)\d{2}[a-z]?\)?[.,]"]
    return text.rlike(r"\d{4}") & ~text.rlike(rf"(?i)^\s*(?:{'|'.join(MATTER)})") & ~after_label & _has(text, *shapes)


def _structured(text: Column) -> Column:
    """Whether a paragraph shows from its start on that it is an entry: a surname with initials, a name and a year in brackets, a number, a dash, a particle."""
    return _has(text, r"^\s*[A-Z][a-zA-Z'’-]+,\s+(?:[A-Z]\.|[A-Z][a-z])", r"^\s*[A-Z][a-zA-Z'’-]+.{0,40}?\(\d{4}[a-z]?\)", r"^\s*\[\d+\]", DASH, rf"^\s*{PARTICLE}")


def reference_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc, pos, line, text, by_heading): the paragraphs of each document that are entries of its reference list.

    Under a heading that names a list, entries go on to the next heading of its level or above; not to one that two of the next
    three paragraphs are entries after. Documents without any such entry give the last run of entries, if it has three, or one that shows its
    structure, or a paragraph before it that names a list. Entries with ordinals go where three or more of them fill less than half
    of their range: these are notes. Null texts are empty.
    """
    rows = split_paragraphs(blocks.withColumn("text", F.coalesce(F.col("text"), F.lit(""))))
    order = W.partitionBy("doc").orderBy("pos", "line")
    whole = W.partitionBy("doc")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    p, text = F.col("tag") == "p", F.col("text")
    label = lambda k: F.lag(F.col("text").rlike(CITE_LABEL)).over(order) if k == 1 else F.lag(F.col("text").rlike(CITE_LABEL), k).over(order)
    is_p = lambda k: F.lag(p, k).over(order)
    after_label = F.coalesce(F.when(is_p(1), label(1)).when(is_p(2), label(2)), F.lit(False))
    named = F.lower(F.btrim(text, F.lit(" \t\r\n"))).isin(HEADINGS)
    rows = rows.select("doc", "pos", "line", "tag", "text", F.row_number().over(order).alias("at"), after_label.alias("labelled"), named.alias("named"), F.sum(p.cast("int")).over(upto).alias("nth"))
    rows = rows.withColumn("like", p & entry_like(text, F.col("labelled")))
    # What the next three paragraphs after a heading are: rows whose paragraph number is one to three more.
    ahead = W.partitionBy("doc").orderBy("nth").rangeBetween(1, 3)
    soon = F.col("like") & F.substring(text, 1, NEAR).rlike(r"\d{4}")
    level = F.regexp_extract("tag", r"^h([1-6])$", 1).try_cast("int")
    rows = rows.withColumn("level", level).withColumn("peeked", F.sum(p.cast("int")).over(ahead)).withColumn("entries_ahead", F.sum(soon.cast("int")).over(ahead))
    ends = F.col("level").isNotNull() & ~(F.coalesce(F.col("peeked") >= 2, F.lit(False)) & F.coalesce(F.col("entries_ahead") >= 2, F.lit(False)))
    opened = lambda k: F.max(F.when(F.col("named") & (F.col("level") == k), F.col("at"))).over(upto)
    closed = lambda k: F.max(F.when(ends & (F.col("level") <= k), F.col("at"))).over(upto)
    within = reduce(lambda a, b: a | b, [F.coalesce(F.coalesce(closed(k), F.lit(0)) <= opened(k), F.lit(False)) for k in range(1, 7)])
    rows = rows.withColumn("listed", F.col("like") & within).withColumn("by_heading", F.max("listed").over(whole))
    # Islands: paragraphs that are no entries part them; the last island is the one after as many of these as any entry has before it.
    paragraphs = rows.where(p).withColumn("island", F.sum((~F.col("like")).cast("int")).over(upto))
    last = F.max(F.when(F.col("like"), F.col("island"))).over(whole)
    paragraphs = paragraphs.withColumn("in_last", F.col("island") == last)
    run = F.col("like") & F.col("in_last")
    trusted = F.max(F.col("in_last") & ~F.col("like") & F.col("named")).over(whole) | F.max(run & _structured(text)).over(whole) | (F.sum(run.cast("int")).over(whole) >= RUN)
    kept = paragraphs.withColumn("trusted", F.coalesce(trusted, F.lit(False))).where(F.col("listed") | (~F.col("by_heading") & run & F.col("trusted")))
    number = F.regexp_extract("text", r"^\s*(\d{1,4})[.)]\s", 1).try_cast("int")
    kept = kept.select("doc", "pos", "line", "text", "by_heading", number.alias("number"))
    share = F.size(F.collect_set("number").over(whole)) / (F.max("number").over(whole) - F.min("number").over(whole) + 1)
    sparse = (F.count("number").over(whole) >= 3) & (share < DENSITY)
    return kept.withColumn("sparse", F.coalesce(sparse, F.lit(False))).where("number IS NULL OR NOT sparse").drop("number", "sparse")


def entry_keys(text: str) -> list[str]:
    """Keys of an entry: those of its authors and year; the same with the last other year after a year in brackets; for an entry that has
    no name before its year in brackets, those of the names after it.
    """
    keys = reference_keys(text)
    found = reference_year(text)
    if not found or text[found[1] - 1 : found[1]] != "(":
        return keys
    year, rest = found[0], text[found[1] + len(found[0]) + 1 :]
    others = [y for y in re.findall(r"(?<!\d)\d{4}(?!\d)", rest) if 1900 <= int(y) <= 2099 and y != year]
    if not keys:
        names = authors(rest)
        keys = reference_keys(f"{', '.join(' '.join(p.words) for p in names)} ({year})") if names else []
    return list(dict.fromkeys([*keys, *(k.removesuffix(year) + others[-1] for k in keys if others)]))


def _keys(of: Callable[[str], list[str]], text: Column) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(each, ArrayType(StringType()))(text)


def bibliography(blocks: DataFrame, rows: int | None = None) -> DataFrame:
    """(doc, pos, line, text, entry_id, keys, duplicate, by_heading): the entries of each document's reference list, with what they are known by.

    A dash for an author stands for that of the entry before. entry_id is the likeliest key; different works of one
    key get letters in order, which no other entry of the document has by itself; an entry that repeats one (its first 60 letters and digits) has the id of
    the first and is marked. Entries without a key can't be cited and have a null id. List marks of most entries go. Where rows says how many rows
    blocks has at most, documents are dealt by it before they are sorted, and anew where keys were made, so that a task's share doesn't grow.
    """
    dealt = lambda df: df if rows is None else spread(df, rows, "doc")
    found = _entries(reference_paragraphs(dealt(blocks)), dealt)
    return found.select("doc", "pos", "line", "text", "entry_id", "keys", "duplicate", "by_heading")


def _entries(rows: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Paragraphs of reference lists with what bibliography() adds; dealt brings each document's rows into one task."""
    whole, order = W.partitionBy("doc"), W.partitionBy("doc").orderBy("pos", "line")
    marked = F.col("text").rlike(r"^\s*[-*]\s")
    rows = rows.withColumn("_bullets", F.avg(marked.cast("double")).over(whole))
    rows = rows.withColumn("text", F.when(F.col("_bullets") > 0.5, F.regexp_replace("text", r"^\s*[-*]\s+", "")).otherwise(F.col("text")))
    dashed = F.col("text").rlike(DASH)
    rows = dealt(rows.withColumn("_own", _keys(entry_keys, F.col("text")))).withColumn("_dashed", dashed)
    author = F.when(~F.col("_dashed") & (F.size("_own") > 0), F.regexp_replace(F.regexp_extract("text", r"(?s)^(.*?)\d{4}", 1), r"[ .,;:(]+$", ""))
    rows = rows.withColumn("_author", F.last(author, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    again = F.col("_dashed") & F.col("_author").isNotNull()
    filled = F.concat("_author", F.regexp_replace("text", DASH.replace("[.,\\s]", ""), ""))
    rows = rows.withColumn("keys", F.when(again, _keys(reference_keys, F.when(again, filled).otherwise(F.lit("")))).otherwise(F.col("_own")))
    rows = dealt(rows.withColumn("_base", F.try_element_at("keys", F.lit(1))))
    rows = rows.withColumn("_probe", F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 1, 60))
    alike = W.partitionBy("doc", "_base", "_probe").orderBy("pos", "line")
    rows = rows.withColumn("duplicate", F.col("_base").isNotNull() & (F.row_number().over(alike) > 1)).withColumn("_first", F.first(F.struct("pos", "line")).over(alike))
    rows = rows.withColumn("_work", F.dense_rank().over(W.partitionBy("doc", "_base").orderBy("_first"))).withColumn("_works", F.size(F.collect_set("_probe").over(W.partitionBy("doc", "_base"))))
    stem, letter = F.regexp_extract("_base", r"^(.*\d{4})[a-z]?$", 1), F.regexp_extract("_base", r"\d{4}([a-z]?)$", 1)
    rows = rows.withColumn("_stem", stem).withColumn("_taken", F.collect_set(letter).over(W.partitionBy("doc", "_stem")))
    free = F.when(letter == "", F.array_except(F.array(*map(F.lit, _LETTERS)), F.col("_taken"))).otherwise(F.array(*map(F.lit, _LETTERS)))
    suffix = F.coalesce(F.try_element_at(free, F.col("_work")), F.concat(F.lit("_"), F.col("_work").cast("string")))
    entry = F.when(F.col("_works") == 1, F.col("_base")).otherwise(F.concat("_base", suffix))
    return rows.withColumn("entry_id", entry)


def key_map(entries: DataFrame) -> DataFrame:
    """(doc, key, entry_id): which entry a key means; of several the last."""
    rows = entries.select("doc", F.explode("keys").alias("key"), F.struct("pos", "line").alias("_at"), "entry_id")
    return rows.groupBy("doc", "key").agg(F.max_by("entry_id", "_at").alias("entry_id"))


def entry_flags(entries: DataFrame) -> DataFrame:
    """entries with glued and overlong: several years in brackets, and at least 500 characters and three times the document's median (the upper of two)."""
    size = F.length("text")
    rank, n = F.row_number().over(W.partitionBy("doc").orderBy(size, "pos", "line")), F.count("*").over(W.partitionBy("doc"))
    placed = entries.withColumn("_rank", rank).withColumn("_n", n)
    middle = F.max(F.when(F.col("_rank") == F.expr("_n div 2 + 1"), size)).over(W.partitionBy("doc"))
    glued = F.size(F.regexp_extract_all("text", F.lit(r"\((?:19|20)\d{2}[a-z]?\)"), F.lit(0))) >= 2
    return placed.withColumn("glued", glued).withColumn("overlong", size >= F.greatest(F.lit(LONG), TIMES * middle)).drop("_rank", "_n")


def bibliography_health(entries: DataFrame) -> DataFrame:
    """(doc, entries, glued, overlong, suspect): how a document's entries look; suspect with two glued, or with a tenth overlong."""
    counts = entry_flags(entries).groupBy("doc").agg(F.count("*").alias("entries"), F.count_if("glued").alias("glued"), F.count_if("overlong").alias("overlong"))
    return counts.withColumn("suspect", (F.col("glued") >= 2) | (F.col("overlong") >= 0.1 * F.col("entries")))
