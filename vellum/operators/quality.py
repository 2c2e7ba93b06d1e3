"""Judgements of documents from their blocks: signals of shells and noise, gaps of numbering, expected places, and orders of shelves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Phrases of pages that stand before a text, and the bounds of the signals.
BLOCK_PHRASES = (
    r"(?i)just a moment|attention required|access denied|are you a robot|robot check|captcha|page not found|\b404\b|\b403\b|server error|subscribe to (read|continue)|sign in to|log ?in required|cookie consent|before you continue|"
    r"search results|results for|access check|unusual traffic|verify (that )?you are (human|not a robot)|enable javascript and cookies|checking your browser"
)
LEAST_NODES, LEAST_CHARS, TOP_NODES, MOST_EMPTY, LEAST_ALPHA, MOST_REPEATED = 5, 2000, 10, 0.5, 0.6, 0.3


def quality_signals(nodes: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """(doc, nodes, chars, empty, alpha, repeated, signals): what speaks against a document, any of which flags it; a document without signals has an empty array.

    Texts are trimmed, null is empty. empty is the share of empty nodes; alpha the share of letters and white space in the others, repeated the share of these that
    stand there before; both null where all are empty. A phrase of a page that stands before a text counts in the first ten nodes.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    rows = nodes.select(F.col(doc).alias("doc"), body.alias("t"), F.row_number().over(W.partitionBy(doc).orderBy(pos)).alias("nth"))
    length, full = F.length("t"), F.col("t") != ""
    whole = rows.groupBy("doc").agg(
        F.count("*").alias("nodes"), F.sum(length).alias("chars"), F.avg((~full).cast("double")).alias("empty"), F.count_if(full).alias("_full"), F.sum(F.length(F.regexp_replace("t", r"[^\p{L}\s]", ""))).alias("_letters"),
        F.count_distinct(F.when(full, F.col("t"))).alias("_unlike"), F.bool_or((F.col("nth") <= TOP_NODES) & F.col("t").rlike(BLOCK_PHRASES)).alias("_blocked"),
    )
    alpha = F.when(F.col("chars") > 0, F.col("_letters") / F.col("chars"))
    repeated = F.when(F.col("_full") > 0, (F.col("_full") - F.col("_unlike")) / F.col("_full"))
    judged = whole.withColumns({"alpha": alpha, "repeated": repeated})
    signs = {"node_count": F.col("nodes") < LEAST_NODES, "total_chars": F.col("chars") < LEAST_CHARS, "block_page_phrase": F.col("_blocked"), "empty_nodes": F.col("empty") > MOST_EMPTY, "alpha_ratio": F.col("alpha") < LEAST_ALPHA, "duplicate_nodes": F.col("repeated") > MOST_REPEATED}
    return judged.select(F.col("doc").alias(doc), "nodes", "chars", "empty", "alpha", "repeated", F.array_compact(F.array(*[F.when(c, k) for k, c in signs.items()])).alias("signals"))


def numbering_audit(rows: DataFrame, doc: str, order: list[str], number: str) -> DataFrame:
    """(doc, section, kind, first, last, n): gaps and repetitions in the numbers of a document's markers.

    A number that is not above the one before it begins a new section, from 1. A gap is the numbers missing between two that follow one another, first
    to last, n of them; a repetition is a number with how often it stands in its section. Null numbers are left out.
    """
    by = W.partitionBy(doc).orderBy(*order)
    known = rows.where(F.col(number).isNotNull())
    starts = F.coalesce((F.col(number) <= F.lag(number).over(by)).cast("int"), F.lit(0))
    parted = known.select(F.col(doc), *order, F.col(number).cast("long").alias("_n"), starts.alias("_new"))
    parted = parted.withColumn("section", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)) + 1)
    after = F.lead("_n").over(W.partitionBy(doc, "section").orderBy(*order))
    gaps = parted.withColumn("_after", after).where(F.col("_after") > F.col("_n") + 1)
    gaps = gaps.select(doc, "section", F.lit("gap").alias("kind"), (F.col("_n") + 1).alias("first"), (F.col("_after") - 1).alias("last"), (F.col("_after") - F.col("_n") - 1).alias("n"))
    again = parted.groupBy(doc, "section", "_n").agg(F.count("*").alias("n")).where("n > 1")
    return gaps.unionByName(again.select(doc, "section", F.lit("duplicate").alias("kind"), F.col("_n").alias("first"), F.col("_n").alias("last"), "n"))


def expected_places(rows: DataFrame, doc: str, old: str, new: str, n_old: Column, n_new: Column) -> DataFrame:
    """rows with expected: where a block of place old (from 0) would be in a new version; for a matched one (new not null) its place.

    Between two matched neighbours it lies in proportion; without one of them it is the same share of the whole. Halves round up.
    """
    by = W.partitionBy(doc).orderBy(old)
    at = F.when(F.col(new).isNotNull(), F.struct(F.col(old).alias("o"), F.col(new).alias("n")))
    before, after = F.last(at, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)), F.first(at, ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing))
    placed = rows.withColumns({"_b": before, "_a": after})
    between = F.col("_b.n") + (F.col("_a.n") - F.col("_b.n")) * (F.col(old) - F.col("_b.o")) / (F.col("_a.o") - F.col("_b.o"))
    share = F.col(old) / n_old * n_new
    expected = F.coalesce(F.col(new), F.floor(F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), between).otherwise(share) + 0.5))
    return placed.withColumn("expected", expected.cast("long")).drop("_a", "_b")


def shelf_order(sort: str) -> list[Column]:
    """The order of a shelf's items (title, author, views, connected, lit, added, manual, year, volume, issue, created) by a sort's name; ties go by book.

    published goes by year, volume and issue, of these the first number in each, the greatest first; what has none comes last.
    """
    number = lambda c: F.regexp_extract(F.col(c), r"(\d+)", 1).try_cast("long").desc_nulls_last()
    most = lambda c: F.col(c).desc_nulls_last()
    orders = {
        "title": [F.lower("title").asc_nulls_last()], "author": [F.lower("author").asc_nulls_last()], "views": [most("views")], "connected": [most("connected")], "lit": [most("lit")], "added": [most("added")],
        "manual": [F.col("manual").asc_nulls_last()], "published": [number("year"), number("volume"), number("issue")], "year": [number("year")], "recent": [most("created")],
    }
    return [*orders[sort], F.col("book").asc()]
