"""Keyword and vector search: a small query language, phrase and prefix matching, weighted rank, headlines, cosine."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.operators.ranking import cover_rank
from vellum.operators.relational import string_tokens

MAX_PARTS = 6
#: Rank weights of fields A, B, C and D.
FIELD_WEIGHTS = {"A": 1.0, "B": 0.3, "C": 0.1, "D": 0.05}


def parse_query(text: str, any_: bool = False) -> dict:
    """{'any': bool, 'parts': [('phrase', [..]) | ('term', w) | ('prefix', w)]}: quoted phrases first, then the other terms.

    At most six parts; the last is a prefix unless it is a phrase. Hyphens part words within quotes only; characters other
    than ASCII letters, digits and underscore vanish from words.
    """
    bare = lambda words: [w for w in (re.sub(r"[^A-Za-z0-9_]", "", x).lower() for x in words) if w]
    quoted = [bare(re.split(r"[\s-]+", q)) for q in re.findall(r'"([^"]+)"', text)]
    parts: list[tuple[str, object]] = [("phrase", ws) if len(ws) > 1 else ("term", ws[0]) for ws in quoted if ws]
    parts += [("term", w) for w in bare(re.sub(r'"[^"]+"', "", text).split())]
    parts = parts[:MAX_PARTS]
    if parts and parts[-1][0] == "term":
        parts[-1] = "prefix", parts[-1][1]
    return {"any": any_, "parts": parts}


def matches(tokens: Column, query: dict) -> Column:
    """Predicate over a token array; an empty query matches nothing."""

    def one(kind: str, value) -> Column:
        if kind == "phrase":
            return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(value)} ")
        if kind == "prefix":
            return F.exists(tokens, lambda t: t.startswith(value))
        return F.array_contains(tokens, value)

    found = [one(*p) for p in query["parts"]]
    return reduce((lambda a, b: a | b) if query["any"] else (lambda a, b: a & b), found) if found else F.lit(False)


def possible(text: Column, query: dict) -> Column:
    """Whether a text may match a query, by the characters of its words alone: far cheaper than tokens, and true for every match."""
    low = F.lower(text)
    parts = [reduce(lambda a, b: a & b, [low.contains(w) for w in (value if kind == "phrase" else [value])]) for kind, value in query["parts"]]
    return reduce((lambda a, b: a | b) if query["any"] else (lambda a, b: a & b), parts) if parts else F.lit(False)


def node_page(hits: DataFrame, nodes: DataFrame, library: DataFrame, words: list[str], most: int, user: str | None = None, token: str | None = None) -> DataFrame:
    """(node, book, title, is_subbook, subbook_kind, parent_book, parent_title, rank, headline): a page of a search of nodes.

    hits (node): what the query matches; nodes (node, book, text); library (book, title, visibility, listed, creator, creator_token). Nodes of public listed books
    count, and of the reader's own that aren't deleted. The best by cover_rank come first, then the least ids. Parents of sub-books
    (book names with a slash; kind highlight where the last part begins with HL_, else footnote) are looked up for the page alone.
    """
    books = library.where(_readable(user, token)).select("book", "title")
    found = hits.select("node").join(nodes.select("node", "book", "text"), "node").join(books, "book")
    rank = F.round(cover_rank(F.col("text"), words), 6)
    page = found.withColumn("rank", rank).orderBy(F.desc("rank"), "node").limit(most)
    sub = F.col("book").contains("/")
    page = page.select(
        "node", "book", "title", sub.alias("is_subbook"), F.when(F.col("book").rlike("HL_[^/]*$"), "highlight").otherwise("footnote").alias("subbook_kind"),
        F.split_part("book", F.lit("/"), F.lit(1)).alias("parent_book"), "rank", headline(F.col("text"), words).alias("headline"),
    )
    parents = library.select(F.col("book").alias("_parent"), F.col("title").alias("parent_title"))
    joined = page.join(parents, F.col("is_subbook") & (F.col("parent_book") == F.col("_parent")), "left")
    return joined.select("node", "book", "title", "is_subbook", "subbook_kind", "parent_book", "parent_title", "rank", "headline")


def _readable(user: str | None, token: str | None) -> Column:
    """Public listed books, and the reader's own by name or token unless deleted; null is not readable."""
    open_ = F.col("listed") & ~F.col("visibility").isin("private", "deleted")
    own = F.lit(False)
    if user is not None:
        own = own | (F.col("creator") == user)
    if token is not None:
        own = own | (F.col("creator_token") == token)
    return F.coalesce(open_, F.lit(False)) | F.coalesce(own & (F.col("visibility") != "deleted"), F.lit(False))


def grouped_by_book(page: DataFrame) -> DataFrame:
    """(book, title, best, hits): a page's rows by book, each book's hits an array of structs, the best first; books by their best hit."""
    hit = F.struct((-F.col("rank")).alias("_less"), "node", "rank", "headline")
    rows = page.groupBy("book", "title").agg(F.max("rank").alias("best"), F.sort_array(F.collect_list(hit)).alias("_hits"))
    return rows.select("book", "title", "best", F.transform("_hits", lambda h: F.struct(h["node"].alias("node"), h["rank"].alias("rank"), h["headline"].alias("headline"))).alias("hits")).orderBy(F.desc("best"), "book")


def weighted_rank(fields: dict[str, Column], words: list[str]) -> Column:
    """Sum over fields of weight times the share of words the field holds: an approximation of weighted text rank."""
    score = F.lit(0.0)
    for label, text in fields.items():
        held = F.size(F.array_intersect(string_tokens(F.coalesce(text, F.lit(""))), F.array(*[F.lit(w) for w in words])))
        score = score + FIELD_WEIGHTS[label] * held / len(words)
    return score


def headline(text: Column, words: list[str], max_words: int = 35, min_words: int = 15) -> Column:
    """The window of at most max_words words with the most hits, hits in <mark>; min_words from the start where there are none."""
    wanted = {w.lower() for w in words}

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            tokens = (t or "").split()
            hit = [re.sub(r"\W", "", x).lower() in wanted for x in tokens]
            if not any(hit):
                return " ".join(tokens[:min_words])
            total = best = sum(hit[:max_words])
            at = 0
            for i in range(1, max(1, len(tokens) - max_words + 1)):
                total += hit[i + max_words - 1] - hit[i - 1]
                if total > best:
                    best, at = total, i
            return " ".join(f"<mark>{x}</mark>" if h else x for x, h in zip(tokens[at : at + max_words], hit[at : at + max_words], strict=True))

        return texts.map(one)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def cover_density(tokens: Column, words: list[str]) -> Column:
    """Proximity: words over the length of the span from the first to the last hit, 0 unless all are there."""
    places = [F.array_position(tokens, w) for w in words]
    span = F.greatest(*places) - F.least(*places) + 1 if len(places) > 1 else F.lit(1)
    every = reduce(lambda a, b: a & b, [p > 0 for p in places])
    return F.when(every, len(words) / span).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(df: DataFrame, vector: str, probe: list[float], k: int, key: str) -> DataFrame:
    """The k nearest by cosine distance; filters must come before, never after."""
    return df.withColumn("distance", 1 - cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in probe]))).orderBy("distance", key).limit(k)


def occurrences(text: Column, needle: str) -> Column:
    """Offsets in code points of all occurrences, overlapping ones too, whatever their case; a null text has null.

    The text is parted before each occurrence, so the work grows with its length.
    """
    low, want = F.lower(text), needle.lower()
    parts = F.split(low, r"(?=\Q" + want.replace(r"\E", r"\E\\E\Q") + r"\E)", -1)
    none = F.array().cast("array<int>")
    starts = F.aggregate(F.transform(parts, F.length), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]
    return F.when(low.startswith(want), starts).otherwise(F.slice(starts, 2, F.size(parts)))


def nearest(positions: Column, expected: Column) -> Column:
    """Of an array of positions the one nearest to where it is expected, the lesser of two; null if there is none."""
    return F.array_min(F.transform(positions, lambda p: F.struct(F.abs(p - expected).alias("gap"), p.alias("at"))))["at"]


def cascade(docs: DataFrame, id_col: str, text: Column, words: list[str], most: int) -> DataFrame:
    """docs with stage: the rows with all words, or with any of them where no row has all; the most hits, then the least ids.

    Rows are first kept by a plain test for the words' characters, then by their tokens; both stages are one scan. A guard of
    one row says whether the first stage found anything. Null texts hold no words.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    any_ = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    hits = F.size(F.array_intersect(string_tokens(low), F.array(*[F.lit(w) for w in words])))
    found = docs.where(any_).withColumn("_hits", hits).where("_hits > 0")
    top = found.agg(F.max("_hits").alias("_top"))
    staged = found.join(F.broadcast(top)).where((F.col("_top") < len(words)) | (F.col("_hits") == len(words)))
    stage = F.when(F.col("_hits") == len(words), "all").otherwise("any")
    return staged.orderBy(F.desc("_hits"), id_col).limit(most).withColumn("stage", stage).drop("_hits", "_top")
