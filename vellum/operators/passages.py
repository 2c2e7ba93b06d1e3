"""Searches of books, works and passages: scopes, ranks of text, and passages of a source that may bear out a claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.operators.ranking import FAR, SQUARES, all_rank, any_rank, stems
from vellum.operators.relational import string_tokens
from vellum.operators.search import matches, parse_query
from vellum.session import written

#: Characters of a claim that are searched for whole, and in part; passages to a claim; how much of one is shown; the weight of body text.
WHOLE, PARTLY, PASSAGES, SHOWN, BODY, POSITIONS = 80, 200, 3, 1500, 0.1, 255
#: English words that searches leave out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "s t can will just don should now"
).split()


def _ranked(rows: DataFrame, fields: dict[str, str], text: str, any_: bool) -> DataFrame:
    """The rows whose fields, one after another, match a query, with rank; a word that starts with the query's prefix counts as it."""
    query = parse_query(text, any_)
    tokens = F.flatten(F.array(*[string_tokens(F.coalesce(F.col(c), F.lit(""))) for c in fields.values()]))
    words = list(dict.fromkeys(w for kind, v in query["parts"] for w in (v if kind == "phrase" else [v])))
    if not words:
        return rows.where(F.lit(False)).withColumn("rank", F.lit(0.0))
    prefixes = [v for kind, v in query["parts"] if kind == "prefix"]
    as_meant = lambda t: reduce(lambda c, p: F.when(t.startswith(p), F.lit(p)).otherwise(c), prefixes, t)
    read = {label: F.array_join(F.transform(string_tokens(F.coalesce(F.col(c), F.lit(""))), as_meant), " ") for label, c in fields.items()}
    return rows.where(matches(tokens, query)).withColumn("rank", F.round((any_rank if any_ else all_rank)(read, words), 6))


def library_page(library: DataFrame, text: str, most: int, scope: str = "public", creator: str | None = None, books: DataFrame | None = None, any_: bool = False) -> DataFrame:
    """(book, title, author, rank): a page of a search of books' titles (weight A) and authors (B).

    library: (book, title, author, type, visibility, listed, creator). Private books never show. scope: public, of listed books; mine, of the creator's; books, of
    those that the table books names (a shelf's). Sub-books, and books of unknown type, are left out. Ties go by book.
    """
    seen = library.where("visibility = 'public' AND type <> 'sub_book'")
    if scope == "public":
        seen = seen.where("listed")
    elif scope == "mine":
        seen = seen.where(F.col("creator") == creator)
    else:
        seen = seen.join(books.select("book").distinct(), "book", "left_semi")
    return _ranked(seen, {"A": "title", "B": "author"}, text, any_).orderBy(F.desc("rank"), "book").limit(most).select("book", "title", "author", "rank")


def citation_page(canonical: DataFrame, library: DataFrame, text: str, most: int, offset: int = 0, scope: str = "public", creator: str | None = None, shelf: DataFrame | None = None, any_: bool = False) -> DataFrame:
    """(row_type, id, title, author, best_version_book, has_version, is_private, rank): works, and books that stand for no work, in one page.

    canonical: (id, title, author, versions), versions in order of trust, of which the first that isn't null is the best. library: (book, title, author, type, visibility,
    listed, creator, canonical_id). In public, works are found whatever has become of them, and listed public books without one; in mine, the
    creator's books and the works that one of them is a version of; in a shelf (a table of books), all its books and their works. Each branch is cut before they are merged.
    """
    mine = {"public": lambda df: df.where("visibility = 'public' AND listed"), "mine": lambda df: df.where(F.col("creator") == creator), "shelf": lambda df: df.join(shelf.select("book").distinct(), "book", "left_semi")}[scope](library)
    best = F.try_element_at(F.array_compact("versions"), F.lit(1))
    works = canonical.select(F.col("id"), "title", "author", best.alias("best_version_book"), "versions")
    held = library.where("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("id")).distinct()
    if scope != "public":
        by_version = works.select("id", F.explode("versions").alias("book")).join(mine.select("book"), "book", "left_semi").select("id")
        by_link = mine.where("canonical_id IS NOT NULL").select(F.col("canonical_id").alias("id"))
        works = works.join(by_version.unionByName(by_link).distinct(), "id", "left_semi")
    found = _ranked(works, {"A": "title", "B": "author"}, text, any_).orderBy(F.desc("rank"), "id").limit(most)
    lock = library.select(F.col("book").alias("best_version_book"), (F.col("visibility") == "private").alias("is_private"))
    linked = held.withColumn("_held", F.lit(True))
    first = found.join(lock, "best_version_book", "left").join(linked, "id", "left")
    first = first.select(F.lit("canonical").alias("row_type"), F.col("id").cast("string").alias("id"), "title", "author", "best_version_book", (F.col("best_version_book").isNotNull() | F.coalesce("_held", F.lit(False))).alias("has_version"), F.coalesce("is_private", F.lit(False)).alias("is_private"), "rank")
    books = mine.where(F.coalesce(F.col("type") != "sub_book", F.lit(True)))
    books = books if scope == "shelf" else books.where("canonical_id IS NULL")
    second = _ranked(books, {"A": "title", "B": "author"}, text, any_).orderBy(F.desc("rank"), "book").limit(most)
    second = second.select(F.lit("library").alias("row_type"), F.col("book").cast("string").alias("id"), "title", "author", F.col("book").cast("string").alias("best_version_book"), F.lit(True).alias("has_version"), F.coalesce(F.col("visibility") == "private", F.lit(False)).alias("is_private"), "rank")
    return first.withColumn("best_version_book", F.col("best_version_book").cast("string")).unionByName(second).orderBy(F.desc("rank"), "row_type", "id").offset(offset).limit(most)


def _whole_rank(found: Column) -> Column:
    """Rank of a match of all terms, from an array of (term, positions), by the nearness of each two positions of two terms."""
    product = lambda xs: F.aggregate(xs, F.lit(1.0), lambda a, x: a * x)
    near = lambda x, y: F.when(F.abs(x - y) > 100, FAR).otherwise(1 / (1.005 + 0.05 * F.exp(F.abs(x - y) / 1.5 - 2)))
    rest = lambda i: F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0)))
    pair = lambda a, b: product(F.transform(a["positions"], lambda x: product(F.transform(b["positions"], lambda y: 1 - F.sqrt(BODY * BODY * near(x, y))))))
    return 1 - product(F.transform(found, lambda a, i: product(F.transform(rest(i), lambda b: pair(a, b)))))


def _partly_rank(found: Column, terms: Column) -> Column:
    """Rank of a match of any term: each by the squares of its places, over the terms of the query."""
    one = lambda e: F.aggregate(F.sequence(F.lit(1), F.size(e["positions"])), F.lit(0.0), lambda a, j: a + BODY / (j * j))
    return F.aggregate(found, F.lit(0.0), lambda a, e: a + one(e)) / SQUARES / terms


def claim_passages(claims: DataFrame, nodes: DataFrame, most: int = PASSAGES) -> DataFrame:
    """(claim, node, stage, rank, passage): for each claim the best passages of its source.

    claims: (claim, book, text); nodes: (book, node, text). First nodes that have all stems of the claim's first 80 characters, stop words aside; for claims
    that find none, nodes with any stem of the key terms of its first 200 (at most fifteen words of four letters or more); then with any of the
    words as they are. Claims and nodes meet by (book, term), never each with each; a term's first 255 positions count. Ties go by node.
    Passages are cut at 1,500 characters, which a mark tells. Null texts say and hold nothing.
    """
    tokens = F.posexplode(string_tokens(F.coalesce(F.col("text"), F.lit("")))).alias("at", "word")
    entries = nodes.select("book", "node", tokens)
    low = F.coalesce(F.col("text"), F.lit(""))
    plain = lambda n: F.filter(F.array_distinct(string_tokens(F.substring(low, 1, n))), lambda w: ~w.isin(STOP_WORDS))
    asked = claims.select("claim", "book", plain(WHOLE).alias("whole"), F.slice(F.filter(plain(PARTLY), lambda w: F.length(w) > 3), 1, 15).alias("partly"))
    # Only words whose stem some claim asks for are indexed.
    sought = asked.select(F.explode(F.array_union("whole", "partly")).alias("word")).distinct().select(stems(F.col("word")).alias("stem")).distinct()
    known = entries.select("word").distinct().select("word", stems(F.col("word")).alias("stem")).join(sought, "stem", "left_semi")
    index = written(entries.join(known, "word").select("book", "node", "word", "stem", (F.col("at") + 1).alias("at")), "passage-terms")

    def stage(name: str, words: str, stemmed: bool, pool: DataFrame) -> DataFrame:
        terms = pool.select("claim", "book", F.explode(words).alias("word"))
        if stemmed:
            of = terms.select("word").distinct().select("word", stems(F.col("word")).alias("term"))
            terms = terms.join(of, "word").select("claim", "book", "term").distinct()
        else:
            terms = terms.select("claim", "book", F.col("word").alias("term"))
        terms = terms.withColumn("n", F.count("*").over(W.partitionBy("claim")))
        places = index.select("book", "node", F.col("stem" if stemmed else "word").alias("term"), "at")
        places = places.join(terms.select("book", "term").distinct(), ["book", "term"], "left_semi").groupBy("book", "node", "term").agg(F.slice(F.sort_array(F.collect_list("at")), 1, POSITIONS).alias("positions"))
        met = terms.join(places, ["book", "term"]).groupBy("claim", "node", "n").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("found"))
        partly = _partly_rank(F.col("found"), F.col("n"))
        if name == "all":
            met = met.where(F.size("found") == F.col("n"))
            rank = F.when(F.col("n") == 1, partly).otherwise(_whole_rank(F.col("found")))
        else:
            rank = partly
        placed = met.select("claim", "node", F.round(rank, 4).alias("rank")).withColumn("_r", F.row_number().over(W.partitionBy("claim").orderBy(F.desc("rank"), "node")))
        return placed.where(F.col("_r") <= most).select("claim", "node", F.lit(name).alias("stage"), "rank")

    all_ = written(stage("all", "whole", True, asked), "passages-all")
    pool = asked.join(all_.select("claim").distinct(), "claim", "left_anti")
    any_ = written(stage("any", "partly", True, pool), "passages-any")
    pool = pool.join(any_.select("claim").distinct(), "claim", "left_anti")
    found = all_.unionByName(any_).unionByName(stage("words", "partly", False, pool))
    cut_ = F.concat(F.substring(F.col("text"), 1, SHOWN), F.when(F.length("text") > SHOWN, "\n[...TRUNCATED]").otherwise(""))
    shown = nodes.select("node", F.col("book").alias("_book"), cut_.alias("passage"))
    books = claims.select("claim", F.col("book").alias("_book"))
    return found.join(books, "claim").join(shown, ["node", "_book"]).select("claim", "node", "stage", "rank", "passage")
