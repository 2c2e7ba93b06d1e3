"""Searches through an index of terms, and pages of results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vellum.operators import search as S
from vellum.operators.passages import citation_page, claim_passages, library_page
from vellum.operators.termindex import TermIndex
from vellum.operators.vectors import VectorIndex, match_scores, widened
from vellum.plans.registry import query
from vellum.session import shared_dir, table as T

_SEARCHES = {
    "and": ("license versi", False, "list_contains(toks, 'license') AND len(list_filter(toks, lambda t: starts_with(t, 'versi'))) > 0"),
    "or": ("idiot apache", True, "list_contains(toks, 'idiot') OR len(list_filter(toks, lambda t: starts_with(t, 'apache'))) > 0"),
    "phrase": ('"under the apache license"', False, "contains(' ' || array_to_string(toks, ' ') || ' ', ' under the apache license ')"),
    "prefix": ("licen", False, "len(list_filter(toks, lambda t: starts_with(t, 'licen'))) > 0"),
}


@query("indexed_search", """
WITH now AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'Put anew, under the Apache License, version ' || doc_id ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 50 <> 1),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda t: t <> '') AS toks FROM now)
""" + " UNION ALL ".join(f"SELECT '{name}' AS query, doc_id FROM t WHERE {sql}" for name, (_, _, sql) in _SEARCHES.items()))
def indexed_search(spark, d):
    """Four searches of an index of all documents, after some were replaced and some deleted; each reads the folders of its own terms."""
    docs = T(spark, d, "documents").select("doc_id", "text")
    index = TermIndex(spark, f"{shared_dir(spark).rstrip('/')}/vellum-terms-{uuid.uuid4().hex}")
    index.build(docs, "doc_id", F.col("text"), buckets=64)
    new = docs.where("doc_id % 50 = 0").select("doc_id", F.concat(F.lit("Put anew, under the Apache License, version "), F.col("doc_id").cast("string")).alias("text"))
    index.upsert(new, "doc_id", F.col("text"), deleted=docs.where("doc_id % 50 = 1").select("doc_id"))
    found = [index.search(S.parse_query(text, any_)).select(F.lit(name).alias("query"), F.col("doc").alias("doc_id")) for name, (text, any_, _) in _SEARCHES.items()]
    return reduce(DataFrame.unionByName, found)


def _library(spark, d):
    """Books by source, some of them sub-books of one text; a third private, some of these the reader's own."""
    n = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    sub = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/HL_"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("/Fn"), F.col("doc_id").cast("string"))).otherwise("")
    nodes = T(spark, d, "documents").select(F.col("doc_id").alias("node"), F.concat(F.coalesce("source", F.lit("")), sub).alias("book"), "text", n.alias("n"), (sub == "").alias("whole"), F.coalesce("source", F.lit("")).alias("parent"))
    of = lambda rows, book: rows.select(F.col(book).alias("book"), F.concat(F.lit("Title of "), book).alias("title"), F.when(F.col("n") % 3 == 0, "private").otherwise("public").alias("visibility"), F.lit(True).alias("listed"), F.when(F.col("n") % 2 == 0, "me").alias("creator"), F.lit(None).cast("string").alias("creator_token"))
    return nodes, of(nodes.select("parent", "n").distinct(), "parent").unionByName(of(nodes.where("NOT whole"), "book"))


_PAGE = r"""
WITH f AS (SELECT doc_id AS node, coalesce(source, '') AS parent, coalesce(source, '') || CASE doc_id % 5 WHEN 0 THEN '/HL_' || doc_id WHEN 1 THEN '/Fn' || doc_id ELSE '' END AS book,
  coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS INT), 0) AS n, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS d FROM documents),
seen AS (SELECT * FROM f WHERE n % 3 <> 0 OR n % 2 = 0),
e AS (SELECT node, unnest(d) AS w, unnest(range(1, len(d) + 1)) AS pos FROM seen),
h AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY pos) AS i FROM e WHERE w IN ('license', 'the')),
l AS (SELECT *, max(pos) FILTER (WHERE w = 'license') OVER r AS a, max(pos) FILTER (WHERE w = 'the') OVER r AS b FROM h WINDOW r AS (PARTITION BY node ORDER BY pos)),
c AS (SELECT node, least(a, b) AS first, min(pos) AS last, min(i) AS i_last FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.node, round(sum(0.1::DOUBLE / (1 + (c.last - c.first) - (c.i_last - h.i))), 6) AS rank FROM c JOIN h ON h.node = c.node AND h.pos = c.first GROUP BY 1),
page AS (SELECT seen.*, rank FROM r JOIN seen USING (node) ORDER BY rank DESC, node LIMIT 25)"""


@query("node_search_page", _PAGE + """
SELECT node, book, 'Title of ' || book AS title, contains(book, '/') AS is_subbook, CASE WHEN contains(book, '/HL_') THEN 'highlight' ELSE 'footnote' END AS subbook_kind, parent AS parent_book, CASE WHEN contains(book, '/') THEN 'Title of ' || parent END AS parent_title, rank FROM page""")
def node_search_page(spark, d):
    """The first page of a search in what a reader may see: rank by nearness, parents of sub-books, headlines."""
    return _page(spark, d).drop("headline")


@query("node_search_grouped", _PAGE + """
SELECT book, 'Title of ' || book AS title, max(rank) AS best, count(*) AS n, array_to_string(list(node ORDER BY rank DESC, node), ',') AS nodes FROM page GROUP BY 1, 2""")
def node_search_grouped(spark, d):
    """The same page by book, each book's hits an array, the best first."""
    rows = S.grouped_by_book(_page(spark, d))
    return rows.select("book", "title", "best", F.size("hits").cast("long").alias("n"), F.array_join(F.transform("hits", lambda h: h["node"].cast("string")), ",").alias("nodes"))


def _page(spark, d):
    nodes, library = _library(spark, d)
    parsed = S.parse_query('"license" "the"')
    parsed["parts"] = [("term", w) for w in ("license", "the")]
    hits = nodes.where(S.possible(F.coalesce(F.col("text"), F.lit("")), parsed)).where(S.matches(S.string_tokens(F.coalesce(F.col("text"), F.lit(""))), parsed)).select("node")
    return S.node_page(hits, nodes.select("node", "book", "text"), library, ["license", "the"], 25, user="me")


@query("search_stages", """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '') AS toks FROM documents)
SELECT 'licensing' AS query, doc_id, 'stemmed' AS stage FROM t WHERE len(list_filter(toks, lambda t: t IN ('license', 'licensed', 'licenses', 'licensing', 'licens'))) > 0 AND NOT EXISTS (SELECT 1 FROM t WHERE list_contains(toks, 'licensing'))
UNION ALL SELECT 'license', doc_id, 'exact' FROM t WHERE list_contains(toks, 'license')""")
def search_stages(spark, d):
    """Two searches by stages: one word stands in texts as it is, the other only by its stem."""
    index = TermIndex(spark, f"{shared_dir(spark).rstrip('/')}/vellum-terms-{uuid.uuid4().hex}")
    index.build(T(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), buckets=64)
    found = [index.cascade({"any": False, "parts": [("term", w)]}).select(F.lit(w).alias("query"), F.col("doc").alias("doc_id"), "stage") for w in ("licensing", "license")]
    return found[0].unionByName(found[1])


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _sim(a: str, b: str) -> str:
    dot = lambda x, y: _DOT.format(a=x, b=y)
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


#: A search of several thoughts: the sum of three vectors.
_PROBE = "(SELECT list_transform(list_zip(a.embedding, b.embedding, c.embedding), lambda z: CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE) + CAST(z[3] AS DOUBLE)) AS embedding, b.label AS label FROM embeddings a, embeddings b, embeddings c WHERE a.vec_id = 0 AND b.vec_id = 3 AND c.vec_id = 6)"


def _near(among: str, k: int) -> str:
    return f"SELECT e.vec_id, 1 - {_sim('e.embedding', 'q.embedding')} AS distance FROM embeddings e, {_PROBE} q WHERE {among} ORDER BY distance, e.vec_id LIMIT {k}"


def _probe(spark, d) -> tuple[list[float], int]:
    """The sum of three vectors, and the label of the second."""
    rows = {r.vec_id: r for r in T(spark, d, "embeddings").where(F.col("vec_id").isin(0, 3, 6)).collect()}
    return [x + y + z for x, y, z in zip(rows[0].embedding, rows[3].embedding, rows[6].embedding, strict=True)], rows[3].label


def _index(spark, d) -> VectorIndex:
    index = VectorIndex(spark, f"{shared_dir(spark).rstrip('/')}/vellum-vectors-{uuid.uuid4().hex}")
    index.build(T(spark, d, "embeddings"), "vec_id", "embedding", cells=32)
    return index


@query("semantic_page", f"""
SELECT vec_id, round(1 - distance, 3) AS similarity, CAST(round(greatest(0, (1 - distance - 0.55) / 0.45) * 100) AS INT) AS match FROM ({_near("e.label % 3 <> 1", 20)}) WHERE distance <= 0.6""")
def semantic_page(spark, d):
    """The nearest vectors among visible labels, through the index: those near enough, with the share of the way from the floor."""
    visible = T(spark, d, "embeddings").select("label").distinct().where("label % 3 <> 1")
    found = _index(spark, d).nearest(_probe(spark, d)[0], 20, visible, "label")
    return match_scores(found).select("vec_id", "similarity", "match")


@query("semantic_nearest", f"SELECT vec_id, round(distance, 6) AS distance FROM ({_near('true', 50)})")
def semantic_nearest(spark, d):
    """The fifty nearest vectors, whatever their distance."""
    return _index(spark, d).nearest(_probe(spark, d)[0], 50).select("vec_id", F.round("distance", 6).alias("distance"))


@query("retrieval_widened", f"""
WITH narrow AS (SELECT * FROM ({_near("e.label = q.label", 10)}) WHERE distance <= 0.6), wide AS (SELECT * FROM ({_near("true", 10)}) WHERE distance <= 0.6)
SELECT vec_id, 'narrow' AS scope FROM narrow UNION ALL SELECT vec_id, 'wide' FROM wide WHERE (SELECT count(*) FROM narrow) < 3 AND vec_id NOT IN (SELECT vec_id FROM narrow)""")
def retrieval_widened(spark, d):
    """Nearest vectors of one label, an author's; as these are few, those of all."""
    probe, label = _probe(spark, d)
    index = _index(spark, d)
    narrow, wide = (match_scores(index.nearest(probe, 10, where=w)).select("vec_id") for w in (F.col("label") == label, None))
    return widened(narrow, wide, "vec_id")


def _rank_sql(name: str, rows: str) -> str:
    """CTEs that rank rows (id, title, author) for "small" and a word that starts with "ri", both wanted."""
    toks = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9_]+'), lambda x: x <> '')"
    return f"""
{name}_f AS (SELECT id, {toks('title')} AS a, {toks('author')} AS b FROM {rows}),
{name}_e AS (SELECT id, unnest(list_concat(a, b)) AS w, unnest(range(1, len(a) + len(b) + 1)) AS pos, len(a) AS n_a FROM {name}_f),
{name}_h AS (SELECT id, CASE WHEN w = 'small' THEN 'small' ELSE 'ri' END AS w, pos, CASE WHEN pos <= n_a THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS weight FROM {name}_e WHERE w = 'small' OR starts_with(w, 'ri')),
{name} AS (SELECT x.id, round(1 - product(1 - sqrt(x.weight * y.weight / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2)))), 6) AS rank FROM {name}_h x JOIN {name}_h y ON x.id = y.id AND x.w = 'small' AND y.w = 'ri' GROUP BY 1)"""


_PARTS = "(SELECT p_partkey AS id, p_name AS title, p_type AS author, CASE WHEN p_size % 9 = 0 THEN 'sub_book' WHEN p_size % 11 <> 0 THEN 'book' END AS type, CASE WHEN p_size < 40 THEN 'public' ELSE 'private' END AS visibility, p_size % 4 <> 0 AS listed, p_brand AS creator FROM part)"


@query("library_scopes", f"""
WITH p AS {_PARTS}, {_rank_sql("r", "p")}, ok AS (SELECT p.*, rank FROM p JOIN r USING (id) WHERE visibility = 'public' AND type <> 'sub_book')
""" + " UNION ALL ".join(f"SELECT '{name}' AS scope, * FROM (SELECT id AS book, title, author, rank FROM ok WHERE {where} ORDER BY rank DESC, id LIMIT 12)" for name, where in {"public": "listed", "mine": "creator = 'Brand#12'", "books": "id % 7 = 0"}.items()))
def library_scopes(spark, d):
    """One search in three scopes: public listed books, the reader's own, a shelf's."""
    size = F.col("p_size")
    library = T(spark, d, "part").select(
        F.col("p_partkey").alias("book"), F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.when(size % 9 == 0, "sub_book").when(size % 11 != 0, "book").alias("type"),
        F.when(size < 40, "public").otherwise("private").alias("visibility"), (size % 4 != 0).alias("listed"), F.col("p_brand").alias("creator"),
    )
    shelf = library.where("book % 7 = 0").select("book")
    pages = {"public": library_page(library, "small ri", 12), "mine": library_page(library, "small ri", 12, "mine", "Brand#12"), "books": library_page(library, "small ri", 12, "books", books=shelf)}
    return reduce(DataFrame.unionByName, [page.select(F.lit(name).alias("scope"), "book", "title", "author", "rank") for name, page in pages.items()])


_COLOURS, _THINGS = ["small", "red", "old"], ["ring", "rod", "rivet", "gear"]
_ORDERS = f"(SELECT o_orderkey AS id, {_COLOURS!r}[o_orderkey % 3 + 1] || ' ' || {_THINGS!r}[o_orderkey % 4 + 1] AS title, o_orderpriority AS author, CASE WHEN o_orderkey % 13 = 0 THEN 'sub_book' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'private' ELSE 'public' END AS visibility, o_orderkey % 5 <> 0 AS listed, CASE WHEN o_custkey % 10 = 0 THEN 'me' END AS creator, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS canonical_id FROM orders)"


def _citation_sql(scope: str) -> str:
    mine = {"public": "visibility = 'public' AND listed", "mine": "creator = 'me'", "shelf": "id % 50 = 2"}[scope]
    works = "true" if scope == "public" else f"id IN (SELECT w FROM (SELECT id AS w, unnest(versions) AS v FROM work) JOIN (SELECT id AS v FROM book WHERE {mine}) USING (v)) OR id IN (SELECT canonical_id FROM book WHERE {mine} AND canonical_id IS NOT NULL)"
    return f"""
SELECT '{scope}' AS scope, * FROM (SELECT * FROM (
  SELECT * FROM (SELECT 'canonical' AS row_type, CAST(w.id AS VARCHAR) AS id, w.title, w.author, CAST(w.best AS VARCHAR) AS best_version_book, w.best IS NOT NULL OR w.id IN (SELECT canonical_id FROM book WHERE canonical_id IS NOT NULL) AS has_version,
    coalesce(b.visibility = 'private', false) AS is_private, w.rank FROM (SELECT * FROM (SELECT work.*, rank FROM work JOIN rw USING (id)) WHERE {works} ORDER BY rank DESC, id LIMIT 15) w LEFT JOIN book b ON b.id = w.best)
  UNION ALL SELECT * FROM (SELECT 'library', CAST(id AS VARCHAR), title, author, CAST(id AS VARCHAR), true, visibility = 'private', rank FROM book JOIN rb USING (id) WHERE {mine} AND type IS DISTINCT FROM 'sub_book' AND {"true" if scope == "shelf" else "canonical_id IS NULL"} ORDER BY rank DESC, id LIMIT 15))
ORDER BY rank DESC, row_type, id LIMIT 15)"""


@query("citation_pages", f"""
WITH work AS (SELECT *, list_filter(versions, lambda v: v IS NOT NULL)[1] AS best FROM (SELECT p_partkey AS id, p_name AS title, p_type AS author, [CASE WHEN p_size % 3 = 0 THEN p_partkey END, CASE WHEN p_size % 5 = 0 THEN p_partkey + 1 END] AS versions FROM part)),
book AS {_ORDERS}, {_rank_sql("rw", "work")}, {_rank_sql("rb", "book")}
""" + " UNION ALL ".join(map(_citation_sql, ("public", "mine", "shelf"))))
def citation_pages(spark, d):
    """Works and unlinked books for a citation, in three scopes."""
    size, key, k = F.col("p_size"), F.col("p_partkey"), F.col("o_orderkey")
    works = T(spark, d, "part").select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.array(F.when(size % 3 == 0, key), F.when(size % 5 == 0, key + 1)).alias("versions"))
    of = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    library = T(spark, d, "orders").select(
        k.alias("book"), F.concat(of(_COLOURS, 3), F.lit(" "), of(_THINGS, 4)).alias("title"), F.col("o_orderpriority").alias("author"), F.when(k % 13 == 0, "sub_book").alias("type"), F.when(F.col("o_orderstatus") == "P", "private").otherwise("public").alias("visibility"),
        (k % 5 != 0).alias("listed"), F.when(F.col("o_custkey") % 10 == 0, "me").alias("creator"), F.when(k % 4 == 0, F.col("o_custkey")).alias("canonical_id"),
    )
    shelf = library.where("book % 50 = 2").select("book")
    pages = {s: citation_page(works, library, "small ri", 15, scope=s, creator="me", shelf=shelf) for s in ("public", "mine", "shelf")}
    return reduce(DataFrame.unionByName, [page.withColumn("scope", F.lit(s)) for s, page in pages.items()])


@query("claim_passages")
def claims_borne_out(spark, d):
    """The benchmark's texts as claims, each held against the documents of one source."""
    claims = T(spark, d, "benchmark").select(F.col("item_id").alias("claim"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("book"), "text")
    nodes = T(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("node"), "text")
    return claim_passages(claims, nodes)
