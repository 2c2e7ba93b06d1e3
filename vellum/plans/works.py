"""Crawls, bibliographies and in-text links as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.operators import bibliography as B, crawl as C, references as Refs
from vellum.plans.registry import query
from vellum.session import shared_dir, spread, table as T

MAX_WORKS, MAX_DEPTH = 150, 3


def _level(d: int) -> str:
    """One level of the crawl: its plan, what the budget leaves of it, and the books it adds."""
    tried = " UNION ALL ".join(["SELECT NULL::BIGINT AS work, NULL AS status WHERE false", *(f"SELECT work, status FROM done{k}" for k in range(1, d))])
    seen = " UNION ALL ".join(f"SELECT book FROM front{k}" for k in range(d))
    return f"""
tried{d} AS MATERIALIZED ({tried}),
plan{d} AS MATERIALIZED (
  SELECT work, parent_book, row_number() OVER (ORDER BY ordinal, cited_by DESC, work) AS position, status, version FROM (
    SELECT e.work, min(f.ordinal) AS ordinal, arg_min(f.book, f.ordinal) AS parent_book FROM front{d - 1} f JOIN edges e ON e.book = f.book GROUP BY 1
  ) JOIN works USING (work) WHERE work NOT IN (SELECT work FROM tried{d} WHERE work IS NOT NULL)),
done{d} AS MATERIALIZED (
  SELECT work, parent_book, position, CASE WHEN position <= left_ THEN status ELSE 'capped' END AS status, CASE WHEN position <= left_ AND status = 'assigned' THEN version END AS book
  FROM plan{d}, (SELECT {MAX_WORKS} - count(*) FILTER (WHERE status <> 'capped') AS left_ FROM tried{d}) WHERE NOT EXISTS (SELECT 1 FROM tried{d} WHERE status = 'capped')),
front{d} AS MATERIALIZED (SELECT book, min(position) AS ordinal FROM done{d} WHERE book IS NOT NULL AND book NOT IN ({seen}) GROUP BY 1)"""


@query("crawled_network", f"""
WITH edges AS MATERIALIZED (SELECT DISTINCT l_orderkey AS book, l_partkey AS work FROM lineitem),
works AS MATERIALIZED (SELECT p_partkey AS work, p_size AS cited_by, CASE WHEN p_size % 7 = 0 THEN 'fetch_failed' ELSE 'assigned' END AS status, p_partkey AS version FROM part WHERE p_size > 5),
front0 AS MATERIALIZED (SELECT l_orderkey AS book, row_number() OVER (ORDER BY l_orderkey) AS ordinal FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300)),
{",".join(_level(d) for d in range(1, MAX_DEPTH + 1))}
SELECT work, book, depth, parent_book, position, status FROM ({" UNION ALL ".join(f"SELECT *, {d} AS depth FROM done{d}" for d in range(1, MAX_DEPTH + 1))})""")
def crawled_network(spark, d):
    """A crawl from the books of the largest orders: parts are works, a part's version book is the order of its number; {MAX_WORKS} attempts in slices of 40."""
    lines = T(spark, d, "lineitem")
    edges = lines.select(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("work"))
    works = T(spark, d, "part").select(
        F.col("p_partkey").alias("work"), (F.col("p_size") > 5).alias("eligible"), F.col("p_size").alias("cited_by"), F.lit(0.0).alias("cost"),
        F.when(F.col("p_size") % 7 == 0, "fetch_failed").otherwise("assigned").alias("outcome"), F.col("p_partkey").alias("version"),
    )
    roots = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 300").select(F.col("l_orderkey").alias("book"), F.col("l_orderkey").alias("ordinal"))
    folder = f"{shared_dir(spark).rstrip('/')}/vellum-crawl-{uuid.uuid4().hex}"
    return C.crawl(edges, works, roots, folder, max_depth=MAX_DEPTH, max_works=MAX_WORKS, slice_works=40).drop("cost")


_NAMES = ["Adorno", "Butler", "Cixous", "Derrida", "Eagleton", "Foucault", "Gramsci", "Haraway"]
_SQL_NAMES = "['" + "', '".join(_NAMES) + "']"


def _name(k):
    return F.element_at(F.array(*map(F.lit, _NAMES)), (k % 8 + 1).cast("int"))


def _entries(spark, d):
    """Books of a customer's orders: prose, then by style a headed list of references, one without a heading, one with subheadings, or none."""
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.year("o_orderdate").cast("string").alias("year"))
    style, k = F.col("doc") % 4, F.col("o_orderkey")
    entry = F.when(k % 7 == 0, F.concat(F.lit("—. "), "year", F.lit(". Order "), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(_name(k), F.lit(", A. ("), "year", F.lit("). Order "), F.lpad(k.cast("string"), 9, "0")))
    listed = o.where(style != 3).select("doc", (k + 1000).alias("pos"), F.lit("p").alias("tag"), F.when(k % 11 == 0, "© 2019 The publisher").otherwise(entry).alias("text"))
    prose = o.select("doc", (-k).alias("pos"), F.lit("p").alias("tag"), F.concat(F.lit("as ordered in "), "year", F.lit(" by many")).alias("text"))
    books = o.select("doc").distinct()
    heading = books.where(style.isin(0, 2)).select("doc", F.lit(0).cast("long").alias("pos"), F.lit("h2").alias("tag"), F.when(style == 0, "References").otherwise("WORKS CITED").alias("text"))
    letters = o.where((style == 2) & (k % 5 == 0)).select("doc", (k + 1000).alias("pos"), F.lit("h3").alias("tag"), F.lit("A").alias("text"))
    end = books.where(style == 0).select("doc", F.lit(10**12).alias("pos"), F.lit("h2").alias("tag"), F.lit("Index").alias("text")).unionByName(books.where(style == 0).select("doc", F.lit(10**12 + 1).alias("pos"), F.lit("p").alias("tag"), F.lit("Printed in 1999.").alias("text")))
    return prose.unionByName(listed).unionByName(heading).unionByName(letters).unionByName(end)


@query("bibliography_entries", f"""
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, CAST(year(o_orderdate) AS VARCHAR) AS y, o_custkey % 4 AS style FROM orders WHERE o_custkey % 4 <> 3),
islands AS (SELECT *, count(*) FILTER (WHERE k % 11 = 0) OVER (PARTITION BY doc ORDER BY k) AS island FROM o),
kept AS (SELECT *, CASE WHEN k % 7 <> 0 THEN lower({_SQL_NAMES}[k % 8 + 1]) END AS name FROM (SELECT *, max(island) FILTER (WHERE k % 11 <> 0) OVER (PARTITION BY doc) AS last FROM islands) WHERE k % 11 <> 0 AND (style <> 1 OR island = last)),
named AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k) || y AS base FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY k) AS r, count(*) OVER (PARTITION BY doc, base) AS n FROM named)
SELECT doc, k + 1000 AS pos, CASE WHEN n = 1 THEN base ELSE base || chr(CAST(96 + r AS INT)) END AS entry_id, style <> 1 AS by_heading FROM placed""")
def bibliography_entries(spark, d):
    most = 6 * T(spark, d, "orders").count()  # an order has prose, an entry and a letter, a document three headings more
    return B.bibliography(_entries(spark, d), most).select("doc", "pos", "entry_id", "by_heading")


@query("bibliography_health", """
WITH o AS (SELECT s_nationkey AS doc, s_suppkey AS k, CASE s_suppkey % 10 WHEN 0 THEN 600 ELSE 20 END + CASE s_suppkey % 9 WHEN 0 THEN 30 ELSE 0 END AS size, s_suppkey % 9 = 0 AS glued FROM supplier),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY size) AS r, count(*) OVER (PARTITION BY doc) AS n FROM o),
judged AS (SELECT *, size >= greatest(500, 3 * max(size) FILTER (WHERE r = n // 2 + 1) OVER (PARTITION BY doc)) AS overlong FROM placed)
SELECT doc, count(*) AS entries, count(*) FILTER (WHERE glued) AS glued, count(*) FILTER (WHERE overlong) AS overlong, count(*) FILTER (WHERE glued) >= 2 OR count(*) FILTER (WHERE overlong) >= 0.1 * count(*) AS suspect FROM judged GROUP BY 1""")
def bibliography_health(spark, d):
    """Lists of suppliers by nation, some of them run into each other, some too long."""
    k = F.col("s_suppkey")
    one = F.rpad(F.concat(F.lit("Adorno, T. (1951). "), F.lpad((k % 10).cast("string"), 1, "0")), 20, ".")
    text = F.concat(one, F.when(k % 9 == 0, F.rpad(F.lit(" Butler, J. (1990). "), 30, ".")).otherwise(""), F.when(k % 10 == 0, F.repeat(F.lit("x"), 580)).otherwise(""))
    entries = T(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), k.alias("pos"), F.lit(0).alias("line"), text.alias("text"))
    return B.bibliography_health(entries)


def _citing(spark, d):
    """References of a nation's suppliers, some of a year with letters, and texts of its customers that cite in four ways."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    year = lambda k: (1900 + k % 100).cast("string")
    letter = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (s % 3 + 1).cast("int"))
    refs = T(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), s.alias("rid"), F.concat(_name(s), F.lit(", A. ("), year(s), letter, F.lit("). "), "s_name").alias("ref"))
    y, lit = year(c), F.lit
    text = (
        F.when(c % 5 == 0, F.concat(lit("see ("), _name(c), lit(" "), y, lit("; "), _name(c + 1), lit(" "), year(c + 1), lit(").")))
        .when(c % 5 == 1, F.concat(lit("("), _name(c), lit(" "), y, lit("a, "), y, lit("b)")))
        .when(c % 5 == 2, F.concat(_name(c), lit(" says ("), y, lit(").")))
        .when(c % 5 == 3, F.concat(lit("["), _name(c), lit(", "), y, lit("] and [1] and ["), y, lit("]")))
        .otherwise(F.concat(lit("In "), y, lit(" nothing was cited.")))
    )
    customers = T(spark, d, "customer")
    return spread(customers.select(F.col("c_nationkey").alias("doc"), c.alias("pos"), text.alias("text")), customers.count(), "doc", "pos"), refs


_LINKS = f"""
WITH refs AS (SELECT s_nationkey AS doc, s_suppkey % 8 AS name, 1900 + s_suppkey % 100 AS y, ['', 'a', 'b'][s_suppkey % 3 + 1] AS letter, max(s_suppkey) AS rid FROM supplier GROUP BY ALL),
c AS (SELECT c_nationkey AS doc, c_custkey AS pos, c_custkey % 5 AS v, {_SQL_NAMES}[c_custkey % 8 + 1] AS who, c_custkey AS k FROM customer),
asked AS (
  SELECT doc, pos, 0 AS citation, 6 + length(who) AS start, k % 8 AS name, 1900 + k % 100 AS y, '' AS letter, true AS lead_ FROM c WHERE v = 0
  UNION ALL SELECT doc, pos, 1, 6 + length(who) + 4 + 2 + length({_SQL_NAMES}[(k + 1) % 8 + 1]) + 1, (k + 1) % 8, 1900 + (k + 1) % 100, '', true FROM c WHERE v = 0
  UNION ALL SELECT doc, pos, 0, 2 + length(who), k % 8, 1900 + k % 100, 'a', true FROM c WHERE v = 1
  UNION ALL SELECT doc, pos, 0, 9 + length(who), k % 8, 1900 + k % 100, 'b', false FROM c WHERE v = 1
  UNION ALL SELECT doc, pos, 0, 7 + length(who), k % 8, 1900 + k % 100, '', true FROM c WHERE v = 2
  UNION ALL SELECT doc, pos, 0, 3 + length(who), k % 8, 1900 + k % 100, '', true FROM c WHERE v = 3),
met AS (
  SELECT a.doc, a.pos, citation, start, a.y || a.letter AS year, lead_, min(t.step) AS step, arg_min(r.rid, t.step) AS rid, arg_min(t.o, t.step) AS "offset"
  FROM asked a LEFT JOIN ((SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS step, unnest([0, 1, -1, 2, -2, 3, -3]) AS o) t JOIN refs r ON true) ON r.doc = a.doc AND r.name = a.name AND r.letter = a.letter AND r.y = a.y + t.o AND (a.lead_ OR t.step = 0)
  GROUP BY ALL),
links AS (
  SELECT *, bool_or(lead_ AND coalesce(step = 0, false)) OVER (PARTITION BY doc, pos, citation) AS exact FROM met)"""


@query("in_text_links", _LINKS + """ SELECT doc, pos, citation, start, start + length(year) AS stop, year, rid, "offset" FROM links WHERE lead_ OR (exact AND rid IS NOT NULL)""")
def in_text_links(spark, d):
    blocks, refs = _citing(spark, d)
    return Refs.citation_links(blocks, refs, "doc", "pos", "text", "rid", "ref", "rid")


def _anchor(n: int, year: str) -> str:
    """What the link of a block's nth year makes of it."""
    return f"""coalesce((SELECT '<a class="in-text-citation" href="#' || rid || '">' || {year} || '</a>' FROM links l WHERE l.pos = c.pos AND l.place = {n} AND rid IS NOT NULL), {year})"""


@query("linked_texts", _LINKS.replace("links AS (", "linked AS (") + f""",
links AS (SELECT pos, rid, row_number() OVER (PARTITION BY doc, pos ORDER BY start) AS place FROM linked WHERE lead_ OR exact),
y AS (SELECT *, CAST(1900 + k % 100 AS VARCHAR) AS y FROM c)
SELECT doc, pos, CASE v WHEN 0 THEN 'see (' || who || ' ' || {_anchor(1, "y")} || '; ' || {_SQL_NAMES}[(k + 1) % 8 + 1] || ' ' || {_anchor(2, "CAST(1900 + (k + 1) % 100 AS VARCHAR)")} || ').'
  WHEN 1 THEN '(' || who || ' ' || {_anchor(1, "(y || 'a')")} || ', ' || {_anchor(2, "(y || 'b')")} || ')'
  WHEN 2 THEN who || ' says (' || {_anchor(1, "y")} || ').' WHEN 3 THEN '[' || who || ', ' || {_anchor(1, "y")} || '] and [1] and [' || y || ']'
  ELSE 'In ' || y || ' nothing was cited.' END AS linked FROM y c""")
def linked_texts(spark, d):
    """The citing texts with anchors; taken out again they leave the texts as they were."""
    blocks, refs = _citing(spark, d)
    links = Refs.citation_links(blocks, refs, "doc", "pos", "text", "rid", "ref", "rid")
    return Refs.linked_text(blocks, links, ["doc", "pos"], "text", "rid").select("doc", "pos", "linked")
