"""Signals of documents, audits of numbers, identifiers, inverted texts, expected places and shelves as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from vellum.functions import documents as D, identifiers as R
from vellum.operators import convert, copies, quality as Q, resolution
from vellum.plans.registry import query
from vellum.session import spread, table as T, written


@query("document_flags", rf"""
WITH n AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t, pos FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
g AS (SELECT doc_id, count(*) AS nodes, CAST(sum(length(t)) AS BIGINT) AS chars, avg(CASE WHEN t = '' THEN 1.0::DOUBLE ELSE 0 END) AS empty, count(*) FILTER (WHERE t <> '') AS full_, sum(length(regexp_replace(t, '[^\p{{L}}\s]', '', 'g'))) AS letters, count(DISTINCT t) FILTER (WHERE t <> '') AS unlike,
  bool_or(pos <= 10 AND regexp_matches(t, '{Q.BLOCK_PHRASES}')) AS blocked FROM n GROUP BY 1),
j AS (SELECT *, CASE WHEN chars > 0 THEN letters / chars::DOUBLE END AS alpha, CASE WHEN full_ > 0 THEN (full_ - unlike) / full_::DOUBLE END AS repeated FROM g)
SELECT doc_id, nodes, chars, round(empty, 6) AS empty, round(alpha, 6) AS alpha, round(repeated, 6) AS repeated, array_to_string(list_filter([CASE WHEN nodes < 5 THEN 'node_count' END, CASE WHEN chars < 2000 THEN 'total_chars' END, CASE WHEN blocked THEN 'block_page_phrase' END,
  CASE WHEN empty > 0.5 THEN 'empty_nodes' END, CASE WHEN alpha < 0.6 THEN 'alpha_ratio' END, CASE WHEN repeated > 0.3 THEN 'duplicate_nodes' END], lambda x: x IS NOT NULL), ',') AS signals FROM j""")
def document_flags(spark, d):
    """What speaks against each document, of lines as its blocks."""
    lines = T(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    six = lambda c: F.round(c, 6).alias(c)
    return Q.quality_signals(lines, "doc_id", "pos", "line").select("doc_id", "nodes", "chars", six("empty"), six("alpha"), six("repeated"), F.array_join("signals", ",").alias("signals"))


@query("numbering_audit", """
WITH r AS (SELECT l_suppkey AS doc, l_orderkey AS a, l_partkey AS b, l_extendedprice AS c, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
s AS (SELECT *, 1 + CAST(sum(new) OVER (PARTITION BY doc ORDER BY a, b, c ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM (SELECT *, CASE WHEN n <= lag(n) OVER (PARTITION BY doc ORDER BY a, b, c) THEN 1 ELSE 0 END AS new FROM r)),
t AS (SELECT *, lead(n) OVER (PARTITION BY doc, section ORDER BY a, b, c) AS after FROM s)
SELECT doc, section, 'gap' AS kind, n + 1 AS first, after - 1 AS last, after - n - 1 AS n FROM t WHERE after > n + 1
UNION ALL SELECT doc, section, 'duplicate', n, n, count(*) FROM s GROUP BY doc, section, n HAVING count(*) > 1""")
def numbering_audit(spark, d):
    """Gaps and repetitions of line numbers, a supplier's lines as a document."""
    rows = T(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_extendedprice").alias("c"), "l_linenumber")
    return Q.numbering_audit(rows, "doc", ["a", "b", "c"], "l_linenumber")


@query("expected_places", """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER w - 1 AS old, count(*) OVER (PARTITION BY o_custkey) AS n_old, count(*) FILTER (WHERE o_orderstatus <> 'F') OVER (PARTITION BY o_custkey) AS n_new,
  CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 3 <> 0 THEN count(*) FILTER (WHERE o_orderstatus <> 'F') OVER (w ROWS UNBOUNDED PRECEDING) - 1 END AS new FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
p AS (SELECT *, last_value(CASE WHEN new IS NOT NULL THEN old END IGNORE NULLS) OVER b AS bo, last_value(new IGNORE NULLS) OVER b AS bn, first_value(CASE WHEN new IS NOT NULL THEN old END IGNORE NULLS) OVER a AS ao, first_value(new IGNORE NULLS) OVER a AS an
  FROM o WINDOW b AS (PARTITION BY doc ORDER BY old ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc ORDER BY old ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc, old, new, CAST(coalesce(new, floor(CASE WHEN bn IS NOT NULL AND an IS NOT NULL THEN bn + (an - bn) * (old - bo) / (ao - bo)::DOUBLE ELSE old / n_old::DOUBLE * n_new END + 0.5)) AS BIGINT) AS expected FROM p""")
def expected_places(spark, d):
    """A customer's orders as the blocks of two versions of a book, some gone, some unmatched."""
    w, whole = W.partitionBy("o_custkey").orderBy("o_orderkey"), W.partitionBy("o_custkey")
    kept = F.col("o_orderstatus") != "F"
    rows = T(spark, d, "orders").select(
        F.col("o_custkey").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("old"), F.count("*").over(whole).alias("n_old"), F.count_if(kept).over(whole).alias("n_new"),
        F.when(kept & (F.col("o_orderkey") % 3 != 0), F.count_if(kept).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).alias("new"),
    )
    return Q.expected_places(rows, "doc", "old", "new", F.col("n_old"), F.col("n_new")).select("doc", "old", "new", "expected")


_SORTS = {
    "title": "lower(title) NULLS LAST", "author": "lower(author) NULLS LAST", "views": "views DESC NULLS LAST", "connected": "connected DESC NULLS LAST", "lit": "lit DESC NULLS LAST", "added": "added DESC NULLS LAST", "manual": "manual NULLS LAST",
    "published": "TRY_CAST(regexp_extract(year, '(\\d+)', 1) AS BIGINT) DESC NULLS LAST, TRY_CAST(regexp_extract(volume, '(\\d+)', 1) AS BIGINT) DESC NULLS LAST, TRY_CAST(regexp_extract(issue, '(\\d+)', 1) AS BIGINT) DESC NULLS LAST",
    "year": "TRY_CAST(regexp_extract(year, '(\\d+)', 1) AS BIGINT) DESC NULLS LAST", "recent": "created DESC NULLS LAST",
}


@query("shelf_sorts", """
WITH s AS (SELECT p_partkey AS book, p_name AS title, CASE WHEN p_size % 6 <> 0 THEN upper(p_type) END AS author, p_size AS views, p_size % 17 AS connected, CASE WHEN p_size % 5 <> 0 THEN p_size % 13 END AS lit, p_retailprice AS added,
  CASE WHEN p_size % 4 = 0 THEN p_size * 1.5::DOUBLE END AS manual, CASE WHEN p_size % 7 <> 0 THEN 'c. ' || (1900 + p_size) END AS year, 'vol. ' || (p_partkey % 9) || ' of 9' AS volume, CASE WHEN p_size % 3 = 0 THEN 'special' ELSE 'no ' || (p_partkey % 12) END AS issue, p_partkey % 1000 AS created FROM part)
""" + " UNION ALL ".join(f"SELECT '{k}' AS sort, row_number() OVER (ORDER BY {o}, book) AS place, book FROM (SELECT * FROM s ORDER BY {o}, book LIMIT 20)" for k, o in _SORTS.items()))
def shelf_sorts(spark, d):
    """The first page of a shelf in each of its ten orders."""
    size, key = F.col("p_size"), F.col("p_partkey")
    shelf = T(spark, d, "part").select(
        key.alias("book"), F.col("p_name").alias("title"), F.when(size % 6 != 0, F.upper("p_type")).alias("author"), size.alias("views"), (size % 17).alias("connected"), F.when(size % 5 != 0, size % 13).alias("lit"), F.col("p_retailprice").alias("added"),
        F.when(size % 4 == 0, size * 1.5).alias("manual"), F.when(size % 7 != 0, F.concat(F.lit("c. "), (1900 + size).cast("string"))).alias("year"), F.concat(F.lit("vol. "), (key % 9).cast("string"), F.lit(" of 9")).alias("volume"),
        F.when(size % 3 == 0, "special").otherwise(F.concat(F.lit("no "), (key % 12).cast("string"))).alias("issue"), (key % 1000).alias("created"),
    )
    page = lambda k: shelf.orderBy(*Q.shelf_order(k)).limit(20).select(F.lit(k).alias("sort"), F.row_number().over(W.orderBy(*Q.shelf_order(k))).cast("long").alias("place"), "book")
    return reduce(DataFrame.unionByName, map(page, _SORTS))


@query("identifier_forms", """
WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS v, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS nine, p_partkey % 5 = 0 AS wrong FROM part),
c AS (SELECT *, (10 - (38 + list_sum(list_transform(range(9), lambda i: CAST(substr(nine, i + 1, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) % 10 AS check13 FROM k)
SELECT k, CASE v WHEN 0 THEN '10.1000/a' || k WHEN 1 THEN '10.1000/b' || k END AS doi, CASE WHEN v IN (2, 3) AND NOT wrong THEN '978' || nine || check13 END AS isbn, CASE WHEN v = 4 THEN '2301.' || right(nine, 5) END AS arxiv FROM c""")
def identifier_forms(spark, d):
    """Identifiers as texts have them, linked, prefixed and bare, some ISBNs with a wrong check digit."""
    k, v = F.col("p_partkey"), F.col("p_partkey") % 6
    nine, wrong = F.lpad(k.cast("string"), 9, "0"), k % 5 == 0
    digit = lambda i: F.substring(nine, i + 1, 1).cast("int")
    thirteen = (10 - (38 + reduce(lambda a, b: a + b, [digit(i) * (3 if i % 2 == 0 else 1) for i in range(9)])) % 10) % 10
    ten = (11 - reduce(lambda a, b: a + b, [digit(i) * (10 - i) for i in range(9)]) % 11) % 11
    lit = F.lit
    text = (
        F.when(v == 0, F.concat(lit('see <a href="https://doi.org/10.1000/A'), k.cast("string"), lit('.">x</a>')))
        .when(v == 1, F.concat(lit("(doi: 10.1000/b"), k.cast("string"), lit("), and")))
        .when(v == 2, F.concat(lit("ISBN 978-"), nine, lit("-"), ((thirteen + F.when(wrong, 1).otherwise(0)) % 10).cast("string")))
        .when(v == 3, F.concat(lit("isbn: "), nine, lit("-"), F.when((ten == 10) & ~wrong, "X").otherwise(((ten + F.when(wrong, 1).otherwise(0)) % 10).cast("string"))))
        .when(v == 4, F.concat(lit("arXiv:2301."), F.substring(nine, 5, 5), lit("v2")))
        .otherwise(F.concat(lit("order "), k.cast("string")))
    )
    rows = T(spark, d, "part").select(k.alias("k"), text.alias("t"))
    return rows.select("k", R.doi(F.col("t")).alias("doi"), R.isbn(F.col("t")).alias("isbn"), R.arxiv(F.col("t")).alias("arxiv"))


@query("abstracts_from_json", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ') AS abstract FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]')")
def abstracts_from_json(spark, d):
    """Texts as inverted indexes in JSON, read back from it."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))  # a word's places stand together; no row leaves its task
    by = lambda f, x: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  x is made once
    first = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["word"] != F.get(p, i - 1)["word"]))
    entry = lambda p, f: lambda i, k: F.struct(F.get(p, i)["word"].alias("word"), F.transform(F.slice(p, i + 1, F.coalesce(F.get(f, k + 1), F.size(p)) - i), lambda x: x["at"]).alias("places"))
    index = by(lambda p: by(lambda f: F.transform(f, entry(p, f)), first(p)), placed)
    docs = T(spark, d, "documents").where(F.size(words) > 0)
    return docs.select("doc_id", F.to_json(F.map_from_entries(index)).alias("json")).select("doc_id", convert.inverted_text(F.col("json")).alias("abstract"))


@query("resolved_entries")
def resolved_entries(spark, d):
    """Orders as entries of their customers' bibliographies against parts as works; footnotes of several entries resolve together."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = T(spark, d, "part").select(F.col("p_partkey").alias("work"), F.concat("p_name", F.lit(" of volume "), F.col("p_partkey").cast("string")).alias("title"), F.concat(F.lit("Author "), "p_brand").alias("author"), (1950 + F.col("p_size")).alias("year"), F.when(F.col("p_size") % 10 == 0, F.concat(F.lit("10.1000/W"), F.col("p_partkey").cast("string"))).alias("doi"), F.lit(None).cast("string").alias("isbn"), F.when(F.col("p_size") % 4 != 0, "x").alias("external"))
    mine = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("work"))
    orders = written(T(spark, d, "orders").join(mine.hint("merge"), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus", "work"), "orders")
    rows = orders.join(parts.select("work", F.col("title").alias("_t"), F.col("author").alias("_a"), F.col("year").alias("_y"), F.col("doi").alias("_d")).hint("merge"), "work")
    entries = rows.select(
        k.alias("entry"), F.when(k % 4 == 0, c).alias("part_of"), c.alias("parent"), F.when(k % 9 == 0, F.concat("_t", F.lit(": a study"))).when(k % 7 != 0, F.col("_t")).alias("title"), F.when(k % 3 != 0, F.col("_a")).alias("author"), F.col("_y").alias("year"),
        F.when(k % 2 == 0, F.concat(F.lit("doi:"), "_d")).alias("text"), F.when(k % 31 == 0, F.col("work")).alias("linked"),
    )
    cited = orders.where("o_orderstatus = 'P'").select(c.alias("parent"), "work")
    return resolution.resolve_entries(entries, parts, cited).resolved


@query("json_documents", """
SELECT event_id, lower(json_type(props)) AS whole, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(props, '$.k')) END AS k, CAST(json_array_length('[' || event_id || ',' || user_id || ',"' || event_type || '"]') AS INT) AS n,
  CAST(json_merge_patch(props, '{"seen":' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE '"no"' END || '}') AS VARCHAR) AS marked FROM events""")
def json_documents(spark, d):
    """Types within documents, lengths of arrays, and a key set in each document."""
    props, seen = F.col("props"), F.when(F.col("user_id") % 2 == 0, "true").otherwise('"no"')
    listed = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]'))
    return T(spark, d, "events").select("event_id", D.json_typeof(props).alias("whole"), D.json_typeof(props, "$.k").alias("k"), F.json_array_length(listed).alias("n"), D.json_set(props, "seen", seen).alias("marked"))


@query("open_copies", """
WITH l AS (SELECT p_partkey AS work, 0 AS n, 'https://arxiv.org/pdf/' || p_size AS pdf, 'https://www.jstor.org/stable/' || p_size || '/' AS landing, NULL AS host_type, 'publishedVersion' AS version, CASE WHEN p_size % 2 = 0 THEN 'CC-BY' END AS license FROM part
UNION ALL SELECT p_partkey, 1, CASE WHEN p_size % 3 = 0 THEN 'https://www.jstor.org/stable/' || p_size || '?download=1' ELSE 'https://files.example.net/' || p_brand END, CASE WHEN p_size % 5 > 0 THEN 'https://library.example.edu/x' ELSE '' END, CASE WHEN p_size % 4 = 0 THEN 'journal' END, CASE WHEN p_size % 7 > 2 THEN 'acceptedVersion' END, 'other-oa' FROM part
UNION ALL SELECT p_partkey, 2, NULL, 'no address', 'repository', 'submittedVersion', 'pd' FROM part),
c AS (SELECT work, n, 0 AS k, 'pdf' AS kind, pdf AS url, host_type, version, license FROM l UNION ALL SELECT work, n, 1, 'landing', landing, host_type, version, license FROM l),
h AS (SELECT *, CASE WHEN contains(url, '://') THEN split_part(split_part(url, '://', 2), '/', 1) ELSE '' END AS host, CASE WHEN contains(url, '://') THEN rtrim(split_part(split_part(url, '://', 2), '?', 1), '/') ELSE '' END AS key FROM c WHERE url IS NOT NULL AND url <> ''),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY work, key ORDER BY n, k) = 1),
s AS (SELECT *, CASE WHEN host = '' THEN 'unknown' WHEN host_type = 'repository' THEN 'repository' WHEN contains(host, 'jstor.org') THEN 'publisher' WHEN host = 'arxiv.org' OR contains(host, '.edu') THEN 'repository' WHEN host_type = 'journal' THEN 'publisher' ELSE 'unknown' END AS host_class FROM f),
p AS (SELECT *, CASE host_class WHEN 'repository' THEN 200 WHEN 'unknown' THEN 100 ELSE 0 END + CASE kind WHEN 'pdf' THEN 10 ELSE 0 END + CASE version WHEN 'publishedVersion' THEN 6 WHEN 'acceptedVersion' THEN 4 WHEN 'submittedVersion' THEN 1 ELSE 2 END + CASE WHEN license IN ('CC-BY', 'pd') THEN 3 WHEN license IS NULL THEN 0 ELSE 1 END AS score FROM s)
SELECT work, CAST(row_number() OVER (PARTITION BY work ORDER BY score DESC, n, k) AS INT) AS place, url, kind, host, host_class, score FROM p""")
def open_copies(spark, d):
    """Copies of each part from three sources, the same address among them in two forms."""
    size, lit = F.col("p_size"), F.lit
    s = lambda c: c.cast("string")
    none = lit(None).cast("string")
    rows = [
        (F.concat(lit("https://arxiv.org/pdf/"), s(size)), F.concat(lit("https://www.jstor.org/stable/"), s(size), lit("/")), none, lit("publishedVersion"), F.when(size % 2 == 0, "CC-BY")),
        (F.when(size % 3 == 0, F.concat(lit("https://www.jstor.org/stable/"), s(size), lit("?download=1"))).otherwise(F.concat(lit("https://files.example.net/"), "p_brand")), F.when(size % 5 > 0, "https://library.example.edu/x").otherwise(""), F.when(size % 4 == 0, "journal"), F.when(size % 7 > 2, "acceptedVersion"), lit("other-oa")),
        (none, lit("no address"), lit("repository"), lit("submittedVersion"), lit("pd")),
    ]
    names = ("pdf_url", "landing_page_url", "host_type", "version", "license")
    each = F.posexplode(F.array(*[F.struct(*[c.cast("string").alias(k) for k, c in zip(names, r, strict=True)]) for r in rows])).alias("n", "l")
    parts = T(spark, d, "part")
    return copies.ranked_copies(spread(parts.select(F.col("p_partkey").alias("work"), each).select("work", "n", "l.*"), 6 * parts.count(), "work"))


@query("body_verdicts", r"""
WITH b AS (SELECT doc_id, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
c AS (SELECT doc_id, length(t) AS size, length(t) >= 200 AND NOT regexp_matches(t, '(?i)(\{[^}]*[\w-]+\s*:\s*[^};]+;)|(\bfunction\s*\()|(\bwindow\.)|(\bdocument\.)|(\bvar\s+\w+\s*=)|(dataLayer)|(@media\b)|(!important)') AND NOT regexp_matches(t, '^\s*\[?\d{0,3}\]?\s*[A-Z][A-Za-z''’-]+,\s+[A-Z]\.')
  AND NOT regexp_matches(t, '(?i)\bdoi:\s*10\.|https?://doi\.org/10\.') AND NOT regexp_matches(t, '(?i)\bRetrieved from\s+https?:') AS counts FROM b),
g AS (SELECT doc_id, count(*) FILTER (WHERE counts AND size >= 400) AS prose_blocks, CAST(coalesce(sum(size) FILTER (WHERE counts), 0) AS BIGINT) AS prose_chars FROM c GROUP BY 1)
SELECT 'scholarly' AS profile, *, CASE WHEN prose_blocks < 5 AND prose_chars < 10000 THEN 'absent' ELSE 'present' END AS verdict FROM g UNION ALL SELECT 'web', *, CASE WHEN prose_blocks < 2 AND prose_chars < 1500 THEN 'absent' ELSE 'present' END FROM g""")
def body_verdicts(spark, d):
    """Whether documents, of lines as blocks, have their body, by both profiles."""
    lines = T(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    of = lambda p: copies.body_verdict(lines, "doc_id", "line", p).withColumn("profile", F.lit(p))
    return of("scholarly").unionByName(of("web"))
