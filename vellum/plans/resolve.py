"""Citation search, resolution waves, harvested networks, restores and approval rules as queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from vellum.operators import convert, graph, linkage as L, references as Refs, relational as R, search as S, temporal as V
from vellum.plans.registry import query
from vellum.session import spread, table as T


@query("auto_approve", r"""
WITH hits AS (SELECT item_id, doc_id, b.text AS quote, CAST((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS BIGINT) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
one AS (SELECT item_id, min(doc_id) AS doc_id, any_value(quote) AS quote FROM hits GROUP BY 1 HAVING sum(n) = 1)
SELECT item_id, doc_id FROM one WHERE length(trim(regexp_replace(lower(quote), '\s+', ' ', 'g'))) >= 40""")
def auto_approve(spark, d):
    """Quotes found exactly, once in the whole corpus, and of forty normalised characters or more."""
    b, docs = T(spark, d, "benchmark"), T(spark, d, "documents")
    found = L.locate_quotes(b, docs, "item_id", "text", "doc_id", "text").join(b.select("item_id", F.col("text").alias("quote")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    n = (F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")
    once = found.select("item_id", "doc_id", "quote", n.cast("long").alias("n")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.min("quote").alias("quote"), F.sum("n").alias("n")).where("n = 1")
    return once.where(F.length(F.trim(F.regexp_replace(F.lower("quote"), r"\s+", " "))) >= 40).select("item_id", "doc_id")


@query("subtree_rows", "SELECT p_partkey FROM (SELECT p_partkey, 'lib_1%/' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/' || p_brand END AS path FROM part) WHERE path = 'lib_1%/7' OR starts_with(path, 'lib_1%/7/')")
def subtree_rows(spark, d):
    """A path's row and its descendants: a root with wildcard characters is meant literally, and 7 is no parent of 70."""
    path = F.concat(F.lit("lib_1%/"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "p_brand")))
    return T(spark, d, "part").select("p_partkey", path.alias("path")).where(R.under(F.col("path"), "lib_1%/7")).select("p_partkey")


@query("visible_sub_books", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey IS NULL OR s_acctbal >= 0 OR s_acctbal IS NULL")
def visible_sub_books(spark, d):
    """Rows that point at a private sub-book go; those without one, or with one of unknown visibility, stay."""
    private = T(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(private, F.col("s_suppkey") == F.col("l_suppkey"), "left_anti")


@query("open_access_fetchable", "SELECT p_partkey FROM (SELECT p_partkey, p_size > 20 AS is_oa, CASE WHEN p_type = 'PROMO' THEN 'http://pdf' ELSE '' END AS pdf_url, CASE WHEN p_size > 40 THEN 'http://oa' END AS oa_url, CASE WHEN p_partkey % 4 = 0 THEN '10.1/' || p_partkey ELSE '' END AS doi FROM part) WHERE is_oa AND (pdf_url <> '' OR oa_url <> '' OR doi <> '')")
def open_access_fetchable(spark, d):
    p = T(spark, d, "part").select(
        "p_partkey", (F.col("p_size") > 20).alias("is_oa"), F.when(F.col("p_type") == "PROMO", "http://pdf").otherwise("").alias("pdf_url"),
        F.when(F.col("p_size") > 40, "http://oa").alias("oa_url"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).otherwise("").alias("doi"),
    )
    return p.where("is_oa AND (pdf_url <> '' OR oa_url <> '' OR doi <> '')").select("p_partkey")


@query("resolution_waves", """
SELECT l_orderkey, l_linenumber, coalesce(l.k, i.k, t.k) AS work, CASE WHEN l.k IS NOT NULL THEN 'linked' WHEN i.k IS NOT NULL THEN 'identifier' WHEN t.k IS NOT NULL THEN 'title' END AS method, CASE WHEN l.k IS NOT NULL OR i.k IS NOT NULL THEN 1.0::DOUBLE ELSE t.score END AS score
FROM lineitem LEFT JOIN (SELECT p_partkey AS k FROM part WHERE p_size < 10) l ON l.k = l_partkey
LEFT JOIN (SELECT s_suppkey AS key, min(p_partkey) AS k FROM supplier JOIN part ON p_size = s_suppkey % 50 AND s_acctbal > 5000 GROUP BY 1) i ON i.key = l_suppkey
LEFT JOIN (SELECT p_partkey AS key, p_partkey AS k, p_retailprice / 1200.0::DOUBLE AS score FROM part WHERE p_retailprice / 1200.0::DOUBLE >= 0.5) t ON t.key = l_partkey
WHERE coalesce(l.k, i.k, t.k) IS NOT NULL""")
def resolution_waves(spark, d):
    """Waves over a shrinking pool, each with its method and score; candidates below a half resolve nothing."""
    p, s = T(spark, d, "part"), T(spark, d, "supplier")
    pool = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    one = F.lit(1.0)
    linked = p.where("p_size < 10").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("work"), one.alias("score"))
    by_id = s.where("s_acctbal > 5000").join(p, F.col("p_size") == F.col("s_suppkey") % 50).groupBy(F.col("s_suppkey").alias("key")).agg(F.min("p_partkey").alias("work")).withColumn("score", one)
    title = p.select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("work"), (F.col("p_retailprice") / 1200.0).alias("score"))
    waves = [("linked", "l_partkey", linked), ("identifier", "l_suppkey", by_id), ("title", "l_partkey", title)]
    return L.resolve(pool, waves).select("l_orderkey", "l_linenumber", "work", "method", "score")


@query("unresolved_pool", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_quantity > 45)")
def unresolved_pool(spark, d):
    """Resolving any part of a footnote takes the parent and its other parts out of the pool."""
    li = T(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber").join(li.where("l_quantity > 45").select("l_orderkey"), "l_orderkey", "left_anti")


_WORD_SHARE = "(CASE WHEN list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), 'anvil') THEN 0.5 ELSE 0.0 END + CASE WHEN list_contains(regexp_split_to_array(lower({c}), '[^a-z0-9_]+'), 'promo') THEN 0.5 ELSE 0.0 END)"
_RANK = f"(1.0 * {_WORD_SHARE.format(c='p_name')} + 0.3 * {_WORD_SHARE.format(c='p_type')})"


@query("library_search", f"SELECT p_partkey, CAST(round({_RANK}, 6) AS DOUBLE) AS rank FROM part WHERE {_RANK} > 0 AND (p_size < 30 OR p_brand = 'Brand#12') ORDER BY rank DESC, p_retailprice DESC, p_partkey LIMIT 25")
def library_search(spark, d):
    """Ranked search of titles and journals in what a reader may see: public books and the reader's own; a page of 25."""
    rank = F.round(S.weighted_rank({"A": F.col("p_name"), "B": F.col("p_type")}, ["anvil", "promo"]), 6)
    seen = R.visible(F.when(F.col("p_size") < 30, "public").otherwise("private"), F.lit(True), F.col("p_brand"), F.lit(None).cast("string"), "Brand#12", None)
    return T(spark, d, "part").where(seen).select("p_partkey", "p_retailprice", rank.alias("rank")).where("rank > 0").orderBy(F.desc("rank"), F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "rank")


@query("hybrid_citation_search", f"""
WITH canonical AS (SELECT p_partkey AS id, 'canonical' AS origin, p_name AS title, CAST(round({_RANK}, 6) AS DOUBLE) AS rank, 0 AS place FROM part WHERE {_RANK} > 0 ORDER BY rank DESC, id LIMIT 20),
orphan AS (SELECT o_orderkey AS id, 'library' AS origin, 'anvil ' || o_orderpriority AS title, 0.5::DOUBLE AS rank, 1 AS place FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size < 40) ORDER BY id LIMIT 20)
SELECT id, origin, title, rank FROM (SELECT * FROM canonical UNION ALL SELECT * FROM orphan) ORDER BY rank DESC, place, id LIMIT 20""")
def hybrid_citation_search(spark, d):
    """Canonical works and library books that no work stands for, each ranked and cut before they are merged and cut again."""
    words = ["anvil", "promo"]
    rank = F.round(S.weighted_rank({"A": F.col("p_name"), "B": F.col("p_type")}, words), 6)
    canonical = T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("canonical").alias("origin"), F.col("p_name").alias("title"), rank.alias("rank"), F.lit(0).alias("place")).where("rank > 0").orderBy(F.desc("rank"), "id").limit(20)
    linked = T(spark, d, "lineitem").join(T(spark, d, "part").where("p_size < 40"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey")
    orphan = T(spark, d, "orders").where("o_orderstatus = 'O'").join(linked, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"), F.lit("library").alias("origin"), F.concat(F.lit("anvil "), "o_orderpriority").alias("title"))
    orphan = orphan.withColumn("rank", F.round(S.weighted_rank({"A": F.col("title")}, words), 6)).withColumn("place", F.lit(1)).orderBy(F.desc("rank"), "id").limit(20)
    return canonical.unionByName(orphan).orderBy(F.desc("rank"), "place", "id").limit(20).select("id", "origin", "title", "rank")


@query("passage_search", """
WITH t AS (SELECT doc_id, left(text, 1500) AS passage, list_contains(toks, 'apache') AS a, list_contains(toks, 'license') AS b, list_contains(toks, 'warranties') AS c FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS toks FROM documents)),
whole AS (SELECT doc_id, passage, 'all' AS stage, 3 AS hits FROM t WHERE a AND b AND c), partly AS (SELECT doc_id, passage, 'any' AS stage, a::INT + b::INT + c::INT AS hits FROM t WHERE (a OR b OR c) AND NOT EXISTS (SELECT 1 FROM whole))
SELECT doc_id, passage, stage FROM (SELECT * FROM whole UNION ALL SELECT * FROM partly) ORDER BY hits DESC, doc_id LIMIT 3""")
def passage_search(spark, d):
    """The three best passages with all words, or with any where none has all, each cut at 1,500 characters."""
    docs = T(spark, d, "documents")
    return S.cascade(docs, "doc_id", F.col("text"), ["apache", "license", "warranties"], 3).select("doc_id", F.substring("text", 1, 1500).alias("passage"), "stage")


@query("nearest_occurrence", """
SELECT doc_id, list_min(list_transform(pos, lambda p: struct_pack(gap := abs(p - n_chars // 2), at := p))).at AS at FROM (SELECT doc_id, n_chars, list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, 7) = 'license') AS pos FROM documents WHERE contains(lower(text), 'license')) WHERE len(pos) > 0""")
def nearest_occurrence(spark, d):
    """The occurrence nearest to where it is expected, the earlier of two as near."""
    docs = T(spark, d, "documents").where(F.lower("text").contains("license"))
    return docs.select("doc_id", S.nearest(S.occurrences(F.col("text"), "license"), F.floor(F.col("n_chars") / 2)).cast("long").alias("at"))


@query("footnote_matches", """
WITH n AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), w AS (SELECT item_id, lower(split_part(text, ' ', 2)) AS surname, lower(split_part(text, ' ', 3)) AS year FROM benchmark),
met AS (SELECT conv_id, turn, item_id, len(list_filter(list_distinct(string_split(t, ' ')), lambda x: x = surname OR x = year)) AS overlap FROM n JOIN w ON contains(t, surname) AND contains(t, year) WHERE surname <> '' AND year <> '')
SELECT conv_id, turn, item_id FROM (SELECT *, rank() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC) AS r FROM met) WHERE r = 1""")
def footnote_matches(spark, d):
    """Footnotes that hold a work's surname and its year; of several works those of most title words, ties stay.

    The works are a query set held against all notes, in blocks of the notes.
    """
    notes = T(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    part = lambda i: F.lower(F.split_part("text", F.lit(" "), F.lit(i)))
    works = T(spark, d, "benchmark").select("item_id", part(2).alias("surname"), part(3).alias("year")).where("surname <> '' AND year <> ''")
    met = notes.join(works, F.col("t").contains(F.col("surname")) & F.col("t").contains(F.col("year")))
    overlap = F.size(F.filter(F.array_distinct(F.split("t", " ")), lambda x: (x == F.col("surname")) | (x == F.col("year"))))
    ranked = met.withColumn("r", F.rank().over(W.partitionBy("conv_id", "turn").orderBy(overlap.desc())))
    return ranked.where("r = 1").select("conv_id", "turn", "item_id")


@query("page_signals", """
WITH pages AS (SELECT o_custkey AS book, o_orderkey AS page, min(l_linenumber + l_partkey % 5) AS lo, max(l_linenumber + l_partkey % 5) AS hi, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
seq AS (SELECT *, lag(hi) OVER (PARTITION BY book ORDER BY page) AS before FROM pages),
spread AS (SELECT book, max(p) AS widest FROM (SELECT o_custkey AS book, l_partkey, count(DISTINCT o_orderkey) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1)
SELECT book, count(*) AS pages, count(*) FILTER (WHERE before > lo) AS resets, round(count(*) FILTER (WHERE before > lo) * 1.0::DOUBLE / count(*), 6) AS reset_ratio, max(widest) AS widest FROM seq JOIN spread USING (book) GROUP BY 1""")
def page_signals(spark, d):
    """Signals of a book's note style: pages whose numbers start over, and on how many pages one number appears."""
    lines, orders = T(spark, d, "lineitem"), T(spark, d, "orders").select("o_custkey", "o_orderkey")
    n, n_orders = lines.count(), orders.count()
    lines = lines.select("l_orderkey", "l_partkey", (F.col("l_linenumber") + F.col("l_partkey") % 5).alias("number"))
    rows = spread(orders, n, "o_orderkey").join(spread(lines, n, "l_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), "l_partkey", "number")
    pages = spread(rows.groupBy("book", "page").agg(F.min("number").alias("lo"), F.max("number").alias("hi")), n_orders, "book")
    reset = F.coalesce(F.lag("hi").over(W.partitionBy("book").orderBy("page")) > F.col("lo"), F.lit(False))
    by = pages.withColumn("reset", reset).groupBy("book").agg(F.count("*").alias("pages"), F.count_if("reset").alias("resets"))
    numbers = spread(rows.select("book", "l_partkey", "page").distinct(), n, "book", "l_partkey").groupBy("book", "l_partkey").agg(F.count("*").alias("p"))
    widest = numbers.groupBy("book").agg(F.max("p").alias("widest"))
    return by.join(widest, "book").select("book", "pages", "resets", F.round(F.col("resets") / F.col("pages"), 6).alias("reset_ratio"), "widest")


@query("connected_works", "SELECT p_partkey, p_brand, array_to_string(list(DISTINCT l_suppkey ORDER BY l_suppkey), ',') AS versions FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2")
def connected_works(spark, d):
    """Works with at least one edge, with their versions; a work has as many as suppliers."""
    edges = T(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    versions = edges.groupBy("l_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("versions"))
    return T(spark, d, "part").join(versions, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_brand", "versions")


@query("harvested_network", """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
seen(node, depth, parent) USING KEY (node) AS (
  SELECT 1400::BIGINT, 0, NULL::BIGINT UNION SELECT e.dst, min(depth) + 1, min(e.src) FROM seen JOIN e ON e.src = seen.node WHERE e.dst NOT IN (SELECT node FROM recurring.seen) GROUP BY e.dst)
SELECT node, depth, parent FROM seen""")
def harvested_network(spark, d):
    edges = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.harvest(edges, spark.createDataFrame([(1400,)], "node long"))


@query("inherited_modes", """
WITH RECURSIVE tree(node, mode) AS (SELECT 1::BIGINT, 'full' UNION ALL SELECT p_partkey, CASE WHEN mode = 'full' AND p_size >= 10 THEN 'full' ELSE 'metadata_only' END FROM tree JOIN part ON p_partkey > 1 AND p_partkey // 3 = node) SELECT node, mode FROM tree""")
def inherited_modes(spark, d):
    """Descendants of a book: what is kept of a child follows its parent and its own mark."""
    mode = F.when(F.col("p_size") >= 10, "full").otherwise("metadata_only")
    edges = T(spark, d, "part").where("p_partkey > 1").select(F.expr("p_partkey div 3").alias("src"), F.col("p_partkey").alias("dst"), mode.alias("mode"))
    return graph.inherited_modes(edges, spark.createDataFrame([(1, "full")], "node long, mode string"))


_HISTORY = "(SELECT user_id, event_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"


@query("restore_to", f"""
SELECT user_id, event_id, value, valid_from, coalesce(valid_to, TIMESTAMP '2030-01-01') AS valid_to FROM {_HISTORY}
UNION ALL SELECT user_id, event_id, value, TIMESTAMP '2030-01-01', NULL FROM {_HISTORY} WHERE valid_from <= TIMESTAMP '2024-01-10 06:00:00' AND (valid_to IS NULL OR TIMESTAMP '2024-01-10 06:00:00' < valid_to)""")
def restore_to(spark, d):
    """A book set back to an instant: what is current closes, and the rows valid then open again."""
    rows = V.versions(T(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value", "valid_from", "valid_to")
    return V.restore(rows, F.lit("2024-01-10 06:00:00").cast(dict(rows.dtypes)["valid_from"]), F.lit("2030-01-01 00:00:00").cast(dict(rows.dtypes)["valid_from"]))


@query("split_texts")
def split_texts(spark, d):
    """Every text in pieces of at most 1,000 characters, parted at paragraphs, then sentences, then anywhere."""
    pieces = convert.split_text(F.col("text"), 1000)
    return T(spark, d, "documents").select("doc_id", F.posexplode(pieces).alias("n", "piece"))


@query("linked_citations")
def linked_citations(spark, d):
    """Citations of surname and year against a bibliography made of the suppliers' names."""
    names = F.array(*[F.lit(x) for x in ("Adorno", "Butler", "Cixous", "Derrida", "Eagleton", "Foucault", "Gramsci", "Haraway")])
    name = lambda k: F.element_at(names, (k % 8 + 1).cast("int"))
    year = lambda k: (F.lit(1900) + k % 100).cast("string")
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    references = T(spark, d, "supplier").select("s_suppkey", F.concat(name(s), F.lit(", A. ("), year(s), F.lit("). "), "s_name").alias("text"))
    citations = T(spark, d, "customer").select("c_custkey", F.concat(F.lit("see "), name(c), F.lit(" "), year(c + F.when(c % 5 == 0, 1).otherwise(0)), F.lit(", 12")).alias("text"))
    return Refs.link_citations(citations, references, "c_custkey", "s_suppkey")
