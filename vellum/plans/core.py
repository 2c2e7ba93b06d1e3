"""Scans, predicates, joins, aggregates, windows, limits and set operations as queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from vellum.operators import relational as R
from vellum.plans.registry import query
from vellum.session import spread, table as T


@query("most_cited", """
SELECT l_partkey AS work, p_name AS title, count(DISTINCT l_orderkey) AS citing, bool_or(o_orderstatus = 'F') AS internal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
GROUP BY 1, 2 ORDER BY citing DESC NULLS LAST, work LIMIT 50""")
def most_cited(spark, d):
    """Edges are dealt by their book and their number, and made distinct where they lie."""
    lines, orders = T(spark, d, "lineitem").select("l_orderkey", "l_partkey"), T(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    n = lines.count()
    edges = spread(lines, n, "l_orderkey").join(spread(orders, n, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    once = edges.groupBy("l_orderkey", "l_partkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("internal"))
    cited = once.groupBy("l_partkey").agg(F.count("l_orderkey").alias("citing"), F.bool_or("internal").alias("internal"))
    named = cited.join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(F.col("l_partkey").alias("work"), F.col("p_name").alias("title"), "citing", "internal").orderBy(F.desc_nulls_last("citing"), "work").limit(50)


@query("point_lookup", "SELECT * FROM customer WHERE c_custkey = 7 ORDER BY c_custkey LIMIT 1")
def point_lookup(spark, d):
    return T(spark, d, "customer").where("c_custkey = 7").orderBy("c_custkey").limit(1)


@query("computed_projection", """
SELECT page_id, split_part(url, '/', 3) AS host, url LIKE '%?%' AS has_query, CASE WHEN regexp_matches(url, '^https') THEN 'tls' WHEN regexp_matches(url, '^http') THEN 'plain' ELSE 'other' END AS scheme,
  substr(coalesce(html, ''), 1, 300) AS excerpt FROM pages""")
def computed_projection(spark, d):
    scheme = F.when(F.col("url").rlike("^https"), "tls").when(F.col("url").rlike("^http"), "plain").otherwise("other")
    return T(spark, d, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.col("url").like("%?%").alias("has_query"), scheme.alias("scheme"), F.substring(F.coalesce("html", F.lit("")), 1, 300).alias("excerpt"))


@query("membership_filter", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') AND p_size BETWEEN 5 AND 30 AND p_type NOT IN ('ECONOMY')")
def membership_filter(spark, d):
    return T(spark, d, "part").where(F.col("p_brand").isin("Brand#2", "Brand#17") & F.col("p_size").between(5, 30) & ~F.col("p_type").isin("ECONOMY")).select("p_partkey", "p_brand")


@query("three_valued_filter", """
SELECT d.doc_id, (l.toxic <> 1) AS plain, (l.toxic IS DISTINCT FROM 1) AS nullsafe FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1""")
def three_valued_filter(spark, d):
    joined = T(spark, d, "documents").select("doc_id").join(T(spark, d, "labels"), "doc_id", "left")
    return joined.where(~F.col("toxic").eqNullSafe(F.lit(1))).select("doc_id", (F.col("toxic") != 1).alias("plain"), (~F.col("toxic").eqNullSafe(F.lit(1))).alias("nullsafe"))


@query("path_descendants", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://ththre.example.com/')")
def path_descendants(spark, d):
    return T(spark, d, "pages").where(F.col("url").startswith("http://ththre.example.com/")).select("page_id", "url")


_LIBRARY = "(SELECT o_orderkey AS book, CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'private' END AS visibility, o_orderpriority <> '5-LOW' AS listed, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS VARCHAR) END AS creator, CAST(o_custkey % 20 AS VARCHAR) AS creator_token, o_totalprice AS price, o_orderdate AS created FROM orders)"


def _library(spark, d):
    o = T(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "private")
    return o.select(F.col("o_orderkey").alias("book"), kind.alias("visibility"), (F.col("o_orderpriority") != "5-LOW").alias("listed"), F.when(F.col("o_custkey") % 5 != 0, (F.col("o_custkey") % 50).cast("string")).alias("creator"), (F.col("o_custkey") % 20).cast("string").alias("creator_token"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created"))


@query("visible_books", f"""
SELECT book, visibility, creator FROM {_LIBRARY} WHERE coalesce(visibility = 'public' AND listed, false) OR coalesce(creator = '7', false) OR coalesce(creator IS NULL AND creator_token = '15', false)""")
def visible_books(spark, d):
    rows = _library(spark, d)
    return rows.where(R.visible(F.col("visibility"), F.col("listed"), F.col("creator"), F.col("creator_token"), "7", "15")).select("book", "visibility", "creator")


@query("row_level_security", f"""
SELECT book FROM {_LIBRARY} b WHERE visibility = 'public' OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = 3 AND CAST(s.s_suppkey AS VARCHAR) = b.creator)""")
def row_level_security(spark, d):
    allowed = T(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").cast("string").alias("creator"), F.lit(True).alias("granted")).distinct()
    return _library(spark, d).join(allowed, "creator", "left").where((F.col("visibility") == "public") | F.col("granted")).select("book")


@query("scoped_sources", f"""
SELECT 'public' AS scope, count(*) AS n FROM {_LIBRARY} WHERE visibility = 'public' AND listed
UNION ALL SELECT 'mine', count(*) FROM {_LIBRARY} WHERE creator = '7'
UNION ALL SELECT 'shelf', count(*) FROM {_LIBRARY} WHERE book IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 11)""")
def scoped_sources(spark, d):
    lib = _library(spark, d)
    shelf = T(spark, d, "lineitem").where("l_partkey = 11").select(F.col("l_orderkey").alias("book"))
    scopes = [("public", lib.where("visibility = 'public' AND listed")), ("mine", lib.where("creator = '7'")), ("shelf", lib.join(shelf, "book", "left_semi"))]
    counts = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n") for name, x in scopes]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_NOTES = "(SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS creator, event_type = 'error' AS is_ai, CASE WHEN value < 10 THEN ' ' ELSE event_type END AS note, event_id % 11 = 0 AS pinned, user_id % 13 = 0 AS co_author FROM events)"


@query("annotation_gate", f"""
SELECT event_id FROM (SELECT *, coalesce(creator = '7', false) OR pinned AS exempt FROM {_NOTES})
WHERE (NOT is_ai OR exempt OR co_author) AND (creator IS NOT NULL OR exempt OR co_author) AND (regexp_matches(note, '\\S') OR exempt)""")
def annotation_gate(spark, d):
    e = T(spark, d, "events")
    notes = e.select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string")).alias("creator"), (F.col("event_type") == "error").alias("is_ai"), F.when(F.col("value") < 10, " ").otherwise(F.col("event_type")).alias("note"), (F.col("event_id") % 11 == 0).alias("pinned"), (F.col("user_id") % 13 == 0).alias("co_author"))
    return R.gate(notes, "7", True, True, True).select("event_id")


@query("embedding_eligible", "SELECT doc_id FROM documents d WHERE length(trim(coalesce(text, ''))) >= 20 AND lang <> 'es' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def embedding_eligible(spark, d):
    bad = T(spark, d, "labels").where("toxic = 1").select("doc_id")
    return T(spark, d, "documents").where((F.length(F.trim(F.coalesce("text", F.lit("")))) >= 20) & (F.col("lang") != "es")).select("doc_id").join(bad, "doc_id", "left_anti")


@query("json_predicates", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_predicates(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return T(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


@query("citable_types", "SELECT p_partkey, coalesce(p_type IN ('ECONOMY', 'STANDARD', 'PROMO'), false) AS citable FROM part")
def citable_types(spark, d):
    return T(spark, d, "part").select("p_partkey", (F.col("p_type").isNotNull() & F.col("p_type").isin("ECONOMY", "STANDARD", "PROMO")).alias("citable"))


@query("inner_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def inner_join(spark, d):
    return T(spark, d, "orders").join(T(spark, d, "customer").where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("left_join_conditional", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_orderstatus = 'F' AND o_custkey = c_custkey")
def left_join_conditional(spark, d):
    return T(spark, d, "orders").join(T(spark, d, "customer"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") == F.col("c_custkey")), "left").select("o_orderkey", "c_name")


@query("semi_and_exists_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_and_exists_column(spark, d):
    o = T(spark, d, "orders")
    big = o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k")).distinct()
    buyers = T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return buyers.join(big, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("big"))


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, d):
    return T(spark, d, "customer").join(T(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("lane_anti_join", "SELECT p_partkey FROM part WHERE p_size < 20 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45 AND l_returnflag = 'N')")
def lane_anti_join(spark, d):
    done = T(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'N'")
    return T(spark, d, "part").where("p_size < 20").join(done, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("coalesced_key_join", """
SELECT c.conv_id, c.turn, d.lang FROM (SELECT conv_id, turn, coalesce(CASE WHEN role = 'system' THEN NULL WHEN turn > 3 THEN conv_id + 1 END, conv_id) AS k FROM conversations) c JOIN documents d ON d.doc_id = c.k""")
def coalesced_key_join(spark, d):
    k = F.coalesce(F.when(F.col("role") == "system", None).when(F.col("turn") > 3, F.col("conv_id") + 1), "conv_id")
    keyed = T(spark, d, "conversations").select("conv_id", "turn", k.alias("k"))
    return keyed.join(T(spark, d, "documents").select("doc_id", "lang"), F.col("k") == F.col("doc_id")).select("conv_id", "turn", "lang")


@query("bridge_join", "SELECT o_custkey, p_brand, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def bridge_join(spark, d):
    o = T(spark, d, "orders")
    return o.join(T(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "p_brand").agg(F.count("*").alias("n"))


@query("four_way_aliases", "SELECT s.s_suppkey, n.n_name, r.r_name, c.c_custkey FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_custkey = s.s_suppkey AND c.c_nationkey = n.n_nationkey")
def four_way_aliases(spark, d):
    s, n, r, c = (T(spark, d, t).alias(t[0]) for t in ("supplier", "nation", "region", "customer"))
    joined = s.join(n, F.col("s.s_nationkey") == F.col("n.n_nationkey"), "left").join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey"), "left")
    return joined.join(c, (F.col("c.c_custkey") == F.col("s.s_suppkey")) & (F.col("c.c_nationkey") == F.col("n.n_nationkey")), "left").select("s_suppkey", "n_name", "r_name", "c_custkey")


@query("outer_join_count", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def outer_join_count(spark, d):
    return T(spark, d, "customer").join(T(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("first_block_per_book", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations WHERE trim(coalesce(text, '')) <> '') WHERE rn = 1")
def first_block_per_book(spark, d):
    rows = T(spark, d, "conversations").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return R.first_per_key(rows, ["conv_id"], ["turn", "role"]).select("conv_id", "turn", "text")


@query("totals", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def totals(spark, d):
    return T(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("distinct_over_union", "SELECT count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier UNION SELECT user_id FROM events)")
def distinct_over_union(spark, d):
    u = T(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(T(spark, d, "supplier").select("s_suppkey")).union(T(spark, d, "events").select("user_id"))
    return u.distinct().agg(F.count("*").alias("n"))


AS_OF = "2024-01-20 00:00:00"


@query("growth_by_period", f"""
SELECT count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS d1, count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS d7,
  count(DISTINCT user_id) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) AS d30, count(DISTINCT user_id) AS ever FROM events WHERE ts <= TIMESTAMP '{AS_OF}'""")
def growth_by_period(spark, d):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    since = lambda days: F.countDistinct(F.when(F.col("ts") > at - F.expr(f"INTERVAL {days} DAY"), F.col("user_id")))
    return T(spark, d, "events").where(F.col("ts") <= at).agg(since(1).alias("d1"), since(7).alias("d7"), since(30).alias("d30"), F.countDistinct("user_id").alias("ever"))


@query("activity_breakdown", "SELECT 'orders' AS kind, o_orderpriority AS sub, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2")
def activity_breakdown(spark, d):
    kinds = [("orders", "o_orderpriority"), ("events", "event_type"), ("documents", "lang")]
    parts = [T(spark, d, t).select(F.lit(t).alias("kind"), F.col(c).alias("sub")) for t, c in kinds]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("kind", "sub").agg(F.count("*").alias("n"))


@query("storage_by_category", """
SELECT l_returnflag AS category, count(*) AS n, round(sum(l_quantity), 2) AS bytes, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END), 2) AS open_bytes, bool_or(s_suppkey IS NULL) AS orphan, min(s_name) AS owner,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY 1""")
def storage_by_category(spark, d):
    joined = T(spark, d, "lineitem").join(T(spark, d, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    aggs = [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("bytes"), F.round(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)), 2).alias("open_bytes")]
    return joined.groupBy(F.col("l_returnflag").alias("category")).agg(*aggs, F.bool_or(F.col("s_suppkey").isNull()).alias("orphan"), F.min("s_name").alias("owner"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


@query("bucket_coverage", """
SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS bucket, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def bucket_coverage(spark, d):
    joined = T(spark, d, "documents").select("doc_id", "n_chars").join(T(spark, d, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    bucket = F.when(F.col("has").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("string_agg_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def string_agg_distinct(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("hourly_rollup", "SELECT date_trunc('hour', ts) AS hour, event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_rollup(spark, d):
    return T(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max("ts").alias("last"), F.count("*").alias("n"))


@query("status_counts", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def status_counts(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))


@query("chunk_manifest", "SELECT conv_id, CAST(floor(turn / 3) AS BIGINT) AS chunk, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM conversations GROUP BY 1, 2")
def chunk_manifest(spark, d):
    return T(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 3).alias("chunk")).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"))


@query("apportioned_bytes", "SELECT lang, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM documents) * (SELECT sum(strlen(text)) FROM documents), 2) AS share FROM documents GROUP BY 1")
def apportioned_bytes(spark, d):
    docs = T(spark, d, "documents")
    whole = docs.agg(F.count("*").alias("all"), F.sum(F.octet_length("text")).alias("bytes"))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(F.broadcast(whole)).select("lang", "n", F.round(F.col("n") * 1.0 / F.col("all") * F.col("bytes"), 2).alias("share"))


@query("self_citation_totals", """
SELECT book, count(*) AS citations FROM (SELECT l_orderkey AS book, '/' || (l_partkey % 40) || CASE WHEN l_linenumber % 3 = 0 THEN '/Fn1' ELSE '' END || '#cite_' || l_linenumber AS url FROM lineitem)
WHERE regexp_extract(url, '^/([^#]+)#', 1) <> CAST(book % 40 AS VARCHAR) GROUP BY 1""")
def self_citation_totals(spark, d):
    url = F.concat(F.lit("/"), (F.col("l_partkey") % 40).cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "/Fn1").otherwise(""), F.lit("#cite_"), F.col("l_linenumber").cast("string"))
    books = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book")).agg(F.to_json(F.collect_list(url)).alias("cited"))
    cited = books.select("book", F.explode(F.from_json("cited", "array<string>")).alias("url"))
    return cited.where(F.regexp_extract("url", "^/([^#]+)#", 1) != (F.col("book") % 40).cast("string")).groupBy("book").agg(F.count("*").alias("citations"))


@query("error_signatures", r"""
SELECT substr(sha1(regexp_replace(regexp_replace(event_type || ' failed at ' || event_id || ' for ' || user_id, '[0-9]+', 'N', 'g'), '\s+', ' ', 'g')), 1, 12) AS signature, count(*) AS n, min(ts) AS oldest FROM events GROUP BY 1""")
def error_signatures(spark, d):
    text = F.concat("event_type", F.lit(" failed at "), F.col("event_id").cast("string"), F.lit(" for "), F.col("user_id").cast("string"))
    sig = F.substring(F.sha1(F.regexp_replace(F.regexp_replace(text, "[0-9]+", "N"), r"\s+", " ").cast("binary")), 1, 12)
    return T(spark, d, "events").groupBy(sig.alias("signature")).agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("fulltext_grouped", """
SELECT lang, n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM (SELECT lang, doc_id, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents WHERE contains(lower(text), 'license')) WHERE place <= 50 GROUP BY 1, 2""")
def fulltext_grouped(spark, d):
    """Hits grouped with their number and the first fifty of each group, as a search page shows them."""
    hits = T(spark, d, "documents").where(F.lower("text").contains("license")).select("lang", "doc_id")
    first = hits.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("place <= 50")
    shown = first.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return hits.groupBy("lang").agg(F.count("*").alias("n")).join(shown, "lang").select("lang", "n", "ids")


@query("node_degree", "SELECT node, count(*) AS degree FROM (SELECT 'b' || l_orderkey AS node FROM lineitem UNION ALL SELECT 'w' || l_partkey FROM lineitem) GROUP BY 1")
def node_degree(spark, d):
    ends = T(spark, d, "lineitem").select(F.explode(F.array(F.concat(F.lit("b"), F.col("l_orderkey").cast("string")), F.concat(F.lit("w"), F.col("l_partkey").cast("string")))).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


@query("missing_embeddings", "SELECT lang, count(*) AS missing FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL GROUP BY 1 ORDER BY missing DESC, lang")
def missing_embeddings(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang").join(T(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti")
    return docs.groupBy("lang").agg(F.count("*").alias("missing")).orderBy(F.desc("missing"), "lang")


@query("ledger_running_balance", "SELECT o_orderkey, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM orders")
def ledger_running_balance(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return T(spark, d, "orders").select("o_orderkey", "o_custkey", F.sum(F.col("o_totalprice").cast("decimal(14,4)")).over(w).cast("double").alias("balance"))


@query("groups_by_latest", "SELECT user_id, max(CASE WHEN event_type = 'error' THEN ts END) AS latest FROM events GROUP BY 1 ORDER BY latest DESC NULLS LAST, user_id LIMIT 40")
def groups_by_latest(spark, d):
    return T(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("latest")).orderBy(F.desc_nulls_last("latest"), "user_id").limit(40)


@query("percentile_histogram", """
WITH v AS (SELECT p_brand, count(l_partkey) AS v FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey, p_brand),
g AS (SELECT p_brand, count(*) AS n, list(v ORDER BY v) AS s, count(*) FILTER (WHERE v = 0) AS h0, count(*) FILTER (WHERE v BETWEEN 1 AND 4) AS h1, count(*) FILTER (WHERE v BETWEEN 5 AND 9) AS h5, count(*) FILTER (WHERE v BETWEEN 10 AND 25) AS h10, count(*) FILTER (WHERE v >= 26) AS h26 FROM v GROUP BY 1)
SELECT p_brand, n, s[1 + CAST(floor(0.1 * (n - 1)) AS INT)] AS p10, s[1 + CAST(floor(0.25 * (n - 1)) AS INT)] AS p25, s[1 + CAST(floor(0.5 * (n - 1)) AS INT)] AS p50, s[1 + CAST(floor(0.75 * (n - 1)) AS INT)] AS p75, s[1 + CAST(floor(0.9 * (n - 1)) AS INT)] AS p90,
       h0, h1, h5, h10, h26, round(100.0::DOUBLE * h0 / n, 4) AS share0, round(100.0::DOUBLE * h26 / n, 4) AS share26 FROM g""")
def percentile_histogram(spark, d):
    """Discrete lower percentiles and fixed bins of works' citations, from counts of values: no group's rows meet in one task."""
    cited = T(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("v"))
    value = T(spark, d, "part").select("p_partkey", "p_brand").join(cited, "p_partkey", "left").select("p_brand", F.coalesce("v", F.lit(0)).alias("v"))
    w = W.partitionBy("p_brand")
    counts = value.groupBy("p_brand", "v").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor(p * (F.col("n") - 1)), F.col("v")))
    held = lambda lo, hi: F.coalesce(F.sum(F.when(F.col("v").between(lo, hi), F.col("c"))), F.lit(0))
    bins = {"h0": (0, 0), "h1": (1, 4), "h5": (5, 9), "h10": (10, 25), "h26": (26, 2**62)}
    got = counts.groupBy("p_brand").agg(F.max("n").alias("n"), *(pick(q / 100).alias(f"p{q}") for q in (10, 25, 50, 75, 90)), *(held(*b).alias(k) for k, b in bins.items()))
    share = lambda k: F.round(100.0 * F.col(k) / F.col("n"), 4)
    return got.withColumns({"share0": share("h0"), "share26": share("h26")})


@query("median_outliers", "SELECT doc_id, n_chars FROM documents, (SELECT list(n_chars ORDER BY n_chars)[1 + CAST(floor(count(*) / 2) AS INT)] AS median FROM documents) WHERE n_chars >= greatest(500, 3 * median)")
def median_outliers(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "n_chars")
    # The median by counts of values: one row per distinct length, not per document.
    by = docs.groupBy("n_chars").agg(F.count("*").alias("c"))
    run = by.select("n_chars", F.sum("c").over(W.orderBy("n_chars")).alias("upto"), F.sum("c").over(W.partitionBy()).alias("all"))
    median = run.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n_chars").alias("median"))
    return docs.join(F.broadcast(median)).where(F.col("n_chars") >= F.greatest(F.lit(500), 3 * F.col("median"))).select("doc_id", "n_chars")


def _ranking(name, sql, metric):
    @query(name, f"SELECT o_custkey, metric, row_number() OVER (ORDER BY metric DESC, created, o_custkey) AS position FROM (SELECT o_custkey, {sql} AS metric, min(o_orderdate) AS created FROM orders GROUP BY 1)")
    def ranking(spark, d):
        books = T(spark, d, "orders").groupBy("o_custkey").agg(metric().alias("metric"), F.min("o_orderdate").alias("created"))
        return R.rank_positions(books, [F.desc("metric"), "created", "o_custkey"]).select("o_custkey", "metric", F.col("position").cast("long").alias("position"))


_ranking("rank_most_recent", "max(o_orderdate)", lambda: F.max("o_orderdate"))
_ranking("rank_most_connected", "count(*)", lambda: F.count("*"))
_ranking("rank_composite", "CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END) AS BIGINT)", lambda: F.sum(F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)))


@query("renumbered_rows", "SELECT conv_id, turn, 100 * row_number() OVER w AS line, CAST(floor((row_number() OVER w - 1) / 100) AS BIGINT) AS chunk FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def renumbered_rows(spark, d):
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long")
    return T(spark, d, "conversations").select("conv_id", "turn", (n * 100).alias("line"), F.floor((n - 1) / 100).alias("chunk"))


@query("local_context", "SELECT conv_id, turn FROM (SELECT conv_id, turn, max(CASE WHEN text LIKE '%the %' AND role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM conversations) WHERE near = 1")
def local_context(spark, d):
    hit = F.when(F.col("text").contains("the ") & (F.col("role") == "user"), 1).otherwise(0)
    near = F.max(hit).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2))
    return T(spark, d, "conversations").select("conv_id", "turn", near.alias("near")).where("near = 1").select("conv_id", "turn")


@query("occurrence_index", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS occurrence FROM lineitem")
def occurrence_index(spark, d):
    w = W.partitionBy("l_partkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


@query("lag_lead_context", "SELECT conv_id, turn, right(lag(text) OVER w, 50) AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_lead_context(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return T(spark, d, "conversations").select("conv_id", "turn", F.right(F.lag("text").over(w), F.lit(50)).alias("before"), F.lead("role").over(w).alias("after"))


@query("sequence_gaps", """
SELECT l_suppkey, segment, count(*) AS n, CAST(sum(CASE WHEN nxt > l_linenumber + 1 THEN nxt - l_linenumber - 1 ELSE 0 END) AS BIGINT) AS missing
FROM (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_suppkey, segment ORDER BY k1, k2, k3) AS nxt FROM (
  SELECT l_suppkey, l_linenumber, k1, k2, k3, CAST(sum(reset) OVER (PARTITION BY l_suppkey ORDER BY k1, k2, k3 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (
    SELECT l_suppkey, l_linenumber, l_orderkey AS k1, l_partkey AS k2, l_extendedprice AS k3,
      CASE WHEN l_linenumber <= lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_extendedprice) THEN 1 ELSE 0 END AS reset FROM lineitem)))
GROUP BY 1, 2""")
def sequence_gaps(spark, d):
    w = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    reset = T(spark, d, "lineitem").withColumn("reset", F.when(F.col("l_linenumber") <= F.lag("l_linenumber").over(w), 1).otherwise(0))
    seg = reset.withColumn("segment", F.sum("reset").over(w.rowsBetween(W.unboundedPreceding, 0)))
    nxt = F.lead("l_linenumber").over(W.partitionBy("l_suppkey", "segment").orderBy("l_orderkey", "l_partkey", "l_extendedprice"))
    gap = seg.withColumn("nxt", nxt).withColumn("gap", F.when(F.col("nxt") > F.col("l_linenumber") + 1, F.col("nxt") - F.col("l_linenumber") - 1).otherwise(0))
    return gap.groupBy("l_suppkey", "segment").agg(F.count("*").alias("n"), F.sum("gap").alias("missing"))


@query("cross_row_windows", "SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS roles FROM conversations")
def cross_row_windows(spark, d):
    roles = F.collect_list("role").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 3))
    return T(spark, d, "conversations").select("conv_id", "turn", F.array_join(roles, ">").alias("roles"))


@query("neighbour_interpolation", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
  first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM events""")
def neighbour_interpolation(spark, d):
    known, w = F.when(F.col("event_type") == "purchase", F.col("value")), W.partitionBy("user_id").orderBy("ts", "event_id")
    return T(spark, d, "events").select("event_id", "user_id", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("before"), F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("after"))


@query("position_ratio", "SELECT conv_id, round(avg(rn) / max(n), 6) AS ratio FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE role = 'assistant' GROUP BY 1")
def position_ratio(spark, d):
    w = W.partitionBy("conv_id")
    rows = T(spark, d, "conversations").select("conv_id", "role", F.row_number().over(w.orderBy("turn")).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.where("role = 'assistant'").groupBy("conv_id").agg(F.round(F.avg("rn") / F.max("n"), 6).alias("ratio"))


@query("first_visible_pointer", "SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'author' END, CASE WHEN p_retailprice > 1500 THEN 'publisher' END, CASE WHEN p_type = 'PROMO' THEN 'commons' END, 'auto') AS pointer FROM part")
def first_visible_pointer(spark, d):
    return T(spark, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 40, "author"), F.when(F.col("p_retailprice") > 1500, "publisher"), F.when(F.col("p_type") == "PROMO", "commons"), F.lit("auto")).alias("pointer"))


@query("two_stage_topk", """
SELECT * FROM (SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY score DESC, id LIMIT 30) UNION ALL SELECT * FROM (SELECT 'part', p_partkey, p_retailprice * 300 AS score FROM part ORDER BY score DESC, p_partkey LIMIT 30)) ORDER BY score DESC, kind, id LIMIT 20 OFFSET 10""")
def two_stage_topk(spark, d):
    o = T(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(30)
    p = T(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 300).alias("score")).orderBy(F.desc("score"), "id").limit(30)
    return o.unionByName(p).orderBy(F.desc("score"), "kind", "id").offset(10).limit(20)


@query("shelf_sorted", r"SELECT page_id, CAST(nullif(regexp_extract(url, '(\d+)', 1), '') AS BIGINT) AS issue FROM pages ORDER BY issue DESC NULLS LAST, lower(url), page_id LIMIT 25")
def shelf_sorted(spark, d):
    issue = F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit("")).cast("long")
    return T(spark, d, "pages").select("page_id", issue.alias("issue"), "url").orderBy(F.desc_nulls_last("issue"), F.lower("url"), "page_id").limit(25).select("page_id", "issue")


@query("pin_overlay", "SELECT o_orderkey, pos FROM orders LEFT JOIN (SELECT n_nationkey * 3 AS k, n_regionkey AS pos FROM nation) ON o_orderkey = k ORDER BY pos NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 41")
def pin_overlay(spark, d):
    pins = T(spark, d, "nation").select((F.col("n_nationkey") * 3).alias("k"), F.col("n_regionkey").alias("pos"))
    return T(spark, d, "orders").join(F.broadcast(pins), F.col("o_orderkey") == F.col("k"), "left").orderBy(F.asc_nulls_last("pos"), F.desc("o_totalprice"), "o_orderkey").limit(41).select("o_orderkey", "pos")


@query("capped_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def capped_per_key(spark, d):
    return R.first_per_key(T(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("union_pathways", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def union_pathways(spark, d):
    li = T(spark, d, "lineitem")
    return li.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).union(li.where("l_discount > 0.09").select("l_partkey")).union(T(spark, d, "part").where("p_size = 1").select("p_partkey")).distinct()


@query("retrieval_merge", """
SELECT doc_id, via FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS rn FROM (
  SELECT vec_id AS doc_id, 'embedding' AS via, 0 AS priority FROM embeddings WHERE label = 3 UNION ALL SELECT doc_id, 'keyword', 1 FROM documents WHERE contains(text, 'tion') UNION ALL SELECT doc_id, 'library', 2 FROM labels)) WHERE rn = 1""")
def retrieval_merge(spark, d):
    via = lambda df, key, name: df.select(F.col(key).alias("doc_id"), F.lit(name).alias("via"))
    branches = [via(T(spark, d, "embeddings").where("label = 3"), "vec_id", "embedding"), via(T(spark, d, "documents").where(F.col("text").contains("tion")), "doc_id", "keyword"), via(T(spark, d, "labels"), "doc_id", "library")]
    return R.priority_merge(branches, "doc_id", ["via"]).select("doc_id", "via")


@query("dedup_keep_last", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_keep_last(spark, d):
    return R.keep_last(T(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("array_set_ops", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(lower(p_type) || ' ring widget', ' '))) AS common FROM part")
def array_set_ops(spark, d):
    common = F.array_intersect(F.split("p_name", " "), F.split(F.concat(F.lower("p_type"), F.lit(" ring widget")), " "))
    return T(spark, d, "part").select("p_partkey", F.size(common).cast("long").alias("common"))


@query("unmatched_refs_defs", "SELECT 'ref' AS side, CAST(l_partkey AS BIGINT) AS k FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 30) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) UNION ALL SELECT 'def', p_partkey FROM part WHERE p_size < 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def unmatched_refs_defs(spark, d):
    refs = T(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("k")).distinct()
    defs = T(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return refs.join(defs, "k", "left_anti").select(F.lit("ref").alias("side"), "k").union(defs.join(refs, "k", "left_anti").select(F.lit("def"), "k"))


@query("upsert_merge", """
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice, CASE WHEN s.o_orderkey IS NULL THEN t.tag WHEN t.o_totalprice IS NOT DISTINCT FROM s.o_totalprice THEN t.tag END AS tag
FROM (SELECT o_orderkey, o_totalprice, o_orderpriority AS tag FROM orders WHERE o_orderstatus <> 'P') t FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F') s ON t.o_orderkey = s.o_orderkey""")
def upsert_merge(spark, d):
    o = T(spark, d, "orders")
    target = o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("tag"))
    source = o.where("o_orderstatus <> 'F'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("o_totalprice"))
    return R.upsert(target, source, ["o_orderkey"], {"tag": "o_totalprice"})


@query("insert_absent", "SELECT c_custkey AS k, 'old' AS src FROM customer WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def insert_absent(spark, d):
    old = T(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("src"))
    new = T(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("new").alias("src")).distinct()
    return R.insert_absent(old, new, ["k"])


@query("heal_from_canonical", "SELECT c_custkey AS k, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END, ''), s_name) AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def heal_from_canonical(spark, d):
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 2, F.col("c_name")).alias("name"))
    return R.heal(c, T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k", ["name"])


@query("claim_queue", "SELECT o_orderkey, CASE WHEN rn <= 10 THEN 'claimed' ELSE 'open' END AS state FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P')")
def claim_queue(spark, d):
    waiting = T(spark, d, "orders").where("o_orderstatus = 'P'")
    claimed = waiting.orderBy("o_orderdate", "o_orderkey").limit(10).select("o_orderkey", F.lit("claimed").alias("s"))
    return waiting.join(F.broadcast(claimed), "o_orderkey", "left").select("o_orderkey", F.coalesce("s", F.lit("open")).alias("state"))
