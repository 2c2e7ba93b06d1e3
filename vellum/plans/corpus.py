"""Search, vectors, linkage, graphs, versions, conversion and text measures as queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from vellum.operators import convert, graph, linkage as L, relational as R, search as S, temporal as V
from vellum.plans.registry import query
from vellum.session import table as T

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: t <> '')"


def _searched(name, text, sql, any_=False):
    @query(name, f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents) WHERE {sql}")
    def run(spark, d):
        parsed, body = S.parse_query(text, any_), F.coalesce(F.col("text"), F.lit(""))
        docs = T(spark, d, "documents").select("doc_id", body.alias("text")).where(S.possible(F.col("text"), parsed))
        return docs.where(S.matches(R.string_tokens(F.col("text")), parsed)).select("doc_id")


_searched("node_search_and", "license versi", "list_contains(toks, 'license') AND len(list_filter(toks, lambda t: starts_with(t, 'versi'))) > 0")
_searched("node_search_or", "idiot apache", "list_contains(toks, 'idiot') OR len(list_filter(toks, lambda t: starts_with(t, 'apache'))) > 0", True)
_searched("node_search_phrase", '"under the apache license"', "contains(' ' || array_to_string(toks, ' ') || ' ', ' under the apache license ')")
_searched("node_search_prefix", "licen", "len(list_filter(toks, lambda t: starts_with(t, 'licen'))) > 0")


@query("search_fallback", """
WITH exact AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'licenses')), stemmed AS (SELECT doc_id FROM documents WHERE contains(lower(text), 'license'))
SELECT doc_id, 'exact' AS stage FROM exact UNION ALL SELECT doc_id, 'stemmed' FROM stemmed WHERE NOT EXISTS (SELECT 1 FROM exact)""")
def search_fallback(spark, d):
    """Both stages in one plan; the second counts only where the first found nothing."""
    docs = T(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    staged = docs.where(F.col("t").contains("license")).select("doc_id", F.col("t").contains("licenses").alias("exact"))
    any_exact = staged.agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("any"))
    return staged.join(F.broadcast(any_exact)).where(F.col("exact") | ~F.col("any")).select("doc_id", F.when(F.col("exact"), "exact").otherwise("stemmed").alias("stage"))


@query("search_terms", """
SELECT item_id, array_to_string(list_slice(list_distinct_ordered, 1, 15), ' ') AS terms FROM (SELECT item_id, list_filter(toks, lambda t, i: length(t) > 3 AND list_position(toks, t) = i) AS list_distinct_ordered FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9'']+') AS toks FROM benchmark))""")
def search_terms(spark, d):
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9']+"), lambda t: F.length(t) > 3))
    return T(spark, d, "benchmark").select("item_id", F.array_join(F.slice(terms, 1, 15), " ").alias("terms"))


@query("in_text_occurrences", """
SELECT doc_id, pos - 1 AS pos FROM (SELECT doc_id, lower(text) AS t, unnest(range(1, length(text) + 1)) AS pos FROM documents) WHERE substr(t, pos, 3) = 'and'""")
def in_text_occurrences(spark, d):
    return T(spark, d, "documents").select("doc_id", F.explode(S.occurrences(F.col("text"), "and")).alias("pos")).select("doc_id", F.col("pos").cast("long").alias("pos"))


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cos_sql(a, b):
    dot = lambda x, y: _COS.format(a=x, b=y)
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


@query("semantic_topk", f"""
SELECT vec_id, match FROM (SELECT vec_id, s, round(greatest(0, (s - 0.05) / (1 - 0.05)) * 100, 4) AS match FROM (SELECT e.vec_id, {_cos_sql('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 3 AND e.vec_id <> 0) ORDER BY s DESC, vec_id LIMIT 20) WHERE 1 - s <= 0.95""")
def semantic_topk(spark, d):
    e = T(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = S.cosine(F.col("embedding"), F.col("q"))
    top = e.where("label <> 3 AND vec_id <> 0").join(F.broadcast(probe)).select("vec_id", s.alias("s")).orderBy(F.desc("s"), "vec_id").limit(20)
    return top.where("1 - s <= 0.95").select("vec_id", F.round(F.greatest(F.lit(0.0), (F.col("s") - 0.05) / (1 - 0.05)) * 100, 4).alias("match"))


@query("similar_same_label", f"""
SELECT e.vec_id, round({_cos_sql('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding, label, vec_id FROM embeddings WHERE vec_id = 5) q WHERE e.label = q.label AND e.vec_id <> q.vec_id ORDER BY score DESC, e.vec_id LIMIT 10""")
def similar_same_label(spark, d):
    e = T(spark, d, "embeddings")
    probe = e.where("vec_id = 5").select(F.col("embedding").alias("q"), F.col("label").alias("ql"), F.col("vec_id").alias("qi"))
    return e.join(F.broadcast(probe), (F.col("label") == F.col("ql")) & (F.col("vec_id") != F.col("qi"))).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("stray_vectors", "SELECT vec_id FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = vec_id AND length(trim(text)) >= 200)")
def stray_vectors(spark, d):
    return T(spark, d, "embeddings").join(T(spark, d, "documents").where(F.length(F.trim("text")) >= 200), F.col("vec_id") == F.col("doc_id"), "left_anti").select("vec_id")


_TRI = "list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)))"


@query("trigram_jaccard_pairs", f"""
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS score FROM (SELECT item_id, {_TRI.format(t='text')} AS g, text FROM benchmark) a
JOIN (SELECT item_id, {_TRI.format(t='text')} AS g, text FROM benchmark) b ON a.item_id < b.item_id AND substr(lower(a.text), 1, 1) = substr(lower(b.text), 1, 1)""")
def trigram_jaccard_pairs(spark, d):
    g = T(spark, d, "benchmark").select("item_id", L.trigrams(F.col("text")).alias("g"), F.substring(F.lower("text"), 1, 1).alias("block"))
    a, b = g.select(F.col("item_id").alias("a"), F.col("g").alias("x"), "block"), g.select(F.col("item_id").alias("b"), F.col("g").alias("y"), "block")
    return a.join(b, "block").where("a < b").select("a", "b", F.round(L.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


@query("quote_locate_exact", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_locate_exact(spark, d):
    return L.locate_quotes(T(spark, d, "benchmark"), T(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("head_tail_signature", "SELECT doc_id, md5(left(text, 300) || right(text, 300)) AS signature FROM documents")
def head_tail_signature(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(F.concat(F.left("text", F.lit(300)), F.right("text", F.lit(300)))).alias("signature"))


@query("normalised_titles", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ': ' || p_brand), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part")
def normalised_titles(spark, d):
    return T(spark, d, "part").select("p_partkey", L.normalise(F.concat("p_name", F.lit(": "), "p_brand")).alias("title"))


@query("identifiers", r"""
SELECT page_id, nullif(regexp_extract(html, '(10\.\d{4,9}/[A-Za-z0-9._;()/:-]+)', 1), '') AS doi, nullif(regexp_extract(html, '(97[89][0-9-]{10,14})', 1), '') AS isbn, nullif(regexp_extract(html, '(\d{4}\.\d{4,5})', 1), '') AS arxiv FROM pages""")
def identifiers(spark, d):
    pick = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return T(spark, d, "pages").select("page_id", pick(r"(10\.\d{4,9}/[A-Za-z0-9._;()/:-]+)").alias("doi"), pick("(97[89][0-9-]{10,14})").alias("isbn"), pick(r"(\d{4}\.\d{4,5})").alias("arxiv"))


@query("abstract_from_inverted_index", "SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS abstract FROM conversations GROUP BY 1")
def abstract_from_inverted_index(spark, d):
    index = T(spark, d, "conversations").groupBy("conv_id", "role").agg(F.collect_list("turn").alias("places"))
    words = index.select("conv_id", "role", F.explode("places").alias("at"))
    return words.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "role"))), lambda s: s["role"]), " ").alias("abstract"))


@query("script_histogram", r"SELECT doc_id, len(regexp_extract_all(text, '[a-zA-Z]')) AS latin, len(regexp_extract_all(text, '[à-ÿ]')) AS accented, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents")
def script_histogram(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return T(spark, d, "documents").select("doc_id", n("[a-zA-Z]").alias("latin"), n("[à-ÿ]").alias("accented"), n("[0-9]").alias("digits"))


@query("script_match", r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[a-zA-Zà-ÿ]')) * 2 >= length(text) AND lang <> 'en'")
def script_match(spark, d):
    return T(spark, d, "documents").where((F.regexp_count("text", F.lit("[a-zA-Zà-ÿ]")) * 2 >= F.length("text")) & (F.col("lang") != "en")).select("doc_id")


@query("printable_ratio", r"SELECT page_id, round(len(regexp_extract_all(html, '[\x20-\x7E]')) / CAST(greatest(length(html), 1) AS DOUBLE), 6) AS ratio FROM pages")
def printable_ratio(spark, d):
    return T(spark, d, "pages").select("page_id", F.round(F.regexp_count("html", F.lit(r"[\x20-\x7E]")) / F.greatest(F.length("html"), F.lit(1)), 6).alias("ratio"))


@query("year_scores", "SELECT l_orderkey, l_linenumber, p_partkey, CASE abs(p_size - l_quantity) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM lineitem JOIN part ON l_partkey = p_partkey")
def year_scores(spark, d):
    joined = T(spark, d, "lineitem").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "p_partkey", L.year_score(F.col("p_size"), F.col("l_quantity")).alias("score"))


@query("year_gap_reject", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount < 0.06 AND least(abs(p_size - l_quantity), abs(p_size - l_linenumber)) > 5")
def year_gap_reject(spark, d):
    joined = T(spark, d, "lineitem").where("l_discount < 0.06").join(T(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.where(F.least(F.abs(F.col("p_size") - F.col("l_quantity")), F.abs(F.col("p_size") - F.col("l_linenumber"))) > 5).select("l_orderkey", "l_linenumber", "l_partkey")


@query("pointer_unique_match", "SELECT c_custkey, p_partkey FROM (SELECT c_custkey, p_partkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN part ON p_brand = 'Brand#' || c_nationkey AND p_size = c_custkey % 50) WHERE n = 1")
def pointer_unique_match(spark, d):
    c = T(spark, d, "customer").select("c_custkey", F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("p_brand"), (F.col("c_custkey") % 50).alias("p_size"))
    parts = T(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("p_partkey"))  # a row for each key that customers meet
    met = c.join(parts, ["p_brand", "p_size"]).groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("p_partkey").alias("p_partkey"))
    return met.where("n = 1").select("c_custkey", "p_partkey")


@query("match_waves", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN e.p_partkey IS NOT NULL AND l_quantity < 10 THEN 'linked' WHEN b.k IS NOT NULL THEN 'identifier' ELSE 'unresolved' END AS method FROM lineitem LEFT JOIN part e ON e.p_partkey = l_partkey AND e.p_size < 20 LEFT JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000) b ON b.k = l_suppkey""")
def match_waves(spark, d):
    """Successive waves over a shrinking pool: what one resolves, the next doesn't see."""
    pool = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    first = T(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("k1"))
    second = T(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("k2"))
    tagged = pool.join(first, F.col("k1") == F.col("l_partkey"), "left").join(second, F.col("k2") == F.col("l_suppkey"), "left")
    return tagged.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("k1").isNotNull() & (F.col("l_quantity") < 10), "linked").when(F.col("k2").isNotNull(), "identifier").otherwise("unresolved").alias("method"))


@query("substring_theta_join", "SELECT page_id, n_name FROM pages JOIN nation ON contains(html, '/' || n_regionkey || n_nationkey)")
def substring_theta_join(spark, d):
    """A few names against all pages: the names' side is the fixed nation table of 25 rows."""
    names = T(spark, d, "nation").select("n_name", F.concat(F.lit("/"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("needle"))
    return T(spark, d, "pages").join(F.broadcast(names), F.col("html").contains(F.col("needle"))).select("page_id", "n_name")


@query("corpus_quality_signals", r"""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n < 5 THEN 'few_blocks' END, CASE WHEN chars < 2000 THEN 'short' END, CASE WHEN empties * 2 > n THEN 'empty' END, CASE WHEN alpha < 0.6 * chars THEN 'symbols' END, CASE WHEN n - uniq > 0.3 * n THEN 'repeats' END], lambda x: x IS NOT NULL), ',') AS signals
FROM (SELECT doc_id, count(*) AS n, sum(length(line)) AS chars, count(*) FILTER (WHERE trim(line) = '') AS empties, sum(len(regexp_extract_all(line, '[a-zA-Zà-ÿß]'))) AS alpha, count(DISTINCT line) AS uniq FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1)""")
def corpus_quality_signals(spark, d):
    lines = T(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    g = lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.count_if(F.trim("line") == "").alias("empties"), F.sum(F.regexp_count("line", F.lit("[a-zA-Zà-ÿß]"))).alias("alpha"), F.countDistinct("line").alias("uniq"))
    flags = [("few_blocks", F.col("n") < 5), ("short", F.col("chars") < 2000), ("empty", F.col("empties") * 2 > F.col("n")), ("symbols", F.col("alpha") < 0.6 * F.col("chars")), ("repeats", F.col("n") - F.col("uniq") > 0.3 * F.col("n"))]
    return g.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in flags])), ",").alias("signals"))


@query("body_presence", "SELECT doc_id, CASE WHEN count(*) FILTER (WHERE length(line) >= 400) < 5 AND coalesce(sum(length(line)) FILTER (WHERE length(line) >= 200), 0) < 10000 THEN 'absent' ELSE 'present' END AS verdict FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def body_presence(spark, d):
    n = F.length("line")
    lines = T(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    g = lines.groupBy("doc_id").agg(F.count_if(n >= 400).alias("prose"), F.coalesce(F.sum(F.when(n >= 200, n)), F.lit(0)).alias("chars"))
    return g.select("doc_id", F.when((F.col("prose") < 5) & (F.col("chars") < 10000), "absent").otherwise("present").alias("verdict"))


@query("stale_span_pruning", "SELECT e.event_id, count(*) AS kept FROM (SELECT event_id, unnest([0, CAST(value * 10 AS BIGINT), CAST(value * 40 AS BIGINT)]) AS s FROM events) e JOIN documents d ON d.doc_id = e.event_id WHERE s < d.n_chars GROUP BY 1")
def stale_span_pruning(spark, d):
    """Spans that begin within their document. Halves round to the even number, as the SQL's casts do; rows of one event count together."""
    starts = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit(0).cast("long"), F.rint(F.col("value") * 10).cast("long"), F.rint(F.col("value") * 40).cast("long")))
    spans = T(spark, d, "events").select("event_id", starts.alias("spans"))
    joined = spans.join(T(spark, d, "documents").select("doc_id", "n_chars"), F.col("event_id") == F.col("doc_id"))
    pruned = joined.select("event_id", F.map_filter("spans", lambda k, v: v < F.col("n_chars")).alias("spans"))
    return pruned.groupBy("event_id").agg(F.sum(F.size("spans")).alias("kept")).where("kept > 0")


@query("best_open_copy", "SELECT p_partkey, url FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, pos) AS rn FROM (SELECT p_partkey, 'http://a/' || p_size AS url, CASE WHEN p_type = 'PROMO' THEN 200 ELSE 100 END AS score, 0 AS pos FROM part UNION ALL SELECT p_partkey, 'http://b/' || p_brand, CASE WHEN p_size > 25 THEN 210 ELSE 10 END, 1 FROM part)) WHERE rn = 1")
def best_open_copy(spark, d):
    copies = F.array(F.struct(F.concat(F.lit("http://a/"), F.col("p_size").cast("string")).alias("url"), F.when(F.col("p_type") == "PROMO", 200).otherwise(100).alias("score")), F.struct(F.concat(F.lit("http://b/"), "p_brand").alias("url"), F.when(F.col("p_size") > 25, 210).otherwise(10).alias("score")))
    rows = T(spark, d, "part").select("p_partkey", F.posexplode(copies).alias("pos", "c")).select("p_partkey", "pos", "c.url", "c.score")
    return R.first_per_key(rows, ["p_partkey"], [F.desc("score"), "pos"]).select("p_partkey", "url")


@query("ibid_resolution", """
SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS antecedent FROM events""")
def ibid_resolution(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return T(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") != "click", F.col("event_id")), True).over(w).alias("antecedent"))


#: All references, cycles too: orders and parts share their numbers as books and works do.
_EDGES = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def _edges(spark, d):
    li = T(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("graph_edges", f"SELECT src, dst FROM {_EDGES}")
def graph_edges(spark, d):
    return _edges(spark, d)


_REACH = f"WITH RECURSIVE e AS MATERIALIZED {_EDGES}, seen(node, depth) USING KEY (node) AS (SELECT 1400::BIGINT, 0 UNION SELECT e.dst, min(depth) + 1 FROM seen JOIN e ON e.src = seen.node WHERE e.dst NOT IN (SELECT node FROM recurring.seen) GROUP BY e.dst)"


@query("citation_reach", f"{_REACH} SELECT node, min(depth) AS depth FROM seen GROUP BY 1")
def citation_reach(spark, d):
    return graph.reach(_edges(spark, d), spark.createDataFrame([(1400,)], "node long"))


@query("focus_network", f"{_REACH} SELECT src, dst FROM e WHERE src IN (SELECT node FROM seen UNION SELECT dst FROM e WHERE src = 1400 UNION SELECT src FROM e WHERE dst = 1400) AND dst IN (SELECT node FROM seen UNION SELECT dst FROM e WHERE src = 1400 UNION SELECT src FROM e WHERE dst = 1400)")
def focus_network(spark, d):
    return graph.focus_network(_edges(spark, d), spark.createDataFrame([(1400,)], "node long"))


@query("delinked_references", "SELECT o_custkey, array_to_string(list_filter(list(o_orderkey ORDER BY o_orderkey), lambda x: x % 7 <> 0), ',') AS refs FROM orders GROUP BY 1")
def delinked_references(spark, d):
    refs = F.filter(F.sort_array(F.collect_list("o_orderkey")), lambda x: x % 7 != 0)
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(refs, lambda x: x.cast("string")), ",").alias("refs"))


@query("graph_layout", f"SELECT n AS node, round(log2(1 + count(*)) * 16, 6) AS y FROM (SELECT src AS n FROM {_EDGES} UNION ALL SELECT dst FROM {_EDGES}) GROUP BY 1")
def graph_layout(spark, d):
    ends = _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.round(F.log2(1 + F.count("*")) * 16, 6).alias("y"))


_VERSIONS = "(SELECT user_id, event_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"
_AT = "2024-01-10 06:00:00"


def _versions(spark, d):
    return V.versions(T(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "value", "valid_from", "valid_to")


@query("node_as_of", f"SELECT * FROM {_VERSIONS} WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR TIMESTAMP '{_AT}' < valid_to)")
def node_as_of(spark, d):
    return V.as_of(_versions(spark, d), F.lit(_AT).cast("timestamp_ntz"))


@query("book_as_of", f"SELECT * FROM {_VERSIONS} WHERE valid_from <= TIMESTAMP '{_AT}' - INTERVAL 1 MICROSECOND AND (valid_to IS NULL OR TIMESTAMP '{_AT}' - INTERVAL 1 MICROSECOND < valid_to)")
def book_as_of(spark, d):
    """Books are read a microsecond before the instant, single nodes at it."""
    return V.as_of(_versions(spark, d), F.lit(_AT).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND"))


@query("node_history", f"SELECT event_id, valid_from, valid_to, valid_to IS NULL AS is_current FROM {_VERSIONS} WHERE user_id = 8")
def node_history(spark, d):
    return _versions(spark, d).where("user_id = 8").select("event_id", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))


@query("recent_changes", "SELECT event_id, ts, left(props, 200) AS excerpt FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_changes(spark, d):
    return T(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", F.left("props", F.lit(200)).alias("excerpt"))


@query("snapshot_rollup", """
SELECT * FROM (SELECT ts AS "at", count(*) AS n, 'exact' AS grain FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ts UNION ALL SELECT max(ts), count(*), 'hour' FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY date_trunc('hour', ts)) ORDER BY "at" DESC LIMIT 2000""")
def snapshot_rollup(spark, d):
    e, at = T(spark, d, "events"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    exact = e.where(F.col("ts") >= at).groupBy(F.col("ts").alias("at")).agg(F.count("*").alias("n")).withColumn("grain", F.lit("exact"))
    older = e.where(F.col("ts") < at).groupBy(F.date_trunc("hour", "ts")).agg(F.max("ts").alias("at"), F.count("*").alias("n")).select("at", "n", F.lit("hour").alias("grain"))
    return exact.unionByName(older).orderBy(F.desc("at")).limit(2000)


@query("ttl_expiry", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 10 DAY AND event_type <> 'error'")
def ttl_expiry(spark, d):
    return T(spark, d, "events").where((F.col("ts") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz") - F.expr("INTERVAL 10 DAY")) & (F.col("event_type") != "error")).select("event_id")


@query("last_write_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_min(props, event_id) AS original, count(*) AS writes FROM events GROUP BY 1, 2")
def last_write_wins(spark, d):
    return T(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.min_by("props", "event_id").alias("original"), F.count("*").alias("writes"))


@query("stale_write_rejection", "SELECT event_id, ts <= coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ts - INTERVAL 1 SECOND) AS rejected FROM events")
def stale_write_rejection(spark, d):
    before = F.max("ts").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1))
    return T(spark, d, "events").select("event_id", (F.col("ts") <= F.coalesce(before, F.col("ts") - F.expr("INTERVAL 1 SECOND"))).alias("rejected"))


#: On these tables blocks are list items, headings, paragraphs, divisions and the footer; links, bold, breaks and comments lie within them.
@query("html_blocks", r"""
WITH b AS (SELECT page_id AS book, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', '<body>'), '(?s)<!--.*?-->', '', 'g'), '<br>', ' ', 'g'), '</?(a|b)( [^>]*)?>', '', 'g') AS body FROM pages),
p AS (SELECT book, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS ix FROM (SELECT book, regexp_extract_all(body, '<[^>]*>[^<]*') AS pieces FROM b)),
t AS (SELECT book, ix, CASE WHEN starts_with(piece, '<li>') THEN 'li' WHEN starts_with(piece, '<h1>') THEN 'h1' ELSE 'p' END AS type,
  trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(piece, '^<[^>]*>', ''), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS plain FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ix) AS line FROM t WHERE plain <> '')
SELECT book, line, (line - 1) // 50 AS chunk, book || '_n' || line AS node_id, type, plain FROM n""")
def html_blocks(spark, d):
    return convert.page_nodes(T(spark, d, "pages"))


@query("top_level_nodes")
def top_level_nodes(spark, d):
    return convert.top_nodes(T(spark, d, "pages"))


@query("reference_paragraphs", r"SELECT page_id, regexp_matches(html, '(1[5-9]|20)[0-9][0-9]') AND NOT regexp_matches(html, 'cookie') AS reference FROM pages")
def reference_paragraphs(spark, d):
    return T(spark, d, "pages").select("page_id", (F.col("html").rlike("(1[5-9]|20)[0-9][0-9]") & ~F.col("html").rlike("cookie")).alias("reference"))


@query("metadata_score_top1")
def metadata_score_top1(spark, d):
    """Record linkage: every work against the others whose author allows a score over 0, the best over 0.5 of each.

    Similarities are of distinct titles and of distinct authors, each pair of them once. They are joined to the distinct title, author and journal of works,
    each with its two least works in all and of each year, so that works alike in these are compared once, however many they are.
    """
    p = T(spark, d, "part")
    titles, authors, journals = (p.select(F.col(c).alias("x")).distinct() for c in ("p_name", "p_brand", "p_type"))
    pairs = lambda v: v.join(v.select(F.col("x").alias("y")), F.col("x").isNotNull() & F.col("y").isNotNull())  # noqa: E731  of distinct values
    title = pairs(titles).select(F.col("x").alias("t"), F.col("y").alias("t2"), L.pairwise(L.title_similarity, F.col("x"), F.col("y")).alias("title")).where(F.col("title") >= L.TITLE_FLOOR)
    author = pairs(authors).select(F.col("x").alias("a"), F.col("y").alias("a2"), L.author_score(F.array("x"), F.col("y")).alias("author")).where("author > 0")
    journal = pairs(journals).select(F.col("x").alias("j"), F.col("y").alias("j2"), L.pairwise(L.text_score, F.col("x"), F.col("y")).alias("journal"))
    kind = ["t", "a", "j"]
    works = p.select(F.col("p_partkey").alias("work"), F.col("p_name").alias("t"), F.col("p_brand").alias("a"), F.col("p_type").alias("j"), F.col("p_size").alias("y"))
    two = lambda *keys: R.first_per_key(works.select(*keys, "work").distinct().where("work IS NOT NULL"), keys, ["work"], 2).groupBy(*keys).agg(F.sort_array(F.collect_list("work")).alias("works"))  # noqa: E731  a work itself is none of its candidates
    by_kind, by_year = two(*kind), two(*kind, "y")
    score = lambda year: F.round(L.metadata_score(F.col("title"), F.col("author"), year, F.col("journal"), F.lit(0.0), F.lit(True), F.lit(True)), 6)
    kinds = by_kind.select(*kind, (F.size("works") > 1).alias("sure"))
    other = kinds.select(*(F.col(c).alias(f"{c}2") for c in kind), F.col("sure").alias("sure2"))
    met = kinds.join(author, "a").join(title, "t").join(other, ["a2", "t2"]).join(journal, ["j", "j2"])
    met = met.select(*kind, "t2", "a2", "j2", "sure2", score(F.lit(0.0)).alias("s0"), score(F.lit(0.5)).alias("s1"), score(F.lit(1.0)).alias("s2")).where("s2 >= 0.5")
    floor = F.max(F.when(F.col("sure2"), F.col("s0"))).over(W.partitionBy(*kind))  # what a work of these values finds in any case
    met = met.withColumn("floor", floor).where("floor IS NULL OR s2 >= floor")
    there = lambda df: df.select(*(F.col(c).alias(f"{c}2") for c in kind), "works", *[c for c in df.columns if c == "y"])
    gaps = F.explode(F.array(*[F.struct(F.lit(g).alias("gap"), F.col(s).alias("score")) for g, s in ((0, "s2"), (1, "s1"), (-1, "s1"))])).alias("g")
    asked = by_year.select(*kind, F.col("y").alias("asked"))
    near = asked.join(met.select(*kind, "t2", "a2", "j2", gaps), kind).withColumn("y", F.col("asked") + F.col("g.gap")).join(there(by_year), ["t2", "a2", "j2", "y"]).select(*kind, "asked", "works", "g.score")
    # Any year scores 0 here: a work of a nearer year is there with its higher score too.
    far = met.join(there(by_kind), ["t2", "a2", "j2"]).select(*kind, "works", F.col("s0").alias("score"))
    best = lambda df, *keys: R.first_per_key(df.where("score >= 0.5").select(*keys, "score", F.explode("works").alias("work")), keys, [F.desc("score"), "work"], 2).groupBy(*keys).agg(F.collect_list(F.struct((-F.col("score")).alias("less"), "work")).alias("found"))
    near, far = best(near, *kind, "asked"), best(far, *kind)
    cite = works.select(F.col("work").alias("cite"), *kind, F.col("y").alias("asked"))
    none = F.array().cast("array<struct<less: double, work: bigint>>")
    both = cite.join(near, [*kind, "asked"], "left").withColumnRenamed("found", "near").join(far, kind, "left")
    top = F.array_min(F.filter(F.concat(F.coalesce("near", none), F.coalesce("found", none)), lambda x: x["work"] != F.col("cite")))
    return both.groupBy("cite").agg(F.min(top).alias("top")).where("top IS NOT NULL").select("cite", "top.work", (-F.col("top.less")).alias("score"))


@query("align_blocks")
def align_blocks(spark, d):
    """Blocks of each conversation against an edited version of it."""
    c = T(spark, d, "conversations").select(F.col("conv_id"), F.col("turn").alias("pos"), "text")
    return L.monotone_alignment(c, c.where("pos <> 1").withColumn("text", F.concat("text", F.lit(" edited"))), "conv_id")


@query("headlines")
def headlines(spark, d):
    docs = T(spark, d, "documents").where(S.matches(R.string_tokens(F.coalesce("text", F.lit(""))), S.parse_query("license")))
    return docs.select("doc_id", S.headline(F.col("text"), ["license", "licensed"]).alias("headline"))


@query("weighted_search", """
WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part),
h AS (SELECT *, list_position(a, 'ring') AS r, list_position(a, 'widget') AS w, list_contains(b, 'ring')::INT + list_contains(b, 'widget')::INT AS n FROM t)
SELECT p_partkey, round((r IS NOT NULL)::INT / 2 + (w IS NOT NULL)::INT / 2 + 0.3::DOUBLE * n / 2, 6) AS rank, coalesce(round(2.0::DOUBLE / (abs(r - w) + 1), 6), 0.0::DOUBLE) AS density FROM h WHERE r IS NOT NULL OR w IS NOT NULL OR n > 0""")
def weighted_search(spark, d):
    words = ["ring", "widget"]
    p = T(spark, d, "part")
    return p.select("p_partkey", F.round(S.weighted_rank({"A": F.col("p_name"), "B": F.col("p_type")}, words), 6).alias("rank"), F.round(S.cover_density(R.string_tokens(F.col("p_name")), words), 6).alias("density")).where("rank > 0").orderBy(F.desc("rank"), "p_partkey")
