"""Layers of a citation network and its layout in space as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import graph
from vellum.plans.registry import query
from vellum.session import table as T

_LAYERS = r"""
WITH library AS (SELECT 'b' || o_orderkey AS book, CASE WHEN o_orderkey % 3 = 0 THEN 'w' || o_custkey ELSE 'b' || o_orderkey END AS node FROM orders),
bib AS (SELECT 'b' || l_orderkey AS root, CASE WHEN l_partkey % 4 = 0 THEN 'w' || l_partkey END AS canonical, CASE WHEN l_partkey % 5 < 2 THEN 'b' || l_partkey END AS foundation, l_returnflag = 'R' AS verified FROM lineitem),
cited AS (SELECT s.node AS source, coalesce(canonical, f.node) AS target, CASE WHEN verified THEN 'citation_verified' ELSE 'citation_auto' END AS kind FROM bib LEFT JOIN library s ON s.book = root LEFT JOIN library f ON f.book = foundation),
noted AS (SELECT s.node AS source, f.node AS target, 'citation_auto' AS kind FROM lineitem JOIN library s ON s.book = 'b' || l_orderkey JOIN library f ON f.book = 'b' || l_suppkey WHERE l_suppkey % 2 = 0),
hyper AS (SELECT s.node AS source, t.node AS target, 'hypercite' AS kind FROM (SELECT 'b' || o_orderkey AS root, unnest(['b' || o_custkey, 'b' || (o_orderkey + 1)]) AS goal FROM orders) JOIN library s ON s.book = root JOIN library t ON t.book = goal),
edges AS (SELECT DISTINCT * FROM (SELECT * FROM cited UNION ALL SELECT * FROM noted UNION ALL SELECT * FROM hyper) WHERE source IS NOT NULL AND target IS NOT NULL AND source <> target)"""


def _layers(spark, d):
    o, li = T(spark, d, "orders"), T(spark, d, "lineitem")
    b = lambda c: F.concat(F.lit("b"), c.cast("string"))
    w = lambda c: F.concat(F.lit("w"), c.cast("string"))
    key, part = F.col("o_orderkey"), F.col("l_partkey")
    library = o.select(b(key).alias("book"), F.when(key % 3 == 0, w(F.col("o_custkey"))).otherwise("").alias("canonical_id"))
    within = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/Fn"), F.col("l_linenumber").cast("string"))).otherwise("")
    bibliography = li.select(F.concat(b(F.col("l_orderkey")), within).alias("book"), F.when(part % 4 == 0, w(part)).alias("canonical_id"), F.when(part % 5 < 2, b(part)).alias("foundation"), (F.col("l_returnflag") == "R").alias("verified"))
    footnotes = li.select(b(F.col("l_orderkey")).alias("book"), (F.col("l_suppkey") % 2 == 0).alias("is_citation"), b(F.col("l_suppkey")).alias("foundation"))
    hypercites = o.select(b(key).alias("book"), F.array(F.concat(F.lit("/"), b(F.col("o_custkey")), F.lit("/2#hypercite_x")), F.concat(F.lit("https://example.org/"), b(key + 1), F.lit("?q=1#y")), F.lit("")).alias("cited_in"))
    return graph.layers(bibliography, footnotes, hypercites, library)


@query("graph_layers", f"{_LAYERS} SELECT * FROM edges")
def graph_layers(spark, d):
    """Verified and found citations, footnotes' citations and hypercites between works."""
    return _layers(spark, d)


def _nodes(spark, d):
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("w"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("b"), key.cast("string")))
    return T(spark, d, "orders").groupBy(name.alias("node")).agg(F.when(F.min("o_orderkey") % 4 != 0, F.year(F.min("o_orderdate"))).alias("year"))


_NODES = "nodes AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'w' || o_custkey ELSE 'b' || o_orderkey END AS node, CASE WHEN min(o_orderkey) % 4 <> 0 THEN year(min(o_orderdate)) END AS year FROM orders GROUP BY 1)"


@query("graph_positions", f"""{_LAYERS}, {_NODES},
h AS (SELECT node, year, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(node, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (((a * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648) % 1000) / 1000.0::DOUBLE AS name FROM nodes),
span AS (SELECT min(year) AS low, max(year) AS high FROM nodes),
dated AS (SELECT node, (year - low) / (high - low)::DOUBLE * 160 - 80 AS x FROM nodes, span WHERE year IS NOT NULL),
ends AS (SELECT source AS node, target AS other FROM edges UNION ALL SELECT target, source FROM edges),
near AS (SELECT ends.node, count(*) AS degree, avg(dated.x) AS mean FROM ends LEFT JOIN dated ON dated.node = other GROUP BY 1)
SELECT h.node, round(coalesce(dated.x, mean + name * 4, name * 40), 6) AS x, round(log2(1 + coalesce(degree, 0)) * 16, 6) AS y, round(name * 45, 6) AS z FROM h LEFT JOIN dated USING (node) LEFT JOIN near USING (node)""")
def graph_positions(spark, d):
    """Where each work lies in space."""
    placed = graph.layout(_nodes(spark, d), _layers(spark, d).select("source", "target"))
    return placed.select("node", *[F.round(c, 6).alias(c) for c in "xyz"])


@query("year_axis", f"""
WITH {_NODES}, span AS (SELECT min(year) AS low, max(year) AS high, max(year) - min(year) AS span FROM nodes),
step AS (SELECT *, coalesce(list_filter([m * pow(10.0::DOUBLE, floor(log10(span / 8.0::DOUBLE))) FOR m IN [1, 2, 5, 10]], lambda s: span / s <= 8)[1], 10 * pow(10.0::DOUBLE, floor(log10(span / 8.0::DOUBLE)))) AS step FROM span WHERE high > low),
ticks AS (SELECT low, span, ceil(low / step) * step + step * unnest(range(0, CAST(floor((high - ceil(low / step) * step) / step) AS BIGINT) + 1)) AS year FROM step)
SELECT year, round((year - low) / span * 160 - 80, 6) AS x FROM ticks""")
def year_axis(spark, d):
    return graph.year_axis(_nodes(spark, d)).select("year", F.round("x", 6).alias("x"))
