"""Scanned pages as a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import ocr
from vellum.plans.registry import query
from vellum.session import table as T


@query("scanned_books", """
WITH p AS (SELECT o_custkey AS book, o_orderkey AS k, o_orderkey % 6 AS v, o_custkey % 2 = 1 AS bottom FROM orders),
q AS (SELECT *, lag(v) OVER w AS pv, count(*) FILTER (WHERE v IN (0, 3, 5)) OVER (w ROWS UNBOUNDED PRECEDING) AS g FROM p WINDOW w AS (PARTITION BY book ORDER BY k)),
r AS (
  SELECT *, CASE WHEN v NOT IN (1, 2) THEN 'new' WHEN NOT bottom AND pv IN (0, 3) THEN 'note' WHEN pv IN (2, 4) OR (bottom AND pv = 0) THEN 'join' ELSE 'new' END AS goes,
         CASE WHEN v IN (1, 2) THEN 'went on past order ' || k || ' and came to its end.' ELSE 'Order ' || k || ' begins a page of its own.' END AS first,
         'The tale' || CASE WHEN v IN (0, 3, 5) THEN '[^' || CASE WHEN bottom THEN g ELSE 1 END || ']' ELSE '' END || ' of order ' || k || CASE WHEN v IN (0, 2, 4) THEN ' runs over the turn of' ELSE ' ends.' END AS tale,
         CASE WHEN v = 5 THEN 'See ledger ' || k || '.' WHEN v IN (0, 3) THEN 'See the ledger of some major' END AS said
  FROM q),
s AS (SELECT *, lead(goes) OVER w AS after, lead(first) OVER w AS following, sum(CASE WHEN goes = 'new' THEN 2 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM r WINDOW w AS (PARTITION BY book ORDER BY k))
SELECT book, 'body' AS kind, CAST(upto - 1 AS BIGINT) AS n, k AS page, NULL AS number, first AS text FROM s WHERE goes = 'new'
UNION ALL SELECT book, 'body', CAST(upto AS BIGINT), k, NULL, tale || CASE WHEN after = 'join' THEN ' ' || following ELSE '' END FROM s
UNION ALL SELECT book, 'note', g, k, CAST(CASE WHEN bottom THEN g ELSE 1 END AS VARCHAR), said || CASE WHEN after = 'note' THEN ' ' || following ELSE '' END FROM s WHERE said IS NOT NULL""")
def scanned_books(spark, d):
    """A customer's orders as pages: some begin in mid sentence, some end in one, with notes at the foot or among the text."""
    k, v = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 6
    lit = F.lit
    first = F.when(v.isin(1, 2), F.concat(lit("went on past order "), k, lit(" and came to its end."))).otherwise(F.concat(lit("Order "), k, lit(" begins a page of its own.")))
    tale = F.concat(lit("The tale"), F.when(v.isin(0, 3, 5), "[^1]").otherwise(""), lit(" of order "), k, F.when(v.isin(0, 2, 4), " runs over the turn of").otherwise(" ends."))
    note = F.when(v == 5, F.concat(lit("\n\n[^1] See ledger "), k, lit("."))).when(v.isin(0, 3), "\n\n[^1] See the ledger of some major").otherwise("")
    style = F.when(F.col("o_custkey") % 2 == 1, "page_bottom").otherwise("unknown")
    pages = T(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.concat(first, lit("\n\n"), tale, note).alias("markdown"), lit(None).cast("string").alias("footer"), style.alias("style"))
    return ocr.assemble(pages)
