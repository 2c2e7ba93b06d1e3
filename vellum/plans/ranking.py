"""Ranks of the documents that hold words, and the stems of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import ranking
from vellum.plans.registry import query
from vellum.session import table as T

_WORDS = ["license", "the"]

_E = r"""
WITH f AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS d FROM documents),
e AS (SELECT doc_id, unnest(list_concat(a, d)) AS w, unnest(range(1, len(a) + len(d) + 1)) AS pos, len(a) AS n_a FROM f),
h AS (SELECT doc_id, w, pos, CASE WHEN pos <= n_a THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS weight, row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS j FROM e WHERE w IN ('license', 'the') QUALIFY j <= 255)"""


@query("any_rank", f"""{_E},
one AS (SELECT doc_id, w, max(weight) AS best, arg_min(j, (-weight, j)) AS place, sum(weight / (j * j)) AS rest FROM h GROUP BY 1, 2)
SELECT doc_id, round(sum((best + rest - best / (place * place)) / 1.64493406685::DOUBLE) / 2, 6) AS rank FROM one GROUP BY 1""")
def any_rank(spark, d):
    rank = F.round(ranking.any_rank({"A": F.col("source"), "D": F.col("text")}, _WORDS), 6)
    # As an array that holds it or nothing, a rank is made once, not once more for its filter.
    return T(spark, d, "documents").select("doc_id", F.explode(F.filter(F.array(rank), lambda r: r > 0)).alias("rank"))


@query("all_rank", f"""{_E}
SELECT x.doc_id, round(1 - product(1 - sqrt(x.weight * y.weight * CASE WHEN abs(x.pos - y.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2)) END)), 6) AS rank
FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.w = 'license' AND y.w = 'the' GROUP BY 1 HAVING rank > 0""")
def all_rank(spark, d):
    rank = F.round(ranking.all_rank({"A": F.col("source"), "D": F.col("text")}, _WORDS), 6)
    return T(spark, d, "documents").select("doc_id", rank.alias("rank")).where("rank > 0")


@query("cover_rank", r"""
WITH f AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS d FROM documents),
e AS (SELECT doc_id, unnest(d) AS w, unnest(range(1, len(d) + 1)) AS pos FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM e WHERE w IN ('license', 'the', 'and')),
l AS (SELECT *, max(pos) FILTER (WHERE w = 'license') OVER r AS a, max(pos) FILTER (WHERE w = 'the') OVER r AS b, max(pos) FILTER (WHERE w = 'and') OVER r AS c FROM h WINDOW r AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, least(a, b, c) AS first, min(pos) AS last, min(i) AS i_last FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2)
SELECT c.doc_id, round(sum(0.1::DOUBLE / (1 + (c.last - c.first) - (c.i_last - h.i))), 6) AS rank FROM c JOIN h ON h.doc_id = c.doc_id AND h.pos = c.first GROUP BY 1""")
def cover_rank(spark, d):
    rank = F.round(ranking.cover_rank(F.col("text"), [*_WORDS, "and"]), 6)
    return T(spark, d, "documents").select("doc_id", rank.alias("rank")).where("rank > 0")


@query("stemmed_terms")
def stemmed_terms(spark, d):
    return ranking.stemmed(T(spark, d, "documents"), "doc_id", F.col("text"))
