"""Claims, titles, quotations and short forms of citations as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import citations as C
from vellum.plans.registry import query
from vellum.session import table as T

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("claim_spans", rf"""
WITH t AS (SELECT conv_id, turn, text, length(text) // 2 AS mid, [length(text) // 3, length(text) * 2 // 5, length(text) * 3 // 4] AS marks FROM conversations WHERE text IS NOT NULL),
b AS (SELECT *, length(regexp_extract(left(text, mid), '(?s)^.*[.!?]\s+')) AS lo, length(regexp_extract(substr(text, mid + 1), '(?s)^.*?[.!?](?:\s|\z)')) AS stop FROM t)
SELECT conv_id, turn, {_TRIM.format("substr(text, lo + 1, CASE WHEN stop > 0 THEN mid + stop ELSE length(text) END - lo)")} AS sentence,
  {_TRIM.format("substr(text, greatest(lo, list_max(list_filter(marks, lambda m: m < mid))) + 1, mid - greatest(lo, list_max(list_filter(marks, lambda m: m < mid))))")} AS clause FROM b""")
def claim_spans(spark, d):
    """The sentence around the middle of each turn, and the clause before it that starts after the last marker."""
    n = F.length("text")
    share = lambda a, b: F.floor(n * a / b).cast("int")
    rows = T(spark, d, "conversations").where("text IS NOT NULL").withColumns({"at": share(1, 2), "marks": F.array(share(1, 3), share(2, 5), share(3, 4))})
    at = F.col("at")
    return rows.select("conv_id", "turn", C.claim_sentence(F.col("text"), at).alias("sentence"), C.claim_clause(F.col("text"), at, F.col("marks")).alias("clause"))


@query("citation_titles", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'On ' || p_name || ' and ' || p_brand WHEN 1 THEN p_name || ', a life'
  WHEN 2 THEN 'An essay on ' || p_name WHEN 3 THEN 'The history of ' || p_name ELSE 'Notes on ' || p_name || ' and others' END AS title FROM part""")
def citation_titles(spark, d):
    """Titles out of citations written in five ways: quoted, in italics, before italics, after the year, and with no year at all."""
    name, brand, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("Hart, A. 1994. “On "), name, F.lit(" and "), brand, F.lit(".” <i>Mind</i> 3")))
        .when(k == 1, F.concat(F.lit("Hart, A. <em>"), name, F.lit(", a life</em>. 1994.")))
        .when(k == 2, F.concat(F.lit("Hart, A. (1994). An essay on "), name, F.lit(", <i>Journal of Parts</i>, 7.")))
        .when(k == 3, F.concat(F.lit("Hart, A. (1994) The history of "), name, F.lit(". London: Press.")))
        .otherwise(F.concat(F.lit("Hart, A. Notes on "), name, F.lit(" and others. London: Press.")))
    )
    return T(spark, d, "part").select("p_partkey", C.citation_title(raw).alias("title"))


@query("detected_quotes", r"""
WITH t AS (SELECT *, regexp_replace(coalesce(text, ''), '[''"‘’“”.!?\s]+', ' ', 'g') AS said FROM conversations)
SELECT conv_id AS book, turn AS pos, length(said) + 11 AS mark, 'inline' AS kind, turn AS quote_pos, trim(said) AS quote FROM t WHERE turn % 2 = 0 AND length(said) BETWEEN 22 AND 290""")
def detected_quotes(spark, d):
    """Turns put into quotation marks with a citation after them: each marker owns what it follows."""
    said = F.regexp_replace(F.coalesce("text", F.lit("")), "['\"‘’“”.!?\\s]+", " ")
    text = F.concat(F.lit("They say "), F.lit("“"), said, F.lit("” (A 2020) and go on"))
    rows = T(spark, d, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), text.alias("text"), F.array(F.length(said) + 11).alias("marks"), F.lit(False).alias("block"), F.length(said).alias("n"))
    return C.detect_quotes(rows.where("n BETWEEN 22 AND 290"), "book", "pos", "text", "marks", "block").drop("candidates").withColumn("mark", F.col("mark").cast("long"))


@query("located_quotes")
def located_quotes(spark, d):
    """A quote of each conversation, found again in its turns: as it was, with straight quotes and single spaces, across two turns, or with a word changed."""
    turns = T(spark, d, "conversations").where("text <> ''")
    by = turns.groupBy(F.col("conv_id").alias("quote_id"), "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"].alias("ts"))
    one, two = F.element_at("ts", 1), F.try_element_at("ts", F.lit(2))
    tail = F.right(one, F.lit(60))
    k = F.col("conv_id") % 4
    quote = (
        F.when(k == 0, F.substring(one, 11, 80))
        .when(k == 1, F.regexp_replace(F.substring(one, 5, 90), r"\s+", "  "))
        .when(k == 2, F.concat(tail, F.lit(" "), F.coalesce(F.left(two, F.lit(50)), F.lit(""))))
        .otherwise(F.overlay(F.substring(one, 1, 120), F.lit("changed"), F.lit(40), F.lit(7)))
    )
    quotes = by.select("quote_id", "conv_id", quote.alias("quote"))
    return C.locate_in_books(quotes, turns, "quote_id", "conv_id", "turn", "text")


_NOTES = """SELECT o_custkey AS doc, l_orderkey * 10 + l_linenumber AS n,
 CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'full' WHEN 2 THEN 'short' WHEN 3 THEN 'ibid' ELSE 'note' END AS kind,
 CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'S' || l_suppkey % 3 END AS surname, 'Title ' || l_partkey % 4 || ' of parts' AS title, 'Title ' || l_partkey % 4 AS short_title FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey"""


@query("short_form_antecedents", f"""
WITH notes AS ({_NOTES}), f AS (SELECT doc, n, surname, title FROM notes WHERE kind = 'full'),
linked AS (SELECT s.doc, s.n, max(f.n) AS meant FROM notes s JOIN f ON f.doc = s.doc AND f.n < s.n AND (s.surname = '' OR s.surname = f.surname) AND contains(f.title, s.short_title) WHERE s.kind = 'short' GROUP BY 1, 2 HAVING count(DISTINCT f.title) = 1),
told AS (SELECT notes.doc, notes.n, kind, CASE WHEN kind = 'full' THEN notes.n WHEN kind = 'short' THEN coalesce(meant, -1) END AS state, meant FROM notes LEFT JOIN linked USING (doc, n)),
every AS (SELECT doc, n, CASE WHEN kind = 'ibid' THEN last_value(state IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE meant END AS antecedent FROM told)
SELECT doc, n, antecedent FROM every WHERE antecedent >= 0""")
def short_form_antecedents(spark, d):
    lines = T(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    rows = T(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 5
    short = F.concat(F.lit("Title "), (F.col("l_partkey") % 4).cast("string"))
    surname = F.when(F.col("l_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")))
    kind = F.when(k < 2, "full").when(k == 2, "short").when(k == 3, "ibid").otherwise("note")
    notes = rows.select(F.col("o_custkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), kind.alias("kind"), surname.alias("surname"), F.concat(short, F.lit(" of parts")).alias("title"), short.alias("short_title"))
    return C.antecedents(notes, "doc", "n", "n").select("doc", "n", "antecedent")
