"""Notes of documents: how they are numbered, defined, linked and audited. Blocks are made of the lines of a customer's orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import notes
from vellum.plans.registry import query
from vellum.session import spread, table as T, written

_TAG = "CASE WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN 'h2' WHEN l_linenumber > 3 AND l_suppkey % 11 = 0 THEN 'hr' ELSE 'p' END"
_TEXT = """CASE WHEN l_linenumber = 1 AND l_partkey % 4 = 0 THEN (CASE l_suppkey % 3 WHEN 0 THEN 'Notes' WHEN 1 THEN 'Further reading' ELSE 'Chapter' END) WHEN l_linenumber > 3 AND l_suppkey % 11 = 0 THEN ''
WHEN l_returnflag = 'R' THEN concat('[', l_linenumber, ']: Note ', l_partkey, '.') WHEN l_partkey % 5 = 0 THEN concat('Words ', l_partkey, '[^', l_linenumber, '] and more.') WHEN l_partkey % 5 = 1 THEN repeat('Body of it. ', 12) ELSE concat('Words ', l_partkey) END"""

_B = f"""
WITH raw AS (SELECT o_custkey AS doc, l_orderkey, l_linenumber, {_TAG} AS tag, trim({_TEXT}) AS body FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
placed AS (SELECT *, row_number() OVER r - 1 AS ix, count(*) OVER (PARTITION BY doc) AS total, CASE tag WHEN 'h2' THEN 'heading' WHEN 'hr' THEN 'rule' ELSE 'block' END AS kind FROM raw WINDOW r AS (PARTITION BY doc ORDER BY l_orderkey, l_linenumber, tag, body)),
seen AS (SELECT *, count(*) FILTER (WHERE kind = 'heading') OVER r AS segment, body LIKE '[%]: %' AS shaped, coalesce(last_value(CASE WHEN kind = 'heading' THEN body = 'Further reading' END IGNORE NULLS) OVER r, false) AS listed FROM placed WINDOW r AS (PARTITION BY doc ORDER BY ix ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, shaped AND NOT listed AS definition, contains(body, '[^') AS reference, CASE WHEN shaped THEN split_part(substr(body, 2), ']', 1) END AS number FROM seen)"""

_S = f"""{_B},
cut AS (SELECT *, count(*) FILTER (WHERE kind <> 'block') OVER (PARTITION BY doc ORDER BY ix) AS stretch FROM m),
noted AS (SELECT *, bool_or(definition) OVER (PARTITION BY doc, stretch) AS noted FROM cut),
opened AS (SELECT *, kind <> 'block' AND coalesce(lag(noted) OVER (PARTITION BY doc ORDER BY ix), false) AS opens FROM noted),
s AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY doc ORDER BY ix) AS section, count(*) FILTER (WHERE definition) OVER (PARTITION BY doc ORDER BY ix) AS k FROM opened),
parts AS (SELECT *, max(k) OVER (PARTITION BY doc) AS last_k, nullif(CASE WHEN definition THEN split_part(body, ']: ', 2) ELSE body END, '') AS part FROM s WHERE k > 0),
ended AS (SELECT *, coalesce(right(last_value(part IGNORE NULLS) OVER (PARTITION BY doc, k ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = '.', false) AS complete FROM parts),
stops AS (SELECT *, count(*) FILTER (WHERE NOT definition AND (kind <> 'block' OR (k < last_k AND complete AND length(body) > 120))) OVER (PARTITION BY doc, k ORDER BY ix) AS stopped FROM ended),
notes AS (SELECT doc, k, min(section) AS section, max(number) FILTER (WHERE definition) AS number, min(ix) AS ix, string_agg(part, '<br><br>' ORDER BY ix) AS content FROM stops WHERE stopped = 0 GROUP BY 1, 2),
defs AS (SELECT doc, section, number, ix, content FROM notes QUALIFY row_number() OVER (PARTITION BY doc, section, number ORDER BY ix DESC) = 1),
marks AS (SELECT doc, section, ix, 0 AS place, split_part(split_part(body, '[^', 2), ']', 1) AS number FROM s WHERE reference),
links AS (SELECT marks.*, defs.ix AS note_at, defs.content FROM marks LEFT JOIN defs USING (doc, section, number))"""


def _blocks(spark, d):
    lines = T(spark, d, "orders").join(T(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_custkey").alias("doc"), "l_orderkey", "l_linenumber", F.expr(_TAG).alias("tag"), F.expr(_TEXT).alias("text"))
    return notes.marked(spread(rows, T(spark, d, "lineitem").count(), "doc"), "doc", ["l_orderkey", "l_linenumber", "tag", "text"])


@query("note_strategies", f"""{_B},
heads AS (SELECT *, max(ix) FILTER (WHERE kind = 'heading') OVER (PARTITION BY doc, segment) AS head FROM m),
seg AS (SELECT doc, min(ix) FILTER (WHERE shaped) AS note, max(ix) FILTER (WHERE kind = 'rule' AND ix < head + 50) AS ruled FROM heads GROUP BY doc, segment),
st AS (SELECT doc, coalesce(bool_or(note < ruled), false) AS structured FROM seg GROUP BY 1),
dup AS (SELECT doc, count(*) FILTER (WHERE n > 1) AS duplicates FROM (SELECT doc, number, count(*) AS n FROM m WHERE definition GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT doc, count(*) AS blocks, count(*) FILTER (WHERE definition) AS definitions, count(*) FILTER (WHERE reference) AS refs, avg(ix) FILTER (WHERE definition) / any_value(total) AS def_ratio, avg(ix) FILTER (WHERE reference) / any_value(total) AS ref_ratio,
  bool_or(kind = 'heading' AND body = 'Notes') AS notes_heading, count(*) FILTER (WHERE kind = 'rule') AS rules, count(*) FILTER (WHERE kind = 'rule' AND ix < total * 0.8) >= 2 AS distributed FROM m GROUP BY 1),
g AS (SELECT *, coalesce(duplicates, 0) AS dups FROM c JOIN st USING (doc) LEFT JOIN dup USING (doc)),
b AS (SELECT *, coalesce(refs > 0 AND definitions > 10 AND dups = 0 AND def_ratio > 0.65 AND ref_ratio < def_ratio - 0.15, false) AS back_loaded FROM g)
SELECT doc, blocks, definitions, refs, dups AS duplicates, structured, notes_heading, round(def_ratio, 6) AS def_ratio,
  CASE WHEN definitions = 0 THEN 'no_footnotes' WHEN dups > 0 AND rules > 0 THEN 'sectioned' WHEN back_loaded THEN 'whole_document' WHEN structured THEN 'sectioned' WHEN def_ratio > 0.8 AND NOT notes_heading AND dups = 0 THEN 'whole_document' WHEN notes_heading THEN 'sectioned' ELSE 'whole_document' END AS strategy,
  CASE WHEN definitions = 0 THEN (CASE WHEN refs = 0 THEN 0.9 ELSE 0.4 END) WHEN dups > 0 AND distributed THEN 0.85 WHEN dups > 0 AND rules > 0 THEN 0.7 WHEN back_loaded THEN round(least(0.9, 0.6 + def_ratio - ref_ratio), 2) WHEN structured THEN 0.65
    WHEN def_ratio > 0.8 AND NOT notes_heading AND dups = 0 THEN round(least(0.85, 0.5 + (def_ratio - 0.8) * 2), 2) WHEN notes_heading THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence FROM b""")  # fmt: skip
def note_strategies(spark, d):
    chosen = notes.decide(notes.signals(_blocks(spark, d), "doc"), notes.STRATEGIES, "strategy")
    return chosen.select("doc", "blocks", "definitions", F.col("references").alias("refs"), "duplicates", "structured", "notes_heading", F.round("def_ratio", 6).alias("def_ratio"), "strategy", F.col("strategy_confidence").alias("confidence"))


def _linked(spark, d):
    blocks = written(notes.sectioned(_blocks(spark, d), "doc"), "note-blocks")  # once for definitions and markers
    defs = notes.definitions(spread(blocks, blocks.count(), "doc"), "doc")
    body = blocks.where(~F.col("definition") & (F.col("kind") == "block"))
    return defs, notes.markers(body.where("reference"), "doc")


@query("note_definitions", f'{_S} SELECT * RENAME (ix AS "at") FROM defs')
def note_definitions(spark, d):
    return _linked(spark, d)[0]


@query("note_links", f'{_S} SELECT * RENAME (ix AS "at") FROM links')
def note_links(spark, d):
    defs, marks = _linked(spark, d)
    return notes.link(defs, marks, "doc")


@query("note_link_stats", f"""{_S},
a AS (SELECT doc, count(*) AS markers, count(note_at) AS linked FROM links GROUP BY 1),
b AS (SELECT doc, count(*) AS definitions, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.doc = defs.doc AND links.note_at = defs.ix)) AS orphan_definitions FROM defs GROUP BY 1)
SELECT doc, coalesce(markers, 0) AS markers, coalesce(linked, 0) AS linked, coalesce(markers - linked, 0) AS orphan_markers, coalesce(definitions, 0) AS definitions, coalesce(orphan_definitions, 0) AS orphan_definitions FROM a FULL JOIN b USING (doc)""")
def note_link_stats(spark, d):
    defs, marks = _linked(spark, d)
    return notes.link_stats(notes.link(defs, marks, "doc"), defs, "doc")


@query("linkable_notes", f"""{_S},
n AS (SELECT doc, count(DISTINCT number) AS n, max(number::BIGINT) - min(number::BIGINT) + 1 AS span FROM defs GROUP BY 1)
SELECT doc, n < 2 OR (span = n AND NOT EXISTS (SELECT 1 FROM marks WHERE marks.doc = n.doc AND NOT EXISTS (SELECT 1 FROM defs WHERE defs.doc = marks.doc AND defs.number = marks.number))) AS linkable FROM n""")
def linkable_notes(spark, d):
    defs, marks = _linked(spark, d)
    return notes.linkable(defs, marks, "doc")


@query("link_fidelity", f"""{_S},
a AS (SELECT doc, count(*) AS markers FROM links GROUP BY 1), b AS (SELECT doc, count(*) AS definitions FROM defs GROUP BY 1)
SELECT doc, 'note markers are missing' AS finding, definitions FROM b LEFT JOIN a USING (doc) WHERE definitions >= 5 AND markers IS NULL""")
def link_fidelity(spark, d):
    defs, marks = _linked(spark, d)
    stats = notes.link_stats(notes.link(defs, marks, "doc"), defs, "doc")
    no = F.lit(0)
    stats = stats.withColumns({"citations": no, "citations_linked": no, "targets": no, "reading_list": F.lit(False), "suppressed": F.lit(False)})
    return notes.fitting(stats, notes.FIDELITY, "finding").select("doc", "finding", "definitions")


@query("note_styles", """
WITH p AS (SELECT o_custkey AS book, o_orderkey AS page, o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 AS header, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 END AS tr,
  list(DISTINCT l_linenumber + l_partkey % (1 + o_custkey % 40)) FILTER (WHERE l_returnflag = 'A' OR o_custkey % 2 = 0 AND l_returnflag = 'N') AS refs, list(DISTINCT l_linenumber + l_partkey % (1 + o_custkey % 40)) FILTER (WHERE l_returnflag = 'R' AND o_custkey % 5 > 1) AS defs,
  count(*) FILTER (WHERE l_discount > 0.08) AS grp, count(*) FILTER (WHERE l_discount < 0.03) AS singles FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS ix, list_min(refs) AS low FROM p),
r AS (SELECT *, low <= last_value(low IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reset, max(ix) FILTER (WHERE refs IS NOT NULL) OVER (PARTITION BY book) AS last_ref, tr - ix AS offs FROM q),
a AS (SELECT book, count(*) AS pages, count(refs) AS pr, count(defs) AS pd, count(*) FILTER (WHERE len(list_intersect(refs, defs)) > 0) AS pb, count(*) FILTER (WHERE reset) AS resets, count(*) FILTER (WHERE header) AS np, count(*) FILTER (WHERE defs IS NOT NULL AND ix > coalesce(last_ref, -1)) AS trail,
  coalesce(max(list_max(refs)), 0) AS max_ref, median(offs) AS mid, sum(grp) AS gr, sum(singles) AS si FROM r GROUP BY 1),
sp AS (SELECT book, max(n) AS max_spread, count(*) FILTER (WHERE n > 1) AS rep FROM (SELECT book, num, count(*) AS n FROM (SELECT book, unnest(refs) AS num FROM r) GROUP BY 1, 2) GROUP BY 1),
pn AS (SELECT r.book, CASE WHEN count(offs) > 0 THEN count(*) FILTER (WHERE offs = mid) / count(offs) ELSE 0 END AS pns FROM r JOIN a ON a.book = r.book GROUP BY 1),
f AS (SELECT a.*, coalesce(max_spread, 0) AS ms, coalesce(rep, 0) AS rn, pns, CASE WHEN pr > 0 THEN pb / pr ELSE 0 END AS co, CASE WHEN pd > 0 THEN pb / pd ELSE 0 END AS dc, pd / pages AS ds, CASE WHEN pr > 0 THEN resets / pr ELSE 0 END AS rf, CASE WHEN pd > 0 THEN trail / pd ELSE 0 END AS td, CASE WHEN gr + si > 0 THEN gr / (gr + si) ELSE 0 END AS ga FROM a JOIN pn USING (book) LEFT JOIN sp USING (book))
SELECT book, pages, resets, max_ref, ms AS max_spread, round(co, 6) AS co_location, round(td, 6) AS trailing_defs, round(pns, 6) AS page_number_share, round(ga, 6) AS group_ratio,
CASE WHEN pr = 0 THEN 'none'
  WHEN ms >= 3 AND co < 0.2 AND np = 0 AND (resets <= 3 OR max_ref > 50 OR ga >= 0.15) AND (rf < 0.2 OR max_ref > 50 OR ga >= 0.15 OR resets <= 2) THEN 'numbered_bibliography'
  WHEN (co > 0.4 AND pb >= 3 AND rf < 0.1 AND max_ref > 10) OR (co > 0.5 AND rf > 0.4) OR (pd >= 5 AND dc > 0.7 AND rf > 0.4 AND np = 0) OR (co > 0.4 AND pb >= 3 AND dc > 0.7 AND np = 0) THEN 'page_bottom'
  WHEN (np > 0 AND co < 0.3) OR (co < 0.3 AND pd > 0 AND rf > 0.3) OR (co < 0.15 AND pd > 5 AND resets >= 3) THEN 'chapter_endnotes'
  WHEN co < 0.15 AND (ds < 0.1 OR (pb = 0 AND pd IN (1, 2) AND pr >= 2) OR (pb = 0 AND pd >= 3 AND pr >= 3 AND td >= 0.9)) THEN 'document_endnotes' ELSE 'unknown' END AS style FROM f""")  # fmt: skip
def note_styles(spark, d):
    lines = T(spark, d, "orders").join(T(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    number = F.expr("l_linenumber + l_partkey % (1 + o_custkey % 40)")
    pages = lines.groupBy(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"), F.expr("o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0").alias("header")).agg(
        F.collect_set(F.when(F.expr("l_returnflag = 'A' OR o_custkey % 2 = 0 AND l_returnflag = 'N'"), number)).alias("refs"), F.collect_set(F.when(F.expr("l_returnflag = 'R' AND o_custkey % 5 > 1"), number)).alias("defs"),
        F.count_if(F.col("l_discount") > 0.08).alias("groups"), F.count_if(F.col("l_discount") < 0.03).alias("singles"),
    )
    found = notes.page_signals(pages, "book", "page", "refs", "defs", F.col("header"), F.expr("CASE WHEN page % 4 = 0 THEN page % 7 END"), F.col("groups"), F.col("singles"))
    six = lambda c: F.round(c, 6).alias(c)
    return notes.decide(found, notes.PAGE_STYLES, "style").select("book", "pages", "resets", "max_ref", "max_spread", six("co_location"), six("trailing_defs"), six("page_number_share"), six("group_ratio"), "style")
