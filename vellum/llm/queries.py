"""The operators of this subpackage as queries over the synthetic tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vellum.llm import bagminhash, bpe, chat, filteraudit, fim, htmltext, linededup, lz, media, reshard, tokencount, toxicity, wfq
from vellum.session import table


def op1_bagminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(table(spark, sf_dir, "documents")))


def op3_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard.resharded(table(spark, sf_dir, "documents"), reshard.scratch(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_chats(turns.unionByName(chat.probe(spark)), digests=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), digests=True)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op10_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = wfq.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("row.page_id", "row.url", "text", "n_chars")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bagminhash_neardup, op2_media_columns, op3_lz_fingerprints, op4_flow_resharding, op5_weak_toxicity,
        op6_chat_formatting, op7_byte_bpe, op8_line_dedup, op9_token_counts, op10_weighted_fair_mix,
        op11_filter_audit, op12_html_text, op13_fill_in_middle,
    )
}

LINE_SQL = r"""
WITH lines AS (
  SELECT rowid_, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM {docs})
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS last
  FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3
), marked AS (
  SELECT k.*, c.key IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> c.last AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
"""

WFQ_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS shuffled, md5(coalesce(text, '')) AS text_md5
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS weight
  FROM docs GROUP BY source
), rising AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(level, cap / weight) AS water FROM rising WHERE cap >= level * weight
), targets AS (
  SELECT source, source_size, round(least(cap, coalesce(water, 0.0) * weight), 6) AS target FROM rising, water
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, text_md5 ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, CAST(round(target) AS BIGINT) - start))
          + greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size))
          + greatest(0, least(size, CAST(round(target) AS BIGINT) - start - 2 * source_size)) AS BIGINT) AS taken
FROM placed
"""

AUDIT_SQL = r"""
WITH RECURSIVE orders(o) AS (
  SELECT '' UNION ALL SELECT o || k FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k) WHERE NOT contains(o, k)
), steps AS (
  SELECT o, step, substr(o, step, 1) AS filter, substr(o, 1, step - 1) AS earlier
  FROM (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders WHERE length(o) = 5)
), words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN words.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN marks ON marks.doc_id = words.doc_id
), kinds AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), met AS (
  SELECT part, o, step, n, good, toxic, contains(fails, filter) AS hit, fails <> '' AND translate(fails, earlier, '') <> fails AS gone, fails = filter AS alone
  FROM kinds, steps
), made AS (
  SELECT part, o AS filter_order, step, substr(o, step, 1) AS filter, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n * good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n * toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM made
"""

#: On these tables every article is one element of that name, and its blocks are paragraphs, headings and line breaks.
PAGES_SQL = r"""
WITH inner_ AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|br|h1)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM inner_
), plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM bare
), made AS (
  SELECT page_id, url, coalesce(trim(regexp_replace(t, '\s+', ' ', 'g')), '') AS text FROM plain
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM made
"""

FIM_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents
), drawn AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, [CAST('0x' || substr(digest, 8 * k + 1, 8) AS BIGINT) FOR k IN range(0, 4)] AS h FROM hashed
), cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

SQL: dict[str, str] = {
    "op8_line_dedup": LINE_SQL.format(docs="documents")
    + r"""
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rowid_
""",
    "op10_weighted_fair_mix": WFQ_SQL,
    "op11_filter_audit": AUDIT_SQL,
    "op12_html_text": PAGES_SQL,
    "op13_fill_in_middle": FIM_SQL,
}
