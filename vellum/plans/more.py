"""Queries over streaming helpers and sources, batch side."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans.registry import query
from vellum.session import table as T
from vellum.sources import files
from vellum.streaming import sync


@query("stream_last_write_wins", "SELECT user_id, arg_max(value, event_id) AS value, arg_min(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_last_write_wins(spark, d):
    return sync.coalesce_changes(T(spark, d, "events"), ["user_id"], "event_id", "value", "props")


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return sync.windowed_counts(T(spark, d, "events"), "ts", "event_type")


@query("session_windows", """
SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_windows(spark, d):
    return sync.sessions(T(spark, d, "events"), "ts", "user_id")


@query("byte_shares", "SELECT count(*) AS rows, count(*) AS sampled, CAST(sum(strlen(text)) AS DOUBLE) AS text, CAST(sum(strlen(source)) AS DOUBLE) AS source FROM documents")
def byte_shares(spark, d):
    """The exact variant: the whole table as its own sample."""
    return files.sampled_shares(T(spark, d, "documents"), ["text", "source"], 1.0)


@query("either_key_last", "SELECT key, c_custkey FROM (SELECT key, c_custkey, row_number() OVER (PARTITION BY key ORDER BY c_custkey DESC) AS rn FROM (SELECT c_mktsegment AS key, c_custkey FROM customer UNION ALL SELECT 'N' || c_nationkey, c_custkey FROM customer)) WHERE rn = 1")
def either_key_last(spark, d):
    c = T(spark, d, "customer").withColumn("nation", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return files.keyed_by_either(c.select("c_custkey", "c_mktsegment", "nation"), ["c_mktsegment", "nation"], "c_custkey").select("key", "c_custkey")
