"""Structured Streaming: keyed coalescing of changes, upserts by micro-batch, and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vellum.operators.commits import Commits
from vellum.operators.relational import upsert


def coalesce_changes(df: DataFrame, keys: Sequence[str], seq: str, value: str, original: str) -> DataFrame:
    """Last write wins by key, while the first original is kept; works on batches and on micro-batches alike."""
    return df.groupBy(*keys).agg(F.max_by(value, seq).alias(value), F.min_by(original, seq).alias(original), F.max(seq).alias(seq))


def read_changes(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_stream(changes: DataFrame, keys: Sequence[str], seq: str, value: str, original: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Coalesce each micro-batch and upsert it into versions of a table, table_path/v=<batch>; a replayed batch rewrites its own version.

    A write older than the row it meets is rejected, the only late data there is.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = coalesce_changes(batch, keys, seq, value, original)
        if number:
            old = batch.sparkSession.read.parquet(f"{table_path}/v={number - 1}")
            base = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(seq).alias("_seq"), F.col(original).alias("_original"))
            on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            new = new.join(base, on, "left").where(F.col("_seq").isNull() | (F.col(seq) > F.col("_seq")))
            new = new.withColumn(original, F.coalesce("_original", original)).select(*old.columns)
            new = upsert(old, new, keys)
        new.write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling event-time windows; on a stream a watermark bounds the state."""
    stamped = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: sessions by a gap, standing in for a debounced flush."""
    stamped = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    return stamped.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def _bucket(book: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(book), F.lit(buckets)).cast("int")


def create_store(spark: SparkSession, path: str, tables: dict[str, DataFrame], book: str, buckets: int = 64) -> None:
    """Tables of many books under one series of commits, each in folders by a hash of the book; a sync writes the folders of its books alone."""
    log = Commits(spark, path)
    if log.last() is not None:
        raise ValueError(f"{path} is a store already")
    state: dict = {"batch": -1, "buckets": buckets, "rejected": [], "tables": {}}
    for name, df in tables.items():
        state["tables"][name] = {"schema": df.schema.json(), "folders": log.folders(_stored(log, df, book, buckets))}
    log.commit(state)


def _stored(log: Commits, df: DataFrame, book: str, buckets: int) -> str:
    # Rebalanced, not dealt by the bucket alone: a book that holds a third of all rows is written by several tasks.
    return log.write(df.withColumn("_bucket", _bucket(F.col(book), buckets)).hint("rebalance", "_bucket"), "_bucket")


def committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a store as of its last commit; a sync that didn't finish isn't seen."""
    log = Commits(spark, path)
    held = log.last()["tables"][table]
    return log.read(sorted(held["folders"].values()), StructType.fromJson(json.loads(held["schema"])))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(batch, reason, kind, book, base, deleted, row): the changes that no sync of a store could take."""
    log = Commits(spark, path)
    return log.read(log.last()["rejected"], REJECTED)


REJECTED = "batch long, reason string, kind string, book string, base string, deleted boolean, row string"


def _judged(tables: dict[str, DataFrame], changes: DataFrame, keys: dict[str, Sequence[str]], book: str, stamp: str, root: str) -> DataFrame:
    """changes with reason: null for those that are taken, else stale, kind, key (no JSON, or a key is missing) or book (the row is another's)."""
    current = tables[root].select(F.col(book).alias("_book"), F.col(stamp).alias("_stamp"))
    stale = changes.join(current, F.col(book) == F.col("_book")).where(F.col("base").isNull() | (F.col("_stamp") > F.col("base"))).select(F.col(book).alias("_stale")).distinct()
    marked = changes.join(stale, F.col(book) == F.col("_stale"), "left")
    reason = F.when(F.col("_stale").isNotNull(), "stale").when(~F.coalesce(F.col("kind").isin(*keys), F.lit(False)), "kind")
    for name, key in keys.items():
        new = F.from_json("row", tables[name].schema)
        mine = F.col("kind") == name
        whole = new[key[0]].isNotNull()
        for k in key[1:]:
            whole = whole & new[k].isNotNull()
        reason = reason.when(mine & ~F.coalesce(whole, F.lit(False)), "key").when(mine & ~new[book].eqNullSafe(F.col(book)), "book")
    return marked.withColumn("reason", reason).drop("_stale")


def sync_tables(tables: dict[str, DataFrame], changes: DataFrame, keys: dict[str, Sequence[str]], book: str, stamp: str, root: str) -> dict[str, DataFrame]:
    """The tables after one sync of many books, in the order of keys. tables: by name, each with book, its keys and any other columns.

    changes: kind (the table), book, base (the stamp its writer last saw; null: never), deleted (null: not), and row, a JSON object of the
    table's columns. A book whose row in the root table is newer than its base is rejected as a whole, so its tables stay
    together; rows of books the root table lacks are taken. Of changes with one key the last base wins, then a deletion, then the row.
    Changes of no known kind, whose row is no JSON or lacks a key, or is of another book than the change, are not taken (_judged() tells them).
    """
    fresh = _judged(tables, changes, keys, book, stamp, root).where("reason IS NULL")
    out = {}
    for name, key in keys.items():
        old = tables[name]
        parsed = fresh.where(F.col("kind") == name).select("base", F.coalesce("deleted", F.lit(False)).alias("deleted"), "row", F.from_json("row", old.schema).alias("_new"))
        last = parsed.groupBy(*[F.col(f"_new.{k}").alias(f"_{k}") for k in key]).agg(F.max(F.struct("base", "deleted", "row", "_new")).alias("_last"))
        kept = old.join(last.select(*[F.col(f"_{k}").alias(k) for k in key]), list(key), "left_anti").select(old.columns)
        out[name] = kept.unionByName(last.where("NOT _last.deleted").select("_last._new.*"))
    return out


def sync_store(changes: DataFrame, path: str, keys: dict[str, Sequence[str]], book: str, stamp: str, root: str, batch: int = 0) -> None:
    """One sync of a store: the folders of the books that changes names are written anew, and one commit names them for all tables.

    A batch that a commit has is not applied again. Folders of before stay for readers of earlier commits.
    """
    spark = changes.sparkSession
    log = Commits(spark, path)
    state = log.last()
    if state["batch"] >= batch:
        return
    buckets = state["buckets"]
    touched = sorted(str(r[0]) for r in changes.select(_bucket(F.col(book), buckets)).distinct().collect())  # as many as there are folders at most
    schemas = {name: StructType.fromJson(json.loads(t["schema"])) for name, t in state["tables"].items()}
    old = {name: log.read([t["folders"][b] for b in touched if b in t["folders"]], schemas[name]) for name, t in state["tables"].items()}
    new = sync_tables(old, changes, keys, book, stamp, root)
    lost = _judged(old, changes, keys, book, stamp, root).where("reason IS NOT NULL")
    tables = {}
    for name, t in state["tables"].items():
        folders = {b: f for b, f in t["folders"].items() if b not in touched}
        if touched and name in new:
            folders |= log.folders(_stored(log, new[name], book, buckets))
        tables[name] = t | {"folders": folders if name in new else t["folders"]}
    left = log.write(lost.select(F.lit(batch).cast("long").alias("batch"), "reason", "kind", F.col(book).cast("string").alias("book"), F.col("base").cast("string").alias("base"), "deleted", "row"))
    log.commit(state | {"batch": batch, "tables": tables, "rejected": [*state["rejected"], left]})


def sync_stream(changes: DataFrame, path: str, keys: dict[str, Sequence[str]], book: str, stamp: str, root: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sync a store with each micro-batch; a replayed batch is one that a commit has. trigger: all that is there, and end, by default."""
    return changes.writeStream.foreachBatch(lambda batch, number: sync_store(batch, path, keys, book, stamp, root, number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
