"""Stateful streams against loops and their batch forms, under replays, late and equal stamps."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import temporal
from vellum.streaming import stateful

START = datetime.datetime(2024, 1, 1)
US = datetime.timedelta(microseconds=1)
SCHEMA = "book string, seq long, ts timestamp_ntz, value string, deleted boolean, batch int"


def changes():
    rng = random.Random(8)
    rows = []
    for seq in range(240):
        # Equal stamps, stamps that go back, and values that don't change.
        ts = START + datetime.timedelta(microseconds=rng.choice([0, 0, 1, 2, 5, 40, 41]))
        rows.append((rng.choice(["a", "b", "c", None]), seq, ts, rng.choice(["x", "y", "z", None]), rng.choice([False, None, False, True]), seq // 60))
    return rows


def one_by_one(rows):
    open_, out = {}, []
    for book, _, ts, value, deleted, _ in rows:
        if book is None:
            continue
        if book in open_:
            was, since = open_[book]
            if not deleted and was == value:
                continue
            now = max(ts, since + US)
            out.append((book, was, since, now))
            del open_[book]
        elif deleted:
            continue
        else:
            now = ts
        if not deleted:
            open_[book] = (value, now)
    return sorted([*out, *((b, v, since, None) for b, (v, since) in open_.items())], key=str)


@pytest.fixture(scope="module")
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_captured_versions_equal_a_loop(spark):
    rows = changes()
    got = temporal.captured(spark.createDataFrame(rows, SCHEMA).where("book IS NOT NULL").repartition(4), "book", ["batch", "seq"], "ts", "value", "deleted")
    assert sorted((tuple(r) for r in got.collect()), key=str) == one_by_one(rows)


def test_a_stream_captures_what_a_batch_does(rocks, tmp_path):
    rows = changes()
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for b in range(4):
        rocks.createDataFrame([r for r in rows if r[5] == b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Each batch is a run of its own, so the state is read back from the checkpoint.
        stream = rocks.readStream.schema(SCHEMA).parquet(source)
        run(stateful.capture_stream(stream, "book", "seq", "ts", "value", "deleted"), out, checkpoint)
    feed = rocks.read.parquet(out)
    got = stateful.versions_of(feed.unionByName(feed.limit(20)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == one_by_one(rows)


def test_writes_are_checked_against_the_last_accepted(rocks, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, k - 3, k - 1, k]), rng.choice([k, k + 1, None]), k // 30) for k in range(90)]
    schema = "book string, seq long, base long, stamp long, batch int"
    last, want = {}, set()
    for book, seq, base, stamp, _ in rows:
        if book is None:
            continue
        ok = book not in last or (base is not None and base >= last[book])
        if ok and stamp is not None:
            last[book] = max(last.get(book, stamp), stamp)
        want.add((book, seq, ok))
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for b in range(3):
        rocks.createDataFrame([r for r in rows if r[4] == b], schema).coalesce(1).write.mode("append").parquet(source)
        run(stateful.check_stream(rocks.readStream.schema(schema).parquet(source), "book", "seq", "base", "stamp"), out, checkpoint)
    assert {tuple(r) for r in rocks.read.parquet(out).collect()} == want
    assert {ok for *_, ok in want} == {True, False}


def test_debounced_changes(spark, tmp_path):
    at = lambda s: START + datetime.timedelta(seconds=s)
    rows = [("a", at(0), "v1", "o1"), ("a", at(2), "v2", "o2"), ("a", at(4.5), "v3", "o3"), ("a", at(7.6), "v4", "o4"), ("b", at(1), None, "p"), ("b", at(1), "q", None)]
    df = spark.createDataFrame(rows, "book string, ts timestamp_ntz, value string, original string")
    want = {("a", at(0), "v3", "o1", 3), ("a", at(7.6), "v4", "o4", 1), ("b", at(1), "q", None, 2)}
    assert {tuple(r) for r in stateful.debounced(df, "book", "ts", "value", "original").collect()} == want
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    df.coalesce(1).write.parquet(source)
    run(stateful.debounced(spark.readStream.schema(df.schema).parquet(source), "book", "ts", "value", "original", late="1 second"), out, checkpoint)
    spark.createDataFrame([("z", at(60), "end", "end")], df.schema).coalesce(1).write.mode("append").parquet(source)
    run(stateful.debounced(spark.readStream.schema(df.schema).parquet(source), "book", "ts", "value", "original", late="1 second"), out, checkpoint)
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want
    assert stateful.debounced(df.where(F.lit(False)), "book", "ts", "value", "original").count() == 0
