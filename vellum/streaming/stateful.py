"""Streams with state of their own for each key: versions captured as changes arrive, writes accepted against the last one, and debounced changes.

Versions have a batch form that gives the same rows, temporal.captured(); debounced() serves both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPENED = "key string, version long, value string, valid_from long, closed long"


class _Capture(StatefulProcessor):
    """The last version of a row: its number, its value, and the microsecond at which it opened, null where it is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "version long, value string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, value, at = self.open.get() if self.open.exists() else (0, None, None)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            gone = bool(row.deleted) if not pd.isna(row.deleted) else False
            new = None if pd.isna(row.value) else row.value
            if at is None and gone or at is not None and not gone and new == value:
                continue
            now = int(row.at) if at is None else max(int(row.at), at + 1)
            if at is not None:
                out.append((key[0], n, value, at, now))
            value, at = (None, None) if gone else (new, now)
            if at is not None:
                n += 1
                out.append((key[0], n, value, at, None))
        if n:
            self.open.update((n, value, at))
        frame = pd.DataFrame(out, columns=["key", "version", "value", "valid_from", "closed"])
        frame["closed"] = frame["closed"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def capture_stream(changes: DataFrame, key: str, seq: str, stamp: str, value: str, deleted: str) -> DataFrame:
    """A feed of (key, version, value, valid_from, closed): each version when it opens, closed null, and again when it closes.

    Changes are taken as they arrive, those of one micro-batch in order of seq. The state is one version a key; a replayed batch finds the state
    of before it. versions_of() makes versions of a feed. Needs the RocksDB state store.
    """
    rows = changes.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("at"), F.col(value).cast("string").alias("value"), F.col(deleted).alias("deleted"))
    return rows.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(_Capture(), OPENED, "Append", "None")


def versions_of(feed: DataFrame) -> DataFrame:
    """(key, value, valid_from, valid_to) of a feed of captured changes; an entry that is there twice counts once."""
    rows = feed.groupBy("key", "version").agg(F.max("value").alias("value"), F.max("valid_from").alias("valid_from"), F.max("closed").alias("closed"))
    return rows.select("key", "value", F.timestamp_micros("valid_from").cast("timestamp_ntz").alias("valid_from"), F.timestamp_micros("closed").cast("timestamp_ntz").alias("valid_to"))


class _Check(StatefulProcessor):
    """The stamp of a book's last accepted write."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stamp long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            ok = last is None or (not pd.isna(row.base) and int(row.base) >= last)
            if ok and not pd.isna(row.stamp):
                last = int(row.stamp) if last is None else max(last, int(row.stamp))
            out.append((key[0], int(row.seq), ok))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["book", "seq", "accepted"])

    def close(self) -> None:
        pass


def check_stream(writes: DataFrame, book: str, seq: str, base: str, stamp: str) -> DataFrame:
    """(book, seq, accepted): whether each write, as it arrives, knows of the book's last accepted one (its stamp is no newer than base).

    A book's first write is accepted, whatever its base. Writes of one micro-batch are taken in order of seq. The state is one number a book.
    """
    rows = writes.select(F.col(book).cast("string").alias("book"), F.col(seq).cast("long").alias("seq"), F.col(base).cast("long").alias("base"), F.col(stamp).cast("long").alias("stamp"))
    return rows.where("book IS NOT NULL").groupBy("book").transformWithStateInPandas(_Check(), "book string, seq long, accepted boolean", "Append", "None")


def debounced(changes: DataFrame, key: str, at: str, value: str, original: str, gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, began, value, original, n): changes of a key that come within gap after one another, as one: the last value and the first original.

    On a stream a row comes out once the watermark has passed its quiet time, so that nothing late can join it; on a batch at once.
    Of changes of one instant the greatest value is the last and the least original the first.
    """
    stamped = changes.withColumn("_at", F.col(at).cast("timestamp"))
    if changes.isStreaming:
        stamped = stamped.withWatermark("_at", late)
    last, first = F.max(F.struct("_at", F.col(value).alias("v"))), F.min(F.struct("_at", F.col(original).alias("o")))
    rows = stamped.groupBy(F.session_window("_at", gap).alias("w"), key).agg(last.alias("l"), first.alias("f"), F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").cast("timestamp_ntz").alias("began"), F.col("l.v").alias(value), F.col("f.o").alias(original), "n")
