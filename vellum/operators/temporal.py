"""System-versioned rows as two timestamps, valid_from and valid_to (null is open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def versions(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each row is valid until the next of its key; later rows of one instant win, the rest of it is void."""
    w = W.partitionBy(key).orderBy(at, tie)
    return df.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w))


def as_of(df: DataFrame, t: Column) -> DataFrame:
    """Rows valid at t; the interval is closed below and open above."""
    return df.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def scd2(current: DataFrame, history: DataFrame, incoming: DataFrame, key: str, value: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(current, history) after incoming replaces current at an instant: changed and removed rows close, new ones open.

    A row opened at the same instant closes a microsecond later, so that no interval is empty.
    """
    c, n = current.alias("c"), incoming.alias("n")
    both = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = F.col(f"n.{key}").isNull() | ~F.col(f"c.{value}").eqNullSafe(F.col(f"n.{value}"))
    end = F.greatest(at, F.col("c.valid_from") + F.expr("INTERVAL 1 MICROSECOND"))
    closed = both.where(F.col(f"c.{key}").isNotNull() & changed).select(F.col(f"c.{key}"), F.col(f"c.{value}"), F.col("c.valid_from"), end.alias("valid_to"))
    kept = both.where(F.col(f"n.{key}").isNotNull()).select(F.col(f"n.{key}"), F.col(f"n.{value}"), F.when(F.col(f"c.{key}").isNull() | changed, at).otherwise(F.col("c.valid_from")).alias("valid_from"))
    return kept, history.unionByName(closed)


def restore(rows: DataFrame, t: Column, at: Column) -> DataFrame:
    """All versions after a restore at an instant: open ones close then, and those valid at t open again.

    Closed versions stay, so what was undone can be restored too; a table without rows stays empty.
    """
    closed = rows.withColumn("valid_to", F.coalesce("valid_to", at))
    back = as_of(rows, t).withColumns({"valid_from": at, "valid_to": F.lit(None).cast(dict(rows.dtypes)["valid_to"])})
    return closed.unionByName(back)


def captured(changes: DataFrame, key: str, order: list[str], stamp: str, value: str, deleted: str) -> DataFrame:
    """(key, value, valid_from, valid_to): the versions that changes to rows leave, each taken in order of arrival.

    A change that leaves a row as it is, and the deletion of a row that isn't there, leave nothing. A row changed at or before the instant at which its
    version opened closes a microsecond after that, so no version is empty and none overlaps; a row inserted after its deletion opens at its
    own stamp. A key's changes are numbered within each of its lives, and the bumps are a running maximum of stamp less number.
    """
    arrived = W.partitionBy(key).orderBy(*order)
    gone = F.coalesce(F.col(deleted), F.lit(False))
    state = F.when(~gone, F.struct(F.col(value).alias("value")))
    rows = changes.select(key, *order, F.unix_micros(F.col(stamp).cast("timestamp")).alias("_at"), state.alias("_state"))
    rows = rows.withColumn("_was", F.lag("_state").over(arrived)).where(~F.col("_state").eqNullSafe(F.col("_was")))
    upto = arrived.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_life", F.sum(F.col("_was").isNull().cast("int")).over(upto))
    life = W.partitionBy(key, "_life").orderBy(*order)
    rows = rows.withColumn("_nth", F.row_number().over(life))
    opened = F.col("_nth") + F.max(F.col("_at") - F.col("_nth")).over(life.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_from", opened).withColumn("_to", F.lead(opened).over(life))
    return rows.where("_state IS NOT NULL").select(key, F.col("_state.value").alias(value), F.timestamp_micros("_from").cast("timestamp_ntz").alias("valid_from"), F.timestamp_micros("_to").cast("timestamp_ntz").alias("valid_to"))
