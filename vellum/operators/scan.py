"""Running values over long groups, without a task for each group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.session import cut, shuffle_width


def ranged(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df in ranges of group and order, with _part, the number of its range, and _edge: whether its group is the first or the last of its range.

    Only these groups may lie in other ranges too. What is made of each row before a scan is best made after this, as the ranges are found by a pass of their own.
    """
    parts = df.repartitionByRange(shuffle_width(df.sparkSession), group, *order).withColumn("_part", F.spark_partition_id())
    parts = cut(parts)
    ends = parts.groupBy("_part").agg(F.min(F.struct(group)).alias("_first"), F.max(F.struct(group)).alias("_last"))
    edge = F.struct(group) == F.col("_first"), F.struct(group) == F.col("_last")
    return parts.join(F.broadcast(ends), "_part").withColumn("_edge", edge[0] | edge[1]).drop("_first", "_last")


def carried(df: DataFrame, group: str, order: Sequence[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with what the rows before each one in its group hold: last, the latest value that isn't null, and sums, the total (0 before the first).

    A segmented scan: rows are range-partitioned by group and order, so that a long group lies over several tasks; each range is
    scanned by itself, and what it hands on to the next is one row for each group at its edges. order is total within a group; a null group is one group.
    df may come from ranged() by the same group and order, or from another scan of such rows; then the ranges stay and go on with the result.
    """
    last, sums = last or {}, sums or {}
    value = {**{f"_l{k}": c for k, c in last.items()}, **{f"_s{k}": c for k, c in sums.items()}}
    kept = "_part" in df.columns
    rows = (df if kept else ranged(df, group, order)).withColumns(value)
    at = F.struct(*order)
    ends = [F.max_by(f"_l{k}", F.when(F.col(f"_l{k}").isNotNull(), at)).alias(f"_l{k}") for k in last] + [F.sum(f"_s{k}").alias(f"_s{k}") for k in sums]
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    edges = rows.where("_edge").groupBy("_part", group).agg(*ends)
    handed = edges.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), *[F.last(f"_l{k}", ignorenulls=True).over(before).alias(f"_hl{k}") for k in last], *[F.sum(f"_s{k}").over(before).alias(f"_hs{k}") for k in sums])
    inside = W.partitionBy("_part", "_edge", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    scanned = rows.withColumns({**{f"_il{k}": F.last(f"_l{k}", ignorenulls=True).over(inside) for k in last}, **{f"_is{k}": F.sum(f"_s{k}").over(inside) for k in sums}})
    both = scanned.join(F.broadcast(handed), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")  # two rows a range
    made = {k: F.coalesce(f"_il{k}", f"_hl{k}") for k in last} | {k: F.coalesce(F.col(f"_is{k}"), F.lit(0)) + F.coalesce(F.col(f"_hs{k}"), F.lit(0)) for k in sums}
    helpers = [f"_{h}{k}" for k in last for h in ("l", "il", "hl")] + [f"_{h}{k}" for k in sums for h in ("s", "is", "hs")]
    return reduce(lambda d, kv: d.withColumn(*kv), made.items(), both).drop("_p", "_g", *helpers, *([] if kept else ["_part", "_edge"]))
