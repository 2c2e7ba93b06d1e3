"""Relational building blocks: keyed picks, upserts, priority merges, version pointers, visibility and gate predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.session import cut, shuffle_width


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order (planned as a partial and a final WindowGroupLimit)."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Deduplicate by key, the row of the highest sequence stays."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in sequence])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], invalidate: dict[str, str] | None = None) -> DataFrame:
    """Rows of source replace target's by key, others stay; source has one row per key.

    invalidate maps a derived column to the column it derives from: it becomes null where that changes, null-safely.
    """
    t, s = target.alias("t"), source.withColumn("_new", F.lit(True)).alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    invalidate = invalidate or {}
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        if c in invalidate:
            basis = invalidate[c]
            kept = F.when(F.col(f"t.{basis}").eqNullSafe(F.col(f"s.{basis}")), old)
            out.append(F.when(F.col("s._new"), kept).otherwise(old).alias(c))
        else:
            out.append((F.when(F.col("s._new"), F.col(f"s.{c}")).otherwise(old) if c in source.columns else old).alias(c))
    return both.select(*out)


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append source rows whose key is not there yet."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def heal(target: DataFrame, canonical: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill null or empty columns from the canonical row of the key."""
    c = canonical.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_c_{x}") for x in columns])
    joined = target.join(c, F.col(key) == F.col("_k"), "left")
    for x in columns:
        joined = joined.withColumn(x, F.coalesce(F.nullif(F.col(x), F.lit("")), F.col(f"_c_{x}")))
    return joined.select(*target.columns)


def priority_merge(branches: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Union of branches in falling priority; the first branch that has a key wins it."""
    tagged = [b.withColumn("priority", F.lit(i)) for i, b in enumerate(branches)]
    merged = tagged[0]
    for b in tagged[1:]:
        merged = merged.unionByName(b)
    return first_per_key(merged, [key], ["priority", *order])


def visible(visibility: Column, listed: Column, creator: Column, token: Column, user: str | None, user_token: str | None) -> Column:
    """Public and listed, or the user's own, or the anonymous user's own; null is not visible."""
    mine = F.lit(False) if user is None else F.coalesce(creator == user, F.lit(False))
    anonymous = F.lit(False) if user_token is None else F.coalesce(creator.isNull() & (token == user_token), F.lit(False))
    return F.coalesce((visibility == "public") & listed, F.lit(False)) | mine | anonymous


def gate(df: DataFrame, viewer: str, hide_ai: bool, hide_anonymous: bool, hide_unannotated: bool) -> DataFrame:
    """Annotation gate over creator, is_ai, note, pinned and co_author: each rule exempts own, pinned and co-authors' rows.

    The rule against rows without a note has no exemption for co-authors.
    """
    exempt = F.coalesce(F.col("creator") == viewer, F.lit(False)) | F.coalesce("pinned", F.lit(False))
    co = F.coalesce("co_author", F.lit(False))
    if hide_ai:
        df = df.where(~F.coalesce("is_ai", F.lit(False)) | exempt | co)
    if hide_anonymous:
        df = df.where(F.col("creator").isNotNull() | exempt | co)
    if hide_unannotated:
        df = df.where(F.coalesce("note", F.lit("")).rlike(r"\S") | exempt)
    return df


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or lies below it; every character of the root stands for itself."""
    return (path == root) | path.startswith(F.lit(root.rstrip("/") + "/"))


def rank_positions(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Dense positions 1..n in a total order over one ranking's rows.

    Rows are range-partitioned by the order and numbered within their range; a range's first number is the count of all rows before
    it, so no task holds more than its range and one row per range is ordered in one place.
    """
    parts = shuffle_width(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", inside).join(before, "_part").withColumn(name, F.col("_base") + F.col("_nth")).drop("_part", "_nth", "_base")


def string_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
