"""Interaction audit of corpus filters by inclusion and exclusion.

Each row has a flag per filter, 1 where it fails. One aggregation sums the products of flags over every set of filters: the
joint-failure counts J[S], 32 for five filters, a row per part of the corpus. All else follows from these few numbers without
the rows: a Moebius sum over the subsets of the filters applied so far gives what an order of filters removes and keeps at a
step, what fails one filter alone, and the signed J[S] are the Harsanyi dividends of the game "rows that fail any filter of
the set", whose Shapley values are the filters' removals averaged over all orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LETTERS = "ABCDE"
_WORDS = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> dict[str, Column]:
    """Flags that follow from a text alone, 1 where it fails: too short, too few distinct words, too many capitals, odd characters."""
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": (F.size(words) < 200).cast("int"),
        "B": (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).cast("int"),
        "C": (100 * capitals > 3 * F.length(text)).cast("int"),
        "D": text.rlike(r"[#$%&*|]").cast("int"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): how many rows of a part have these flags and labels.

    part is the row's lang, null as the empty string; a null text is empty. E: a smaller doc_id has the same text. Rows that share
    id and text don't make each other fail; a row without an id neither fails E nor makes another fail. A document is good or
    toxic if any of its label rows says so, and neither if it has none. An empty table gives no rows.

    Texts meet by their sha-256 only. Rows are aggregated before each shuffle: first those of one id and text, then all
    of one text that are alike in labels and part, so that a text held by a third of the table is a few rows when it is grouped.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    slim = docs.select(docs["doc_id"].cast("long").alias("id"), F.coalesce(docs["lang"], F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), *(c.alias(k) for k, c in failures(text).items()))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    group = ["part", "key", *"ABCD"]
    rows = slim.groupBy("id", *group).agg(F.count("*").alias("n"))
    # Rows without an id meet no label: they stay out of the join, where they would all be one key.
    known = rows.where("id IS NOT NULL").join(marks, "id", "left").select("id", *group, "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    rows = known.unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    # The least id of each kind of row, and how many rows have it; then the least of the whole text.
    least = F.min(F.struct(F.col("id"), F.col("n")))
    kinds = rows.groupBy(*group, "good", "toxic", F.col("id").isNull().alias("nameless")).agg(F.sum("n").alias("n"), F.min("id").alias("first"), least.alias("least"))
    each = kinds.withColumn("of_text", F.min("first").over(W.partitionBy("key")))
    kept = F.when(F.col("nameless"), F.col("n")).when(F.col("first") == F.col("of_text"), F.col("least.n")).otherwise(F.lit(0))
    each = each.select("part", *"ABCD", "good", "toxic", "n", kept.alias("kept"))
    counted = each.groupBy("part", *"ABCD", "good", "toxic").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    copies = F.explode(F.array(F.struct(F.lit(0).alias("E"), F.col("kept").alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - F.col("kept")).alias("n")))).alias("e")
    return counted.select("part", *"ABCD", "good", "toxic", copies).select("part", *"ABCD", "e.E", "good", "toxic", "e.n").where("n > 0")


def joint_failures(flags: DataFrame, letters: str = LETTERS, weights: dict[str, Column] | None = None, part: str = "part") -> DataFrame:
    """(part, a column of 2^k counts for each weight): element S of an array counts the rows that fail every filter of the set S.

    Bit i of S stands for letters[i]; element 0 counts all rows. weights: what a row counts by name, by default n: 1 a row. A null flag counts as not failed.
    """
    weights = weights or {"n": F.lit(1)}
    flag = {k: F.coalesce(F.col(k), F.lit(0)).cast("long") for k in letters}

    def sums(weight: Column) -> Column:
        sets = [[k for i, k in enumerate(letters) if s >> i & 1] for s in range(1 << len(letters))]
        return F.array(*[F.sum(reduce(lambda p, k: p * flag[k], s, weight.cast("long"))) for s in sets])

    return flags.groupBy(part).agg(*[sums(w).alias(name) for name, w in weights.items()])


def _signed(joint: Column, among: Column, also: Column) -> Column:
    """Moebius sum: rows that fail all filters of the set also and none of the set among."""
    n = F.size(joint)
    sign = lambda t: F.when(F.bit_count(t) % 2 == 0, 1).otherwise(-1)
    at = lambda t: F.element_at(joint, t.bitwiseOR(also) + 1)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda acc, t: acc + F.when(t.bitwiseAND(among) == t, sign(t) * at(t)).otherwise(0))


def _shapley(joint: Column, bit: Column, orders: int) -> Column:
    """A filter's removals summed over all orders: each dividend is shared alike by the filters of its set."""
    share = lambda t: F.lit(orders) / F.bit_count(t)
    dividend = lambda t: F.when(F.bit_count(t) % 2 == 1, 1).otherwise(-1) * F.element_at(joint, t + 1)
    sets = F.sequence(F.lit(1), F.size(joint) - 1)
    total = F.aggregate(sets, F.lit(0.0), lambda acc, t: acc + F.when(t.bitwiseAND(bit) != 0, dividend(t) * share(t)).otherwise(0.0))
    return F.round(total).cast("long")


def audit_orders(joint: DataFrame, letters: str = LETTERS, part: str = "part", count: str = "n", lost: dict[str, str] | None = None) -> DataFrame:
    """A row for each part, order of all filters and step: kept, removed, redundant, unique_fails, shapley, and a column for each of lost.

    joint is what joint_failures() returns; lost names result columns by the weight they count, of the rows removed at the step.
    For up to six filters or so: the rows are k * k! a part.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])).alias("filter_order")
    steps = joint.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit_of = F.create_map(*[F.lit(x) for i, k in enumerate(letters) for x in (k, 1 << i)])
    bits = F.transform(F.split("filter_order", ""), lambda k: bit_of[k])
    steps = steps.withColumn("bit", F.element_at(bits, F.col("step"))).withColumn("before", F.aggregate(F.slice(bits, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))
    n, bit, before, none = F.col(count), F.col("bit"), F.col("before"), F.lit(0)
    removed = _signed(n, before, bit)
    return steps.select(
        part, "filter_order", F.col("step").cast("int").alias("step"),
        _signed(n, before + bit, none).alias("kept"), removed.alias("removed"), (F.element_at(n, bit + 1) - removed).alias("redundant"),
        _signed(n, F.lit((1 << len(letters)) - 1) - bit, bit).alias("unique_fails"),
        *[_signed(F.col(weight), before, bit).alias(name) for name, weight in (lost or {}).items()],
        _shapley(n, bit, factorial(len(letters))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents: all 120 orders, a row for each part, order and step, zeros included; see flagged() for odd rows."""
    weights = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    return audit_orders(joint_failures(flagged(docs, labels), weights=weights), lost={"good_lost": "good", "toxic_lost": "toxic"})
