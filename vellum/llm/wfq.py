"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow that sends its documents in shuffled order, up to three rounds of them. A document's virtual
start and finish are its source's words sent before and after it, divided by the source's target; the last document a
target reaches is sent in part, so it finishes at 1. The mix is the global order of finish times, cut at the total budget.
Prefix sums are taken in two steps, over hash ranges and within them, so a hot source is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.session import cut, shuffle_width

WEIGHTS, ROUNDS = (5, 2, 1), 3
#: Rows of a hash range, about.
RANGE_ROWS = 500


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t\\n\\v\\f\\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): weights repeat over sources by code point, null last.

    Shares of the total, none above rounds times its source's size, the excess shared again by weight. A source is
    capped where its cap lies below weight times the water level; sorted by cap / weight, the capped are a prefix.
    One row per source, so a window over all of them is small whatever the documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1)).withColumn("cap", F.lit(float(rounds)) * F.col("source_size"))
    rising = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, everyone = rising.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    named = named.withColumn("level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    # The level is that of the first source, in rising order, whose cap it doesn't reach.
    named = named.withColumn("water", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everyone)["level"])
    return named.select("source", "source_size", F.round(F.least("cap", F.coalesce("water", F.lit(0.0)) * F.col("weight")), 6).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, seed: str = "") -> DataFrame:
    """The mix as a schedule: a row per document and round sent: doc_id, text_md5, source, size, source_size, target, round, taken, finish, place.

    Documents are shuffled by md5 of seed and id (ties by the text's md5); taken is size, or less for the document that its
    source's target ends in; place counts words sent before it, in order of finish. Rows with nothing to send are left out.
    Null texts have no words; a null source is a source of its own; a null id shuffles as "null". Equal ids with
    equal texts share their place's order, with the same sums on a rerun. No document is sent more than rounds times.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("text_md5"), F.col(source_col).alias("source"), words(text).alias("size"))
    slim = cut(slim.withColumn("shuffled", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))))
    return schedule(slim, weights, rounds)


def sized(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """slim with source_size and target."""
    # Source keys are shipped as a struct so that null is a key like any other.
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, weights, rounds).withColumnRenamed("source", "s")
    return slim.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def schedule(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    n = slim.count()
    digits = len(f"{n // RANGE_ROWS:x}")
    ranged = sized(slim, weights, rounds).withColumn("range", F.substring("shuffled", 1, digits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("part"))
    before = sums.withColumn("base", F.sum("part").over(W.partitionBy("source").orderBy("range")) - F.col("part")).select(F.col("source").alias("s"), F.col("range").alias("r"), "base")
    placed = ranged.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = W.partitionBy("source", "range").orderBy("shuffled", "doc_id", "text_md5").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size")).drop("base", "range")
    sent = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("start", F.col("start") + F.col("round") * F.col("source_size"))
    quota = F.round("target").cast("long")
    sent = sent.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), quota - F.col("start")))).where("taken > 0")
    return _cut_at_budget(sent.withColumn("finish", (F.col("start") + F.col("taken")) / F.col("target")), slim)


def _cut_at_budget(sent: DataFrame, slim: DataFrame) -> DataFrame:
    """Global order of finish times; what lies beyond the total of all sizes is cut off."""
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("doc_id"), F.col("text_md5")]
    lined = sent.repartitionByRange(shuffle_width(sent.sparkSession), *order).withColumn("part", F.spark_partition_id())
    lined = cut(lined.withColumn("run", F.sum("taken").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("taken")))
    base = lined.groupBy("part").agg(F.sum("taken").alias("total")).withColumn("base", F.sum("total").over(W.orderBy("part")) - F.col("total")).drop("total")
    budget = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    whole = lined.join(base, "part").withColumn("place", F.col("base") + F.col("run")).join(F.broadcast(budget))
    return whole.withColumn("taken", F.least("taken", F.col("budget") - F.col("place"))).where("taken > 0").select("doc_id", "text_md5", "source", "size", "source_size", "target", "round", "taken", "finish", "place")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, rounds: int = ROUNDS, seed: str = "") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target and taken, the words the mix takes of it, repeats counted.

    Rows are told apart by id, text and source, and repeated rows are numbered, each with a share of its own. Null texts have
    no words and are never taken; a null source is a source; null ids shuffle as "null". An empty table gives no rows; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("text_md5"), F.col(source_col).alias("source"), words(text).alias("size"))
    slim = slim.withColumn("shuffled", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    # Repeated rows are told apart, so that each has its own share.
    same = W.partitionBy("doc_id", "text_md5", "source").orderBy(F.lit(1))
    slim = cut(slim.withColumn("copy", F.row_number().over(same)).withColumn("text_md5", F.concat("text_md5", F.lit("."), F.lpad("copy", 9, "0"))).drop("copy"))
    sent = schedule(slim, weights, rounds).groupBy("doc_id", "text_md5", "source").agg(F.sum("taken").alias("t"))
    sent = sent.select(F.col("doc_id").alias("d"), F.col("text_md5").alias("m"), F.col("source").alias("s"), "t")
    full = sized(slim, weights, rounds)
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_md5") == F.col("m")) & F.col("source").eqNullSafe(F.col("s"))
    return full.join(sent, on, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("t", F.lit(0)).alias("taken"))
