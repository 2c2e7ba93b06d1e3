"""Resumable crawls of a citation network: a frontier of books, the works they cite, a budget, and committed progress.

A crawl's state is a folder of tables and of numbered commits. A level of the frontier is planned as one distributed step: the works its
books cite, each under the first book that cites it, in the order in which they are to be attempted. Then slices of it are
attempted, a commit each. Tables are written under names of their own before the commit that names them, which is renamed into
place whole, so a crawl killed at any time goes on from its last commit and ends as if it had never stopped.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from vellum.operators.commits import Commits
from vellum.operators.relational import rank_positions
from vellum.session import cut, shuffle_width

RESULTS = "work long, book long, depth int, parent_book long, position long, status string, cost double"
PLAN = "work long, depth int, parent_book long, position long, charge double, outcome string, version long"
FRONTIER = "book long, depth int, ordinal long"


def _plan(edges: DataFrame, works: DataFrame, frontier: DataFrame, tried: DataFrame, depth: int) -> DataFrame:
    """A level's works in the order of attempt: by book, most cited first, nulls last, then by id; each under the first book that cites it."""
    cited = frontier.select("book", "ordinal").join(edges.select("book", "work"), "book").groupBy("work").agg(F.min(F.struct("ordinal", "book")).alias("by"))
    fresh = cited.join(works.where("eligible"), "work").join(tried.select("work"), "work", "left_anti")
    rows = fresh.select("work", F.lit(depth).alias("depth"), F.col("by.book").alias("parent_book"), F.col("by.ordinal").alias("ordinal"), "cited_by", F.coalesce(F.col("cost"), F.lit(0.0)).cast("double").alias("charge"), F.col("outcome"), F.col("version"))
    placed = rank_positions(rows, [F.col("ordinal"), F.col("cited_by").desc_nulls_last(), F.col("work")])
    return placed.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PLAN.split(", ")])


def _spent_before(plan: DataFrame) -> DataFrame:
    """plan with spent, what the works before each cost that were imported: sums within ranges of position, and of the ranges before."""
    paid = F.when(F.col("outcome") == "assigned", F.col("charge")).otherwise(0.0)
    ranged = cut(plan.withColumn("_paid", paid).repartitionByRange(shuffle_width(plan.sparkSession), "position").withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.sum("_paid").alias("_sum")).withColumn("_base", F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).drop("_sum")
    inside = F.sum("_paid").over(W.partitionBy("_part").orderBy("position").rowsBetween(W.unboundedPreceding, -1))
    return ranged.withColumn("_in", F.coalesce(inside, F.lit(0.0))).join(before, "_part").withColumn("spent", F.round(F.col("_base") + F.col("_in"), 6)).drop("_part", "_paid", "_in", "_base")


def crawl(
    edges: DataFrame,
    works: DataFrame,
    roots: DataFrame,
    folder: str,
    max_depth: int = 1,
    max_works: int | None = None,
    max_spend: float | None = None,
    slice_works: int | None = None,
    on_commit: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(work, book, depth, parent_book, position, status, cost): every work attempted or left for want of budget.

    edges (book, work): who cites what. works (work, eligible, cited_by, cost, outcome, version): outcome is what an attempt gives, the
    book imported is version where that is "assigned" or "assigned_existing"; only "assigned" costs. roots (book, ordinal): where
    to begin, in that order. Depth 1 are the works that roots cite; an imported book's own works follow while its depth is below max_depth,
    each book once. A level is attempted book by book, most cited first, and every work once in a crawl: under the first book that cites it.

    max_works bounds the attempts: what a level has beyond is recorded as "capped". max_spend stops the crawl before the first work at
    which that much is spent; the work that crosses it still counts, and the rest of its level is "skipped_over_budget".
    slice_works: a commit after so many attempts; None: after each level. on_commit sees each state. A folder with commits is gone on from, with
    the same inputs and bounds; one that is complete just gives its results.

    Null books and works are no nodes. Books without works, dangling works and cycles are fine.
    """
    spark = edges.sparkSession
    log = Commits(spark, folder)
    edges = edges.where("book IS NOT NULL AND work IS NOT NULL").select("book", "work").distinct()

    def publish(state: dict) -> dict:
        state = log.commit(state)
        if on_commit:
            on_commit(state)
        return state

    state = log.last()
    if state is None:
        first = roots.where("book IS NOT NULL").groupBy("book").agg(F.min("ordinal").alias("ordinal")).select(F.col("book").cast("long").alias("book"), F.lit(0).alias("depth"), F.col("ordinal").cast("long").alias("ordinal"))
        state = publish({"frontier": [log.write(first)], "plan": None, "results": [], "depth": 0, "attempted": 0, "spent": 0.0, "from": 0, "done": False})
    while not state["done"]:
        depth = state["depth"] + 1
        if state["plan"] is None:
            # What one level attempts is decided once and committed; the slices read it from there.
            frontier, tried = log.read(state["frontier"][-1:], FRONTIER), log.read(state["results"], RESULTS)
            plan = log.write(_plan(edges, works, frontier, tried, depth))
            n = log.read([plan], PLAN).count()
            state = publish(state | {"plan": plan, "planned": n, "from": 0}) if n else publish(state | {"done": True})
            continue
        plan = _spent_before(log.read([state["plan"]], PLAN)) if max_spend is not None else log.read([state["plan"]], PLAN).withColumn("spent", F.lit(0.0))
        left = state["planned"] - state["from"] if max_works is None else max_works - state["attempted"]
        upto = min(state["planned"], state["from"] + min(left, slice_works or state["planned"]))
        # The level's own spending counts from its beginning; state has what levels before it spent.
        over = F.lit(False) if max_spend is None else F.lit(state["spent"]) + F.col("spent") >= F.lit(float(max_spend))
        mine = plan.where((F.col("position") > state["from"]) & (F.col("position") <= upto))
        imported = F.col("outcome").isin("assigned", "assigned_existing")

        def result(rows: DataFrame, status, tried: bool) -> DataFrame:
            book, cost = (F.when(imported, F.col("version")), F.when(F.col("outcome") == "assigned", F.col("charge")).otherwise(0.0)) if tried else (F.lit(None).cast("long"), F.lit(0.0))
            return rows.select("work", book.cast("long").alias("book"), "depth", "parent_book", "position", status.alias("status"), cost.cast("double").alias("cost"))

        parts = [result(mine.where(~over), F.col("outcome"), True)]
        stop = max_spend is not None and not mine.where(over).isEmpty()
        rest = plan.where(F.col("position") > upto)
        if stop:
            parts.append(result(plan.where((F.col("position") > state["from"]) & over), F.lit("skipped_over_budget"), False))
        elif upto - state["from"] == left and upto < state["planned"]:
            parts.append(result(rest, F.lit("capped"), False))
        name = log.write(reduce(DataFrame.unionByName, parts))
        written = log.read([name], RESULTS)
        sums = written.agg(F.count_if(~F.col("status").isin("capped", "skipped_over_budget")).alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()
        state = state | {"results": [*state["results"], name], "attempted": state["attempted"] + sums.n, "from": upto, "level_spent": round(state.get("level_spent", 0.0) + sums.c, 6)}
        out_of_works = max_works is not None and state["attempted"] >= max_works
        if stop or (out_of_works and upto < state["planned"]):
            state = publish(state | {"done": True})
        elif upto < state["planned"]:
            state = publish(state)
        else:
            state = state | {"spent": round(state["spent"] + state["level_spent"], 6), "level_spent": 0.0, "plan": None, "depth": depth}
            visited = log.read(state["frontier"], FRONTIER).select("book")
            level = log.read(state["results"], RESULTS).where((F.col("depth") == depth) & F.col("book").isNotNull())
            new = level.groupBy("book").agg(F.min("position").alias("ordinal")).join(visited, "book", "left_anti")
            new = log.write(new.select("book", F.lit(depth).alias("depth"), "ordinal")) if depth < max_depth else None
            if new is None or log.read([new], FRONTIER).isEmpty():
                state = publish(state | {"done": True})
            else:
                state = publish(state | {"frontier": [*state["frontier"], new]})
    return log.read(state["results"], RESULTS)
