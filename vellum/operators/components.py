"""Connected components of an edge list by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vellum.session import discard, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable over the undirected edges.

    Each round every node takes the least label among itself, its neighbours and its label's label, so chains
    halve and stars settle in two rounds. Nothing but a changed-row count comes to the driver; each round is a table in
    the shared folder that replaces the last one, so small edge lists are broadcast by their size and large ones shuffled.
    Edges with a null end and self-loops contribute no link; an empty edge list gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = written(
            labels.join(near.withColumnRenamed("a", "node"), "node", "left")
            .join(hop, "component", "left")
            .select("node", F.least("component", "near", "far").alias("component"), F.col("component").alias("before")),
            "labels",
        )
        discard(labels)
        labels = new
        if new.where("component <> before").isEmpty():
            discard(both)
            settled = new.select("node", "component")
            settled.scratch_path = new.scratch_path
            return settled
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
