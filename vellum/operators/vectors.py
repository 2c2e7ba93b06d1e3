"""Exact nearest vectors through lists around centroids, within what a reader may see.

Vectors lie in a folder for each nearest centroid, sorted by their angle to it. Angles obey the triangle inequality: a vector of angle t in a cell whose centroid is
a away from the probe is at least |a - t| from it. So a search reads the nearest cells first, and of the rest only cells and
ranges of t that can still hold one nearer than the k-th found. Filters come before the k are taken.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators.commits import Commits
from vellum.operators.search import cosine
from vellum.session import cut

#: Similarity at which a match begins to count, the greatest distance of a match, and how few matches widen a search.
MATCH_FLOOR, MAX_DISTANCE, TOO_FEW = 0.55, 0.6, 3
#: How much rounding an angle near 0 may hold.
SLACK = 1e-6


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of a sample of vectors by a few rounds of spherical means; the first are every n-th of the sample."""
    units = _units(sample)
    centroids = units[np.linspace(0, len(units) - 1, min(cells, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(units @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        held = np.linalg.norm(sums, axis=1) > 1e-12
        centroids = np.where(held[:, None], _units(sums), centroids)
    return centroids


class VectorIndex:
    """Vectors of a table in a folder, all columns kept; rows whose vector is null, empty, all zeros or of another length are left out."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = Commits(spark, folder)

    def build(self, rows: DataFrame, key: str, vector: str, cells: int = 64, sample: int = 20_000) -> None:
        """Index every row. The centroids alone are fitted on a sample: the rows of the least hashes of their keys, at most sample of them."""
        if self.log.last() is not None:
            raise ValueError(f"{self.log.folder} has an index")
        whole = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
        drawn = whole.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.xxhash64(key), key).limit(sample).toPandas()["v"]
        size = len(drawn.iloc[0]) if len(drawn) else 0
        centroids = fit_centroids(np.stack([v for v in drawn if len(v) == size]), cells) if size else np.zeros((0, 0))

        def place(batches):
            for batch in batches:
                units = _units(np.stack(batch["_v"].to_numpy())) if len(batch) else np.zeros((0, size))
                near = units @ centroids.T
                cell = np.argmax(near, axis=1) if len(batch) else np.zeros(0, dtype=int)
                yield batch.drop(columns="_v").assign(_cell=cell.astype("int32"), _angle=np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1)))

        same = whole.where(F.size(vector) == size).withColumn("_v", F.col(vector).cast("array<double>"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _cell int, _angle double"
        placed = same.mapInPandas(place, schema) if size else rows.limit(0).withColumns({"_cell": F.lit(0), "_angle": F.lit(0.0)})
        name = self.log.write(placed.hint("rebalance", "_cell").sortWithinPartitions("_cell", "_angle"), "_cell")
        folders = self.log.folders(name)
        stored = self.log.spark.read.schema(schema.replace(", _cell int", "")).option("basePath", f"{self.log.folder}/{name}")
        state = {"schema": schema.replace(", _cell int", ""), "key": key, "vector": vector, "centroids": centroids.tolist(), "cells": {}}
        if folders:
            bounds = stored.parquet(*[f"{self.log.folder}/{f}" for f in folders.values()]).groupBy(F.regexp_extract(F.input_file_name(), r"_cell=(\d+)", 1).alias("c"))
            for r in bounds.agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count("*").alias("n")).collect():  # a row a cell
                state["cells"][r.c] = {"folder": folders[r.c], "low": r.low, "high": r.high, "n": r.n}
        self.log.commit(state)

    def _read(self, state: dict, names: list[str], near: dict[str, float], within: float) -> DataFrame:
        """Rows of cells whose angle to the centroid is not more than within from the probe's, pushed down to the files of each cell."""
        parts = None
        for c in names:
            rows = self.log.read([state["cells"][c]["folder"]], state["schema"])
            if within < math.pi:
                rows = rows.where(F.col("_angle").between(near[c] - within, near[c] + within))
            parts = rows if parts is None else parts.unionByName(rows)
        return parts.drop("_angle") if parts is not None else self.log.read([], state["schema"]).drop("_angle")

    def nearest(self, probe: list[float], k: int, visible: DataFrame | None = None, on: str | None = None, where: Column | None = None, first: int = 4) -> DataFrame:
        """The k rows of least cosine distance to the probe, with distance, ties by key; of those that where holds for and whose on is in visible.

        The first cells are read whole; the distance of the k-th row found there bounds what is read of the others. self.read has the share of rows whose cells were read.
        """
        state = self.log.last()
        q = np.asarray(probe, dtype=float)
        if not state["cells"] or not np.any(q):
            return self.log.read([], state["schema"]).drop("_angle").withColumn("distance", F.lit(0.0)).limit(0)
        centroids = np.asarray(state["centroids"])
        angle = np.arccos(np.clip(_units(q[None, :])[0] @ centroids.T, -1, 1))
        near = {c: float(angle[int(c)]) for c in state["cells"]}
        bound = {c: max(0.0, near[c] - s["high"], s["low"] - near[c]) for c, s in state["cells"].items()}
        order = sorted(state["cells"], key=lambda c: (bound[c], near[c]))
        wanted = F.array(*[F.lit(float(x)) for x in q])

        def best(rows: DataFrame) -> DataFrame:
            rows = rows if where is None else rows.where(where)
            rows = rows if visible is None else rows.join(visible.select(on).distinct(), on, "left_semi")
            return rows.withColumn("distance", 1 - cosine(F.col(state["vector"]), wanted)).orderBy("distance", state["key"]).limit(k)

        found = cut(best(self._read(state, order[:first], near, math.pi)))
        last = found.orderBy(F.desc("distance")).limit(1).agg(F.max("distance").alias("d"), F.lit(found.count()).alias("n")).first()
        reach = math.pi if last.n < k else math.acos(max(-1.0, min(1.0, 1 - last.d))) + SLACK
        rest = [c for c in order[first:] if bound[c] <= reach]
        total = sum(s["n"] for s in state["cells"].values())
        self.read = sum(state["cells"][c]["n"] for c in [*order[:first], *rest]) / total
        if not rest:
            return found
        return found.unionByName(best(self._read(state, rest, near, reach))).orderBy("distance", state["key"]).limit(k)


def match_scores(found: DataFrame, floor: float = MATCH_FLOOR, most: float = MAX_DISTANCE) -> DataFrame:
    """found without rows beyond the greatest distance, with similarity (of three digits) and match, the percentage of the way from the floor to 1."""
    sim = 1 - F.col("distance")
    match = F.round(F.greatest(F.lit(0.0), (sim - floor) / (1 - floor)) * 100).cast("int")
    return found.where(F.col("distance") <= most).withColumns({"similarity": F.round(sim, 3), "match": match})


def widened(narrow: DataFrame, wide: DataFrame, key: str, least: int = TOO_FEW) -> DataFrame:
    """narrow with scope "narrow", and where it has fewer than least rows, the rows of wide that it lacks with scope "wide"."""
    few = narrow.limit(least).agg((F.count("*") < least).alias("_few"))
    more = wide.join(narrow.select(key), key, "left_anti").join(F.broadcast(few)).where("_few").drop("_few")
    return narrow.withColumn("scope", F.lit("narrow")).unionByName(more.withColumn("scope", F.lit("wide")))
