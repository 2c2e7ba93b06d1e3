"""Nearest vectors through the index against a scan of all."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import vectors as V


def rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 12)) * 3
    out = [(i, (centres[i % 8] + rng.normal(size=12) * 0.5).tolist(), f"b{i % 5}") for i in range(n)]
    return out + [(n, out[0][1], "b1"), (n + 1, None, "b1"), (n + 2, [0.0] * 12, "b1"), (n + 3, [], "b1"), (n + 4, [1.0, 2.0], "b1")]


SCHEMA = "id long, v array<double>, book string"


def scan(data, probe, k, books=None):
    q = np.array(probe)
    held = [(i, np.array(v)) for i, v, b in data if v and len(v) == len(q) and any(v) and (books is None or b in books)]
    dist = sorted((1 - float(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q)), i) for i, v in held)
    return [i for _, i in dist[:k]]


@pytest.fixture(scope="module")
def index(spark):
    made = V.VectorIndex(spark, tempfile.mkdtemp())
    made.build(spark.createDataFrame(rows(), SCHEMA).repartition(4), "id", "v", cells=16, sample=200)
    return made


def test_nearest_equals_a_scan_and_reads_less(spark, index):
    data, shares = rows(), []
    rng = np.random.default_rng(1)
    for probe in [data[3][1], data[77][1], rng.normal(size=12).tolist(), (-np.array(data[5][1])).tolist()]:
        got = [r.id for r in index.nearest(probe, 7, first=2).collect()]
        assert len(got) == 7 and set(got) == set(scan(data, probe, 7))
        shares.append(index.read)
    assert min(shares) < 0.3


def test_filters_come_before_the_nearest(spark, index):
    data = rows()
    visible = spark.createDataFrame([("b4",), ("b4",), ("b2",)], "book string")
    got = [r.id for r in index.nearest(data[0][1], 9, visible, "book", first=1).collect()]
    assert set(got) == set(scan(data, data[0][1], 9, {"b4", "b2"}))
    few = index.nearest(data[0][1], 500, visible, "book", F.col("id") < 40).collect()
    assert {r.id for r in few} == {i for i in range(40) if i % 5 in (4, 2)} and index.read == 1.0
    assert index.nearest([0.0] * 12, 3).count() == 0


def test_scores_and_widening(spark):
    found = spark.createDataFrame([(1, 0.0), (2, 0.3), (3, 0.5), (4, 0.6), (5, 0.61)], "id long, distance double")
    assert [(r.id, r.similarity, r.match) for r in V.match_scores(found).orderBy("id").collect()] == [(1, 1.0, 100), (2, 0.7, 33), (3, 0.5, 0), (4, 0.4, 0)]
    wide = found.select("id")
    of = lambda n: {(r.id, r.scope) for r in V.widened(wide.where(F.col("id") > 5 - n), wide, "id").collect()}
    assert of(3) == {(3, "narrow"), (4, "narrow"), (5, "narrow")}
    assert of(1) == {(5, "narrow"), *((k, "wide") for k in range(1, 5))} and len(of(0)) == 5


def test_index_of_nothing(spark):
    made = V.VectorIndex(spark, tempfile.mkdtemp())
    made.build(spark.createDataFrame([(1, None, "b")], SCHEMA), "id", "v")
    assert made.nearest([1.0, 0.0], 3).count() == 0
    with pytest.raises(ValueError):
        made.build(spark.createDataFrame([], SCHEMA), "id", "v")
