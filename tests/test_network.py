"""Layers and layout of networks with odd rows."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import graph


def test_layers_fold_paths_and_drop_loops(spark):
    library = spark.createDataFrame([("a", "W1"), ("b", None), ("c", ""), ("d", "W1")], "book string, canonical_id string")
    bib = spark.createDataFrame([("a/2/x", None, "b", True), ("a", "W9", "b", None), ("a", None, "d", True), ("zz", "W1", None, True), ("c", None, "gone", False), (None, None, None, None), ("a", None, "b", True)], "book string, canonical_id string, foundation string, verified boolean")
    notes = spark.createDataFrame([("b", True, "a"), ("b", False, "c"), ("b", None, "c"), ("b/1", True, "a")], "book string, is_citation boolean, foundation string")
    hyper = spark.createDataFrame([("c", ["/b/3#x", "https://host.org/a?y=1", "", "/", "/nowhere"]), ("b", None), ("b", []), ("d", ["/a"])], "book string, cited_in array<string>")
    got = {tuple(r) for r in graph.layers(bib, notes, hyper, library).collect()}
    assert got == {("W1", "b", "citation_verified"), ("W1", "W9", "citation_auto"), ("b", "W1", "citation_auto"), ("c", "b", "hypercite"), ("c", "W1", "hypercite")}


def test_layout(spark):
    def by_hand(name):
        h = 0
        for c in name:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        return (abs(h) % 1000) * (1 if h >= 0 else -1) / 1000

    names = ["", "a", "a long name of a work, to run over 32 bits", "x1", "alone"]
    nodes = spark.createDataFrame([(names[0], 1900), (names[1], 2000), (names[2], None), (names[3], None), (names[4], None)], "node string, year int")
    edges = spark.createDataFrame([("", names[2]), ("a", names[2]), ("a", names[2]), ("x1", "alone"), ("x1", "x1")], "source string, target string")
    got = {r.node: r for r in graph.layout(nodes, edges).collect()}
    assert got[""].x == -80 and got["a"].x == 80
    assert got[names[2]].x == pytest.approx(80 / 3 + by_hand(names[2]) * 4) and got["alone"].x == pytest.approx(by_hand("alone") * 40)
    assert got["x1"].y == 32 and got["a"].z == pytest.approx(by_hand("a") * 45)
    one = nodes.where("year = 2000")
    assert graph.layout(one, edges).first().x == 0 and graph.year_axis(one).count() == 0
    assert [r.year for r in graph.year_axis(nodes).orderBy("year").collect()] == [1900, 1920, 1940, 1960, 1980, 2000]
    assert graph.layout(nodes.where(F.lit(False)), edges).count() == 0
