"""Ranks against values worked out by hand, stems against pairs of the stemmer's published vocabulary."""

from math import exp, sqrt

import pytest
from pyspark.sql import functions as F

from vellum.operators import ranking

PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoling": "consol", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirators": "conspir",
    "constable": "constabl", "constancy": "constanc", "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knightly": "knight", "knitting": "knit", "knives": "knive",
    "generate": "generat", "generous": "generous", "communism": "communism", "happy": "happi", "by": "by", "say": "say", "enjoy": "enjoy", "ties": "tie", "cries": "cri", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "hopping": "hop", "hoping": "hope",
    "luxuriated": "luxuri", "relational": "relat", "sky": "sky", "news": "news", "succeed": "succeed", "dying": "die", "national": "nation", "running": "run", "agreed": "agre", "feed": "feed", "controlled": "control", "adoption": "adopt", "rolling": "roll",
}


@pytest.mark.parametrize("word", PAIRS)
def test_stems(word):
    assert ranking.stem_word(word) == PAIRS[word]


def test_stemmed_counts(spark):
    docs = spark.createDataFrame([(1, "Running runs, run! knives"), (2, None), (3, "")], "id int, text string")
    assert {(r.id, r.stem, r.n) for r in ranking.stemmed(docs, "id", F.col("text")).collect()} == {(1, "run", 3), (1, "knive", 1)}


def ranks(spark, fields, column):
    row = spark.range(1).select(*[F.lit(t).cast("string").alias(k) for k, t in fields.items()])
    return row.select(column({k: F.col(k) for k in fields})).collect()[0][0]


def test_any_rank_counts_the_best_weight_in_full(spark):
    got = ranks(spark, {"D": "x y x", "A": "z x"}, lambda f: ranking.any_rank(f, ["x", "q"]))
    assert got == pytest.approx((1.0 + (0.05 + 0.05 / 4 + 1.0 / 9) - 1.0 / 9) / 1.64493406685 / 2)
    assert ranks(spark, {"A": None}, lambda f: ranking.any_rank(f, ["x"])) == 0


def test_all_rank_by_nearness(spark):
    near = lambda gap: 1 / (1.005 + 0.05 * exp(gap / 1.5 - 2))
    got = ranks(spark, {"A": "x a y", "D": "x"}, lambda f: ranking.all_rank(f, ["x", "y"]))
    assert got == pytest.approx(1 - (1 - sqrt(near(2))) * (1 - sqrt(0.05 * near(1))))
    assert ranks(spark, {"A": "x x"}, lambda f: ranking.all_rank(f, ["x", "y"])) == 0


def test_cover_rank_takes_the_least_spans(spark):
    # spans: x . y (2 apart, one other word), then y x (1 apart, none)
    assert ranks(spark, {"A": "x a y x b b"}, lambda f: ranking.cover_rank(f["A"], ["x", "y"])) == pytest.approx(0.1 / 2 + 0.1)
    assert ranks(spark, {"A": "x x x"}, lambda f: ranking.cover_rank(f["A"], ["x"])) == pytest.approx(0.3)
    assert ranks(spark, {"A": "x"}, lambda f: ranking.cover_rank(f["A"], ["x", "y"])) == 0
