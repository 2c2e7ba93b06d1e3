"""Passages of sources against a loop over claims and nodes."""

import math
import random
import re

from vellum.operators import passages as P
from vellum.operators.ranking import FAR, SQUARES, stem_word

WORDS = "river rivers stone stones carries carried lamp the of under between morning mornings x ab".split()


def tokens(text):
    return [w for w in re.split("[^a-z0-9_]+", (text or "").lower()) if w]


def search(nodes, book, terms, read, whole):
    found = []
    for b, node, text in nodes:
        places = {}
        for at, w in enumerate(map(read, tokens(text)), 1):
            places.setdefault(w, []).append(at)
        held = sorted(t for t in terms if t in places)
        if b != book or not held or (whole and len(held) < len(terms)):
            continue
        if whole and len(terms) > 1:
            product = 1.0
            for i, s in enumerate(held):
                for t in held[i + 1 :]:
                    for x in places[s]:
                        for y in places[t]:
                            gap = abs(x - y)
                            product *= 1 - math.sqrt(0.01 * (FAR if gap > 100 else 1 / (1.005 + 0.05 * math.exp(gap / 1.5 - 2))))
            rank = 1 - product
        else:
            rank = sum(0.1 / j**2 for t in held for j in range(1, len(places[t]) + 1)) / SQUARES / len(terms)
        found.append((-round(rank, 4), node))
    return sorted(found)[:3]


def by_loop(claims, nodes):
    out = set()
    for claim, book, text in claims:
        plain = lambda n: list(dict.fromkeys(w for w in tokens((text or "")[:n]) if w not in P.STOP_WORDS))  # noqa: B023, E731
        words = [w for w in plain(200) if len(w) > 3][:15]
        for stage, terms, read in (("all", {stem_word(w) for w in plain(80)}, stem_word), ("any", {stem_word(w) for w in words}, stem_word), ("words", set(words), str)):
            found = search(nodes, book, terms, read, stage == "all") if terms else []
            if found:
                out |= {(claim, node, stage, -rank) for rank, node in found}
                break
    return out


def test_passages_equal_a_loop(spark):
    rng = random.Random(2)
    nodes = [(rng.choice("ab"), k, rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.choice([3, 12, 60])))]) if k % 7 == 0 else " ".join(rng.choices(WORDS, k=rng.choice([2, 5, 30])))) for k in range(50)]
    claims = [(k, rng.choice(["a", "b", "none", None]), rng.choice([None, "the of", " ".join(rng.choices([*WORDS, "zebra"], k=rng.choice([1, 2, 4, 9, 30])))])) for k in range(40)]
    got = P.claim_passages(spark.createDataFrame(claims, "claim long, book string, text string"), spark.createDataFrame(nodes, "book string, node long, text string")).collect()
    want = by_loop(claims, nodes)
    ranks = {(c, n, s): r for c, n, s, r in want}
    assert {(r.claim, r.node, r.stage) for r in got} == set(ranks)
    assert all(abs(r["rank"] - ranks[r.claim, r.node, r.stage]) < 2e-4 for r in got)
    assert {r.stage for r in got} == {"all", "any"}


def test_long_passages_are_cut_and_marked(spark):
    nodes = spark.createDataFrame([("a", 1, "lamp " * 400)], "book string, node long, text string")
    row = P.claim_passages(spark.createDataFrame([(1, "a", "a lamp")], "claim long, book string, text string"), nodes).first()
    assert row.passage == ("lamp " * 400)[:1500] + "\n[...TRUNCATED]" and row.stage == "all"


def test_no_claims(spark):
    nodes = spark.createDataFrame([("a", 1, "lamp")], "book string, node long, text string")
    assert P.claim_passages(spark.createDataFrame([], "claim long, book string, text string"), nodes).count() == 0
