"""Signals, audits, inverted texts and shelves with odd rows; alignment and stems against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.operators import convert, linkage as L, quality as Q, ranking
from vellum.plans import registry


def test_signals_of_odd_documents(spark):
    rows = [("a", k, t) for k, t in enumerate([None, "", " \t", "Just a moment..."])] + [("b", k, "same line of text") for k in range(8)] + [("c", k, "#$%& 123") for k in range(400)] + [(None, 1, "x")]
    rows += [("deep", k, f"line {k} of a long and proper document " * 6) for k in range(12)] + [("deep", 99, "checking your browser")]
    got = {r.doc: r for r in Q.quality_signals(spark.createDataFrame(rows, "doc string, pos long, t string"), "doc", "pos", "t").collect()}
    assert got["a"].signals == ["node_count", "total_chars", "block_page_phrase", "empty_nodes"] and got["a"].empty == 0.75
    assert got["b"].signals == ["total_chars", "duplicate_nodes"] and got["b"].repeated == 7 / 8
    assert got["c"].signals == ["alpha_ratio", "duplicate_nodes"] and got["c"].alpha == 1 / 8
    assert got["deep"].signals == [] and got[None].nodes == 1
    only_empty = spark.createDataFrame([("z", 1, None)], "doc string, pos long, t string")
    row = Q.quality_signals(only_empty, "doc", "pos", "t").first()
    assert (row.alpha, row.repeated, row.empty) == (None, None, 1.0)
    assert Q.quality_signals(only_empty.where("pos > 1"), "doc", "pos", "t").count() == 0


def test_numbers_that_start_over(spark):
    numbers = [1, 2, 5, None, 6, 6, 1, 4, 3]
    df = spark.createDataFrame([("d", k, n) for k, n in enumerate(numbers)] + [("e", 0, 7)], "d string, k long, n long")
    got = {tuple(r) for r in Q.numbering_audit(df, "d", ["k"], "n").collect()}
    assert got == {("d", 1, "gap", 3, 4, 2), ("d", 3, "gap", 2, 3, 2)}
    # A number that repeats begins a section, so none repeats within one unless rows share it in order.
    assert Q.numbering_audit(df.where("d = 'z'"), "d", ["k"], "n").count() == 0


def test_inverted_texts(spark):
    rows = [('{"b": [1, 3], "a": [0], "c": [2]}', "a b c b"), ("{}", ""), (None, None), ('{"x": null, "y": [5]}', "y"), ("no json", None)]
    df = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(rows)], "k long, j string")
    got = {r.k: r.t for r in df.select("k", convert.inverted_text(F.col("j")).alias("t")).collect()}
    assert [got[k] for k in range(4)] == [t for _, t in rows[:4]] and got[4] in (None, "")


def test_expected_places(spark):
    rows = [("d", 0, None), ("d", 1, 4), ("d", 2, None), ("d", 3, None), ("d", 4, 10), ("d", 5, None)]
    df = spark.createDataFrame(rows, "d string, o long, n long")
    got = {r.o: r.expected for r in Q.expected_places(df, "d", "o", "n", F.lit(6), F.lit(12)).collect()}
    assert got == {0: 0, 1: 4, 2: 6, 3: 8, 4: 10, 5: 10}


def test_unknown_sorts_fail():
    with pytest.raises(KeyError):
        Q.shelf_order("colour")


def plain_alignment(old, new, threshold=0.6, margin=0.1, radius=25):
    """One document: first equal texts, the first of several first, then what is most alike near the expected place."""
    a, b = ([None if t is None else L.block_normalise(t) for t in x] for x in (old, new))
    match, used = {}, set()
    for i, t in enumerate(a):
        if t is None:
            continue
        for j, u in enumerate(b):
            if j not in used and (u or "") == t:
                match[i] = (j, 1.0)
                used.add(j)
                break
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    for i, t in enumerate(a):
        mine = grams(t or "")
        if i in match or not mine:
            continue
        before, after = max((k for k in match if k < i), default=None), min((k for k in match if k > i), default=None)
        low, high = match[before][0] if before is not None else -1, match[after][0] if after is not None else len(b)
        share = low + (high - low) * (i - before) / (after - before) if before is not None and after is not None else i / len(a) * len(b)
        place = int(share + 0.5)
        scored = sorted(((len(mine & grams(b[j] or "")) / len(mine | grams(b[j] or "")), -j) for j in range(len(b)) if low < j < high and abs(j - place) <= radius and j not in used), reverse=True)
        if scored and scored[0][0] >= threshold and (len(scored) == 1 or scored[0][0] - scored[1][0] >= margin):
            match[i] = (-scored[0][1], scored[0][0])
            used.add(-scored[0][1])
    return {(i, j, round(s, 6)) for i, (j, s) in match.items()}


def test_alignment_equals_a_plain_loop(spark):
    rng = random.Random(6)
    words = "river stone lamp carries between morning house order theory under".split()
    docs = {}
    for g in range(25):
        old = [rng.choice([None, "", "same", " ".join(rng.choices(words, k=rng.randrange(1, 9)))]) for _ in range(rng.randrange(0, 20))]
        new = []
        for t in old:
            kind = rng.random()
            if kind < 0.2:
                new.append(" ".join(rng.choices(words, k=5)))
            if kind < 0.85:
                new.append(t if kind < 0.5 or not t else f"{t} {rng.choice(words)}")
        docs[g] = (old, new)
    frame = lambda k: spark.createDataFrame([(g, p, t) for g, x in docs.items() for p, t in enumerate(x[k])], "g long, pos long, text string")
    found = {}
    for r in L.monotone_alignment(frame(0), frame(1), "g").collect():
        found.setdefault(r.g, set()).add((r.old_pos, r.new_pos, r.score))
    for g, (old, new) in docs.items():
        assert found.get(g, set()) == (plain_alignment(old, new) if old and new else set()), g


def test_stems_of_all_documents_equal_a_count(spark, sf):
    import re

    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for w in re.split("[^a-z0-9_]+", (r.text or "").lower()):
            if w:
                want[r.doc_id, ranking.stem_word(w)] += 1
    got = {(r.doc_id, r.stem): r.n for r in registry.queries()["stemmed_terms"](spark, sf).collect()}
    assert got == dict(want)


def test_json_documents(spark):
    from vellum.functions import documents as D

    rows = ['{"a": 1, "b": [1, 2], "c": {"d": null}, "e": "x", "f": true, "g": 1.5}', "[1]", '"s"', "no json", None, "null"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, t string")
    whole = {r.k: r.v for r in df.select("k", D.json_typeof(F.col("t")).alias("v")).collect()}
    assert [whole[k] for k in range(6)] == ["object", "array", "string", None, None, "null"]
    first = df.where("k = 0")
    assert [first.select(D.json_typeof(F.col("t"), f"$.{p}")).first()[0] for p in ("a", "b", "c", "c.d", "e", "f", "g", "z")] == ["number", "array", "object", "null", "string", "boolean", "number", None]
    put = {r.k: r.v for r in df.select("k", D.json_set(F.col("t"), "a", F.lit('{"n": 2}')).alias("v")).collect()}
    assert put[0] == '{"a":{"n":2},"b":[1,2],"c":{"d":null},"e":"x","f":true,"g":1.5}' and [put[k] for k in range(1, 6)] == [None] * 5
