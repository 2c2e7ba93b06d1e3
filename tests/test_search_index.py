"""The term index against a scan of tokens, after upserts, deletions and merges; pages of results and headlines against loops."""

import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.operators import ranking, search as S
from vellum.operators.commits import Commits
from vellum.operators.relational import string_tokens
from vellum.operators.termindex import TermIndex

WORDS = "run running runs dying die license licensed licensing the a of under apache house houses dyer x_1 42".split()
QUERIES = ["running", '"the house"', '"the the a"', "licens", "d", "dy", "license the", '"under the apache" run', "nothing", "", "zz die", '"a"', "x_1 42"]


def documents(seed, ids):
    rng = random.Random(seed)
    return [(i, None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 5, 40])))) for i in ids]


def scan(spark, rows, text, any_):
    query = S.parse_query(text, any_)
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("text"))
    assert docs.where(S.matches(string_tokens(F.col("text")), query) & ~S.possible(F.col("text"), query)).count() == 0
    return {r.id for r in docs.where(S.matches(string_tokens(F.col("text")), query)).collect()}


def test_index_equals_a_scan_after_changes(spark):
    folder = tempfile.mkdtemp()
    index = TermIndex(spark, folder)
    now = dict(documents(1, range(60)))
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    index.build(frame([*now.items(), (None, "the house")]), "id", F.col("text"), buckets=16)
    for step in range(3):
        if step:
            new = documents(10 + step, range(40 * step, 40 * step + 30))
            gone = [(k,) for k in range(step, 60, 7) if k not in dict(new)]
            index.upsert(frame(new), "id", F.col("text"), deleted=spark.createDataFrame(gone, "id long"))
            now = {k: v for k, v in now.items() if (k,) not in gone} | dict(new)
        for text in QUERIES if step != 1 else QUERIES[:3]:
            for any_ in (False, True):
                got = [r.doc for r in index.search(S.parse_query(text, any_)).collect()]
                assert len(got) == len(set(got)) and set(got) == scan(spark, [(k, v) for k, v in now.items()], text, any_), (step, text, any_)
    index.merge()
    assert len(index.log.last()["segments"]) == 1
    assert {r.doc for r in index.search(S.parse_query('"the house"')).collect()} == scan(spark, list(now.items()), '"the house"', False)
    with pytest.raises(ValueError):
        index.build(frame([]), "id", F.col("text"))


def test_a_search_reads_the_folders_of_its_terms(spark):
    index = TermIndex(spark, tempfile.mkdtemp())
    index.build(spark.createDataFrame(documents(2, range(40)), "id long, text string"), "id", F.col("text"), buckets=64)
    query = S.parse_query('"under the apache"')
    assert len(index.buckets_of(query)) <= 3
    read = {f.rsplit("/", 2)[1] for f in index.search(query).inputFiles()}
    assert read <= {f"bucket={b}" for b in index.buckets_of(query)}
    assert len(index.buckets_of(S.parse_query("d"))) == 64
    assert set(index.buckets_of(S.parse_query("dyi"))) >= set(index.buckets_of({"any": False, "parts": [("term", "dying")]}))


def test_stems_where_no_word_matches(spark):
    index = TermIndex(spark, tempfile.mkdtemp())
    rows = [(1, "he runs home"), (2, "the run"), (3, "dying houses"), (4, "running")]
    index.build(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), buckets=8)
    stage = lambda word: {(r.doc, r.stage) for r in index.cascade({"any": False, "parts": [("term", word)]}).collect()}
    assert stage("running") == {(4, "exact")}
    assert stage("die") == {(3, "stemmed")} and stage("house") == {(3, "stemmed")} and stage("none") == set()
    phrase = index.search({"any": False, "parts": [("phrase", ["he", "running"])]}, stemmed=True)
    assert {r.doc for r in phrase.collect()} == {1}


def test_index_of_nothing(spark):
    index = TermIndex(spark, tempfile.mkdtemp())
    index.build(spark.createDataFrame([], "id long, text string"), "id", F.col("text"), buckets=4)
    assert index.search(S.parse_query("word")).count() == 0 and Commits(spark, index.log.folder).last()["commit"] == 0


def test_postings_of_a_term_share_rows_and_rows_of_one_id_count_together(spark, monkeypatch):
    from vellum.operators import termindex

    rows = [*documents(3, range(30)), *documents(4, range(10, 20)), (None, "the house"), (40, "Éa b\u0130a  B"), (41, "")]
    df = termindex.postings(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", F.col("text"))
    got, terms = Counter(), Counter()
    for r in df.collect():
        terms[r.term] += 1
        assert r.stem == ranking.stem_word(r.term) and len(r.docs) == len(r.positions)
        got.update((r.term, d, p) for d, ps in zip(r.docs, r.positions, strict=True) for p in ps)
    want = Counter((t, d, at) for d, text in rows if d is not None for at, t in enumerate(re.findall("[a-z0-9_]+", (text or "").lower()), 1))
    assert got == want and max(terms.values()) <= df.rdd.getNumPartitions()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    index = TermIndex(spark, tempfile.mkdtemp())
    index.build(spark.createDataFrame([(1, "the"), (1, "a house"), (2, "the house"), (2, "the")], "id long, text string"), "id", F.col("text"), buckets=4)
    for _ in range(2):
        assert sorted(r.doc for r in index.search(S.parse_query("the house")).collect()) == [1, 2]
        assert sorted(r.doc for r in index.search(S.parse_query('"the house"')).collect()) == [1, 2]
        index.merge()


def plain_headline(text, words, most=35, least=15):
    tokens = (text or "").split()
    hit = [re.sub(r"\W", "", t).lower() in words for t in tokens]
    if not any(hit):
        return " ".join(tokens[:least])
    starts = range(max(1, len(tokens) - most + 1))
    at = max(starts, key=lambda i: (sum(hit[i : i + most]), -i))
    return " ".join(f"<mark>{t}</mark>" if h else t for t, h in zip(tokens[at : at + most], hit[at : at + most], strict=True))


def test_headlines_and_pages_equal_loops(spark):
    rng = random.Random(5)
    texts = [(k, None if k == 7 else " ".join(rng.choices(["the", "The,", "license", "river", "of", "stone"], weights=[1, 1, 1, 9, 9, 9], k=rng.choice([3, 20, 90])))) for k in range(60)]
    books = ["b1", "b2/HL_1", "b2/Fn2", "b3", "gone", "own", "deleted", "b2"]
    nodes = spark.createDataFrame([(k, books[k % 8], t) for k, t in texts], "node long, book string, text string")
    library = spark.createDataFrame(
        [("b1", "One", "public", True, None, None), ("b2/HL_1", "Two H", "public", True, None, None), ("b2/Fn2", "Two F", None, True, "me", None), ("b3", None, "public", False, "you", "t"), ("own", "Own", "private", False, "me", None), ("deleted", "D", "deleted", True, "me", None), ("b2", "Two", "private", True, "you", None)],
        "book string, title string, visibility string, listed boolean, creator string, creator_token string",
    )
    words = ["the", "license"]
    hits = nodes.where(F.col("text").contains("license")).select("node")
    page = S.node_page(hits, nodes, library, words, 10, user="me", token="t").collect()
    ranks = {r.node: r.rank for r in nodes.select("node", F.round(ranking.cover_rank(F.col("text"), words), 6).alias("rank")).collect()}
    readable = {"b1", "b2/HL_1", "b3", "own"}
    want = sorted((k for k, t in texts if "license" in (t or "") and books[k % 8] in readable), key=lambda k: (-ranks[k], k))[:10]
    assert sorted(r.node for r in page) == sorted(want)
    for r in page:
        assert r.rank == ranks[r.node] and r.headline == plain_headline(dict(texts)[r.node], words)
        assert (r.is_subbook, r.parent_book, r.parent_title) == ("/" in r.book, r.book.split("/")[0], "Two" if "/" in r.book else None)
    grouped = S.grouped_by_book(S.node_page(hits, nodes, library, words, 10, user="me", token="t")).collect()
    assert [h.node for g in grouped for h in g.hits if g.book == "b1"] == [k for k in want if books[k % 8] == "b1"]
    assert [g.best for g in grouped] == sorted((g.best for g in grouped), reverse=True)
    assert {r.book for r in S.node_page(hits, nodes, library, words, 50).collect()} <= {"b1", "b2/HL_1"}
