"""Queries over tables with large groups: rows that their joins make, halves, copies; each against its SQL or a loop."""

import os
import re
from collections import Counter

import duckdb
import pytest

from vellum.plans import registry


def tables(tmp_path, **made) -> str:
    """A folder with the tables that the SQL makes."""
    for name, sql in made.items():
        duckdb.connect().execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def rows_by_sql(folder: str, name: str) -> Counter:
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS FROM '{folder}/{file}'")
    return Counter(con.execute(registry.oracle_sql()[name]).fetchall())


def joined_rows(df) -> int:
    """Rows that the joins of a plan gave, most of one, after it ran."""

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        mine = node.metrics().apply("numOutputRows").value() if name.endswith("JoinExec") else 0
        return max([mine, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_halves_round_to_even_and_rows_of_an_event_count_together(spark, tmp_path):
    d = tables(tmp_path, events="SELECT unnest([1, 2, 2, 3, 4])::BIGINT AS event_id, unnest([0.25, 0.35, 0.05, NULL, 9]) :: DOUBLE AS value", documents="SELECT i AS doc_id, 3::BIGINT AS n_chars FROM range(4) t(i)")
    got = registry.queries()["stale_span_pruning"](spark, d)
    assert Counter(tuple(r) for r in got.collect()) == rows_by_sql(d, "stale_span_pruning") == Counter([(1, 2), (2, 4), (3, 1)])


def test_pointers_meet_a_row_for_each_key(spark, tmp_path):
    customers = "SELECT i * 50 + 1 AS c_custkey, 3 AS c_nationkey FROM range(60) t(i) UNION ALL SELECT 2, 3 UNION ALL SELECT 4, 3 UNION ALL SELECT 4, 5"
    parts = "SELECT i AS p_partkey, 'Brand#3' AS p_brand, 1 AS p_size FROM range(60) t(i) UNION ALL SELECT 100, 'Brand#3', 2 UNION ALL SELECT 101, 'Brand#3', 4 UNION ALL SELECT 102, 'Brand#5', 4"
    d = tables(tmp_path, customer=customers, part=parts)
    df = registry.queries()["pointer_unique_match"](spark, d)
    assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(d, "pointer_unique_match") == Counter([(2, 100)])
    assert joined_rows(df) <= 63


def test_citations_meet_one_reference_for_each_key(spark, tmp_path):
    d = tables(tmp_path, supplier="SELECT i * 200 AS s_suppkey, 'S' AS s_name FROM range(60) t(i)", customer="SELECT i * 200 AS c_custkey FROM range(1, 60) t(i)")
    df = registry.queries()["linked_citations"](spark, d)
    got = {(r.c_custkey, r.s_suppkey, r.offset) for r in df.collect()}
    assert got == {(i * 200, 0, -1) for i in range(1, 60)}
    assert joined_rows(df) <= 59 * 7


def test_blocks_of_notes_are_dealt_by_their_number(spark, sf, monkeypatch):
    from vellum import session
    from vellum.plans import notes

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert notes._blocks(spark, sf).rdd.getNumPartitions() == -(-lines // 500)


def test_sections_follow_stretches_with_notes(spark):
    import random

    from vellum.operators import notes

    rng = random.Random(3)
    rows = [(doc, at, *rng.choice([("block", True), ("block", False), ("block", False), ("heading", False), ("rule", False)])) for doc in range(30) for at in range(20)]
    want = {}
    for doc in range(30):
        section, noted = 0, False
        for _, at, kind, definition in (r for r in rows if r[0] == doc):
            if kind != "block":
                section, noted = section + noted, False
            noted |= definition
            want[doc, at] = section
    got = notes.sectioned(spark.createDataFrame(rows, "doc long, at long, kind string, definition boolean"), "doc").collect()
    assert {(r.doc, r.at): r.section for r in got} == want


def test_titles_meet_by_long_pieces(spark):
    from vellum.operators import resolution

    titles = [f"Large ring of volume {k}" for k in range(1000, 1600)]
    works = spark.createDataFrame(list(enumerate(titles)), "work long, title string")
    entries = spark.createDataFrame([(k, t.upper()) for k, t in enumerate(titles)] + [(-1, "ume 1"), (-2, "zz"), (-3, titles[0] + ": a study"), (-4, "volume 11")], "entry long, title string")
    df = resolution.title_candidates(entries, works, "title")
    got = Counter((r.entry, r.work) for r in df.collect())
    want = [(k, k) for k in range(600)] + [(-1, k) for k in range(600)] + [(-4, k) for k in range(100, 200)]
    assert got == Counter(want)
    assert joined_rows(df) < 5_000


def test_works_alike_are_compared_once(spark, tmp_path):
    d = tables(tmp_path, part="SELECT i AS p_partkey, ['red ring', 'blue bolt'][1 + i % 2] AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, (10 + i % 3)::INT AS p_size FROM range(120) t(i) UNION ALL SELECT 5, 'red ring', 'Brand#1', 'SMALL', NULL")
    df = registry.queries()["metadata_score_top1"](spark, d)
    got = {r.cite: (r.work, r.score) for r in df.collect()}
    least = lambda k: next(w for w in range(120) if w != k and w % 6 == k % 6)  # noqa: E731  of its title and year
    assert len(got) == 120 and all(got[k] == (least(k), 0.95) for k in range(120) if k != 5)
    assert joined_rows(df) < 1_000


def test_copies_of_parts_are_dealt_by_their_number(spark, sf, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    assert registry.queries()["open_copies"](spark, sf).rdd.getNumPartitions() == -(-6 * parts // 100)


def test_indexes_are_made_within_their_rows(spark, sf, tmp_path):
    d = tables(tmp_path, documents="SELECT unnest([1, 1, 2, 3, 4])::BIGINT AS doc_id, unnest(['b a  b', 'c', NULL, ' ', 'x' || chr(10) || 'y x é \"q\" x']) AS text")
    df = registry.queries()["abstracts_from_json"](spark, d)
    assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(d, "abstracts_from_json")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_dealt_once_and_ranges_hand_on_at_their_edges(spark, monkeypatch):
    import random

    from vellum.operators import ocr, scan
    from vellum.session import cut

    cuts = []
    monkeypatch.setattr(scan, "cut", lambda df: cuts.append(1) or cut(df))
    rng = random.Random(5)
    rows = [(book, k, rng.choice([None, k])) for book, n in ((None, 40), (1, 300), (2, 3), (3, 1), (4, 90)) for k in range(n)]
    want, latest, total = {}, {}, Counter()
    for book, k, v in rows:
        want[book, k] = latest.get(book), total[book]
        latest[book], total[book] = v if v is not None else latest.get(book), total[book] + k
    df = scan.ranged(spark.createDataFrame(rows, "book long, page long, v long"), "book", ["page"])
    once = scan.carried(df, "book", ["page"], {"was": df["v"]})
    got = scan.carried(once, "book", ["page"], sums={"upto": once["page"]}).collect()
    assert {(r.book, r.page): (r.was, r.upto) for r in got} == want and len(got) == len(rows) and len(cuts) == 1
    ocr.assemble(spark.createDataFrame([(1, 1, "A page.", None, None)], "book long, page long, markdown string, footer string, style string"))
    assert len(cuts) == 2


def test_ranks_count_words_without_tokens(spark, tmp_path):
    texts = "'the ' || repeat('License, ', 300)", "'The_license the-LICENSE'", "''", "NULL", "'thé license2 licens'", "repeat('the.', 300)"
    d = tables(tmp_path, documents=" UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, {t} AS text, {s} AS source" for i, (t, s) in enumerate(zip(texts, ["'the src'", "NULL", "'license the the'", "''", "'x'", "repeat('the ', 260)"]))))
    df = registry.queries()["any_rank"](spark, d)
    got, want = {r.doc_id: r.rank for r in df.collect()}, dict(rows_by_sql(d, "any_rank").keys())
    assert got.keys() == want.keys() == {0, 1, 2, 5} and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("1.64493406685") == 1  # made once for all words, not again in a filter


def test_texts_are_dealt_by_id_and_words_counted_there(spark, monkeypatch):
    from vellum.operators import ranking

    monkeypatch.setattr(ranking, "TEXT_ROWS", 10)
    docs = spark.createDataFrame([(k, "Running runs, the runner ran " * (k % 3)) for k in range(100)] + [(1, "runs"), (2, None)], "doc long, text string")
    got = {(r.doc, r.stem): r.n for r in ranking.stemmed(docs, "doc", docs["text"]).collect()}
    want = Counter((k, ranking.stem_word(w)) for k in range(100) for w in ["running", "runs", "the", "runner", "ran"] * (k % 3))
    assert got == want + Counter([(1, "run")])
    assert ranking.dealt_texts(docs, "doc").rdd.getNumPartitions() == 11


def test_only_words_that_claims_ask_for_are_indexed(spark, monkeypatch):
    from vellum.operators import passages

    kept, write = {}, passages.written
    monkeypatch.setattr(passages, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    claims = spark.createDataFrame([(1, "a", "The lamps of it")], "claim long, book string, text string")
    nodes = spark.createDataFrame([("a", 1, "A lamp, lamps and other words"), ("a", 2, "nothing of it")], "book string, node long, text string")
    assert [(r.claim, r.node, r.stage) for r in passages.claim_passages(claims, nodes).collect()] == [(1, 1, "all")]
    assert {(r.node, r.word, r.stem, r.at) for r in kept["passage-terms"].collect()} == {(1, "lamp", "lamp", 2), (1, "lamps", "lamp", 3)}


def dealt(df) -> Counter:
    """The keys by which a plan deals rows, and over how many partitions."""
    found = re.findall(r"RepartitionByExpression \[([^\]]*)\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    return Counter((re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in found)


def test_edges_of_works_are_dealt_by_their_number(spark, sf, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    df = registry.queries()["most_cited"](spark, sf)
    assert dealt(df) == Counter({("l_orderkey", n): 1, ("o_orderkey", n): 1})
    assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(sf, "most_cited")


def test_numbers_on_pages_are_dealt_by_their_number(spark, sf, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    n, n_orders = (-(-spark.read.parquet(f"{sf}/{t}.parquet").count() // 500) for t in ("lineitem", "orders"))
    df = registry.queries()["page_signals"](spark, sf)
    assert dealt(df) == Counter({("l_orderkey", n): 2, ("o_orderkey", n): 2, ("book, l_partkey", n): 1, ("book", max(n_orders, spark.sparkContext.defaultParallelism)): 1})
    assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(sf, "page_signals")


def test_blocks_of_bibliographies_are_dealt_by_their_number(spark, sf, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "TASK_ROWS", 1_000)
    n = -(-6 * spark.read.parquet(f"{sf}/orders.parquet").count() // 1_000)
    df = registry.queries()["bibliography_entries"](spark, sf)
    assert dealt(df) == Counter({("doc", n): 3})
    assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(sf, "bibliography_entries")


def test_citing_texts_are_dealt_and_each_key_meets_one_reference(spark, tmp_path, monkeypatch):
    from vellum import session

    monkeypatch.setattr(session, "TASK_ROWS", 40)
    supplier = "SELECT i AS s_suppkey, 1 AS s_nationkey, 'S' AS s_name FROM range(600) t(i)"
    d = tables(tmp_path, supplier=supplier, customer="SELECT i AS c_custkey, 1 AS c_nationkey FROM range(400) t(i)")
    for name in ("in_text_links", "linked_texts"):
        df = registry.queries()[name](spark, d)
        assert dealt(df)["doc, pos", 10] >= 1
        assert Counter(tuple(r) for r in df.collect()) == rows_by_sql(d, name)
        assert joined_rows(df) <= 3_000
    plan = registry.queries()["in_text_links"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [cited") == 1


def test_only_links_that_name_a_book_look_its_work_up(spark):
    from vellum.operators import graph

    library = spark.createDataFrame([("a", ""), ("b", "w"), ("c", None)], "book string, canonical_id string")
    listed = [("a", "w", "c", True), ("a/Fn1", "", "b", False), ("a", None, None, True), (None, "w", None, True)] + [("c", "v", "a", False)] * 50 + [("c", None, None, None)] * 50
    notes = [("b", True, "a"), ("a", True, None), ("c", False, "a"), ("gone", True, "a")]
    df = graph.layers(spark.createDataFrame(listed, "book string, canonical_id string, foundation string, verified boolean"), spark.createDataFrame(notes, "book string, is_citation boolean, foundation string"), spark.createDataFrame([("c", ["/b/2#x", "", "https://e.org/c?q"])], "book string, cited_in array<string>"), library)
    want = {("a", "w", "citation_verified"), ("a", "w", "citation_auto"), ("c", "v", "citation_auto"), ("w", "a", "citation_auto"), ("c", "w", "hypercite")}
    assert Counter(tuple(r) for r in df.collect()) == Counter(want)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
