"""Operators on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import convert, graph, linkage as L, references as Refs, relational as R, search as S, temporal as V
from vellum.operators.components import connected_components
from vellum.sources import files
from vellum.streaming import sync


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_reach_handles_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in graph.reach(edges, seed).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in graph.focus_network(edges, seed).collect()} == {(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)}


def test_upsert_nulls_what_derives_from_a_change(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0)], "k long, text string, vec double")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, text string")
    assert {tuple(r) for r in R.upsert(t, s, ["k"], {"vec": "text"}).collect()} == {(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (4, "d", None)}


def test_visibility_is_two_valued(spark):
    rows = [("public", True, None, None), ("public", None, None, None), (None, None, "u", None), (None, None, None, "t"), ("private", True, "v", "t")]
    df = spark.createDataFrame(rows, "visibility string, listed boolean, creator string, token string")
    cols = [F.col(c) for c in df.columns]
    assert [r[0] for r in df.select(R.visible(*cols, "u", "t")).collect()] == [True, False, True, True, False]
    assert [r[0] for r in df.select(R.visible(*cols, None, None)).collect()] == [True, False, False, False, False]


def test_versions_and_scd2(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, at int").withColumn("at", F.timestamp_seconds("at"))
    v = V.versions(rows, "k", "at", "at")
    assert {(r.k) for r in V.as_of(v, F.timestamp_seconds(F.lit(2))).collect()} == {"a"}
    assert V.as_of(v, F.timestamp_seconds(F.lit(5))).count() == 2
    cur = spark.createDataFrame([("a", 1), ("b", 2)], "k string, val int").withColumn("valid_from", F.timestamp_seconds(F.lit(1)))
    hist = cur.limit(0).withColumn("valid_to", F.timestamp_seconds(F.lit(1)))
    new, old = V.scd2(cur, hist, spark.createDataFrame([("a", 1), ("c", 3)], "k string, val int"), "k", "val", F.timestamp_seconds(F.lit(9)))
    assert {(r.k, r.val) for r in new.collect()} == {("a", 1), ("c", 3)} and [r.k for r in old.collect()] == ["b"]


def test_query_parser():
    assert S.parse_query('café "two words" x') == {"any": False, "parts": [("phrase", ["two", "words"]), ("term", "caf"), ("prefix", "x")]}
    assert S.parse_query('x "two words"')["parts"] == [("phrase", ["two", "words"]), ("prefix", "x")]
    assert S.parse_query('"well-known fact" "one"')["parts"] == [("phrase", ["well", "known", "fact"]), ("prefix", "one")]
    assert len(S.parse_query("a b c d e f g h")["parts"]) == 6 and S.parse_query("  ")["parts"] == []


def test_text_similarities():
    assert L.similar_text("World", "Word") == pytest.approx(8 / 9) and L.similar_text("", "") == 0
    assert L.name_similarity("Jon Smith", "Smyth, John") == 0.5 and L.name_similarity("", "x") == 0
    assert L.offset_normalise("a [12]“b”  c") == ('a "b" c', [0, 1, 6, 7, 8, 9, 11])
    assert Refs.reference_keys("Smith and Jones 1999a; Other 2001") == ["smith1999a", "jonessmith1999a"] and Refs.reference_keys("Smith") == []
    assert Refs.reference_keys("Müller-Lüdenscheidt, K. (1987). On 1984") == ["mullerludenscheidt1987"]
    assert Refs.reference_keys("John Smith, Mary Jones (2001) Title")[:2] == ["smith2001", "john2001"]
    assert Refs.reference_keys("(2001)", "as argued by Adorno and Horkheimer ") == ["adorno2001", "adornohorkheimer2001"]
    assert Refs.reference_keys("WHO. Report. Geneva, 1999, reprinted 2004") == ["who2004"]


def test_blocks_and_markdown():
    assert convert.html_blocks("<title>t</title><div><p>a &amp; b</p><ul><li>c</li></ul><script>x</script></div>") == [("p", "a & b"), ("li", "c")]
    html = files.markdown_to_html("# T\n\npara **b**\n\n- x\n- y\n\n|a|b|\n|-|-|\n|1|2|\n\n```\n<\n```\n> q")
    assert [k for k, _ in convert.html_blocks(html)] == ["h1", "p", "li", "li", "td", "td", "td", "td", "pre", "blockquote"]
    assert files.ocr_to_markdown([{"lines": ["exam-"]}, {"lines": ["ple goes"]}, {"lines": ["on."]}, {"lines": ["New"]}]) == "example goes on.\n\nNew"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\ntext")
    (tmp_path / "b.json").write_text(json.dumps([{"lines": ["one"]}]))
    (tmp_path / "c.csv").write_text("x,id\n1,a\n2,b\n")
    assert {(r.type, r.plain) for r in files.read_documents(spark, str(tmp_path), "*.md", "markdown").collect()} == {("h1", "T"), ("p", "text")}
    assert [r.plain for r in files.read_documents(spark, str(tmp_path), "*.json", "ocr").collect()] == ["one"]
    assert {r.extension: r.files for r in files.directory_sizes(spark, str(tmp_path)).collect()} == {"md": 1, "json": 1, "csv": 1}
    assert files.read_csv(spark, str(tmp_path / "c.csv"), ["id"], ["gone"]).collect()[0].asDict() == {"id": "a", "gone": None}
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(tmp_path / "c.csv"), ["nope"])


def test_alignment_keeps_order(spark):
    old = spark.createDataFrame([(1, i, t) for i, t in enumerate(["alpha beta gamma", "delta epsilon zeta", "eta theta iota"])], "g long, pos long, text string")
    new = spark.createDataFrame([(1, 0, "new text"), (1, 1, "alpha beta gamma"), (1, 2, "delta epsilon zetas")], "g long, pos long, text string")
    assert [(r.old_pos, r.new_pos) for r in L.monotone_alignment(old, new, "g").orderBy("old_pos").collect()] == [(0, 1), (1, 2)]


def test_alignment_finds_blocks_behind_many_inserted_ones(spark):
    words = [f"own{i} words{i * 7} of{i * 13} block{i * 29}" for i in range(80)]
    edited = [t.upper() if i == 50 else f"{t} edited" if i == 60 else t for i, t in enumerate(words)]
    texts = [f"inserted {i * 31} before {i * 17}" for i in range(40)] + edited
    old = spark.createDataFrame([(1, i, t) for i, t in enumerate(words)], "g long, pos long, text string")
    new = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g long, pos long, text string")
    for a, b, shift in ((old, new, 40), (new, old, -40)):
        got = {r.old_pos: (r.new_pos, r.score) for r in L.monotone_alignment(a, b, "g").collect()}
        assert {i: j for i, (j, _) in got.items()} == {i + max(0, -shift): i + max(0, shift) for i in range(80)}
        assert [i + shift for i, (_, score) in got.items() if score < 1] == [60 + max(0, shift)]
    twice = spark.createDataFrame([(1, 0, "same text"), (1, 1, "same text"), (1, 2, None)], "g long, pos long, text string")
    assert [(r.old_pos, r.new_pos) for r in L.monotone_alignment(twice, twice, "g").orderBy("old_pos").collect()] == [(0, 0), (1, 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 7, float(i), f"p{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double, props string")
    for k in range(3):
        df.where(f"event_id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes = sync.read_changes(spark, str(tmp_path / "in"), df)
    q = sync.upsert_stream(changes, ["user_id"], "event_id", "value", "props", str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    last = max((p for p in (tmp_path / "t").iterdir()), key=lambda p: int(p.name[2:]))
    got = spark.read.parquet(str(last))
    assert {(r.user_id, r.value, r.event_id) for r in got.collect()} == {(r.user_id, r.value, r.event_id) for r in sync.coalesce_changes(df, ["user_id"], "event_id", "value", "props").collect()}


def test_metadata_scores():
    assert L.name_similarity("Jean-Paul Sartre", "SARTRE, J.") == 1.0 and L.name_similarity("Ng", "Ng") == 0.0
    assert L.title_similarity("The Order of Things", "order things") == pytest.approx((0.6 + 0.4 * L.similar_text("the order of things", "order things")))
    assert L.title_similarity("of the", "of the") == 0.0 and L.title_similarity("", "x") == 0.0
    assert L.authors_matched(["Smith, J.", "et al."], "Jane Smith; K. Jones") == 1.0 and L.authors_matched(["A. Smith", "B. Smith"], "Smith") == 0.5
    assert L.text_score("Nature", "Nature") == 1.0 and L.text_score("ab", "ab") == 0.0 and L.text_score("Nature", "xyzqk") == 0.0


def test_metadata_score_penalties(spark):
    rows = [(1.0, 1.0, 1.0, True, True, 0.9), (0.1, 1.0, 1.0, True, True, 0.0), (1.0, 0.0, 1.0, True, True, 0.0), (1.0, 0.0, 1.0, True, False, 0.65 * 0.85), (1.0, 0.25, 0.0, True, True, (0.55 + 0.0625) * 0.85), (1.0, 0.0, 0.0, False, True, 0.55 * 0.75), (1.0, 0.0, 0.0, False, False, 0.55)]
    df = spark.createDataFrame(rows, "t double, a double, y double, h boolean, c boolean, want double")
    got = df.select("want", L.metadata_score(F.col("t"), F.col("a"), F.col("y"), F.lit(0.0), F.lit(0.0), F.col("h"), F.col("c")).alias("got")).collect()
    assert all(r.got == pytest.approx(r.want) for r in got)


def test_record_linkage_equals_brute_force(spark, sf):
    from vellum.plans import registry

    rows = [(r.p_partkey, r.p_name, r.p_brand, r.p_size, r.p_type) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    want = {}
    for k, t, a, y, j in rows:
        for k2, t2, a2, y2, j2 in rows:
            title, author = L.title_similarity(t, t2), L.authors_matched([a], a2)
            if k != k2 and title >= L.TITLE_FLOOR and author:
                s = 0.55 * title + 0.25 * author + 0.1 * {0: 1.0, 1: 0.5}.get(abs(y - y2), 0.0) + 0.05 * L.text_score(j, j2)
                s = round(s * (0.7 + 0.6 * author if author < 0.5 else 1.0), 6)
                if s >= 0.5 and (-s, k2) < want.get(k, (0, 0)):
                    want[k] = -s, k2
    got = {r.cite: (-r.score, r.work) for r in registry.queries()["metadata_score_top1"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=2e-6) for k in want)


def test_citations_meet_references_by_key(spark):
    refs = spark.createDataFrame([(1, "b", "Smith, J. (1999). A title"), (2, "b", "Smith, J. and Jones, K. (1999a). Another"), (3, "b", "Weber, M. (1922)"), (4, "c", "Weber, M. (1920)"), (5, "b", None)], "rid long, book string, text string")
    cites = spark.createDataFrame([(1, "b", "Smith 1999"), (2, "b", "(Smith and Jones 1999a)"), (3, "b", "Weber 1923"), (4, "c", "Weber 1922"), (5, "b", "no year"), (6, "b", None), (7, "b", "Nobody 1950")], "cid long, book string, text string")
    got = {(r.cid, r.rid, r.offset) for r in Refs.link_citations(cites, refs, "cid", "rid", scope="book").collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, -1), (4, 4, -2)}
    assert Refs.link_citations(cites.limit(0), refs, "cid", "rid").count() == 0


def test_linked_citations_equal_brute_force(spark, sf):
    from vellum.plans import registry

    keys = sorted(r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect())
    got = {r.c_custkey: (r.s_suppkey, r.offset) for r in registry.queries()["linked_citations"](spark, sf).collect()}
    for c in (r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()):
        year = 1900 + (c + (c % 5 == 0)) % 100
        want = next(((s, o) for o in Refs.YEAR_OFFSETS for s in keys if s % 8 == c % 8 and 1900 + s % 100 == year + o), None)
        assert got.get(c) == want, c


def test_harvest_modes_and_unbounded_reach(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (None, 6), (5, None)], "src long, dst long")
    seed = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.harvest(edges, seed).collect()} == {(1, 0, None), (2, 1, 1), (3, 1, 1), (4, 2, 2), (5, 3, 4)}
    assert {r.node for r in graph.harvest(edges, seed, max_nodes=2).collect()} == {1, 2}
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert graph.reach(chain, start).count() == 21 and graph.reach(chain, start, max_depth=3).count() == 4
    with pytest.raises(RuntimeError):
        graph.reach(chain, start, limit=5)
    marked = spark.createDataFrame([(1, 2, "full"), (2, 3, "metadata_only"), (3, 4, "full"), (1, 5, "metadata_only"), (2, 5, "full"), (5, 6, "full"), (6, 1, "full")], "src long, dst long, mode string")
    got = graph.inherited_modes(marked, spark.createDataFrame([(1, "full")], "node long, mode string"))
    assert {tuple(r) for r in got.collect()} == {(1, "full"), (2, "full"), (3, "metadata_only"), (4, "metadata_only"), (5, "full"), (6, "full")}


def test_text_pieces():
    text = "One. Two is longer! " * 10 + "\n\n" + "x" * 130 + "\n\n短い。とても短い。"
    pieces = convert.text_pieces(text, 50)
    assert all(0 < len(p) <= 50 for p in pieces) and "".join("".join(pieces).split()) == "".join(text.split())
    assert convert.text_pieces("a\n\nb", 50) == ["a\n\nb"] and convert.text_pieces(None, 5) == [] and convert.text_pieces(" \n\n ", 5) == []


def test_waves_stop_at_the_first_that_resolves(spark):
    pool = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, "c", None)], "id long, doi string, title string")
    one = spark.createDataFrame([("a", 10, 1.0), ("b", 11, 0.4)], "key string, work long, score double")
    two = spark.createDataFrame([("x", 20, 0.6), ("x", 21, 0.9), ("x", 19, 0.9), ("y", 22, 0.5)], "key string, work long, score double")
    got = {(r.id, r.work, r.method, r.score) for r in L.resolve(pool, [("doi", "doi", one), ("title", "title", two)]).collect()}
    assert got == {(1, 10, "doi", 1.0), (2, 19, "title", 0.9), (3, 22, "title", 0.5)}
