"""Open copies, bodies and outgrown spans with odd rows."""

from vellum.operators import copies as C


def test_copies_are_ranked_and_kept_once(spark):
    rows = [
        (1, 0, "https://www.JSTOR.org/a/", "https://arxiv.org/abs/1", None, None, None), (1, 1, "http://www.jstor.org/a?x=1", None, "repository", "published", "cc-by"), (1, 2, "https://user@plain.org:80/f.pdf", "", None, "submittedVersion", "odd"),
        (1, 3, "https://plain.org/g", None, "journal", "AcceptedVersion", "public-domain"), (2, 0, None, None, None, None, None), (3, 0, "no address", None, "repository", None, None), (None, 0, None, "https://x.edu", None, None, None),
    ]
    df = spark.createDataFrame(rows, "work long, n int, pdf_url string, landing_page_url string, host_type string, version string, license string")
    got = [(r.work, r.place, r.url, r.host_class, r.score) for r in C.ranked_copies(df).orderBy("work", "place").collect()]
    assert got == [
        (None, 1, "https://x.edu", "repository", 202), (1, 1, "https://arxiv.org/abs/1", "repository", 202), (1, 2, "https://user@plain.org:80/f.pdf", "unknown", 112), (1, 3, "https://plain.org/g", "publisher", 17), (1, 4, "https://www.JSTOR.org/a/", "publisher", 12),
        (3, 1, "no address", "unknown", 112),
    ]
    assert C.ranked_copies(df.limit(0)).count() == 0


def test_bodies(spark):
    prose = "A sentence of the body, which goes on for a while and says what it says. " * 6
    blocks = [("few", prose), ("few", "short"), ("code", ".buybox { color: red; } " * 60), ("refs", "Ostrom, E. (1990). " + prose), ("refs", prose + "doi: 10.1/x"), ("full", prose), ("full", prose), ("none", None), (None, prose * 30)]
    df = spark.createDataFrame(blocks, "doc string, text string")
    got = {r.doc: (r.prose_blocks, r.verdict) for r in C.body_verdict(df, "doc", "text", "web").collect()}
    assert got == {"few": (1, "absent"), "code": (0, "absent"), "refs": (0, "absent"), "full": (2, "present"), "none": (0, "absent"), None: (1, "present")}
    assert {r.doc for r in C.body_verdict(df, "doc", "text").where("verdict = 'present'").collect()} == {None}


def test_outgrown_spans(spark):
    nodes = spark.createDataFrame([("b", "n1", "12345", None), ("b", "n2", "123", "<p>"), ("b", "n3", "1", "<latex>"), ("b", "n4", None, None), ("c", "n1", "1", None)], "book string, node string, text string, content string")
    items = [
        (1, "b", ["n1", "n2"], {"n1": 4, "n2": 3}), (2, "b", ["n1", "n2"], {"n1": 5, "n2": 9}), (3, "b", ["n2"], {"n2": 99}), (4, "b", ["n1", "n3", "n4", "gone", "n2"], {"n1": 9, "n3": 9, "n4": 9, "gone": 9}), (5, "b", ["n1", "n2"], None), (6, "b", None, None), (7, "c", ["n1", "n2"], {"n1": 1, "n2": 0}),
    ]
    df = spark.createDataFrame(items, "item long, book string, node_ids array<string>, starts map<string,long>")
    got = {r.item: (r.node_ids, r.starts) for r in C.pruned_spans(df, nodes).collect()}
    assert got[1] == (["n1"], {"n1": 4}) and got[2] == items[1][2:] and got[3] == items[2][2:]
    assert got[4] == (["n3", "n4", "gone", "n2"], {"n3": 9, "n4": 9, "gone": 9}) and got[5] == items[4][2:] and got[6] == items[5][2:] and got[7] == (["n2"], {"n2": 0})
