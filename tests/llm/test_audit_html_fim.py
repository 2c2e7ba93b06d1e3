"""Filter audit, main text of pages and fill-in-middle against plain versions, with odd rows among the input."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

pytest.importorskip("vellum.llm")

from vellum.llm import filteraudit, fim, htmltext  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, part string, n long, row string, form string, A int, key string, toxic int"


def odd_rows():
    rng = random.Random(3)
    words = [w + str(i) for i in range(60) for w in ("alpha", "beta", "Gamma", "DELTA")]
    texts = ["", None, "x", "A B", " \t\n", "a#b", "é ü 漢字 😀", "<P>", "p<S>", "q<M>r", "<P", "S>", "one\r\ntwo\x0bthree", "w " * 30000]
    texts += [" ".join(rng.choices(words[: rng.choice([3, 40, 240])], k=rng.choice([20, 199, 200, 420]))) for _ in range(40)] + [" ".join(words).lower()] * 3
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (20, "another text of this id", "en"), (None, texts[21], "en"), (None, None, None), (None, None, None), (100, texts[21], "de"), (-5, texts[22], "fr"), (-5, texts[22], "fr")]
    return [(*r, "p", 7, "r", "f", 1, "k", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 3)] + [(3, 1, None), (20, 0, 0), (20, 1, 1), (None, 1, 1), (None, 1, 1), (999, 1, 1), (6, None, None)]


def audit_rows(rows, labels):
    """Every order applied row by row."""
    kinds = []
    for doc, text, lang, *_ in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        copy = doc is not None and any(o[0] is not None and o[0] < doc and (o[1] or "") == t for o in rows)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        good, toxic = (any(x[0] == doc and x[k] == 1 for x in labels) for k in (1, 2))
        kinds.append((lang or "", {k for k, b in zip("ABCDE", bad) if b}, doc is not None and good, doc is not None and toxic))
    found, shapley = {}, Counter()
    for part in {k[0] for k in kinds}:
        mine = [k for k in kinds if k[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in k[1]]
                left = [k for k in left if f not in k[1]]
                failing = [k for k in mine if f in k[1]]
                found[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(k[1] == {f} for k in mine), sum(k[2] for k in gone), sum(k[3] for k in gone)]
                shapley[part, f] += len(gone)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in found.items()}


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_every_order_applied(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filteraudit.audit(docs, labels).select(AUDIT).collect()]
    assert len(got) == len(set(got)) == 600 * 4
    assert set(got) == audit_rows(odd_rows(), LABELS)


def test_audit_of_no_rows_and_no_labels(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(empty, labels).count() == 0
    assert filteraudit.audit(docs, labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_audit_of_other_filters(spark):
    flags = spark.createDataFrame([("p", 1, 1, 2), ("p", 1, 0, 3), ("p", None, 1, 5), ("q", 0, 0, 1)], "part string, X int, Y int, w int")
    joint = filteraudit.joint_failures(flags, "XY", {"n": F.lit(1), "w": F.col("w")})
    assert {r.part: (r.n, r.w) for r in joint.collect()} == {"p": ([3, 2, 2, 1], [10, 5, 7, 2]), "q": ([1, 0, 0, 0], [1, 0, 0, 0])}
    rows = {(r.part, r.filter_order, r.step): r for r in filteraudit.audit_orders(joint, "XY", lost={"weight": "w"}).collect()}
    assert rows["p", "YX", 2][3:] == (0, 1, 1, 1, 3, 3)
    assert rows["q", "XY", 1][3:] == (1, 0, 0, 0, 0, 0)


BODY = "<h1>Title</h1><p>The first paragraph, long enough that a window of lines surges above all else on the page.</p>"
PAGES = {
    None: "",
    "": "",
    "   \n ": "",
    "just text &amp; no markup": "just text & no markup",
    "<p>a<b>b</b>\n\t c&nbsp;&nbsp;d<br>e</p>": "ab c d e",
    "<p>&lt;p&gt; &#65;&#x42; &copy; &am &unknown; &amp;lt;</p>": "<p> AB © &am &unknown; &lt;",
    f"<html><head><title>no</title><style>p{{}}</style></head><body><nav><a href=x>menu</a></nav><article>{BODY}</article><footer>foot</footer></body></html>": "Title The first paragraph, long enough that a window of lines surges above all else on the page.",
    "<article><p>in</p></article><p>A long text outside of the article, which is no part of it although it surges as well, doesn't it?</p>": "in",
    "<main><div class='sidebar'>side</div><p>x</p><aside>y</aside><form>z<input></form><p>w</p></main>": "x w",
    "<article>a<div class='ad'>b<div>c</div>d</div>e<section id='comments'><article class='comment'>f</article></section><p>g": "a e g",
    "<article><p>one<p>two<ul><li>three<li>four</ul><table><tr><td>5<td>6</table></article>": "one two three four 5 6",
    "<article>a<script>var t='</p>x';</script>b<!-- c -->d<noscript>e</noscript></article>": "abd",
    "<article>kept<script>never closed": "kept",
    "<article>kept<!-- never closed <p>x</p>": "kept",
    "<article>kept<p class='x": "kept",
    "<article>a < b and c > d <3</article>": "a < b and c > d <3",
    "<article><p title='a>b' data-x=it's>it's</p><p title=\"<i>\">c</p></article>": "it's c",
    "<article><header><h2>T</h2></header><p>x</p></article><header>site</header>": "T x",
    "<article><div class='entry-header'><h2>T</h2></div><section id='discussion'>d</section><section id='related-work'>r</section><div class='related-posts'>no</div><ins class='adsbygoogle'>no</ins></article>": "T d r",
    "<div class='site-header'>no</div><div class='post'><header class='post-header'><h1>T</h1></header><p>body of it</p><p class='notice'>no<p>more</div>": "T body of it more",
    "<article>" + "<div>" * 3000 + "deep" + "</div>" * 2000 + "</article>": "deep",
    f"<div id='menu'><a href=a>A</a> <a href=b>B</a></div><div class='txt'>{BODY}<div class='ad-box'>buy</div><p>Short.</p></div><div>© 2020</div><div>x</div>": "Title The first paragraph, long enough that a window of lines surges above all else on the page. Short. © 2020 x",
    f"<body class='has-sidebar'><div class='cookie-notice'>We use cookies, and say so at such a length that this line alone would surge, as it should not.</div><div class='post-content'>{BODY}<p>End.</p></div><div class='comments'>No!</div></body>": "Title The first paragraph, long enough that a window of lines surges above all else on the page. End.",
}


@pytest.mark.parametrize("page", list(PAGES))
def test_main_text(page):
    assert htmltext.main_text(page) == PAGES[page]


def test_runs_surge_and_dive():
    assert htmltext._runs([0, 5, 0, 0, 4, 0, 0, 0, 9, 0], 3) == [(1, 5, 5), (8, 9, 9)]
    assert htmltext._runs([], 3) == []
    assert htmltext._runs([0, 0, 0, 0], 3) == []


@pytest.mark.parametrize("junk", ["<", "<a ", "<div>", "</p>", "<!--", '<p a="', "<a b='", "<li>", "<div class='ad'>", "&", "<article>", "<script>"])
def test_broken_markup_ends(junk):
    assert isinstance(htmltext.main_text(junk * 30_000), str)


def test_extract_keeps_rows_and_columns(spark):
    rows = [(i, f"u{i}", page, "t", "r", 3) for i, page in enumerate(PAGES)] + [(None, None, "<p>x", None, None, None), (1, "u1", "", "t", "r", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row string, n_chars int").repartition(3)
    got = htmltext.extract(pages)
    want = Counter((i, u, t, r, n, PAGES.get(h, "x"), len(PAGES.get(h, "x"))) for i, u, h, t, r, n in rows)
    assert Counter(tuple(r) for r in got.select("row.page_id", "row.url", "row.text", "row.row", "row.n_chars", "text", "n_chars").collect()) == want
    assert htmltext.extract(pages.limit(0)).count() == 0


def cut(doc, text):
    """The stated transformation with slices."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_slices(docs, empty):
    want = Counter((r[0], *cut(r[0], r[1])) for r in odd_rows())
    made = fim.fill_in_middle(docs)
    assert Counter(tuple(r) for r in made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()) == want
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    digests = fim.fill_in_middle(docs, digests=True).select("row.doc_id", "row.form", "output_sha256", "restored_sha256")
    assert Counter(tuple(r) for r in digests.collect()) == Counter((r[0], "f", sha(cut(r[0], r[1])[4]), sha(r[1])) for r in odd_rows())
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM \n😀", max_size=40), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4), st.sampled_from([fim.CODE_POINT, r"\w+", r"[^\n]*\n?", "zz"]))
def test_any_unit_round_trips(text, h, unit):
    pattern = re.compile(unit)
    n, form, output, prefix, middle = fim.transform(text, h, pattern)
    assert n == len(pattern.findall(text))
    assert fim.restore(output, form) == text
    assert (form == "plain") == (prefix is None)
    if form != "plain":
        ends = [0, *(m.end() for m in pattern.finditer(text))]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        assert prefix == (len(text) if a == n and n == b else ends[a])
        assert prefix + middle == (len(text) if b == n else ends[b])


def test_matches_are_not_kept():
    import tracemalloc

    text = "x" * 1_000_000
    tracemalloc.start()
    fim.n_units(re.compile(fim.CODE_POINT).finditer(text))
    fim.offsets(text, re.compile(fim.CODE_POINT), 400_000, 900_000)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
