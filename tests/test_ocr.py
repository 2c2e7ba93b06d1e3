"""Pages to text and notes against a loop over pages, on hand-made pages and on books cut into pages at random."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import ocr as O, scan


@pytest.mark.parametrize(
    "text, want",
    [
        ("as said¹ and ¹², too", "as said[^1] and [^12], too"),
        ("sums $^{5}$ $^5$ $^{1, 2}$ x^2y a^23 b^{2}", "sums [^5] [^5] [^1][^2] x^2y a[^23] b^{2}"),
        ("[^4] stays", "[^4] stays"),
    ],
)
def test_markers(text, want):
    assert O.marked(text) == want


def test_ends_of_paragraphs():
    assert O.mid_sentence("[^12] See the account of some major") and O.mid_sentence("of some <i>major</i> [^3]")
    assert not any(map(O.mid_sentence, ["It ends.", "pp. 505-507", "", "of (some)", "OF SOME"]))
    assert O.goes_on("a long line that is broken in the mid-") == "" and O.goes_on("a long line that goes on and[^3]") == " "
    assert [O.goes_on(t) for t in ("A short line", "# A heading of some length", "---", "| a | row of | cells |", "A line that ends its sentence.", "")] == [None] * 6


def test_notes_at_the_bottom():
    page = "Body[^3] text[^4].\n\n3 First note\n4. second note"
    assert O.bottom_notes(page) == "Body[^3] text[^4].\n\n[^3]: First note\n[^4]: second note"
    assert O.bottom_notes("Body with 1 list\n\n1. one\n2. two") == "Body with 1 list\n\n1. one\n2. two"
    assert O.bottom_notes("Body[^2].\n\n5 Five\n2 Two") == "Body[^2].\n\n5 Five\n[^2]: Two"


def plain(pages, style):
    """One book, page after page: [(kind, n, page, number, text)]."""
    rows, open_, body, notes, counter = [], False, [], [], 0
    for page, markdown, footer in sorted(pages, key=lambda p: p[0]):
        paragraphs, numbers = O.page_paragraphs(markdown or "", footer or "", style)
        anew = {n: str(counter + k) for k, n in enumerate(numbers, 1)} if style == "page_bottom" else {}
        counter += len(anew)
        renamed = lambda t: re.sub(O.NOTE, lambda m: f"[^{anew.get(m[1], m[1])}]", t)  # noqa: B023, E731
        if style == "page_bottom":
            open_ = False
        for text, opens in paragraphs:
            lower = text.lstrip()[:1].islower()
            if opens:
                number = re.match(rf"\s*{O.NOTE}", text)[1]
                notes.append([page, anew.get(number, number), renamed(re.sub(rf"^\s*{O.NOTE}[:.]?\s*", "", text))])
                open_ = True if style == "page_bottom" else O.mid_sentence(text)
            elif open_ and (lower or style == "page_bottom"):
                notes[-1][2] = notes[-1][2].rstrip() + " " + renamed(text).lstrip()
                open_ = True if style == "page_bottom" else O.mid_sentence(text)
            else:
                open_ = False
                joint = O.goes_on(body[-1][1]) if body and lower else None
                if joint is None:
                    body.append([page, text, renamed(text)])
                else:
                    was = re.sub(r"-\s*$", "", body[-1][2]) if joint == "" else body[-1][2].rstrip() + " "
                    body[-1] = [body[-1][0], text, was + renamed(text).lstrip()]
    rows += [("body", n, page, None, text) for n, (page, _, text) in enumerate(body, 1)]
    return sorted([*rows, *(("note", n, page, number, text) for n, (page, number, text) in enumerate(notes, 1))], key=str)


def got(spark, books):
    rows = [(b, p, m, f, s) for b, (s, pages) in books.items() for p, m, f in pages]
    out = {}
    for r in O.assemble(spark.createDataFrame(rows, "book long, page long, markdown string, footer string, style string").repartition(5)).collect():
        out.setdefault(r.book, []).append((r.kind, r.n, r.page, r.number, r.text))
    return {b: sorted(v, key=str) for b, v in out.items()}


def cut_book(rng, notes):
    """A book's paragraphs, and its pages: words cut anywhere, a word too, notes in the middle of pages."""
    paragraphs = []
    for _ in range(rng.randrange(3, 12)):
        words = [rng.choice("river stone lamp under carries between morning".split()) for _ in range(rng.randrange(8, 40))]
        paragraphs.append(" ".join(words).capitalize() + ".")
    text = "\n\n".join(paragraphs)
    pages, at = [], 0
    while at < len(text):
        size = rng.randrange(60, 200)
        end = min(len(text), at + size)
        if end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            pages.append(text[at:end] + "-")
        else:
            pages.append(text[at:end].rstrip(" "))
        at = end
    if notes:
        for k in range(len(pages)):
            if rng.random() < 0.4:
                pages[k] += f"\n\n[^{k + 1}] See the shelf, number {k}."
            if rng.random() < 0.2 and pages[k].count("-") == 0:
                pages[k] = ""
    return paragraphs, [(k, p, None) for k, p in enumerate(pages)]


def test_books_cut_into_pages_at_random(spark):
    rng = random.Random(4)
    books, whole = {}, {}
    for b in range(60):
        paragraphs, pages = cut_book(rng, b % 2 == 1)
        books[b] = (rng.choice(["unknown", None, "page_bottom"]) if b % 2 else "none", pages)
        if b % 2 == 0:
            whole[b] = paragraphs
    found = got(spark, books)
    for b, (style, pages) in books.items():
        assert found[b] == plain(pages, style), b
    same = sum([t for k, *_, t in sorted(found[b], key=lambda r: r[1]) if k == "body"] == p for b, p in whole.items())
    assert same > 20  # a cut may fall where nothing tells that a sentence goes on


STATES = ["[^1] A note of some", "[^2] A note.", "[^3]: Another with more", "lower goes on and", "lower ends.", "Upper starts and runs on to", "Upper ends.", "# Heading", "bro-", "¹ Superscript note on", "", None, "a\n\nb c d e f g h i j k l m n\n\n[^9] x y", "3 Bottom note\n4 other", "Text[^3] and more[^4] of it.\n\n3 Bottom note\n4 other note that runs\n\nTail of it"]


def test_every_state_is_carried(spark):
    rng = random.Random(7)
    books = {b: (rng.choice(["unknown", "page_bottom"]), [(p, "\n\n".join(x for x in rng.choices(STATES, k=rng.randrange(1, 4)) if x) or rng.choice([None, ""]), rng.choice([None, None, "¹ Foot note of", "12 Running head"])) for p in range(rng.randrange(1, 14))]) for b in range(120)}
    found = got(spark, books)
    for b, (style, pages) in books.items():
        assert found.get(b, []) == plain(pages, style), (b, style, pages)


def test_no_pages(spark):
    assert O.assemble(spark.createDataFrame([], "book long, page long, markdown string, footer string, style string")).count() == 0


def test_carried_values_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), k, rng.choice([None, None, rng.randrange(9)]), rng.randrange(3)) for k in range(400)]
    df = spark.createDataFrame(rows, "g long, k long, v long, x long").repartition(7)
    made = {r.k: (r.seen, r.total) for r in scan.carried(df, "g", ["k"], {"seen": F.col("v")}, {"total": F.col("x")}).collect()}
    for g in (1, 2, None):
        seen, total = None, 0
        for _, k, v, x in (r for r in rows if r[0] == g):
            assert made[k] == (seen, total)
            seen, total = v if v is not None else seen, total + x
