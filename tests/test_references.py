"""Keys of references, in-text links and bibliographies: cases of who meets whom, and plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import bibliography as B, references as R

# (citation, what stands before it, reference, whether they meet)
MEET = [
    ("Ostrom 1990", "", "Ostrom, Elinor (1990). Governing the Commons. Cambridge UP.", True),
    ("Ostrom 1990a", "", "Ostrom, E. (1990a). Governing the Commons.", True),
    ("Ostrom 1990", "", "Ostrom, E. (1990a). Governing the Commons.", False),
    ("Hardin 1968", "", "Hardin, Garrett. 1968. The Tragedy of the Commons. Science.", True),
    ("WHO 2020", "", "WHO (2020). World Health Report.", True),
    ("UN 1948", "", "United Nations General Assembly (1948). Declaration.", True),
    ("Smith and Jones, 2009", "", "Smith, A. and Jones, B. (2009). A Study. Journal.", True),
    ("Smith et al. 2009", "", "Smith, A., Jones, B. & Wu, C. (2009). A Study. Journal.", True),
    ("Jones 2009", "", "Smith, A. and Jones, B. (2009). A Study. Journal.", False),
    ("Neumann 1944", "", "von Neumann, John (1944). Theory of Games.", True),
    ("Van Dijk, 1998", "", "van Dijk, T. A. (1998) Ideology.", True),
    ("Breiman 2001", "", "Leo Breiman (2001). Random Forests. Machine Learning 45.", True),
    ("Chen & Guestrin, 2016", "", "Tianqi Chen and Carlos Guestrin (2016). XGBoost. KDD.", True),
    ("García Márquez 1967", "", "García Márquez, Gabriel (1967). Cien años.", True),
    ("Weiss 1990", "", "Weiß, P. (1990). Ästhetik.", True),
    ("Ingersleben-Seip 2020", "", "Ingersleben-Seip, N. v. (2020). Networks.", True),
    ("2001", "as argued by Adorno and Horkheimer ", "Adorno, T. and Horkheimer, M. (2001). Dialectic.", True),
    ("2001", "what Butler’s book has ", "Butler, J. (2001). Gender.", True),
    ("ephemera collective 2021", "", "ephemera collective. 2021. Title of it.", True),
    ("Smith 1999", "", "Smith, J. The Art of War. Oxford, 1999", True),
    ("Smith 1999", "", "Smith, J. (1998). On 1999.", False),
    ("Smith 12", "", "Smith, J. (1998).", False),
]


@pytest.mark.parametrize("citation, before, reference, meets", MEET)
def test_citations_meet_their_references(citation, before, reference, meets):
    assert bool(set(R.reference_keys(citation, before)) & set(R.reference_keys(reference))) == meets


def test_leading_key_is_short():
    assert R.reference_keys("Albathan, Albishre, Khaled, Mubarak, Yuefeng (2015). A Method.")[0] == "albathan2015"
    assert R.reference_keys("Just a sentence.") == [] and R.reference_keys("") == []


TEXT = "As Smith (2010) and others say [Baldwin, 2018; see Jones 2012], (Smith 2010a, 2010b, and 3000) [36] [2013] (Nobody 1990), (Smith, J., 2010, Jones, 2012) or (Weber 1921)."
REFERENCES = [
    (1, 1, 10, "Smith, J. (2010). First."), (1, 2, 11, "Smith, J. (2010a). Second."), (1, 3, 12, "Smith, J. (2010b). Third."), (1, 4, 13, "Jones, K. 2012. Fourth."),
    (1, 5, 14, "Baldwin, L. (2018)"), (1, 6, 15, "Weber, M. (1922)"), (1, 7, 16, "Smith, Z. (2010). Last."), (1, 8, 17, None), (2, 1, 20, "Nobody, N. (1990)"),
]


def linked(spark, rows, part=None):
    blocks = spark.createDataFrame(rows, "doc long, pos long, part long, text string")
    refs = spark.createDataFrame(REFERENCES, "doc long, n long, rid long, ref string")
    return blocks, R.citation_links(blocks, refs, "doc", "pos", "text", "rid", "ref", "n", part)


def test_links_are_spans_of_the_text(spark):
    blocks, links = linked(spark, [(1, 1, 0, TEXT), (1, 2, 0, None), (1, 3, 0, ""), (1, 4, 0, "None (here)."), (2, 1, 0, TEXT)])
    got = {(r.start, r.year): (r.rid, r.offset) for r in links.where("doc = 1").collect()}
    assert all(TEXT[at : at + len(y)] == y for at, y in got)
    want = [("2010", 16, 0), ("2018", 14, 0), ("2012", 13, 0), ("2010a", 11, 0), ("2010b", 12, 0), ("1990", None, None), ("2010", 16, 0), ("2012", 13, 0), ("1921", 15, 1)]
    assert [(y, *v) for (_, y), v in sorted(got.items())] == want
    assert {(r.year, r.rid) for r in links.where("doc = 2 AND rid IS NOT NULL").collect()} == {("1990", 20)}
    texts = R.linked_text(blocks, links, ["doc", "pos"], "text", "rid").where("doc = 1").collect()
    made = {r.pos: r.linked for r in texts}
    assert made[2] is None and made[3] == "" and made[4] == "None (here)."
    assert re.sub(r"</?a[^>]*>", "", made[1]) == TEXT and made[1].count("<a ") == 8
    assert '(Smith <a class="in-text-citation" href="#11">2010a</a>, <a class="in-text-citation" href="#12">2010b</a>, and 3000)' in made[1]


def test_context_comes_from_earlier_pieces(spark):
    _, links = linked(spark, [(1, 1, 1, "what Jones"), (1, 1, 2, " wrote "), (1, 1, 3, "(2012) and (2012)"), (1, 2, 1, "(2012)")], "part")
    assert {(r.pos, r.part, r.rid) for r in links.collect()} == {(1, 3, 13), (2, 1, None)}


def test_links_of_nothing(spark):
    blocks, links = linked(spark, [])
    assert links.count() == 0 and R.linked_text(blocks, links, ["doc", "pos"], "text", "rid").count() == 0


# --- bibliographies


def like(text, previous):
    if not re.search(r"\d{4}", text) or re.match(rf"(?i)\s*(?:{'|'.join(B.MATTER)})", text):
        return False
    for tag, t in previous[:2]:
        if tag == "p":
            if re.match(B.CITE_LABEL, t):
                return False
            break
    if re.match(r"\s*\d{1,4}[.)]\s", text):
        rest = re.sub(r"^\s*\d{1,4}[.)]\s+", "", text)
        return bool(re.match(r"[A-ZÀ-ÖØ-Þ][a-zA-ZÀ-ÿ'’-]+,\s", rest) or re.match(r"(?s)[A-ZÀ-ÖØ-Þ].{0,60}?\(\d{4}[a-z]?\)", rest))
    return bool(re.match(r"\s*\[\d+\]", text) or re.match(r"\s*(?i:von|van|de|du|da|del|della|le|la|los|las|den|der|het|ten|ter)\s+[A-ZÀ-Þ]", text) or re.match(B.DASH, text) or text.lstrip()[:1].isupper())


def plain_entries(blocks):
    """One document, block by block: (pos, line, text) of its entries."""
    rows = []
    for pos, tag, text in sorted(blocks):
        lines = [x.strip(" \t\r") for x in (text or "").split("\n") if x.strip(" \t\r")]
        crammed = tag == "p" and "\n" in (text or "") and len(lines) >= 2 and sum(x[0].isupper() and bool(re.search(r"\d{4}", x)) for x in lines) >= 2
        rows += [(pos, k, tag, x) for k, x in enumerate(lines)] if crammed else [(pos, 0, tag, text or "")]
    flags = [tag == "p" and like(t, [(r[2], r[3]) for r in reversed(rows[:i])]) for i, (_, _, tag, t) in enumerate(rows)]
    level = [int(r[2][1]) if re.fullmatch(r"h[1-6]", r[2]) else None for r in rows]
    found = set()
    for i, r in enumerate(rows):
        if level[i] is None or r[3].strip(" \t\r\n").lower() not in B.HEADINGS:
            continue
        for j in range(i + 1, len(rows)):
            if level[j] is not None and level[j] <= level[i]:
                ahead = [k for k in range(j + 1, len(rows)) if rows[k][2] == "p"][:3]
                if len(ahead) < 2 or sum(flags[k] and bool(re.search(r"\d{4}", rows[k][3][:80])) for k in ahead) < 2:
                    break
            elif flags[j]:
                found.add(j)
    if not found:
        run, header = [], False
        for i in reversed([k for k, r in enumerate(rows) if r[2] == "p"]):
            if flags[i]:
                run.append(i)
            elif run:
                header = rows[i][3].strip(" \t\r\n").lower() in B.HEADINGS
                break
        shaped = any(re.match(r"\s*[A-Z][a-zA-Z'’-]+,\s+(?:[A-Z]\.|[A-Z][a-z])|\s*[A-Z][a-zA-Z'’-]+.{0,40}?\(\d{4}[a-z]?\)|\s*\[\d+\]", rows[i][3]) or re.match(B.DASH, rows[i][3]) or re.match(r"\s*(?i:von|van|de)\s+[A-Z]", rows[i][3]) for i in run)
        found = set(run) if header or shaped or len(run) >= 3 else set()
    numbered = {i: int(m[1]) for i in found if (m := re.match(r"\s*(\d{1,4})[.)]\s", rows[i][3]))}
    if len(numbered) >= 3 and len(set(numbered.values())) / (max(numbered.values()) - min(numbered.values()) + 1) < 0.5:
        found -= set(numbered)
    return [(rows[i][0], rows[i][1], rows[i][3]) for i in sorted(found)]


def random_documents(n):
    rng = random.Random(11)
    names = ["Ostrom", "Hardin", "Weber", "Müller"]

    def entry():
        a, y = rng.choice(names), rng.randrange(1990, 1994)
        return rng.choice([f"{a}, B. ({y}). Title {rng.randrange(3)}.", f"{a}, B. {y}. Title.", f"[{rng.randrange(9)}] {a} {y}", f"—. {y}. Other.", f"{rng.randrange(90)}. {a}, C. ({y}) T.", f"von {a}, D. ({y}). T.", f"{a}, A. ({y}). One.\n{a}, B. ({y}). Two."])

    for doc in range(n):
        blocks = []
        for pos in range(rng.randrange(1, 30)):
            kind = rng.random()
            if kind < 0.12:
                blocks.append((pos, f"h{rng.randrange(1, 4)}", rng.choice(["References", " bibliography ", "Chapter", "Notes"])))
            elif kind < 0.6:
                blocks.append((pos, "p", entry()))
            else:
                blocks.append((pos, rng.choice("ppd"), rng.choice(["prose without a year", "lower prose of 1999", "It was in 1990 that all of it began.", "© 2019 Publisher", "To cite this article:", "works cited", None, "", "two\nlines"])))
        yield doc, blocks


def test_reference_paragraphs_equal_a_plain_loop(spark):
    docs = dict(random_documents(150))
    rows = [(doc, *b) for doc, blocks in docs.items() for b in blocks]
    got = {}
    for r in B.reference_paragraphs(spark.createDataFrame(rows, "doc long, pos long, tag string, text string")).collect():
        got.setdefault(r.doc, []).append((r.pos, r.line, r.text))
    for doc, blocks in docs.items():
        assert sorted(got.get(doc, [])) == plain_entries(blocks), (doc, blocks)
    assert sum(map(len, got.values())) > 300


def entries_of(spark, *texts, heading="References"):
    blocks = [(1, 0, "h2", heading)] + [(1, k, "p", t) for k, t in enumerate(texts, 1)]
    entries = B.bibliography(spark.createDataFrame(blocks, "doc long, pos long, tag string, text string"))
    return entries, {r.pos: (r.entry_id, r.duplicate) for r in entries.collect()}


def test_ids_of_entries(spark):
    entries, got = entries_of(
        spark, "Ostrom, E. (1990). Governing the Commons. CUP.", "Ostrom, E. (1990). A Different Book Entirely. OUP.", "Ostrom, E. (1990). Governing the Commons. CUP.",
        "—. 2014. Another Work. Seuil.", "Hardin, G. (1968). The Tragedy. Reprinted 1977.", "Weber, M. (1922a). One.", "Weber, M. (1922). Two.", "Weber, M. (1922). Three.", "K. E. (2005) Daniel Kennefick. Waves.", "[7] 1999",
    )
    assert got == {1: ("ostrom1990a", False), 2: ("ostrom1990b", False), 3: ("ostrom1990a", True), 4: ("ostrom2014", False), 5: ("hardin1968", False), 6: ("weber1922a", False), 7: ("weber1922b", False), 8: ("weber1922c", False), 9: ("kennefick2005", False), 10: (None, False)}
    keys = {r.key: r.entry_id for r in B.key_map(entries).collect()}
    assert keys["ostrom1990"] == "ostrom1990a" and keys["hardin1977"] == "hardin1968" and keys["weber1922"] == "weber1922c"


def test_list_marks_go_where_most_entries_have_them(spark):
    entries, got = entries_of(spark, "- Ostrom, E. (1990). One.", "- Hardin, G. (1968). Two.", "Weber, M. (1922). Three.", heading="Sources")
    assert got == {1: ("ostrom1990", False), 2: ("hardin1968", False), 3: ("weber1922", False)}
    assert {r.text for r in entries.collect()} == {"Ostrom, E. (1990). One.", "Hardin, G. (1968). Two.", "Weber, M. (1922). Three."}


def test_glued_and_overlong_entries(spark):
    entries, _ = entries_of(spark, *[f"Ostrom, E. (199{k}). Work." for k in range(5)], "Weber, M. (1922). One. Hardin, G. (1968). Two.", "Butler, J. (1990). " + "long " * 120)
    flags = {r.pos: (r.glued, r.overlong) for r in B.entry_flags(entries).collect()}
    assert flags[6] == (True, False) and flags[7] == (False, True) and flags[1] == (False, False)
    health = B.bibliography_health(entries).first()
    assert (health.entries, health.glued, health.overlong, health.suspect) == (7, 1, 1, True)


def test_bibliography_of_nothing(spark):
    empty = spark.createDataFrame([], "doc long, pos long, tag string, text string")
    assert B.bibliography(empty).count() == 0 and B.bibliography_health(B.bibliography(empty)).count() == 0
    assert B.key_map(B.bibliography(empty)).agg(F.count("*")).first()[0] == 0
