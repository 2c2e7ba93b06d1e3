"""Author and year keys of references, and in-text citations as spans of a text that link to them.

A reference and what cites it meet in keys made of the same list of authors, so both go through one reading of author lists: words, initials,
commas and joining words become persons, and persons become surnames. Citations are found by position; linking is one
equi-join on (scope, key), and texts are put together from the linked spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.operators.linkage import folded

#: Capitalised words that are no surnames, and particles that a surname is known without.
NOT_NAMES = {"and", "the", "for", "in", "an", "on", "as", "ed", "eds", "of", "see", "also", "et", "al", "cf", "by", "from"}
PARTICLES = {"von", "van", "de", "du", "da", "del", "della", "le", "la", "los", "las", "den", "der", "het", "ten", "ter"}
#: Fixed value: how far a citation's year may be from its reference's, in the order in which that is tried.
YEAR_OFFSETS = (0, 1, -1, 2, -2, 3, -3)

_APOSTROPHES = str.maketrans("‘’ʼ", "'''")
_PIECE = re.compile(r"(?P<word>[^\W\d_]+(?:['-][^\W\d_]+)*)(?P<dot>\.?)|(?P<comma>,)|(?P<join>[;&])|(?P<stop>[:\"“”])")


@dataclass(slots=True)
class _Person:
    """One entry of an author list: its capitalised words, whether it has initials, and what stands before it."""

    words: list[str] = field(default_factory=list)
    initials: bool = False
    after_comma: bool = False


def _plain(word: str) -> str:
    return folded(word.removesuffix("'s")).replace("-", "").replace("'", "")


def authors(head: str) -> list[_Person]:
    """The persons of an author list, up to the end of the sentence it stands in or to a quotation or colon.

    A comma, a semicolon, an ampersand and the word "and" end a person; initials alone belong to the person before them.
    """
    people, now = [], _Person()

    def end(comma: bool) -> None:
        nonlocal now
        if now.words:
            people.append(now)
        elif now.initials and people:
            people[-1].initials = True
        now = _Person(after_comma=comma)

    for m in _PIECE.finditer(head.translate(_APOSTROPHES)):
        word = m["word"]
        if word is None:
            if m["stop"] and (people or now.words):
                break
            if not m["stop"]:
                end(bool(m["comma"]))
            continue
        if word == "and":
            end(False)
        elif word[0].isupper() and word.lower() not in NOT_NAMES:
            if len(word) == 1 or (m["dot"] and re.fullmatch(r"[A-Z](?:-?[A-Z])?", word)):
                now.initials = True
            elif word.lower() not in PARTICLES:
                now.words.append(word)
        if m["dot"] and len(word) > 2 and (people or now.words):
            break
    end(False)
    return people


def _trailing(context: str) -> str:
    """The author list that a context ends with, or its last capitalised word."""
    pieces = [m for m in _PIECE.finditer(context.translate(_APOSTROPHES)) if not m["stop"]]
    start = None
    for m in reversed(pieces):
        word = m["word"]
        if word and word[0].isupper() and word.lower() not in NOT_NAMES:
            start = m.start()
        elif word and word not in PARTICLES | {"and"}:
            break
    if start is not None:
        return context[start:]
    capitals = [m["word"] for m in pieces if m["word"] and m["word"][0].isupper() and m["word"].lower() not in NOT_NAMES]
    return capitals[-1] if capitals else ""


def reference_year(text: str) -> tuple[str, int] | None:
    """The year of a reference with its letter, and where it starts: one in round brackets first, then one with a letter, then the last of 1900 to 2099."""
    found = []
    for m in re.finditer(r"(?<!\d)(\d{4})([a-z]?)(?![\d\w])", text):
        bracketed = text[m.start() - 1 : m.start()] == "(" and text[m.end() : m.end() + 1] == ")"
        boxed = text[m.start() - 1 : m.start()] == "[" and text[m.end() : m.end() + 1] == "]"
        if bracketed or 1900 <= int(m[1]) <= 2099:
            found.append((0, m.start(), m) if bracketed else (3, m.start(), m) if boxed else (1, m.start(), m) if m[2] else (2, -m.start(), m))
    if not found:
        return None
    best = min(found, key=lambda f: f[:2])[2]
    return best[0], best.start()


def _surname_keys(people: list[_Person]) -> list[str]:
    last = [_plain(p.words[-1]) for p in people]
    keys = [last[0], _plain(people[0].words[0]), "".join(sorted(last))]
    # "Surname, Given, Surname, Given": a lone word after a comma may be the given name of the person before it.
    families, given = [], False
    for p, name in zip(people, last, strict=True):
        given = p.after_comma and len(p.words) == 1 and bool(families) and not given and not p.initials
        if not given:
            families.append(name)
    keys += ["".join(sorted(families)), "".join(sorted(_plain(w) for p in people for w in p.words))]
    keys += [w.lower() for p in people for w in p.words if len(w) > 1 and w.isupper()]
    for p in people:
        if len(p.words) > 2 and not p.initials:  # a body: its initials, and those of its first two words
            keys += ["".join(w[0] for w in p.words[:n]).lower() for n in (len(p.words), 2)]
    return keys


def reference_keys(text: str, context: str = "") -> list[str]:
    """Keys of authors and year by which a citation and its reference meet, the likeliest first; none without a year.

    Authors stand before the year; a citation of a year alone has those that its context ends with. Keys: the leading surname, its first
    word, all surnames in order, the same with given names read as such, all words, acronyms, initials of bodies. A name all in lower case counts if nothing is capitalised.
    """
    found = reference_year(text)
    if not found:
        return []
    year, at = found
    head = text[:at] if re.search(r"[^\W\d_]", text[:at]) else _trailing(context)
    people = authors(head)
    if people:
        names = _surname_keys(people)
    else:
        small = [w for w in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", head.translate(_APOSTROPHES)) if w.lower() not in NOT_NAMES]
        names = [_plain(w) for w in small if len(w) > 2][:1] if len(small) <= 4 else []
    return [k + year for k in dict.fromkeys(names) if k]


def keyed(df: DataFrame, text: Column) -> DataFrame:
    """df with a row for each of its text's reference keys: key, and rank from 0 for the likeliest."""
    keys = F.udf(reference_keys, "array<string>", useArrow=True)(F.coalesce(text, F.lit("")))
    return df.select("*", F.posexplode(keys).alias("rank", "key"))


def _near(df: DataFrame, only_exact: Column) -> DataFrame:
    """df with its key at each year offset that is tried (step, offset, key); where only_exact, at none but its own."""
    tries = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(y).alias("offset")) for i, y in enumerate(YEAR_OFFSETS)])
    name, year, letter = (F.regexp_extract("key", r"^(.*?)(\d{4})([a-z]?)$", i) for i in (1, 2, 3))
    rest = [c for c in df.columns if c != "key"]
    opened = df.select(*rest, name.alias("_name"), year.cast("int").alias("_year"), letter.alias("_letter"), F.explode(F.when(only_exact, F.slice(tries, 1, 1)).otherwise(tries)).alias("_near"))
    return opened.select(*rest, "_near.*", F.concat("_name", (F.col("_year") + F.col("_near.offset")).cast("string"), "_letter").alias("key"))


def link_citations(citations: DataFrame, references: DataFrame, citation_id: str, reference_id: str, citation: str = "text", reference: str = "text", scope: str | None = None) -> DataFrame:
    """(citation_id, reference_id, offset): the reference of each citation that meets one by key, within a scope such as a book.

    The citation's likeliest key counts first, then the reference's, then the lesser id; years misread by up to three
    are tried only where the year itself finds nothing. Null texts and texts without a year link to nothing.
    """
    scoped = [F.col(scope).alias("_scope")] if scope else [F.lit(0).alias("_scope")]
    asked = keyed(citations.select(F.col(citation_id).alias("_c"), *scoped, F.col(citation).alias("_t")), F.col("_t")).select("_c", "_scope", F.col("rank").alias("_first"), "key")
    tried = _near(asked, F.lit(False))
    known = keyed(references.select(F.col(reference_id).alias("_r"), *scoped, F.col(reference).alias("_t")), F.col("_t")).select("_r", "_scope", F.col("rank").alias("_second"), "key")
    known = known.groupBy("_scope", "key").agg(F.min(F.struct("_second", "_r")).alias("_known"))  # of references that share a key only the first can win
    met = tried.join(known, ["_scope", "key"]).groupBy("_c").agg(F.min(F.struct("step", "_first", "_known", "offset")).alias("best"))
    return met.select(F.col("_c").alias(citation_id), F.col("best._known._r").alias(reference_id), F.col("best.offset").alias("offset"))


_YEAR = re.compile(r"(?<!\d)\d{4}[a-z]?(?![\d\w])")
_BRACKETS = re.compile(r"\(([^()]*\d{4}[^()]*)\)|\[([^\[\]]*\d{4}[^\[\]]*)\]")
_LIST_OF_YEARS = re.compile(r"[\s,]+(\d{4}[a-z]?)(?![\d\w])")


def _sub_citations(block: str, base: int) -> list[tuple[int, str]]:
    """(offset, text) of each citation of a bracket: between semicolons, and where one piece has several years, before capitals that follow
    a comma; a part without a year belongs to the next that has one, or else to the one before.
    """
    out: list[tuple[int, str]] = []
    for piece in re.finditer(r"[^;]+", block):
        cuts = [piece.start()]
        if len(_YEAR.findall(piece[0])) > 1:
            cuts += [piece.start() + m.end() for m in re.finditer(r",\s*(?=[^\W\d_])", piece[0]) if piece[0][m.end()].isupper()]
        cuts.append(piece.end())
        start = cuts[0]
        for end, following in zip(cuts[1:], [*cuts[2:], None], strict=True):
            if following is not None and not (_YEAR.search(block, start, end) and _YEAR.search(block, end, piece.end())):
                continue
            out.append((base + start, block[start:end]))
            start = end
    return out


def cited_years(text: str, before: str = "") -> list[tuple[int, int, int, bool, list[str]]]:
    """(citation, start, end, leading, keys) of each year cited in a text: where it stands in code points, and the keys it may meet.

    Years are looked for in round brackets, and in square ones that have a letter too. leading: the first of its citation; those listed
    right after it have its authors. A year alone takes its authors from the text since the last bracket, and if that has no capital, from before too.
    """
    out, last, n = [], 0, 0
    for group in _BRACKETS.finditer(text):
        square = group[2] is not None
        block = group[2] if square else group[1]
        years = _YEAR.search(block)
        if not years or (square and not re.search(r"[^\W\d_]", _YEAR.sub("", block))):
            continue
        context = text[last : group.start()]
        if not any(c.isupper() for c in context):
            context = before + text[: group.start()]
        for start, sub in _sub_citations(block, group.start() + 1):
            if not (first := _YEAR.search(sub)):
                continue
            head, at = sub[: first.start()], first.end()
            out.append((n, start + first.start(), start + first.end(), True, reference_keys(head + first[0], context)))
            while more := _LIST_OF_YEARS.match(sub, at):
                out.append((n, start + more.start(1), start + more.end(1), False, reference_keys(head + more[1], context)))
                at = more.end()
            n += 1
        last = group.end()
    return out


_CITED = "array<struct<citation: int, start: int, stop: int, leading: boolean, keys: array<string>>>"


def citation_links(blocks: DataFrame, references: DataFrame, doc: str, pos: str, text: str, reference_id: str, reference: str, order: str, part: str | None = None) -> DataFrame:
    """(doc, pos, [part,] citation, start, stop, year, reference_id, offset): every year cited in a text, with the reference of its document that it links to, or null.

    blocks: (doc, pos, text), the texts that may cite; references: (doc, reference_id, reference, order). part numbers the inline
    pieces of a block: what stands in earlier pieces is context for later ones. Of references that share a key the last in order is meant.
    Keys go from the likeliest on; years up to three off are tried for a leading year alone, where nothing else is found. Years
    listed after one that links count only if they link themselves. Null texts cite nothing.
    """
    place = [doc, pos, *([part] if part else [])]
    before = F.lit("")
    if part:
        earlier = W.partitionBy(doc, pos).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.array_join(F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(earlier), ""), F.lit(""))
    rows = blocks.select(*place, F.coalesce(F.col(text), F.lit("")).alias("_text"), before.alias("_before")).where(F.col("_text").rlike(r"\d{4}"))

    @F.pandas_udf(_CITED)
    def cited(texts: pd.Series, befores: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("citation", "start", "stop", "leading", "keys"), c, strict=True)) for c in cited_years(t, b)] for t, b in zip(texts, befores, strict=True)])

    years = rows.select(*place, "_text", F.explode(cited("_text", "_before")).alias("_y")).select(*place, F.substring(F.col("_text"), F.col("_y.start") + 1, F.col("_y.stop") - F.col("_y.start")).alias("year"), "_y.*")
    parts = lambda key: [F.regexp_extract(key, r"^(.*?)(\d{4})([a-z]?)$", i).alias(n) for i, n in ((1, "_name"), (2, "_in"), (3, "_letter"))]
    asked = years.select(*place, "citation", "start", "stop", "year", "leading", F.posexplode_outer("keys").alias("_first", "_key")).withColumns(dict(zip(("_name", "_in", "_letter"), parts("_key"), strict=True)))
    known = keyed(references.select(F.col(doc), F.col(order).alias("_o"), F.col(reference_id).alias("_r"), F.col(reference).alias("_t")), F.col("_t"))
    known = known.groupBy(doc, "key").agg(F.max_by("_r", F.struct("_o", "_r")).alias("_r")).select(doc, "_r", *parts("key")).where("_in >= '1000'")
    # A reference stands at every year from which it may be meant, so that each key that is asked for meets one row at most.
    tries = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(y).alias("offset")) for i, y in enumerate(YEAR_OFFSETS)])
    tried = known.select(doc, "_r", "_name", "_letter", F.col("_in").cast("int").alias("_in"), F.explode(tries).alias("_near"))
    best = tried.groupBy(doc, "_name", "_letter", (F.col("_in") - F.col("_near.offset")).alias("_in")).agg(F.min(F.struct("_near.step", "_r", "_near.offset")).alias("_b"))
    met = asked.withColumn("_in", F.col("_in").try_cast("int")).join(best, [doc, "_name", "_letter", "_in"], "left")
    may = F.when(F.col("leading") | (F.col("_b.step") == 0), F.when(F.col("_b").isNotNull(), F.struct("_b.step", "_first", "_b._r", "_b.offset")))
    one = met.select(*place, "citation", "start", "stop", "year", "leading", may.alias("_m")).repartition(*place)
    one = one.groupBy(*place, "citation", "start", "stop", "year", "leading").agg(F.min("_m").alias("_best"))
    exact = F.max(F.col("leading") & F.coalesce(F.col("_best.step") == 0, F.lit(False))).over(W.partitionBy(*place, "citation"))
    linked = one.withColumn("_best", F.when(F.col("leading") | exact, F.col("_best")))
    return linked.where("leading OR _best IS NOT NULL").select(*place, "citation", "start", "stop", "year", F.col("_best._r").alias(reference_id), F.col("_best.offset").alias("offset"))


def linked_text(blocks: DataFrame, links: DataFrame, place: list[str], text: str, reference_id: str) -> DataFrame:
    """blocks with linked: the text with each linked year in an anchor to its reference; the rest of it is as it was.

    place: the columns that name a block in both tables. A null text stays null.
    """
    spans = links.where(F.col(reference_id).isNotNull()).groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("start", "stop", F.col(reference_id).cast("string").alias("to")))).alias("_spans"))
    both = blocks.join(spans, place, "left")
    t = F.col(text)
    piece = lambda a, b: F.substring(t, a + 1, b - a)
    anchor = lambda s: F.concat(F.lit('<a class="in-text-citation" href="#'), s["to"], F.lit('">'), piece(s["start"], s["stop"]), F.lit("</a>"))
    begun = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("_spans", begun, lambda acc, s: F.struct(s["stop"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"]), anchor(s)).alias("out")), lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(t))))
    return both.withColumn("linked", F.when(F.col("_spans").isNull(), t).otherwise(made)).drop("_spans")
