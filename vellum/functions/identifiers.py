"""Identifiers of works as they stand in texts, and short titles, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Forms of identifiers, and the least lengths of a shortened title and of what stands before its colon.
DOI = r"10\.\d{4,9}/[^\s<>\"']+"
ISBN13, ISBN10 = r"(?i)\b(?:isbn[:\s]*)?(97[89][\d\-\s]{10,16}\d)\b", r"(?i)\b(?:isbn[:\s]*)?(\d[\d\-\s]{8,12}[\dXx])\b"
ARXIV = r"([a-z\-]+/\d{7}|\d{4}\.\d{4,5})"
SHORTENED, COLON = 10, 8


def doi(text: Column) -> Column:
    """The first DOI of a text, one in a link first, then one with a prefix, then a bare one; without marks at its end, in lower case; else null."""
    forms = [rf"(?i)href=[\"']https?://(?:dx\.)?doi\.org/({DOI})", rf"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)({DOI})", rf"\b({DOI})"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in forms])
    return F.lower(F.regexp_replace(found, r"[.,;)]+$", ""))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _weighed(digits: Column, weights: list[int]) -> Column:
    """The sum of digits by their weights, X as ten; null where there are more or fewer."""
    values = F.transform(F.split(digits, ""), lambda x: F.when(x == "X", 10).otherwise(x.try_cast("int")))
    return F.aggregate(F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: v * w), F.lit(0), lambda a, x: a + x)


def isbn(text: Column) -> Column:
    """The first ISBN of a text, of 13 digits first, without marks, checked by its last digit; one of 10 is given as of 13; else null."""
    thirteen = F.regexp_replace(F.regexp_extract(text, ISBN13, 1), r"\D", "")
    ten = F.upper(F.regexp_replace(F.regexp_extract(text, ISBN10, 1), r"[^\dXx]", ""))
    long_ = _with(thirteen, lambda d: F.when(_weighed(d, [1, 3] * 6 + [1]) % 10 == 0, d))
    short = _with(ten, lambda d: F.when(_weighed(d, list(range(10, 0, -1))) % 11 == 0, F.concat(F.lit("978"), F.substring(d, 1, 9))))
    found = F.coalesce(long_, _with(short, lambda d: F.concat(d, ((10 - _weighed(d, [1, 3] * 6) % 10) % 10).cast("string"))))
    return F.when(text.rlike(r"\d[\d\-\s]{8}"), found)  # either form holds nine such characters; most texts don't


def arxiv(text: Column) -> Column:
    """The arXiv number of a text, from a link, its DOI, a prefix, or as the whole text; without its version; else null."""
    forms = [rf"(?i)10\.48550/arXiv\.{ARXIV}", rf"(?i)(?:arxiv|ar5iv)\.(?:labs\.arxiv\.)?(?:org/)?(?:labs\.)?(?:abs|pdf|html)/{ARXIV}", rf"(?i)(?:arxiv|ar5iv)\.(?:org|labs\.arxiv\.org)/(?:abs|pdf|html)/{ARXIV}", rf"(?i)^\s*arxiv:\s*{ARXIV}(?:v\d+)?\s*$", rf"(?i)^\s*{ARXIV}(?:v\d+)?\s*$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f, 1), F.lit("")) for f in forms])


def shortened_title(title: Column) -> Column:
    """What stands before a title's first colon, if the colon is not among its first eight characters and ten are left; else null."""
    at = F.instr(title, ":") - 1
    short = F.btrim(F.substring(title, 1, at))
    return F.when((at >= COLON) & (F.length(short) >= SHORTENED), short)
