"""Ranks of full-text matches by the usual formulas: weighted frequency, nearness of the words, density of covers; English stems.

Everything but the stems of single words is an expression of the JVM. Positions count words from 1, over the fields in the order given.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vellum.operators.relational import string_tokens
from vellum.session import TASK_ROWS, spread

#: Field weights, the limit of the sum of inverse squares, the most positions of a word that rank, what a far pair adds.
WEIGHTS = {"A": 1.0, "B": 0.3, "C": 0.1, "D": 0.05}
SQUARES = 1.64493406685
POSITIONS = 255
#: Texts that one task takes the words of.
TEXT_ROWS = 5_000
FAR = 1e-30


def _weighted(tokens: Column, weight: float) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(weight).alias("w")))


def _of(entries: Column, word: str) -> Column:
    return F.filter(entries, lambda e: e["t"] == word)


def _hits(fields: dict[str, Column], words: list[str]) -> list[Column]:
    """Of each word the array of (at, weight) where it stands; null fields are empty."""
    placed = None
    for label, text in fields.items():
        tokens = string_tokens(F.coalesce(text, F.lit("")))
        weighted = _weighted(tokens, WEIGHTS[label])
        placed = weighted if placed is None else F.concat(placed, weighted)
    numbered = F.transform(placed, lambda e, i: F.struct((i + 1).alias("at"), e["w"].alias("w"), e["t"].alias("t")))
    return [F.slice(_of(numbered, w), 1, POSITIONS) for w in words]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _weights(fields: dict[str, Column], word: str) -> Column:
    """The weights of a word where it stands, in order: counted in each field, tokens are not made."""
    if not re.fullmatch("[a-z0-9_]+", word):
        return F.array().cast("array<double>")
    times = lambda text: F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?<![a-z0-9_]){word}(?![a-z0-9_])"))
    return F.slice(F.concat(*[F.array_repeat(F.lit(WEIGHTS[label]), F.least(times(text), F.lit(POSITIONS))) for label, text in fields.items()]), 1, POSITIONS)


def any_rank(fields: dict[str, Column], words: list[str]) -> Column:
    """Rank of a match of any word: a word's best weight counts in full, the others by the squares of their places; the mean of the words."""

    def one(hits: Column) -> Column:
        best = F.array_max(hits)
        place = F.array_position(hits, best)
        rest = _sum(F.transform(hits, lambda w, i: w / ((i + 1) * (i + 1))))
        return F.coalesce((best + rest - best / (place * place)) / SQUARES, F.lit(0.0))

    return _sum(F.transform(F.array(*[_weights(fields, w) for w in words]), one)) / len(words)


def all_rank(fields: dict[str, Column], words: list[str]) -> Column:
    """Rank of a match of all words by the nearness of each two of them; 0 unless all are there. One word ranks as any_rank()."""
    if len(words) == 1:
        return any_rank(fields, words)
    hits = _hits(fields, words)

    def near(a: Column, b: Column) -> Column:
        gap = F.abs(a["at"] - b["at"])
        nearness = F.when(gap > 100, FAR).otherwise(1 / (1.005 + 0.05 * F.exp(gap / 1.5 - 2)))
        return 1 - F.sqrt(a["w"] * b["w"] * nearness)

    product = lambda values: F.aggregate(values, F.lit(1.0), lambda s, v: s * v)
    pair = lambda x, y: product(F.transform(x, lambda a: product(F.transform(y, lambda b: near(a, b)))))
    missed = reduce(lambda a, b: a * b, [pair(hits[i], hits[k]) for i in range(1, len(words)) for k in range(i)])
    every = reduce(lambda a, b: a & b, [F.size(h) > 0 for h in hits])
    return F.when(every, 1 - missed).otherwise(0.0)


def cover_rank(text: Column, words: list[str], weight: float = 0.1) -> Column:
    """Sum over the least spans that hold all words, each weight over one more than the span's other words; 0 where there is none."""
    order = {w: k for k, w in enumerate(dict.fromkeys(words))}
    tokens = string_tokens(F.coalesce(text, F.lit("")))
    found = F.transform(tokens, lambda t, i: F.struct((i + 1).alias("at"), t.alias("t")))
    entries = F.transform(F.filter(found, lambda e: e["t"].isin(*order)), lambda e, i: F.struct(e["at"].alias("at"), e["t"].alias("t"), i.alias("i")))
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("at"))
    start = F.struct(F.array(*[none for _ in order]).alias("last"), F.lit(-1).alias("from_"), F.lit(0.0).alias("sum"))

    def step(s: Column, e: Column) -> Column:
        here = F.struct(e["i"].alias("i"), e["at"].alias("at"))
        last = F.array(*[F.when(e["t"] == w, here).otherwise(s["last"][k]) for w, k in order.items()])
        first = F.array_min(last)
        cover = first["i"] > s["from_"]
        gain = weight / (1 + (e["at"] - first["at"]) - (e["i"] - first["i"]))
        return F.struct(last.alias("last"), F.when(cover, first["i"]).otherwise(s["from_"]).alias("from_"), F.when(cover, s["sum"] + gain).otherwise(s["sum"]).alias("sum"))

    return F.aggregate(entries, start, step, lambda s: s["sum"])


#: The public English (Porter 2) stemmer's letter classes, suffixes, irregular words.
_VOWEL = "[aeiouy]"
IRREGULAR_STEMS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_UNCHANGED_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_ENDS2, _ENDS3, _ENDS4 = (*_STEP2, "ogi", "li"), (*_STEP3, "ative"), (*_STEP4, "ion")


def _regions(w: str) -> tuple[int, int]:
    after = lambda i: (m.end() if (m := re.search("[aeiouy][^aeiouy]", w[i:])) else len(w) - i) + i
    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch("[aeiouy][^aeiouy]", w))


def stem_word(word: str) -> str:
    """The English stem of one lower-case word, by the published rules of the second Porter stemmer."""
    w = word.replace("’", "'").removeprefix("'")
    if len(w) <= 2 or w in _UNCHANGED:
        return w
    if w in IRREGULAR_STEMS:
        return IRREGULAR_STEMS[w]
    if "y" in w:
        w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("ie[ds]$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _UNCHANGED_1A:
        return w
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(_VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and re.search("[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    longest = lambda suffixes: max((s for s in suffixes if w.endswith(s)), key=len) if w.endswith(suffixes) else ""
    suffix = longest(_ENDS2)
    if suffix and len(w) - len(suffix) >= r1:
        stem = w[: len(w) - len(suffix)]
        if suffix in _STEP2:
            w = stem + _STEP2[suffix]
        elif suffix == "ogi" and stem.endswith("l") or suffix == "li" and re.search("[cdeghkmnrt]$", stem):
            w = stem + ("og" if suffix == "ogi" else "")
    suffix = longest(_ENDS3)
    if suffix and len(w) - len(suffix) >= r1:
        stem = w[: len(w) - len(suffix)]
        if suffix != "ative":
            w = stem + _STEP3[suffix]
        elif len(stem) >= r2:
            w = stem
    suffix = longest(_ENDS4)
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[: -len("ion")].endswith(("s", "t"))):
        w = w[: len(w) - len(suffix)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(words: Column) -> Column:
    """Stem of a column of words, in Arrow batches; each batch stems a word once. Null stays null."""

    def run(batch: pd.Series) -> pd.Series:
        known = {w: stem_word(w) for w in batch.dropna().unique()}
        return batch.map(known).where(batch.notna(), None)

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(words)


def stemmed(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, stem, n): how often each stem stands in each text. Texts are dealt by id, so that their words are counted where they lie;
    words are counted before the distinct ones are stemmed; the stems come back by a join, so every word of the corpus is stemmed once."""
    dealt = dealt_texts(docs.select(F.col(id_col), text.alias("_text")), id_col)
    counts = dealt.select(F.col(id_col), F.explode(string_tokens(F.coalesce("_text", F.lit("")))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    return with_stems(counts, "word").groupBy(id_col, "stem").agg(F.sum("n").alias("n"))


def with_stems(rows: DataFrame, word: str) -> DataFrame:
    """rows with stem, that of their word."""
    known = rows.select(F.col(word).alias("_word")).distinct().select("_word", stems(F.col("_word")).alias("stem"))
    return rows.join(known, F.col(word) == F.col("_word")).drop("_word")


def dealt_texts(docs: DataFrame, id_col: str) -> DataFrame:
    """Texts in partitions by id of some TEXT_ROWS, so that what is made of a text's words needs no shuffle of words."""
    return spread(docs, docs.count() * (TASK_ROWS // TEXT_ROWS), id_col)
