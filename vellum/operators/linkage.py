"""Text similarity, record linkage and quote alignment."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections import defaultdict, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Weights of the metadata score and its title floor.
SCORE_WEIGHTS = {"title": 0.55, "author": 0.25, "year": 0.10, "journal": 0.05, "publisher": 0.05}
TITLE_FLOOR = 0.15
_ACCENTS, _PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normalise(text: Column) -> Column:
    """Lower case, Latin accents folded, punctuation to spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), _ACCENTS, _PLAIN), r"[^a-z0-9\s]", " "), r"\s+", " "))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; shorter texts have none."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _longest_common(a: str, b: str) -> tuple[int, int, int]:
    """The length of the longest common substring and where it begins in each, the first of several; substrings are looked for whole, not letter by letter."""
    best = (0, 0, 0)
    for i in range(len(a)):
        n = best[0]
        while i + n < len(a) and a[i : i + n + 1] in b:
            n += 1
        if n > best[0]:
            best = n, i, b.find(a[i : i + n])
    return best


def similar_text(a: str, b: str) -> float:
    """Twice the recursively matched longest common substrings, over both lengths."""

    def matched(x: str, y: str) -> int:
        n, i, j = _longest_common(x, y)
        return n + matched(x[:i], y[:j]) + matched(x[i + n :], y[j + n :]) if n else 0

    if a == b:
        return 1.0 if a else 0.0
    return 2 * matched(a, b) / (len(a) + len(b))


#: Words that titles are compared without, and ways to write "and others".
TITLE_STOPS = {"the", "a", "an", "of", "and", "in", "on", "to", "for", "by", "with", "from", "at", "is", "as"}
ET_AL = {"et al.", "et al", "etal"}
_SPELT = str.maketrans({"\u00df": "ss", "\u00e6": "ae", "\u0153": "oe", "\u00f8": "o", "\u0142": "l", "\u00f0": "d", "\u00fe": "th", "\u0111": "d"})


def folded(text: str) -> str:
    """Lower case with accents off and letters that don't decompose spelt out."""
    if text.isascii():
        return text.lower()
    spelt = text.lower().translate(_SPELT)
    return "".join(c for c in unicodedata.normalize("NFD", spelt) if unicodedata.category(c) != "Mn")


def plain_words(text: str) -> list[str]:
    return re.sub(r"[^\w\s]", " ", folded(text)).split()


def name_similarity(a: str, b: str) -> float:
    """Share of the shorter name's tokens that match one of the longer's, each used once: equal, or one edit apart from four letters on.

    Names are folded and parted at commas, dots, hyphens and spaces; tokens of one or two letters don't count.
    """
    x, y = ([t for t in re.split(r"[,.\-\s]+", folded(s)) if len(t) > 2] for s in (a, b))
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    if not few:
        return 0.0
    hits = 0
    for t in few:
        k = next((i for i, u in enumerate(many) if u == t or (min(len(u), len(t)) >= 4 and _one_edit(u, t))), None)
        if k is not None:
            hits, many = hits + 1, many[:k] + many[k + 1 :]
    return hits / len(few)


def title_similarity(a: str, b: str) -> float:
    """Blend of word overlap without stop words and similar text, less for titles of unlike numbers of words."""
    whole = [plain_words(a)] * 2 if a == b else [plain_words(s) for s in (a, b)]
    x, y = ([w for w in words if w not in TITLE_STOPS] for words in whole)
    if not x or not y:
        return 0.0
    others = set(y)
    overlap = sum(w in others for w in x) / len({*x, *y})
    alike = similar_text(*(" ".join(words) for words in whole))
    return (0.6 * overlap + 0.4 * alike) * (0.5 + 0.5 * min(len(x), len(y)) / max(len(x), len(y)))


def title_ceiling(title: str) -> float:
    """The most that title_similarity() of a title with any other can be; above 1 where words of it repeat."""
    words = [w for w in plain_words(title) if w not in TITLE_STOPS]
    return 0.6 * (len(words) / len(set(words))) + 0.4 if words else 0.0


def text_score(a: str, b: str) -> float:
    """Similar text of journals or publishers of three bytes or more; nothing below 0.4."""
    if min(len(a.encode()), len(b.encode())) < 3:
        return 0.0
    alike = similar_text(*(" ".join(plain_words(s)) for s in (a, b)))
    return alike if alike >= 0.4 else 0.0


def authors_matched(authors: list[str], candidate: str) -> float:
    """Share of the authors that have a name of their own, at 0.6 or more, among the candidate's, parted by semicolons."""
    named = [a for a in authors if a.strip().lower() not in ET_AL]
    free = [n for n in map(str.strip, candidate.split(";")) if len(n.encode()) >= 2]
    hits = 0
    for a in named:
        score, k = max(((name_similarity(a, n), -i) for i, n in enumerate(free)), default=(0.0, 0))
        if score >= 0.6:
            hits += 1
            free.pop(-k)
    return hits / len(named) if named else 0.0


def _one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _alike_once(f, x: Iterable, y: Iterable) -> pd.Series:
    """f of each pair of an Arrow batch, made once for each unlike pair of it."""
    made: dict = {}
    out = []
    for pair in zip(x, y, strict=True):
        if pair not in made:
            made[pair] = f(*pair)
        out.append(made[pair])
    return pd.Series(out, dtype="float64")


def pairwise(f, a: Column, b: Column) -> Column:
    """A two-string similarity as an Arrow-batched function; nulls are empty. Not deterministic for Spark, which would else run it again in each filter on it."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _alike_once(lambda p, q: f(p or "", q or ""), x, y)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double").asNondeterministic()(a, b)


def author_score(authors: Column, candidate: Column) -> Column:
    """authors_matched() of an array of names and a string; nulls are empty. Not deterministic for Spark, as pairwise()."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _alike_once(lambda p, q: authors_matched(list(p), q or ""), (() if p is None else tuple(p) for p in x), y)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double").asNondeterministic()(authors, candidate)


def year_score(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def metadata_score(title: Column, author: Column, year: Column, journal: Column, publisher: Column, has_authors: Column, has_candidate: Column) -> Column:
    """Weighted score of part similarities in 0 to 1. Titles below the floor score 0, and so do authors none of whom matches.

    An unnamed candidate, fewer than half of the authors matched, and authors missing from the record alone each cost a share.
    has_authors, has_candidate: whether the record and the candidate name authors.
    """
    s = SCORE_WEIGHTS
    raw = s["title"] * title + s["author"] * author + s["year"] * year + s["journal"] * journal + s["publisher"] * publisher
    none = has_authors & (author == 0)
    share = F.when(none, F.when(has_candidate, 0.0).otherwise(0.85)).when(has_authors & (author < 0.5), 0.7 + 0.6 * author).when(~has_authors & has_candidate, 0.75).otherwise(1.0)
    return F.when(title < TITLE_FLOOR, 0.0).otherwise(raw * share)


_DROPPED = re.compile(r"[\u200b-\u200d\ufeff\u2060\u2197\u00b9\u00b2\u00b3\u2070\u2074-\u2079]")
_STRAIGHT = str.maketrans("\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--")


def block_normalise(text: str) -> str:
    """Lower case without zero-width and superscript characters and [N] markers, quotes and dashes straight, spaces collapsed."""
    return " ".join(re.sub(r"\[[0-9]{1,3}\]", "", _DROPPED.sub("", text)).translate(_STRAIGHT).lower().split())


def monotone_alignment(old: DataFrame, new: DataFrame, group: str, threshold: float = 0.6, margin: float = 0.1, radius: int = 25) -> DataFrame:
    """(group, old_pos, new_pos, score): matches of blocks between two versions of a document, each block in one at most.

    First, equal normalised texts match over the whole document, the first of several first (a block that moved may cross
    others). The rest match by trigram Jaccard between the places of their matched neighbours, within a window around the
    rank interpolated between these, if the best is clear of the second by the margin.
    Inputs have group, pos, text. One group is one document, held by one task.
    """

    def grams(t: str) -> set[str]:
        return {t[i : i + 3] for i in range(len(t) - 2)}

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("pos"), b.sort_values("pos")
        olds, news = ([None if pd.isna(t) else block_normalise(t) for t in x.text] for x in (a, b))
        places: dict[str, deque[int]] = defaultdict(deque)
        for j, text in enumerate(news):
            places[text or ""].append(j)
        match = {i: (places[text].popleft(), 1.0) for i, text in enumerate(olds) if text is not None and places.get(text)}
        taken, matched, sets = {j for j, _ in match.values()}, list(match), [grams(t or "") for t in news]
        for i, text in enumerate(olds):
            mine = grams(text or "")
            if i in match or not mine:
                continue
            at = bisect(matched, i)
            lo_old, lo = (matched[at - 1], match[matched[at - 1]][0]) if at else (-1, -1)
            hi_old, hi = (matched[at], match[matched[at]][0]) if at < len(matched) else (len(olds), len(news))
            between = at and at < len(matched)
            rank = int((lo + (hi - lo) * (i - lo_old) / (hi_old - lo_old) if between else i / len(olds) * len(news)) + 0.5)
            window = (j for j in range(max(lo + 1, rank - radius), min(hi, rank + radius + 1)) if j not in taken)
            ranked = sorted(((len(mine & sets[j]) / len(mine | sets[j]), -j) for j in window), reverse=True)[:2]
            if not ranked or ranked[0][0] < threshold or (len(ranked) > 1 and ranked[0][0] - ranked[1][0] < margin):
                continue
            match[i] = -ranked[0][1], ranked[0][0]
            taken.add(-ranked[0][1])
            matched.insert(at, i)
        out = [(key[0], a.pos.iloc[i], b.pos.iloc[j], round(score, 6)) for i, (j, score) in sorted(match.items())]
        return pd.DataFrame(out, columns=[group, "old_pos", "new_pos", "score"])

    # Projected anew, so that two versions derived from one table don't share column identities.
    a, b = (df.select(F.col(group).alias(f"_g{k}"), F.col("pos").cast("long").alias("pos"), F.col("text").alias("text")) for k, df in enumerate((old, new)))
    return a.groupBy("_g0").cogroup(b.groupBy("_g1")).applyInPandas(run, f"{group} long, old_pos long, new_pos long, score double")


def offset_normalise(text: str) -> tuple[str, list[int]]:
    """Text without zero-width characters and [N] markers, quotes straightened, spaces collapsed; and each character's old offset."""
    out, at = [], []
    skip = {m.start(): m.end() for m in re.finditer(r"\[\d+\]|[​-‍﻿²³¹⁰-⁹]+", text)}
    quotes = {"‘": "'", "’": "'", "“": '"', "”": '"'}
    i = 0
    while i < len(text):
        if i in skip:
            i = skip[i]
            continue
        c = quotes.get(text[i], text[i])
        if c.isspace():
            c = " "
            if out and out[-1] == " ":
                i += 1
                continue
        out.append(c)
        at.append(i)
        i += 1
    return "".join(out), at


def locate_quotes(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, doc_id: str, text: str, size: int = 8) -> DataFrame:
    """(quote_id, doc_id) where the document contains the quote, by an equi-join on words inside the quote.

    The key of a quote is its size words from the second on, which stand whole in any text that contains it; every run
    of size words of a document is hashed, and only documents with an equal run are held against the quote in full.
    Quotes of fewer than size + 2 words are a query set held against all rows.
    """
    words = lambda t: F.split(t, "[ \\n]")
    asked = quotes.select(F.col(quote_id), F.col(quote).alias("_q"), words(F.col(quote)).alias("_w"))
    whole = asked.where(F.size("_w") >= size + 2).select(quote_id, "_q", F.xxhash64(F.slice("_w", 2, size)).alias("_h"))
    runs = docs.select(F.col(doc_id), words(F.col(text)).alias("_w"))
    hashed = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, F.lit(size))))
    pairs = runs.select(doc_id, F.explode(F.array_distinct(hashed)).alias("_h")).join(whole, "_h").select(quote_id, doc_id, "_q").distinct()
    texts = docs.select(F.col(doc_id), F.col(text).alias("_t"))
    found = pairs.join(texts, doc_id).where(F.col("_t").contains(F.col("_q"))).select(quote_id, doc_id)
    short = asked.where(F.size("_w") < size + 2).select(quote_id, "_q")
    return found.unionByName(texts.join(short, F.col("_t").contains(F.col("_q"))).select(quote_id, doc_id))


def resolve(pool: DataFrame, waves: list[tuple[str, str, DataFrame]], accept: float = 0.5) -> DataFrame:
    """The rows of the pool that a wave resolves, with work, method and score.

    waves: (method, the pool's column, a table of key, work, score) in order of trust. A row goes to the first wave with a candidate that
    scores accept or more, there to the best and then the least; later waves don't see it. Null keys resolve nothing.
    """
    best = None
    for k, (method, column, candidates) in enumerate(waves):
        top = candidates.where(F.col("score") >= accept).groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("_less"), "work")).alias(f"_w{k}"))
        pool = pool.join(top, F.col(column) == F.col("key"), "left").drop("key")
        found = F.when(F.col(f"_w{k}").isNotNull(), F.struct(F.col(f"_w{k}.work").alias("work"), F.lit(method).alias("method"), (-F.col(f"_w{k}._less")).alias("score")))
        best = found if best is None else F.coalesce(best, found)
    rows = pool.withColumn("_best", best).where("_best IS NOT NULL")
    return rows.select(*[c for c in rows.columns if not c.startswith("_")], "_best.*")
