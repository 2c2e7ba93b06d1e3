"""Toxicity by weak supervision.

Voters are lexicon words and word-start patterns induced from a bounded sample of labelled rows, and one voter
against: no other voter spoke. A generative label model, fitted by expectation maximisation over the sample's votes without
looking at labels again, estimates each voter's accuracies and, from what the posterior leaves unexplained, the
correlations between voters, by which it discounts their evidence. A linear classifier is trained on the posterior labels
over the voters' presence and its own bias, and scores every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vellum.session import discard, written

#: Bounds of the training sample and the number of voters; the sample is the labelled rows of least hash.
MAX_LABELLED, MAX_VOTERS = 20_000, 256
PREFIXES = (4, 5, 6, 7)
REJECT = 0.7
_WORD = re.compile(r"[^\W_]+")


def _features(text: str) -> set[str]:
    """Whole words, and their starts marked with a star."""
    words = set(_WORD.findall(text.lower()))
    found = {w for w in words if len(w) > 2}
    for k in PREFIXES:
        found |= {w[:k] + "*" for w in words if len(w) >= k}
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[label].update(_features(text))
    names = list(counts[0] | counts[1])
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[y][x] for x in part], pa.int64()) for y in (0, 1))], names=["feature", "n0", "n1"])


class Votes:
    """Which voters speak for a text: one Aho-Corasick pass, then word boundaries."""

    def __init__(self, voters: list[str]):
        self.find, own = ahocorasick.Automaton(), {}
        for k, v in enumerate(voters):
            own.setdefault(v.removesuffix("*"), []).append((k, v.endswith("*")))
        for word, ks in own.items():
            self.find.add_word(word, (len(word), ks))
        if own:
            self.find.make_automaton()
        self.any = bool(own)

    def __call__(self, text: str | None) -> list[int]:
        if not text or not self.any:
            return []
        low, found = text.lower(), set()
        for end, (n, ks) in self.find.iter(low):
            if end - n >= 0 and low[end - n].isalnum():
                continue
            closed = end + 1 == len(low) or not low[end + 1].isalnum()
            found.update(k for k, start in ks if start or closed)
        return sorted(found)


@dataclass
class Model:
    """voters, the linear classifier's weights and bias, and the label model's estimates."""

    voters: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -3.0
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    prior: float = 0.0

    def scorer(self):
        votes = Votes(self.voters)
        return lambda text: 1 / (1 + math.exp(-min(max(self.bias + float(self.weights[votes(text)].sum()), -50), 50)))


def label_model(votes: np.ndarray, accuracies: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """EM for a two-class model of (rows x voters) 0/1 votes: posterior, P(vote | class), residual correlations, prior.

    Between rounds, correlations of votes about their expectation under the posterior discount each voter's
    log-likelihood by one plus the sum of its positive correlations, so a clique of copies counts about once.
    """
    v = votes.astype(np.float64)
    discount = np.ones(v.shape[1])
    corr = np.zeros((v.shape[1],) * 2)
    post = np.zeros(len(v))
    for step in range(rounds):
        p1, p0 = accuracies[:, 1], accuracies[:, 0]
        gain = v @ (discount * np.log(p1 / p0)) + (1 - v) @ (discount * np.log((1 - p1) / (1 - p0)))
        new = 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + gain, -50, 50)))
        if step and np.abs(new - post).max() < 1e-5:
            break
        post = new
        mass = post.sum()
        accuracies = np.stack([((1 - post) @ v + 0.1) / (len(v) - mass + 1), (post @ v + 0.1) / (mass + 1)], axis=1).clip(1e-5, 1 - 1e-5)
        prior = float(np.clip((mass + 1) / (len(v) + 2), 1e-4, 0.5))
        rest = v - np.outer(post, accuracies[:, 1]) - np.outer(1 - post, accuracies[:, 0])
        scale = np.sqrt((rest**2).mean(axis=0)).clip(1e-6)
        corr = (rest.T @ rest) / len(v) / np.outer(scale, scale)
        np.fill_diagonal(corr, 0)
        discount = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
    return post, accuracies, corr, prior


def linear(x: np.ndarray, target: np.ndarray, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the bias isn't shrunk."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, l2), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (target - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def choose_voters(ranked: list[tuple[str, int, int]], most: int) -> list[str]:
    """Best first; one that only extends a chosen start no less precise adds nothing and is left out."""
    chosen: dict[str, float] = {}
    for name, n0, n1 in ranked:
        stem, share = name.removesuffix("*"), n0 / (n0 + n1)
        if not any(stem[:k] + "*" in chosen and chosen[stem[:k] + "*"] <= share for k in PREFIXES if k <= len(stem) and stem[:k] + "*" != name):
            chosen[name] = share
        if len(chosen) >= most:
            break
    return list(chosen)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_voters: int = MAX_VOTERS) -> Model:
    """Fit voters, label model and classifier on at most max_labelled labelled rows.

    Rows with a null label or id are no use and are left out; an id that has both labels counts as toxic. Texts are used
    whole; of documents that share a labelled id the text of least hash is used, so repeated rows count once. Without rows of
    both labels the model has no voters and scores everything low.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    sample = ids.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("id_") == F.col("i"))
    rows = written(texts.groupBy("i", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y"), "sample")
    counts = rows.mapInArrow(_count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    n0, n1 = (rows.where(F.col("y") == y).count() for y in (0, 1))
    if not n1 or not n0:
        discard(rows)
        return Model()
    support = max(3, n1 // 200)
    lift = F.log(((F.col("n1") + 0.1) / (n1 + 1.0)) / ((F.col("n0") + 0.1) / (n0 + 1.0)))
    # Ten rows for each voter at most come to the driver.
    ranked = counts.where((F.col("n1") >= support) & (lift > 2)).orderBy((F.col("n1") * lift).desc(), "feature").limit(10 * max_voters).collect()
    voters = choose_voters([(r.feature, r.n0, r.n1) for r in ranked], max_voters)
    if not voters:
        return Model()
    share = {r.feature: (r.n0, r.n1) for r in ranked}
    spoken = _votes(rows, voters).collect()  # a short list for each labelled id, at most max_labelled
    discard(rows)
    votes = np.zeros((len(spoken), len(voters) + 1), dtype=np.float32)
    for i, r in enumerate(spoken):
        votes[i, r.votes or [len(voters)]] = 1
    start = [[(share[v][0] + 0.1) / (n0 + 1), (share[v][1] + 0.1) / (n1 + 1)] for v in voters] + [[0.95, 0.3]]
    post, accuracies, corr, prior = label_model(votes, np.array(start), n1 / (n0 + n1))
    weights, bias = linear(votes[:, :-1], post)
    return Model(voters, weights, bias, accuracies, corr, prior)


def _votes(rows: DataFrame, voters: list[str]) -> DataFrame:
    def run(batches):
        votes = Votes(voters)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["votes"])

    return rows.select("text").mapInArrow(run, "votes array<int>")


def score(text: Column, model: Model) -> Column:
    """The classifier's score of a whole text in 0 to 1; null and empty texts get the bias's."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield texts.map(one).astype("float64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def training_fold(doc_id: Column) -> Column:
    """True where labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with score, predicted and held_out added; the model learns from training_fold() rows of labels only.

    One row per row of docs, repeated rows too, equal texts with equal scores. Null and empty texts get the bias's score; a null id
    is neither labelled nor held out. Columns of docs named score, predicted or held_out are replaced, others stay. No
    labels or no documents: every score is low, or there are no rows. No score is null.
    """
    model = train(docs, labels.where(training_fold(F.col(id_col))), id_col, text_col)
    whole = docs.withColumn("score", score(F.col(f"`{text_col}`"), model))
    return whole.withColumn("predicted", (F.col("score") >= REJECT).cast("int")).withColumn("held_out", F.coalesce(~training_fold(F.col(f"`{id_col}`")), F.lit(False)))
