"""A positional index of terms as Parquet tables: searches read the folders of their own terms.

Postings (bucket, stem, term, docs, positions), those of a term in some documents a row, lie in a folder for each bucket of the stems' first two letters,
sorted by stem and term, so that within a folder the readers skip by the bounds of row groups and pages. Changed documents are further segments; a
document counts in the last segment that names it. Segments and merges are published by commits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vellum.operators.commits import Commits
from vellum.operators.ranking import IRREGULAR_STEMS, dealt_texts, stem_word

POSTINGS = "stem string, term string, docs array<long>, positions array<array<int>>"
BUCKETS = 256
#: Tokens whose positions a task holds before it hands them on, and numbers of documents that a merge puts into one row.
BATCH, PACK = 1_000_000, 5_000


def _bucket(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(stem, 1, 2)), F.lit(buckets)).cast("int")


@lru_cache(maxsize=200_000)
def _stem(term: str) -> str:
    return stem_word(term)


def _together(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
    """Postings of some texts' tokens, a row for each term: tokens are ordered by term, which leaves each term's by text and place."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    coded = pa.array(chain.from_iterable(texts), pa.string(), size=int(sizes.sum())).dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    text = np.repeat(np.arange(len(texts)), sizes)[order]
    at = (np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
    begins = np.diff(codes[order], prepend=-1) != 0
    starts = np.flatnonzero(begins | (np.diff(text, prepend=-1) != 0))  # of each posting
    rows = np.searchsorted(starts, [*np.flatnonzero(begins), len(codes)]).astype(np.int32)
    positions = pa.ListArray.from_arrays(np.append(starts, len(codes)).astype(np.int32), at.astype(np.int32))
    terms = coded.dictionary
    columns = [pa.array(map(_stem, terms.to_pylist()), pa.string()), terms, pa.ListArray.from_arrays(rows, np.array(ids, np.int64)[text[starts]]), pa.ListArray.from_arrays(rows, positions)]
    return pa.RecordBatch.from_arrays(columns, ["stem", "term", "docs", "positions"])


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of batches (doc, text in lower case), those of texts of some BATCH tokens together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"], strict=True):
            if tokens := re.findall("[a-z0-9_]+", text.as_py()):
                ids.append(doc)
                texts.append(tokens)
                held += len(tokens)
            if held >= BATCH:
                yield _together(ids, texts)
                ids, texts, held = [], [], 0
    if held:
        yield _together(ids, texts)


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(stem, term, docs, positions): where each term stands, from 1, in each of some texts. Null texts have none, null ids are left out; each of several rows
    of one id has positions of its own, which searches take together.

    Texts are dealt by their number and read once, where they lie; a term has a row for some BATCH tokens of texts, so that few rows are shuffled and sorted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("text")).where("doc IS NOT NULL")
    return dealt_texts(rows, "doc").mapInArrow(_placed, POSTINGS)


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (stem, term, doc, positions) as postings(): a row for each term and PACK numbers of documents."""
    held = rows.groupBy("stem", "term", F.floor(F.col("doc") / PACK).alias("_pack")).agg(F.collect_list(F.struct("doc", "positions")).alias("_held"))
    return held.select("stem", "term", F.col("_held.doc").alias("docs"), F.col("_held.positions").alias("positions"))


class TermIndex:
    """An index in a folder; it has what its last commit names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.log = Commits(spark, folder)

    def _segment(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        placed = rows.withColumn("bucket", _bucket(F.col("stem"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "stem", "term")
        return self.log.folders(self.log.write(placed, "bucket"))

    def build(self, docs: DataFrame, id_col: str, text: Column, buckets: int = BUCKETS) -> None:
        """Index all documents as the first segment."""
        if self.log.last() is not None:
            raise ValueError(f"{self.log.folder} has an index")
        self.log.commit({"buckets": buckets, "segments": [{"folders": self._segment(postings(docs, id_col, text), buckets), "touched": None}]})

    def upsert(self, docs: DataFrame, id_col: str, text: Column, deleted: DataFrame | None = None) -> None:
        """Put documents in place of those of their ids, and take away those of deleted (its first column)."""
        state = self.log.last()
        touched = docs.select(F.col(id_col).cast("long").alias("doc"))
        if deleted is not None:
            touched = touched.unionByName(deleted.select(F.col(deleted.columns[0]).cast("long").alias("doc")))
        segment = {"folders": self._segment(postings(docs, id_col, text), state["buckets"]), "touched": self.log.write(touched.where("doc IS NOT NULL").distinct())}
        self.log.commit(state | {"segments": [*state["segments"], segment]})

    def _rows(self, state: dict, buckets: list[int] | None, wanted: Column | None) -> DataFrame:
        """(stem, term, doc, positions) of the last state of each document, from the folders named."""
        parts = []
        for k, segment in enumerate(state["segments"]):
            names = [f for b, f in segment["folders"].items() if buckets is None or int(b) in buckets]
            rows = self.log.read(sorted(names), POSTINGS)
            rows = (rows if wanted is None else rows.where(wanted)).select("stem", "term", F.explode(F.arrays_zip("docs", "positions")).alias("_p"))
            rows = rows.select("stem", "term", F.col("_p.docs").alias("doc"), "_p.positions")
            later = [s["touched"] for s in state["segments"][k + 1 :]]
            parts.append(rows.join(self.log.read(later, "doc long"), "doc", "left_anti").select("stem", "term", "doc", "positions") if later and names else rows)
        return reduce(DataFrame.unionByName, parts)

    def merge(self) -> None:
        """Make one segment of all."""
        state = self.log.last()
        self.log.commit(state | {"segments": [{"folders": self._segment(_packed(self._rows(state, None, None)), state["buckets"]), "touched": None}]})

    def buckets_of(self, query: dict, stemmed: bool = False) -> list[int]:
        """The buckets that a query's terms lie in; a prefix of one letter may lie in any."""
        n = self.log.last()["buckets"]
        starts: set[str] = set()
        for kind, value in query["parts"]:
            for word in value if kind == "phrase" else [value]:
                if kind == "prefix" and not stemmed:
                    if len(word) < 2:
                        return list(range(n))
                    starts |= {word[:2], *(s[:2] for w, s in IRREGULAR_STEMS.items() if w.startswith(word))}
                else:
                    starts.add(stem_word(word)[:2])
        rows = self.log.spark.createDataFrame([(s,) for s in sorted(starts)], "s string").select(_bucket(F.col("s"), n)).distinct().collect()  # a query's words
        return sorted(r[0] for r in rows)

    def search(self, query: dict, stemmed: bool = False) -> DataFrame:
        """(doc): the documents that a parsed query matches, as search.matches() over their tokens does; stemmed: words and prefixes stand for their stems.

        A phrase is where the positions of its words, each less its place, meet. An empty query matches nothing.
        """
        parts = []
        for i, (kind, value) in enumerate(query["parts"]):
            for j, word in enumerate(value if kind == "phrase" else [value]):
                hit = F.col("stem") == stem_word(word) if stemmed else F.col("term").startswith(word) if kind == "prefix" else F.col("term") == word
                parts.append((hit, F.struct(F.lit(i).alias("part"), F.lit(j).alias("place"))))
        if not parts:
            return self.log.spark.createDataFrame([], "doc long")
        state = self.log.last()
        rows = self._rows(state, self.buckets_of(query, stemmed), reduce(lambda a, b: a | b, [h for h, _ in parts]))
        served = rows.select("doc", "positions", F.explode(F.array_compact(F.array(*[F.when(h, s) for h, s in parts]))).alias("_s")).select("doc", "_s.*", "positions")
        sizes = F.element_at(F.array(*[F.lit(len(v) if k == "phrase" else 1) for k, v in query["parts"]]), F.col("part") + 1)
        # Of several terms of one place, as stems have, and of several rows of one id all positions count.
        places = served.groupBy("doc", "part", "place").agg(F.flatten(F.collect_list(F.transform("positions", lambda p: p - F.col("place")))).alias("at"))
        met = places.groupBy("doc", "part").agg(F.collect_list("at").alias("all"))
        shared = F.aggregate(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), F.col("all")[0], lambda acc, x: F.array_intersect(acc, x))
        held = met.where((F.size("all") == sizes) & (F.size(shared) > 0))
        if query["any"]:
            return held.select("doc").distinct()
        return held.groupBy("doc").agg(F.count("*").alias("n")).where(F.col("n") == len(query["parts"])).select("doc")

    def cascade(self, query: dict) -> DataFrame:
        """(doc, stage): what a query matches exactly, or where nothing does what its stems match."""
        exact, stemmed = self.search(query), self.search(query, stemmed=True)
        found = exact.limit(1).agg((F.count("*") > 0).alias("any"))
        return exact.withColumn("stage", F.lit("exact")).unionByName(stemmed.join(F.broadcast(found)).where("NOT any").select("doc", F.lit("stemmed").alias("stage")))
