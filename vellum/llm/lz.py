"""Lempel-Ziv phrase fingerprints: documents are alike when they compress with the same phrases.

LZ78 parses a text into phrases, each the longest known phrase and one more character. The fingerprint is the
one-permutation minimum-hash signature of the phrase set: every phrase hash falls into one of the bins and each bin
keeps its least; empty bins take the value of the next full bin (rotation densification). The share of equal bins estimates
the Jaccard similarity of the phrase sets. A text's parse never looks ahead, so a parser can be copied part-way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vellum.session import shuffle_width, written

BINS = 128
_HASH = xxhash.xxh3_64_intdigest
PAIR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
PAIR_NAMES = [x.split()[0] for x in PAIR_SCHEMA.split(", ")]
PAIR_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def parse(text: str, known: set[str] | None = None) -> tuple[set[str], str]:
    """The phrase set of a text and its unfinished last phrase, which is a known one. known: phrases so far, changed in place.

    Phrase sets are closed under prefixes, so the search for a phrase's end starts from the last phrase's length
    and moves either way.
    """
    phrases = set() if known is None else known
    at, n, length = 0, len(text), 1
    while at < n:
        end = at + length
        if text[at:end] in phrases:
            end += 1
            while text[at:end] in phrases:
                if end > n:
                    return phrases, text[at:]
                end += 1
            if end > n:
                return phrases, text[at:]
        else:
            while end - 1 > at and text[at : end - 1] not in phrases:
                end -= 1
        end = min(end, n)
        phrases.add(text[at:end])
        length = end - at
        at = end
    return phrases, ""


def signature(phrases: set[str], bins: int = BINS) -> np.ndarray:
    """The low 16 bits of each bin's minimum; all ones for no phrases."""
    if not phrases:
        return np.full(bins, 0xFFFF, dtype=np.uint16)
    hashes = np.fromiter(map(_HASH, phrases), dtype=np.uint64, count=len(phrases))
    low = np.full(bins, 1 << 32, dtype=np.uint64)
    np.minimum.at(low, (hashes % np.uint64(bins)).astype(np.int64), hashes >> np.uint64(32))
    full = np.flatnonzero(low < 1 << 32)
    source = full[np.searchsorted(full, np.arange(bins)) % len(full)]
    return ((low[source] + (np.arange(bins) != source) * np.uint64(0x9E37)) & np.uint64(0xFFFF)).astype(np.uint16)


def fingerprint(text: str | None, bins: int = BINS) -> np.ndarray:
    """Of a whole text; null is empty. The last, unfinished phrase is known already and adds nothing."""
    return signature(parse(text or "")[0], bins)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def lz_fingerprint(text: Column) -> Column:
    """The fingerprint's bytes; equal texts have equal ones. Null is an empty text."""
    return F.udf(lambda x: fingerprint(x).tobytes(), "binary", useArrow=True)(text)


def _edited(text: str, after: str) -> tuple[str, str]:
    """What stays of a text and its new tail: the last third gives way to as many of the next text's first characters."""
    n = len(text) // 3
    return text[: len(text) - n], after[:n]


def _pair(doc_id, text: str, after: str, own: np.ndarray, next_print: np.ndarray, head: tuple[set[str], str]) -> tuple:
    kept, tail = _edited(text, after)
    phrases, open_ = head
    other = signature(parse(open_ + tail, phrases)[0])
    return doc_id, len(text), hashlib.sha256((kept + tail).encode()).hexdigest(), own.tobytes(), other.tobytes(), likeness(own, other), likeness(own, next_print)


def _own(text: str) -> tuple[np.ndarray, tuple[set[str], str]]:
    """A text's fingerprint, and the parse of what an edit keeps of it."""
    kept = text[: len(text) - len(text) // 3]
    phrases, open_ = parse(kept)
    head = set(phrases), open_
    return signature(parse(open_ + text[len(kept) :], phrases)[0]), head


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or ""


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order. Each but a partition's last is compared with the row after it; the partition's first and last texts come out too, with its number."""
    names, kinds = [*PAIR_NAMES, "edge", "text", "part"], [*PAIR_KINDS, pa.string(), pa.string(), pa.int32()]
    part = TaskContext.get().partitionId()
    out: list[tuple] = []

    def flush():
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return done

    held = None
    for doc_id, text in _rows(batches):
        own, head = _own(text)
        if held is None:
            out.append((doc_id, *[None] * 6, "first", text, part))
        else:
            out.append((*_pair(held[0], held[1], text, held[2], own, held[3]), None, None, None))
        held = doc_id, text, own, head
        if len(out) >= 1000:
            yield flush()
    if held is not None:
        out.append((held[0], *[None] * 6, "last", held[1], part))
        yield flush()


def _seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for doc_id, text, nxt in zip(ids, texts, after, strict=True):
            own, head = _own(text or "")
            rows.append(_pair(doc_id, text or "", nxt or "", own, fingerprint(nxt), head))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), PAIR_KINDS, strict=True)], names=PAIR_NAMES)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses; one row per row of docs.

    The next document is the one with the next lower id (nulls last, equal ids by the text's hash), after the last the first; a
    lone document is its own next. Documents are range-partitioned by that order once. Each partition handles its
    own neighbours in a stream; the seams, one to a partition, are handled after it, the two texts of each joined by the partition's number. Null and empty texts are alike:
    no phrases, likeness 1 to each other. An empty table gives no rows; extra columns are not read.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # by hash, so that no text is sampled for the ranges
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lined = rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    chained = written(lined.mapInArrow(_chain, f"{PAIR_SCHEMA}, edge string, text string, part int"), "chained")
    # The numbers of partitions with rows are put in order, one short row each; the texts at their edges meet by them, a seam to a task.
    parts = chained.where("edge = 'first'").select("part")
    order_of = W.orderBy("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(order_of), F.min("part").over(W.partitionBy(F.lit(0)))).alias("next"))
    firsts = chained.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    lasts = chained.where("edge = 'last'").select("part", "doc_id", "text").join(after, "part")
    seams = lasts.join(firsts.hint("shuffle_hash"), "next").select("doc_id", "text", "after", "part")
    seams = seams.repartition(shuffle_width(docs.sparkSession), "part").select("doc_id", "text", "after")
    pairs = chained.where("edge IS NULL").select(*PAIR_NAMES).unionByName(seams.mapInArrow(_seam, PAIR_SCHEMA))
    return pairs.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
