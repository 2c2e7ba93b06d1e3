"""Line deduplication by range-partitioned line hashes.

Every line long enough is a row (key hash, document, position); rows are range-partitioned and sorted by hash, then
document descending, then position, so a common line is dealt over as many tasks as its rows need. Each partition is
streamed: the first document of a run keeps its lines, and once a third document shows up the rest of the run loses
them. Runs that cross partitions are settled beforehand from their edges, at most two short rows to a partition. What
comes back is a compressed keep bitmap for each document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from vellum.session import cut, discard, shuffle_width, written

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = -(2**63)
ROWS = "h1 long, h2 long, doc long, text_hash long, pos int"


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, text_hash, pos) of every line whose key has min_chars code points or more; a null id sorts least."""
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line")
    )
    key = F.translate(F.btrim("line", F.lit(SPACE)), _UPPER, _LOWER)
    keyed = lines.select("doc", "text_hash", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "text_hash", "pos")


def _segments(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    h1, h2, doc, th, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    starts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
    return h1, h2, doc, th, pos, np.concatenate([[0], starts, [len(h1)]])


def _largest(docs: np.ndarray, k: int) -> list[int]:
    """The k largest distinct of documents in descending order."""
    if not len(docs):
        return []
    return docs[np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))[:k]].tolist()


def _edges(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The first and the last run of a partition, each with its k largest documents."""
    runs: list[tuple[tuple[int, int], list[int]]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, _, _, cuts = _segments(batch)
        for a, b in {(cuts[0], cuts[1]): 0, (cuts[-2], cuts[-1]): 0}:
            key, top = (int(h1[a]), int(h2[a])), _largest(doc[a:b], k)
            if runs and runs[-1][0] == key:
                runs[-1] = key, sorted({*runs[-1][1], *top}, reverse=True)[:k]
            else:
                runs = [*runs[:1], (key, top)]
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in runs]), pa.array([r[0][1] for r in runs]), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["h1", "h2", "docs"])


def _dropped(batches: Iterator[pa.RecordBatch], crossing: dict[tuple[int, int], int | None], k: int) -> Iterator[pa.RecordBatch]:
    """Rows that lose their line. crossing: runs that may cross partitions, with their largest document, None if they stay."""
    held: tuple[np.ndarray, ...] | None = None

    def settle(doc, th, pos, cuts, whole):
        """Rows of complete runs that have k documents or more and aren't of the run's first document."""
        run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        step = np.append(True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1]))
        number = np.cumsum(step)
        rank = number - number[cuts[:-1]][run]
        many = np.maximum.reduceat(rank, cuts[:-1])[run] >= k - 1
        return many & (rank > 0) & whole[run]

    def rows(th, doc, pos, drop):
        return pa.RecordBatch.from_arrays([pa.array(doc[drop]), pa.array(th[drop]), pa.array(pos[drop])], names=["doc", "text_hash", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
            held = None
        h1, h2, doc, th, pos, cuts = _segments(batch)
        last = int(cuts[-2])
        if (int(h1[last]), int(h2[last])) not in crossing:
            held = batch.slice(last)  # a run within this partition, perhaps going on
            batch, cuts = batch.slice(0, last), cuts[:-1]
            h1, h2, doc, th, pos = h1[:last], h2[:last], doc[:last], th[:last], pos[:last]
            if not last:
                continue
        whole = np.ones(len(cuts) - 1, dtype=bool)
        known = np.zeros(len(doc), dtype=bool)
        for s in {0, len(cuts) - 2}:
            key = int(h1[cuts[s]]), int(h2[cuts[s]])
            if key in crossing:
                whole[s] = False
                if (top := crossing[key]) is not None:
                    known[cuts[s] : cuts[s + 1]] = doc[cuts[s] : cuts[s + 1]] != top
        if (drop := settle(doc, th, pos, cuts, whole) | known).any():
            yield rows(th, doc, pos, drop)
    if held is not None:
        h1, h2, doc, th, pos, cuts = _segments(held)
        if (drop := settle(doc, th, pos, cuts, np.ones(len(cuts) - 1, dtype=bool))).any():
            yield rows(th, doc, pos, drop)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, drops): positions of the lines a document loses; documents that lose none have no row."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("text_hash"), F.col("pos")]
    rows = written(line_rows(docs, id_col, text_col, min_chars), "lines")  # once, as ranges are sampled before rows are dealt
    lined = cut(rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order))
    discard(rows)
    # Two rows to a partition at most, min_docs numbers each.
    merged: dict[tuple[int, int], set[int]] = {}
    for r in lined.mapInArrow(lambda it: _edges(it, min_docs), "h1 long, h2 long, docs array<long>").collect():
        merged.setdefault((r.h1, r.h2), set()).update(r.docs)
    crossing = {key: max(ids) if len(ids) >= min_docs else None for key, ids in merged.items()}
    gone = lined.mapInArrow(lambda it: _dropped(it, crossing, min_docs), "doc long, text_hash long, pos int")
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("drops"))


def _keep(text: str, drops: list[int] | None) -> tuple[int, int, bytes, str]:
    """Lines, lines dropped, the compressed keep bitmap, and the text that the bitmap gives back."""
    keep = np.ones(text.count("\n") + 1, dtype=bool)
    keep[drops or []] = False
    bitmap = zlib.compress(np.packbits(keep).tobytes())
    return len(keep), len(drops or ()), bitmap, kept_text(text, bitmap)


def kept_text(text: str, bitmap: bytes) -> str:
    """The lines that a document's bitmap keeps."""
    lines = text.split("\n")
    keep = unpack(bitmap, len(lines))
    return text if keep.all() else "\n".join([lines[i] for i in np.flatnonzero(keep)])


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def _finish(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, drops = batch.column(batch.schema.get_field_index("text")).to_pylist(), batch.column(batch.schema.get_field_index("drops")).to_pylist()
        made = [_keep(t or "", d) for t, d in zip(texts, drops, strict=True)]
        new = [pa.array([m[i] for m in made], k) for i, k in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))]
        new.append(pa.array([m[3] for m in made], pa.string()) if with_text else pa.array([hashlib.sha256(m[3].encode()).hexdigest() for m in made], pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", "n_lines", "n_dropped", "keep", "kept" if with_text else "kept_sha256"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = False) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns but the text), n_lines, n_dropped, keep, and kept_sha256 or kept.

    A line's key is the line without spaces at its ends, A-Z in lower case. Keys of min_chars code points or more found
    in min_docs documents or more lose all their lines but those of the largest id. keep is the zlib-compressed bitmap
    of lines that stay (unpack()). Null and empty texts are one empty line. Documents are told apart by id; a null id is one
    more document and sorts least (the id -2^63 counts as null); rows of one id and text fare alike. An empty table gives no
    rows. The text kept, or its digest, is made from the bitmap (kept_text()).
    """
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs)
    others = [c for c in docs.columns if c != text_col]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    joined = left.join(drops.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("row", "text", "drops")
    schema = StructType().add("row", joined.schema["row"].dataType).add("n_lines", LongType()).add("n_dropped", LongType())
    schema = schema.add("keep", BinaryType()).add("kept" if with_text else "kept_sha256", StringType())
    return joined.mapInArrow(lambda it: _finish(it, with_text), schema)
