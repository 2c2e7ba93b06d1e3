"""Near-duplicate detection with BagMinHash signatures of word-shingle multisets.

A document is the multiset of its five-word shingles (lower-cased runs of letters and digits; a text of one to four
words is a single shingle). For each distinct shingle a hierarchy of Poisson processes over the discretised weight
axis [0,1), [1,2), [2,4), [4,8) ... yields points (time, component, weight level); a document keeps the points below
its own count, and component k of the signature is the earliest time seen there. Two documents share a component
exactly with the probability of their weighted Jaccard similarity. Times are drawn only up to the horizon at which all
components are filled, so the number of points hardly depends on the document's length.

Bands of the signature name candidates, exact multiset overlap verifies them, and classes are connected components.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.operators.components import connected_components
from vellum.session import discard, written

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: Bands and rows of the finer signatures for what the pivots leave apart; a pair at the threshold is missed once in 20,000,
#: as by the first bands.
FINE_BANDS, FINE_ROWS = 220, 14
#: One bit of each of so many signature components is kept too: pairs that share a fine key are verified only if their bits
#: agree as those of a pair at the threshold do, or less often by up to SIGMAS standard deviations (one in 50,000 falls below).
SKETCH_BITS, SIGMAS = 3072, 4.1
#: Words that a worker turns into signatures at once.
BATCH_WORDS = 200_000
#: A group of exact copies is hot if it holds more than one row in so many; there are fewer hot groups than that.
HOT = 1_000
_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_EMPTY = np.zeros(0, dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on wrapping 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of every shingle, given word hashes and each document's offsets into them."""
    counts = np.diff(offsets)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    n = len(words)
    with np.errstate(over="ignore"):
        powers = [_mix(np.array([k + 1], dtype=_U))[0] | _U(1) for k in range(size)]
        if n >= size:
            h = sum((words[k : n - size + 1 + k] * powers[k] for k in range(1, size)), words[: n - size + 1] * powers[0])
            whole = doc_of[: n - size + 1] == doc_of[size - 1 :]
            docs, hashes = doc_of[: n - size + 1][whole], _mix(h[whole])
        else:
            docs, hashes = np.zeros(0, dtype=np.int64), _EMPTY
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            extra = np.zeros(len(short), dtype=_U)
            for k in range(size - 1):
                has = counts[short] > k
                extra[has] += words[offsets[short[has]] + k] * powers[k]
            docs, hashes = np.concatenate([docs, short]), np.concatenate([hashes, _mix(extra + counts[short].astype(_U))])
    return docs, hashes


def counted(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, occurrence number from 0) in order of document and shingle."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    starts = np.flatnonzero(new)
    return docs, hashes, np.arange(len(docs)) - np.repeat(starts, np.diff(np.append(starts, len(docs))))


def coded(hashes: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """A multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    with np.errstate(over="ignore"):
        return _mix(hashes + _mix(occurrence.astype(_U)) * _U(3))


def bag_signatures(docs: np.ndarray, hashes: np.ndarray, occurrence: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m earliest arrival times; rows of empty documents stay infinite."""
    sig = np.full(n_docs * m, np.inf)
    if not len(docs):
        return sig.reshape(n_docs, m)
    last = np.ones(len(docs), dtype=bool)
    last[:-1] = occurrence[1:] == 0
    doc, elem, weight = docs[last], hashes[last], occurrence[last] + 1
    total = np.bincount(docs, minlength=n_docs)
    # A process for each dyadic block of the weight axis below the element's weight: [0,1), [1,2), [2,4) ...
    parts = [(doc, elem, np.zeros(len(doc), dtype=np.int64), np.ones(len(doc), dtype=np.int64), weight)]
    low = 1
    while (more := weight > low).any():
        k = int(more.sum())
        parts.append((doc[more], elem[more], np.full(k, low), np.full(k, low), weight[more]))
        low *= 2
    doc, elem, low_, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        seed = _mix(elem + _mix(low_.astype(_U)))
    horizon = m * (np.log(m) + 5.0) / np.maximum(total, 1)
    todo = np.ones(len(doc), dtype=bool)
    while todo.any():
        d, s, lo, wd, w = doc[todo], seed[todo], low_[todo], width[todo], weight[todo]
        t, step = np.zeros(len(d)), 0
        while len(d):
            with np.errstate(over="ignore"):
                r = _mix(s + _U(2 * step + 1) * _GOLD)
                t = t - np.log(_unit(r)) / wd
                r = _mix(r)
            live = t < horizon[d]
            d, s, lo, wd, w, t, r = d[live], s[live], lo[live], wd[live], w[live], t[live], r[live]
            level = lo + ((r >> _U(32)) % wd.astype(_U)).astype(np.int64)
            keep = level < w
            np.minimum.at(sig, d[keep] * m + (r[keep] & _U(0xFFFFFFFF)).astype(np.int64) % m, t[keep])
            step += 1
        lacking = np.isinf(sig.reshape(n_docs, m)).any(axis=1) & (total > 0)
        horizon = np.where(lacking, horizon * 2, horizon)
        todo = lacking[doc]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = _mix(sig[:, : bands * rows].copy().view(_U)).reshape(len(sig), bands, rows)
        key = np.zeros(bits.shape[:2], dtype=_U)
        for k in range(rows):
            key = _mix(key + bits[:, :, k])
    return key.view(np.int64)


def _banded(keys: np.ndarray) -> np.ndarray:
    """Keys that name their band too."""
    with np.errstate(over="ignore"):
        return keys ^ np.arange(keys.shape[1], dtype=np.int64) * np.int64(0x1E3779B97F4A7C15)


def _sums(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of values by (sorted) document."""
    ends = np.searchsorted(docs, np.arange(n + 1))
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(values, dtype=_U)])
        return run[ends[1:]] - run[ends[:-1]]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False).view(_U)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _ids(values: np.ndarray, docs: np.ndarray, n: int) -> pa.Array:
    """128-bit multiset hashes as binary(16)."""
    both = np.stack([_sums(values, docs, n), _sums(_mix(values ^ _M1), docs, n)], axis=1).astype(">u8")
    return pa.array([x.tobytes() for x in both], type=pa.binary())


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_WORDS words, so that memory follows neither the batch nor, but for one document, its texts."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((ends - ends[0]) // BATCH_WORDS, prepend=-1)[:-1])
        for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
            yield batch.slice(a, b - a)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in _sliced(batches, 1):
        words, offsets = _flat(batch.column(1))
        docs, hashes, occ = counted(*shingles(words, offsets))
        sig = bag_signatures(docs, hashes, occ, batch.num_rows, bands * rows)
        full = np.isfinite(sig[:, 0])
        keys = _banded(band_keys(sig[full], bands, rows))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)), pa.array(keys.ravel()))
        sizes = pa.array(np.bincount(docs, minlength=batch.num_rows).astype(np.int64))
        columns = [batch.column(0), _ids(coded(hashes, occ), docs, batch.num_rows), lists, sizes, batch.column(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "exact", "bands", "size", "text_md5"])


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finer band keys and bit sketches of coded multisets, whose elements all weigh 1."""
    for batch in _sliced(batches, 1):
        values, offsets = _flat(batch.column(1))
        n = batch.num_rows
        docs = np.repeat(np.arange(n), np.diff(offsets))
        sig = bag_signatures(docs, values, np.zeros(len(docs), dtype=np.int64), n, FINE_BANDS * FINE_ROWS)
        bits = (_mix(sig[:, :SKETCH_BITS].copy().view(_U)) >> _U(17)) & _U(1)
        sketches = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
        columns = [batch.column(0)]
        for rows in (_banded(band_keys(sig, FINE_BANDS, FINE_ROWS)), sketches):
            columns.append(pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel())))
        yield pa.RecordBatch.from_arrays(columns, names=["id", "keys", "sketch"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, items): the coded multisets of texts."""
    for batch in _sliced(batches, 1):
        words, offsets = _flat(batch.column(1))
        docs, hashes, occ = counted(*shingles(words, offsets))
        ends = np.searchsorted(docs, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(coded(hashes, occ).view(np.int64)))], names=["id", "items"])


def multiset_items(text: str) -> list[int]:
    """The coded multiset of one text, its words hashed by xxhash as in word_hashes()."""
    words = np.array([xxhash.xxh64_intdigest(w, seed=42) for w in re.findall(r"[^\W_]+", text.lower())], dtype=_U)
    docs, hashes, occ = counted(*shingles(words, np.array([0, len(words)])))
    return coded(hashes, occ).view(np.int64).tolist()


def word_hashes(text):
    """Column: hashes of the text's lower-cased words; null and empty texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def text_md5(text_col: str = "text") -> Column:
    """The text's MD5; empty for null, which is a text of its own."""
    return F.coalesce(F.md5(text_col), F.lit(""))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, exact, bands, size, text_md5): the multiset's 128-bit hash, the band keys of its signature (none if it is empty), its size, the text's hash."""
    words = docs.select(F.col(id_col).alias("doc_id"), word_hashes(F.col(text_col)).alias("w"), text_md5(text_col).alias("text_md5"))
    return words.mapInArrow(lambda it: _sign(it, bands, rows), "doc_id long, exact binary, bands array<long>, size long, text_md5 string")


def _pivoted(placed: DataFrame, order: Column, pivot: Column) -> DataFrame:
    """(key, id, part, size, pivot, pivot_part, pivot_size) of the buckets that hold several parts; the pivot is the member of least order."""
    lead = placed.groupBy("key").agg(F.min(F.struct(order.alias("least"), "part", "size")).alias("first"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    lead = lead.where("lo <> hi").select("key", F.col("first.least").alias("least"), F.col("first.part").alias("pivot_part"), F.col("first.size").alias("pivot_size"))
    return placed.join(lead.withColumn("pivot", pivot).drop("least"), "key").select("key", "id", "part", "size", "pivot", "pivot_part", "pivot_size")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows (key, id, part ...) of the buckets that hold several parts."""
    several = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return placed.join(several, "key", "left_semi")


def _close(x: str, y: str, threshold: float) -> Column:
    """Whether two multisets' sizes allow the threshold: the smaller has at least that share of the larger."""
    return F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9


def _to_pivot(placed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, pa, pb) of a pivot and a member of another part whose sizes allow the threshold."""
    met = placed.where("part <> pivot_part").where(_close("size", "pivot_size", threshold))
    return met.select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("pivot_part").alias("pa"), F.col("part").alias("pb")).distinct()


def _items(docs: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(id, items): the coded multisets of members, each made from the text of its group's least row.

    Rows of one id and text are made one before the shuffle, so repeated rows do not gather in a task.
    """
    key = ["k", "nul", "text_md5"]
    of = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("nul"), "text_md5"]
    wanted = groups.join(members, "id").select("id", "first.doc_id", "first.text_md5").select("id", *of)
    texts = docs.select("doc_id", "text", text_md5().alias("text_md5")).select("text", *of).groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(wanted.hint("shuffle_hash"), key).select("id", word_hashes(F.col("text")).alias("w")).mapInArrow(_expand, "id long, items array<long>")


def _alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two sketches differ in no more bits than those of a pair at the threshold may."""
    share = (1 - threshold) / 2
    most = SKETCH_BITS * share + SIGMAS * (SKETCH_BITS * share * (1 - share)) ** 0.5
    return reduce(Column.__add__, (F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_BITS // 64))) <= int(most)


def _verified(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The (pa, pb) of the pairs a, b whose multisets reach the threshold."""
    a, b = items.select(F.col("id").alias("a"), F.col("items").alias("x")), items.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(b, "b").join(a, "a").where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both)).select("pa", "pb").distinct()


def _merged(parts: DataFrame, pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """parts (id, part) after verified pairs (a, b of the parts pa, pb) made parts one; the old table goes."""
    links = written(_verified(pairs, items, threshold), "links")
    into = connected_components(links, "pa", "pb")
    new = written(parts.join(into.select(F.col("node").alias("part"), "component"), "part", "left").select("id", F.coalesce("component", "part").alias("part")), "parts")
    discard(links, into, parts)
    return new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, exact: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, class_id, exact_id, class_size.

    exact_id is the least doc_id with the same shingle multiset, class_id the least doc_id of the connected component
    over links of weighted Jaccard >= threshold, class_size its number of rows. Only distinct multisets are compared.
    In each bucket every member is verified against a pivot, which then has met all the others and leaves the bucket. Members
    of buckets that still hold several components are banded by finer signatures, whose buckets have a pivot each too; pairs
    of different components that still meet there are verified one by one if their sketches agree (see SKETCH_BITS). No bucket is capped, and a large bucket of
    unlike members is split by its members' likeness. A pair at the threshold is missed by each step once in 20,000 or less, others
    more rarely; exact=True adds a join on rare shingles that misses none (see exact_links).

    Null and empty texts (no words) are equal to each other and form one class. Repeated rows are copies; a null doc_id
    counts as greater than any; rows of one id are told apart by their texts. An empty table gives no rows. Extra columns are not read.
    """
    signed = written(signatures(docs, id_col, text_col, bands, rows), "signed")
    named = _parts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), signed, threshold, exact)
    classes = named.groupBy("part").agg(F.min("first.doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = named.join(classes, "part").select("exact", F.col("first.doc_id").alias("exact_id"), "class_id", "class_size", "n")
    # Groups that hold more than one row in HOT are fewer than HOT, so they go to the rows; the rest meets by hash.
    hot = F.col("n") * HOT > signed.count()
    own, many = signed.select("doc_id", "exact"), F.broadcast(named.where(hot))
    few = own.join(many.select("exact"), "exact", "left_anti").join(named.where(~hot), "exact")
    columns = ["doc_id", "class_id", "exact_id", "class_size"]
    return own.join(many, "exact").select(*columns).unionByName(few.select(*columns))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_md5) of one row of each class: the least doc_id, nulls last, then the least text_md5.

    Unlike class_id, which classes may share where ids are null or repeated, the two name a class's text.
    """
    signed = written(signatures(docs, bands=bands, rows=rows), "signed")
    least = _parts(docs, signed, threshold).groupBy("part").agg(F.min("first").alias("first"))
    return least.select("first.doc_id", "first.text_md5")


def _parts(docs: DataFrame, signed: DataFrame, threshold: float, exact: bool = False) -> DataFrame:
    """(exact, n, first, part) of each distinct multiset: its rows, its least row, and the part that names its class."""
    kept = ["exact", "n", "first"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "text_md5")).alias("first")
    groups = signed.groupBy("exact").agg(F.count("*").alias("n"), first, F.min("bands").alias("bands"), F.min("size").alias("size"))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    sizes = groups.select("id", "size")
    buckets = groups.select("id", F.explode("bands").alias("key"), F.col("id").alias("part"), "size")
    shared = written(_pivoted(buckets, F.col("id"), F.col("least")), "shared")
    members = groups.select("id") if exact else shared.select("id").distinct()
    parts = written(members.withColumn("part", F.col("id")), "parts")
    items = written(_items(docs, groups, parts.select("id")), "items")
    parts = _merged(parts, _to_pivot(shared, threshold), items, threshold)

    # Members of buckets that still hold several parts get finer signatures; a bucket's pivot has met all of it and leaves it.
    left = _mixed(shared.where("id <> pivot").select("key", "id").join(parts, "id")).select("id").distinct()
    keyed = items.join(left, "id", "left_semi").select("id", "items").mapInArrow(_refine, "id long, keys array<long>, sketch array<long>")
    keyed = written(keyed, "keyed")
    discard(shared)

    # The finer buckets have pivots too, each by an order of its own, so that members of one group meet other pivots in other
    # buckets; only what these leave apart is compared in pairs.
    of_key, back = F.col("id").bitwiseXOR(F.col("key")), F.col("least").bitwiseXOR(F.col("key"))
    fine = keyed.select("id", F.explode("keys").alias("key")).join(sizes, "id")
    fine = written(_pivoted(fine.join(parts, "id"), of_key, back), "fine")
    sketch = keyed.select("id", "sketch")
    l, r = (sketch.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    met = _to_pivot(fine, threshold).join(r, "b").join(l, "a").where(_alike(F.col("sa"), F.col("sb"), threshold))
    parts = _merged(parts, met.select("a", "b", "pa", "pb"), items, threshold)

    rest = written(_mixed(fine.where("id <> pivot").select("key", "id", "size").join(parts, "id")).join(sketch, "id"), "rest")
    discard(fine, keyed)
    l, r = (rest.select("key", F.col("id").alias(x), F.col("part").alias(f"p{x}"), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    met = l.join(r, (l["key"] == r["key"]) & F.expr("pa < pb") & _close("na", "nb", threshold) & _alike(F.col("sa"), F.col("sb"), threshold))
    parts = _merged(parts, met.select("a", "b", "pa", "pb").distinct(), items, threshold)
    if exact:
        parts = _merged(parts, exact_links(items.join(parts, "id"), threshold), items, threshold)

    named = written(groups.select("id", *kept).join(parts, "id", "left").select(*kept, F.coalesce("part", "id").alias("part")), "named")
    discard(groups, items, rest, parts)
    return named


def exact_links(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b, pa, pb): candidate pairs of different parts among (id, items, part); none that reaches the threshold is left out.

    Elements are ordered by how many multisets hold them, rare ones first. Two multisets of the threshold's likeness share
    an element among their first |x| - ceil(threshold |x|) + 1, and neither is smaller than the threshold's share of the other.
    Counts and order are by a shuffle of all elements, several times the input, and buckets of common elements are joined in
    pairs: a check of the bands on tables of moderate size, not the way for all of a corpus.
    """
    each = items.select("id", "part", F.size("items").alias("n"), F.explode("items").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("df"))
    ordered = each.join(often.where("df > 1"), "e", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "e"))
    first = ordered.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("df > 1")
    l, r = (first.select("e", F.col("id").alias(x), F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    return l.join(r, (l["e"] == r["e"]) & F.expr("pa < pb") & _close("na", "nb", threshold)).select("a", "b", "pa", "pb").distinct()
