"""Byte-level BPE by a global shuffle of distinct words.

Texts are exploded into pre-tokens with their positions, block by block: a block's sequence of word numbers is kept in
pieces, and its distinct words go, by hash, to the tasks of a global word shuffle. A word's hash names one task, so every
distinct word of the whole table is encoded once; its ids are joined back to the blocks that hold it, and blocks are
reassembled by position. Decoding looks ids up in the token-byte table, an Arrow array of the vocabulary's size in every
task, as a broadcast join would. Sequences and word lists travel as compressed columns through two shuffles: a row for
each pre-token, as plain rows would have it, takes several times the input's size.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vellum.llm.pretokens import splitter
from vellum.session import shuffle_width

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of a block, whose words are listed once, and of a piece, whose sequence is held at once.
BLOCK_CHARS, PIECE_CHARS = 32_000_000, 2_000_000
#: Kinds of a block's rows: a piece's documents and sequence, the tasks of its words, and a task's words.
PIECE, PLACES, WORDS = range(3)
BLOCKS = "kind int, block long, part int, ids array<long>, lengths binary, data binary"
KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(path: str) -> pa.BinaryArray:
    """The token-byte table; ids are its places."""
    with open(path, "rb") as lines:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """uint32 numbers by byte planes, compressed."""
    return _pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(data), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _explode(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block. Words are numbered as they appear, so frequent ones have low numbers."""
    split, block, chars = splitter(), TaskContext.get().partitionId() << 32, 0
    words: defaultdict[str, int] = defaultdict(count().__next__)
    ids: list[int | None] = []
    codes: list[np.ndarray] = []
    size, held, number = 0, False, count()

    def home() -> int:
        """A task for a row that only passes the word shuffle: another one for each."""
        return zlib.crc32(struct.pack("<qq", block, next(number))) % parts

    def piece() -> pa.RecordBatch:
        nonlocal size, held
        held = True
        lengths = np.fromiter(map(len, codes), dtype=np.uint32, count=len(codes))
        row = (PIECE, block, home(), list(ids), _planes(lengths), _planes(np.concatenate(codes)))
        ids.clear(), codes.clear()
        size = 0
        return _rows([row])

    def dictionary() -> Iterator[pa.RecordBatch]:
        nonlocal block, chars, words, held
        held = False
        utf8 = [w.encode() for w in words]
        part = np.fromiter((zlib.crc32(w) % parts for w in utf8), dtype=np.uint32, count=len(utf8))
        yield _rows([(PLACES, block, home(), None, None, _planes(part))])
        order = np.argsort(part, kind="stable")
        for p, group in zip(*_grouped(part[order], order), strict=True):
            mine = [utf8[i] for i in group]
            yield _rows([(WORDS, block, int(p), None, _planes(np.fromiter(map(len, mine), dtype=np.uint32, count=len(mine))), _pack(b"".join(mine)))])
        block, chars, words = block + 1, 0, defaultdict(count().__next__)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            pieces = split(text)
            ids.append(doc_id.as_py())
            codes.append(np.fromiter(map(words.__getitem__, pieces), dtype=np.uint32, count=len(pieces)))
            size, chars = size + len(text), chars + len(text)
            if size >= PIECE_CHARS:
                yield piece()
            if chars >= BLOCK_CHARS:
                if ids:
                    yield piece()
                yield from dictionary()
    if ids:
        yield piece()
    if held:
        yield from dictionary()


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """Runs of equal (sorted) keys."""
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.append(0, cuts)].tolist(), np.split(values, cuts)


def _cuts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Word lists to id lists; other rows pass. Words of equal hash are all in this task, so each is encoded once.

    The task holds its distinct words: those of one of the session's shuffle partitions.
    """
    piece = encoding(path)._encode_single_piece
    known: dict[bytes, bytes] = {}
    for batch in batches:
        lists = batch.column(0).to_numpy() == WORDS
        lengths, data = batch.column(4).to_pylist(), batch.column(5).to_pylist()
        for i in np.flatnonzero(lists):
            text, at = _unpack(data[i]), _cuts(_numbers(lengths[i])).tolist()
            found = []
            for a, b in zip(at, at[1:]):
                word = text[a:b]
                got = known.get(word)
                if got is None:
                    got = known[word] = np.array(piece(word), dtype="<u4").tobytes()
                found.append(got)
            lengths[i] = _planes(np.fromiter(map(len, found), dtype=np.uint32, count=len(found)) // 4)
            data[i] = _planes(np.frombuffer(b"".join(found), dtype="<u4"))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lengths, pa.binary()), pa.array(data, pa.binary())], names=batch.schema.names)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of consecutive runs: starts[0], starts[0]+1, ... for each length."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _assemble(rows: pa.Table, table: pa.BinaryArray, digests: bool) -> pa.Table:
    """A block's documents, piece by piece: ids by position, and what the token-byte table decodes them to."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kinds = [pa.int64(), pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()]
    kind = rows.column("kind").to_numpy()
    (part,) = (_numbers(x.as_py()) for x in rows.column("data").filter(pa.array(kind == PLACES)))
    order = np.argsort(part, kind="stable")  # place in the tasks' order -> word
    mine = sorted(rows.filter(pa.array(kind == WORDS)).select(["part", "lengths", "data"]).to_pylist(), key=lambda r: r["part"])
    by_part = np.concatenate([np.zeros(0, dtype=np.uint32), *(_numbers(r["lengths"]) for r in mine)]).astype(np.int64)
    ids = np.concatenate([np.zeros(0, dtype=np.uint32), *(_numbers(r["data"]) for r in mine)])
    length, start = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
    length[order], start[order] = by_part, _cuts(by_part)[:-1]
    spelt = pc.binary_length(table).to_numpy()
    made = []
    for one in rows.filter(pa.array(kind == PIECE)).select(["ids", "lengths", "data"]).to_batches(max_chunksize=1):
        (doc_ids,), (lengths,), (data,) = (c.to_pylist() for c in one.columns)
        seq, words = _numbers(data), _cuts(_numbers(lengths))
        per_word = length[seq]
        tokens = ids[_spread(start[seq], per_word)].astype("<u4")
        at = _cuts(per_word)[words]
        text, chars = decode(tokens, table), _cuts(spelt[tokens])[at]
        for k, doc_id in enumerate(doc_ids):
            own, said = tokens[at[k] : at[k + 1]], text[chars[k] : chars[k + 1]]
            made.append((doc_id, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(said).hexdigest()) if digests else (doc_id, len(own), own.astype(np.int32), said.tobytes().decode()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)] if made else [pa.array([], k) for k in kinds], names=names)


def decode(tokens: np.ndarray, table: pa.BinaryArray, at_once: int = 1_000_000) -> memoryview:
    """The bytes of the tokens' table entries, one after another; gathered in parts, so that no array passes 2 GB."""
    parts = []
    for i in range(0, len(tokens), at_once):
        found = table.take(pa.array(tokens[i : i + at_once]))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1]
        parts.append(memoryview(found.buffers()[2])[ends[0] : ends[-1]])
    return memoryview(b"".join(parts))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, and ids and the text decoded from them, or the digests of both.

    Ids are those of ranks and pattern for the whole text, without special tokens. path: a rank file readable on every executor. Null
    texts are empty and have no ids; ids may be null or repeated; an empty table gives no rows; extra columns are not read.
    With digests, memory is a piece's, two million characters or the longest document, with the words of a block of 32 million, and in the
    word shuffle the distinct words of one of the session's shuffle partitions; without, the ids and texts of a block are held too. Words are numbered in the
    order in which a partition is read: docs must be a table as written, or made by steps that give the same rows in the same order when a lost partition is made anew.
    """
    path, spark = path or public_tokenizers.path(RANKS), docs.sparkSession
    parts = shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(lambda it: _explode(it, parts), BLOCKS).repartitionById(parts, F.col("part"))
    encoded = made.mapInArrow(lambda it: _encode(it, path), BLOCKS)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return encoded.groupBy("block").applyInArrow(lambda block: _assemble(block, token_bytes(path), digests), schema)
