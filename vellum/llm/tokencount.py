"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as their single token are proven, and a
pre-token equal to one of them counts 1 without any merging. Only the rest is merged, each distinct string once per worker
while the bounded memo holds it. Counts are those of the library: special strings in texts are tokens of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from vellum.llm.pretokens import splitter

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Distinct merged strings a worker remembers.
MEMO = 400_000


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet by its rule: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def prove(path: str) -> tuple[Tokenizer, frozenset[str], tuple[str, ...]]:
    """The tokenizer, the strings proven to encode alone as one token, and its special strings."""
    tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
    special = tuple(x.content for x in tokenizer.get_added_tokens_decoder().values())
    strings = {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            strings[bytes(letters[c] for c in token).decode()] = number
        except (UnicodeDecodeError, KeyError):
            continue  # part of a character: never a pre-token
    names = [s for s in strings if s and s not in special]
    proven = [s for s, e in zip(names, tokenizer.encode_batch(names, add_special_tokens=False), strict=True) if e.ids == [strings[s]]]
    return tokenizer, frozenset(proven), special


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proven; others are merged on first sight."""

    def __init__(self, tokenizer: Tokenizer, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.tokenizer, self.proven, self.full = tokenizer, proven, len(proven) + MEMO

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.full:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self[piece] = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return n


def counter(path: str):
    """text -> number of tokens."""
    tokenizer, proven, special = prove(path)
    counts, split = _Counts(tokenizer, proven), splitter()
    look = counts.__getitem__

    def count(text: str) -> int:
        if not any(s in text for s in special):
            return sum(map(look, split(text)))
        parts = [text]
        for s in special:
            parts = [p for x in parts for p in x.split(s)]
        return len(parts) - 1 + sum(sum(map(look, split(p))) for p in parts)

    return count


def _run(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        text = pc.fill_null(batch.column(1), "")
        n_bytes = pc.cast(pc.binary_length(text), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(map(count, text.to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    path: a byte-level BPE file of the tokenizers library, readable on every executor, whose special strings match as they
    stand (its flags to strip or to match normalised text are not followed). Null texts are empty and count 0; ids may be
    null or repeated; an empty table gives no rows; extra columns are not read. No shuffle.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: _run(it, path), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
