"""Fill-in-middle: texts cut in three at two ranks of their units and put together in another order.

A text is matched twice, left to right. The first pass counts its units; from the count and the row's hashes follow two ranks.
The second advances an iterator of matches to the lower rank, then on to the upper one, and reads where it stands. Neither
keeps a match: what is held beside the text is a counter and two offsets, however long the text.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
#: Of a hundred texts so many stay plain or, of those that change, have the suffix first.
KEEP_FROM, SUFFIX_FIRST = 90, 20


def hashes(id_: Column, seed: int = 1) -> Column:
    """The first four 8-digit groups of the sha-256 of seed, colon and id as unsigned integers; a null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def n_units(matches: Iterator) -> int:
    """How many matches an iterator yields; none is kept."""
    ticks = count()
    deque(zip(matches, ticks, strict=False), maxlen=0)
    return next(ticks)


def offsets(text: str, unit: re.Pattern, low: int, high: int) -> tuple[int, int]:
    """Where the units of two ranks, low <= high, end in a text; rank 0 ends at 0. What follows the last unit belongs to it."""
    matches, ends, done = unit.finditer(text), [], 0
    for rank in (low, high):
        if rank > done:
            at, done = next(islice(matches, rank - done - 1, None)).end(), rank
        ends.append(at if rank else 0)
    return ends[0], ends[1]


def form_of(text: str, h: list[int]) -> str:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= KEEP_FROM:
        return "plain"
    return "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"


def transform(text: str, h: list[int], unit: re.Pattern) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, characters of the prefix, of the middle) of a text; the last two are null if it stays plain."""
    n = n_units(unit.finditer(text))
    form = form_of(text, h)
    if form == "plain":
        return n, form, text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = offsets(text, unit, a, b)
    if b == n:
        i, j = len(text) if a == n else i, len(text)  # what no unit matches after the last one
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    output = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, form, output, i, j - i


def restore(output: str, form: str) -> str:
    """The text that an output was made of: no part holds a mark, and marks start and end unlike, so the first of each is the mark."""
    if form == "plain":
        return output
    head, rest = output.split(SUFFIX if form == "psm" else PREFIX, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return head[len(PREFIX) :] + middle + tail if form == "psm" else tail + middle + head[len(SUFFIX) :]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int = 1, digests: bool = False) -> DataFrame:
    """One row per row of docs: row (a struct of all its columns but the text), n, form, prefix_chars, middle_chars, and output, or the
    digests output_sha256 and restored_sha256, the latter of the text rebuilt from output and form.

    unit is a pattern whose matches, left to right, are counted and cut at. Null and empty texts have no units and stay
    plain, as do texts that hold a mark. Rows of one id and text get the same cut; a null id hashes as the empty string. An empty table gives no
    rows. Nothing is shuffled; an Arrow batch is what a task holds.
    """
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), hashes(F.col(f"`{id_col}`"), seed).alias("h"))
    schema = StructType().add("row", source.schema["row"].dataType).add("n", LongType()).add("form", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType())
    for name in ("output_sha256", "restored_sha256") if digests else ("output",):
        schema = schema.add(name, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            made: list[tuple] = []
            for text, h in zip(batch.column(1), batch.column(2), strict=True):
                n, form, output, prefix, middle = transform(text.as_py(), h.as_py(), pattern)
                made.append((n, form, prefix, middle, *((_sha(output), _sha(restore(output, form))) if digests else (output,))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array([m[k] for m in made], kinds[k]) for k in range(6 if digests else 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return source.mapInArrow(run, schema)
