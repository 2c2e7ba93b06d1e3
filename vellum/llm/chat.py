"""Chat formatting with a black-box template and incremental rendering.

The formatter knows the template only as a function from turns to text. It renders every prefix of a conversation, each
longer by one turn, and takes what each turn adds as that turn's span; a template whose output for a longer prefix does not begin
with its output for the shorter one rewrites history, and is reported. Within the spans, the template's own marks are found
and texts unescaped, so turns and the loss mask are read back from the output. A template that rewrites history has no
spans; its output is searched from the start instead, turn after turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellum.session import shuffle_width

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]
#: A turn read back: role, text, and where its escaped text lies in the output.
Read = tuple[str, str, int, int]
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|over|>"
#: Strings a text may not hold unescaped: this template's marks, and those of common others.
CONTROL = [START, MIDDLE, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def escape(text: str) -> str:
    """Backslashes double, and one breaks each control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def template(turns: list[Turn]) -> str:
    """The default template: every turn between marks, role and text escaped."""
    return "".join(f"{START}{escape(role)}{MIDDLE}{escape(text)}{END}" for role, text in turns)


def spans(turns: list[Turn], render: Render = template) -> tuple[str, list[tuple[int, int]] | None]:
    """The whole output, and each turn's span in it; None if the template rewrites history at any prefix.

    All prefixes are rendered, so the work grows with the square of a conversation's turns; two renderings are held.
    """
    before, found = "", []
    for k in range(len(turns)):
        after = render(turns[: k + 1])
        if not after.startswith(before):
            return render(turns), None
        found.append((len(before), len(after)))
        before = after
    return before, found


def turn_in(piece: str) -> tuple[str, str, int, int] | None:
    """(role, text, start, end) of the default template's turn in a piece of its output; None if there is none."""
    a = piece.find(START)
    b = piece.find(MIDDLE, a + 1)
    c = piece.find(END, b + 1)
    if min(a, b, c) < 0:
        return None
    return unescape(piece[a + len(START) : b]), unescape(piece[b + len(MIDDLE) : c]), b + len(MIDDLE), c


def read_back(formatted: str, found: list[tuple[int, int]] | None, read: Callable[[str], Read | None] = turn_in) -> list[Read]:
    """(role, text, start, end) of every turn; start and end hold the escaped text.

    Each span holds a turn. Without spans, turns are taken from the output one after another, as far as there are any.
    """
    rows = []
    if found is None:
        at = 0
        while got := read(formatted[at:]):
            rows.append((got[0], got[1], at + got[2], at + got[3]))
            at += got[3] + 1
        return rows
    for a, b in found:
        got = read(formatted[a:b])
        if got is None:
            raise ValueError("no turn at this span")
        rows.append((got[0], got[1], a + got[2], a + got[3]))
    return rows


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    key, turns, any_ = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if any_ and conv != key:
                yield key, turns
                turns = []
            key, any_ = conv, True
            turns.append((role or "", text or ""))
    if any_:
        yield key, turns


def _format(batches: Iterator[pa.RecordBatch], digests: bool, render: Render, read: Callable[[str], Read | None]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()] if digests else [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string())])), pa.bool_()]
    names = [x.split()[0] for x in DIGESTS.split(", ")] if digests else ["conv_id", "formatted", "turns", "rewrites_history"]

    def flush():
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return done

    for conv, turns in _conversations(batches):
        formatted, found = spans(turns, render)
        back = read_back(formatted, found, read)
        if digests:
            said, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, text, _, _ in back:
                said.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss.update(text.encode())
                    chars += len(text)
            rows.append((conv, len(back), said.hexdigest(), chars, loss.hexdigest(), len(formatted), found is None))
        else:
            rows.append((conv, formatted, [{"start": a, "end": b, "role": role} for role, _, a, b in back], found is None))
        size += len(formatted)
        if len(rows) >= 2000 or size > 8_000_000:
            yield flush()
            size = 0
    if rows:
        yield flush()


def format_chats(turns: DataFrame, digests: bool = False, render: Render = template, read: Callable[[str], Read | None] = turn_in) -> DataFrame:
    """One row per conv_id: the formatted text with each turn's text span and role, or their digests read back from it.

    render is the template, a black box; read finds one turn in a piece of its output. rewrites_history says that some
    prefix's output is not the start of the next one's; such a conversation keeps its text, and its turns are those that read
    finds in it in order. Turns go by turn number, nulls first, ties by role and text, repeated rows stay. Null roles and texts
    are empty; a null conv_id is one conversation. A conversation is one output value and is made by one task, which
    streams its partition's sorted rows and holds one conversation at a time. An empty table gives no rows; extra columns are not read.
    """
    rows = turns.select("conv_id", "role", "text", "turn").repartition(shuffle_width(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = DIGESTS if digests else "conv_id long, formatted string, turns array<struct<start:long,end:long,role:string>>, rewrites_history boolean"
    return rows.select("conv_id", "role", "text").mapInArrow(lambda it: _format(it, digests, render, read), schema)


def probe(spark) -> DataFrame:
    """Conversation -7, whose texts hold another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
