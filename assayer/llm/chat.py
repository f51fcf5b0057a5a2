r"""Chat formatting with a grammar round trip.

A turn is ``<|im_start|>ROLE\nTEXT<|im_end|>\n``.  It is first rendered as it
is and read back by the parser; only where the recovered turn differs from the
source is the conflicting content escaped, and it is parsed again until both
are identical.  The escape puts one more backslash into every ``<`` +
backslashes + ``|``, so no text can hold a control string, and taking one
backslash away again restores every text.  A line break in a role becomes
``<|n|>``.

A conversation streams through in turn order and leaves in parts of whole
turns of about ``PART_CHARS`` characters, so memory does not grow with its
length; an ordinary conversation is one part.  Rows of one conversation must
meet in one task, since a digest of the whole is sequential.

Defined cases: null text or role is empty; a null conversation id is one
conversation; rows with equal turn are ordered by role, then text, and repeated
rows are repeated turns; a null turn comes first; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ship, slices

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|n|>"
TRAINED = "assistant"
PART_CHARS = 1 << 20
PARTS = "conv_id long, part long, formatted string, loss array<struct<start: int, end: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_RAISE, _LOWER = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _RAISE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _LOWER.sub(r"<\1|", text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns as (role, text, start and end of the text in ``formatted``); ValueError if it is not of the grammar."""
    at = 0
    while at < len(formatted):
        head = formatted.find("\n", at)
        close = formatted.find(END, head + 1)
        if not formatted.startswith(START, at) or head < 0 or close < 0 or not formatted.startswith("\n", close + len(END)):
            raise ValueError(f"not a turn at {at}")
        role, text = formatted[at + len(START) : head], formatted[head + 1 : close]
        if START in role or START in text or END in role:
            raise ValueError(f"control string inside the turn at {at}")
        yield unescape(role.replace(BREAK, "\n")), unescape(text), head + 1, close
        at = close + len(END) + 1


def _write(role: str, text: str) -> str:
    return f"{START}{role}\n{text}{END}\n"


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string and where its text lies in it."""
    for r, t in ((role, text), (role, escape(text)), (escape(role).replace("\n", BREAK), escape(text))):
        out = _write(r, t)
        try:
            got = [*parse(out)]
        except ValueError:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return out, got[0][2], got[0][3]
    raise AssertionError("the escape is reversible, so this can't be reached")


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, part, pieces, spans, size, opened = None, 0, [], [], 0, False

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([conv], pa.int64()),
                pa.array([part], pa.int64()),
                pa.array(["".join(pieces)], pa.string()),
                pa.array([spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ],
            ["conv_id", "part", "formatted", "loss"],
        )

    for batch in slices(batches):
        done = []
        for key, role, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), _texts(batch.column(2)), strict=True):
            if opened and (key != conv or size >= PART_CHARS):
                done.append(out())
                part, pieces, spans, size = (part + 1 if key == conv else 0), [], [], 0
            conv, opened = key, True
            turn, start, end = render_turn(role, text)
            if role == TRAINED:
                spans.append({"start": size + start, "end": size + end})
            pieces.append(turn)
            size += len(turn)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if opened:
        yield out()


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted parts of every conversation with the spans under the loss mask.

    One shuffle, by conversation; parts of a conversation follow each other in
    their partition in order.
    """
    ship(df.sparkSession)
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_render, PARTS)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    conv, opened, turns, learnt, n, chars, formatted = None, False, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def flush() -> None:
        rows.append((conv, n, turns.hexdigest(), chars, learnt.hexdigest(), formatted))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in slices(batches):
        for key, part, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if opened and (key != conv or part == 0):
                flush()
                turns, learnt, n, chars, formatted = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            conv, opened = key, True
            for role, said, _, _ in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                learnt.update(said.encode())
                chars += len(said)
            formatted += len(text)
        if rows:
            yield batch_of()
            rows.clear()
    if opened:
        flush()
        yield batch_of()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of the turns and of the masked text, parsed out of formatted parts in their partition's order."""
    return parts.select("conv_id", "part", "formatted", "loss").mapInArrow(_digest, DIGESTS)
