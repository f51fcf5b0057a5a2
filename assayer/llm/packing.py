"""Harmonic packing of tokenized documents into fixed-capacity sequences.

A sequence has ``CAPACITY`` tokens.  Lengths fall into reciprocal-capacity
classes: class i takes pieces of floor(CAPACITY / i) tokens and fills each of
its bins with exactly i of them, for i = 1..16 and every higher power of two.
Unlike plain harmonic packing, which gives a whole document the class of its length and pads
the rest of its slot, a document is cut greedily into the largest class lengths that fit, so
a class's bins hold a fixed number of pieces, and a bin of class i lacks at most CAPACITY mod i tokens.  Every task keeps one open bin a
class and packs on its own: no shuffle, memory bounded by the classes.  Bins
still open at the end of a task are cut into powers of two, which combine into
sequences whose lengths are powers of two and need no padding.

Ids come from the tokenizers library; a word memory holds the ids of chunks
between white space, which that vocabulary never joins.

Defined cases: a null or empty text is its end id alone; a text may be of any length, one at a
time in memory; a null id stays null; repeated rows are
packed as often as they occur; an empty table gives an empty table; other
columns are ignored.  Sequence ids are unique within a result; they depend on
how the rows are dealt to tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ship, slices

CAPACITY = 4096
#: Reciprocals that get a class besides the powers of two.
RECIPROCALS = 16
END_ID = 2
#: Chunks remembered by one worker.
REMEMBERED = 600_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def classes(capacity: int) -> list[tuple[int, int]]:
    """(length, pieces in a bin), longest first, down to length 1.

    ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    lengths = {capacity // i for i in range(1, min(RECIPROCALS, capacity) + 1)} | {1 << k for k in range(capacity.bit_length())}
    return [(length, capacity // length) for length in sorted(lengths, reverse=True)]


def _byte_chars() -> list[str]:
    """The character that stands for each byte inside the model: printable ones for themselves."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else chr(next(spare)) for b in range(256)]


_CHARS = _byte_chars()
#: Runs of letters, and of ASCII signs but for the quote and the opening bracket, which may begin a suffix or a special token.
_PIECES = re.compile(r"[^\W\d_]+|[!-&(-/:;=-@\[-`{-~]+")


class Packer:
    """Takes (document, tokens) and gives pieces (document, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0):
        self.kinds = classes(capacity)
        self.next = first_sequence
        self.open: dict[int, list[tuple[object, int]]] = {length: [] for length, _ in self.kinds}
        self.count = dict(self.kinds)

    def _close(self, length: int, pieces: list[tuple[object, int]]) -> Iterator[tuple[object, int, int, int, int]]:
        for k, (doc, start) in enumerate(pieces):
            yield doc, start, length, self.next, k * length
        self.next += 1

    def add(self, doc: object, tokens: int) -> Iterator[tuple[object, int, int, int, int]]:
        start = 0
        for length, count in self.kinds:
            while tokens - start >= length:
                bin_ = self.open[length]
                bin_.append((doc, start))
                start += length
                if len(bin_) == count:
                    yield from self._close(length, bin_)
                    self.open[length] = []

    def finish(self) -> Iterator[tuple[object, int, int, int, int]]:
        """Empty the open bins into sequences of power-of-two lengths."""
        for length, _ in self.kinds:
            pieces, self.open[length] = self.open[length], []
            if length & (length - 1):
                for doc, start in pieces:
                    for bit in range(length.bit_length() - 1, -1, -1):
                        if length >> bit & 1:
                            size = 1 << bit
                            self.open[size].append((doc, start))
                            start += size
            else:
                while pieces:
                    take = min(self.count[length], 1 << (len(pieces).bit_length() - 1))
                    yield from self._close(length, pieces[:take])
                    pieces = pieces[take:]


class Chunks(dict):
    """Little-endian 32-bit ids of a chunk without ASCII white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.word = self.tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            low = chunk.lower()
            if "Σ" in chunk or not low.isalpha() or not is_normalized("NFC", chunk):
                ids = self._whole(chunk)
            elif low != chunk:
                ids = self[low]
            else:  # letters alone are one word of the vocabulary's model
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.word(low if low.isascii() else "".join([_CHARS[b] for b in low.encode()]))])
        elif len(pieces := _PIECES.findall(chunk)) > 1 and "".join(pieces) == chunk and is_normalized("NFC", chunk) and all(p.lower().isalpha() or p.isascii() and not p.isalnum() for p in pieces):
            ids = b"".join([self[p] for p in pieces])  # letters and plain signs never share a word
        else:
            ids = self._whole(chunk)
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def _whole(self, chunk: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])


def pack(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their ids (little-endian unsigned 32-bit) and place in a sequence."""
    ship(df.sparkSession)
    classes(capacity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 36)
        of = chunks(vocab_path)
        end = END_ID.to_bytes(4, "little")

        def row(piece: tuple) -> tuple:
            (doc, ids), start, length, sequence, offset = piece
            return doc, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, sequence, offset

        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = of.ids(text or "") + end
                rows += map(row, packer.add((doc, ids), len(ids) // 4))
            if rows:
                yield _batch(rows)
        if rows := [*map(row, packer.finish())]:
            yield _batch(rows)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
