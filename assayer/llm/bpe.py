"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as the ids of the parts between its remaining boundaries and a
second array with the merge rank of every adjacent pair.  The smallest rank is
found by a linear scan, its boundary is deleted, and the ranks of the two
neighbouring pairs are looked up anew.  For words of a few bytes, nearly all
of them, that touches a few adjacent array cells and needs no heap.  Above
``SHORT`` bytes a heap over a linked list makes the same merges in n log n.

Defined cases: a vocabulary file with another normalizer, splitter or model is an error; texts
and words may be of any length; a null or empty text has no ids and decodes to the empty
string; a special token's string in a text is that token; repeated rows give
repeated results; an empty table gives an empty table.  Only the two named
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_slices

# The split pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Settings of a model that this module doesn't know.
ODD = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
#: Bytes up to which the linear scan is used.
SHORT = 128
#: Words remembered by one worker; the memory is emptied when full.
REMEMBERED = 200_000
NONE = 1 << 60
SCHEMA = "doc_id long, ids array<int>, decoded string"


def _byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Ids by word, worked out on first sight."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.codec.merge(word.encode("utf-8")))
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(model.get(k) for k in ODD):
            raise ValueError(f"{path} is no plain byte-level BPE, which splits texts by the pattern of this module")
        vocab, chars = model["vocab"], _byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        self.byte_ids = [vocab[c] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode("utf-8")
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode("utf-8")
        self.split = regex.compile(PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self)

    def merge(self, word: bytes) -> list[int]:
        if len(word) > SHORT:
            return self.merge_long(word)
        parts = [self.byte_ids[b] for b in word]
        rank_of, made = self.pairs.get, self.made
        ranks = [rank_of(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NONE:
            at = ranks.index(low)  # the leftmost of equals
            parts[at : at + 2] = [made[low]]
            del ranks[at]  # the boundary
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NONE)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NONE)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges, smallest rank first and then leftmost, by a heap over a linked list."""
        n = len(word)
        part = [self.byte_ids[b] for b in word]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, at, part[at], part[at + 1]) for at in range(n - 1) if (rank := self.pairs.get((part[at], part[at + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            to = after[at]
            if to < 0 or part[at] != left or part[to] != right:
                continue  # one of the two has been merged since
            part[at], part[to] = self.made[rank], -1
            after[at] = after[to]
            if after[to] >= 0:
                before[after[to]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b >= 0 and (new := self.pairs.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (new, a, part[a], part[b]))
        return [p for p in part if p >= 0]

    def encode(self, text: str) -> list[int]:
        if self.at_special and any(s in text for s in self.special):
            pieces = self.at_special.split(text)
            return [*chain.from_iterable([self.special[p]] if p in self.special else self.encode_plain(p) for p in pieces)]
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.words.__getitem__, self.split(text)))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec and its word memory for each worker process."""
    return Codec(path)


def encode_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text, and the text that these ids decode to.

    ``vocab_path`` must exist on every worker.  Rows are independent: no shuffle.
    """

    def make():
        own = codec(vocab_path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

        return each

    return map_slices(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)
