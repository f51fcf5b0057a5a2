import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm.packing import CAPACITY, Chunks, Packer, classes, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, lengths, capacity=CAPACITY):
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, sequence, offset in pieces:
        docs[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for doc, n in lengths.items():
        at = 0
        for start, length in sorted(docs[doc]):
            assert start == at
            at += length
        assert at == n
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, sum(lengths.values()))


def test_every_token_once_and_little_padding():
    r = random.Random(3)
    lengths = {i: r.choice([1, 2, 4096, 4097, r.randint(1, 9000), r.randint(1, 90)]) for i in range(3000)}
    packer = Packer()
    pieces = [p for doc, n in lengths.items() for p in packer.add(doc, n)] + [*packer.finish()]
    assert check(pieces, lengths) < 0.002


def test_classes():
    assert classes(8) == [(8, 1), (4, 2), (2, 4), (1, 8)] and (1365, 3) in classes(4096)
    with pytest.raises(ValueError):
        classes(1000)


def test_chunk_memory_matches_the_library():
    ours, lib = Chunks(PATH), Tokenizer.from_file(PATH)
    r = random.Random(4)
    for _ in range(500):
        text = "".join(r.choice("abCDeHtsn" * 4 + " \n\t\r \u0085\x1c'éÉßΣİ1,.<|漢́") for _ in range(r.randint(0, 300)))
        if r.random() < 0.2:
            text += "<|endoftext|>It's we'Re"
        assert [*np.frombuffer(ours.ids(text), "<u4")] == lib.encode(text, add_special_tokens=False).ids


def test_frame(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 50000, 5), (3, "word " * 50000, 5), (4, "a b c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(1)
    out = pack(df, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    by = defaultdict(list)
    for x in out:
        assert len(x.ids) == 4 * x.length
        by[x.doc_id].append(x)
    for doc in (1, 2, 4):
        ids = b"".join(bytes(x.ids) for x in sorted(by[doc], key=lambda x: x.start))
        assert [*np.frombuffer(ids, "<u4")] == [*lib.encode(dict((r[0], r[1] or "") for r in rows)[doc], add_special_tokens=False).ids, 2]
        assert {x.doc_tokens for x in by[doc]} == {len(ids) // 4}
    assert sum(x.length for x in by[3]) == 2 * 50001
    check([(0, 0, x.length, x.sequence_id, x.offset) for x in out if False], {})
    assert pack(df.limit(0), PATH).count() == 0
