import json
import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm.bpe import Codec, encode_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Codec(PATH), Tokenizer.from_file(PATH)


def test_random_texts_match_the_library(both):
    ours, lib = both
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abcdehtsn" * 3 + " \n'éß1<|漢 ") for _ in range(r.randint(0, 500)))
        if r.random() < 0.3:
            text = text.replace(" ", "")
        if r.random() < 0.2:
            text = text[:9] + "<|endoftext|>" + text[9:]
        ids = ours.encode(text)
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert ours.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_merge_alike(both):
    ours, _ = both
    r = random.Random(6)
    for _ in range(60):
        word = "".join(r.choice("aehnrst") for _ in range(r.randint(20, 120))).encode()
        assert ours.merge(word) == ours.merge_long(word)


def test_frame(spark, both):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "a b " * 30000, "y"), (4, "z" * 20000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = {r.doc_id: r for r in encode_decode(df, PATH).collect()}
    assert out[1].ids == [] and out[1].decoded == ""
    for i, text, _ in rows[1:]:
        assert out[i].ids == both[1].encode(text, add_special_tokens=False).ids and out[i].decoded == text
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_other_splitters_are_refused(tmp_path):
    spec = json.loads(Path(PATH).read_text())
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            Codec(str(other))
