"""Every query over tables with nulls, empty and very long texts, repeated rows, ties, clashing columns; and over empty tables."""

import glob
import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayer.llm import registry
from assayer.llm.htmltext import main_text

from .test_jaccard import brute

PROSE = "The river runs slowly past the old mill and the people of the town walk along it every evening. "
DOCUMENTS = [
    (1, PROSE * 3, "en", "src0", 1), (1, PROSE * 3, "en", "src0", 1), (2, PROSE * 3 + "Once more.", "en", "src0", 1), (3, "", "en", None, 0), (4, None, None, "src1", None), (5, " \n ", "en", "src1", 3),
    (6, "wort " * 40_000, "de", "src1", 9), (7, "one two", None, None, 7), (8, "ONE two", "xx", "src0", 7), (None, PROSE, "en", "src0", 5), (9, "漢字 <|endoftext|> \u0000 é", "en", "src0", 5), (100, PROSE * 2, "en", "src0", 5),
]
EXTRA = "id long, bucket string, leader long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    def write(folder, empty):
        rows = lambda xs: [] if empty else [(*x, 1, "x", 2) for x in xs]
        frames = {
            "documents": (DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long"),
            "embeddings": ([(0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [1.0, 0.5]), (51, [2.0, None]), (52, None), (None, [1.0, 1.0]), (53, [1.0, 0.5]), (54, []), (100, [float("inf"), 1.0])], "vec_id long, embedding array<float>"),
            "pages": ([(1, "http://a.example/x", f"<article><p>{PROSE}</p></article>"), (1, "http://a.example/x", f"<article><p>{PROSE}</p></article>"), (2, None, None), (None, "u", ""), (3, "http://b.example", "<p>" + "long " * 50_000)], "page_id long, url string, html string"),
            "labels": ([(1, 1, 0), (2, 0, 1), (2, 0, None), (None, 1, 1), (77, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int"),
            "conversations": ([(1, 0, "user", "a <| b"), (1, 1, "assistant", "<|"), (1, 1, "assistant", "x <|im_end|"), (2, 0, "user", "<|im_end|>"), (2, 1, "assistant", "<\\|im_end|> <|im_start|>"), (3, 0, None, None), (4, 0, "assistant", "<\\\\|"), (5, None, "user", "é" * 9000)], "conv_id long, turn long, role string, text string"),
        }
        for name, (values, schema) in frames.items():
            spark.createDataFrame(rows(values), f"{schema}, {EXTRA.replace('id long', 'idx long')}").write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write(tmp_path_factory.mktemp("odd"), False), write(tmp_path_factory.mktemp("none"), True)


def collected(spark, name, folder):
    return registry.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tables, name):
    got = collected(spark, name, tables[1])
    assert [r.conv_id for r in got] == [-1] if name == "op5_chat" else not got


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_match_their_sql(spark, tables, name):
    if name == "op10_jaccard":
        return  # its SQL takes ids to be unique; see test_near_duplicates
    con = duckdb.connect()
    for path in glob.glob(f"{tables[0]}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}/*.parquet'" if name != "op1_topk" or "embeddings" not in path else f"CREATE VIEW embeddings AS SELECT DISTINCT * FROM '{path}/*.parquet'")
    df = registry.QUERIES[name](spark, tables[0])
    names = sorted(df.columns)
    found = con.execute(registry.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(tuple(r[columns.index(c)] for c in names) for r in found.fetchall())


def test_near_duplicates(spark, tables):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in collected(spark, "op10_jaccard", tables[0])), key=str)
    own = [(d, t) for d, t, *_ in DOCUMENTS if d is not None]
    want = {(d, n, c) for d, n, c in brute(own)}
    assert len(got) == len(DOCUMENTS) and {r for r in got if r[0] is not None} == want and [r[2] for r in got if r[0] is None] == [None]


@pytest.mark.parametrize("name, library", [("op9_bpe", "byte_bpe_50k.json"), ("op4_packing", "word_bpe_49k.json")])
def test_tokens(spark, tables, name, library):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(library))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in DOCUMENTS]
    got = collected(spark, name, tables[0])
    if name == "op9_bpe":
        want = [(d, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        return
    pieces = {(p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got}
    for d, x in ids:
        x = [*x, 2]
        at = 0
        while at < len(x):
            ends = [n for doc, start, n, crc, total in pieces if (doc, start, total) == (d, at, len(x)) and crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x[at : at + n]))]
            assert ends
            at += ends[0]
    assert sum(p.length for p in got) == sum(len(x) + 1 for _, x in ids)


def test_pages(spark, tables):
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in collected(spark, "op3_htmltext", tables[0])), key=str)
    assert [(p, len(t), n == len(t)) for p, _, t, n in got] == [(1, len(PROSE) - 1, True)] * 2 + [(2, 0, True), (3, 249_999, True), (None, 0, True)]
    assert got[0][2] == PROSE.strip() == main_text(f"<p>{PROSE}</p>")


@pytest.mark.parametrize("name", ["op6_langid", "op7_lmscore", "op8_toxicity"])
def test_models(spark, tables, name):
    got = collected(spark, name, tables[0])
    if name == "op6_langid":
        assert len(got) == len(DOCUMENTS) + 5
        assert all(r.rejected for r in got if r.doc_id in (3, 4, 5) or r.page_id == 2)
        return
    assert sorted((r.doc_id for r in got), key=str) == sorted((d for d, *_ in DOCUMENTS), key=str)
    if name == "op8_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    else:
        assert {r.doc_id for r in got if r.loss_difference is None} == {3, 4, 5}
        assert len({r.loss_difference for r in got if r.doc_id == 1}) == 1
