import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

from .test_jaccard import brute

STEMS = {"en": ["the", "tion", "ing", "wh", "and", "er"], "de": ["ung", "keit", "sch", "der", "ein", "ge"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted rejects, toxic texts and copies."""
    r = random.Random(7)
    rows, toxic, odd, labels = [], set(), set(), []
    for i in range(500):
        lang = r.choice([*STEMS])
        words = ["".join(r.choice(STEMS[lang]) for _ in range(r.randint(2, 4))) for _ in range(r.randint(40, 120))]
        if i % 7 == 0:
            toxic.add(i)
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(["vilest", "scummy", "moronic"]))
        rows.append([i, " ".join(words), lang, f"src{i % 4}"])
        labels.append((i, int(i in toxic)))
    for i in range(500, 560):  # copies of clean documents, exact and near
        words = rows[r.choice([x for x in range(500) if x not in toxic])][1].split()
        if i % 2:
            words[r.randrange(len(words))] = "theder"
        rows.append([i, " ".join(words), "en", "src0"])
    for i, text in enumerate([None, "", "123 456 --", "漢字 仮名 交じり 文章 です"], 560):
        rows.append([i, text, "en", "src1"])
        odd.add(i)
    rows = [(i, t, x, s, len(t or "")) for i, t, x, s in rows]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
    return str(d), {r[0]: r[1] for r in rows}, toxic, odd


def test_stages(spark, corpus):
    d, texts, toxic, odd = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    told = pipeline.language(spark, docs, d).cache()
    assert told.columns == list(pipeline.COLUMNS)
    assert {r.doc_id for r in told.collect()} == set(texts) - odd
    civil = pipeline.civil(spark, told, d).cache()
    left = {r.doc_id for r in civil.collect()}
    assert civil.columns == list(pipeline.COLUMNS)
    assert not left & toxic and len(set(texts) - odd - toxic - left) <= 3
    distinct = pipeline.distinct(spark, civil, d).cache()
    kept = {r.doc_id for r in distinct.collect()}
    assert kept == {doc for doc, _, group in brute([(i, texts[i]) for i in sorted(left)]) if doc == group}
    lib, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(int)
    pieces = pipeline.packed(spark, distinct, d).collect()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id]
        at[p.doc_id] += p.length
    assert dict(at) == {i: len(lib.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept}


def test_run_and_empty_tables(spark, corpus, tmp_path):
    d, *_ = corpus
    assert pipeline.run(spark, d).select("doc_id").distinct().count() > 300
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id_stay(spark):
    docs = spark.createDataFrame([(None, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.without(docs, docs.where("doc_id = 2")).collect()} == {None, 1}
