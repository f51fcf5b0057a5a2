"""The corpus pipeline: language ID, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's ``docs``.  All but the last return the
columns of ``documents``; columns beside them are left out.

Defined cases: a null or empty text, or one without letters, is rejected by the first stage
if its row has an id; texts may be of any length.  A row with a null id can't be named by a
rejection, so it passes the first and third stage and is judged by its own text in the second.
Rows with the same id are one document: a rejection of one rejects all in the first
stage, and the third keeps them all or none; repeated rows of a kept document stay.  Of near
duplicates the smallest id stays, so there are no ties.  Documents without labels or sources are scored
like others.  Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import jaccard, langid, packing, toxicity
from assayer.llm.common import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many rejected ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``dropped``; rows with a null id stay."""
    ids = keep(dropped.select("doc_id").where("doc_id is not null").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``source`` is the host, ``lang`` the declaration."""
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("host"), F.col("lang").alias("declared"), "text", none.alias("markup"))
    told = langid.identify(rows, langid.train(docs))
    return without(docs, told.where("rejected").select(F.col("id").cast("long").alias("doc_id")))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxicity; the labels are those of the documents that are left."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=toxicity.label_part() != 0)
    scored = toxicity.score(docs, model, carry=COLUMNS)
    return scored.where("predicted = 0").select("carried.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    groups = jaccard.near_duplicates(docs)
    return without(docs, groups.where("doc_id <> component_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language), ("toxicity", civil), ("n-gram Jaccard join", distinct), ("packing", packed)]
#: Trained models and packing can't be expressed in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, f"stage-{k}")
    return docs
