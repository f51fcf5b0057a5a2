"""Queries ``opN_<name>`` over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many labelled ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their main text, markup, address suffix and host; documents by text, ``lang`` and ``source``."""
    from assayer.llm import htmltext, langid

    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("host"), F.col("lang").alias("declared"), "text", none.alias("markup"))
    rows = rows.union(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), langid.host_of(F.col("url")), langid.declared_in(F.col("html")), none, F.col("html")))
    told = langid.identify(rows, langid.train(docs), htmltext.main_text)
    number = F.expr("try_cast(substring(id, 2) AS bigint)")
    return told.select(F.when(F.col("id").startswith("d"), number).alias("doc_id"), F.when(F.col("id").startswith("p"), number).alias("page_id"), "lang", "confidence", "rejected")


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is every document that is labelled as of good quality; the background is every document."""
    from assayer.llm.common import keep
    from assayer.llm.lmscore import score_corpus

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("chosen", F.lit(True))
    few = good.count() <= BROADCAST_IDS
    marked = docs.join(F.broadcast(good) if few else good, "doc_id", "left").select("doc_id", "text", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    return score_corpus(marked if few else keep(marked, "marked"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=toxicity.label_part() != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(toxicity.label_part() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), "predicted", F.size("passages").cast("long").alias("n_passages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.bpe import encode_decode

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm import media

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    features = media.read_media(media.store(docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")), "body"))
    name = F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    page = docs.select("doc_id", F.concat(F.lit("<article><p>"), name, F.lit('</p><figure><img src="sha256:'), media.payload_digest(F.col("text")), F.lit('"><figcaption>payload of '), name, F.lit("</figcaption></figure></article>")).alias("html"))
    resolved = media.resolve(media.parse_sequences(page, "doc_id", "html"), features)
    return resolved.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.chat import format_conversations, read_back

    hard = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_conversations(rows.unionByName(extra)))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|') AS hard_text,
    contains(role, '<|im_start|>') OR contains(role, '<|im_end|>') OR contains(role, '<|n|>') OR contains(role, chr(10)) OR regexp_matches(role, '<\\+\|') AS hard_role FROM turns
), written AS (
  SELECT *, length('<|im_start|>') + 1 + length('<|im_end|>') + 1
    + length(CASE WHEN hard_role THEN replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|n|>') ELSE role END)
    + length(CASE WHEN hard_role OR hard_text THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END) AS chars FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets
), entries AS (SELECT doc_id, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS c FROM sizes
  UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.doc_id
)
SELECT sizes.doc_id, sizes.n AS n_shingles, min(reach.c) AS component_id
FROM sizes JOIN reach ON reach.doc_id = sizes.doc_id GROUP BY sizes.doc_id, sizes.n
"""

QUERIES = {
    "op1_topk": op1_topk,
    "op2_media": op2_media,
    "op3_htmltext": op3_htmltext,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_langid": op6_langid,
    "op7_lmscore": op7_lmscore,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_jaccard": op10_jaccard,
}
#: The others can't be expressed in SQL; their tests hold them against brute force, a library or a round trip.
SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op5_chat": OP5_SQL, "op10_jaccard": OP10_SQL}
