"""Cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary: every word of the corpus and the target, one mark
for words in neither and one for the start of a text.  Word and bigram counts are
taken over every text; the target's come from the target texts.  Probabilities are
bigram counts with a Dirichlet prior at the model's own unigrams, which are smoothed
by one.  A text's score is the mean over its tokens of the target's loss less the
background's: lower is more like the target.

Bigrams of the ``DENSE`` most frequent words are counted in square tables of 17 MB a
model that are broadcast.  A bigram with any other word goes, with its place in its text,
to the task of that word (the second, if both are such words), where all of the word's
tokens meet: that task counts the word and its bigrams for both models and sends
losses back by text.  There are more such tasks as the texts grow, and no other
word has more than a share of 1 / ``DENSE`` of the tokens.  Words are told apart by
hashes of 63 bits.

With a ``size`` the vocabulary is the so many most frequent words of the corpus, all
others are one word, and the tables hold everything.

Defined cases: texts and words may be of any length, one text at a time in memory; a null or
empty text has no tokens and null losses; a corpus without
words scores nothing; target texts may also be in the corpus; repeated rows count as
often as they occur; ties between equally frequent words go to the smaller word; empty
tables give empty tables; other columns are ignored; a task that runs again has to read its
rows in the same order, as it does from files.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import keep, map_slices, releasing, ship, slices

#: Words whose bigrams are counted in broadcast tables; those of all others are counted by shuffles.
DENSE = 2046
#: Weight of the unigrams in a bigram's probability.
WEIGHT = 20.0
#: Distinct words or bigrams that a task counts before it hands them on.
HELD = 500_000
#: Tokens that a task gathers before it deals them out, and tokens that one task receives.
CHUNK, BUCKET = 1_000_000, 1_000_000
#: What a text is for: to count in the background, in the target, to be scored.
IN_CORPUS, IN_TARGET, SCORED = 1, 2, 4
WORDS = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, loss_difference double"


@dataclass
class Open:
    """Of each model, target first: logarithms of contexts' weights, unigrams' shares of the prior, and its denominator; NaN stands for other words."""

    contexts: tuple[np.ndarray, np.ndarray]
    priors: tuple[np.ndarray, np.ndarray]
    totals: tuple[float, float]


@dataclass
class Model:
    """Losses (negative natural logarithms) by previous and next token; ``open`` and ``texts`` (text, role) where other words are told apart."""

    ids: dict[str, int]
    target: np.ndarray
    background: np.ndarray
    open: Open | None = None
    texts: DataFrame | None = None

    def tokens(self, text: str) -> np.ndarray:
        other = len(self.ids)
        return np.fromiter((self.ids.get(w, other) for w in WORDS.findall(text.lower())), np.int64)


class Numbers(dict):
    """Words as numbers: small ones for those of the tables, hashes above 2^63 for others."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self.ids = ids

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
            self.update(self.ids)
        self[word] = number = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") | 1 << 63
        return number


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts.keys()], pa.string()), pa.array([*counts.values()], pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(WORDS.findall((text or "").lower()))
        if len(counts) > HELD:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _counted(texts: DataFrame) -> DataFrame:
    """Every word of all texts with its count."""
    return texts.select("text").mapInArrow(releasing(_words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _first(counted: DataFrame, size: int) -> list[str]:
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def _bigrams(texts: DataFrame, ids: dict[str, int]) -> np.ndarray:
    """Counts by previous and next token; the row after the words is for other words, the last for the start."""
    shared = texts.sparkSession.sparkContext.broadcast(ids)
    size = len(ids) + 2

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value, np.zeros(0), np.zeros(0))
        keys, times, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(times)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])

        for batch in slices(batches):
            pairs = []
            for text in batch.column(0).to_pylist():
                t = own.tokens(text or "")
                if len(t):
                    pairs.append(np.concatenate(([size - 1], t[:-1])) * size + t)
            if pairs:
                k, n = np.unique(np.concatenate(pairs), return_counts=True)
                keys.append(k)
                times.append(n)
                held += len(k)
            if held > 4 * HELD:
                yield out()
                keys, times, held = [], [], 0
        if keys:
            yield out()

    # At most size^2 rows, whatever the corpus.
    found = texts.select("text").mapInArrow(releasing(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size, np.float64)
    table[np.asarray(found.column("pair"))] = np.asarray(found.column("n"))
    return table.reshape(size, size)


def _unigrams(counts: np.ndarray, more: int = 0) -> tuple[np.ndarray, float]:
    """Shares of the next tokens, and the denominator; ``more`` words are outside the table, each smoothed by one too."""
    unigrams = counts.sum(0) + 1
    unigrams[-1] = 0
    total = float(unigrams.sum() + more)
    return unigrams / total, total


def losses(counts: np.ndarray, more: int = 0) -> np.ndarray:
    """-ln P(next | previous) with the unigrams as prior.

    The last column, the start mark, never follows a token and has no share.
    """
    unigrams, _ = _unigrams(counts, more)
    table = (counts + WEIGHT * unigrams) / (counts.sum(1, keepdims=True) + WEIGHT)
    table[:, -1] = 1
    return -np.log(table).astype(np.float32)


def _open(both: list[np.ndarray], more: int) -> Open:
    contexts, priors, totals = [], [], []
    for counts in both:
        unigrams, total = _unigrams(counts, more)
        contexts.append(np.log(counts.sum(1) + WEIGHT))
        priors.append(WEIGHT * unigrams)
        contexts[-1][-2] = priors[-1][-2] = np.nan
        totals.append(total)
    return Open(tuple(contexts), tuple(priors), tuple(totals))


def _train(counted: DataFrame, corpus: DataFrame, target: DataFrame, dense: int) -> Model:
    counted = keep(counted, "words")
    ids = {w: i for i, w in enumerate(_first(counted, dense))}
    more = counted.count() - len(ids)
    both = [_bigrams(target, ids), _bigrams(corpus, ids)]
    return Model(ids, *(losses(x, more) for x in both), _open(both, more))


def train(corpus: DataFrame, target: DataFrame, size: int | None = None, dense: int = DENSE) -> Model:
    """Both models, from the column ``text`` of the whole corpus and of the target."""
    ship(corpus.sparkSession)
    if size is not None:
        ids = {w: i for i, w in enumerate(_first(_counted(corpus), size))}
        return Model(ids, losses(_bigrams(target, ids)), losses(_bigrams(corpus, ids)))
    corpus, target = corpus.select("text"), target.select("text")
    model = _train(_counted(corpus.union(target)), corpus, target, dense)
    return replace(model, texts=corpus.withColumn("role", F.lit(IN_CORPUS)).union(target.withColumn("role", F.lit(IN_TARGET))))


def score_corpus(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """Scores of the corpus itself (doc_id, text, chosen), the target being its rows that are ``chosen``; reads each text's tokens once for counts and scores."""
    ship(docs.sparkSession)
    model = _train(_counted(docs), docs, docs.where("chosen"), dense)
    role = F.lit(IN_CORPUS | SCORED) + F.when(F.col("chosen"), IN_TARGET).otherwise(0)
    return _score_open(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role")), model)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not model.open:
        return _score_closed(rows, model)
    counted = model.texts.select(F.lit(None).cast("long").alias("doc_id"), "text", "role")
    return _score_open(rows.withColumn("role", F.lit(SCORED)).union(counted), model)


PIECES = "chunk long, size int, part int, docs binary, keys binary, near binary, far binary, ids binary"
PARTS = "chunk long, size int, docs binary, target binary, background binary, ids binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kinds[k]) for i, (_, k) in enumerate(named)], [n for n, _ in named])


def _deal(batches: Iterable[pa.RecordBatch], model: Model, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sums of the tables' losses by text, and all bigrams with another word, by that word's bucket.

    Texts are numbered inside chunks.  A bigram is its key, the word that decides its bucket,
    and the other word: ``near`` is a number in the tables, doubled, and one more if it
    follows the key; ``far`` is a hash and comes before the key.  ``docs`` holds the
    text's number, whether the token is its last, and its role.
    """
    numbers, start, chunk = Numbers(model.ids), len(model.ids) + 1, TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    told: list[tuple] = []
    docs = tokens = 0

    def out() -> pa.RecordBatch:
        rows = []
        if told:
            known = [x for part in told for x in part[0]]
            ids = np.array([x or 0 for x in known], np.int64).tobytes() + np.array([x is not None for x in known], bool).tobytes()
            at, n, a, b = (np.concatenate([part[i] for part in told]) for i in range(1, 5))
            rows.append((chunk, docs, chunk % buckets, np.stack((at, n)).tobytes(), b"", a.tobytes(), b.tobytes(), ids))
        key, other, marks, follows = (np.concatenate([part[i] for part in held]) for i in range(4))
        bucket = (key >> np.uint64(8)) % np.uint64(buckets)
        far = other >= 1 << 63
        order = np.lexsort((far, bucket))
        key, other, marks, follows, bucket, far = (x[order] for x in (key, other, marks, follows, bucket, far))
        near = (other * np.uint64(2) + follows).astype(np.uint16)
        found, first = np.unique(bucket, return_index=True)
        for k, i, j in zip(found.tolist(), first.tolist(), [*first.tolist(), len(bucket)][1:], strict=True):
            m = i + int(np.count_nonzero(~far[i:j]))
            rows.append((chunk, docs, k, zlib.compress(marks[i:j].tobytes(), 1), key[i:j].tobytes(), near[i:m].tobytes(), other[m:j].tobytes(), None))
        return _batch(rows, PIECES)

    for batch in slices(batches):
        texts = [np.fromiter(map(numbers.__getitem__, WORDS.findall((x or "").lower())), np.uint64) for x in batch.column(1).to_pylist()]
        roles = np.asarray(batch.column(2)).astype(np.uint32)
        n = np.array([len(x) for x in texts])
        word = np.concatenate(texts)
        doc = np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(n)[n > 0]
        before = np.roll(word, 1)
        before[np.concatenate(([0], ends[:-1]))[: len(ends)]] = start
        last = np.zeros(len(word), bool)
        last[ends - 1] = True
        inside, known = word < 1 << 63, before < 1 << 63
        both = inside & known
        asked = both & ((roles & SCORED) > 0)[doc]
        where, pair = doc[asked], (before[asked].astype(np.int64), word[asked].astype(np.int64))
        sums = [np.bincount(where, table[pair].astype(np.float64), len(n)) for table in (model.target, model.background)]
        scored = np.flatnonzero(roles & SCORED)
        if len(scored):
            ids = batch.column(0).to_pylist()
            told.append(([ids[i] for i in scored], docs + scored, n[scored], *(x[scored] for x in sums)))
        rest = ~both
        follows = (inside & ~known)[rest]
        marks = (((docs + doc[rest]) * 2 + last[rest]) * 8 + roles[doc[rest]]).astype(np.uint32)
        held.append((np.where(follows, before[rest], word[rest]), np.where(follows, word[rest], before[rest]), marks, follows))
        docs, tokens = docs + len(n), tokens + int(rest.sum()) + len(n)
        if tokens > CHUNK:
            yield out()
            held, told, docs, tokens, chunk = [], [], 0, 0, chunk + 1
    if docs:
        yield out()


def _count_and_score(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """One bucket: counts all of its words and bigrams and sums the losses by text."""
    chunks: list[tuple[int, int]] = []
    held: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                yield _batch([(row["chunk"], row["size"], row["docs"], row["near"], row["far"], row["ids"])], PARTS)
                continue
            marks = np.frombuffer(zlib.decompress(row["docs"]), np.uint32)
            near, far = np.frombuffer(row["near"], np.uint16).astype(np.uint64), np.frombuffer(row["far"], np.uint64)
            held.append((np.frombuffer(row["keys"], np.uint64), np.concatenate((near, far)), marks, np.full(len(marks), len(chunks), np.int64)))
            chunks.append((row["chunk"], row["size"]))
    if not held:
        return
    key, other, marks, chunk = (np.concatenate([part[i] for part in held]) for i in range(4))
    held.clear()
    roles, last, doc = marks & 7, (marks & 8) > 0, (marks >> 4).astype(np.int64)
    far = other >= 1 << 63
    follows = ~far & ((other & np.uint64(1)) > 0)
    small = np.where(far, 0, other >> np.uint64(1)).astype(np.int64)
    _, word = np.unique(key, return_inverse=True)
    mixed = (other ^ other >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    _, pair = np.unique(key ^ mixed ^ mixed >> np.uint64(32), return_inverse=True)
    asked = (roles & SCORED) > 0
    sums = []
    for i, role in enumerate((IN_TARGET, IN_CORPUS)):
        n = ((roles & role) > 0).astype(np.float64)
        bigrams = np.bincount(pair, n)
        unigrams = np.bincount(word, n * ~follows)
        contexts = np.bincount(word, n * (~follows & ~last))
        own = model.open
        prior = np.where(follows, own.priors[i][small], WEIGHT * (unigrams[word] + 1) / own.totals[i])
        loss = -np.log(bigrams[pair] + prior)
        # The context before the key, if it is in the tables; and the key as the next token's context.
        loss += np.where(far | follows, 0, own.contexts[i][small])
        loss += np.where(follows | last, 0, np.log(contexts[word] + WEIGHT))
        sums.append(loss[asked])
    place, at = np.unique(chunk[asked] << 32 | doc[asked], return_inverse=True)
    target, background = (np.bincount(at, x, len(place)).astype(np.float32) for x in sums)
    found, first = np.unique(place >> 32, return_index=True)
    for k, i, j in zip(found.tolist(), first.tolist(), [*first.tolist(), len(place)][1:], strict=True):
        yield _batch([(*chunks[k], zlib.compress((place[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes(), 1), target[i:j].tobytes(), background[i:j].tobytes(), None)], PARTS)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each text's losses over the buckets, chunk by chunk."""
    sums: dict[int, np.ndarray] = {}
    told: dict[int, tuple] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = sums.setdefault(row["chunk"], np.zeros((2, row["size"])))
            if row["ids"] is not None:
                at, n = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
                told[row["chunk"]] = row["ids"], at, n
                kind = np.float64
            else:
                at, kind = np.frombuffer(zlib.decompress(row["docs"]), np.uint32), np.float32
            for i, name in enumerate(("target", "background")):
                total[i, at] += np.frombuffer(row[name], kind)
    for chunk, (ids, at, n) in told.items():
        none = n == 0
        a, b = sums.pop(chunk)[:, at] / np.maximum(n, 1)
        known = np.frombuffer(ids, bool, offset=8 * len(n))
        doc_id = pa.array(np.frombuffer(ids, np.int64, len(n)), mask=~known)
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(n), *(pa.array(x, mask=none) for x in (a, b, a - b))], [x.split()[0] for x in SCHEMA.split(", ")])


def _score_open(rows: DataFrame, model: Model) -> DataFrame:
    """Scores of the rows (doc_id, text, role) whose role says so."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(replace(model, texts=None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A token and what divides it from the next take two characters at least, six as a rule.
    buckets = max(parts, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (6 * BUCKET))
    dealt = rows.mapInArrow(releasing(lambda x: _deal(x, shared.value, buckets)), PIECES).repartitionById(buckets, F.col("part"))
    counted = dealt.mapInArrow(releasing(lambda x: _count_and_score(x, shared.value)), PARTS)
    return counted.repartitionById(parts, F.pmod(F.shiftright("chunk", 32), F.lit(parts)).cast("int")).mapInArrow(releasing(_gather), SCHEMA)


def _score_closed(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        size = len(own.ids) + 2

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                t = own.tokens(text or "")
                if not len(t):
                    rows.append((0, None, None, None))
                    continue
                before = np.concatenate(([size - 1], t[:-1]))
                a, b = (float(x[before, t].mean(dtype=np.float64)) for x in (own.target, own.background))
                rows.append((len(t), a, b, a - b))
            n, a, b, d = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array(d, pa.float64())], [x.split()[0] for x in SCHEMA.split(", ")])

        return each

    return map_slices(rows, make, SCHEMA)
