"""Toxic passages by maximum-scoring segments over token log-odds.

Training counts whole words and their prefixes of ``SHORTEST`` to ``LONGEST`` letters, every
occurrence, in labelled texts.  The log-odds of
a unit has a Dirichlet prior centred on the next shorter prefix, down to
the prior of all words, so rare compounds of a telling stem lean on the stem.  A unit
scores only if the documents it appears in are significantly more often toxic
than others (likelihood ratio).  Every other token costs ``DRIFT``.

A text is scanned once: Ruzzo and Tompa's algorithm finds all maximal scoring
segments in time linear in its tokens.  Under the extreme-value law of such scores
a segment of score S in n tokens has the expected count K n exp(-lambda S)
among clean texts; lambda solves sum p(s) exp(lambda s) = 1 over the clean
training tokens, K is fitted by maximum likelihood.  A logistic curve on the best
segment's surprise and the number of significant segments gives the score.

Labels come from a sample of at most ``SAMPLE`` labelled documents by hash order,
which bounds the broadcast and the model; scoring covers whole texts of all rows.
The driver gets counts of units, a histogram of scores rounded to thousandths, sums, and
three numbers for each document of the sample.

Defined cases: texts and words may be of any length; a null or empty text has no tokens and the score of the
calibration at no evidence; labels null or without a document are ignored, an
id labelled twice is toxic if any label is; without both classes in the sample
every score is 0; repeated rows score alike; empty tables give empty tables;
columns beside the named ones are ignored or carried unread.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import keep, map_slices, releasing, ship, slices

SAMPLE = 20_000
#: Letters of the prefixes that stand between all words and the whole word.
SHORTEST, LONGEST = 3, 16
#: Weight of a unit's prior; documents that a unit is in at least; likelihood ratio and log-odds that it takes to score.
PRIOR, LEAST_DOCS, SIGNIFICANT, LEAST_SCORE = 10.0, 4, 15.0, 1.0
#: Log-odds are held below this: prefixes of one word are the same evidence again.
MOST_SCORE = 8.0
DRIFT = 0.05
#: Expected count among clean texts below which a segment is a toxic passage.
E_VALUE = 0.05
#: Words that a task remembers, and their characters; units that it counts before it tells them.
REMEMBERED, REMEMBERED_CHARS, COUNTED = 100_000, 4_000_000, 150_000
WORDS = re.compile(r"[^\W\d_]+")
PASSAGES = "array<struct<start: int, end: int, score: double, e_value: double>>"


def units(word: str) -> list[str]:
    """Prefixes from short to long, then the whole word."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


def parent(unit: str) -> str:
    """The next shorter unit."""
    return unit[:-1] if len(unit) <= LONGEST + 1 else unit[:LONGEST]


def segments(scores: Sequence[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score), by Ruzzo and Tompa.

    ``scores`` lists only positions whose token scores; the others cost ``drift``.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, the nearest earlier segment with a smaller sum before
    total, at = 0.0, 0
    for place, score in scores:
        total -= drift * (place - at)
        at = place + 1
        gain = score - drift
        if gain <= 0:
            total += gain
            continue
        start, end, left, right = place, place + 1, total, total + gain
        total = right
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
            j -= 1
        out.append((start, end, left, right, j))
    return [(s, e, r - l) for s, e, l, r, _ in out]


@dataclass
class Model:
    scores: dict[str, float]
    decay: float = 1.0  # lambda
    scale: float = 1.0  # K
    weights: tuple[float, float, float] = (0.0, 0.0, -50.0)

    def reader(self) -> Words:
        return Words(self.scores)

    def surprise(self, score: float, tokens: int) -> float:
        """-ln of the expected count among clean texts."""
        return self.decay * score - math.log(self.scale * max(1, tokens))

    def evidence(self, found: list[tuple[int, int, float]], tokens: int) -> tuple[float, float]:
        values = [self.surprise(s, tokens) for _, _, s in found]
        best = max(values, default=self.surprise(0.0, tokens))
        return max(-20.0, min(60.0, best)), math.log1p(sum(v > -math.log(E_VALUE) for v in values))

    def probability(self, found: list[tuple[int, int, float]], tokens: int) -> float:
        x = sum(w * v for w, v in zip(self.weights, (*self.evidence(found, tokens), 1.0)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class Words(dict):
    """Score by word: that of the longest known unit."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.chars = 0

    def __missing__(self, word: str) -> float:
        value = 0.0
        for unit in reversed(units(word)):
            if unit in self.scores:
                value = self.scores[unit]
                break
        if len(self) >= REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars = 0
        self[word] = value
        self.chars += len(word)
        return value

    def read(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Segments of the text and its number of tokens."""
        values = [*map(self.__getitem__, WORDS.findall(text.lower()))]
        return segments([(i, v) for i, v in enumerate(values) if v]), len(values)


COUNTS = "unit string, toxic_n long, clean_n long, toxic_docs long, clean_docs long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents by unit and label; the empty unit counts words and documents in all."""
    n: tuple[Counter, Counter] = (Counter(), Counter())
    docs: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = [*(docs[0].keys() | docs[1].keys())]
        columns = [[c[u] for u in names] for c in (n[1], n[0], docs[1], docs[0])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], [x.split()[0] for x in COUNTS.split(", ")])

    for batch in slices(batches):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: Counter = Counter()
            for word, times in Counter(WORDS.findall((text or "").lower())).items():
                own[""] += times
                for unit in units(word):
                    own[unit] += times
            own[""] += 0
            n[toxic].update(own)
            docs[toxic].update(own.keys())
        if len(docs[0]) + len(docs[1]) > COUNTED:
            yield out()
            for c in (*n, *docs):
                c.clear()
    if docs[0] or docs[1]:
        yield out()


def _log_odds(counts: dict[str, tuple[int, int, int, int]]) -> dict[str, float]:
    """Scores of the units; 0 for known ones that say nothing though a prefix of theirs does."""
    all_n1, all_n0, docs1, docs0 = counts[""]
    base, base_docs = (all_n1 + 1) / (all_n1 + all_n0 + 2), docs1 / (docs1 + docs0)
    share: dict[str, tuple[float, float]] = {}
    out: dict[str, float] = {}
    for unit in sorted(counts, key=len):
        if not unit:
            continue
        n1, n0, d1, d0 = counts[unit]
        prior = share.get(parent(unit), (base, 1 - base))
        share[unit] = toxic, clean = (n1 + PRIOR * prior[0]) / (n1 + n0 + PRIOR), (n0 + PRIOR * prior[1]) / (n1 + n0 + PRIOR)
        rate = d1 / (d1 + d0)
        ratio = 2 * (d1 * math.log(rate / base_docs) + (d0 * math.log((1 - rate) / (1 - base_docs)) if d0 else 0.0)) if rate > base_docs else 0.0
        score = min(MOST_SCORE, math.log(toxic / clean) - math.log(base / (1 - base)))
        out[unit] = score if ratio >= SIGNIFICANT and score >= LEAST_SCORE else 0.0
    # A unit without a score matters only below a prefix that has one.
    scoring = {u for u, v in out.items() if v}
    return {u: v for u, v in out.items() if v or any(u[:k] in scoring for k in range(SHORTEST, min(len(u), LONGEST + 1)))}


def _decay(scores: Counter, drift: float = DRIFT) -> float:
    """The positive root of E[exp(x * score)] = 1 over clean tokens."""
    values, weights = np.array([*scores], float) - drift, np.array([*scores.values()], float)
    weights /= weights.sum()
    if not (values > 0).any() or (values * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda x: float((weights * np.exp(x * values)).sum()) - 1
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x.T * (p * (1 - p) + 1e-6)) @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (y - p) - 1e-2 * w)
    return tuple(map(float, w))


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled rows; ``learn`` is a condition on ``doc_id`` for those that may be used."""
    ship(documents.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(learn) if learn is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    texts = keep(texts.distinct().select("text", "toxic"), "labelled")  # dealt out by id and text
    sums = [F.sum(c).alias(c) for c in ("toxic_n", "clean_n", "toxic_docs", "clean_docs")]
    counted = texts.mapInArrow(releasing(_count), COUNTS).groupBy("unit").agg(*sums).where(f"unit = '' or toxic_docs + clean_docs >= {LEAST_DOCS}").toArrow().to_pydict()
    counts = dict(zip(counted["unit"], zip(*(counted[c] for c in ("toxic_n", "clean_n", "toxic_docs", "clean_docs"))), strict=True))
    if not all(counts.get("", (0, 0, 0, 0))[2:]):
        return Model({})
    model = Model(_log_odds(counts))

    def each_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in slices(batches):
            best, tokens, hits = [], [], []
            for text in batch.column(0).to_pylist():
                words = WORDS.findall((text or "").lower())
                values = [(i, v) for i, v in enumerate(map(reader.__getitem__, words)) if v]
                best.append([s for _, _, s in segments(values)])
                tokens.append(len(words))
                hits.append([v for _, v in values])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(tokens, pa.int64()), pa.array(best, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.float64()))], ["toxic", "tokens", "found", "hits"])

    rows = keep(texts.mapInArrow(releasing(each_text), "toxic int, tokens long, found array<double>, hits array<double>"), "segments")
    clean = rows.where("toxic = 0")
    tokens = Counter({r["score"]: r["count"] for r in clean.select(F.explode("hits").alias("score")).groupBy(F.round("score", 3).alias("score")).count().collect()})
    tokens[0.0] += clean.agg(F.sum("tokens")).first()[0] - sum(tokens.values())
    model.decay = _decay(tokens)
    size, top = F.greatest(F.lit(1), F.col("tokens")), F.coalesce(F.array_max("found"), F.lit(0.0))
    count, mass = clean.agg(F.count(F.lit(1)), F.sum(size * F.exp(-model.decay * top))).first()
    model.scale = count / max(1.0, mass)
    noise = F.log(model.scale * size)
    significant = F.size(F.filter("found", lambda v: model.decay * v - noise > -math.log(E_VALUE)))
    best = F.greatest(F.lit(-20.0), F.least(F.lit(60.0), model.decay * top - noise))
    fit = rows.select("toxic", best.alias("best"), F.log1p(significant).alias("significant")).toArrow()
    model.weights = _logistic(np.c_[np.asarray(fit["best"]), np.asarray(fit["significant"])], np.asarray(fit["toxic"], float))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, toxicity (0 to 1), predicted, n_tokens, passages (significant segments by token) of every row, and the carried columns."""
    source = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.struct(*(F.col(c) for c in carry)).alias("_carried") if carry else F.lit(None).cast("int").alias("_carried"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["_carried"].dataType.simpleString()

    def make():
        own = shared.value
        reader = own.reader()
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, tokens, passages = [], [], []
            for text in batch.column(1).to_pylist():
                found, n = reader.read(text or "")
                scores.append(own.probability(found, n))
                tokens.append(n)
                valued = [(s, e, v, math.exp(-own.surprise(v, n))) for s, e, v in found]
                passages.append([dict(zip(("start", "end", "score", "e_value"), p)) for p in valued if p[3] < E_VALUE])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(tokens, pa.int64()), pa.array(passages, passage), batch.column(2)],
                ["doc_id", "toxicity", "predicted", "n_tokens", "passages", "carried"],
            )

        return each

    out = map_slices(source, make, f"doc_id long, toxicity double, predicted int, n_tokens long, passages {PASSAGES}, carried {kind}")
    return out if carry else out.drop("carried")


def label_part(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5; rows where it is 0 are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
