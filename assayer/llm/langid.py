"""Language identification by Bayesian fusion of text, markup, address and host.

The text's likelihood under each language comes from a model of character
trigrams inside words, shared by all rows and fitted on about ``SAMPLE``
different texts whose language is declared, the same number for each language, chosen
by hash out of all rows; copies count once.  Neighbouring trigrams are not independent, so the
evidence of n words counts as n / sqrt(1 + n / ``TEMPER``).  A declared language enters by the measured
probability of that declaration given the language.  The prior is hierarchical:
counts of languages by host are smoothed towards those of its domain, these towards
its address suffix, and these towards all rows.  The counts are grouped
aggregations over all rows, each row's own vote taken out again, and joined
back by host to small rows that no longer hold the text.

A row is rejected if its text has no letters, if more than ``STRANGE`` of its
trigrams were never seen in any language, or if no language reaches
``LEAST`` in the posterior.

Defined cases: null or empty texts are rejected; texts and words may be of any length, read
in parts; null declarations and addresses are no evidence; a null id stays a null id; languages are those declared by at least ``LEAST_ROWS`` different
texts, the ``SAMPLE // LEAST_ROWS`` most frequent ones if there are more; without any, every row is rejected; repeated rows count as often
as they occur; ties go to the language that comes first in the alphabet; empty tables give
empty tables; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import attach, keep, map_slices, releasing, ship, slices

SAMPLE = 8_000
LEAST_ROWS = 5
#: Rows of the sample that a trigram is in at least; those of one odd text are no language's.
LEAST_TEXTS = 2
#: Pseudo-count of a trigram, weight of a coarser prior, pseudo-count of declarations.
ALPHA, WEIGHT, DECLARED = 0.5, 8.0, 1.0
TEMPER = 8.0
STRANGE, LEAST = 0.5, 0.6
#: Characters read at a time; up to so many possible trigrams have a table of their own, beyond they are searched for.
GRAMS, DENSE = 32_768, 1_000_000
WORDS = re.compile(r"[^\W\d_]+")
EVIDENCE = "id string, host string, declared string, lang string, loglik array<double>, words long, strange double"


def trigrams(word: str, start: int = 0, end: int | None = None) -> list[str]:
    """The word's trigrams from number ``start`` to the one before ``end``; a space stands at either side of the word."""
    end = len(word) if end is None else min(len(word), end)
    part = (" " if not start else "") + word[max(0, start - 1) : end + 1] + (" " if end == len(word) else "")
    return [part[i : i + 3] for i in range(end - start)]


@dataclass
class Model:
    languages: list[str]
    table: dict[str, tuple[float, ...]]
    unseen: tuple[float, ...]

    def reader(self) -> Reader:
        return Reader(self)


@functools.cache
def letters() -> np.ndarray:
    """Whether a code point belongs to a word."""
    out = np.zeros(0x110000, bool)
    for found in WORDS.finditer("".join(map(chr, range(len(out))))):
        out[found.start() : found.end()] = True
    return out


class Reader:
    """Sums over a text's trigrams by arrays, so that a word costs the same whether it was met before or not.

    A word has a trigram around each of its letters, with a space for a neighbour outside it.  So each position
    has one line of a table: log-likelihoods, trigrams (1), unseen ones, words (1 at a first letter).  The
    first line, of positions that hold no letter, is zero; two are for unseen trigrams, one at a first letter.
    """

    def __init__(self, model: Model):
        grams = sorted(model.table)
        alphabet = sorted({c for g in grams for c in g if c != " "})
        # 0 stands for a space, 1 for letters that no trigram of the model has.
        self.codes = letters().astype(np.int32)
        self.codes[[ord(c) for c in alphabet]] = range(2, len(alphabet) + 2)
        code = {c: i for i, c in enumerate(alphabet, 2)} | {" ": 0}
        self.size = len(alphabet) + 2
        keys = np.array([(code[g[0]] * self.size + code[g[1]]) * self.size + code[g[2]] for g in grams], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        lines = [(*(0.0 for _ in model.languages), 0, 0, 0), *((*model.unseen, 1, 1, first) for first in (0, 1))]
        lines += [(*model.table[g], 1, 0, g[0] == " ") for g in (grams[i] for i in order)]
        self.columns = np.ascontiguousarray(np.array(lines, float).T)
        self.dense = None
        if self.size**3 <= DENSE:
            self.dense = self._search(np.arange(self.size**3))

    def _search(self, keys: np.ndarray) -> np.ndarray:
        """The line of each trigram, given by the number that its codes make."""
        before, middle = keys // self.size**2, keys // self.size % self.size
        line = np.where(middle == 0, 0, np.where(before == 0, 2, 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            line = np.where(self.keys[at] == keys, at + 3, line)
        return line

    def _sums(self, part: str, starts: list[int]) -> np.ndarray:
        """Sums of the columns from each start to the next; ``part`` has one more character at either side."""
        codes = self.codes[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        keys = (codes[:-2] * self.size + codes[1:-1]) * self.size + codes[2:]
        line = self._search(keys) if self.dense is None else self.dense[keys]
        return np.array([np.add.reduceat(column[line], starts) for column in self.columns]).T

    def read_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods by text and language, words, shares of unseen trigrams."""
        lower = [text.lower() for text in texts]
        total = np.zeros((len(texts), len(self.columns)))
        at = 0
        while at < len(lower):
            end, starts, chars = at + 1, [0], len(lower[at]) + 1
            while end < len(lower) and chars + len(lower[end]) < GRAMS:  # short texts together
                starts.append(chars)
                chars += len(lower[end]) + 1
                end += 1
            if end > at + 1 or chars <= GRAMS:
                total[at:end] = self._sums("\n" + "\n".join(lower[at:end]) + "\n\n", starts)
            else:  # a long text in parts from its start, so that its sums don't depend on its neighbours
                text = lower[at]
                for start in range(0, len(text), GRAMS):
                    stop = start + GRAMS
                    total[at] += self._sums((text[start - 1] if start else "\n") + text[start:stop] + (text[stop : stop + 1] or "\n"), [0])[0]
            at = end
        words = total[:, -1].astype(np.int64)
        return total[:, :-3] / np.sqrt(1 + words / TEMPER)[:, None], words, total[:, -2] / np.maximum(1.0, total[:, -3])

    def read(self, text: str) -> tuple[list[float], int, float]:
        """The same of one text."""
        logs, words, strange = self.read_all([text])
        return logs[0].tolist(), int(words[0]), float(strange[0])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams by language with the rows that hold them; the empty one counts rows."""
    counts: Counter = Counter()
    texts: Counter = Counter()
    for batch in slices(batches):
        for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: Counter = Counter({"": 1})
            for word, times in Counter(WORDS.findall((text or "").lower())).items():
                for gram in trigrams(word):
                    own[gram] += times
            for gram, times in own.items():
                counts[language, gram] += times
                texts[language, gram] += 1
    if counts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array([*counts.values()], pa.int64()), pa.array([texts[k] for k in counts], pa.int64())], ["lang", "gram", "n", "texts"]
        )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Trigram likelihoods from at most ``sample`` rows (text, lang) by hash order."""
    ship(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    declared = keep(rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("rows")).select("lang", "h"), "declared")
    # Bounded: each language listed gets LEAST_ROWS texts of the sample at least.
    each = declared.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).where(f"texts >= {LEAST_ROWS}").orderBy(F.desc("texts"), "lang").limit(max(1, sample // LEAST_ROWS)).collect()
    quota = max(LEAST_ROWS, sample // max(1, len(each)))
    # A share of the range of hashes, so the same texts for whatever order of rows; a language with few texts gives all.
    bounds = [(r["lang"], int(-(1 << 63) + min(1.0, quota / r["texts"]) * ((1 << 64) - 2048))) for r in each]
    bound = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")
    chosen = declared.join(F.broadcast(bound), "lang").where(F.xxhash64("h") <= F.col("bound")).select("lang", "h")
    chosen = chosen.orderBy(F.xxhash64("h"), "lang").limit(2 * sample)  # the shares give about ``sample``
    # Copies go before the shuffle; a text has one row for each language that it is declared in.
    own = keep(rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("text", "lang").distinct(), "declared")
    counted = own.mapInArrow(releasing(_count), "lang string, gram string, n long, texts long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).toArrow().to_pydict()
    by: dict[str, Counter] = {}
    texts: Counter = Counter()
    for gram, n in zip(counted["gram"], counted["texts"], strict=True):
        texts[gram] += n
    for language, gram, n in zip(counted["lang"], counted["gram"], counted["n"], strict=True):
        by.setdefault(language, Counter())[gram] = n
    languages = sorted(x for x, c in by.items() if c[""] >= LEAST_ROWS and len(c) > 1)
    grams = sorted({g for x in languages for g in by[x] if g and texts[g] >= LEAST_TEXTS})
    sums = [sum(by[x][g] for g in grams) + ALPHA * (len(grams) + 1) for x in languages]
    table = {g: tuple(math.log((by[x][g] + ALPHA) / s) for x, s in zip(languages, sums)) for g in grams}
    return Model(languages, table, tuple(math.log(ALPHA / s) for s in sums))


def host_parts(host: Column) -> tuple[Column, Column]:
    """The last two labels of a host, and the last."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def declared_in(markup: Column) -> Column:
    """The primary language that the html element declares."""
    return F.lower(F.nullif(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1), F.lit("")))


def _evidence(rows: DataFrame, model: Model, extract=None) -> DataFrame:
    """A kept table; the model leaves the executors with it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        reader = own.reader()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(markup) if extract and markup is not None else text or "" for text, markup in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            logs, words, strange = reader.read_all(texts)
            top = [own.languages[i] if n else None for i, n in zip(logs.argmax(1).tolist(), words.tolist(), strict=True)] if own.languages else [None] * len(texts)
            logs = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(own.languages), logs.ravel())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(top, pa.string()), logs, pa.array(words), pa.array(strange)],
                [x.split()[0] for x in EVIDENCE.split(", ")],
            )

        return each

    told = keep(map_slices(rows.select("id", "host", "declared", "text", "markup"), make, EVIDENCE), "evidence")
    shared.destroy()
    return told


def identify(rows: DataFrame, model: Model, extract=None) -> DataFrame:
    """id, lang, confidence, rejected, text_lang, declared, host of every row.

    ``rows``: id, host, declared, text, markup (null where the text is given).
    ``extract`` turns markup into text.
    """
    ship(rows.sparkSession)
    told = _evidence(rows, model, extract)
    k = len(model.languages)
    if not k:
        return told.select("id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("rejected"), F.col("lang").alias("text_lang"), "declared", "host")

    def votes(by: list[Column], names: list[str]) -> DataFrame:
        counts = [F.count_if(F.col("lang") == x) for x in model.languages]
        return told.groupBy(*(c.alias(n) for c, n in zip(by, names))).agg(F.array(*counts).alias("votes"))

    hosts = votes([F.col("host")], ["host"]).where("host is not null")
    domain, suffix = host_parts(F.col("host"))
    levels = keep(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), F.col("votes").alias("of_host")), "hosts")
    summed = [F.array(*(F.sum(F.col("of_host")[i]) for i in range(k)))]
    domains = levels.groupBy("domain").agg(summed[0].alias("of_domain"))
    suffixes = levels.groupBy("suffix").agg(summed[0].alias("of_suffix"))
    priors = attach(keep(attach(levels, domains, "domain"), "hosts"), suffixes, "suffix").select("host", "of_host", "of_domain", "of_suffix")
    # A row for each declaration and language: bounded by the languages that are told apart.
    said = told.where("declared is not null and lang is not null").groupBy("declared", "lang").count().where(F.col("declared").isin(model.languages)).collect()
    table = {(r["declared"], r["lang"]): r["count"] for r in said}
    everything = [max(0, x) for x in told.agg(*(F.count_if(F.col("lang") == x) for x in model.languages)).first()]
    given = {}
    for d in model.languages:
        given[d] = [math.log((table.get((d, x), 0) + DECLARED) / (sum(table.get((e, x), 0) for e in model.languages) + DECLARED * k)) for x in model.languages]

    def each_of(f) -> Column:
        return F.array(*(f(i, x) for i, x in enumerate(model.languages)))

    own = each_of(lambda i, x: F.when(F.col("lang") == x, 1.0).otherwise(0.0))

    def smoothed(counts: str, coarser: Column) -> Column:
        """Counts without the row's own vote, smoothed towards a coarser distribution."""
        votes_ = [F.greatest(F.lit(0.0), F.coalesce(F.col(counts)[i], F.lit(0)) - F.col("own")[i]) for i in range(k)]
        total = sum(votes_[1:], votes_[0])
        return F.array(*((votes_[i] + WEIGHT * coarser[i]) / (total + WEIGHT) for i in range(k)))

    total = sum(everything) + k
    base = F.array(*(F.lit((n + 1) / total) for n in everything))
    fused = attach(told, keep(priors, "priors"), "host", "left").withColumn("own", own)
    fused = fused.withColumn("p", smoothed("of_suffix", base)).withColumn("p", smoothed("of_domain", F.col("p"))).withColumn("p", smoothed("of_host", F.col("p")))
    # Declarations outside the known languages are no evidence.
    claim = [F.coalesce(*(F.when(F.col("declared") == d, F.lit(given[d][i])) for d in model.languages), F.lit(0.0)) for i in range(k)]
    fused = fused.withColumn("x", F.array(*(F.log(F.col("p")[i]) + claim[i] + F.col("loglik")[i] for i in range(k))))
    fused = fused.withColumn("top", F.array_max("x"))
    fused = fused.withColumn("confidence", 1 / F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    best = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("x", F.col("top")).cast("int"))
    rejected = (F.col("words") == 0) | (F.col("strange") > STRANGE) | (F.col("confidence") < LEAST)
    return fused.select("id", F.when(F.col("words") > 0, best).alias("lang"), "confidence", rejected.alias("rejected"), F.col("lang").alias("text_lang"), "declared", "host")
