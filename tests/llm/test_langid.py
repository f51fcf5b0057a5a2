import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from assayer.llm import langid
from assayer.llm.langid import declared_in, host_of, identify, train

STEMS = {"en": ["the", "tion", "ing", "wh", "and"], "de": ["ung", "keit", "sch", "der", "ein"], "fr": ["eau", "oux", "ment", "les", "que"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_fusion(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        lang = r.choice([*STEMS])
        claim = lang if r.random() < 0.9 else r.choice([*STEMS])
        rows.append((str(i), f"{lang}.site.example" if r.random() < 0.8 else None, claim, text(r, lang, 30), None, lang))
    # Text that fits no language better: the host and the declaration decide.
    rows += [(f"h{x}", f"{x}.site.example", x, "zz", None, x) for x in STEMS]
    rows += [("none", None, None, None, None, None), ("empty", None, "en", "", None, None), ("digits", "en.site.example", "en", "123 456", None, None), ("far", None, None, "漢字 漢字 仮名 交じり", None, None)]
    rows += [("long", None, None, text(r, "fr", 60000), None, "fr")] * 2
    df = spark.createDataFrame(rows, "id string, host string, declared string, text string, markup string, lang string")
    model = train(df.select("text", "lang"))
    assert model.languages == ["de", "en", "fr"]
    out = {x.id: x for x in identify(df, model).collect()}
    for i, _, _, _, _, lang in rows:
        if lang is None:
            assert out[i].rejected
        elif not i.startswith("h"):
            assert not out[i].rejected and out[i].lang == lang
        else:
            assert out[i].lang == lang
    assert identify(df, model).count() == len(rows)
    assert identify(df.limit(0), model).count() == 0
    empty = train(df.limit(0).select("text", "lang"))
    assert identify(df, empty).where("not rejected").count() == 0


def test_addresses_and_markup(spark):
    df = spark.createDataFrame([("https://u@WWW.Example.DE:80/x", '<!DOCTYPE html>\n<html class="a" lang=de-AT>'), ("nonsense", "<p>"), (None, None)], "url string, html string")
    got = df.select(host_of(F.col("url")), declared_in(F.col("html"))).collect()
    assert [tuple(x) for x in got] == [("www.example.de", "de"), (None, None), (None, None)]


def by_hand(rows, model):
    """The posterior of every row from its definition: (language, confidence, rejected) by id."""
    langs, k = model.languages, len(model.languages)
    seen = {}
    for i, _, _, body, *_ in rows:
        words = re.findall(r"[^\W\d_]+", (body or "").lower())
        grams = [f" {w} "[j : j + 3] for w in words for j in range(len(w))]
        logs = [sum(model.table.get(g, model.unseen)[x] for g in grams) / math.sqrt(1 + len(words) / langid.TEMPER) for x in range(k)]
        strange = sum(g not in model.table for g in grams) / max(1, len(grams))
        seen[i] = (logs, len(words), strange, langs[max(range(k), key=lambda x: (logs[x], -x))] if words else None)
    vote = {r[0]: seen[r[0]][3] for r in rows}
    out = {}
    claims = Counter((r[2], vote[r[0]]) for r in rows if r[2] in langs and vote[r[0]])
    for i, host, declared, *_ in rows:
        logs, n, strange, _ = seen[i]

        def share(rows_of, coarser, own=vote[i]):
            counts = Counter(vote[r[0]] for r in rows if rows_of(r))
            counts = [max(0, counts[x] - (own == x)) for x in langs]
            return [(c + langid.WEIGHT * p) / (sum(counts) + langid.WEIGHT) for c, p in zip(counts, coarser)]

        every = Counter(v for v in vote.values() if v)
        p = [(every[x] + 1) / (sum(every.values()) + k) for x in langs]
        if host is None:
            for _level in range(3):  # no counts of its own at any level
                p = [langid.WEIGHT * x / langid.WEIGHT for x in p]
        else:
            parts = host.split(".")
            p = share(lambda r: r[1] and r[1].split(".")[-1] == parts[-1], p)
            p = share(lambda r: r[1] and r[1].split(".")[-2:] == parts[-2:], p)
            p = share(lambda r: r[1] == host, p)
        said = [0.0] * k
        if declared in langs:
            said = [math.log((claims[declared, x] + langid.DECLARED) / (sum(claims[d, x] for d in langs) + langid.DECLARED * k)) for x in langs]
        total = [math.log(p[x]) + said[x] + logs[x] for x in range(k)]
        top = max(total)
        confidence = 1 / sum(math.exp(t - top) for t in total)
        out[i] = (langs[total.index(top)] if n else None, confidence, n == 0 or strange > langid.STRANGE or confidence < langid.LEAST)
    return out


def test_fusion_by_its_definition(spark):
    r = random.Random(8)
    rows = []
    for i in range(160):
        lang = r.choice([*STEMS])
        words = text(r, lang, r.choice([1, 2, 5, 40])) if i % 9 else r.choice(["", "zz", "12 3", "qq xx", None])
        host = r.choice([None, f"{lang}.a.example", "b.example", "c.other"])
        rows.append((str(i), host, r.choice([lang, lang, None, "xx", "en"]), words, None, 5))
    train_rows = spark.createDataFrame([(text(r, x, 12), x) for x in STEMS for _ in range(30)], "text string, lang string")
    model = train(train_rows)
    df = spark.createDataFrame(rows, "id string, host string, declared string, text string, markup string, rejected int")
    want = by_hand(rows, model)
    got = {x.id: x for x in identify(df, model).collect()}
    assert len(got) == len(rows)
    for i, (lang, confidence, rejected) in want.items():
        assert (got[i].lang, got[i].rejected) == (lang, rejected) and abs(got[i].confidence - confidence) < 1e-9, i


def test_the_sample_is_bounded_and_fair(spark):
    r = random.Random(9)
    rows = [("the same text over and over", "en")] * 400 + [(text(r, "en", 9), "en") for _ in range(300)] + [(text(r, "de", 9), "de") for _ in range(12)] + [("x y", "fr")] * 50
    kept = []
    real = langid.keep

    def keep(df, what):
        out = real(df, what)
        if what == "declared" and "text" in out.columns:
            kept.extend(tuple(x) for x in out.collect())
        return out

    langid.keep = keep
    try:
        model = train(spark.createDataFrame(rows, "text string, lang string"), sample=40)
    finally:
        langid.keep = real
    assert model.languages == ["de", "en"]  # one text declared fifty times is no language
    assert len(kept) == len(set(kept)) <= 80 and sum(x == "de" for _, x in kept) == 12 and 5 <= sum(x == "en" for _, x in kept) <= 45


def test_long_words():
    from assayer.llm.langid import GRAMS, trigrams

    word = "abcdefgh" * (GRAMS // 4)
    whole = trigrams(word)
    assert whole == [f" {word} "[i : i + 3] for i in range(len(word))]
    assert [g for a in range(0, len(word), GRAMS) for g in trigrams(word, a, a + GRAMS)] == whole


def small_model():
    r = random.Random(4)
    grams = {f" {w} "[j : j + 3] for x in STEMS for w in [*STEMS[x], "größe", "ſ²", "漢字", "𐐀a"] for j in range(len(w))}
    return langid.Model(["de", "en"], {g: (-r.random(), -r.random()) for g in sorted(grams)}, (-2.5, -3.5))


def test_new_words_cost_no_more_than_known_ones():
    """Of large tables most words are rare; a word not met before once took many times a known one's time."""
    r, model, took = random.Random(5), small_model(), {}
    for kind in ("known", "new"):
        words = ["abcdef"] * 30_000 if kind == "known" else ["".join(r.choices("abcdefghij", k=6)) for _ in range(30_000)]
        body, times = " ".join(words), []
        for _ in range(3):
            reader = model.reader()
            start = time.process_time()
            _, n, _ = reader.read(body)
            times.append(time.process_time() - start)
            assert n == len(words)
        took[kind] = min(times)
    assert took["new"] < 4 * took["known"]


def test_reading_by_its_definition(monkeypatch):
    r, model = random.Random(6), small_model()
    alphabet = "thegrößeſ²İΣςK½٣१_-'\n\t\x00 漢字𐐀́‍THE"
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 1, 2, 3, 50, 900]))) for _ in range(120)] + ["", "a", "the " * 200, "x" * 63, "x" * 64, "x" * 65, "\ud800a"]
    whole = model.reader().read_all(texts)
    monkeypatch.setattr(langid, "GRAMS", 64)  # many parts
    monkeypatch.setattr(langid, "DENSE", 0)  # trigrams are searched for
    logs, words, strange = model.reader().read_all(texts)
    for i, body in enumerate(texts):
        found = re.findall(r"[^\W\d_]+", body.lower())
        grams = [f" {w} "[j : j + 3] for w in found for j in range(len(w))]
        want = [math.fsum(model.table.get(g, model.unseen)[x] for g in grams) / math.sqrt(1 + len(found) / langid.TEMPER) for x in range(2)]
        share = sum(g not in model.table for g in grams) / max(1, len(grams))
        for got in ((logs, words, strange), whole):
            assert got[1][i] == len(found) and got[2][i] == share and max(abs(a - b) for a, b in zip(got[0][i], want)) < 1e-9
        assert model.reader().read(body) == (logs[i].tolist(), words[i], strange[i])  # whatever its neighbours
