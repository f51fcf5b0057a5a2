import math
import random

from pyspark.sql import functions as F

from assayer.llm.toxicity import DRIFT, MOST_SCORE, Model, _log_odds, label_part, parent, score, segments, train, units


def brute(values):
    """Maximal segments by their recursive definition: the best one, then left and right of it."""
    def best(a, b):
        top = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-12 or abs(total - top[2]) < 1e-12 and j + 1 - i < top[1] - top[0] and i >= top[0]):
                    top = (i, j + 1, total)
        return [] if top is None else [*best(a, top[0]), top, *best(top[1], b)]

    return best(0, len(values))


def test_segments_match_the_definition():
    r = random.Random(3)
    for _ in range(300):
        raw = [r.choice([0, 0, 0, 0.31, 1.07, 0.02]) for _ in range(r.randint(0, 30))]
        got = segments([(i, v) for i, v in enumerate(raw) if v], 0.13)
        want = brute([v - 0.13 for v in raw])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    neutral = ["w%s" % "".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, marks = [], []
    for i in range(900):
        words = [r.choice(neutral) for _ in range(r.randint(20, 200))]
        toxic = i % 6 == 0
        for _ in range(r.randint(3, 6) if toxic else r.random() < 0.1):
            words.insert(r.randrange(len(words)), "vile" + r.choice(["", "ness", "r", "st", "ling", r.choice("abcdefgh") * 3]))
        docs.append((i, " ".join(words), "x"))
        marks.append((i, int(toxic), 1))
    docs += [(None, "vile vile", "y"), (5000, None, "y"), (5001, "", None), (5001, "", None), (5002, ("word " * 30000) + "vile vileness viler vile vile " * 4, "y")]
    marks += [(5001, None, 1), (None, 1, 0), (9999, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    m = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    model = train(d, m, learn=label_part() != 0)
    out = score(d, model, carry=["doc_id", "predicted"]).select("doc_id", "toxicity", "predicted", "passages", "carried", (label_part() == 0).alias("held")).collect()
    assert len(out) == len(docs)
    held = [x for x in out if x.held and x.doc_id < 900]
    assert len(held) > 100 and sum((x.predicted == 1) == (x.doc_id % 6 == 0) for x in held) / len(held) > 0.95
    long = next(x for x in out if x.doc_id == 5002)
    assert long.predicted == 1 and long.passages and long.passages[0].start >= 29990 and long.carried.predicted == "y"
    assert {x.predicted for x in out if x.doc_id in (5000, 5001)} == {0} and all(0 <= x.toxicity <= 1 for x in out)
    assert score(d.limit(0), model).count() == 0


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(d, none)
    assert model == Model({}) and DRIFT > 0
    assert score(d, model).select("predicted").first()[0] == 0
    assert d.select(F.pmod(label_part(), F.lit(5))).first()[0] == 3


def test_overwhelming_evidence_stays_finite():
    counts = {"": (10**7, 10**8, 10**4, 10**5)} | {"abcdefghijklmnop"[:k]: (10**6, 0, 9000, 0) for k in range(3, 17)}
    assert set(_log_odds(counts).values()) == {MOST_SCORE}


def test_model_and_scores_by_their_definition(spark):
    """Counts, log-odds, calibration and scores worked out again from the texts."""
    r = random.Random(11)
    plain = ["calm", "calmly", "river", "rivers", "walk", "walking", "day", "of", "internationalization", "internationalizations"]
    docs = []
    for i in range(240):
        words = [r.choice(plain) for _ in range(r.randint(3, 60))]
        for _ in range(r.randint(2, 5) if i % 4 == 0 else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "vileness", "internationalizedvile"]))
        docs.append((i, " ".join(words)))
    labels = [(i, int(i % 4 == 0)) for i, _ in docs]
    model = train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))

    def parts(word):
        return [word[:k] for k in range(3, min(len(word), 16) + 1)] + [word + "$"]

    n, seen = {}, {}
    for i, t in docs:
        for w in t.split():
            for u in ("", *parts(w)):
                n.setdefault(u, [0, 0])[int(i % 4 == 0)] += 1
                seen.setdefault(u, (set(), set()))[int(i % 4 == 0)].add(i)
    counts = {u: (n[u][1], n[u][0], len(seen[u][1]), len(seen[u][0])) for u in n if not u or len(seen[u][0] | seen[u][1]) >= 4}
    assert model.scores == _log_odds(counts) and model.scores["vile$"] > 1 and "calm$" not in model.scores

    def read(t):
        words = t.split()
        values = [next((model.scores[u] for u in reversed(parts(w)) if u in model.scores), 0.0) for w in words]
        return brute([v - DRIFT for v in values]) if len(words) < 40 else segments([(k, v) for k, v in enumerate(values) if v]), len(words), values

    clean = [read(t) for i, t in docs if i % 4]
    steps = [round(v, 3) - DRIFT for _, _, values in clean for v in values]
    if any(x > 0 for x in steps):
        assert abs(sum(math.exp(model.decay * x) for x in steps) / len(steps) - 1) < 1e-6
    tops = [(tokens, max((x for *_, x in found), default=0.0)) for found, tokens, _ in clean]
    assert abs(model.scale - len(clean) / max(1.0, sum(tokens * math.exp(-model.decay * x) for tokens, x in tops))) < 1e-9
    got = {x.doc_id: x for x in score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for i, t in docs:
        found, tokens, _ = read(t)
        surprise = [model.decay * x - math.log(model.scale * max(1, tokens)) for *_, x in found]
        best = max(-20, min(60, max(surprise, default=-math.log(model.scale * max(1, tokens)))))
        z = model.weights[0] * best + model.weights[1] * math.log1p(sum(s > -math.log(0.05) for s in surprise)) + model.weights[2]
        assert abs(got[i].toxicity - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9 and got[i].n_tokens == tokens
        assert len(got[i].passages) == sum(math.exp(-s) < 0.05 for s in surprise)


def test_words_count_whole():
    assert units("internationalizations")[-1] != units("internationalization")[-1] and parent("internationalizations$") == "internationaliz" + "a"
    assert parent("abc$") == "abc" and parent("abcd") == "abc"
