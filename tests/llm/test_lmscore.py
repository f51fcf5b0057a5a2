import math
from collections import Counter

import numpy as np

from assayer.llm import registry
from assayer.llm.lmscore import WEIGHT, WORDS, losses, score, score_corpus, train


def brute(corpus, target, size):
    """Both models with dictionaries, token by token."""
    words = [WORDS.findall((t or "").lower()) for t in corpus]
    order = sorted(Counter(w for t in words for w in t).items(), key=lambda x: (-x[1], x[0]))[:size]
    known = {w for w, _ in order}
    fold = lambda t: [w if w in known else "<other>" for w in WORDS.findall((t or "").lower())]

    def model(texts):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for t in map(fold, texts):
            for a, b in zip(["<start>", *t], t):
                uni[b] += 1
                bi[a, b] += 1
                ctx[a] += 1
        total = sum(uni.values()) + len(known) + 1
        return lambda a, b: -math.log((bi[a, b] + WEIGHT * (uni[b] + 1) / total) / (ctx[a] + WEIGHT))

    t, b = model(target), model(corpus)
    out = []
    for x in map(fold, corpus):
        pairs = [*zip(["<start>", *x], x)]
        out.append((len(x), *((sum(m(*p) for p in pairs) / len(pairs)) for m in (t, b))) if x else (0, None, None))
    return out


def test_matches_brute_force(spark):
    corpus = ["The cat sat on the mat", "the dog sat on a log", None, "", "a cat and a dog and a cat " * 900, "rare words only", "The cat sat on the mat", "123 _ été"]
    target = ["the cat sat", "the cat sat on the mat", None]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(corpus)], "doc_id long, text string, n long".replace("n long", "n_tokens string"))
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.doc_id: r for r in score(df, train(df, tf, 6)).collect()}
    for i, (n, a, b) in enumerate(brute(corpus, target, 6)):
        assert got[i].n_tokens == n
        if n:
            assert abs(got[i].target_loss - a) < 1e-5 and abs(got[i].background_loss - b) < 1e-5 and abs(got[i].loss_difference - (a - b)) < 2e-5
        else:
            assert got[i].loss_difference is None
    none = train(df.limit(0), tf.limit(0))
    assert score(df.limit(0), none).count() == 0 and score(df, none).count() == len(corpus)


def test_rows_are_distributions():
    p = np.exp(-losses(np.array([[3.0, 1, 0], [0, 0, 0], [1, 2, 0]])))[:, :-1].sum(1)
    assert np.allclose(p, 1, atol=1e-6)


def test_every_word_counts(spark):
    """Words beyond the broadcast tables have counts and bigrams of their own."""
    corpus = ["the cat sat on the mat", "the dog sat on a log", None, "", "a cat and a dog and a cat " * 900, "rare words only", "the cat sat on the mat", "only", "rare words rare words the rare"]
    rows = [(None if i == 7 else i, t, i in (1, 4, 8)) for i, t in enumerate(corpus)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chosen boolean").repartition(3)
    expected = brute(corpus, [t for _, t, chosen in rows if chosen], 10_000)
    for dense in (0, 3, 2046):
        for scored in [score_corpus(df, dense)] + [score(df, train(df, df.where("chosen"), dense=dense))] * (dense == 3):
            got = {r.doc_id: r for r in scored.collect()}
            assert len(got) == len(corpus)
            for (i, _, _), (n, a, b) in zip(rows, expected):
                assert got[i].n_tokens == n
                if n:
                    assert abs(got[i].target_loss - a) < 1e-5 and abs(got[i].background_loss - b) < 1e-5 and abs(got[i].loss_difference - (a - b)) < 2e-5
                else:
                    assert got[i].target_loss is None and got[i].loss_difference is None
    other = spark.createDataFrame([(1, "the unheard cat")], "doc_id long, text string")
    both = brute(corpus + ["the unheard cat"], [t for _, t, chosen in rows if chosen], 10_000)
    assert score(other, train(df, df.where("chosen"), dense=2)).first().n_tokens == both[-1][0]
    assert score_corpus(df.limit(0)).count() == 0 and score(df.limit(0), train(df, df)).count() == 0


def test_no_word_is_dropped_in_a_large_vocabulary(spark):
    """More than 2,046 words: two texts that differ in rare words only are told apart."""
    texts = [" ".join(f"w{i}" for i in range(k, k + 50)) for k in range(0, 5000, 50)] * 3
    texts += ["seldom heard", "seldom heard", "hardly known", "hardly known"]
    rows = [(i, t, t == "seldom heard") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in score_corpus(spark.createDataFrame(rows, "doc_id long, text string, chosen boolean")).collect()}
    assert got[len(texts) - 4].loss_difference < got[len(texts) - 1].loss_difference - 1
    for i, (n, a, b) in enumerate(brute(texts, ["seldom heard"] * 2, 10_000)):
        assert got[i].n_tokens == n and abs(got[i].target_loss - a) < 1e-5 and abs(got[i].background_loss - b) < 1e-5


def test_every_good_document_is_in_the_target(spark, tmp_path, monkeypatch):
    """More than 20,000 good documents: a target that is the whole corpus has the corpus's losses."""
    n = 20_400
    spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 7, ' seen', id % 3000) AS text").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")
    labels.union(labels.limit(50)).write.parquet(str(tmp_path / "labels.parquet"))
    for most in (registry.BROADCAST_IDS, 100):
        monkeypatch.setattr(registry, "BROADCAST_IDS", most)
        got = registry.op7_lmscore(spark, str(tmp_path))
        assert got.count() == n and got.where("abs(loss_difference) > 1e-6").count() == 0
