import math

import numpy as np
from pyspark.sql import functions as F

from assayer.llm.topk import search, top_k


def brute(rows, asks, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, set()).add(tuple(math.floor(256 * float(x)) for x in v))
    out = set()
    for q in filter(asks, vectors):
        best = {}
        for i, own in vectors.items():
            scores = [sum(a * b for a, b in zip(x, y)) for x in vectors[q] for y in own if len(x) == len(y)]
            if i != q and scores:
                best[i] = max(scores)
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, max(-(2**63), min(2**63 - 1, s))))
    return out


def test_pruned_search_is_exact():
    r = np.random.default_rng(1)
    for n, d, spread in ((900, 24, 2.0), (700, 5, 0.0), (40, 3, 1.0)):
        v = np.floor(256 * r.normal(size=(n, d)) * np.exp(spread * r.normal(size=(n, 1)))).clip(-(2**23), 2**23).astype(np.int64)
        v[5:40] = v[5]
        ids = r.permutation(n).astype(np.int64)
        got = search(ids[::7], v[::7], ids, v, 5)
        scores = v[::7] @ v.T
        for a, q in enumerate(ids[::7]):
            want = sorted(((-s, i) for s, i in zip(scores[a].tolist(), ids.tolist()) if i != q))[:5]
            assert sorted((-s, i) for qq, i, s in got if qq == q) == want


def exact_share(vectors, queries=200, k=5):
    """The part of all pairs that gets an exact product, with floors as in a cell."""
    ids, tally = np.arange(len(vectors)), [0]
    asked = np.arange(0, len(vectors), max(1, len(vectors) // queries))
    longest = np.argsort(-(vectors.astype(float) ** 2).sum(1))[:256]
    floors = []
    for q in asked:
        scores = np.sort(vectors[longest[longest != q]] @ vectors[q])
        floors.append(float(scores[-k]))
    search(ids[asked], vectors[asked], ids, vectors, k, np.array(floors), tally)
    return tally[0] / (len(asked) * len(vectors))


def test_how_much_the_bounds_prune():
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0]
    unit = r.normal(size=(6000, 64))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    low_rank = r.normal(size=(6000, 64)) * 0.8 ** np.arange(64) @ turn
    low_rank /= np.sqrt((low_rank**2).sum(1))[:, None]

    def whole(x):
        return np.floor(256 * x).astype(np.int64)

    assert exact_share(whole(8 * unit * np.exp(r.normal(size=(6000, 1))))) < 0.05  # lengths of their own
    assert exact_share(whole(8 * low_rank)) < 0.25  # one length, but few directions matter
    assert exact_share(whole(8 * unit)) < 0.6  # neither: only steps near the last coordinate tell


def test_large_components_and_repeated_ids():
    r = np.random.default_rng(6)
    v = r.integers(-1000, 1000, size=(300, 8)).astype(np.int64)
    v[7] = 1 << 40
    v[250] = -(1 << 61)
    ids = np.r_[np.arange(200), np.arange(100)].astype(np.int64)
    rows = search(ids[:9], v[:9], ids, v, 4)
    for q in range(9):
        best = {}
        for i, x in zip(ids.tolist(), v.astype(object)):
            if i != q:
                best[i] = max(best.get(i, -(2**63)), max(-(2**63), min(2**63 - 1, int(np.dot(v[q].astype(object), x)))))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted([(i, s) for a, i, s in rows if a == q], key=lambda x: (-x[1], x[0])) == want


def test_frame(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [rows[3], rows[50], (50, rows[9][1]), (400, None), (450, [1.0, None]), (500, [float("nan")] * 6), (None, rows[1][1])]
    rows += [(550, [1.0, 2.0]), (551, [2.0, 1.0]), (600, []), (650, [1e18] * 6), (651, [-1e18] * 6), (700, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("g", F.lit("x"))
    got = {tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0).collect()}
    plain = [x for x in rows if x[0] not in (650, 651)]
    huge = {x for x in got if 650 in (x[0], x[2]) or x[2] == 651}
    assert {x for x in huge if x[0] == 650} and all(-(2**63) <= x[3] < 2**63 for x in huge)
    few = {tuple(x) for x in top_k(df.where("vec_id is null or vec_id not in (650, 651)"), F.col("vec_id") % 50 == 0).collect()}
    assert few == brute(plain, lambda i: i % 50 == 0, 5)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    small = df.where("vec_id < 300 or vec_id in (550, 551, 500)")
    keep = [x for x in rows if x[0] is not None and (x[0] < 300 or x[0] in (550, 551, 500))]
    assert {tuple(x) for x in top_k(small, F.col("vec_id") % 50 == 0).collect()} == brute(keep, lambda i: i % 50 == 0, 5)
