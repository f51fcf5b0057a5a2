import random
import re

import numpy as np
import pytest

from assayer.llm import common, jaccard
from assayer.llm.components import components
from assayer.llm.shingles import shingle_sets, word_hashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                root[y] = x
    return {(d, len(s), find(d)) for (d, _), s in zip(rows, sets)}


def corpus(seed, n=260):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "x\x0by", "A.b"]
    passage = [r.choice(words) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.55:
            w = re.split(r"[ \n]", r.choice(texts))
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            w = w[r.choice([0, 0, 1, 5]) :] or ["x"]
        elif kind < 0.7:
            w = passage + [r.choice(words) for _ in range(r.randint(0, 25))]
        else:
            w = [r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 20, 60, 150]))]
        text = " ".join(w)
        texts.append(text.upper() if r.random() < 0.1 else text)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def test_sets_match_words():
    texts = ["", " \n ", "A b", "a  B\tc d e f g a b c d e", "x" * 3_000_000 + " y z", "É é " * 9, None]
    hashes, bounds = shingle_sets([(t or "").encode() for t in texts])
    assert [*np.diff(bounds)] == [len(brute_set(t)) for t in texts]
    assert word_hashes(b"ab Ab aB")[0].tolist() == [word_hashes(b"ab")[0][0]] * 3


def test_bounds_never_exclude_a_link():
    r = random.Random(2)
    for _ in range(400):
        n = r.choice([3, 40, 63, 64, 65, 130, 900])
        a = np.array(sorted({r.getrandbits(64) for _ in range(n)}), np.uint64)
        drop = r.randint(0, n // 5)
        b = np.array(sorted({int(x) for x in a[drop:]} | {r.getrandbits(64) for _ in range(r.randint(0, n // 5))}), np.uint64)
        if jaccard.linked(a, b):
            assert jaccard.within_bounds(np.array([len(a)]), [jaccard.bitmap(a)], np.array([len(b)]), [jaccard.bitmap(b)]).all()
            dealt = [x[: jaccard.dealt(len(x))] for x in (a, b)]
            assert len(np.intersect1d(*dealt)) >= max(jaccard.needed(len(a)), jaccard.needed(len(b)))
            bands = np.searchsorted(jaccard.EDGES, [len(a), len(b)], side="right")
            assert abs(int(bands[0]) - int(bands[1])) <= 1
            hot = np.array(sorted(r.sample(a.tolist(), len(a) // 3)), np.uint64)
            assert {*jaccard.prefix(a, hot).tolist()} & {*jaccard.prefix(b, hot).tolist()}
            got = jaccard.cell_pairs(np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), [jaccard.bitmap(a), jaccard.bitmap(b)], np.array([0, 1]), True)
            assert len(got) == 1


@pytest.mark.parametrize("seed, split", [(1, 1_000_000), (2, 7), (3, 1_000_000)])
def test_components_match_brute_force(spark, monkeypatch, seed, split):
    monkeypatch.setattr(jaccard, "SPLIT", split)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 6)
    monkeypatch.setattr(jaccard, "CELL", 8)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, tile string, n int").repartition(3)
    got = {tuple(r) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_a_cell_joins_what_brute_force_joins():
    r = random.Random(9)
    for _ in range(20):
        base = [r.getrandbits(64) for _ in range(60)]
        sets = [np.array(sorted({*r.sample(base, r.randint(40, 60)), *(r.getrandbits(64) for _ in range(r.randint(0, 12)))}), np.uint64) for _ in range(30)]
        side = [i % 2 for i in range(30)]
        for crossing in (False, True):
            got = jaccard.solve([*range(30)], [*range(30)], side, sets, crossing)
            assert all(jaccard.linked(sets[a], sets[b]) and (not crossing or side[a] != side[b]) for a, b in got)

            def groups(links):
                root = [*range(30)]
                for a, b in links:
                    x, y = root[a], root[b]
                    root = [y if z == x else z for z in root]
                return len(set(root))

            every = [(a, b) for a in range(30) for b in range(a) if jaccard.linked(sets[a], sets[b]) and (not crossing or side[a] != side[b])]
            assert groups(got) == groups(every)


def test_odd_rows(spark):
    same = "one two three four five six"
    rows = [(1, None), (2, ""), (3, same), (4, same.upper()), (None, same), (5, "one two"), (5, "one two"), (6, "one two"), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(jaccard.near_duplicates(df).collect(), key=str)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (None, 2, None), (5, 1, 5), (6, 1, 5), (7, 0, 7)}
    assert len(got) == len(rows)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [200_000, 0])
def test_chain_of_links(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "HEAVY_LEAST", 5)
    n = 200
    hub = [(5000, i) for i in range(2000, 2100)] + [(i, 6000) for i in range(2000, 2100, 3)]
    links = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(1000, 1001), (7, 7)] + hub, "a long, b long").repartition(4)
    want = {(i, 1) for i in range(1, n + 1)} | {(1000, 1000), (1001, 1000)} | {(i, 2000) for i in (*range(2000, 2100), 5000, 6000)}
    assert {tuple(r) for r in components(links).collect()} == want


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HEAVY_LEAST", 5)
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(None, i) for i in range(20)] + [(2, 0), (3, 0), (4, 0)], "k long, x long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, y string")
    for how, n in (("inner", 51), ("left", 73)):
        got = common.attach(left, right, "k", how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str) and got.count() == n
