import random
from collections import Counter
from itertools import combinations

import pytest

from pathloom.llm import cooccurrence as C


def brute(rows, min_count, lift):
    sets, n = {}, Counter()
    for g, items in rows:
        s = sorted(set(items or ()) - {None})
        if s:
            n[g] += 1
            sets.setdefault(g, []).append(s)
    out = {}
    for g, all_ in sets.items():
        one, two = Counter(x for s in all_ for x in s), Counter(p for s in all_ for p in combinations(s, 2))
        for (a, b), k in two.items():
            if k >= min_count and k * n[g] >= lift * one[a] * one[b]:
                out[(g, a, b)] = (n[g], one[a], one[b], k)
    return out


def got(spark, rows, *args):
    df = spark.createDataFrame([(*r, 5) for r in rows], "g string, items array<string>, n long")
    return {(r.g, r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.n_ab) for r in C.cooccurrence(df, ["g"], "items", *args).collect()}


def rows(seed, n=600):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.5 else r.choice(("a", "b", None)), [f"i{int(r.paretovariate(0.7)) % 50}" for _ in range(r.randrange(0, 12))]) for _ in range(n)]


@pytest.mark.parametrize("share", [0.0, 1 / 64, 0.2, 2.0])
@pytest.mark.parametrize("block", [64, 8192])
def test_equals_brute_force(spark, monkeypatch, share, block):
    monkeypatch.setattr(C, "HEAVY_SHARE", share)
    monkeypatch.setattr(C, "BLOCK", block)
    assert got(spark, rows(1)) == brute(rows(1), 1, 0)


def test_thresholds(spark):
    want = brute(rows(2), 8, 1.2)
    assert want and got(spark, rows(2), 8, 1.2) == want


def test_pairs_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "_AT_ONCE", 50)
    assert got(spark, rows(3, 200)) == brute(rows(3, 200), 1, 0)


def test_odd_records(spark):
    odd = [("a", None), ("a", []), ("a", [None]), ("a", ["x", "x", None]), (None, ["x", "y"]), ("a", ["x", "", "é"])]
    assert got(spark, odd) == brute(odd, 1, 0)
    assert got(spark, []) == {}
    assert got(spark, [("a", [f"i{i}" for i in range(300)])]) == brute([("a", [f"i{i}" for i in range(300)])], 1, 0)
