import random

import pytest

from pathloom.llm import topn as T


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "task string, s double, path string, n int, cell string")


def brute(rows, n):
    best = {}
    for g, s, i in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[(g, i)] = max(s, best.get((g, i), s))
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i.encode(), i))
    return sorted((g, i) for g, v in groups.items() for _, _, i in sorted(v)[:n])


def got(spark, rows, n, **kw):
    return sorted((r.g, r.id) for r in T.top_n(frame(spark, rows), n, "task", "s", "path", **kw).collect())


@pytest.mark.parametrize("n", [1, 5])
@pytest.mark.parametrize("points", [1, 127])
def test_equals_sorting(spark, n, points):
    r = random.Random(n)
    names = ["".join(r.choice("ab/é中") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    rows = [("hot" if r.random() < 0.5 else f"g{r.randrange(40)}", r.choice((0.1, 0.5, 0.5, 0.9, r.random())), r.choice(names)) for _ in range(900)]
    assert got(spark, rows, n, points=points) == brute(rows, n)


def test_hot_groups_and_identifiers_are_spread(spark, monkeypatch):
    monkeypatch.setattr(T, "hot_buckets", lambda items, **kw: (list(range(T.HOT_BUCKETS)), list(range(T.HOT_BUCKETS))))
    rows = [("a", i % 3 / 2, f"p{i % 20}") for i in range(200)] + [("b", 0.5, "q")]
    assert got(spark, rows, 5) == brute(rows, 5)


def test_all_scores_equal_and_long_prefixes(spark):
    long = "x" * 3000
    rows = [("a", 1.0, long + s) for s in ("", "a", "b", "bb", "\0", "é")] + [("b", 1.0, s) for s in ("", "\0", "\0\0", "a")]
    assert got(spark, rows, 3) == brute(rows, 3)


def test_odd_rows(spark):
    rows = [(None, 1.0, "a"), ("a", None, "b"), ("a", float("nan"), "c"), ("a", 1.0, None), ("b", float("inf"), "x"), ("b", float("-inf"), "y"), ("b", -1.0, "z"), ("c", 0.0, "p"), ("c", -0.0, "q"), ("c", 0.0, "p")]
    assert got(spark, rows, 2) == [("b", "x"), ("b", "z"), ("c", "p"), ("c", "q")]
    assert got(spark, rows, 0) == [] and got(spark, [], 5) == []
