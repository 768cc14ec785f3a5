import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import patterns as T
from pathloom.operators.cycles import components, strong_components, task_order


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_path_templates(spark):
    files = spark.createDataFrame([(p,) for p in ("api/users/route.ts", "api/teams/route.ts", "api/teams/members/route.ts", "a.py", None)], "path string")
    assert rows(T.path_templates(files)) == [("*/route.ts", 3), ("api/*/route.ts", 3)]
    assert T.path_templates(files.limit(0)).count() == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_length():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(0, 12))) for _ in range(2))
        assert T.lcs_length(a, b) == plain_lcs(a, b)


def test_alike(spark):
    words = ["sidebar", "sidebars", "side", "billing", "biling", "b", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(a, b) for a in words for b in words if a and b and 200 * plain_lcs(a, b) / (len(a) + len(b)) >= 85}
    assert {(r.word, r.other) for r in T.alike(df, df).collect()} == want


def test_break_even(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 0.0), (10.0, 4.0)], "o double, s double")
    assert [r[0] for r in df.coalesce(1).select(T.break_even(F.col("o"), F.col("s"))).collect()] == [0.0, float("inf"), 2.5]


def reachable(edges, a):
    seen, todo = set(), [a]
    while todo:
        n = todo.pop()
        for s, d in edges:
            if s == n and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("seed", range(6))
def test_components(seed):
    r = random.Random(seed)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(11)]
    nodes = {n for e in edges for n in e}
    want = {frozenset({n} | {m for m in nodes if m in reachable(edges, n) and n in reachable(edges, m)}) for n in nodes}
    assert {frozenset(g) for g in components(edges)} == {g for g in want if len(g) > 1}


def test_collapse(spark):
    e = [("p", 3, 1), ("p", 1, 2), ("p", 2, 3), ("p", 3, 4), ("p", 4, 4), ("q", 1, 2), ("q", None, 2)]
    df = spark.createDataFrame(e, "plan string, src long, dst long")
    assert rows(chained(df)) == [("p", 1, 2), ("p", 2, 3), ("p", 3, 4), ("q", 1, 2)]
    assert chained(df.limit(0)).count() == 0
    deep = spark.createDataFrame([("p", i, i + 1) for i in range(5000)] + [("p", 5000, 0)], "plan string, src long, dst long")
    assert strong_components(deep).count() == 5001


def chained(edges):
    """Conflict edges with their cycles made chains."""
    tasks = edges.select("plan", F.explode(F.array("src", "dst")).alias("task")).where("task IS NOT NULL").distinct().withColumn("last", F.lit(False))
    order = task_order(tasks, edges.dropna().where("src <> dst"), edges.limit(0))
    return order.where("src >= 0 AND dst >= 0").select("plan", "src", "dst").distinct()
