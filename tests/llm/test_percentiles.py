import random

import numpy as np
import pytest

from pathloom.llm.percentiles import bounded_percentiles, merge_cells, percentiles, value_cells


def frame(spark, rows):
    return spark.createDataFrame([(g, v, 1) for g, v in rows], "k string, v double, n int")


def check(spark, rows, **kw):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    got = {(r.k, r.pct): r.value for r in percentiles(frame(spark, rows), ["k"], "v", [0, 5, 50, 95, 100], **kw).collect()}
    assert set(got) == {(g, p) for g in groups for p in (0.0, 5.0, 50.0, 95.0, 100.0)}
    for (g, p), v in got.items():
        want = np.percentile(groups[g], p)
        assert v == pytest.approx(want, rel=1e-12, abs=kw.get("tolerance", 0) + 1e-323), (g, p)


@pytest.mark.parametrize("points", [1, 63])
def test_equals_sorting(spark, points):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.6 else f"g{r.randrange(5)}", r.lognormvariate(0, 4) * r.choice((1, 1, -1))) for _ in range(1500)]
    rows += [(None, 3.0), (None, 5.0), ("null", None), ("nan", float("nan")), ("one", 7.0), ("ties", 2.0), ("ties", 2.0), ("ties", 2.0)]
    check(spark, rows, points=points)


def test_extreme_values(spark):
    check(spark, [("a", v) for v in (1e-290, 1e300, -1e300, 0.0, -0.0, 5.0, 1.7e308, -1.7e308, 5.000000000000001)])
    check(spark, [("b", 10.0**i) for i in range(-200, 200, 7)])
    check(spark, [("c", v) for v in (5e-324, 1e-323, 1e-310, 1.0000000001e-310, -5e-324, 0.0)])


def test_tolerance(spark):
    rows = [("a", i / 7) for i in range(500)]
    got = percentiles(frame(spark, rows), ["k"], "v", [50], tolerance=2.0).first()
    assert abs(got.value - np.percentile([v for _, v in rows], 50)) <= 2.0


def test_infinite_and_empty(spark):
    inf = float("inf")
    got = {r.pct: r.value for r in percentiles(frame(spark, [("a", inf), ("a", -inf), ("a", 1.0)]), ["k"], "v", [0, 50, 75, 100]).collect()}
    assert got == {0.0: -inf, 50.0: 1.0, 75.0: inf, 100.0: inf}
    assert percentiles(frame(spark, []), ["k"], "v", [50]).count() == 0


def test_counts_of_parts_add_up(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.lognormvariate(1, 2) * r.choice((1, -1))) for _ in range(400)]
    days = [value_cells(frame(spark, rows[i::3]), ["k"], "v") for i in range(3)]
    cells = merge_cells(days[0].unionByName(days[1]).unionByName(days[2]), ["k"])
    whole = value_cells(frame(spark, rows), ["k"], "v")
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, whole.collect()))
    for x in bounded_percentiles(cells, ["k"], [5, 50, 95]).collect():
        want = np.percentile([v for k, v in rows if k == x.k], x.pct)
        assert x.low - 1e-12 <= want <= x.high + 1e-12 and x.n == sum(k == x.k for k, _ in rows)


def test_totals(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", None, 8.0), (None, "x", 5.0)], "p string, q string, v double")
    got = sorted((r.level, str(r.p), str(r.q), r.n, r.value) for r in percentiles(df, ["p", "q"], "v", [50], totals=(["p"],)).collect())
    assert got == [(0, "None", "x", 1, 5.0), (0, "a", "None", 1, 8.0), (0, "a", "x", 1, 1.0), (0, "a", "y", 1, 3.0), (1, "None", "None", 1, 5.0), (1, "a", "None", 3, 3.0)]


def test_whole_numbers_and_several_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", "x", 9)], "p string, q string, v long")
    assert sorted((r.p, str(r.q), r.n, r.value) for r in percentiles(df, ["p", "q"], "v", [50]).collect()) == [("a", "None", 2, 1.5), ("a", "x", 1, 9.0)]
