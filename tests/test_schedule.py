import pytest

from pathloom.operators import conflicts as C
from pathloom.operators import cycles as Y


def edges(spark, pairs, plan="p"):
    return spark.createDataFrame([(plan, a, b) for a, b in pairs], "plan string, src long, dst long")


def tasks(spark, last):
    return spark.createDataFrame([("p", i, x) for i, x in enumerate(last)], "plan string, task long, last boolean")


def levels(spark, last, conflicts=(), declared=()):
    order = Y.task_order(tasks(spark, last), edges(spark, conflicts), edges(spark, declared))
    return {r.task: r.level for r in C.plan_levels(tasks(spark, last).select("plan", "task"), order).collect()}


@pytest.fixture(params=[200_000, 2], ids=["one task", "passes"])
def size(request, monkeypatch):
    monkeypatch.setattr(C, "PLAN_EDGES", request.param)


def test_components(spark, size):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 7), (9, 4)])
    assert sorted((r.node, r.scc) for r in Y.strong_components(e).collect()) == [(0, 2), (1, 2), (2, 2), (4, 5), (5, 5), (7, 9), (8, 9), (9, 9)]
    assert Y.strong_components(edges(spark, [(0, 1), (1, 2), (0, 2)])).count() == 0
    assert Y.strong_components(e.limit(0)).count() == 0


def test_tests_run_last(spark, size):
    assert levels(spark, [False, True, False, True]) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert levels(spark, [None, False]) == {0: 0, 1: 0}


def test_tests_last_gives_way_to_conflicts(spark, size):
    # 1 (a test) goes before 0 by conflict and after it by its kind: a chain; 2 is not part of the cycle
    assert levels(spark, [False, True, False, True], [(1, 0)]) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert levels(spark, [True, False, False], [(0, 2)]) == {0: 1, 1: 0, 2: 2}


def test_declared_edges_do_not_give_way(spark, size):
    assert levels(spark, [False, False], [(0, 1)], [(0, 1)]) == {0: 0, 1: 1}
    with pytest.raises(Exception, match="cycle"):
        levels(spark, [False, False], [(0, 1)], [(1, 0)])
    with pytest.raises(Exception, match="cycle"):
        levels(spark, [False, False, False], [], [(0, 1), (1, 2), (2, 0)])
    with pytest.raises(Exception, match="cycle"):
        levels(spark, [False, True], [], [(1, 0)])


def test_both_paths_agree(spark, monkeypatch):
    pairs = [(i, (i * 7 + k) % 40) for i in range(40) for k in (1, 5) if (i * 7 + k) % 40 != i]
    last = [i % 4 == 0 for i in range(40)]

    def run():
        soft = Y.task_order(tasks(spark, last), edges(spark, pairs), edges(spark, []).limit(0))
        return sorted(map(tuple, soft.collect())), sorted((r.task, r.level) for r in C.plan_levels(tasks(spark, last).select("plan", "task"), soft).collect())

    one = run()
    monkeypatch.setattr(C, "PLAN_EDGES", 3)
    assert run() == one and len(one[1]) == 40


def test_unknown_names(spark):
    named = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("q", 2, "c")], "plan string, task long, name string")
    wanted = spark.createDataFrame([("p", 1, "a"), ("p", 1, "c"), ("q", 2, None)], "plan string, task long, name string")
    found, unknown = Y.declared_edges(wanted, named)
    assert [tuple(r) for r in found.collect()] == [("p", 0, 1)] and [tuple(r) for r in unknown.collect()] == [("p", 1, "c")]
    with pytest.raises(ValueError, match="unknown 'c'"):
        Y.declared_edges(wanted, named, strict=True)


def test_empty(spark):
    none = tasks(spark, []).limit(0)
    assert Y.task_order(none, edges(spark, []).limit(0), edges(spark, []).limit(0)).count() == 0
