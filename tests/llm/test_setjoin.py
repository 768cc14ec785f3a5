import random

import pytest

from pathloom.llm import setjoin as S


def brute(left, right, t, same):
    out = set()
    for i, (ka, a) in enumerate(left):
        for kb, b in (left[i + 1 :] if same else right):
            a_, b_ = set(a or ()) - {None}, set(b or ()) - {None}
            if a_ and b_ and len(a_ & b_) * 1000 >= len(a_ | b_) * round(t * 1000):
                out.add((min(ka, kb), max(ka, kb)) if same else (ka, kb))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0) for k, v in rows], "id long, items array<string>, n int")


def found(members, links):
    return {(r.a, r.b) for r in S.similar_records(members, links).collect()}


def records(n, seed, hot=True):
    """Clusters of like sets, copies, and a token that a third of all records have."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            items = [x for x in r.choice(out)[1] if r.random() > 0.15] + [f"x{r.randrange(60)}"] * (r.random() < 0.5)
        else:
            items = [f"x{r.randrange(60)}" for _ in range(r.randrange(1, 9))]
        if hot and r.random() < 0.33:
            items.append("hot")
        out.append((i, items))
    return out


@pytest.mark.parametrize("limits", [(64, 128, 256, 512, 1024), (2, 3, 4, 5, 6)])
def test_equals_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(S, "NODE_LIMITS", limits)
    monkeypatch.setattr(S, "BLOCK", 8)
    rows = records(300, 1)
    want = brute(rows, None, 0.6, True)
    got = found(*S.similar_sets(frame(spark, rows), "id", "items", 0.6))
    assert got <= want
    assert len(got) >= 0.995 * len(want) > 100


def test_two_tables(spark):
    a, b = records(120, 2), records(120, 3)
    want = brute(a, b, 0.5, False)
    members, links = S.similar_sets(frame(spark, a), "id", "items", 0.5, right=frame(spark, b))
    by = {(r.side, r.class_id): [] for r in members.collect()}
    for r in members.collect():
        by[(r.side, r.class_id)].append(r.rid)
    got = {(x, y) for r in links.collect() for x in by[(0, r.class_a)] for y in by[(1, r.class_b)]}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_odd_records(spark):
    rows = [(1, ["a", "a", None]), (2, ["a"]), (3, None), (4, []), (5, [None]), (6, ["a", "b"]), (7, ["b", "a"]), (8, ["c"])]
    members, links = S.similar_sets(frame(spark, rows), "id", "items", 0.5)
    assert found(members, links) == {(1, 2), (6, 7), (1, 6), (1, 7), (2, 6), (2, 7)}
    assert sorted(r.rid for r in members.collect()) == [1, 2, 6, 7, 8]


def test_exactly_the_threshold_counts(spark):
    rows = [(1, list("abc")), (2, list("abcde")), (3, list("abcdef"))]
    assert found(*S.similar_sets(frame(spark, rows), "id", "items", 0.6)) == {(1, 2), (2, 3)}


def test_spaces_and_sizes(spark):
    df = spark.createDataFrame([(1, "p", ["a", "b", "c"]), (2, "p", ["a", "b", "c"]), (3, "q", ["a", "b", "c"]), (4, "p", ["a", "b"])], "id long, kind string, items array<string>")
    members, links = S.similar_sets(df, "id", "items", 0.6, space="kind", min_size=3)
    assert {(r.space, r.a, r.b) for r in S.similar_records(members, links).collect()} == {("p", 1, 2)}


def test_empty_and_huge(spark):
    members, links = S.similar_sets(frame(spark, []), "id", "items", 0.6)
    assert members.count() == links.count() == 0
    big = [f"t{i}" for i in range(3000)]
    assert found(*S.similar_sets(frame(spark, [(1, big), (2, big[:2900]), (3, ["t1"])]), "id", "items", 0.9)) == {(1, 2)}


@pytest.mark.parametrize("t", [0.2, 0.3, 0.5, 0.6, 0.8, 0.9])
@pytest.mark.parametrize("hot", [0, 6])
def test_recall_at_the_threshold(spark, monkeypatch, t, hot):
    """Pairs of equal size and of a set within another, as far apart as still counts, among tokens
    that all records have."""
    monkeypatch.setattr(S, "NODE_LIMITS", (8, 8, 8, 8, 8))
    r = random.Random(7)
    rows = []
    for _ in range(60):
        size = r.choice((5, 10, 15))
        one = {f"x{r.randrange(10**6)}" for _ in range(size)}
        like = -(-int(2 * t * size * 1000) // int(1000 * (1 + t)))
        other = set(sorted(one)[:like]) | {f"y{r.randrange(10**6)}" for _ in range(size - like)}
        rows += [one, other, set(sorted(one)[: -(-int(t * size * 1000) // 1000)])]
    rows = [(i, sorted(x | {f"hot{j}" for j in range(hot)})) for i, x in enumerate(rows)]
    want = brute(rows, None, t, True)
    got = found(*S.similar_sets(frame(spark, rows), "id", "items", t))
    assert got <= want and len(got) >= 0.998 * len(want) > 50


def test_trees_follow_the_recall():
    assert [S.trees_for(0.6, recall)[0] for recall in (0.5, 0.9, 0.999)] == sorted({S.trees_for(0.6, recall)[0] for recall in (0.5, 0.9, 0.999)})
    for t in (0.2, 0.5, 0.9):
        trees, b = S.trees_for(t)
        assert 1 - (1 - S.survival(t, b)) ** trees >= S.RECALL
