import random

import numpy as np
import pytest

from pathloom.llm.mixing import mix, quotas, split_tree


def test_tree_deals_out_everything():
    rng = np.random.default_rng(1)
    q = np.array([7, 0, 1000, 33])
    for shards in (1, 2, 5, 64):
        t = split_tree(q, shards, rng)
        assert t.shape == (shards, 4) and (t.sum(axis=0) == q).all() and (t >= 0).all()
        assert np.ptp(t.sum(axis=1)) <= np.ceil(np.log2(shards)) + 1


def test_quotas():
    total, goal = quotas([("a", 3.0, 2), ("b", 1.0, 1), ("gone", 5.0, 1), ("zero", 0.0, 1)], {"a": 30, "b": 100})
    assert total == pytest.approx(80) and goal["a"] == (0.75, pytest.approx(60)) and goal["b"] == (0.25, pytest.approx(20))
    assert quotas([("a", 1.0, 1)], {}) == (0.0, {})


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "id long, src string, size long, block int")


def docs(n, seed):
    r = random.Random(seed)
    return [(i, "big" if r.random() < 0.8 else r.choice(("small", "mid")), r.randrange(1, 100)) for i in range(n)]


@pytest.mark.parametrize("blocks", [1, 16, 1024])
def test_shares_and_repeats(spark, blocks):
    rows = docs(3000, 1)
    draw, report = mix(frame(spark, rows), "id", "src", "size", [("big", 0.4, 1), ("small", 0.5, 3), ("mid", 0.1, 2), ("none", 1.0, 4)], seed=5, blocks=blocks, shard_tokens=20_000)
    drawn, r = draw.collect(), {x.source: x for x in report.collect()}
    assert len({(x.doc_id, x.copy_no) for x in drawn}) == len(drawn)
    sizes = {i: s for i, _, s in rows}
    assert all(x.n_tokens == sizes[x.doc_id] for x in drawn)
    assert r["small"].max_copies == 3 and r["big"].max_copies == 1 and r["none"].documents == 0
    for s in ("big", "small", "mid"):
        assert r[s].actual_share == pytest.approx(r[s].share, abs=0.002)
        assert all(x.copy_no < {"big": 1, "small": 3, "mid": 2}[s] for x in drawn if x.source == s)
    shards = {}
    for x in drawn:
        shards.setdefault(x.shard, []).append(x.position)
    assert len(shards) > 1 or blocks == 1
    assert all(sorted(p) == list(range(len(p))) for p in shards.values())


def test_same_seed_same_draw(spark):
    df = frame(spark, docs(300, 2))
    one, two, other = ({tuple(x) for x in mix(df, "id", "src", "size", [("big", 1, 1), ("mid", 1, 2)], seed=s)[0].collect()} for s in (1, 1, 2))
    assert one == two != other


def test_odd_rows(spark):
    rows = [(1, "a", None), (2, "a", 0), (3, None, 5), (None, "a", 5), (4, "a", 5), (5, "a", -1)]
    draw, report = mix(frame(spark, rows), "id", "src", "size", [("a", 1.0, 2), ("a", 1.0, 3)])
    assert sorted((x.doc_id, x.copy_no) for x in draw.collect()) == [(4, 0), (4, 1)]
    draw, report = mix(frame(spark, []), "id", "src", "size", [("a", 1.0, 2)])
    assert draw.count() == 0 and report.first().tokens == 0
    assert mix(frame(spark, rows), "id", "src", "size", [])[0].count() == 0
