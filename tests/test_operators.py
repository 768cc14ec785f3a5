from hashlib import md5

import pytest
from pyspark.sql import functions as F

from pathloom.operators import conflicts as C
from pathloom.operators import graph as G
from pathloom.operators import metrics as M
from pathloom.operators import ranking as R
from pathloom.operators.intervals import overlapping
from pathloom.operators.latest import latest, latest_of_few_repeats
from pathloom.plans import runs


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def writes(spark, plan):
    return spark.createDataFrame([("p", i, path) for i, paths in enumerate(plan) for path in paths], "plan string, task long, path string")


def levelled(spark, plan, extra=()):
    w = writes(spark, plan)
    e = C.conflict_edges(w).select("plan", F.col("predecessor").alias("src"), F.col("successor").alias("dst"))
    if extra:
        e = e.unionByName(spark.createDataFrame([("p", a, b) for a, b in extra], "plan string, src long, dst long"))
    tasks = spark.createDataFrame([("p", i) for i in range(len(plan))], "plan string, task long")
    return C.plan_levels(tasks, e)


def test_independent_tasks_form_one_group(spark):
    g = C.groups(levelled(spark, [{"README.md", "docs/quickstart.md"}, {"package.json", "package-lock.json"}])).collect()
    assert [(r.group_id, r.tasks, r.type, r.waits_for) for r in g] == [(1, [0, 1], "parallel", [])]


def test_groups_of_the_worked_example(spark):
    # oauth, billing, settings, tests (which depend on billing)
    plan = [{"lib/auth.ts", "schema", "route"}, {"page", "lib/stripe.ts", "schema", "sidebar"}, {"settings/page", "sidebar"}, {"spec"}]
    g = sorted(C.groups(levelled(spark, plan, [(1, 3)])).collect(), key=lambda r: r.group_id)
    assert [(r.tasks, r.type, r.waits_for) for r in g] == [([0, 2], "parallel", []), ([1], "serial", [1]), ([3], "serial", [2])]


def test_orientation(spark):
    assert rows(C.conflict_edges(writes(spark, [{"s"}, {"s"}])), "predecessor", "successor") == [(0, 1)]
    assert rows(C.conflict_edges(writes(spark, [{"a", "b", "c"}, {"a"}, {"b"}])), "predecessor", "successor") == [(1, 0), (2, 0)]


def test_three_way_conflict_becomes_a_chain(spark):
    assert rows(levelled(spark, [{"x", "z"}, {"x", "y"}, {"y", "z"}, {"solo"}]), "task", "level") == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_cycles_are_errors(spark):
    with pytest.raises(Exception, match="cycle"):
        levelled(spark, [{"s"}, {"s"}], [(1, 0)]).collect()


def test_large_plans_are_relaxed(spark, monkeypatch):
    monkeypatch.setattr(C, "PLAN_EDGES", 2)
    assert rows(levelled(spark, [{"x", "z"}, {"x", "y"}, {"y", "z"}, {"solo"}]), "task", "level") == [(0, 0), (1, 1), (2, 2), (3, 0)]
    with pytest.raises(ValueError, match="cycle"):
        levelled(spark, [{"s"}, {"s"}, {"s"}], [(2, 0)])


def test_overlaps(spark):
    w = writes(spark, [{"pom.xml", "a"}, {"pom.xml", "b"}, {"pom.xml", "c"}])
    assert C.sharing_pairs(w).count() == 3
    assert rows(C.burden(w)) == [("p", 6, 4, 2, 1)]
    assert rows(C.peers(writes(spark, [{"x"}, {"x"}, {"y"}])), "task", "peers") == [(0, [1]), (1, [0]), (2, [])]
    order = spark.createDataFrame([("p", i, i) for i in range(3)], "plan string, task long, place long")
    assert rows(C.concurrent_pairs(order, C.sharing_pairs(w), [1, 2, 3]), "parallelism", "pairs") == [(1, 0), (2, 1), (3, 3)]


def test_empty_tables(spark):
    w = writes(spark, []).limit(0)
    assert C.conflict_edges(w).count() == C.peers(w).count() == C.burden(w).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (1, 2, "tie"), (2, None, "none"), (None, 5, "nokey")], "k int, t int, v string")
    assert rows(latest(df, ["k"], "t", ["v"]), "k", "v") == sorted([(1, "tie"), (2, "none"), (None, "nokey")], key=repr)
    assert rows(latest_of_few_repeats(df, ["k"], "t", ["v"]), "k", "v") == [(1, "tie"), (2, "none")]
    assert rows(latest_of_few_repeats(df, ["k"], "t", ["v"], limit=0), "k", "v") == [(1, "tie"), (2, "none")]


def test_accuracy(spark):
    p = spark.createDataFrame([("t", x) for x in "abc"], "task string, path string")
    a = spark.createDataFrame([("t", x) for x in "abd"], "task string, path string")
    r = M.pair_accuracy(p, a, ["task"]).select("tp", "fp", "fn", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.precision == r.recall == r.f1 == pytest.approx(2 / 3)
    nothing = spark.createDataFrame([([], None)], "p array<string>, a array<string>").select(*M.set_counts(F.col("p"), F.col("a")))
    assert nothing.select(*M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))).first() == (0.0, 0.0, 0.0)


def test_recall_without_truth(spark):
    ranked = spark.createDataFrame([("x", "a", 1), ("y", "a", 1), ("y", "b", 9)], "task string, path string, rank int")
    truth = spark.createDataFrame([("y", "a"), ("y", "b"), ("z", "a")], "task string, path string")
    assert rows(M.recall_at(ranked, truth, 5)) == [("x", 1.0, 0.0), ("y", 0.5, 0.2), ("z", 0.0, 0.0)]


def test_spread(spark):
    df = spark.createDataFrame([("a", 0.4), ("a", 0.8), ("b", 1.0), ("c", None)], "k string, v double")
    r = {x.k: x for x in M.spread(df, ["k"], "v").collect()}
    assert set(r) == {"a", "b"} and r["a"]["mean"] == pytest.approx(0.6) and r["a"]["pstdev"] == pytest.approx(0.2) and r["b"]["stdev"] == 0.0
    assert r["b"]["variance"] == "zero_variance_observation" and r["a"]["p95_nearest"] == 0.8


def test_bootstrap(spark):
    df = spark.createDataFrame([(s, m, v) for s, v in enumerate([1.0, 2.0, 4.0]) for m in "ab"], "seed int, arm string, v double")
    assert M.paired_bootstrap(df, "seed", "arm", "v", "a", "b", 50).first() == (0.0, 0.0, 0.0)
    one, two = (M.bootstrap(df, ["arm"], "v", ["seed"], 50).collect() for _ in range(2))
    assert sorted(one) == sorted(two) and all(r.low <= r["mean"] <= r.high for r in one)


def by_hand(values, resamples, seed):
    """The interval of the mean of sorted values, with the draws of the SQL."""
    n = len(values)
    m = sorted(sum(values[int(md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:8], 16) % n] for s in range(n)) / n for r in range(resamples))
    at = [(resamples - 1) * p for p in (0.025, 0.975)]
    return [m[int(x)] + (m[int(x) + 1] - m[int(x)]) * (x - int(x)) for x in at]


def test_bootstrap_ci_draws_as_often_as_the_reference(spark, sf):
    values = {}
    for r in runs._run_values(spark, sf).collect():
        values.setdefault(r.strategy, []).append(r.wall)
    got = {r.strategy: [r.low, r.high] for r in runs.bootstrap_ci(spark, sf).collect()}
    assert got == {k: pytest.approx(by_hand(sorted(v), 10_000, 0), abs=1e-6) for k, v in values.items()}


def test_every_pair_of_strategies_has_an_interval(spark, sf):
    got = {(r.a, r.b): r for r in runs.paired_bootstrap_pairs(spark, sf).collect()}
    means = {(r.suite_name, r.strategy): r.x for r in runs._run_values(spark, sf).where("suite_name IS NOT NULL").groupBy("suite_name", "strategy").agg(F.avg("wall").alias("x")).collect()}
    suites, strategies = ({k[i] for k in means} for i in (0, 1))
    diffs = {(a, b): sorted(round(means[s, a] - means[s, b], 6) for s in suites if (s, a) in means and (s, b) in means) for a in strategies for b in strategies if a < b}
    wanted = {k: d for k, d in diffs.items() if len(d) >= 2}
    assert len(strategies) == 6 and wanted and got.keys() == wanted.keys()
    for k, d in wanted.items():
        assert [got[k].low, got[k].high] == pytest.approx(by_hand(d, 10_000, 7), abs=1e-5)
    assert runs.ARM == "acg_planned"


def test_bm25(spark):
    docs = spark.createDataFrame([("a/billing.ts", ["billing"]), ("b/billing.ts", ["billing"]), ("c", ["nav"]), ("d", ["x"]), ("e", ["y"])], "doc string, tokens array<string>")
    q = spark.createDataFrame([(1, ["billing"]), (2, ["navigation"]), (3, [])], "qid int, tokens array<string>").withColumn("tokens", R.with_synonyms(F.col("tokens")))
    assert rows(R.bm25(docs, q), "qid", "rank", "doc") == [(1, 1, "a/billing.ts"), (1, 2, "b/billing.ts"), (2, 1, "c")]
    assert R.bm25(docs.limit(0), q).count() == 0


def test_cochange(spark):
    c = [(f"c{i}", p) for i in range(3) for p in ("src/auth.py", "tests/test_auth.py")] + [("c9", "src/billing.py"), ("c9", "tests/test_billing.py")]
    model = R.cochange_counts(spark.createDataFrame([("s", *x) for x in c], "space string, commit string, path string"))
    seeds = spark.createDataFrame([(1, "s", "src/auth.py"), (2, "s", "src/billing.py")], "qid int, space string, seed string")
    assert rows(R.cochange_top(model, seeds), "qid", "path", "n", "confidence") == [(1, "tests/test_auth.py", 3, 0.8)]


def test_pagerank(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "node string, weight double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("a", "c", 1.0)], "src string, dst string, weight double")
    got = dict(rows(R.pagerank(nodes, edges)))
    assert sum(got.values()) == pytest.approx(1) and got["c"] > got["a"] > got["b"]
    lost = dict(rows(R.pagerank(nodes, edges.limit(1))))
    assert sum(lost.values()) == pytest.approx(1)


def test_fusion(spark):
    p = spark.createDataFrame([("t", "a.py", 0.2, "same", 1), ("t", "a.py", 0.7, "same", 2), ("t", "a.py", 0.6, "other", 3), ("t", "g.py", 0.99, "Graph expansion: x", 4), ("t", "n.py", 2.0, None, 5)], "task string, path string, confidence double, reason string, place int")
    assert rows(R.fuse(p, 9), "rank", "path", "confidence", "reason") == [(1, "n.py", 1.0, ""), (2, "a.py", 0.7, "same; other"), (3, "g.py", 0.99, "Graph expansion: x")]
    tie = spark.createDataFrame([("t", p, c, "r", 1) for p, c in (("b", 0.9), ("a", 0.9), ("c", 0.8))], "task string, path string, confidence double, reason string, place int")
    assert rows(R.fuse(tie, 2), "rank", "path") == [(1, "a"), (2, "b")]


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    assert rows(R.cosine_top(v, q, 5), "vec_id", "rank") == [(1, 1), (3, 2)]


def test_many_queries_meet_all_vectors_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    one = rows(R.cosine_top(v, q, 5))
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "broadcast_if_small", lambda df, *a: df)
    assert rows(R.cosine_top(v, q, 5)) == one and len(one) == 100


def test_intervals(spark):
    df = spark.createDataFrame([("k", 1, 0.0, 10.0), ("k", 2, 10.0, 12.0), ("k", 3, 11.0, 99.0), ("k", 4, 5.0, 4.0), ("j", 5, 0.0, 9.0), ("k", 6, None, 1.0)], "k string, id int, lo double, hi double")
    got = overlapping(df, df, ["k"], 3.0).where("left_id < right_id")
    assert rows(got, "left_id", "right_id") == [(1, 2), (2, 3)]


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/b.ts", "src/b.js", "lib/index.ts", "pkg/m.py", "types/request.d.ts", "lib/request.js")], "path string")
    s = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib"), ("src/a.ts", "react"), ("src/a.ts", "~/b"), ("x.py", "pkg.m"), ("src/a.ts", "./a"), ("src/a.ts", "@scope/x")], "importer string, specifier string")
    r = G.resolve_imports(s, files)
    assert rows(r, "specifier", "target") == [("../lib", "lib/index.ts"), ("./b", "src/b.ts"), ("pkg.m", "pkg/m.py"), ("~/b", "src/b.ts")]
    assert dict(rows(G.importers(r, files)))["src/b.ts"] == ["src/a.ts"]
    assert rows(G.type_links(files)) == [("lib/request.js", "types/request.d.ts"), ("types/request.d.ts", "lib/request.js")]
