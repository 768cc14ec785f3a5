"""Operators that meet in blocks, against brute force; and what they shuffle."""

import random
from collections import Counter
from hashlib import md5
from math import log

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.operators import blocks as B
from pathloom.operators import ranking as R
from pathloom.operators import selection as S
from pathloom.plans import rankings as Q


def moved(spark, make):
    """The rows of ``make()``, and how many rows of shuffles and spilled bytes it took."""

    def now():
        sc = spark.sparkContext
        jvm = sc._jvm
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        all_of = [stages.apply(i) for i in range(stages.size())]
        return sum(x.shuffleWriteRecords() for x in all_of), sum(x.diskBytesSpilled() for x in all_of)

    before = now()
    rows = make().collect()
    after = now()
    return rows, after[0] - before[0], after[1] - before[1]


@pytest.fixture(scope="module")
def texts():
    long = [f"{'é' * (i % 23)}{i}/" + "x" * (i % 70) for i in range(400)]
    return long + ["", "a" * 55, "b" * 56, "c" * 63, "d" * 64, "e" * 119, "f" * 120, "g" * 500]


def test_least_hashed_is_exact(spark, texts, monkeypatch):
    monkeypatch.setattr(B, "HASHED_AT_ONCE", 16)
    asked = [1, 50, 99, 100, 12345678, -7, 10**15]
    docs, queries = spark.createDataFrame([(t,) for t in texts], "doc string"), spark.createDataFrame([(q,) for q in asked], "qid bigint")
    got = {}
    for r in B.least_hashed(docs, queries, 5).collect():
        got.setdefault(r.qid, []).append((r.h, r.doc))
    assert {q: sorted(x)[:5] for q, x in got.items()} == {q: sorted((md5(f"{q}:{t}".encode()).hexdigest(), t) for t in texts)[:5] for q in asked}


def test_least_hashed_of_few_and_none(spark):
    docs, queries = spark.createDataFrame([("a",), ("b",)], "doc string"), spark.createDataFrame([(1,)], "qid bigint")
    assert {r.doc for r in B.least_hashed(docs, queries, 5).collect()} == {"a", "b"}
    assert B.least_hashed(docs.where("false"), queries, 5).count() == 0
    assert B.least_hashed(docs, queries.where("false"), 5).count() == 0


def test_random_topk_sorts_no_product(spark, sf):
    plan = Q.random_topk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan


def links(spark, n):
    kinds = [("alpha", "beta"), ("beta",), ("gamma",), ("delta", "alpha"), ()]
    made = lambda what, k: [(f"{what}{i}", list(kinds[i % k])) for i in range(n)]
    sources, tests = (spark.createDataFrame(x, "path string, words array<string>") for x in (made("s", 5), made("t", 4)))
    edges = spark.createDataFrame([("t0", "s4"), ("t0", "s4"), ("t0", "s0"), ("t2", "s1"), ("t3", "t1"), ("s1", "t1"), ("t9", "s9")], "src string, dst string")
    return sources, tests, edges


def test_counts_are_those_of_the_links(spark):
    s, t, e = links(spark, 40)
    t = t.unionByName(spark.createDataFrame([("t40", []), ("t41", ["nothing"])], t.schema))
    e = e.unionByName(spark.createDataFrame([("t40", "s7")], e.schema))
    slow = S.test_links(s, t, e).groupBy("test").agg(F.count(F.lit(1)).alias("sources"), F.min("source").alias("first"))
    assert sorted(S.test_counts(s, t, e).collect()) == sorted(slow.collect())


def test_test_counts_shuffle_no_pairs(spark):
    s, t, e = links(spark, 1000)
    rows, shuffled, _ = moved(spark, lambda: S.test_counts(s, t, e))
    assert len(rows) == 1000 and sum(r.sources for r in rows) > 300_000
    assert shuffled < 50_000


@pytest.fixture(scope="module")
def worded(spark):
    """Texts of frequent, rare and repeated words, many of them alike; and queries."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    some = lambda least, most: draw.choices(words, [1 / (i + 1) for i in range(40)], k=draw.randint(least, most))
    corpus = {f"{draw.random():.9f}-{i}": some(0, 7) + ["all"] * (i % 5 > 0) for i in range(900)}
    queries = {q: some(1, 12) * draw.randint(1, 3) + ["all", "unknown"][: q % 3] for q in range(30)} | {30: ["all"], 31: ["unknown"], 32: ["w39"], 33: words + ["w39"] * 30}
    return corpus, queries, spark.createDataFrame(list(corpus.items()), "doc string, tokens array<string>").cache(), spark.createDataFrame(list(queries.items()), "qid bigint, tokens array<string>").cache()


def ranked(scores, n):
    return [(d, s) for s, d in sorted((-s, d) for d, s in scores.items())[:n]]


@pytest.mark.parametrize("n", [1, 8, 2000])
def test_token_overlap_is_exact_in_blocks(worded, monkeypatch, n):
    corpus, queries, c, q = worded
    monkeypatch.setattr(B, "DOC_BLOCK", 250)
    got = {}
    for r in sorted(R.token_overlap(c, q, n).collect(), key=lambda r: r.rank):
        got.setdefault(r.qid, []).append((r.doc, -r.common))
    want = {k: ranked({d: m for d, t in corpus.items() if (m := len({*t} & {*w}))}, n) for k, w in queries.items()}
    assert got == {k: x for k, x in want.items() if x}


def test_token_overlap_shuffles_no_pairs(worded):
    _, _, c, q = worded
    rows, shuffled, _ = moved(c.sparkSession, lambda: R.token_overlap(c, q))
    assert len(rows) > 200
    # 34 queries meet some 800 of 900 texts each
    assert shuffled < 900 * 8 + 34 * 13 * 8 + 34 * 8 * 8


@pytest.mark.parametrize("n", [1, 8, 2000])
@pytest.mark.parametrize("paired", [0, 3, 16])
def test_overlaps_of_a_block_are_exact(worded, monkeypatch, paired, n):
    corpus, queries, _, _ = worded
    for what, size in (("PAIRED_WORDS", paired), ("QUERIES_AT_ONCE", 15), ("PAIRS_AT_ONCE", 300), ("CANDIDATES_AT_ONCE", 50), ("FLAGS_AT_ONCE", 1000)):
        monkeypatch.setattr(B, what, size)
    asked = queries | {40: [], 41: ["w0", "w0"]}
    tables = [pa.table({k: list(x), "tokens": pa.array(x.values(), pa.list_(pa.string()))}) for k, x in (("doc", corpus), ("qid", asked))]
    got = {}
    for r in B._overlaps(*tables, n).to_pylist():
        got.setdefault(r["qid"], {})[r["doc"]] = r["common"]
    want = {k: ranked({d: m for d, t in corpus.items() if (m := len({*t} & {*w}))}, n) for k, w in asked.items()}
    assert {k: ranked(x, n) for k, x in got.items()} == {k: x for k, x in want.items() if x}


def test_overlaps_of_none(worded):
    corpus, queries, _, _ = worded
    d, q = (pa.table({k: list(x), "tokens": pa.array(x.values(), pa.list_(pa.string()))}) for k, x in (("doc", corpus), ("qid", queries)))
    assert not len(B._overlaps(d[:0], q, 8)) and not len(B._overlaps(d, q[:0], 8))


def test_blocks_of_queries_are_bounded(worded, monkeypatch):
    monkeypatch.setattr(B, "QUERY_BLOCK", 1)
    _, queries, c, q = worded
    sizes = B.in_blocks(c, q, lambda d, q: pa.table({"n": [len(d)], "q": [len(q)]}), "n bigint, q bigint", len(queries)).collect()
    assert len(sizes) >= 20 and sum(r.q for r in sizes) == len(queries) and all(r.n == len(c.collect()) for r in sizes)


def test_token_overlap_topk_asks_every_contract(spark, sf):
    con = duckdb.connect()
    for t in ("contracts", "predicted_writes"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = [tuple(r) for r in Q.token_overlap_topk(spark, sf).select("qid", "doc", "common", "rank").collect()]
    assert {r[0] for r in got} == {r[0] for r in con.sql("SELECT DISTINCT contract_id FROM contracts WHERE contract_id IS NOT NULL").fetchall()}
    assert sorted(got) == sorted(con.sql(f"SELECT qid, doc, common, rank FROM ({Q.SQL['token_overlap_topk']})").fetchall())


@pytest.mark.parametrize("n", [1, 8, 2000])
def test_bm25_is_exact_in_blocks(worded, monkeypatch, n):
    corpus, queries, c, q = worded
    monkeypatch.setattr(B, "DOC_BLOCK", 250)
    df = Counter(w for t in corpus.values() for w in {*t})
    idf = {w: log(len(corpus) - k + 0.5) - log(k + 0.5) for w, k in df.items()}
    floor, mean = R.EPSILON * sum(idf.values()) / len(idf), sum(map(len, corpus.values())) / len(corpus)
    want = {}
    for k, asked in queries.items():
        scores = {}
        for d, t in corpus.items():
            if common := {*t} & {*asked}:
                part = lambda w: asked.count(w) * (idf[w] if idf[w] >= 0 else floor) * t.count(w) * (R.K1 + 1) / (t.count(w) + R.K1 * (1 - R.B + R.B * len(t) / mean))  # noqa: B023, E731
                scores[d] = max(round(sum(map(part, sorted(common))), 6), len(common))
        if scores:
            want[k] = ranked(scores, n)
    got = {}
    for r in sorted(R.bm25(c, q, n).collect(), key=lambda r: r.rank):
        got.setdefault(r.qid, []).append((r.doc, r.score))
    assert {k: [d for d, _ in x] for k, x in got.items()} == {k: [d for d, _ in x] for k, x in want.items()}
    assert all(s == pytest.approx(-t, abs=2e-6) for k, x in got.items() for (_, s), (_, t) in zip(x, want[k], strict=True))


def test_bm25_with_negative_weights(spark):
    c = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", ["x", "x"])], "doc string, tokens array<string>")
    got = R.bm25(c, spark.createDataFrame([(1, ["x", "y", "x"])], "qid bigint, tokens array<string>")).collect()
    assert [(r.doc, r.score) for r in sorted(got, key=lambda r: r.rank)] == [("a", 2.0), ("b", 1.0), ("c", 1.0)]


def test_bm25_shuffles_no_pairs(worded):
    _, _, c, q = worded
    rows, shuffled, _ = moved(c.sparkSession, lambda: R.bm25(c, q))
    assert len(rows) > 200
    assert shuffled < 900 * 8 + 34 * 13 * 8 * 2 + 34 * 8 * 8


def graph(spark, tasks, files):
    """Paths of which a few lead to all others, some of both kinds; tasks with one or more of them."""
    draw = random.Random(3)
    kinds = ["word", "test", "other", "tests/x"]
    names = [f"{kinds[i % 4]}/f{i}" for i in range(files)]
    fused = {(t, p): draw.choice([0.5, 0.72, 0.9]) for t in range(tasks) for p in [names[0], *draw.sample(names[:4], t % 3), *draw.sample(names, 3)]}
    around = {(names[h], p, "importer" if (i + h) % 3 else "import") for h in range(4) for i, p in enumerate(names) if i % (h + 1) == 0 and i != h}
    around |= {(draw.choice(names), draw.choice(names), draw.choice(["import", "importer", "type"])) for _ in range(4 * files)} | {(names[1], names[7], "type")}
    return (
        spark.createDataFrame([(f"t{t}", p, c) for (t, p), c in sorted(fused.items())], "task string, path string, confidence double").cache(),
        spark.createDataFrame(sorted(around), "src string, dst string, kind string").cache(),
        spark.createDataFrame([(p, p.split("/")) for p in names], "path string, words array<string>").cache(),
        spark.createDataFrame([(f"t{t}", ["task", *kinds[t % 5 : t % 5 + 1]][: 1 + (t % 7 == 0)], t % 2 == 0) for t in range(tasks)], "task string, words array<string>, tests boolean").cache(),
    )


def expanded_slowly(fused, around, files, tasks):
    fused, words, tasks = {(r.task, r.path): r.confidence for r in fused.collect()}, {r.path: r.words for r in files.collect()}, {r.task: r for r in tasks.collect()}
    to = {}
    for r in around.collect():
        to.setdefault(r.src, []).append((r.dst, r.kind))
    found = {}
    for (task, src), c in fused.items():
        for path, kind in to.get(src, []) if c >= 0.72 else []:
            if (task, path) not in fused and (tasks[task].tests or not path.startswith("tests/") and not path.startswith("test/")):
                found.setdefault((task, path), []).append((src, kind))
    rows = set()
    for (task, path), by in found.items():
        kinds, seeds = {k for _, k in by}, sorted({s for s, _ in by})
        if {*words[path]} & {*tasks[task].words} or "type" in kinds or ("import" in kinds and len(seeds) > 1):
            rows.add((task, path, f"Graph expansion: local import/type edge from high-confidence seed(s) {', '.join(seeds[:3])}."))
    return rows


@pytest.mark.parametrize("few", [0, 3, 20, 10**6])
def test_expanded_is_exact_around_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW_NEIGHBOURS", few)
    g = graph(spark, 30, 120)
    want = expanded_slowly(*g)
    got = S.expanded(*g).collect()
    assert len(got) == len(want) > 100 and {(r.task, r.path, r.reason) for r in got} == want


def test_expanded_lists_no_neighbours_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_NEIGHBOURS", 100)
    fused = spark.createDataFrame([(f"t{t}", "hub", 0.9) for t in range(300)], "task string, path string, confidence double")
    around = spark.createDataFrame([("hub", f"f{i}", "importer") for i in range(1000)], "src string, dst string, kind string")
    files = spark.createDataFrame([(f"f{i}", [f"w{i}"]) for i in range(1000)], "path string, words array<string>")
    tasks = spark.createDataFrame([(f"t{t}", [f"w{t}"], False) for t in range(300)], "task string, words array<string>, tests boolean")
    rows, shuffled, _ = moved(spark, lambda: S.expanded(fused, around, files, tasks))
    assert sorted((r.task, r.path) for r in rows) == sorted((f"t{i}", f"f{i}") for i in range(300))
    assert shuffled < 30_000
