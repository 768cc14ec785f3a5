import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions import tasks as T
from pathloom.operators import selection as S
from pathloom.operators import symbols as Y


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_prompt_functions(spark):
    df = spark.createDataFrame([("see ./src/a.tsx and docs/x.md, x.md", ["Tests", None]), (None, None), ("", [])], "t string, h array<string>")
    got = df.select(T.mentioned_files(F.col("t")).alias("m"), T.asks_for_docs(F.col("t")).alias("d"), T.asks_for_tests(F.col("t")).alias("s"), T.hinted_as_test(F.col("h")).alias("h"), T.string_list(F.col("h")).alias("l")).collect()
    assert tuple(got[0]) == (["src/a.ts", "docs/x.md", "x.md"], True, False, True, ["Tests"])
    assert tuple(got[1]) == (None, None, None, False, []) and tuple(got[2]) == ([], False, False, False, [])


def test_reported_values(spark):
    df = spark.createDataFrame([(v,) for v in ("422", " 7.9 ", "-3", "n/a", "true", "", None, "$0.5")], "v string")
    assert [tuple(r) for r in df.select(T.token_count(F.col("v")), T.cost(F.col("v"))).collect()] == [(422, 422.0), (7, 7.9), (0, -3.0), (None, None), (None, None), (None, None), (None, None), (None, 0.5)]


def test_paths_that_patches_may_write(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.py", "/etc/x", "a/../b", " ", "a\\..\\b", "docs/README.md", "x/doc/y")], "p string")
    assert [tuple(r) for r in df.select(T.stays_inside(F.col("p")), T.is_docs(F.col("p"))).collect()] == [(True, False), (False, False), (False, False), (False, False), (False, False), (True, True), (True, True)]


def test_surest_and_reranked(spark):
    s = spark.createDataFrame([("t", "a", 0.5, "x", 2), ("t", "a", 0.5, "y", 1), ("t", "b", None, "z", 3), (None, "c", 1.0, "", 4)], "task string, path string, confidence double, reason string, place long")
    assert rows(S.surest(s), "path", "confidence", "reason") == [("a", 0.5, "y"), ("b", None, "z")]
    again = spark.createDataFrame([("t", "a", 0.9, "", 1), ("t", "b", 0.2, "explicit", 1), ("t", "n", 0.3, "new", 1)], "task string, path string, confidence double, reason string, place long")
    assert rows(S.reranked(S.surest(s), again, "explicit")) == [("t", "a", 0.9, "y"), ("t", "b", None, "explicit"), ("t", "n", 0.3, "new")]
    assert S.surest(s.limit(0)).count() == 0 and S.reranked(s.limit(0), s.limit(0), "x").count() == 0


def test_expansion(spark):
    fused = spark.createDataFrame([("t", "lib/a.js", 0.95), ("t", "lib/b.js", 0.95), ("t", "lib/low.js", 0.1)], "task string, path string, confidence double")
    edges = spark.createDataFrame([("lib/a.js", "lib/v.js", "import"), ("lib/b.js", "lib/v.js", "import"), ("lib/a.js", "lib/w.js", "import"), ("lib/a.js", "types/a.d.ts", "type"), ("lib/a.js", "lib/billing.js", "import"), ("lib/a.js", "tests/billing.js", "import"), ("lib/low.js", "lib/z.js", "type")], "src string, dst string, kind string")
    names = ["lib/v.js", "lib/w.js", "types/a.d.ts", "lib/billing.js", "tests/billing.js", "lib/z.js"]
    files = spark.createDataFrame([(n, [w for w in n.replace("/", ".").split(".")]) for n in names], "path string, words array<string>")
    task = lambda tests: spark.createDataFrame([("t", ["billing"], tests)], "task string, words array<string>, tests boolean")
    around = S.neighbours(edges)
    assert rows(S.expanded(fused, around, files, task(False)), "path") == [("lib/billing.js",), ("lib/v.js",), ("types/a.d.ts",)]
    assert ("tests/billing.js",) in rows(S.expanded(fused, around, files, task(True)), "path")
    assert rows(S.stub_neighbours(fused, edges.where("kind = 'type'")), "anchor", "path") == [("lib/a.js", "types/a.d.ts"), ("lib/low.js", "lib/z.js")]


def test_pagerank_over_symbols_equals_that_over_pairs(spark):
    r = random.Random(2)
    defined = sorted({(r.randrange(8), f"s{r.randrange(6)}") for _ in range(14)})
    named = {(r.randrange(10), f"s{r.randrange(7)}"): r.randrange(1, 4) for _ in range(30)}
    edges = {}
    for (f, s), n in named.items():
        for g, t in defined:
            if s == t and f != g:
                edges[(f, g)] = edges.get((f, g), 0) + n
    out = {}
    for (f, _), n in edges.items():
        out[f] = out.get(f, 0) + n
    rank = dict.fromkeys(range(10), 0.1)
    for _ in range(7):
        lost = sum(v for f, v in rank.items() if f not in out)
        new = {f: 0.1 * (0.15 + 0.85 * lost) for f in rank}
        for (f, g), n in edges.items():
            new[g] += 0.85 * rank[f] * n / out[f]
        rank = new
    files = spark.createDataFrame([(i, 1.0) for i in range(10)], "file long, weight double")
    refs = spark.createDataFrame([(f, s, n) for (f, s), n in named.items()], "file long, symbol string, n long")
    defs = spark.createDataFrame(defined, "file long, symbol string")
    assert {x.file: x["rank"] for x in Y.symbol_pagerank(files, refs, defs, 7).collect()} == pytest.approx(rank)
    weights = {}
    for (_, g), n in edges.items():
        weights[g] = weights.get(g, 0) + n
    assert {x.file: x.weight for x in Y.definer_weights(refs, defs).collect()} == weights
    assert Y.symbol_pagerank(files.limit(0), refs, defs).count() == 0
