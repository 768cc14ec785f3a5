import json

import pytest
from pyspark.sql import functions as F

from pathloom.sources import code, parsers, readers
from pathloom.streaming.authorize import blocked_per_window, verdicts


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def lines(spark, *texts):
    return parsers.text_lines(spark.createDataFrame(list(enumerate(texts)), "key int, text string"), "key", "text")


def test_commit_log(spark):
    got = parsers.commit_files(lines(spark, "COMMIT\na.py\nb.py\n\nCOMMIT\na.py\na.py"), "key")
    assert rows(got) == [(0, 1, "a.py"), (0, 1, "b.py"), (0, 2, "a.py")]


def test_hunks_and_totals(spark):
    d = lines(spark, "@@ -10,3 +12 @@ x\n-a\n@@ -0,0 +1,2 @@\n@@ -5 +0,0 @@")
    assert rows(parsers.hunk_ranges(d, "key", True)) == [(0, 10, 12), (0, 5, 5)]
    assert rows(parsers.hunk_ranges(d, "key", False)) == [(0, 1, 2), (0, 12, 12)]
    assert rows(parsers.line_totals(lines(spark, "3\t1\ta.py\n-\t-\tb.png\n2\t0\tc.py"), "key")) == [(0, 5, 1, 3)]


def test_test_output(spark):
    out = "tests/a.py::test_x[trio] FAILED [ 10%]\ntests/a.py::test_x[asyncio] PASSED\ntests/a.py::test_y PASSED\nnoise\n"
    r = parsers.pytest_results(lines(spark, out), "key")
    assert rows(r, "status") == [("FAILED",), ("PASSED",), ("PASSED",)]
    need = spark.createDataFrame([(0, "fail_to_pass", "test_x"), (0, "pass_to_pass", "test_y"), (0, "pass_to_pass", "test_z")], "key int, kind string, node string")
    assert rows(parsers.required_passed(r, need)) == [(0, "fail_to_pass", 1, 0), (0, "pass_to_pass", 2, 1)]
    assert rows(parsers.tap_results(lines(spark, "TAP version 13\nok 1 - a\nnot ok 2 - b\nnot ok 3 - c # TODO later"), "key"), "name", "status") == [("a", "PASSED"), ("b", "FAILED"), ("c", "PASSED")]
    report = "log\n" + json.dumps({"testResults": [{"name": "f", "assertionResults": [{"fullName": "n", "status": "passed"}, {"title": "m", "status": "pending"}]}]})
    assert rows(parsers.vitest_results(spark.createDataFrame([(0, report)], "key int, text string"), "key", "text"), "node", "status") == [("m", "FAILED"), ("n", "PASSED")]


def test_json_recovery(spark):
    texts = ['{"writes": [{"path": "a", "confidence": 0.5}, {"path": "b", "confidence": 2}]}', '```json\n{"writes": [{"path": "c", "confidence": 1}]}\n```', 'sure: {"writes": []} done', "{cut", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    assert [r[0] for r in df.coalesce(1).orderBy("key").select(parsers.json_state(F.col("text"))).collect()] == ["parsed", "recovered", "recovered", "lost", "empty", "empty"]
    assert rows(parsers.proposed_writes(df, "key", "text"), "key", "path") == [(0, "a"), (1, "c")]


def test_patch_envelopes(spark):
    t = "x\n*** Begin Patch\n*** Add File: a.py\n+1\n*** Delete File: b.py\n*** End Patch\n"
    got = parsers.patch_operations(spark.createDataFrame([(0, t), (1, "none")], "key int, text string"), "key", "text")
    assert rows(got, "operation", "path", "body") == [("add", "a.py", "+1\n"), ("delete", "b.py", "")]


def test_code(spark):
    files = spark.createDataFrame([("a.py", "import os\nfrom .b import c\nclass A:\n  def m(self): pass\ndef _p(): pass\n"), ("bad.py", "def ("), ("A.java", "package p;\nimport q.B;\nimport r.*;\nclass A {}"), ("q/B.java", "package q;\npublic class B {}"), ("r/C.java", "package r;\nimport q.B.Inner;\nenum C {}")], "path string, text string")
    p = {r.path: r for r in code.python_files(files.where("path LIKE '%.py'")).collect()}
    assert (p["a.py"].imports, p["a.py"].symbols, p["a.py"].exports) == ([".b", "os"], ["A", "_p", "m"], ["A"])
    assert p["bad.py"].symbols == []
    assert rows(code.java_fan_in(files.where("path LIKE '%.java'"))) == [("A.java", 0), ("q/B.java", 2), ("r/C.java", 1)]
    assert files.where("path = 'a.py'").select(code.imports(F.col("text"))).first()[0] == ["os", ".b"]


def test_symbol_index(spark):
    doc = {"documents": [{"relative_path": "a.ts", "occurrences": [{"symbol": "s a/`A`#", "symbol_roles": 1, "range": [0, 0, 1]}], "symbols": [{"symbol": "s a/`A`#", "display_name": "A"}]}, {"relative_path": "b.ts", "occurrences": [{"symbol": "s a/`A`#", "range": [4, 0, 1]}]}]}
    entities, refs = code.symbol_index(spark.createDataFrame([(json.dumps(doc),)], "text string"), "text")
    assert rows(entities, "name", "path", "references") == [("A", "a.ts", ["b.ts"])]
    assert rows(refs, "path", "lines") == [("b.ts", [5])]


def test_readers(spark, tmp_path):
    (tmp_path / "tasks.json").write_text(json.dumps({"version": "1.0", "tasks": [{"id": "b", "prompt": "x"}, {"id": "a", "prompt": "y", "hints": {"touches": ["nav"]}}]}))
    assert rows(readers.read_tasks(spark, str(tmp_path / "tasks.json")), "task_idx", "id") == [(0, "b"), (1, "a")]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "one.json").write_text(json.dumps({"strategy": "s1", "backend": "mock", "tasks": [{"task_id": "t"}]}))
    (runs / "two.json").write_text(json.dumps({"strategies": {"s2": {"backend": "mock", "tasks": []}, "s3": {"strategy": "own", "tasks": []}}}))
    r = readers.read_runs(spark, str(runs))
    assert rows(r, "strategy") == [("own",), ("s1",), ("s2",)]
    assert readers.merge_runs(r, "file").count() == 2
    assert rows(readers.missing_runs(spark.createDataFrame([(1, "a")], "seed int, strategy string"), [1, 2], ["a"])) == [(2, "a")]


def test_contract_faults(spark):
    good = {"version": "1.0", "repo": {"root": "."}, "tasks": [{"id": "a-1", "allowed_paths": []}]}
    bad = {"version": "1.0", "repo": {}, "extra": 1, "tasks": [{"id": "A!", "odd": 1, "predicted_writes": [{"path": "x", "confidence": 3}], "file_scopes": [{"path": "x", "tier": "maybe", "score": 0.1}]}]}
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("cut", "{"), ("none", None)], "key string, text string")
    got = rows(readers.contract_faults(df, "key", "text"))
    assert sorted(f for k, f in got if k == "bad") == ["confidence", "scope", "task id", "unknown key", "unknown key of a task"]
    assert not [f for k, f in got if k == "good"] and ("cut", "not JSON") in got


def test_scan_and_tables(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "a.txt").write_text("x")
    (tmp_path / "node_modules" / "b.js").write_text("x")
    assert rows(readers.scan_sources(spark, str(tmp_path))) == [("src/a.py", "x = 1")]
    df = spark.createDataFrame([("a|b", 1)], "k string, n int")
    readers.write_table(df, str(tmp_path / "t"))
    assert rows(readers.read_table(spark, str(tmp_path / "t"))) == [("a|b", "1")]
    assert readers.markdown(df).endswith("| a\\|b | 1 |\n")


def test_stream(spark, tmp_path):
    contracts = spark.createDataFrame([("t", ["src/**", ".env"])], "task_id string, allowed_paths array<string>")
    data = [("2026-01-01 00:00:01", "t", "src/a.ts"), ("2026-01-01 00:00:02", "t", "../x"), ("2026-01-01 00:06:00", "t", "lib/a"), ("2026-01-01 00:07:00", "u", "src/a.ts")]
    df = spark.createDataFrame(data, "ts string, task_id string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(verdicts(df, contracts), "path", "allowed", "reason") == [("../x", False, "escapes repository root"), ("lib/a", False, "outside allowed paths"), ("src/a.ts", False, "no contract"), ("src/a.ts", True, None)]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = blocked_per_window(verdicts(stream, contracts)).writeStream.format("memory").queryName("blocked").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(spark.table("blocked"), "task_id", "proposed", "blocked") == [("t", 1, 1), ("t", 2, 1), ("u", 1, 1)]
