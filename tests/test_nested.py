import json

import duckdb

from pathloom.plans.documents import MAPS, p6_found
from pathloom.sources.nested import NestedTables


def expected(sf):
    """Problem 6 by walking each body, apart from the operator."""
    out = []
    seen = set()
    for raw_id, body in duckdb.sql(f"SELECT raw_id, body FROM '{sf}/raw_documents.parquet' ORDER BY landed_at DESC").fetchall():
        if raw_id in seen:
            continue
        seen.add(raw_id)
        try:
            doc = json.loads(body)
        except ValueError:
            continue
        runs = [(doc.get("strategy") or "", doc)] if "tasks" in doc else [(r.get("strategy") or name, r) for name, r in doc["strategies"].items()]
        for key, run in runs:
            tasks = run["tasks"]
            if isinstance(tasks, dict):
                tasks = [tasks] if "task_id" in tasks or "id" in tasks else [{"id": k, **v} for k, v in tasks.items() if isinstance(v, dict)]
            for task in tasks:
                if not isinstance(task, dict):
                    continue
                for field, column in (("metrics", "tokens_prompt"), ("artifacts", "diff_path"), ("file_scopes", "tier")):
                    there = task.get(field)
                    for i, o in enumerate(there if isinstance(there, list) else [there]):
                        if isinstance(o, dict) and o.get(column) not in (None, ""):
                            out.append((raw_id, key, task.get("task_id", task.get("id")), f"{field}.{column}", i))
    return sorted(out)


def test_found_equals_walking(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in p6_found(spark, sf).select("raw_id", "run_key", "task_id", "field_name", "item_no").collect())
    assert got == expected(sf)
    assert len(got) > 100


def tables(spark, *bodies):
    return NestedTables(spark.createDataFrame(list(enumerate(bodies)), "raw_id long, body string"), "raw_id", "body", MAPS)


def test_equal_objects_are_stored_once(spark):
    n = tables(spark, '{"tasks": [{"id": "a", "m": {"x": 1, "y": null}}, {"m": {"y": null, "x": 1}, "id": "b"}]}')
    m = n.table("m", {"x": "x"}).orderBy("occ").collect()
    assert len(m) == 2 and m[0]["node"] == m[1]["node"] and m[0]["parent"] != m[1]["parent"]
    assert n.nodes.count() == 4


def test_parents_differ_if_a_child_does(spark):
    n = tables(spark, '{"a": {"b": {"c": 1}}}', '{"a": {"b": {"c": 2}}}', '{"a": {"b": {"c": 1}}}')
    by_doc = {r["doc_id"]: r["node"] for r in n.bridge.where("field = 'a'").collect()}
    assert by_doc[0] == by_doc[2] != by_doc[1]


def test_odd_bodies(spark):
    deep = '{"a":' * 400 + "1" + "}" * 400
    n = tables(spark, None, "", "{", "[1]", "3", "{}", deep, '{"tasks": null}', '{"tasks": []}', '{"tasks": [null, 3, {"id": "x"}]}')
    per = {r["doc_id"]: r["n"] for r in n.bridge.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert per == {5: 1, 6: 400, 7: 1, 8: 1, 9: 2}
    assert n.bridge.where("field = 'tasks'").first()["ordinal"] == 2


def test_maps_and_lone_objects(spark):
    n = tables(spark, '{"tasks": {"t1": {"status": "x"}, "t2": null, "t3": [{"q": 1}, null, {"q": 2}]}}', '{"tasks": {"id": "z", "m": {"q": 1}}}')
    got = sorted((r["doc_id"], r["name"] or "", r["ordinal"]) for r in n.bridge.where("field = 'tasks'").collect())
    assert got == [(0, "t1", 0), (0, "t3", 0), (0, "t3", 2), (1, "", 0)]


def test_empty_table(spark):
    assert NestedTables(spark.createDataFrame([], "raw_id long, body string, node string"), "raw_id", "body", MAPS).bridge.count() == 0
