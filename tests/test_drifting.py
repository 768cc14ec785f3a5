import json

import pytest

from pathloom.operators.flooding import changes, evidence
from pathloom.sources.drifting import cast_value, failed_casts, file_schemas, flatten, kind_of, one_table, schema_changes


def found(old, new):
    return {(n, k, t) for n, k, t in changes(tuple(sorted(old.items())), tuple(sorted(new.items())))}


def test_renames_moves_and_retypes():
    assert found({"status": "string", "id": "number"}, {"task_status": "string", "id": "number"}) == {("status", "renamed", "task_status")}
    assert found({"m.typecheck_ran": "boolean", "m.x": "number"}, {"typecheck_ran": "string", "m.x": "number"}) == {("m.typecheck_ran", "renamed", "typecheck_ran"), ("m.typecheck_ran", "retyped", "typecheck_ran")}
    assert found({"oob_files": "number"}, {"out_of_bounds_files": "number"}) == {("oob_files", "renamed", "out_of_bounds_files")}
    assert found({"a": "number"}, {"a": "string"}) == {("a", "retyped", "a")}


def test_unrelated_fields_are_removed_and_added():
    assert found({"patch_na_reason": "string"}, {"overlay_skip_reason": "string"}) == {("patch_na_reason", "removed", None), ("overlay_skip_reason", "added", "overlay_skip_reason")}
    assert found({"changed_files": "list of strings"}, {"oob_files": "list of strings"}) == {("changed_files", "removed", None), ("oob_files", "added", "oob_files")}
    assert found({}, {"x": "number"}) == {("x", "added", "x")}
    assert found({"x": "number"}, {}) == {("x", "removed", None)}


def test_each_field_corresponds_once():
    got = found({"wall_seconds": "number"}, {"wall_time_seconds": "number", "m.wall_seconds": "number"})
    assert got == {("wall_seconds", "renamed", "m.wall_seconds"), ("wall_time_seconds", "added", "wall_time_seconds")}


def test_kinds():
    assert [kind_of(v) for v in (None, [], [None], True, 1, 1.5, "", ["a"], [{"a": 1}], [None, "a"])] == [None, None, None, "boolean", "number", "number", "string", "list of strings", "list of objects", "list of strings"]
    assert sorted(flatten({"a": {"b": {"c": 1}, "d": []}, "e": {}})) == [("a.b.c", 1), ("a.d", [])]
    assert evidence("a", "b") == 0 and evidence("promptTokens", "tokens_prompt") == 1


def test_casts():
    assert cast_value("a, b,,", "list of strings") == ["a", "b"]
    assert cast_value([{"path": "p"}, None, "q"], "list of strings") == ["p", "q"]
    assert cast_value(3, "list of strings") is None
    assert [cast_value(v, "boolean") for v in (True, "yes", 0, "maybe")] == [True, True, False, None]
    assert [cast_value(v, "number") for v in ("12.5s", "1,000", 3, True, "x")] == [12.5, 1000.0, 3.0, 1.0, None]


@pytest.fixture(scope="module")
def lines(spark):
    def line(o):
        return json.dumps(o)

    rows = [
        ("p", 2, 20, 1, line({"b": "x", "k": [1], "extra": None})),
        ("p", 1, 10, 1, line({"a": 1, "k": []})),
        ("p", 1, 10, 2, line({"a": 2, "k": ["z"]})),
        ("p", 1, 10, 3, '{"cut": '),
        ("p", 5, 50, 1, line({"b": 4, "k": ["z"]})),
        ("q", 1, 11, 1, line({"b": 1})),
        (None, 1, 12, 1, None),
    ]
    return spark.createDataFrame(rows, "producer string, file_seq int, file_id long, line_no int, payload string")


def test_changes_follow_the_order_of_files(lines):
    got = sorted((r.file_id, r.field_name, r.change_kind) for r in schema_changes(file_schemas(lines)).collect())
    assert got == [(20, "a", "removed"), (20, "b", "added"), (50, "b", "retyped")]


def test_one_table(lines):
    got = {(r.file_id, r.line_no): r for r in one_table(lines, ["file_id", "line_no"]).collect()}
    assert set(got) == {(20, 1), (10, 1), (10, 2), (50, 1), (11, 1)}
    assert got[(10, 2)]["k"] == ["z"] and got[(20, 1)]["b"] == "x" and got[(50, 1)]["b"] == "4"
    assert got[(20, 1)]["k"] is not None and got[(10, 1)]["k"] is None


def test_no_value_is_lost(spark):
    rows = [("p", 1, 1, i, json.dumps({"flag": v, "n": v2, "files": v3})) for i, (v, v2, v3) in enumerate([(True, 1, ["a"]), ("skipped", "2.5", 3), (3, 7, "b, c")])]
    df = spark.createDataFrame(rows, "producer string, file_seq int, file_id long, line_no int, payload string")
    t = one_table(df, ["line_no"])
    assert dict(t.dtypes) == {"line_no": "int", "flag": "string", "n": "double", "files": "string"}
    assert [tuple(r) for r in t.select("flag", "n", "files").orderBy("line_no").collect()] == [("true", 1.0, '["a"]'), ("skipped", 2.5, "3"), ("3", 7.0, "b, c")]
    forced = one_table(df, ["line_no"], {"files": "list of strings"})
    assert [r.files for r in forced.orderBy("line_no").collect()] == [["a"], None, ["b", "c"]]
    assert [tuple(r) for r in failed_casts(df, ["line_no"], {"files": "list of strings"}).collect()] == [(1, "files", "list of strings", "3")]


def test_a_rename_without_common_words_is_told_by_values():
    old, new = (("duration", "number"), ("id", "string")), (("elapsed", "number"), ("id", "string"))
    same = list(range(10))
    assert ("duration", "renamed", "elapsed") in changes(old, new, ({"duration": same}, {"elapsed": same[2:]}))
    assert ("duration", "removed", None) in changes(old, new, ({"duration": same}, {"elapsed": range(20, 30)}))
    assert ("duration", "removed", None) in changes(old, (*new, ("other", "number")), ({"duration": same}, {"elapsed": same, "other": same}))


def test_empty_table(spark, lines):
    assert schema_changes(file_schemas(lines.limit(0))).count() == 0
    assert one_table(lines.limit(0), ["file_id"]).count() == 0
