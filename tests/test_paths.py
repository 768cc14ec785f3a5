import fnmatch
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.functions.text import camel, identifier_tokens, slug, snake, token_estimate
from pathloom.functions.text import test_name as bare_name


def column(spark, rows, expr, schema="a string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def clean(p):
    out = []
    for s in p.strip(" \t").replace("\\", "/").split("/"):
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out) or None


CASES = [" a/b ", "a\\b", "./a//b/./c", "a/../b", "../a", "a/b/../../c", "/a", "", " ", ".", "..", "a/..", "[id]/p*.ts", "A/b.TS", "\ta", "a b/c", "a/ b"]


def test_clean_path(spark):
    assert column(spark, [(c,) for c in CASES], P.clean_path(F.col("a"))) == [clean(c) for c in CASES]
    assert column(spark, [(None,)], P.clean_path(F.col("a"))) == [None]


def test_clean_path_set(spark):
    got = column(spark, [([*CASES, None, "a/b"],), ([],), (None,), ([None],)], F.array_sort(P.clean_path_set(F.col("a"))), "a array<string>")
    assert got == [sorted({clean(c) for c in CASES} - {None}), [], None, []]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab./\\ \t", max_size=9), max_size=30))
def test_clean_path_like_plain_python(spark, texts):
    assert column(spark, [(t,) for t in texts], P.clean_path(F.col("a"))) == [clean(t) for t in texts]


def test_lexical_path_escapes(spark):
    got = column(spark, [("../outside.ts",), ("src/../../outside.ts",), ("./../outside.ts",), ("src/./a/../b.ts",), (" a",), (None,)], P.lexical_path(F.col("a")))
    assert [r and (r["path"], r["escapes"]) for r in got] == [(None, True), (None, True), (None, True), ("src/b.ts", False), (" a", False), None]


def test_write_path(spark):
    got = column(spark, [("/work/repo/a/b",), ("/work/repo",), ("/elsewhere/a",), ("a/b",), ("../a",)], P.write_path(F.col("a"), F.lit("/work/repo/")))
    assert [(r["path"], r["reason"]) for r in got] == [("a/b", None), ("", None), (None, "outside repo root"), ("a/b", None), (None, "escapes repository root")]


def covered(pattern, path):
    """The same by regular expressions."""
    p, c = pattern.lstrip("./"), path.lstrip("./")
    if p.endswith("/**"):
        return f"{c}/".startswith(p[:-2])
    if "**" in p:
        literal = [re.escape(piece.strip("/")) for piece in p.split("**")]
        start = "^" if literal[0] else ""
        return bool(re.search(start + ".*".join(x for x in literal if x), c))
    return fnmatch.fnmatchcase(c, p)


PATTERNS = ["src/**", "**/a.py", "src/**/b.ts", "a*.py", "a?.py", "[abc].py", "[!a].py", "[id]/page.tsx", ".env.example", "src/a+b(1).ts", "x[y", "**", "src/*/c.ts", "./src/a.ts", "a|b"]
PATHS = ["src", "src/a.ts", "src/x/b.ts", "srcx/a.ts", "a.py", "ab.py", "deep/a.py", "b.py", "i/page.tsx", "[id]/page.tsx", "env.example", ".env.example", "src/a+b(1).ts", "x[y", "src/q/c.ts", "src/q/r/c.ts", "a|b", "a"]


def test_glob_matches(spark):
    rows = [(p, c) for p in PATTERNS for c in PATHS]
    got = column(spark, rows, P.glob_matches(F.col("p"), F.col("c")), "p string, c string")
    assert got == [covered(p, c) for p, c in rows]


def test_plain_glob_and_kinds(spark):
    assert column(spark, [("a/**", "a"), ("a/**", "a/b"), ("a", "a"), ("[id]", "[id]")], P.plain_glob_matches(F.col("p"), F.col("c")), "p string, c string") == [False, True, True, True]
    assert column(spark, [("a/**",), ("a/**/b",), ("a*",), ("a",)], P.glob_kind(F.col("a"))) == ["subtree", "ordered", "wildcard", "exact"]


def test_broadened(spark):
    rows = [("a/b/c/d.ts", 0.7), ("a/b/c/d.ts", 0.69), ("a/b/c.ts", 0.9), ("tests/x/y.ts", 0.9), ("tests/y.ts", 0.9)]
    assert column(spark, rows, P.broadened(F.col("p"), F.col("c")), "p string, c double") == ["a/b/c/**", "a/b/c/d.ts", "a/b/c.ts", "tests/x/**", "tests/y.ts"]


@pytest.mark.parametrize(("path", "kind", "where"), [("app/page.tsx", "page", "/"), ("src/app/api/x/route.ts", "api", "/api/x"), ("app/x/layout.tsx", "layout", "/x"), ("a/OwnerController.java", "spring_controller", None), ("lib/page.tsx", None, None)])
def test_route(spark, path, kind, where):
    (r,) = column(spark, [(path,)], P.route(F.col("a")))
    assert (r and (r["kind"], r["route"])) == (kind and (kind, where))


def test_flags(spark):
    paths = ["src/x.test.ts", "tests/a.py", "src/latest.ts", ".env.local", "a/vite.config.ts", "src/test/java/A.java"]
    assert column(spark, [(p,) for p in paths], P.in_test_folder(F.col("a"))) == [True, True, False, False, False, True]
    assert column(spark, [(p,) for p in paths], P.is_config(F.col("a"), ("package.json",))) == [False, False, False, True, True, False]


def test_names(spark):
    assert column(spark, [("fooBar_baz-HTTPServer2x/a.ts",)], identifier_tokens(F.col("a"))) == [["foo", "bar", "baz", "httpserver2x", "a", "ts"]]
    assert column(spark, [("Add OAuth login!",)], slug(F.col("a"))) == ["add-oauth-login"]
    assert column(spark, [("my-suite name",)], snake(F.col("a"))) == ["my_suite_name"]
    assert column(spark, [("my-suite name",)], camel(F.col("a"))) == ["mySuiteName"]
    assert column(spark, [("",), ("12345678",)], token_estimate(F.col("a"))) == [1, 2]
    assert column(spark, [("tests/x.py::T::test_a[b-c]",), ("test_a",)], bare_name(F.col("a"))) == ["test_a", "test_a"]
