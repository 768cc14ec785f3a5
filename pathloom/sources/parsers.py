"""Parsers of tool output and of replies, as DataFrame operations on lines and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---- fixed values that results depend on --------------------------------------------------------

PYTEST_LINE = r"^(\S+)\s+(PASSED|FAILED|ERROR)(?:\s+\[.*?\])?\s*$"

# -------------------------------------------------------------------------------------------------


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): the lines of each text, from 1, without line ends."""
    return texts.select(key, F.posexplode(F.split(text, r"\r?\n"))).select(key, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def commit_files(lines: DataFrame, key: str, marker: str = "COMMIT") -> DataFrame:
    """(key, commit_no, path): file names that follow each marker line of a log; repeats once.

    Names before the first marker form commit 0.  ``lines``: key, line_no, line."""
    line = F.btrim("line")
    n = F.sum((line == marker).cast("int")).over(Window.partitionBy(key).orderBy("line_no"))
    return lines.withColumn("commit_no", n).where((line != marker) & (line != "")).select(key, "commit_no", line.alias("path")).distinct()


def hunk_ranges(lines: DataFrame, key: str, old: bool) -> DataFrame:
    """(key, lo, hi): line ranges of a diff's hunks on its old or new side; empty sides have none."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    at, n = (1, 2) if old else (3, 4)
    start = F.regexp_extract("line", pattern, at)
    count = F.regexp_extract("line", pattern, n)
    h = lines.where(F.col("line").rlike(pattern)).select(key, start.cast("long").alias("lo"), F.when(count != "", count.try_cast("long")).otherwise((start != "0").cast("long")).alias("n"))
    return h.where("n > 0").select(key, "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))


def line_totals(lines: DataFrame, key: str) -> DataFrame:
    """(key, added, deleted, files) of a numstat; binary files count as files only."""
    parts = F.split("line", "\t")
    p = lines.where(F.size(parts) >= 3).select(key, F.get(parts, 0).try_cast("long").alias("a"), F.get(parts, 1).try_cast("long").alias("d"))
    return p.groupBy(key).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("added"), F.coalesce(F.sum("d"), F.lit(0)).alias("deleted"), F.count(F.lit(1)).alias("files"))


def pytest_results(lines: DataFrame, key: str) -> DataFrame:
    """(key, node, status) of verbose pytest output; of repeated nodes the last line holds."""
    r = lines.where(F.col("line").rlike(PYTEST_LINE)).select(key, F.regexp_extract("line", PYTEST_LINE, 1).alias("node"), F.regexp_extract("line", PYTEST_LINE, 2).alias("status"), "line_no")
    return r.groupBy(key, "node").agg(F.max_by("status", "line_no").alias("status"))


def tap_results(lines: DataFrame, key: str) -> DataFrame:
    """(key, number, name, status) of TAP output; skipped and to-do tests count as passed."""
    pattern = r"^\s*(not )?ok\b\s*(\d+)?\s*-?\s*(.*?)\s*(#\s*(?i:skip|todo).*)?$"
    bad = F.regexp_extract("line", pattern, 1) != ""
    excused = F.regexp_extract("line", pattern, 4) != ""
    return lines.where(F.col("line").rlike(pattern)).select(key, F.regexp_extract("line", pattern, 2).try_cast("int").alias("number"), F.regexp_extract("line", pattern, 3).alias("name"), F.when(bad & ~excused, "FAILED").otherwise("PASSED").alias("status"))


_VITEST = "testResults array<struct<name:string,assertionResults:array<struct<fullName:string,title:string,status:string>>>>"


def vitest_results(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, file, node, status) of a JSON test report that may follow other output."""
    o = F.from_json(F.substring(F.col(text), F.locate("{", F.col(text)), F.length(text)), _VITEST)
    files = texts.select(key, F.explode(o["testResults"]).alias("f"))
    tests = files.select(key, F.col("f.name").alias("file"), F.explode("f.assertionResults").alias("t"))
    return tests.select(key, "file", F.coalesce("t.fullName", "t.title").alias("node"), F.when(F.col("t.status") == "passed", "PASSED").otherwise("FAILED").alias("status"))


def required_passed(observed: DataFrame, required: DataFrame) -> DataFrame:
    """(key, kind, required, passed): required tests all of whose observed variants passed.

    ``observed``: key, node, status; ``required``: key, kind, node.  Tests are compared by bare name;
    one that wasn't observed has not passed."""
    from pathloom.functions.text import test_name

    o = observed.groupBy("key", test_name(F.col("node")).alias("name")).agg(F.bool_and(F.col("status") == "PASSED").alias("ok"))
    r = required.withColumn("name", test_name(F.col("node"))).join(o, ["key", "name"], "left")
    return r.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("required"), F.count_if(F.coalesce("ok", F.lit(False))).alias("passed"))


def recovered_json(reply: Column) -> Column:
    """The JSON text in a reply: as it is, without a code fence, or from the first ``{`` to the last
    ``}``; null if neither parses."""
    t = F.btrim(reply)
    bare = F.btrim(F.regexp_replace(F.btrim(t, F.lit("`")), "^(?i:json)", ""))
    t = F.when(F.startswith(t, F.lit("```")), bare).otherwise(t)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(t).isNotNull(), t).when((inner != "") & F.try_parse_json(inner).isNotNull(), inner)


def json_state(reply: Column) -> Column:
    """parsed, recovered, lost or empty."""
    t = F.btrim(reply)
    return F.when(reply.isNull() | (t == ""), "empty").when(F.try_parse_json(t).isNotNull(), "parsed").when(recovered_json(reply).isNotNull(), "recovered").otherwise("lost")


def proposed_writes(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, place, path, confidence, reason) of replies that hold {"writes": [...]}; entries without
    path or with a confidence outside 0 and 1 are left out."""
    o = F.from_json(recovered_json(F.col(reply)), "writes array<struct<path:string,confidence:double,reason:string>>")
    w = replies.select(key, F.posexplode(o["writes"]))
    return w.select(key, F.col("pos").alias("place"), "col.*").where("path <> '' AND confidence BETWEEN 0 AND 1")


def patch_operations(replies: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, place, operation, path, body) of the file sections of patch envelopes in replies."""
    blocks = F.regexp_extract_all(F.col(reply), F.lit(r"(?s)\*\*\* Begin Patch\n(.*?)\*\*\* End Patch"), 1)
    text = F.array_join(blocks, "\n")
    header = r"(?m)^\*\*\* (Add|Update|Delete) File: (.+)$"
    parts = F.filter(F.split(text, r"(?m)(?=^\*\*\* (?:Add|Update|Delete) File: )"), lambda p: p.rlike(header))
    s = replies.select(key, F.posexplode(parts))
    return s.select(key, F.col("pos").alias("place"), F.lower(F.regexp_extract("col", header, 1)).alias("operation"), F.btrim(F.regexp_extract("col", header, 2)).alias("path"), F.regexp_replace("col", r"^[^\n]*\n?", "").alias("body"))
