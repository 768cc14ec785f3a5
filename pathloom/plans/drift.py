"""Drifting schemas of run files (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.latest import latest
from pathloom.plans.tables import read
from pathloom.sources.drifting import failed_casts, file_schemas, one_table, schema_changes


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "run_file_lines").where("file_id IS NOT NULL")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file's fields against the producer's file before it."""
    return schema_changes(file_schemas(_lines(spark, sf_dir))).select("file_id", "field_name", "change_kind")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, with the new names and kinds."""
    return schema_changes(file_schemas(_lines(spark, sf_dir)))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of all lines with unified names and kinds; repeated lines once."""
    return one_table(_once(spark, sf_dir), ["producer", "file_id", "file_seq", "line_no"])


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_lines(spark, sf_dir), ["file_id", "line_no"], "landed_at", ["payload"])


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: rows of the one table, and those with a task and a run in it."""
    t = p5_unified(spark, sf_dir)
    return t.groupBy("file_id").agg(F.count(F.lit(1)).alias("lines"), F.count("task_id").alias("tasks"), F.count("run_id").alias("runs"))


def p5_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are neither lists nor texts of names where lists of files are asked for."""
    keys = ["file_id", "line_no"]
    return failed_casts(_once(spark, sf_dir), keys, {c: "list of strings" for c in ("out_of_bounds_files", "actual_changed_files")})


_ONCE = "SELECT file_id, line_no, payload FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line_no ORDER BY landed_at DESC NULLS LAST, payload DESC NULLS LAST) rn FROM run_file_lines WHERE file_id IS NOT NULL) WHERE rn = 1 AND json_valid(payload) AND json_type(payload) = 'OBJECT'"
_FILES = ["out_of_bounds_files", "outOfBoundsFiles", "oob_files", "out_of_bounds", "actual_changed_files", "actualChangedFiles", "changed_files", "files_changed_actual"]
SQL = {
    "p5_lines": f"SELECT file_id, count(*) AS lines, count(payload->>'task_id') AS tasks, count(payload->>'run_id') AS runs FROM ({_ONCE}) GROUP BY file_id",
    "p5_lost": f"""SELECT file_id, line_no, field_name, 'list of strings' AS kind, value FROM (SELECT file_id, line_no, p || n AS field_name, json_extract(payload, '$.' || p || n)::VARCHAR AS value, json_type(payload, '$.' || p || n) AS t
  FROM ({_ONCE}), (SELECT unnest({_FILES}) AS n), (SELECT unnest(['', 'metrics.']) AS p)) WHERE t IN ('BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')""",
}
