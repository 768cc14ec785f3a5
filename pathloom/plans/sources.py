"""Queries over texts of code and tool output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators import graph as G
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans.tables import read
from pathloom.sources import code, parsers
from pathloom.streaming.authorize import blocked_per_window, verdicts


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stages(spark, "files").put(K.writes(spark, sf_dir).select("path").distinct(), "paths")


def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path imported by its folder's entry file under its name without ending."""
    f = _files(spark, sf_dir)
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.regexp_extract("path", r"([^/.]+)(?:\.[^/]*)?$", 1)
    s = f.where(F.col("path").rlike(r"^[^.*]+/[^/.*]+\.[a-z]+$")).select(F.concat(folder, F.lit("/entry.ts")).alias("importer"), F.concat(F.lit("./"), name).alias("specifier"))
    return G.resolve_imports(s, f).select("importer", "specifier", "target")


def import_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = G.importers(import_targets(spark, sf_dir), _files(spark, sf_dir))
    return i.select("path", F.size("importers").alias("importers"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(code.definitions(F.col("text"))).alias("symbol"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("documents"))


def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = code.identifier_counts(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))
    return c.groupBy("symbol").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def json_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "run_file_lines")
    return d.groupBy("producer", parsers.json_state(F.col("payload")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def write_verdicts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on the whole table at once."""
    w = read(spark, sf_dir, "predicted_writes").where("scored_at IS NOT NULL AND path IS NOT NULL AND task_id IS NOT NULL")
    c = K.tasks(spark, sf_dir).groupBy("task").agg(F.flatten(F.collect_list("allowed_paths")).alias("allowed_paths"))
    p = w.select(F.col("scored_at").alias("ts"), F.lower(F.btrim("task_id", F.lit(" \t\r\n"))).alias("task_id"), "path")
    return blocked_per_window(verdicts(p, c.select(F.col("task").alias("task_id"), "allowed_paths")), "1 day").groupBy(F.date_format("start", "yyyy-MM-dd").alias("day")).agg(F.sum("proposed").alias("proposed"), F.sum("blocked").alias("blocked"))


_FILES = f"WITH writes AS ({K.SQL_WRITES}), files AS (SELECT DISTINCT path FROM writes)"
_ENDS = "[" + ", ".join(f"'{e}'" for e in G.MODULE_ENDINGS) + "]"
_TARGETS = rf"{_FILES}, s AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]+$', 1) || '/entry.ts' AS importer, './' || regexp_extract(path, '([^/.]+)(\.[^/]*)?$', 1) AS specifier FROM files WHERE regexp_matches(path, '^[^.*]+/[^/.*]+\.[a-z]+$')), c AS (SELECT importer, specifier, i AS place, replace(importer, '/entry.ts', '/') || specifier[3:] || ({_ENDS})[i] AS path FROM s, range(1, {len(G.MODULE_ENDINGS) + 1}) r(i)), t AS (SELECT importer, specifier, arg_min(path, place) AS target FROM c JOIN files USING (path) GROUP BY ALL)"
QUERIES = {f.__name__: f for f in (import_targets, import_fan_in, code_symbols, identifier_counts, json_states, write_verdicts_by_window)}
_PROPOSED = f"""p AS MATERIALIZED (SELECT rid, scored_at, lower(trim(task_id, ' \t\r\n')) AS task, inside AS c FROM (SELECT rid, scored_at, task_id, CASE WHEN NOT (SELECT coalesce(min(d) < 0, false) FROM (SELECT sum(CASE WHEN s = '..' THEN -1 ELSE 1 END) OVER (ORDER BY i) AS d FROM (SELECT unnest(segs) AS s, generate_subscripts(segs, 1) AS i))) THEN coalesce({K.SQL_CLEAN.replace("trim({p}, ' " + chr(9) + "')", "{p}").format(p="path")}, '') END AS inside
  FROM (SELECT row_number() OVER () AS rid, scored_at, task_id, path, {K.SQL_SEGMENTS.format(p="path")} AS segs FROM predicted_writes WHERE scored_at IS NOT NULL AND path IS NOT NULL AND task_id IS NOT NULL)))"""
SQL = {
    "write_verdicts_by_window": f"WITH tasks AS ({K.SQL_TASKS}), {_PROPOSED}, a AS (SELECT task, ltrim(pattern, './') AS p FROM (SELECT task, unnest(allowed_paths) AS pattern FROM tasks) WHERE pattern IS NOT NULL), h AS (SELECT x.rid, bool_or({K._GLOB}) AS hit FROM (SELECT rid, task, ltrim(c, './') AS c FROM p WHERE c IS NOT NULL) x JOIN a USING (task) GROUP BY x.rid) SELECT strftime(scored_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS proposed, count(*) FILTER (NOT coalesce(hit, false)) AS blocked FROM p LEFT JOIN h USING (rid) GROUP BY ALL",
    "import_targets": f"{_TARGETS} SELECT importer, specifier, target FROM t WHERE target <> importer",
    "import_fan_in": f"{_TARGETS} SELECT f.path, count(DISTINCT t.importer)::INT AS importers FROM files f LEFT JOIN (SELECT * FROM t WHERE target <> importer) t ON t.target = f.path GROUP BY f.path",
    "code_symbols": f"SELECT symbol, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{code.DEFINITION}', 1))) AS symbol FROM documents) GROUP BY symbol",
    "identifier_counts": r"SELECT symbol, sum(n)::BIGINT AS n, count(*) AS documents FROM (SELECT doc_id, symbol, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS symbol FROM documents) WHERE regexp_matches(symbol, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY ALL) GROUP BY symbol",
    "json_states": r"SELECT producer, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'empty' WHEN json_valid(payload) THEN 'parsed' WHEN json_valid(nullif(regexp_extract(payload, '(?s)\{.*\}'), '')) THEN 'recovered' ELSE 'lost' END AS state, count(*) AS n FROM run_file_lines GROUP BY ALL",
}
