"""Queries over whole texts and reported values: files named, languages, replies, logs, test output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import tasks as T
from pathloom.functions.text import plain_name
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans import runs as E
from pathloom.plans.tables import read
from pathloom.sources import code, parsers


def file_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.mentioned_files(F.col("text"))).alias("path"))
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", T.asks_for_docs(F.col("text")).alias("docs_task"), T.asks_for_tests(F.col("text")).alias("test_task"))


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "predicted_writes").select("path").where("path IS NOT NULL").distinct()
    return p.select("path", T.is_docs(F.col("path")).alias("is_docs"), T.stays_inside(F.col("path")).alias("stays_inside"))


def task_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contract: its text (suite, name and files), by md5, and whether its files hint at tests."""
    t = K.tasks(spark, sf_dir)
    return t.select("contract_id", F.md5(T.task_text(F.col("task"), F.col("suite_name"), F.col("allowed_paths"))).alias("text"), T.hinted_as_test(F.flatten(F.transform(F.filter("allowed_paths", lambda p: p.isNotNull()), lambda p: F.split(p, "/")))).alias("hinted"))


def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed paths as they come, once each, and sorted."""
    t = K.tasks(spark, sf_dir).select("contract_id", "allowed_paths")
    distinct = F.array_distinct(F.filter("allowed_paths", lambda v: v.isNotNull() & (v != "")))
    return t.select("contract_id", F.array_join(distinct, "|").alias("in_order"), F.array_join(T.string_list(F.col("allowed_paths")), "|").alias("sorted"))


def needle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that contain a word of a suite's name, with the first such word."""
    words = read(spark, sf_dir, "runs").where("suite_name IS NOT NULL").select("suite_name").distinct().withColumn("needles", F.split("suite_name", "-"))
    hits = words.select("suite_name", F.posexplode("needles").alias("place", "needle")).where("needle <> ''")
    paths = K.writes(spark, sf_dir).select("path").distinct()
    # a path is looked up by its own pieces of each needle's length, so no path meets all suites
    lengths = F.explode(F.sequence(F.lit(1), F.lit(32)))
    pieces = paths.select("path", F.lower("path").alias("low"), lengths.alias("n")).where("n <= length(low)").select("path", F.explode(F.expr("array_distinct(transform(sequence(1, length(low) - n + 1), i -> substring(low, i, n)))")).alias("needle"))
    near = pieces.join(F.broadcast(hits.select(F.lower("needle").alias("needle")).distinct()), "needle")
    met = near.join(hits.withColumn("needle", F.lower("needle")), "needle")
    return met.groupBy("suite_name", "path").agg(F.min_by("needle", "place").alias("needle"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "runs").where("created_at IS NOT NULL")
    return r.select("run_id", T.run_name(F.lit("run"), plain_name(F.col("strategy")), F.col("backend"), F.col("created_at")).alias("name"), T.iso(F.col("created_at")).alias("at"))


def reported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and costs of all lines of run files, under whichever of their names they come."""
    d = read(spark, sf_dir, "run_file_lines").where("payload IS NOT NULL").select("file_id", "line_no", "landed_at", "payload")
    now = latest(d.where("file_id IS NOT NULL"), ["file_id", "line_no"], "landed_at", ["payload"])
    first = lambda *paths: F.coalesce(*[F.get_json_object("payload", p) for p in paths])
    tokens = T.token_count(first("$.metrics.tokens_prompt", "$.metrics.prompt_tokens", "$.tokens_prompt", "$.prompt_tokens"))
    return now.select("file_id", "line_no", tokens.alias("tokens"), T.cost(first("$.metrics.cost_usd", "$.cost_usd")).alias("cost")).where("tokens IS NOT NULL OR cost IS NOT NULL")


def suite_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = K.plan_writes(spark, sf_dir).select("plan", "path").distinct()
    end = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    n = lambda *ends: F.count_if(end.isin(*ends)).alias(ends[0])
    # only the few names that settle a language are collected
    built = F.collect_set(F.when(F.col("path").isin(*T.JAVA_BUILDS, *T.TYPESCRIPT_BUILDS, "pyproject.toml", "package.json"), F.col("path"))).alias("names")
    g = w.groupBy("plan").agg(n("java"), n("py"), n("ts", "tsx"), n("js", "jsx"), built)
    return g.select("plan", T.language(F.col("java"), F.col("py"), F.col("ts"), F.col("js"), F.col("names")).alias("language"))


def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that the code in all texts imports."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(code.imports(F.col("text"))).alias("specifier"))
    return d.where("specifier <> ''").groupBy("specifier").agg(F.count(F.lit(1)).alias("documents"))


def review_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer sees of each text: its first 700 characters (by md5) and 8 of its definitions."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(F.substring("text", 1, 700)).alias("snippet"), F.array_join(F.slice(F.array_sort(code.definitions(F.col("text"))), 1, 8), ",").alias("symbols"))


def patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply with a patch envelope for every contract, taken apart again."""
    t = K.tasks(spark, sf_dir).where("allowed_paths IS NOT NULL")
    verb = F.expr("transform(filter(allowed_paths, p -> p is not null and trim(p) <> ''), (p, i) -> concat('*** ', element_at(array('Add', 'Update', 'Delete'), cast(i % 3 + 1 as int)), ' File: ', p, '\n+line ', i, '\n'))")
    reply = F.concat(F.lit("Here it is:\n*** Begin Patch\n"), F.array_join(verb, ""), F.lit("*** End Patch\nDone."))
    ops = parsers.patch_operations(t.select("contract_id", reply.alias("reply")), "contract_id", "reply")
    return ops.select("contract_id", "place", "operation", "path", F.btrim("body", F.lit("\n")).alias("body"))


def log_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every suite's changed files as a log, read again as commits: files per commit and suite."""
    e = E.evals(spark, sf_dir).where("suite_name IS NOT NULL AND size(actual) > 0")
    lines = F.concat(F.array(F.lit("COMMIT")), "actual")
    log = e.select(F.concat_ws("/", "suite_name", F.col("run_id").cast("string")).alias("log"), "task_id", F.posexplode(lines).alias("pos", "line"))
    at = F.row_number().over(E.Window.partitionBy("log").orderBy("task_id", "pos"))
    c = parsers.commit_files(log.select("log", at.alias("line_no"), "line"), "log")
    return c.groupBy("log", "commit_no").agg(F.count(F.lit(1)).alias("files"))


def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's outcomes as verbose test output, read again and held against the tasks that ought
    to pass: all of the run's."""
    rows = read(spark, sf_dir, "eval_tasks").where("run_id IS NOT NULL AND task_id IS NOT NULL")
    now = Stages(spark, "results").put(latest(rows, ["run_id", "task_id"], "ingested_at", ["finished_at", "status"]).select("run_id", "task_id", "status"), "now")
    word = F.when(F.col("status") == "completed", "PASSED").otherwise("FAILED")
    out = now.select(F.col("run_id").alias("key"), F.concat(F.lit("tests/test_run.py::"), "task_id", F.lit("[case] "), word, F.lit("  [ 50%]")).alias("line")).withColumn("line_no", F.lit(1))
    required = now.select(F.col("run_id").alias("key"), F.lit("task").alias("kind"), F.concat(F.lit("Suite::"), "task_id").alias("node"))
    return parsers.required_passed(parsers.pytest_results(out, "key"), required).select(F.col("key").alias("run_id"), "required", "passed")


_RUNS = r"regexp_extract_all(text, '[\p{L}\p{N}_./-]+')"
_ENDS = "|".join(T.MENTIONED_ENDINGS)
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ingested_at DESC, finished_at DESC NULLS LAST, status DESC NULLS LAST) rn FROM eval_tasks WHERE run_id IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1"
QUERIES = {f.__name__: f for f in (file_mentions, text_flags, path_kinds, task_texts, path_lists, needle_paths, run_names, reported_numbers, suite_languages, code_imports, review_evidence, patch_files, log_commits, suite_results)}
SQL = {
    "file_mentions": rf"SELECT path, count(*) AS documents, min(doc_id) AS first_doc FROM (SELECT DISTINCT doc_id, trim(regexp_extract(r, '^(.+\.(?:{_ENDS}))', 1), './') AS path FROM (SELECT doc_id, unnest({_RUNS}) AS r FROM documents)) WHERE path <> '' GROUP BY path",
    "text_flags": rf"SELECT doc_id, regexp_matches(text, '(?i){T.DOCS_WORDS}') AS docs_task, regexp_matches(lower(text), 'test|spec|coverage|regression') AS test_task FROM documents WHERE text IS NOT NULL",
    "path_kinds": r"SELECT path, lower(path) IN ('readme.md', 'changelog.md', 'history.md') OR regexp_matches(lower(path), '(^|/)(docs|doc|documentation)(/|$)') AS is_docs, p <> '' AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS stays_inside FROM (SELECT DISTINCT path, replace(trim(path), '\', '/') AS p FROM predicted_writes WHERE path IS NOT NULL)",
    "task_texts": f"WITH tasks AS ({K.SQL_TASKS}) SELECT contract_id, md5(concat_ws(' ', task, suite_name, coalesce(array_to_string(allowed_paths, ' '), NULL))) AS text, coalesce(len(list_filter(flatten([string_split(lower(p), '/') for p in allowed_paths if p IS NOT NULL]), lambda s: s IN {T.TEST_HINTS})) > 0, false) AS hinted FROM tasks",
    "path_lists": f"WITH tasks AS ({K.SQL_TASKS}), u AS (SELECT contract_id, p, min(i) AS i FROM (SELECT contract_id, unnest(allowed_paths) AS p, generate_subscripts(allowed_paths, 1) AS i FROM tasks) WHERE p <> '' GROUP BY ALL), g AS (SELECT contract_id, string_agg(p, '|' ORDER BY i) AS o, string_agg(p, '|' ORDER BY p) AS s FROM u GROUP BY ALL) SELECT contract_id, CASE WHEN allowed_paths IS NOT NULL THEN coalesce(o, '') END AS in_order, coalesce(s, '') AS sorted FROM tasks LEFT JOIN g USING (contract_id)",
    "needle_paths": f"WITH writes AS ({K.SQL_WRITES}), h AS (SELECT suite_name, unnest(ns) AS needle, generate_subscripts(ns, 1) AS place FROM (SELECT suite_name, string_split(suite_name, '-') AS ns FROM (SELECT DISTINCT suite_name FROM runs WHERE suite_name IS NOT NULL))) SELECT suite_name, path, arg_min(lower(needle), place) AS needle FROM h, (SELECT DISTINCT path FROM writes) WHERE needle <> '' AND contains(lower(path), lower(needle)) GROUP BY ALL",
    "run_names": r"SELECT run_id, concat_ws('-', 'run', coalesce(backend, 'unknown'), nullif(replace(lower(trim(strategy, E' \t\r\n')), '-', '_'), ''), strftime(created_at AT TIME ZONE 'UTC', '%Y%m%d-%H%M%S')) AS name, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM runs WHERE created_at IS NOT NULL",
    "reported_numbers": """SELECT file_id, line_no, CASE WHEN t IS NOT NULL AND NOT isnan(t) THEN greatest(0, trunc(t)::BIGINT) END AS tokens, try_cast(ltrim(trim(c), '$') AS DOUBLE) AS cost FROM (SELECT file_id, line_no, try_cast(trim(coalesce(payload->>'$.metrics.tokens_prompt', payload->>'$.metrics.prompt_tokens', payload->>'$.tokens_prompt', payload->>'$.prompt_tokens')) AS DOUBLE) AS t, coalesce(payload->>'$.metrics.cost_usd', payload->>'$.cost_usd') AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line_no ORDER BY landed_at DESC NULLS LAST, payload DESC) rn FROM run_file_lines WHERE file_id IS NOT NULL AND payload IS NOT NULL) WHERE rn = 1 AND json_valid(payload)) WHERE tokens IS NOT NULL OR cost IS NOT NULL""",
    "suite_languages": f"WITH {K.SQL_PLAN}, c AS (SELECT plan, count(*) FILTER (e = 'java') AS j, count(*) FILTER (e = 'py') AS p, count(*) FILTER (e IN ('ts', 'tsx')) AS t, count(*) FILTER (e IN ('js', 'jsx')) AS s, list(path) AS names FROM (SELECT DISTINCT plan, path, regexp_extract(path, '\\.([a-z]+)$', 1) AS e FROM w) GROUP BY plan) SELECT plan, CASE WHEN len(list_intersect(names, ['pom.xml', 'build.gradle', 'build.gradle.kts'])) > 0 THEN 'java' WHEN len(list_intersect(names, ['tsconfig.json', 'next.config.ts', 'vite.config.ts'])) > 0 OR t > 0 THEN 'typescript' WHEN p > 0 AND (list_contains(names, 'pyproject.toml') OR p >= s) THEN 'python' WHEN s > 0 OR list_contains(names, 'package.json') THEN 'javascript' WHEN p > 0 THEN 'python' WHEN j > 0 THEN 'java' ELSE 'typescript' END AS language FROM c",
    "code_imports": r"""SELECT specifier, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:from|import|require\()\s*[''"]([^''"]+)[''"]', 1) || [coalesce(nullif(regexp_extract(m, 'from\s+([\w.]+)', 1), ''), regexp_extract(m, 'import\s+([\w.]+)', 1)) for m in regexp_extract_all(text, '(?m)^\s*(?:from\s+[\w.]+\s+import\b|import\s+[\w.]+)')]) AS specifier FROM documents) WHERE specifier <> '' GROUP BY specifier""",
    "review_evidence": f"SELECT doc_id, md5(substring(text, 1, 700)) AS snippet, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{code.DEFINITION}', 1)))[1:8], ',') AS symbols FROM documents WHERE text IS NOT NULL",
    "patch_files": f"WITH tasks AS ({K.SQL_TASKS}) SELECT contract_id, (i - 1)::INT AS place, ['add', 'update', 'delete'][(i - 1) % 3 + 1] AS operation, trim(p) AS path, '+line ' || (i - 1) AS body FROM (SELECT contract_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT contract_id, list_filter(allowed_paths, lambda p: p IS NOT NULL AND trim(p) <> '') AS ps FROM tasks))",
    "log_commits": f"{E.SQL_EVALS} SELECT suite_name || '/' || run_id AS log, row_number() OVER (PARTITION BY suite_name, run_id ORDER BY task_id) AS commit_no, len(actual) AS files FROM ev WHERE suite_name IS NOT NULL AND len(actual) > 0",
    "suite_results": f"SELECT run_id, count(*) AS required, count(*) FILTER (status = 'completed') AS passed FROM ({_LAST}) GROUP BY run_id",
}
