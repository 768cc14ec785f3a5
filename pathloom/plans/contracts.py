"""Queries over contracts, predicted writes and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import paths as P
from pathloom.operators import conflicts as C
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans.tables import read

ROOT = "/work/checkout"

# SQL of the pieces that several queries share
SQL_TASKS = "SELECT contract_id, suite_name, lower(trim(task_id, ' \t\r\n')) AS task, allowed_paths FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY landed_at DESC) rn FROM contracts WHERE contract_id IS NOT NULL) WHERE rn = 1"
SQL_SEGMENTS = "list_filter(string_split(replace({p}, '\\', '/'), '/'), lambda s: s NOT IN ('', '.'))"
SQL_CLEAN = """nullif(array_to_string(list_reduce(list_prepend([]::VARCHAR[], [[s] for s in string_split(replace(trim({p}, ' \t'), '\\', '/'), '/') if s not in ('', '.')]), lambda a, s: CASE WHEN s[1] = '..' THEN a[:len(a)-1] ELSE a || s END), '/'), '')"""
SQL_WRITES = f"""SELECT * FROM (SELECT lower(trim(task_id, ' \t\r\n')) AS task, {SQL_CLEAN.format(p='path')} AS path, max(confidence) AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY landed_at DESC) rn FROM predicted_writes WHERE write_id IS NOT NULL)
  WHERE rn = 1 AND confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) GROUP BY ALL) WHERE path IS NOT NULL AND task IS NOT NULL"""
#: Tasks of a suite and the paths they are predicted to write; contracts with the same task id share writes.
SQL_PLAN = f"""tasks AS ({SQL_TASKS}), writes AS ({SQL_WRITES}), w AS (SELECT t.suite_name AS plan, t.contract_id AS task, w.path, w.confidence FROM tasks t JOIN writes w USING (task) WHERE t.suite_name IS NOT NULL)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract_id, suite_name, task, allowed_paths): contracts, latest by contract_id."""
    rows = read(spark, sf_dir, "contracts").where("contract_id IS NOT NULL").select("contract_id", "suite_name", "task_id", "allowed_paths", "landed_at")
    return latest(rows, ["contract_id"], "landed_at", ["task_id"]).select("contract_id", "suite_name", F.lower(F.btrim("task_id", F.lit(" \t\r\n"))).alias("task"), "allowed_paths")


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, path, confidence): predicted writes, latest by write_id, clean, with the highest confidence."""
    rows = read(spark, sf_dir, "predicted_writes").where("write_id IS NOT NULL").select("write_id", "task_id", "path", "confidence", "landed_at")
    now = latest(rows, ["write_id"], "landed_at", ["confidence", "path"])
    good = now.where("confidence BETWEEN 0 AND 1").select(F.lower(F.btrim("task_id", F.lit(" \t\r\n"))).alias("task"), P.clean_path(F.col("path")).alias("path"), "confidence")
    return good.dropna(subset=["task", "path"]).groupBy("task", "path").agg(F.max("confidence").alias("confidence"))


def plan_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, task, path, confidence): suites as plans, contracts as tasks."""
    t = tasks(spark, sf_dir).where("suite_name IS NOT NULL").select(F.col("suite_name").alias("plan"), F.col("contract_id").alias("id"), "task")
    return Stages(spark, "plan").put(t.join(writes(spark, sf_dir), "task").select("plan", F.col("id").alias("task"), "path", "confidence"), "writes")


def conflict_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflict_edges(plan_writes(spark, sf_dir)).select("plan", "predecessor", "successor", F.array_join("files", ",").alias("files"))


def conflict_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflict_degrees(C.sharing_pairs(plan_writes(spark, sf_dir)))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sharing_pairs(plan_writes(spark, sf_dir)).groupBy("plan").agg(F.count(F.lit(1)).alias("pairs"))


def overlap_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.peers(plan_writes(spark, sf_dir))
    return p.select("plan", "task", F.size("peers").alias("peers"), F.array_join(F.transform("peers", lambda x: x.cast("string")), ",").alias("ids"))


def ownership_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.burden(plan_writes(spark, sf_dir))


def naive_vs_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to files that more than one task owns, and simulated minutes: all tasks at once and
    then resolving, or group after group of 4 + (n - 1)."""
    w = plan_writes(spark, sf_dir)
    owners = w.groupBy("plan", "path").agg(F.count_distinct("task").alias("owners"))
    naive = owners.groupBy("plan").agg(F.sum(F.when(F.col("owners") > 1, F.col("owners")).otherwise(0)).alias("overlapping_writes"), F.count_if(F.col("owners") > 1).alias("shared_files"))
    g = C.groups(plan_levels(spark, sf_dir))
    minutes = g.groupBy("plan").agg(F.sum(4 + F.greatest(F.size("tasks") - 1, F.lit(0))).cast("long").alias("planned_minutes"))
    return naive.join(minutes, "plan")


def plan_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = plan_writes(spark, sf_dir)
    return C.plan_levels(w.select("plan", "task").distinct(), C.conflict_order(w))


def plan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.groups(plan_levels(spark, sf_dir))
    return g.select("plan", "group_id", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks"), "type", F.array_join(F.transform("waits_for", lambda x: x.cast("string")), ",").alias("waits_for"))


def concurrent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = plan_writes(spark, sf_dir)
    order = w.select("plan", "task").distinct().withColumn("place", F.row_number().over(Window.partitionBy("plan").orderBy("task")) - 1)
    return C.concurrent_pairs(order, C.sharing_pairs(w), [2, 4, 8, 16])


def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read(spark, sf_dir, "predicted_writes").select("path").where("path IS NOT NULL").distinct()
    n = raw.withColumn("n", P.lexical_path(F.col("path")))
    return n.select("path", F.col("n.path").alias("normalized"), F.col("n.escapes").alias("escapes"))


def write_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second path (by length) as an absolute one, relative to the root again."""
    raw = read(spark, sf_dir, "predicted_writes").select("path").where("path IS NOT NULL").distinct()
    given = raw.select(F.when(F.length("path") % 2 == 0, F.concat(F.lit(f"{ROOT}/"), F.col("path"))).when(F.length("path") % 3 == 0, F.concat(F.lit("/elsewhere/"), F.col("path"))).otherwise(F.col("path")).alias("given"))
    n = given.withColumn("n", P.write_path(F.col("given"), F.lit(ROOT)))
    return n.select("given", F.col("n.path").alias("relative"), F.col("n.reason").alias("reason"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicted write of a task against each of its contract's patterns."""
    t = tasks(spark, sf_dir).select("contract_id", "task", F.explode_outer("allowed_paths").alias("pattern"))
    return t.join(writes(spark, sf_dir), "task")


def allow_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(P.glob_matches(F.col("pattern"), F.col("path")), F.lit(False))
    return _asked(spark, sf_dir).groupBy("contract_id", "path").agg(F.bool_or(hit).alias("allowed"))


def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allow_verdicts(spark, sf_dir).groupBy("contract_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


def verdict_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of single checks: 0 allowed, 2 blocked, 1 for a task without contract."""
    w = writes(spark, sf_dir).withColumn("known", F.lit(True))
    v = allow_verdicts(spark, sf_dir).join(tasks(spark, sf_dir).select("contract_id", "task"), "contract_id").groupBy("task", "path").agg(F.bool_or("allowed").alias("allowed"))
    return w.join(v, ["task", "path"], "left").select("task", "path", F.when(F.col("allowed").isNull(), 1).when(F.col("allowed"), 0).otherwise(2).alias("code"))


def glob_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tasks(spark, sf_dir).select(F.explode("allowed_paths").alias("pattern")).where("pattern IS NOT NULL")
    return p.groupBy(P.glob_kind(F.col("pattern")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pattern").alias("patterns"))


def plain_glob_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.coalesce(P.plain_glob_matches(F.col("pattern"), F.col("path")), F.lit(False))
    return _asked(spark, sf_dir).groupBy("contract_id", "path").agg(F.bool_or(hit).alias("allowed"))


def broaden_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = writes(spark, sf_dir).withColumn("pattern", P.broadened(F.col("path"), F.col("confidence")))
    return w.groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("pattern")), "|").alias("patterns"))


def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = writes(spark, sf_dir).select("path").distinct()
    c = F.col("path")
    return p.select("path", P.in_test_folder(c).alias("in_test_folder"), P.mentions_test(c).alias("mentions_test"), P.is_config(c).alias("is_config"))


def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of all predicted paths, whose service folders stand for an app's."""
    p = writes(spark, sf_dir).select(F.regexp_replace("path", "^(services|internal)/[^/]+", "app").alias("path")).distinct()
    r = p.withColumn("r", P.route(F.col("path"))).where("r IS NOT NULL")
    return r.select("path", F.col("r.kind").alias("kind"), F.col("r.route").alias("route"))


_PAIRS = f"WITH {SQL_PLAN}, pairs AS (SELECT a.plan, a.task AS i, b.task AS j, list(DISTINCT a.path ORDER BY a.path) AS files FROM w a JOIN w b USING (plan, path) WHERE a.task < b.task GROUP BY ALL), deg AS (SELECT plan, task, count(*) AS degree FROM (SELECT plan, i AS task FROM pairs UNION ALL SELECT plan, j FROM pairs) GROUP BY ALL), edges AS (SELECT p.plan, CASE WHEN a.degree <= b.degree THEN i ELSE j END AS predecessor, CASE WHEN a.degree <= b.degree THEN j ELSE i END AS successor, files FROM pairs p JOIN deg a ON a.plan = p.plan AND a.task = p.i JOIN deg b ON b.plan = p.plan AND b.task = p.j)"
_LEVELS = f"{_PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, nodes AS (SELECT DISTINCT plan, task FROM w), walk AS (SELECT plan, task, 0 AS level FROM nodes UNION SELECT e.plan, e.successor, k.level + 1 FROM walk k JOIN edges e ON e.plan = k.plan AND e.predecessor = k.task), levels AS (SELECT plan, task, max(level)::INT AS level FROM walk GROUP BY ALL), grp AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY level) AS group_id FROM (SELECT plan, level, list(task ORDER BY task) AS tasks FROM levels GROUP BY plan, level))"
_GLOB = r"""CASE WHEN ends_with(p, '/**') THEN c = p[:length(p)-3] OR starts_with(c, p[:length(p)-3] || '/')
  WHEN contains(p, '**') THEN regexp_matches(c, (CASE WHEN trim(string_split(p, '**')[1], '/') <> '' THEN '^' ELSE '' END) || array_to_string([regexp_escape(trim(s, '/')) for s in string_split(p, '**') if trim(s, '/') <> ''], '.*'), 's')
  WHEN regexp_matches(p, '[*?\[]') THEN c GLOB p ELSE c = p END"""
_ASKED = f"WITH tasks AS ({SQL_TASKS}), writes AS ({SQL_WRITES}), asked AS (SELECT t.contract_id, t.task, w.path, x.pattern, ltrim(x.pattern, './') AS p, ltrim(w.path, './') AS c FROM (SELECT contract_id, task, unnest(CASE WHEN len(allowed_paths) > 0 THEN allowed_paths ELSE [NULL] END) AS pattern FROM tasks) x JOIN tasks t USING (contract_id) JOIN writes w ON w.task = t.task), verdicts AS (SELECT contract_id, path, bool_or(coalesce({_GLOB}, false)) AS allowed FROM asked GROUP BY ALL)"
_NORM = f"SELECT path, escapes, CASE WHEN NOT escapes THEN coalesce({SQL_CLEAN.replace("trim({p}, ' " + chr(9) + "')", '{p}').format(p='path')}, '') END AS normalized FROM (SELECT path, coalesce((SELECT min(d) < 0 FROM (SELECT sum(CASE WHEN s = '..' THEN -1 ELSE 1 END) OVER (ORDER BY i) AS d FROM (SELECT unnest(segs) AS s, generate_subscripts(segs, 1) AS i))), false) AS escapes FROM (SELECT path, {SQL_SEGMENTS.format(p='path')} AS segs FROM {{src}}))"

QUERIES = {f.__name__: f for f in (conflict_edges, conflict_degree, overlap_pairs, overlap_peers, ownership_burden, naive_vs_planned, plan_levels, plan_groups, concurrent_pairs, normalize_paths, write_paths, allow_verdicts, verdict_summary, verdict_codes, glob_kinds, plain_glob_verdicts, broaden_paths, path_flags, route_rows)}
SQL = {
    "conflict_edges": f"{_PAIRS} SELECT plan, predecessor, successor, array_to_string(files, ',') AS files FROM edges",
    "conflict_degree": f"{_PAIRS} SELECT plan, task, degree FROM deg",
    "overlap_pairs": f"{_PAIRS} SELECT plan, count(*) AS pairs FROM pairs GROUP BY plan",
    "overlap_peers": f"{_PAIRS}, ends AS (SELECT plan, i AS task, j AS peer FROM pairs UNION ALL SELECT plan, j, i FROM pairs) SELECT n.plan, n.task, count(e.peer)::INT AS peers, coalesce(string_agg(e.peer::VARCHAR, ',' ORDER BY e.peer), '') AS ids FROM (SELECT DISTINCT plan, task FROM w) n LEFT JOIN ends e ON e.plan = n.plan AND e.task = n.task GROUP BY ALL",
    "ownership_burden": f"WITH {SQL_PLAN} SELECT plan, sum(n)::BIGINT AS mentions, count(*) AS unique_files, (sum(n) - count(*))::BIGINT AS duplicates, count(*) FILTER (n >= 2) AS overlapping_files FROM (SELECT plan, path, count(*) AS n FROM w GROUP BY ALL) GROUP BY plan",
    "naive_vs_planned": f"{_LEVELS} SELECT o.plan, o.overlapping_writes, o.shared_files, m.planned_minutes FROM (SELECT plan, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS overlapping_writes, count(*) FILTER (n > 1) AS shared_files FROM (SELECT plan, path, count(DISTINCT task) AS n FROM w GROUP BY ALL) GROUP BY plan) o JOIN (SELECT plan, sum(4 + greatest(len(tasks) - 1, 0))::BIGINT AS planned_minutes FROM grp GROUP BY plan) m USING (plan)",
    "plan_levels": f"{_LEVELS} SELECT plan, task, level FROM levels",
    "plan_groups": f"{_LEVELS} SELECT plan, group_id::INT AS group_id, array_to_string(tasks, ',') AS tasks, CASE WHEN len(tasks) > 1 OR level = 0 THEN 'parallel' ELSE 'serial' END AS type, CASE WHEN group_id > 1 THEN (group_id - 1)::VARCHAR ELSE '' END AS waits_for FROM grp",
    "concurrent_pairs": f"{_PAIRS}, o AS (SELECT plan, task, row_number() OVER (PARTITION BY plan ORDER BY task) - 1 AS place FROM (SELECT DISTINCT plan, task FROM w)) SELECT p.plan, s.parallelism, sum((a.place // s.parallelism = b.place // s.parallelism)::INT)::BIGINT AS pairs FROM pairs p JOIN o a ON a.plan = p.plan AND a.task = p.i JOIN o b ON b.plan = p.plan AND b.task = p.j, (SELECT unnest([2, 4, 8, 16]) AS parallelism) s GROUP BY ALL",
    "normalize_paths": _NORM.format(src="(SELECT DISTINCT path FROM predicted_writes WHERE path IS NOT NULL)"),
    "write_paths": f"WITH n AS ({_NORM.format(src=f'''(SELECT DISTINCT CASE WHEN length(path) % 2 = 0 THEN '{ROOT}/' || path WHEN length(path) % 3 = 0 THEN '/elsewhere/' || path ELSE path END AS path FROM predicted_writes WHERE path IS NOT NULL)''')}) SELECT path AS given, CASE WHEN NOT starts_with(path, '/') THEN normalized WHEN normalized = '{ROOT[1:]}' THEN '' WHEN starts_with(normalized, '{ROOT[1:]}/') THEN normalized[length('{ROOT}') + 1:] END AS relative, CASE WHEN escapes AND starts_with(path, '/') THEN 'escapes filesystem root' WHEN escapes THEN 'escapes repository root' WHEN starts_with(path, '/') AND normalized <> '{ROOT[1:]}' AND NOT starts_with(normalized, '{ROOT[1:]}/') THEN 'outside repo root' END AS reason FROM n",
    "allow_verdicts": f"{_ASKED} SELECT contract_id, path, allowed FROM verdicts",
    "verdict_summary": f"{_ASKED} SELECT contract_id, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS blocked FROM verdicts GROUP BY contract_id",
    "verdict_codes": f"{_ASKED}, v AS (SELECT t.task, v.path, bool_or(v.allowed) AS allowed FROM verdicts v JOIN tasks t USING (contract_id) GROUP BY ALL) SELECT w.task, w.path, CASE WHEN v.allowed IS NULL THEN 1 WHEN v.allowed THEN 0 ELSE 2 END AS code FROM writes w LEFT JOIN v ON v.task = w.task AND v.path = w.path",
    "glob_kinds": f"WITH tasks AS ({SQL_TASKS}), p AS (SELECT pattern, ltrim(pattern, './') AS p FROM (SELECT unnest(allowed_paths) AS pattern FROM tasks) WHERE pattern IS NOT NULL) SELECT CASE WHEN ends_with(p, '/**') THEN 'subtree' WHEN contains(p, '**') THEN 'ordered' WHEN regexp_matches(p, '[*?\\[]') THEN 'wildcard' ELSE 'exact' END AS kind, count(*) AS n, count(DISTINCT pattern) AS patterns FROM p GROUP BY ALL",
    "plain_glob_verdicts": f"{_ASKED} SELECT contract_id, path, bool_or(coalesce(path = pattern OR (regexp_matches(pattern, '[*?\\[]') AND path GLOB pattern), false)) AS allowed FROM asked GROUP BY ALL",
    "broaden_paths": f"WITH writes AS ({SQL_WRITES}) SELECT task, array_to_string(list(DISTINCT pattern ORDER BY pattern), '|') AS patterns FROM (SELECT task, CASE WHEN confidence >= 0.7 AND len(string_split(path, '/')) >= CASE WHEN regexp_matches(path, '^(tests/|__tests__/|cypress/|e2e/|spec/)') THEN 3 ELSE 4 END THEN regexp_replace(path, '/[^/]*$', '/**') ELSE path END AS pattern FROM writes) GROUP BY task",
    "path_flags": rf"WITH writes AS ({SQL_WRITES}) SELECT path, len(list_intersect(string_split(path, '/'), ['__tests__', 'cypress', 'e2e', 'spec', 'test', 'tests'])) > 0 OR starts_with(path, 'src/test/java/') OR regexp_matches(path, '\.(cy|spec|test)\.(js|jsx|ts|tsx)$') AS in_test_folder, regexp_matches(path, '^(test|tests|__tests__|cypress|e2e)/') OR len(list_intersect(string_split(path, '/'), ['test', 'tests', '__tests__'])) > 0 OR regexp_matches(path, '\.(test|spec|test-d)\.') AS mentions_test, string_split(path, '/')[-1] IN {P.CONFIG_NAMES} OR path IN {P.SCHEMA_FILES} OR starts_with(string_split(path, '/')[-1], '.env') OR regexp_matches(path, '(\.config\.(cjs|js|mjs|ts)|\.schema\.json|\.prisma)$') AS is_config FROM (SELECT DISTINCT path FROM writes)",
    "route_rows": f"WITH writes AS ({SQL_WRITES}), p AS (SELECT DISTINCT regexp_replace(path, '^(services|internal)/[^/]+', 'app') AS path FROM writes), s AS (SELECT path, string_split(path, '/') AS parts, string_split(string_split(path, '/')[-1], '.')[1] AS stem, CASE WHEN starts_with(path, 'app/') THEN 1 WHEN starts_with(path, 'src/app/') THEN 2 END AS app FROM p) SELECT path, CASE WHEN stem NOT IN ('layout', 'page', 'route') THEN 'spring_controller' WHEN stem = 'route' AND parts[app + 1] = 'api' AND len(parts) > app + 1 THEN 'api' ELSE stem END AS kind, CASE WHEN stem IN ('layout', 'page', 'route') THEN '/' || array_to_string(parts[app + 1:len(parts) - 1], '/') END AS route FROM s WHERE (stem IN ('layout', 'page', 'route') AND app IS NOT NULL) OR (stem NOT IN ('layout', 'page', 'route') AND ends_with(path, 'Controller.java'))",
}
