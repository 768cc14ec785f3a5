"""Queries over execution plans: conflicts, tests that run last and declared dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path_set, in_test_folder
from pathloom.operators import conflicts as C
from pathloom.operators import cycles as Y
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans.tables import read

#: The share of a task's predicted paths that are tests from which the task itself runs last.
LAST_SHARE = 0.2


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "contracts").where("contract_id IS NOT NULL").select("contract_id", "suite_name", "task_id", "depends_on", "candidate_context_paths", "landed_at")
    return latest(rows, ["contract_id"], "landed_at", ["task_id"]).where("suite_name IS NOT NULL")


def _name(c: str):
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def _tasks(writes: DataFrame) -> DataFrame:
    """(plan, task, last): tests run last."""
    tests = F.count_if(in_test_folder(F.col("path"))) >= F.count(F.lit(1)) * LAST_SHARE
    return writes.groupBy("plan", "task").agg(tests.alias("last"))


def _declared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = Stages(spark, "declared").put(_contracts(spark, sf_dir).select(F.col("suite_name").alias("plan"), F.col("contract_id").alias("task"), _name("task_id").alias("name"), "depends_on"), "contracts")
    wanted = c.select("plan", "task", F.explode("depends_on").alias("d")).select("plan", "task", _name("d").alias("name"))
    return Y.declared_edges(wanted, c.select("plan", "task", "name"))


def _ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tasks, edges, tasks on a cycle and unknown names."""
    stages = Stages(spark, "schedule")
    w = K.plan_writes(spark, sf_dir)
    tasks = stages.put(_tasks(w), "tasks")
    declared, unknown = _declared(spark, sf_dir)
    known = tasks.select("plan", "task")
    declared = declared.join(known.withColumnRenamed("task", "src"), ["plan", "src"], "left_semi").join(known.withColumnRenamed("task", "dst"), ["plan", "dst"], "left_semi")
    edges = stages.put(Y.task_order(tasks, C.conflict_order(w), declared.select("plan", "src", "dst")), "edges")
    cyclic = stages.put(Y.strong_components(edges.select("plan", "src", "dst")).where("node >= 0"), "cyclic")
    return tasks, edges, cyclic, unknown


def collapsed_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all tasks but those that declared dependencies put on a cycle (see ``plan_faults``)."""
    tasks, edges, cyclic, _ = _ordered(spark, sf_dir)
    bad = cyclic.select("plan", "node")
    good = edges.join(bad.withColumnRenamed("node", "src"), ["plan", "src"], "left_anti").join(bad.withColumnRenamed("node", "dst"), ["plan", "dst"], "left_anti")
    return C.plan_levels(tasks.select("plan", "task").join(bad.withColumnRenamed("node", "task"), ["plan", "task"], "left_anti"), good)


def plan_groups_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.groups(collapsed_levels(spark, sf_dir))
    return g.select("plan", "group_id", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks"), "type")


def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, task, fault): dependencies on unknown names, and tasks on cycles through declared ones."""
    _, _, cyclic, unknown = _ordered(spark, sf_dir)
    return unknown.select("plan", "task", F.concat(F.lit("unknown "), "name").alias("fault")).unionByName(cyclic.select("plan", F.col("node").alias("task"), F.lit("cycle").alias("fault")))


def promoted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a plan rebuilt after every contract's first candidate path, by code point, was
    granted for writing; conflicts and declared dependencies count, "tests last" no more."""
    c = _contracts(spark, sf_dir).select(F.col("suite_name").alias("plan"), F.col("contract_id").alias("task"), F.array_sort(clean_path_set(F.col("candidate_context_paths"))).alias("p"))
    granted = c.where(F.size("p") > 0).select("plan", "task", F.get("p", 0).alias("path"))
    w = Stages(spark, "promoted").put(K.plan_writes(spark, sf_dir).select("plan", "task", "path").unionByName(granted).distinct(), "writes")
    tasks = w.select("plan", "task").distinct()
    return C.plan_levels(tasks, C.conflict_order(w))


def planned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan and parallelism: conflicting pairs that run together if groups run one after the
    other and each in batches; as tasks of a group share nothing, none should."""
    w = K.plan_writes(spark, sf_dir)
    levels = Stages(spark, "levels").put(C.plan_levels(w.select("plan", "task").distinct(), C.conflict_order(w)), "levels")
    order = levels.withColumn("place", F.row_number().over(Window.partitionBy("plan", "level").orderBy("task")) - 1)
    a = order.select("plan", F.col("task").alias("i"), F.col("level").alias("li"), F.col("place").alias("pi"))
    b = order.select("plan", F.col("task").alias("j"), F.col("level").alias("lj"), F.col("place").alias("pj"))
    met = C.sharing_pairs(w).select("plan", "i", "j").join(a, ["plan", "i"]).join(b, ["plan", "j"])
    sizes = [F.struct(F.lit(n).alias("parallelism"), ((F.col("li") == F.col("lj")) & (F.floor(F.col("pi") / n) == F.floor(F.col("pj") / n))).cast("long").alias("hit")) for n in (2, 4, 8, 16)]
    return met.select("plan", F.explode(F.array(*sizes)).alias("s")).groupBy("plan", "s.parallelism").agg(F.sum("s.hit").alias("pairs"))


_IN_TESTS = r"len(list_intersect(string_split(path, '/'), ['__tests__', 'cypress', 'e2e', 'spec', 'test', 'tests'])) > 0 OR starts_with(path, 'src/test/java/') OR regexp_matches(path, '\.(cy|spec|test)\.(js|jsx|ts|tsx)$')"
_CONTRACTS = "SELECT suite_name AS plan, contract_id AS task, lower(trim(task_id, ' \t\r\n')) AS name, depends_on, candidate_context_paths FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY landed_at DESC) rn FROM contracts WHERE contract_id IS NOT NULL) WHERE rn = 1 AND suite_name IS NOT NULL"
_ORDER = f"""{K._PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, nodes AS (SELECT plan, task, count(*) FILTER ({_IN_TESTS}) >= count(*) * {LAST_SHARE} AS last FROM w GROUP BY ALL),
cts AS MATERIALIZED ({_CONTRACTS}), wanted AS (SELECT plan, task, lower(trim(d, ' \t\r\n')) AS name FROM (SELECT plan, task, unnest(depends_on) AS d FROM cts) WHERE d IS NOT NULL),
declared AS (SELECT DISTINCT x.plan, c.task AS src, x.task AS dst FROM wanted x JOIN cts c ON c.plan = x.plan AND c.name = x.name JOIN nodes a ON a.plan = x.plan AND a.task = c.task JOIN nodes b ON b.plan = x.plan AND b.task = x.task),
soft AS MATERIALIZED (SELECT plan, predecessor AS src, successor AS dst FROM edges UNION SELECT a.plan, a.task, b.task FROM nodes a JOIN nodes b USING (plan) WHERE NOT a.last AND b.last),
reach AS (SELECT plan, src, dst FROM soft UNION SELECT r.plan, r.src, s.dst FROM reach r JOIN soft s ON s.plan = r.plan AND s.src = r.dst),
comp AS MATERIALIZED (SELECT a.plan, a.src AS node, max(a.dst) AS scc FROM reach a JOIN reach b ON b.plan = a.plan AND b.src = a.dst AND b.dst = a.src GROUP BY ALL),
hard AS MATERIALIZED (SELECT s.plan, s.src, s.dst FROM soft s LEFT JOIN comp a ON a.plan = s.plan AND a.node = s.src LEFT JOIN comp b ON b.plan = s.plan AND b.node = s.dst WHERE a.scc IS NULL OR b.scc IS NULL OR a.scc <> b.scc
  UNION SELECT plan, node, nxt FROM (SELECT *, lead(node) OVER (PARTITION BY plan, scc ORDER BY node) AS nxt FROM comp) WHERE nxt IS NOT NULL UNION SELECT plan, src, dst FROM declared),
reach2 AS (SELECT plan, src, dst FROM hard UNION SELECT r.plan, r.src, s.dst FROM reach2 r JOIN hard s ON s.plan = r.plan AND s.src = r.dst),
cyclic AS MATERIALIZED (SELECT DISTINCT plan, src AS task FROM reach2 WHERE src = dst),
sound AS MATERIALIZED (SELECT h.* FROM hard h ANTI JOIN cyclic c ON c.plan = h.plan AND c.task = h.src ANTI JOIN cyclic d ON d.plan = h.plan AND d.task = h.dst),
walk2 AS (SELECT plan, task, 0 AS level FROM nodes ANTI JOIN cyclic USING (plan, task) UNION SELECT e.plan, e.dst, k.level + 1 FROM walk2 k JOIN sound e ON e.plan = k.plan AND e.src = k.task),
lv AS (SELECT plan, task, max(level)::INT AS level FROM walk2 GROUP BY ALL)"""
_PROMOTED = f"""WITH RECURSIVE {K.SQL_PLAN.replace('w AS (', 'w0 AS (')}, cts AS ({_CONTRACTS}), granted AS (SELECT plan, task, min(path) AS path FROM (SELECT plan, task, {K.SQL_CLEAN.format(p='x')} AS path FROM (SELECT plan, task, unnest(candidate_context_paths) AS x FROM cts) WHERE x IS NOT NULL) WHERE path IS NOT NULL GROUP BY ALL), w AS MATERIALIZED (SELECT plan, task, path FROM w0 UNION SELECT plan, task, path FROM granted)"""
QUERIES = {f.__name__: f for f in (collapsed_levels, plan_groups_explicit, plan_faults, promoted_levels, planned_pairs)}
SQL = {
    "collapsed_levels": f"{_ORDER} SELECT plan, task, level FROM lv",
    "plan_groups_explicit": f"{_ORDER} SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY level)::INT AS group_id, array_to_string(tasks, ',') AS tasks, CASE WHEN len(tasks) > 1 OR level = 0 THEN 'parallel' ELSE 'serial' END AS type FROM (SELECT plan, level, list(task ORDER BY task) AS tasks FROM lv GROUP BY ALL)",
    "plan_faults": f"{_ORDER} SELECT plan, task, 'unknown ' || name AS fault FROM wanted x WHERE NOT EXISTS (SELECT 1 FROM cts c WHERE c.plan = x.plan AND c.name = x.name) UNION ALL SELECT plan, task, 'cycle' FROM cyclic",
    "promoted_levels": f"{_PROMOTED}{K._LEVELS[K._LEVELS.index(', pairs AS'):]} SELECT plan, task, level FROM levels",
    "planned_pairs": f"{K._LEVELS}, o AS (SELECT *, row_number() OVER (PARTITION BY plan, level ORDER BY task) - 1 AS place FROM levels) SELECT p.plan, s.parallelism, sum((a.level = b.level AND a.place // s.parallelism = b.place // s.parallelism)::INT)::BIGINT AS pairs FROM pairs p JOIN o a ON a.plan = p.plan AND a.task = p.i JOIN o b ON b.plan = p.plan AND b.task = p.j, (SELECT unnest([2, 4, 8, 16]) AS parallelism) s GROUP BY ALL",
}
