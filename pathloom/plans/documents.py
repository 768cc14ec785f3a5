"""Flat tables of eval_run and agent_lock documents (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.latest import latest
from pathloom.plans.tables import read
from pathloom.sources.nested import NestedTables

#: Fields whose object may file members by name, and the keys of a lone member.
MAPS = {"strategies": ("tasks", "strategy", "backend"), "tasks": ("task_id", "id", "status", "prompt", "metrics", "artifacts", "file_scopes")}


def nested_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, NestedTables]:
    """The documents, latest by raw_id, and their objects."""
    raw = read(spark, sf_dir, "raw_documents").where("raw_id IS NOT NULL")
    documents = latest(raw, ["raw_id"], "landed_at", ["body"])
    return documents, NestedTables(documents, "raw_id", "body", MAPS)


def p6_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """runs, tasks, metrics, artifacts and scopes, each row with its key (raw_id, occ) and the
    ``occ`` of its parent."""
    _, n = nested_tables(spark, sf_dir)
    run = {"strategy": "strategy", "backend": "backend", "run_id": "run_id"}
    filed = n.table("strategies", run)
    # a document whose tasks are its own is a run
    own = n.bridge.where("field = 'tasks' AND parent = 0").select("doc_id").distinct()
    alone = n.table("", run).join(own, "doc_id", "left_semi")
    runs = filed.unionByName(alone.select(*filed.columns)).withColumn("run_key", F.coalesce("strategy", "name", F.lit("")))
    tasks = n.table("tasks", {"task_id": "task_id", "id": "id", "status": "status", "prompt": "prompt"}).withColumn("task_key", F.coalesce("task_id", "id", "name"))
    return {
        "runs": runs,
        "tasks": tasks,
        "metrics": n.table("metrics", {"tokens_prompt": "tokens_prompt", "wall_time_seconds": "wall_time_seconds", "model_calls": "model_calls"}),
        "artifacts": n.table("artifacts", {"diff_path": "diff_path", "branch": "branch", "log_path": "log_path"}),
        "scopes": n.table("file_scopes", {"tier": "tier", "path": "path", "score": "score"}),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that hold a prompt token count, a diff path or a tier, with their run and task."""
    t = p6_tables(spark, sf_dir)
    runs = t["runs"].select("doc_id", F.col("occ").alias("run_occ"), "run_key")
    tasks = t["tasks"].select("doc_id", F.col("occ").alias("task_occ"), F.col("parent").alias("run_occ"), F.col("task_key").alias("task_id"))
    placed = tasks.join(runs, ["doc_id", "run_occ"], "left")
    wanted = (("metrics", "tokens_prompt"), ("artifacts", "diff_path"), ("scopes", "tier"))
    parts = [
        t[name].where(F.col(c).isNotNull() & (F.col(c) != "")).select("doc_id", F.col("parent").alias("task_occ"), F.lit(f"{'file_scopes' if name == 'scopes' else name}.{c}").alias("field_name"), F.col("ordinal").alias("item_no"))
        for name, c in wanted
    ]
    values = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return values.join(placed, ["doc_id", "task_occ"]).select(F.col("doc_id").alias("raw_id"), F.coalesce("run_key", F.lit("")).alias("run_key"), "task_id", "field_name", "item_no")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each flat table, and how many of them hold a value of its main column."""
    t = p6_tables(spark, sf_dir)
    parts = [t[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count(F.nullif(F.col(c), F.lit(""))).alias("with_value")) for n, c in (("metrics", "tokens_prompt"), ("artifacts", "diff_path"), ("scopes", "tier"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field: occurrences of objects, and distinct objects that are stored for them."""
    _, n = nested_tables(spark, sf_dir)
    return n.bridge.groupBy("field").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("node").alias("objects"))


_PART = """SELECT raw_id, run_key, task_id, '{f}.{c}' AS field_name, i - 1 AS item_no FROM (SELECT raw_id, run_key, task_id, unnest(os) AS o, generate_subscripts(os, 1) AS i FROM (SELECT raw_id, run_key, task_id, CASE json_type(t->'{f}') WHEN 'ARRAY' THEN json_extract(t, '$.{f}[*]') WHEN 'OBJECT' THEN [t->'{f}'] ELSE [] END AS os FROM task)) WHERE json_type(o) = 'OBJECT' AND coalesce(o->>'{c}', '') <> ''"""
QUERIES = {"p6_found": p6_found, "p6_objects": p6_objects, "p6_rows": p6_rows}
_TASKS = """WITH d AS (SELECT raw_id, body::JSON AS b FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY landed_at DESC) rn FROM raw_documents WHERE raw_id IS NOT NULL) WHERE rn = 1 AND json_valid(body)),
n AS (SELECT raw_id, b, unnest(json_keys(b, '$.strategies')) AS name FROM d WHERE json_type(b->'strategies') = 'OBJECT'),
run AS (SELECT raw_id, coalesce(b->>'strategy', '') AS run_key, b->'tasks' AS ts FROM d WHERE json_exists(b, '$.tasks') UNION ALL SELECT raw_id, coalesce(r->>'strategy', name), r->'tasks' FROM (SELECT raw_id, name, json_extract(b, '$.strategies."' || name || '"') AS r FROM n)),
lone AS (SELECT *, json_exists(ts, '$.task_id') OR json_exists(ts, '$.id') AS lone FROM run WHERE json_type(ts) = 'OBJECT'),
filed AS (SELECT raw_id, run_key, ts, unnest(json_keys(ts)) AS name FROM lone WHERE NOT lone),
one AS (SELECT raw_id, run_key, NULL AS name, unnest(json_extract(ts, '$[*]')) AS t FROM run WHERE json_type(ts) = 'ARRAY' UNION ALL SELECT raw_id, run_key, NULL, ts FROM lone WHERE lone UNION ALL SELECT raw_id, run_key, name, json_extract(ts, '$."' || name || '"') FROM filed),
task AS (SELECT raw_id, run_key, coalesce(t->>'task_id', t->>'id', name) AS task_id, t FROM one WHERE json_type(t) = 'OBJECT')
"""
SQL = {
    "p6_found": _TASKS + " UNION ALL ".join(_PART.format(f=f, c=c) for f, c in (("metrics", "tokens_prompt"), ("artifacts", "diff_path"), ("file_scopes", "tier"))),
    "p6_rows": _TASKS
    + " UNION ALL ".join(
        _PART.format(f=f, c=c).replace("SELECT raw_id, run_key, task_id, '" + f + "." + c + "' AS field_name, i - 1 AS item_no FROM", f"SELECT '{n}' AS name, count(*) AS n, count(nullif(o->>'{c}', '')) AS with_value FROM", 1).replace(f" AND coalesce(o->>'{c}', '') <> ''", "")
        for n, f, c in (("metrics", "metrics", "tokens_prompt"), ("artifacts", "artifacts", "diff_path"), ("scopes", "file_scopes", "tier"))
    ),
}
