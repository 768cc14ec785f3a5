"""Queries of the problems tagged llm, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.text import plain_name
from pathloom.functions.paths import clean_path, clean_path_set
from pathloom.llm.cooccurrence import cooccurrence
from pathloom.llm.mixing import mix
from pathloom.llm.packing import pack_all
from pathloom.llm.percentiles import percentiles
from pathloom.llm.tables import latest_eval_tasks, plain_strategy, read
from pathloom.llm.tokens import with_tokens
from pathloom.llm.topn import top_n
from pathloom.llm.pii import find_personal, sanitise
from pathloom.llm.setjoin import similar_records, similar_sets
from pathloom.operators.latest import latest, latest_of_few_repeats
from pathloom.operators.staging import Stages, broadcast_if_small

def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with their size in tokens instead of their text."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", *columns, "text")
    return Stages(spark, "sized").put(with_tokens(docs, "text"), "documents")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # a table of a few capacities
    wanted = sorted((r["pack_name"], r["capacity_tokens"]) for r in read(spark, sf_dir, "pack_capacities").where("capacity_tokens > 0").collect())
    packed = pack_all(_sized(spark, sf_dir), "doc_id", "n_tokens", [c for _, c in wanted])
    plans, reports = ([p[i].select(F.lit(name).alias("pack_name"), "*") for (name, _), p in zip(wanted, packed)] for i in (0, 1))
    plan, report = plans[0], reports[0]
    for p, q in zip(plans[1:], reports[1:]):
        plan, report = plan.unionByName(p), report.unionByName(q)
    return plan, report


def p7_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents (or pieces of them) of every container, for each capacity."""
    return _packed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return _packed(spark, sf_dir)[1]


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, and what must not be: containers over it, documents whose pieces
    don't add up, pieces out of order, documents cut though they fit, and room left of more than one container and 5 percent."""
    sized = _sized(spark, sf_dir)
    wanted = sorted((r["pack_name"], r["capacity_tokens"]) for r in read(spark, sf_dir, "pack_capacities").where("capacity_tokens > 0").collect())
    out = None
    for (name, cap), (plan, report) in zip(wanted, pack_all(sized, "doc_id", "n_tokens", [c for _, c in wanted])):
        over = plan.groupBy("container_id").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > cap).alias("over_capacity"))
        d = plan.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("ends"), F.count_distinct("piece_no").alias("numbers"))
        d = d.join(sized.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "full")
        bad = d.agg(
            F.count("doc_id").alias("documents"),
            F.count_if(F.col("d").isNull() | F.col("doc_id").isNull() | (F.col("t") != F.col("n_tokens"))).alias("lost"),
            F.count_if((F.col("ends") != F.col("n_tokens")) | (F.col("numbers") != F.col("pieces"))).alias("disordered"),
            F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= cap)).alias("cut_though_small"),
        )
        row = bad.join(over).join(report.select((F.col("containers") * F.col("capacity") - F.col("tokens") > F.greatest(F.col("capacity"), 0.05 * F.col("containers") * F.col("capacity"))).alias("roomy"))).select(F.lit(name).alias("pack_name"), *bad.columns, "over_capacity", "roomy")
        out = row if out is None else out.unionByName(row)
    return out


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix: targets, and what must not be: sources off their share by more than two of their documents,
    documents drawn too often, places given twice."""
    draw, report = _mixed(spark, sf_dir)
    repeats = read(spark, sf_dir, "mix_targets").withColumn("source", plain_name(F.col("source"))).where("mix_name IS NOT NULL AND source IS NOT NULL").groupBy("mix_name", "source").agg(F.min("max_repeats").alias("r"))
    largest = draw.groupBy("mix_name", "source").agg(F.max("n_tokens").alias("largest"), F.sum("n_tokens").alias("tokens"))
    size = draw.groupBy("mix_name").agg(F.sum("n_tokens").alias("all"))
    off = report.select("mix_name", "source", "share").join(largest, ["mix_name", "source"], "left").join(size, "mix_name").groupBy("mix_name").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(F.abs(F.coalesce("tokens", F.lit(0)) - F.col("share") * F.col("all")) > 2 * F.coalesce("largest", F.lit(0)) + 1).alias("off_share")
    )
    often = draw.groupBy("mix_name", "source", "doc_id").agg(F.count(F.lit(1)).alias("n")).join(repeats, ["mix_name", "source"]).groupBy("mix_name").agg(F.count_if(F.col("n") > F.col("r")).alias("too_often"))
    twice = draw.groupBy("mix_name", "shard", "position").agg(F.count(F.lit(1)).alias("n")).groupBy("mix_name").agg(F.count_if(F.col("n") > 1).alias("same_place"))
    return off.join(often, "mix_name").join(twice, "mix_name")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(spark, sf_dir, "source").withColumn("source", plain_name(F.col("source")))
    sized = Stages(spark, "mixed").put(sized, "documents")
    mixes: dict[str, list[tuple[str, float, int]]] = {}
    # a table of a few targets
    for r in read(spark, sf_dir, "mix_targets").withColumn("source", plain_name(F.col("source"))).where("mix_name IS NOT NULL AND source IS NOT NULL").collect():
        mixes.setdefault(r["mix_name"], []).append((r["source"], r["target_share"], r["max_repeats"]))
    draws, reports = [], []
    for name in sorted(mixes):
        draw, report = mix(sized, "doc_id", "source", "n_tokens", mixes[name], seed=zlib.crc32(name.encode()))
        draws.append(draw.select(F.lit(name).alias("mix_name"), "*"))
        reports.append(report.select(F.lit(name).alias("mix_name"), "*"))
    draw, report = draws[0], reports[0]
    for d, r in zip(draws[1:], reports[1:]):
        draw, report = draw.unionByName(d), report.unionByName(r)
    return draw, report


def p8_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix, in order within its shards."""
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of each mix."""
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in all documents."""
    return find_personal(read(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), "doc_id", "text").select("doc_id", "kind", "start_char")


def p9_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with placeholders."""
    return sanitise(read(spark, sf_dir, "documents").where("doc_id IS NOT NULL"), "doc_id", "text")


CLEAN_SQL = """nullif(array_to_string(list_reduce(list_prepend([]::VARCHAR[], [[s] for s in string_split(replace(trim({p}, ' \t'), '\\', '/'), '/') if s not in ('', '.')]), lambda a, s: CASE WHEN s[1] = '..' THEN a[:len(a)-1] ELSE a || s END), '/'), '')"""
PLAIN_SQL = "nullif(replace(lower(trim({c}, ' \t\r\n')), '-', '_'), '')"


FIELDS_P1 = ("allowed_paths", "candidate_context_paths")


def p1_similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contracts = read(spark, sf_dir, "contracts").select("contract_id", "landed_at", *FIELDS_P1)
    now = latest(contracts.where("contract_id IS NOT NULL"), ["contract_id"], "landed_at", list(FIELDS_P1))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("paths")) for f in FIELDS_P1])
    long = now.select("contract_id", F.explode(fields).alias("f")).select("contract_id", "f.field_name", clean_path_set(F.col("f.paths")).alias("paths"))
    return similar_sets(long, "contract_id", "paths", 0.6, space="field_name", min_size=3)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of contracts with at least 0.6 of their paths in common."""
    pairs = similar_records(*p1_similar(spark, sf_dir))
    return pairs.select(F.col("space").alias("field_name"), F.col("a").alias("contract_a"), F.col("b").alias("contract_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contract and field: its class of equal lists and the number of similar classes."""
    members, links = p1_similar(spark, sf_dir)
    ends = links.select("space", F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("space", "class_id").agg(F.count(F.lit(1)).alias("links"))
    out = members.join(ends, ["space", "class_id"], "left")
    return out.select(F.col("space").alias("field_name"), F.col("rid").alias("contract_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


_P1_SETS = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY landed_at DESC) rn FROM contracts WHERE contract_id IS NOT NULL) WHERE rn = 1
), f AS (
  SELECT contract_id, 'allowed_paths' AS field_name, unnest(allowed_paths) AS p FROM latest
  UNION ALL SELECT contract_id, 'candidate_context_paths', unnest(candidate_context_paths) FROM latest
), e AS (SELECT DISTINCT field_name, contract_id, {CLEAN_SQL.format(p='p')} AS path FROM f WHERE p IS NOT NULL
), g AS (SELECT * FROM e WHERE path IS NOT NULL
), s AS (SELECT field_name, contract_id, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3
), x AS (
  SELECT a.field_name, a.contract_id AS contract_a, b.contract_id AS contract_b, count(*) AS c FROM g a JOIN g b USING (field_name, path) WHERE a.contract_id < b.contract_id GROUP BY ALL
), pairs AS (
  SELECT x.* FROM x JOIN s a ON a.field_name = x.field_name AND a.contract_id = x.contract_a JOIN s b ON b.field_name = x.field_name AND b.contract_id = x.contract_b
  WHERE x.c * 10 >= 6 * (a.n + b.n - x.c)
)"""


def p2_values(spark: SparkSession, sf_dir: str, stages: Stages) -> DataFrame:
    """(strategy, run_day, metric, value) of all evaluated tasks with a run; null values stay."""
    tasks = latest_eval_tasks(spark, sf_dir, ["finished_at", "metrics.wall_time_seconds AS wall", "metrics.tokens_prompt AS tokens"], ["finished_at", "wall", "tokens"], stages)
    runs = read(spark, sf_dir, "runs").where("run_id IS NOT NULL").select("run_id", "strategy").dropDuplicates(["run_id"])
    runs = plain_strategy(runs)
    dated = tasks.where("finished_at IS NOT NULL").join(broadcast_if_small(runs), "run_id")
    long = dated.select(
        "strategy",
        F.date_format("finished_at", "yyyy-MM-dd").alias("run_day"),
        F.explode(F.create_map(F.lit("wall_time_seconds"), F.col("wall"), F.lit("tokens_prompt"), F.col("tokens").cast("double"))).alias("metric", "value"),
    )
    return long.where("value >= 0 AND NOT isnan(value) AND strategy IS NOT NULL")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles 50 and 95 per strategy, day and metric; ``run_day`` is null over all days."""
    values = p2_values(spark, sf_dir, Stages(spark, "p2"))
    return percentiles(values, ["strategy", "run_day", "metric"], "value", [50, 95], totals=(["strategy", "metric"],)).withColumn("pct", F.col("pct").cast("int"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose percentile is at least twice that of their strategy over all days."""
    both = p2_percentiles(spark, sf_dir)
    overall = both.where("level = 1").select("strategy", "metric", "pct", F.col("value").alias("usual"))
    days = both.where("level = 0 AND n >= 15")
    return days.join(overall, ["strategy", "metric", "pct"]).where("value >= 2 * usual").select("strategy", "run_day", "metric", "pct")


def p3_scored_paths(spark: SparkSession, sf_dir: str, stages: Stages) -> DataFrame:
    """(g, id, score): task, clean path and confidence of all predicted writes that count."""
    writes = read(spark, sf_dir, "predicted_writes").select("write_id", "task_id", "path", "confidence", "landed_at")
    now = latest_of_few_repeats(writes, ["write_id"], "landed_at", ["confidence", "path", "task_id"], stages)
    task = F.lower(F.btrim("task_id", F.lit(" \t\r\n")))
    known = read(spark, sf_dir, "contracts").select(task.alias("g")).where("g IS NOT NULL").distinct()
    scored = now.where("confidence BETWEEN 0 AND 1").select(task.alias("g"), clean_path(F.col("path")).alias("id"), F.col("confidence").alias("score"))
    return scored.where("id IS NOT NULL").join(broadcast_if_small(known), "g", "left_semi")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best paths of each task: confidence descending, then path."""
    return top_n(p3_scored_paths(spark, sf_dir, Stages(spark, "p3")), 5).select(F.col("g").alias("task_id"), F.col("id").alias("path"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files changed or predicted together, per field and suite, with counts and lift."""
    stages = Stages(spark, "p4")
    tasks = latest_eval_tasks(spark, sf_dir, ["actual_changed_files", "predicted_write_files"], ["actual_changed_files", "predicted_write_files"], stages)
    runs = read(spark, sf_dir, "runs").where("run_id IS NOT NULL").select("run_id", "suite_name").dropDuplicates(["run_id"])
    of_suite = tasks.join(broadcast_if_small(runs), "run_id")
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("paths")) for f in ("actual_changed_files", "predicted_write_files")])
    long = of_suite.select("suite_name", F.explode(fields).alias("f")).select("suite_name", "f.field_name", clean_path_set(F.col("f.paths")).alias("paths"))
    return cooccurrence(long, ["field_name", "suite_name"], "paths", 8, 4.0)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of files found together in at least 8 records and at least 4 times as often as chance."""
    return p4_pairs(spark, sf_dir).select("field_name", "suite_name", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


_P4_SQL = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ingested_at DESC) rn FROM eval_tasks WHERE run_id IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1
), f AS (
  SELECT r.suite_name, l.run_id, l.task_id, x.field_name, x.paths FROM latest l JOIN runs r USING (run_id),
  LATERAL (SELECT 'actual_changed_files' AS field_name, l.actual_changed_files AS paths UNION ALL SELECT 'predicted_write_files', l.predicted_write_files) x
), e AS (
  SELECT DISTINCT field_name, suite_name, run_id, task_id, {CLEAN_SQL.format(p='p')} AS path FROM (SELECT * EXCLUDE (paths), unnest(paths) AS p FROM f) WHERE p IS NOT NULL
), g AS (SELECT * FROM e WHERE path IS NOT NULL
), n AS (SELECT field_name, suite_name, count(DISTINCT (run_id, task_id)) AS n FROM g GROUP BY ALL
), c AS (SELECT field_name, suite_name, path, count(*) AS c FROM g GROUP BY ALL
), ab AS (
  SELECT a.field_name, a.suite_name, a.path AS path_a, b.path AS path_b, count(*) AS n_ab
  FROM g a JOIN g b ON a.field_name = b.field_name AND a.suite_name = b.suite_name AND a.run_id = b.run_id AND a.task_id = b.task_id AND a.path < b.path
  GROUP BY ALL HAVING count(*) >= 8
)
SELECT ab.field_name, ab.suite_name, ab.path_a, ab.path_b FROM ab JOIN n USING (field_name, suite_name)
JOIN c ca ON ca.field_name = ab.field_name AND ca.suite_name = ab.suite_name AND ca.path = ab.path_a
JOIN c cb ON cb.field_name = ab.field_name AND cb.suite_name = ab.suite_name AND cb.path = ab.path_b
WHERE ab.n_ab * n.n >= 4 * ca.c * cb.c"""

_P3_SQL = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY landed_at DESC) rn FROM predicted_writes WHERE write_id IS NOT NULL) WHERE rn = 1
), s AS (
  SELECT lower(trim(task_id, ' \t\r\n')) AS task_id, {CLEAN_SQL.format(p='path')} AS path, max(confidence) AS c
  FROM latest WHERE confidence BETWEEN 0 AND 1 AND NOT isnan(confidence) GROUP BY ALL
), r AS (
  SELECT task_id, path, row_number() OVER (PARTITION BY task_id ORDER BY c DESC, path) AS rn FROM s
  WHERE path IS NOT NULL AND task_id IN (SELECT lower(trim(task_id, ' \t\r\n')) FROM contracts)
)
SELECT task_id, path FROM r WHERE rn <= 5"""

_P2_SQL = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ingested_at DESC) rn FROM eval_tasks WHERE run_id IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1
), v AS (
  SELECT {PLAIN_SQL.format(c='r.strategy')} AS strategy, strftime(l.finished_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS run_day, m.metric, m.value
  FROM latest l JOIN runs r USING (run_id), LATERAL (SELECT 'wall_time_seconds' AS metric, l.metrics.wall_time_seconds AS value UNION ALL SELECT 'tokens_prompt', l.metrics.tokens_prompt::DOUBLE) m
  WHERE l.finished_at IS NOT NULL AND m.value >= 0 AND NOT isnan(m.value)
), d AS (
  SELECT strategy, run_day, metric, count(*) n, quantile_cont(value, 0.5) q50, quantile_cont(value, 0.95) q95 FROM v GROUP BY ALL
), a AS (
  SELECT strategy, metric, quantile_cont(value, 0.5) q50, quantile_cont(value, 0.95) q95 FROM v GROUP BY ALL
)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p7_plan": p7_plan,
    "p7_report": p7_report,
    "p8_draw": p8_draw,
    "p8_report": p8_report,
    "p7_check": p7_check,
    "p8_check": p8_check,
    "p9_found": p9_found,
    "p9_sanitised": p9_sanitised,
}
SQL: dict[str, str] = {
    "p1_found": _P1_SETS + " SELECT field_name, contract_a, contract_b FROM pairs",
    "p1_classes": _P1_SETS
    + """, sets AS (SELECT field_name, contract_id, list(path ORDER BY path) AS paths FROM g JOIN s USING (field_name, contract_id) GROUP BY ALL
), cls AS (SELECT field_name, contract_id, min(contract_id) OVER (PARTITION BY field_name, paths) AS class_id FROM sets
), links AS (
  SELECT DISTINCT p.field_name, a.class_id AS x, b.class_id AS y FROM pairs p
  JOIN cls a ON a.field_name = p.field_name AND a.contract_id = p.contract_a JOIN cls b ON b.field_name = p.field_name AND b.contract_id = p.contract_b WHERE a.class_id <> b.class_id
), ends AS (SELECT field_name, x AS class_id, y FROM links UNION SELECT field_name, y, x FROM links)
SELECT c.field_name, c.contract_id, c.class_id, (SELECT count(*) FROM ends e WHERE e.field_name = c.field_name AND e.class_id = c.class_id) AS links FROM cls c""",
    "p7_check": "SELECT pack_name, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0::BIGINT AS lost, 0::BIGINT AS disordered, 0::BIGINT AS cut_though_small, 0::BIGINT AS over_capacity, false AS roomy FROM pack_capacities WHERE capacity_tokens > 0",
    "p8_check": f"SELECT mix_name, count(DISTINCT {PLAIN_SQL.format(c='source')}) AS targets, 0::BIGINT AS off_share, 0::BIGINT AS too_often, 0::BIGINT AS same_place FROM mix_targets WHERE mix_name IS NOT NULL GROUP BY mix_name",
    "p3_found": _P3_SQL,
    "p4_found": _P4_SQL,
    "p2_found": _P2_SQL
    + """
SELECT d.strategy, d.run_day, d.metric, 50 AS pct FROM d JOIN a USING (strategy, metric) WHERE d.n >= 15 AND d.q50 >= 2 * a.q50
UNION ALL SELECT d.strategy, d.run_day, d.metric, 95 FROM d JOIN a USING (strategy, metric) WHERE d.n >= 15 AND d.q95 >= 2 * a.q95""",
}
