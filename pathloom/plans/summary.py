"""Queries that sum up runs: all metrics of a run, predictions against truth, strategies side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path_set, glob_matches
from pathloom.functions.text import plain_name
from pathloom.operators import metrics as M
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans import runs as E
from pathloom.plans.tables import read

#: What counts as done, and as proposed but not applied.
DONE, SAFE = "completed", ("completed", "completed_unverified")
#: Parallel tasks at most, of the sweep.
CAPS = (1, 2, 4, 8)


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest evaluated tasks with what their run says of itself."""
    cols = ["run_id", "task_id", "status", "predicted_write_files", "actual_changed_files", "out_of_bounds_files", "metrics", "started_at", "finished_at", "ingested_at"]
    rows = read(spark, sf_dir, "eval_tasks").where("run_id IS NOT NULL AND task_id IS NOT NULL").select(*cols)
    now = latest(rows, ["run_id", "task_id"], "ingested_at", ["finished_at", "status", "metrics.tokens_completion", "metrics.typecheck_ran"])
    runs = read(spark, sf_dir, "runs").select("run_id", "suite_name", plain_name(F.col("strategy")).alias("strategy"), "backend", "execution_mode", "evidence_kind", F.col("wall_time_seconds").alias("run_wall"))
    wall, tokens, done = F.col("metrics.wall_time_seconds"), F.col("metrics.tokens_prompt"), F.col("metrics.tokens_completion")
    return now.join(runs, "run_id").select(
        *runs.columns, "task_id", "status", "started_at", "finished_at",
        F.when((wall >= 0) & ~F.isnan(wall), wall).alias("wall"), F.when(tokens >= 0, tokens).alias("prompt"), F.when(done >= 0, done).alias("completion"), F.col("metrics.typecheck_ran").alias("typecheck"),
        clean_path_set(F.col("predicted_write_files")).alias("predicted"), clean_path_set(F.col("actual_changed_files")).alias("actual"), clean_path_set(F.col("out_of_bounds_files")).alias("oob"),
    )


def run_summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run every metric that its tasks can feed; sums that nothing reports stay null."""
    t = Stages(spark, "summary").put(_tasks(spark, sf_dir), "tasks")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    per = t.groupBy("run_id", "suite_name", "strategy", "run_wall").agg(
        F.count(F.lit(1)).alias("tasks_total"),
        F.count_if(F.col("status") == DONE).alias("tasks_completed"),
        F.count_if(F.col("status").isin(*SAFE)).alias("tasks_proposed"),
        F.count_if(F.col("status") == "failed").alias("tasks_failed"),
        F.count_if(F.col("status") == "blocked").alias("tasks_blocked"),
        F.sum("prompt").alias("tokens_prompt"),
        F.sum("completion").alias("tokens_completion"),
        F.round(F.sum("wall"), 4).alias("task_wall"),
        F.count_if(F.coalesce("typecheck", F.lit(False))).alias("typechecked"),
        F.count_if(~F.coalesce("typecheck", F.lit(False)) & (F.col("evidence_kind") == "applied_diff")).alias("typecheck_skipped"),
        F.count("wall").alias("walls_reported"),
        F.sum(size("oob")).alias("oob_files"),
        F.count_if(size("oob") > 0).alias("oob_tasks"),
        F.sum(size("predicted")).alias("predicted_files"),
        F.sum(size("actual")).alias("changed_mentions"),
        F.count_if(size("actual") == 0).alias("tasks_without_change"),
        F.sum(F.when(F.col("evidence_kind") == "applied_diff", size("actual")).otherwise(0)).alias("applied_changed"),
        F.min("started_at").alias("first"),
        F.max("finished_at").alias("last"),
    )
    files = t.select("run_id", F.explode("actual").alias("path")).groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n"))
    files = files.groupBy("run_id").agg(F.count(F.lit(1)).alias("changed_files"), F.count_if(F.col("n") >= 2).alias("overlapping_files"))
    s = per.join(files, "run_id", "left").fillna(0, ["changed_files", "overlapping_files"])
    rate = lambda c: F.round(F.col(c) / F.col("tasks_total"), 6)
    good = (F.col("run_wall") > 0) & ~F.isnan("run_wall")
    return s.select(
        *[c for c in s.columns if c not in ("first", "last", "run_wall")],
        F.when(good, F.round("run_wall", 6)).alias("wall_seconds"),
        rate("tasks_completed").alias("completion_rate"),
        rate("tasks_proposed").alias("proposal_rate"),
        F.when(good, F.round(F.col("tasks_completed") / (F.col("run_wall") / 3600), 6)).otherwise(0.0).alias("completed_per_hour"),
        F.when(good & F.col("task_wall").isNotNull(), F.round(F.col("task_wall") / F.col("run_wall"), 4)).alias("speedup"),
        F.when(F.col("tokens_prompt").isNotNull() | F.col("tokens_completion").isNotNull(), F.coalesce("tokens_prompt", F.lit(0)) + F.coalesce("tokens_completion", F.lit(0))).alias("tokens_all"),
        F.round(M.ratio(F.col("tokens_prompt"), F.col("tasks_completed")), 6).alias("prompt_per_completed"),
        (F.col("changed_mentions") - F.col("changed_files")).alias("repeated_touches"),
        F.round((F.unix_micros("last") - F.unix_micros("first")) / 1e6, 3).alias("span_seconds"),
        F.coalesce(F.round("run_wall", 4), F.round("task_wall", 4)).alias("wall_or_tasks"),
    )


def predictor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contract: predicted writes and candidate context against what its runs changed, and the
    share of missed files that the context could still give."""
    c = latest(read(spark, sf_dir, "contracts").where("contract_id IS NOT NULL"), ["contract_id"], "landed_at", ["task_id"])
    c = c.select("contract_id", F.lower(F.btrim("task_id", F.lit(" \t\r\n"))).alias("task"), F.coalesce(clean_path_set(F.col("candidate_context_paths")), F.array().cast("array<string>")).alias("context"))
    w = K.writes(spark, sf_dir).groupBy("task").agg(F.collect_set("path").alias("predicted"))
    truth = E.evals(spark, sf_dir).select(F.lower("task_id").alias("task"), F.explode("actual").alias("path")).groupBy("task").agg(F.collect_set("path").alias("truth"))
    t = c.join(truth, "task").join(w, "task", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    missed = F.array_except("truth", "predicted")
    either = F.array_union("predicted", "context")
    counts = t.select("contract_id", *M.set_counts(F.col("predicted"), F.col("truth")), F.size("truth").alias("truth"), F.size(F.array_intersect(missed, F.col("context"))).alias("recoverable"), F.size(missed).alias("missed"), F.size(F.array_intersect(either, F.col("truth"))).alias("found"), F.size(either).alias("offered"))
    scored = counts.select("contract_id", "truth", "tp", "fp", "fn", "recoverable", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn")), M.ratio(F.col("found"), F.col("truth")).alias("candidate_recall"), M.ratio(F.col("found"), F.col("offered")).alias("candidate_precision"), M.ratio(F.col("recoverable"), F.col("missed")).alias("recoverable_share"))
    return E._rounded(scored, "precision", "recall", "f1", "candidate_recall", "candidate_precision", "recoverable_share")


def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every strategy over its runs: number, mean, sample deviation, median, ends."""
    t = _tasks(spark, sf_dir).where("strategy IS NOT NULL")
    r = t.groupBy("strategy", "run_id").agg(F.avg((F.col("status") == DONE).cast("int")).alias("completion_rate"), F.sum("prompt").cast("double").alias("tokens_prompt"), F.sum("wall").alias("task_wall"), F.sum(F.greatest(F.size("oob"), F.lit(0))).cast("double").alias("oob_files"))
    long = r.unpivot(["strategy", "run_id"], ["completion_rate", "tokens_prompt", "task_wall", "oob_files"], "metric", "value").where("value IS NOT NULL")
    s = long.groupBy("strategy", "metric").agg(F.count(F.lit(1)).alias("runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))
    return E._rounded(s, "mean", "stdev", "median", "least", "most", places=5)


def lowest_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite the run with the lowest F1, then precision, then id."""
    c = E.evals(spark, sf_dir).where("suite_name IS NOT NULL").select("suite_name", "run_id", *M.set_counts(F.col("predicted"), F.col("actual"))).groupBy("suite_name", "run_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    a = E._rounded(c.select("suite_name", "run_id", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))), "precision", "recall", "f1")
    low = a.groupBy("suite_name").agg(F.min(F.struct("f1", "precision", "run_id", "recall")).alias("x"))
    return low.select("suite_name", "x.run_id", "x.f1", "x.precision", "x.recall")


def conflict_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: pairs of tasks of a run that change a common file (textual conflicts), pairs of
    the same folder without one (semantic ones), and the textual share."""
    e = Stages(spark, "fraction").put(E.evals(spark, sf_dir).where("suite_name IS NOT NULL").select("suite_name", "run_id", "task_id", F.explode("actual").alias("path")).withColumn("folder", F.regexp_replace("path", r"(^|/)[^/]*$", "")), "files")
    def met(key):
        a, b = (e.select("suite_name", "run_id", F.col("task_id").alias(k), key).distinct() for k in ("i", "j"))
        return a.join(b, ["suite_name", "run_id", key]).where("i < j").select("suite_name", "run_id", "i", "j").distinct()
    both = met("folder").join(met("path").withColumn("textual", F.lit(True)), ["suite_name", "run_id", "i", "j"], "left")
    s = both.groupBy("suite_name").agg(F.count("textual").alias("textual"), F.count_if(F.col("textual").isNull()).alias("semantic"))
    return s.withColumn("share", F.round(F.col("textual") / (F.col("textual") + F.col("semantic")), 6))


def sampler_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of event and day: samples, peak and mean of its values, and the longest silence."""
    e = read(spark, sf_dir, "events").where("value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL")
    s = e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"))
    return s


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: tokens and seconds of all its tasks, and the best source that any of them names:
    a provider before an estimate before none."""
    t = _tasks(spark, sf_dir).where("suite_name IS NOT NULL")
    rank = F.when(F.col("backend").isNull(), 0).when(F.col("backend") == "mock", 1).otherwise(2)
    s = t.groupBy("suite_name").agg(F.sum(F.coalesce("prompt", F.lit(0))).alias("prompt"), F.sum(F.coalesce("completion", F.lit(0))).alias("completion"), F.round(F.sum(F.coalesce("wall", F.lit(0.0))), 3).alias("seconds"), F.count(F.lit(1)).alias("calls"), F.max(rank).alias("r"))
    return s.select("suite_name", "prompt", "completion", "seconds", "calls", F.element_at(F.array(*map(F.lit, ("none", "estimate", "provider"))), F.col("r") + 1).alias("source"))


def token_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites whose prompt tokens per task differ from the strategy's by more than 30 percent."""
    t = _tasks(spark, sf_dir).where("prompt IS NOT NULL AND suite_name IS NOT NULL AND strategy IS NOT NULL")
    m = t.groupBy("strategy", "suite_name").agg(F.sum("prompt").alias("s"), F.count(F.lit(1)).alias("n"))
    m = Stages(spark, "drift").put(m, "means")
    e = m.groupBy("strategy").agg((F.sum("s") / F.sum("n")).alias("expected"))
    d = m.join(e, "strategy").select("strategy", "suite_name", (F.col("s") / F.col("n")).alias("observed"), "expected")
    return E._rounded(d.withColumn("drift", F.try_divide(F.abs(F.col("observed") - F.col("expected")), F.col("expected"))).where("drift > 0.3"), "observed", "expected", "drift")


def oob_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and files out of bounds per kind of evidence."""
    t = _tasks(spark, sf_dir).select("evidence_kind", F.greatest(F.size("oob"), F.lit(0)).alias("o"), *M.set_counts(F.col("predicted"), F.col("actual")))
    c = t.groupBy("evidence_kind").agg(F.count(F.lit(1)).alias("tasks"), F.sum("o").alias("oob_files"), F.count_if(F.col("o") > 0).alias("oob_tasks"), *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return E._rounded(c.select("evidence_kind", "tasks", "oob_files", "oob_tasks", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))), *E._ROUND)


def bounds_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluated task's changed files held against its contract's patterns again: inside,
    outside, and how many of the outside ones the record names."""
    e = E.evals(spark, sf_dir).select("run_id", "task_id", F.lower("task_id").alias("task"), F.explode("actual").alias("path"), "oob")
    p = K.tasks(spark, sf_dir).select("task", F.explode("allowed_paths").alias("pattern")).where("pattern IS NOT NULL").distinct()
    hit = F.coalesce(glob_matches(F.col("pattern"), F.col("path")), F.lit(False))
    f = e.join(p, "task").groupBy("run_id", "task_id", "path").agg(F.bool_or(hit).alias("inside"), F.bool_or(F.coalesce(F.array_contains("oob", F.col("path")), F.lit(False))).alias("named"))
    return f.groupBy("run_id", "task_id").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"), F.count_if(~F.col("inside") & F.col("named")).alias("named"))


def parallel_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy and number of tasks at once: batches that its runs take, and the seconds if a
    batch takes as long as the mean task of its run."""
    t = _tasks(spark, sf_dir).where("strategy IS NOT NULL")
    r = t.groupBy("strategy", "run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("wall").alias("mean"))
    s = r.withColumn("cap", F.explode(F.array(*map(F.lit, CAPS)))).withColumn("batches", F.ceil(F.col("n") / F.col("cap")))
    return s.groupBy("strategy", "cap").agg(F.count(F.lit(1)).alias("runs"), F.sum("batches").alias("batches"), F.round(F.sum(F.col("batches") * F.col("mean")), 3).alias("seconds"))


def burden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: repeated touches of files per run under the baseline and the planned strategy, where
    both ran, and what planning saves."""
    e = E.evals(spark, sf_dir).where("suite_name IS NOT NULL").where(F.col("strategy").isin(E.BASELINE, E.ARM))
    n = e.select("suite_name", "strategy", "run_id", F.explode("actual").alias("path")).groupBy("suite_name", "strategy", "run_id").agg((F.count(F.lit(1)) - F.count_distinct("path")).alias("d"))
    p = n.groupBy("suite_name").agg(F.avg(F.when(F.col("strategy") == E.BASELINE, F.col("d"))).alias("naive"), F.avg(F.when(F.col("strategy") == E.ARM, F.col("d"))).alias("planned")).dropna()
    return E._rounded(p.withColumn("saved", F.col("naive") - F.col("planned")), "naive", "planned", "saved")


_C = K.SQL_CLEAN
_T = f"""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ingested_at DESC, finished_at DESC NULLS LAST, status DESC NULLS LAST, metrics.tokens_completion DESC NULLS LAST, metrics.typecheck_ran DESC NULLS LAST) rn FROM eval_tasks WHERE run_id IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1),
t AS (SELECT l.run_id, r.suite_name, nullif(replace(lower(trim(r.strategy, E' \\t\\r\\n')), '-', '_'), '') AS strategy, r.backend, r.evidence_kind, r.wall_time_seconds AS run_wall, l.task_id, l.status, l.started_at, l.finished_at, CASE WHEN l.metrics.wall_time_seconds >= 0 AND NOT isnan(l.metrics.wall_time_seconds) THEN l.metrics.wall_time_seconds END AS wall, CASE WHEN l.metrics.tokens_prompt >= 0 THEN l.metrics.tokens_prompt END AS prompt, CASE WHEN l.metrics.tokens_completion >= 0 THEN l.metrics.tokens_completion END AS completion, l.metrics.typecheck_ran AS typecheck, {E._SETS} FROM latest l JOIN runs r USING (run_id))"""
_N = "coalesce(len({c}), 0)"
QUERIES = {f.__name__: f for f in (run_summary_full, predictor_rows, seed_aggregate, lowest_accuracy, conflict_fraction, sampler_peaks, usage_totals, token_drift, oob_by_evidence, bounds_split, parallel_sweep, burden_lines)}
SQL = {
    "run_summary_full": f"""{_T}, f AS (SELECT run_id, count(*) AS changed_files, count(*) FILTER (n >= 2) AS overlapping_files FROM (SELECT run_id, path, count(*) AS n FROM (SELECT run_id, unnest(actual) AS path FROM t) GROUP BY ALL) GROUP BY run_id),
p AS (SELECT run_id, suite_name, strategy, run_wall, count(*) AS tasks_total, count(*) FILTER (status = 'completed') AS tasks_completed, count(*) FILTER (status IN {SAFE}) AS tasks_proposed, count(*) FILTER (status = 'failed') AS tasks_failed, count(*) FILTER (status = 'blocked') AS tasks_blocked, sum(prompt)::BIGINT AS tokens_prompt, sum(completion)::BIGINT AS tokens_completion, round(sum(wall), 4) AS task_wall, count(*) FILTER (coalesce(typecheck, false)) AS typechecked, count(*) FILTER (NOT coalesce(typecheck, false) AND evidence_kind = 'applied_diff') AS typecheck_skipped, count(wall) AS walls_reported,
  sum({_N.format(c='oob')})::BIGINT AS oob_files, count(*) FILTER ({_N.format(c='oob')} > 0) AS oob_tasks, sum({_N.format(c='predicted')})::BIGINT AS predicted_files, sum({_N.format(c='actual')})::BIGINT AS changed_mentions, count(*) FILTER ({_N.format(c='actual')} = 0) AS tasks_without_change, sum(CASE WHEN evidence_kind = 'applied_diff' THEN {_N.format(c='actual')} ELSE 0 END)::BIGINT AS applied_changed, min(started_at) AS first, max(finished_at) AS last FROM t GROUP BY ALL)
SELECT p.* EXCLUDE (first, last, run_wall), coalesce(changed_files, 0) AS changed_files, coalesce(overlapping_files, 0) AS overlapping_files, CASE WHEN run_wall > 0 AND NOT isnan(run_wall) THEN round(run_wall, 6) END AS wall_seconds, round(tasks_completed / tasks_total, 6) AS completion_rate, round(tasks_proposed / tasks_total, 6) AS proposal_rate, CASE WHEN run_wall > 0 AND NOT isnan(run_wall) THEN round(tasks_completed / (run_wall / 3600), 6) ELSE 0 END AS completed_per_hour,
  CASE WHEN run_wall > 0 AND NOT isnan(run_wall) AND task_wall IS NOT NULL THEN round(task_wall / run_wall, 4) END AS speedup, CASE WHEN tokens_prompt IS NOT NULL OR tokens_completion IS NOT NULL THEN coalesce(tokens_prompt, 0) + coalesce(tokens_completion, 0) END AS tokens_all, round(coalesce(tokens_prompt / nullif(tasks_completed, 0), 0), 6) AS prompt_per_completed, changed_mentions - coalesce(changed_files, 0) AS repeated_touches, round((epoch_us(last) - epoch_us(first)) / 1e6, 3) AS span_seconds, coalesce(round(run_wall, 4), round(task_wall, 4)) AS wall_or_tasks FROM p LEFT JOIN f USING (run_id)""",
    "predictor_rows": f"""{E.SQL_EVALS}, writes AS ({K.SQL_WRITES}), c AS (SELECT contract_id, lower(trim(task_id, E' \\t\\r\\n')) AS task, coalesce([y for y in list_distinct([{_C.format(p='z')} for z in candidate_context_paths if z IS NOT NULL]) if y IS NOT NULL], []) AS ctx FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY landed_at DESC) rn FROM contracts WHERE contract_id IS NOT NULL) WHERE rn = 1),
w AS (SELECT task, list(path) AS predicted FROM writes GROUP BY task), tr AS (SELECT task, list(DISTINCT path) AS truth FROM (SELECT lower(task_id) AS task, unnest(actual) AS path FROM ev) GROUP BY task),
x AS (SELECT contract_id, truth, coalesce(predicted, []) AS p, ctx FROM c JOIN tr USING (task) LEFT JOIN w USING (task)),
n AS (SELECT contract_id, len(truth) AS truth, len(list_intersect(p, truth)) AS tp, len(p) - len(list_intersect(p, truth)) AS fp, len(truth) - len(list_intersect(p, truth)) AS fn, len(list_filter(truth, lambda v: NOT list_contains(p, v) AND list_contains(ctx, v))) AS recoverable, len(list_intersect(list_distinct(p || ctx), truth)) AS found, len(list_distinct(p || ctx)) AS offered FROM x)
SELECT contract_id, truth, tp, fp, fn, recoverable, {E._R}, round(coalesce(found / nullif(truth, 0), 0), 6) AS candidate_recall, round(coalesce(found / nullif(offered, 0), 0), 6) AS candidate_precision, round(coalesce(recoverable / nullif(fn, 0), 0), 6) AS recoverable_share FROM (SELECT *, {E._PRF} FROM n)""",
    "seed_aggregate": f"{_T}, r AS (SELECT strategy, run_id, avg((status = 'completed')::INT) AS completion_rate, sum(prompt)::DOUBLE AS tokens_prompt, sum(wall) AS task_wall, sum({_N.format(c='oob')})::DOUBLE AS oob_files FROM t WHERE strategy IS NOT NULL GROUP BY ALL), u AS (UNPIVOT r ON completion_rate, tokens_prompt, task_wall, oob_files INTO NAME metric VALUE value) SELECT strategy, metric, count(*) AS runs, round(avg(value), 5) AS mean, round(coalesce(stddev_samp(value), 0), 5) AS stdev, round(quantile_cont(value, 0.5), 5) AS median, round(min(value), 5) AS least, round(max(value), 5) AS most FROM u GROUP BY ALL",
    "lowest_accuracy": f"{E._COUNTS}, s AS (SELECT r.suite_name, run_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c JOIN runs r USING (run_id) WHERE r.suite_name IS NOT NULL GROUP BY ALL), a AS (SELECT suite_name, run_id, {E._R} FROM (SELECT *, {E._PRF} FROM s)) SELECT suite_name, run_id, f1, precision, recall FROM a QUALIFY row_number() OVER (PARTITION BY suite_name ORDER BY f1, precision, run_id) = 1",
    "conflict_fraction": f"{E.SQL_EVALS}, e AS MATERIALIZED (SELECT suite_name, run_id, task_id, path, regexp_replace(path, '(^|/)[^/]*$', '') AS folder FROM (SELECT suite_name, run_id, task_id, unnest(actual) AS path FROM ev WHERE suite_name IS NOT NULL)), fo AS (SELECT DISTINCT a.suite_name, a.run_id, a.task_id AS i, b.task_id AS j FROM e a JOIN e b USING (run_id, folder) WHERE a.task_id < b.task_id), pa AS (SELECT DISTINCT a.run_id, a.task_id AS i, b.task_id AS j FROM e a JOIN e b USING (run_id, path) WHERE a.task_id < b.task_id), s AS (SELECT suite_name, count(pa.i) AS textual, count(*) - count(pa.i) AS semantic FROM fo LEFT JOIN pa USING (run_id, i, j) GROUP BY suite_name) SELECT *, round(textual / (textual + semantic), 6) AS share FROM s",
    "sampler_peaks": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS samples, max(value) AS peak, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND ts IS NOT NULL GROUP BY ALL",
    "usage_totals": f"{_T} SELECT suite_name, sum(coalesce(prompt, 0))::BIGINT AS prompt, sum(coalesce(completion, 0))::BIGINT AS completion, round(sum(coalesce(wall, 0)), 3) AS seconds, count(*) AS calls, ['none', 'estimate', 'provider'][max(CASE WHEN backend IS NULL THEN 0 WHEN backend = 'mock' THEN 1 ELSE 2 END) + 1] AS source FROM t WHERE suite_name IS NOT NULL GROUP BY suite_name",
    "token_drift": f"{_T}, m AS (SELECT strategy, suite_name, sum(prompt) AS s, count(*) AS n FROM t WHERE prompt IS NOT NULL AND suite_name IS NOT NULL AND strategy IS NOT NULL GROUP BY ALL), e AS (SELECT strategy, sum(s) / sum(n) AS expected FROM m GROUP BY ALL) SELECT strategy, suite_name, round(s / n, 6) AS observed, round(expected, 6) AS expected, round(abs(s / n - expected) / expected, 6) AS drift FROM m JOIN e USING (strategy) WHERE abs(s / n - expected) / expected > 0.3",
    "oob_by_evidence": f"{_T}, n AS (SELECT evidence_kind, count(*) AS tasks, sum({_N.format(c='oob')})::BIGINT AS oob_files, count(*) FILTER ({_N.format(c='oob')} > 0) AS oob_tasks, sum(x) AS tp, sum({_N.format(c='predicted')} - x) AS fp, sum({_N.format(c='actual')} - x) AS fn FROM (SELECT *, coalesce(len(list_intersect(predicted, actual)), 0) AS x FROM t) GROUP BY ALL) SELECT evidence_kind, tasks, oob_files, oob_tasks, {E._R} FROM (SELECT *, {E._PRF} FROM n)",
    "bounds_split": f"{E.SQL_EVALS}, tasks AS ({K.SQL_TASKS}), pt AS (SELECT DISTINCT task, ltrim(pattern, './') AS p FROM (SELECT task, unnest(allowed_paths) AS pattern FROM tasks) WHERE pattern IS NOT NULL), e AS (SELECT run_id, task_id, lower(task_id) AS task, unnest(actual) AS path, oob FROM ev), h AS (SELECT run_id, task_id, path, bool_or(coalesce({K._GLOB}, false)) AS inside, bool_or(coalesce(list_contains(oob, path), false)) AS named FROM (SELECT *, ltrim(path, './') AS c FROM e) JOIN pt USING (task) GROUP BY ALL) SELECT run_id, task_id, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (NOT inside AND named) AS named FROM h GROUP BY ALL",
    "parallel_sweep": f"{_T}, r AS (SELECT strategy, run_id, count(*) AS n, avg(wall) AS mean FROM t WHERE strategy IS NOT NULL GROUP BY ALL) SELECT strategy, cap, count(*) AS runs, sum(ceil(n / cap))::BIGINT AS batches, round(sum(ceil(n / cap) * mean), 3) AS seconds FROM r, (SELECT unnest({list(CAPS)}) AS cap) GROUP BY ALL",
    "burden_lines": f"{E.SQL_EVALS}, n AS (SELECT suite_name, strategy, run_id, count(*) - count(DISTINCT path) AS d FROM (SELECT suite_name, strategy, run_id, unnest(actual) AS path FROM ev WHERE suite_name IS NOT NULL AND strategy IN ('{E.BASELINE}', '{E.ARM}')) GROUP BY ALL), p AS (SELECT suite_name, avg(d) FILTER (strategy = '{E.BASELINE}') AS naive, avg(d) FILTER (strategy = '{E.ARM}') AS planned FROM n GROUP BY ALL) SELECT suite_name, round(naive, 6) AS naive, round(planned, 6) AS planned, round(naive - planned, 6) AS saved FROM p WHERE naive IS NOT NULL AND planned IS NOT NULL",
}
