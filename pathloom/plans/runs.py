"""Queries over evaluated tasks and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path_set
from pathloom.functions.text import plain_name
from pathloom.operators import metrics as M
from pathloom.operators import ranking as R
from pathloom.operators.intervals import overlapping
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans.tables import read

_LISTS = {"predicted": "predicted_write_files", "actual": "actual_changed_files", "oob": "out_of_bounds_files"}
RESAMPLES, BASELINE, ARM = 10_000, "naive_parallel", "acg_planned"


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated tasks, latest by (run_id, task_id), with their run's strategy and suite; lists clean."""
    rows = read(spark, sf_dir, "eval_tasks").where("run_id IS NOT NULL AND task_id IS NOT NULL")
    now = latest(rows, ["run_id", "task_id"], "ingested_at", ["finished_at", "status"])
    runs = read(spark, sf_dir, "runs").select("run_id", "suite_name", plain_name(F.col("strategy")).alias("strategy"))
    wall, tokens = F.col("metrics.wall_time_seconds"), F.col("metrics.tokens_prompt")
    return now.join(runs, "run_id").select(
        "run_id",
        "task_id",
        "suite_name",
        "strategy",
        F.when((wall >= 0) & ~F.isnan(wall), wall).alias("wall"),
        F.when(tokens >= 0, tokens).alias("tokens"),
        "started_at",
        "finished_at",
        *[clean_path_set(F.col(c)).alias(a) for a, c in _LISTS.items()],
    )


_SETS = ", ".join(f"[y for y in list_distinct([{K.SQL_CLEAN.format(p='z')} for z in l.{c} if z IS NOT NULL]) if y IS NOT NULL] AS {a}" for a, c in _LISTS.items())
SQL_EVALS = f"""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY ingested_at DESC, finished_at DESC NULLS LAST, status DESC NULLS LAST) rn FROM eval_tasks WHERE run_id IS NOT NULL AND task_id IS NOT NULL) WHERE rn = 1),
ev AS (SELECT l.run_id, l.task_id, r.suite_name, nullif(replace(lower(trim(r.strategy, ' \t\r\n')), '-', '_'), '') AS strategy, CASE WHEN l.metrics.wall_time_seconds >= 0 AND NOT isnan(l.metrics.wall_time_seconds) THEN l.metrics.wall_time_seconds END AS wall, CASE WHEN l.metrics.tokens_prompt >= 0 THEN l.metrics.tokens_prompt END AS tokens, l.started_at, l.finished_at, {_SETS} FROM latest l JOIN runs r USING (run_id))"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals(spark, sf_dir).select("run_id", "task_id", "strategy", *M.set_counts(F.col("predicted"), F.col("actual")))


_ROUND = ("precision", "recall", "f1")


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def prf_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return _rounded(c.select("run_id", "task_id", "tp", "fp", "fn", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))), *_ROUND)


def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir).groupBy("strategy").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return _rounded(c.select("strategy", "tp", "fp", "fn", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))), *_ROUND)


def prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir).select("strategy", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn")))
    return _rounded(c.groupBy("strategy").agg(F.count(F.lit(1)).alias("tasks"), *[F.avg(x).alias(x) for x in _ROUND]), *_ROUND)


def task_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task over all its runs: the union of predictions against the union of changes."""
    e = evals(spark, sf_dir)
    p, a = (e.select("task_id", F.explode(c).alias("path")) for c in ("predicted", "actual"))
    c = M.pair_accuracy(p, a, ["task_id"])
    return _rounded(c.select("task_id", "tp", "fp", "fn", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))), *_ROUND)


def recall_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five surest predicted writes of each task against what its runs changed."""
    ranked = R.top(K.writes(spark, sf_dir), ["task"], [F.desc("confidence"), F.asc("path")], 5)
    truth = evals(spark, sf_dir).select(F.lower("task_id").alias("task"), F.explode("actual").alias("path"))
    return _rounded(M.recall_at(ranked, truth, 5), "recall", "precision")


def out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evals(spark, sf_dir)
    return e.groupBy("strategy").agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.greatest(F.size("oob"), F.lit(0))).cast("long").alias("files"), F.count_if(F.size("oob") > 0).alias("tasks_outside"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: tasks, sums that stay null where nothing is reported, files and repeated touches."""
    e = evals(spark, sf_dir)
    files = e.select("run_id", F.explode("actual").alias("path")).groupBy("run_id").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("path").alias("files"))
    s = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("tasks"), F.round(F.sum("wall"), 4).alias("wall"), F.sum("tokens").alias("tokens"))
    return s.join(files, "run_id", "left").fillna(0, ["mentions", "files"]).withColumn("repeated", F.col("mentions") - F.col("files"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status for every strategy, zeros included."""
    rows = read(spark, sf_dir, "eval_tasks").where("run_id IS NOT NULL AND task_id IS NOT NULL")
    now = latest(rows, ["run_id", "task_id"], "ingested_at", ["finished_at", "status"]).select("run_id", "status")
    s = now.join(read(spark, sf_dir, "runs").select("run_id", plain_name(F.col("strategy")).alias("strategy")), "run_id").dropna()
    n = s.groupBy("strategy", "status").agg(F.count(F.lit(1)).alias("n"))
    # a few strategies by a few statuses
    grid = n.select("strategy").distinct().crossJoin(F.broadcast(n.select("status").distinct()))
    return grid.join(n, ["strategy", "status"], "left").fillna(0, ["n"])


def _run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per run: its wall time, where it is reported."""
    r = read(spark, sf_dir, "runs").where("wall_time_seconds >= 0 AND NOT isnan(wall_time_seconds)")
    return r.select("run_id", "suite_name", plain_name(F.col("strategy")).alias("strategy"), F.col("wall_time_seconds").alias("wall")).where("strategy IS NOT NULL")


_VALUES = "WITH v AS (SELECT run_id, suite_name, nullif(replace(lower(trim(strategy, ' \t\r\n')), '-', '_'), '') AS strategy, wall_time_seconds AS wall FROM runs WHERE wall_time_seconds >= 0 AND NOT isnan(wall_time_seconds)), vals AS (SELECT * FROM v WHERE strategy IS NOT NULL)"


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.spread(_run_values(spark, sf_dir), ["strategy"], "wall"), "mean", "stdev", "pstdev", "median", "p975", "p95_nearest", places=9)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.bootstrap(_run_values(spark, sf_dir), ["strategy"], "wall", ["run_id"], RESAMPLES), "mean", "low", "high", places=9)


def paired_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _run_values(spark, sf_dir).where("suite_name IS NOT NULL")
    return _rounded(M.paired_bootstrap(v, "suite_name", "strategy", "wall", ARM, BASELINE, RESAMPLES, 7), "mean", "low", "high", places=9)


def paired_bootstrap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paired_bootstrap_ci for every pair of strategies."""
    v = _run_values(spark, sf_dir).where("suite_name IS NOT NULL")
    return _rounded(M.paired_bootstraps(v, "suite_name", "strategy", "wall", RESAMPLES, 7), "mean", "low", "high", places=9)


def baseline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _run_values(spark, sf_dir).where("suite_name IS NOT NULL").groupBy("suite_name", "strategy").agg(F.avg("wall").alias("mean"))
    m = Stages(spark, "means").put(m, "means")
    return _rounded(M.deltas(m, ["suite_name"], "strategy", BASELINE, "mean"), "mean", "baseline", "delta", places=9)


def drift_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites whose mean differs from that of all runs of the strategy by more than 30 percent."""
    v = Stages(spark, "values").put(_run_values(spark, sf_dir), "values")
    m = v.where("suite_name IS NOT NULL").groupBy("suite_name", "strategy").agg(F.avg("wall").alias("mean"))
    e = v.groupBy("strategy").agg(F.avg("wall").alias("expected"))
    d = m.join(F.broadcast(e), "strategy").withColumn("drift", F.abs(F.col("mean") - F.col("expected")) / F.col("expected"))
    return _rounded(d.where("drift > 0.3"), "mean", "expected", "drift", places=9)


def best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite the mean of one strategy against the best of the others, and a row over all suites."""
    v = _run_values(spark, sf_dir).where("suite_name IS NOT NULL")
    m = v.groupBy("suite_name").agg(F.avg(F.when(F.col("strategy") == ARM, F.col("wall"))).alias("arm"))
    o = v.where(F.col("strategy") != ARM).groupBy("suite_name", "strategy").agg(F.avg("wall").alias("x")).groupBy("suite_name").agg(F.min("x").alias("best"))
    both = m.join(o, "suite_name").where("arm IS NOT NULL").withColumn("delta", F.col("arm") - F.col("best"))
    all_ = both.agg(F.lit("(mean)").alias("suite_name"), *[F.avg(c).alias(c) for c in ("arm", "best", "delta")])
    return _rounded(both.unionByName(all_), "arm", "best", "delta", places=9)


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: pairs of tasks whose times overlap, and those that changed a common file besides."""
    e = Stages(spark, "times").put(evals(spark, sf_dir), "evals")
    t = e.select("run_id", F.col("task_id").alias("id"), F.unix_micros("started_at").cast("double").alias("lo"), F.unix_micros("finished_at").cast("double").alias("hi"))
    met = overlapping(t, t, ["run_id"], 3600e6).where("left_id < right_id")
    files = e.select("run_id", "task_id", "actual")
    full = met.join(files.select("run_id", F.col("task_id").alias("left_id"), F.col("actual").alias("x")), ["run_id", "left_id"]).join(files.select("run_id", F.col("task_id").alias("right_id"), F.col("actual").alias("y")), ["run_id", "right_id"])
    return full.groupBy("run_id").agg(F.count(F.lit(1)).alias("together"), F.count_if(F.coalesce(F.arrays_overlap("x", "y"), F.lit(False))).alias("conflicting"))


def outcome_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by whether their first and their last run completed: fail to pass and so on."""
    rows = read(spark, sf_dir, "eval_tasks").where("run_id IS NOT NULL AND task_id IS NOT NULL AND started_at IS NOT NULL")
    now = latest(rows, ["run_id", "task_id"], "ingested_at", ["finished_at", "status"])
    by = F.struct("started_at", "run_id")
    ends = now.groupBy("task_id").agg((F.min_by("status", by) == "completed").alias("before"), (F.max_by("status", by) == "completed").alias("after"))
    return ends.groupBy("before", "after").agg(F.count(F.lit(1)).alias("tasks"))


def perf_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evals(spark, sf_dir).where("started_at IS NOT NULL AND finished_at >= started_at")
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    s = e.groupBy("strategy").agg(F.count(F.lit(1)).alias("tasks"), F.sum("tokens").alias("tokens"), F.round(F.sum(took), 3).alias("seconds"), F.round(F.max(took), 3).alias("longest"))
    return s.withColumn("per_second", F.round(F.try_divide(F.col("tokens"), F.col("seconds")), 3))


def replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each run is after each quarter of its time: tasks started and finished."""
    e = evals(spark, sf_dir).where("started_at IS NOT NULL AND finished_at >= started_at").select("run_id", F.unix_micros("started_at").alias("s"), F.unix_micros("finished_at").alias("f"))
    e = Stages(spark, "replay").put(e, "times")
    span = e.groupBy("run_id").agg(F.min("s").alias("lo"), F.max("f").alias("hi"))
    at = span.select("run_id", "lo", "hi", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("quarter")).withColumn("t", F.col("lo") + F.expr("(hi - lo) * quarter div 4"))
    return e.join(at, "run_id").groupBy("run_id", "quarter").agg(F.count_if(F.col("s") <= F.col("t")).alias("started"), F.count_if(F.col("f") <= F.col("t")).alias("finished"))


_COUNTS = f"{SQL_EVALS}, c AS (SELECT run_id, task_id, strategy, len(list_intersect(predicted, actual)) AS tp, len(predicted) - len(list_intersect(predicted, actual)) AS fp, len(actual) - len(list_intersect(predicted, actual)) AS fn FROM (SELECT * REPLACE (coalesce(predicted, []) AS predicted, coalesce(actual, []) AS actual) FROM ev))"
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_R = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_BOOT = "n AS (SELECT {k}, count(*) AS size, avg({v}) AS mean FROM vals GROUP BY ALL), s AS (SELECT {k}, {v} AS value, row_number() OVER (PARTITION BY {k} ORDER BY {v}, {o}) - 1 AS slot FROM vals), d AS (SELECT s.{k}, r.resample, ('0x' || md5('{seed}:' || r.resample || ':' || s.slot)[1:8])::BIGINT % n.size AS slot FROM s JOIN n USING ({k}), range({R}) r(resample)), m AS (SELECT d.{k}, d.resample, avg(s.value) AS m FROM d JOIN s USING ({k}, slot) GROUP BY ALL), ci AS (SELECT {k}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL)"
QUERIES = {f.__name__: f for f in (prf_per_task, prf_micro, prf_macro, task_accuracy, recall_at_5, out_of_bounds, run_summary, status_counts, spread, bootstrap_ci, paired_bootstrap_ci, paired_bootstrap_pairs, baseline_deltas, drift_guard, best_baseline, interval_overlap, outcome_flips, perf_rollup, replay_state)}
SQL = {
    "prf_per_task": f"{_COUNTS} SELECT run_id, task_id, tp, fp, fn, {_R} FROM (SELECT *, {_PRF} FROM c)",
    "prf_micro": f"{_COUNTS} SELECT strategy, tp, fp, fn, {_R} FROM (SELECT *, {_PRF} FROM (SELECT strategy, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ALL))",
    "prf_macro": f"{_COUNTS} SELECT strategy, count(*) AS tasks, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM (SELECT strategy, {_PRF} FROM c) GROUP BY ALL",
    "task_accuracy": f"{SQL_EVALS}, p AS (SELECT DISTINCT task_id, unnest(predicted) AS path FROM ev), a AS (SELECT DISTINCT task_id, unnest(actual) AS path FROM ev), j AS (SELECT coalesce(p.task_id, a.task_id) AS task_id, p.path AS pp, a.path AS ap FROM p FULL JOIN a ON p.task_id = a.task_id AND p.path = a.path), c AS (SELECT task_id, count(*) FILTER (pp IS NOT NULL AND ap IS NOT NULL) AS tp, count(*) FILTER (ap IS NULL) AS fp, count(*) FILTER (pp IS NULL) AS fn FROM j GROUP BY ALL) SELECT task_id, tp, fp, fn, {_R} FROM (SELECT *, {_PRF} FROM c)",
    "recall_at_5": f"{SQL_EVALS}, writes AS ({K.SQL_WRITES}), rk AS (SELECT task, path FROM writes QUALIFY row_number() OVER (PARTITION BY task ORDER BY confidence DESC, path) <= 5), tr AS (SELECT DISTINCT lower(task_id) AS task, unnest(actual) AS path FROM ev), h AS (SELECT task, count(*) AS hits FROM rk JOIN tr USING (task, path) GROUP BY task), z AS (SELECT task, count(*) AS size FROM tr GROUP BY task) SELECT task, round(CASE WHEN coalesce(size, 0) = 0 THEN 1.0 ELSE coalesce(hits, 0) / size END, 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS precision FROM (SELECT task FROM rk UNION SELECT task FROM tr) LEFT JOIN h USING (task) LEFT JOIN z USING (task)",
    "out_of_bounds": f"{SQL_EVALS} SELECT strategy, count(*) AS tasks, sum(coalesce(len(oob), 0))::BIGINT AS files, count(*) FILTER (len(oob) > 0) AS tasks_outside FROM ev GROUP BY strategy",
    "run_summary": f"{SQL_EVALS}, f AS (SELECT run_id, count(*) AS mentions, count(DISTINCT path) AS files FROM (SELECT run_id, unnest(actual) AS path FROM ev) GROUP BY run_id), s AS (SELECT run_id, count(*) AS tasks, round(sum(wall), 4) AS wall, sum(tokens)::BIGINT AS tokens FROM ev GROUP BY run_id) SELECT run_id, tasks, wall, tokens, coalesce(mentions, 0) AS mentions, coalesce(files, 0) AS files, coalesce(mentions - files, 0) AS repeated FROM s LEFT JOIN f USING (run_id)",
    "status_counts": f"{SQL_EVALS}, s AS (SELECT nullif(replace(lower(trim(r.strategy, ' \t\r\n')), '-', '_'), '') AS strategy, l.status FROM latest l JOIN runs r USING (run_id)), n AS (SELECT strategy, status, count(*) AS n FROM s WHERE strategy IS NOT NULL AND status IS NOT NULL GROUP BY ALL) SELECT a.strategy, b.status, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT strategy FROM n) a CROSS JOIN (SELECT DISTINCT status FROM n) b LEFT JOIN n ON n.strategy = a.strategy AND n.status = b.status",
    "spread": f"{_VALUES} SELECT strategy, count(*) AS n, round(avg(wall), 9) AS mean, round(coalesce(stddev_samp(wall), 0), 9) AS stdev, round(stddev_pop(wall), 9) AS pstdev, round(quantile_cont(wall, 0.5), 9) AS median, round(quantile_cont(wall, 0.975), 9) AS p975, round(quantile_disc(wall, 0.95), 9) AS p95_nearest, CASE WHEN min(wall) = max(wall) THEN 'zero_variance_observation' ELSE 'stochastic' END AS variance FROM vals GROUP BY strategy",
    "bootstrap_ci": f"{_VALUES}, {_BOOT.format(k='strategy', v='wall', o='run_id', seed=0, R=RESAMPLES)} SELECT strategy, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM n JOIN ci USING (strategy)",
    "paired_bootstrap_ci": f"{_VALUES.replace('vals AS', 'vals0 AS')}, a AS (SELECT suite_name, avg(wall) AS va FROM vals0 WHERE strategy = '{ARM}' AND suite_name IS NOT NULL GROUP BY ALL), b AS (SELECT suite_name, avg(wall) AS vb FROM vals0 WHERE strategy = '{BASELINE}' AND suite_name IS NOT NULL GROUP BY ALL), vals AS (SELECT 1 AS g, suite_name, round(va - vb, 6) AS d FROM a JOIN b USING (suite_name)), {_BOOT.format(k='g', v='d', o='suite_name', seed=7, R=RESAMPLES).replace(' d AS (', ' dr AS (').replace('FROM d JOIN', 'FROM dr d JOIN')} SELECT round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM n JOIN ci USING (g)",
    "paired_bootstrap_pairs": f"{_VALUES.replace('vals AS', 'vals0 AS')}, means AS (SELECT suite_name, strategy, avg(wall) AS x FROM vals0 WHERE suite_name IS NOT NULL GROUP BY ALL), vals AS (SELECT {{'a': p.strategy, 'b': q.strategy}} AS g, suite_name, round(p.x - q.x, 6) AS d FROM means p JOIN means q USING (suite_name) WHERE p.strategy < q.strategy QUALIFY count(*) OVER (PARTITION BY p.strategy, q.strategy) >= 2), {_BOOT.format(k='g', v='d', o='suite_name', seed=7, R=RESAMPLES).replace(' d AS (', ' dr AS (').replace('FROM d JOIN', 'FROM dr d JOIN')} SELECT g.a AS a, g.b AS b, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM n JOIN ci USING (g)",
    "baseline_deltas": f"{_VALUES}, m AS (SELECT suite_name, strategy, avg(wall) AS mean FROM vals WHERE suite_name IS NOT NULL GROUP BY ALL) SELECT m.suite_name, m.strategy, round(m.mean, 9) AS mean, round(b.mean, 9) AS baseline, round(m.mean - b.mean, 9) AS delta FROM m LEFT JOIN m b ON b.suite_name = m.suite_name AND b.strategy = '{BASELINE}'",
    "drift_guard": f"{_VALUES}, m AS (SELECT suite_name, strategy, avg(wall) AS mean FROM vals WHERE suite_name IS NOT NULL GROUP BY ALL), e AS (SELECT strategy, avg(wall) AS expected FROM vals GROUP BY ALL) SELECT suite_name, strategy, round(mean, 9) AS mean, round(expected, 9) AS expected, round(abs(mean - expected) / expected, 9) AS drift FROM m JOIN e USING (strategy) WHERE abs(mean - expected) / expected > 0.3",
    "best_baseline": f"{_VALUES}, m AS (SELECT suite_name, avg(wall) FILTER (strategy = '{ARM}') AS arm FROM vals WHERE suite_name IS NOT NULL GROUP BY ALL), o AS (SELECT suite_name, min(x) AS best FROM (SELECT suite_name, strategy, avg(wall) AS x FROM vals WHERE suite_name IS NOT NULL AND strategy <> '{ARM}' GROUP BY ALL) GROUP BY ALL), b AS (SELECT suite_name, arm, best, arm - best AS delta FROM m JOIN o USING (suite_name) WHERE arm IS NOT NULL) SELECT suite_name, round(arm, 9) AS arm, round(best, 9) AS best, round(delta, 9) AS delta FROM b UNION ALL SELECT '(mean)', round(avg(arm), 9), round(avg(best), 9), round(avg(delta), 9) FROM b",
    "interval_overlap": f"{SQL_EVALS}, t AS (SELECT * FROM ev WHERE started_at IS NOT NULL AND finished_at IS NOT NULL AND started_at <= finished_at) SELECT a.run_id, count(*) AS together, count(*) FILTER (len(list_intersect(a.actual, b.actual)) > 0) AS conflicting FROM t a JOIN t b ON a.run_id = b.run_id AND a.task_id < b.task_id AND a.started_at <= b.finished_at AND b.started_at <= a.finished_at GROUP BY a.run_id",
    "outcome_flips": f"{SQL_EVALS}, r AS (SELECT * FROM latest WHERE started_at IS NOT NULL), e AS (SELECT task_id, arg_min(status, (started_at, run_id)) FILTER (status IS NOT NULL) AS b, arg_max(status, (started_at, run_id)) FILTER (status IS NOT NULL) AS a FROM r GROUP BY task_id) SELECT b = 'completed' AS before, a = 'completed' AS after, count(*) AS tasks FROM e GROUP BY ALL",
    "perf_rollup": f"{SQL_EVALS}, s AS (SELECT strategy, count(*) AS tasks, sum(tokens)::BIGINT AS tokens, round(sum((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 3) AS seconds, round(max((epoch_us(finished_at) - epoch_us(started_at)) / 1e6), 3) AS longest FROM ev WHERE started_at IS NOT NULL AND finished_at >= started_at GROUP BY strategy) SELECT *, round(tokens / nullif(seconds, 0), 3) AS per_second FROM s",
    "replay_state": f"{SQL_EVALS}, e AS (SELECT run_id, epoch_us(started_at) AS s, epoch_us(finished_at) AS f FROM ev WHERE started_at IS NOT NULL AND finished_at >= started_at), sp AS (SELECT run_id, min(s) AS lo, max(f) AS hi FROM e GROUP BY run_id), pt AS (SELECT run_id, quarter, lo + (hi - lo) * quarter // 4 AS t FROM sp, (SELECT unnest([1, 2, 3, 4]) AS quarter)) SELECT run_id, quarter, count(*) FILTER (s <= t) AS started, count(*) FILTER (f <= t) AS finished FROM e JOIN pt USING (run_id) GROUP BY ALL",
}
