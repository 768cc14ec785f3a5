"""Further queries: decompositions, differences, templates, statistics of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path_set, plain_glob_matches
from pathloom.operators import conflicts as C
from pathloom.operators import metrics as M
from pathloom.operators import patterns as T
from pathloom.operators import ranking as R
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans import runs as E
from pathloom.plans import sources as S
from pathloom.plans.tables import read


def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.path_templates(K.writes(spark, sf_dir).select("path"))


def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of paths that are nearly words of suite names."""
    from pathloom.functions.text import identifier_tokens

    words = lambda df, c: df.select(F.explode(identifier_tokens(F.col(c))).alias("word")).distinct()
    return T.alike(words(read(spark, sf_dir, "runs"), "suite_name"), words(K.writes(spark, sf_dir), "path")).withColumn("ratio", F.round("ratio", 6))


def miss_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contract, with predicted writes as the truth: files outside its patterns, files inside that
    no run changed, and files changed beyond the truth."""
    t = K.tasks(spark, sf_dir).select("contract_id", "task", "allowed_paths")
    truth = Stages(spark, "truth").put(t.join(K.writes(spark, sf_dir).select("task", "path"), "task").select("contract_id", "task", "path"), "truth")
    p = t.select("contract_id", F.explode("allowed_paths").alias("pattern"))
    covered = truth.join(p, "contract_id", "left").groupBy("contract_id", "task", "path").agg(F.bool_or(F.coalesce(plain_glob_matches(F.col("pattern"), F.col("path")), F.lit(False))).alias("covered"))
    changed = E.evals(spark, sf_dir).select(F.lower("task_id").alias("task"), F.explode("actual").alias("path")).distinct()
    done = t.join(changed, "task").select("contract_id", "path").distinct().withColumn("changed", F.lit(True))
    both = covered.join(done, ["contract_id", "path"], "full")
    return both.groupBy("contract_id").agg(
        F.count_if(F.col("covered").isNotNull() & ~F.col("covered")).alias("not_allowed"),
        F.count_if(F.coalesce("covered", F.lit(False)) & F.col("changed").isNull()).alias("not_changed"),
        F.count_if(F.col("covered").isNull()).alias("beyond"),
    )


def prediction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task: what its last run predicts against its first one."""
    e = E.evals(spark, sf_dir).where("started_at IS NOT NULL AND predicted IS NOT NULL")
    by = F.struct("started_at", "run_id")
    d = e.groupBy("task_id").agg(F.min_by("predicted", by).alias("a"), F.max_by("predicted", by).alias("b"))
    return d.select("task_id", F.size(F.array_except("b", "a")).alias("added"), F.size(F.array_except("a", "b")).alias("removed"), F.size(F.array_intersect("a", "b")).alias("kept"))


def run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How F1 varies over the runs of a strategy."""
    c = E.evals(spark, sf_dir).select("run_id", "strategy", *M.set_counts(F.col("predicted"), F.col("actual")))
    r = c.groupBy("strategy", "run_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    f = r.select("strategy", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn")))
    s = f.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("pstdev"), F.median("f1").alias("median"))
    return s.withColumns({c: F.round(c, 9) for c in ("mean", "pstdev", "median")})


def backend_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro accuracy per backend and strategy; runs without backend are a group."""
    b = read(spark, sf_dir, "runs").select("run_id", "backend")
    c = E.evals(spark, sf_dir).join(b, "run_id").select("backend", "strategy", *M.set_counts(F.col("predicted"), F.col("actual")))
    s = c.groupBy("backend", "strategy").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return s.select("backend", "strategy", "tp", "fp", "fn", *M.accuracy(F.col("tp"), F.col("fp"), F.col("fn"))).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def most_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.import_fan_in(spark, sf_dir).where("importers > 0")
    return f.orderBy(F.desc("importers"), F.asc("path")).limit(30)


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S._files(spark, sf_dir).agg(F.count(F.lit(1)).alias("files"))
    e = S.import_targets(spark, sf_dir).select("importer", "target").distinct().agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("target").alias("targets"))
    return n.crossJoin(F.broadcast(e)).withColumn("density", F.round(F.col("edges") / F.col("files"), 9))


def candidate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: pairs of contracts that share candidate context, and how many share writes too."""
    c = latest(read(spark, sf_dir, "contracts").where("contract_id IS NOT NULL"), ["contract_id"], "landed_at", ["task_id"]).where("suite_name IS NOT NULL")
    w = c.select(F.col("suite_name").alias("plan"), F.col("contract_id").alias("task"), F.explode(clean_path_set(F.col("candidate_context_paths"))).alias("path"))
    soft = C.sharing_pairs(Stages(spark, "context").put(w, "context")).select("plan", "i", "j")
    hard = C.sharing_pairs(K.plan_writes(spark, sf_dir)).select("plan", "i", "j", F.lit(True).alias("hard"))
    return soft.join(hard, ["plan", "i", "j"], "left").groupBy("plan").agg(F.count(F.lit(1)).alias("pairs"), F.count("hard").alias("hard_too"))


def last_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: the files of the task that finished last."""
    e = E.evals(spark, sf_dir).where("finished_at IS NOT NULL AND suite_name IS NOT NULL AND size(actual) > 0")
    last = R.top(e, ["suite_name"], [F.desc("finished_at"), F.asc("run_id"), F.asc("task_id")], 1)
    return last.select("suite_name", F.explode("actual").alias("path"))


def largest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("repo IS NOT NULL AND text IS NOT NULL").select("repo", "doc_id", (F.length(F.regexp_replace("text", "[^\n]", "")) + 1).alias("lines"))
    return R.top(d, ["repo"], [F.desc("lines"), F.asc("doc_id")], 8)


_EV = E.SQL_EVALS
_C = f"{E._COUNTS}"
QUERIES = {f.__name__: f for f in (path_templates, similar_words, miss_decomposition, prediction_diff, run_variance, backend_accuracy, most_imported, graph_stats, candidate_conflicts, last_changed, largest_documents)}
SQL = {
    "path_templates": f"WITH writes AS ({K.SQL_WRITES}), p AS (SELECT path, string_split(path, '/') AS parts FROM (SELECT DISTINCT path FROM writes)), s AS (SELECT path, parts, unnest(range(1, len(parts))) AS a FROM p), t AS (SELECT path, parts, a, unnest(range(a, len(parts))) AS b FROM s) SELECT template, count(*) AS members FROM (SELECT DISTINCT path, array_to_string(parts[1:a - 1] || ['*'] || parts[b + 1:], '/') AS template FROM t) GROUP BY template HAVING count(*) >= 2",
    "miss_decomposition": f"{_EV}, tasks AS ({K.SQL_TASKS}), writes AS ({K.SQL_WRITES}), truth AS (SELECT t.contract_id, t.task, w.path FROM tasks t JOIN writes w USING (task)), p AS (SELECT contract_id, unnest(allowed_paths) AS pattern FROM tasks), cv AS (SELECT t.contract_id, t.path, bool_or(coalesce(t.path = p.pattern OR (regexp_matches(p.pattern, '[*?\\[]') AND t.path GLOB p.pattern), false)) AS covered FROM truth t LEFT JOIN p USING (contract_id) GROUP BY ALL), ch AS (SELECT DISTINCT t.contract_id, x.path FROM tasks t JOIN (SELECT lower(task_id) AS task, unnest(actual) AS path FROM ev) x USING (task)), b AS (SELECT coalesce(cv.contract_id, ch.contract_id) AS contract_id, cv.covered, ch.path AS changed FROM cv FULL JOIN ch ON ch.contract_id = cv.contract_id AND ch.path = cv.path) SELECT contract_id, count(*) FILTER (NOT covered) AS not_allowed, count(*) FILTER (covered AND changed IS NULL) AS not_changed, count(*) FILTER (covered IS NULL) AS beyond FROM b GROUP BY contract_id",
    "prediction_diff": f"{_EV}, l AS (SELECT * FROM ev WHERE started_at IS NOT NULL AND predicted IS NOT NULL), d AS (SELECT task_id, arg_min(predicted, (started_at, run_id)) AS a, arg_max(predicted, (started_at, run_id)) AS b FROM l GROUP BY task_id) SELECT task_id, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS added, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS removed, len(list_filter(a, lambda x: list_contains(b, x)))::INT AS kept FROM d",
    "run_variance": f"{_C}, r AS (SELECT strategy, run_id, coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS f1 FROM c GROUP BY ALL) SELECT strategy, count(*) AS runs, round(avg(f1), 9) AS mean, round(stddev_pop(f1), 9) AS pstdev, round(quantile_cont(f1, 0.5), 9) AS median FROM r GROUP BY strategy",
    "backend_accuracy": f"{_C}, s AS (SELECT backend, c.strategy, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c JOIN runs r USING (run_id) GROUP BY ALL) SELECT backend, strategy, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM (SELECT *, {E._PRF} FROM s)",
    "most_imported": f"{S._TARGETS}, n AS (SELECT target AS path, count(DISTINCT importer)::INT AS importers FROM t WHERE target <> importer GROUP BY target) SELECT path, importers FROM n ORDER BY importers DESC, path LIMIT 30",
    "graph_stats": f"{S._TARGETS}, e AS (SELECT DISTINCT importer, target FROM t WHERE target <> importer) SELECT files, edges, targets, round(edges / files, 9) AS density FROM (SELECT count(*) AS files FROM files), (SELECT count(*) AS edges, count(DISTINCT target) AS targets FROM e)",
    "candidate_conflicts": f"{K._PAIRS}, cx AS (SELECT DISTINCT plan, task, {K.SQL_CLEAN.format(p='x')} AS path FROM (SELECT suite_name AS plan, contract_id AS task, unnest(candidate_context_paths) AS x FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY landed_at DESC) rn FROM contracts WHERE contract_id IS NOT NULL) WHERE rn = 1 AND suite_name IS NOT NULL) WHERE x IS NOT NULL), soft AS (SELECT DISTINCT a.plan, a.task AS i, b.task AS j FROM cx a JOIN cx b USING (plan, path) WHERE a.task < b.task AND a.path IS NOT NULL) SELECT s.plan, count(*) AS pairs, count(p.i) AS hard_too FROM soft s LEFT JOIN pairs p ON p.plan = s.plan AND p.i = s.i AND p.j = s.j GROUP BY s.plan",
    "last_changed": f"{_EV} SELECT suite_name, unnest(actual) AS path FROM (SELECT * FROM ev WHERE finished_at IS NOT NULL AND suite_name IS NOT NULL AND len(actual) > 0 QUALIFY row_number() OVER (PARTITION BY suite_name ORDER BY finished_at DESC, run_id, task_id) = 1)",
    "largest_documents": "SELECT repo, doc_id, (length(regexp_replace(text, '[^\n]', '', 'g')) + 1)::INT AS lines, row_number() OVER (PARTITION BY repo ORDER BY length(regexp_replace(text, '[^\n]', '', 'g')) DESC, doc_id) AS rank FROM documents WHERE repo IS NOT NULL AND text IS NOT NULL QUALIFY rank <= 8",
}
