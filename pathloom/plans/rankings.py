"""Queries that rank paths, vectors and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.paths import clean_path_set
from pathloom.functions.text import camel, identifier_tokens, slug, snake, token_estimate
from pathloom.operators import ranking as R
from pathloom.operators.blocks import least_hashed
from pathloom.operators.latest import latest
from pathloom.operators.staging import Stages
from pathloom.plans import contracts as K
from pathloom.plans.runs import SQL_EVALS, evals
from pathloom.plans.tables import read


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Stages(spark, "corpus").put(K.writes(spark, sf_dir).select(F.col("path").alias("doc")).distinct().withColumn("tokens", identifier_tokens(F.col("doc"))), "paths")


def _asking(t: DataFrame) -> DataFrame:
    """Contracts by their task's id and allowed paths as words."""
    text = F.concat_ws(" ", "task", F.array_join(clean_path_set(F.col("allowed_paths")), " "))
    return t.select(F.col("contract_id").alias("qid"), R.with_synonyms(identifier_tokens(text)).alias("tokens"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract whose id is divisible by 50."""
    return _asking(K.tasks(spark, sf_dir).where("contract_id % 50 = 0"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.bm25(_corpus(spark, sf_dir), _queries(spark, sf_dir))
    return r.select("qid", "doc", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "rank")


def token_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that share the most words with each contract."""
    asked = Stages(spark, "asked").put(_asking(K.tasks(spark, sf_dir)), "queries")
    return R.token_overlap(_corpus(spark, sf_dir), asked).select("qid", "doc", "common", "rank")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return R.cosine_top(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 5)


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evals(spark, sf_dir).select(F.col("suite_name").alias("space"), F.concat_ws("/", F.col("run_id").cast("string"), "task_id").alias("commit"), F.explode("actual").alias("path"))
    return Stages(spark, "commits").put(e, "commits")


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cochange_counts(_commits(spark, sf_dir)).select("space", "seed", "path", "n", "seed_commits")


def cochange_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Stages(spark, "cochange").put(R.cochange_counts(_commits(spark, sf_dir)), "model")
    t = K.tasks(spark, sf_dir).where("contract_id % 50 = 0")
    seeds = t.select(F.col("contract_id").alias("qid"), F.col("suite_name").alias("space"), F.explode(clean_path_set(F.col("allowed_paths"))).alias("seed"))
    return R.cochange_top(model, seeds).select("qid", "path", "n", F.round("confidence", 6).alias("confidence"), "seed", "rank")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers lead to the parts that they deliver, by line items."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = line.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.withColumn("weight", F.when(F.startswith("node", F.lit("s")), 2.0).otherwise(1.0)), edges


def pagerank_fixed10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pagerank(*_graph(spark, sf_dir), iterations=10).select("node", F.round("rank", 9).alias("rank"))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pagerank(*_graph(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "predicted_writes").where("write_id IS NOT NULL").select("write_id", "task_id", "path", "confidence", "reason", "landed_at")
    now = latest(rows, ["write_id"], "landed_at", ["reason", "confidence", "path"]).where("confidence IS NOT NULL AND NOT isnan(confidence)")
    from pathloom.functions.paths import clean_path

    return now.select(F.lower(F.btrim("task_id", F.lit(" \t\r\n"))).alias("task"), clean_path(F.col("path")).alias("path"), "confidence", "reason", F.col("write_id").alias("place"))


def fusion_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_signals(spark, sf_dir), 8).select("task", "path", "confidence", "reason", "rank")


def random_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline: for every 50th contract five of all paths, by a hash."""
    q = K.tasks(spark, sf_dir).where("contract_id % 50 = 0").select(F.col("contract_id").alias("qid"))
    docs = Stages(spark, "corpus").put(K.writes(spark, sf_dir).select(F.col("path").alias("doc")).distinct(), "paths")
    return R.top(least_hashed(docs, q, 5), ["qid"], [F.asc("h"), F.asc("doc")], 5).select("qid", "doc", "rank")


def path_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "runs").where("suite_name IS NOT NULL").select("suite_name").distinct()
    c = F.col("suite_name")
    return s.select("suite_name", slug(c).alias("slug"), snake(c).alias("snake"), camel(c).alias("camel"))


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


_TOKENS = r"[lower(x) for x in regexp_extract_all(regexp_replace(replace({t}, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[a-zA-Z][a-zA-Z0-9]*')]"
_SYN = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in R.SYNONYMS.items()) + "}"
_FIFTIETH = " WHERE contract_id % 50 = 0"
_IR = f"""WITH tasks AS ({K.SQL_TASKS}), writes AS ({K.SQL_WRITES}), corpus AS (SELECT doc, {_TOKENS.format(t='doc')} AS tokens FROM (SELECT DISTINCT path AS doc FROM writes)),
q0 AS (SELECT contract_id AS qid, {_TOKENS.format(t="task || ' ' || coalesce(array_to_string(list_distinct([y for y in [" + K.SQL_CLEAN.format(p='z') + " for z in allowed_paths if z IS NOT NULL] if y IS NOT NULL]), ' '), '')")} AS tokens FROM tasks{_FIFTIETH}),
queries AS (SELECT qid, tokens || flatten([coalesce({_SYN}[t], []) for t in tokens]) AS tokens FROM q0),
tf AS (SELECT doc, len(tokens) AS dl, token, count(*) AS tf FROM (SELECT doc, tokens, unnest(tokens) AS token FROM corpus) GROUP BY ALL),
asked AS (SELECT qid, token, count(*) AS qf FROM (SELECT qid, unnest(tokens) AS token FROM queries) GROUP BY ALL)"""
_COMMITS = f"{SQL_EVALS}, c AS (SELECT DISTINCT suite_name AS space, run_id, task_id, unnest(actual) AS path FROM ev WHERE suite_name IS NOT NULL), per AS (SELECT space, path, count(*) AS seed_commits FROM c GROUP BY ALL), model AS (SELECT n.*, p.seed_commits FROM (SELECT a.space, a.path AS seed, b.path AS path, count(*) AS n FROM c a JOIN c b ON a.space = b.space AND a.run_id = b.run_id AND a.task_id = b.task_id AND a.path <> b.path GROUP BY ALL HAVING count(*) >= 3) n JOIN per p ON p.space = n.space AND p.path = n.seed)"


def _pagerank_sql(rounds: int) -> str:
    a = R.ALPHA
    sql = [
        "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL)",
        "f AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM e)",
        "n AS (SELECT node, CASE WHEN node LIKE 's%' THEN 2.0 ELSE 1.0 END AS w, node IN (SELECT src FROM e) AS leads FROM (SELECT src AS node FROM e UNION SELECT dst FROM e))",
        "b AS (SELECT node, w / sum(w) OVER () AS p, leads, count(*) OVER () AS n FROM n)",
        "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM b)",
    ]
    for i in range(rounds):
        sql.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.node, {1 - a} * b.p + {a} * b.p * (SELECT coalesce(sum(rank), 0) FROM r{i} JOIN b x USING (node) WHERE NOT x.leads) + {a} * coalesce(g.s, 0) AS rank FROM b LEFT JOIN (SELECT dst, sum(rank * share) AS s FROM f JOIN r{i} ON r{i}.node = f.src GROUP BY dst) g ON g.dst = b.node)"
        )
    return ", ".join(sql) + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


QUERIES = {f.__name__: f for f in (bm25_topk, token_overlap_topk, vector_topk, cochange_pairs, cochange_topk, pagerank_fixed10, pagerank, fusion_topn, random_topk, path_words, name_forms, token_estimates)}
SQL = {
    "bm25_topk": f"""{_IR}, s AS (SELECT count(*) AS docs, avg(len(tokens)) AS avgdl FROM corpus), idf AS (SELECT token, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, avgdl FROM tf, s GROUP BY token, docs, avgdl), w AS (SELECT token, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
sc AS (SELECT a.qid, t.doc, greatest(round(sum(a.qf * w.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / w.avgdl))), 6), count(*)::DOUBLE) AS score FROM asked a JOIN w USING (token) JOIN tf t USING (token) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM sc WHERE score > 0)
SELECT qid, doc, round(score, 4) AS score, round(least(0.78, 0.25 + ln(1 + score) / 5.5), 4) AS confidence, rank FROM r WHERE rank <= 8""",
    "token_overlap_topk": f"{_IR.replace(_FIFTIETH, '')} SELECT * FROM (SELECT qid, doc, count(*) AS common, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, doc) AS rank FROM asked JOIN tf USING (token) GROUP BY qid, doc) WHERE rank <= 8",
    "vector_topk": "WITH m AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS rank FROM m) WHERE rank <= 5 AND similarity >= 0.18",
    "cochange_pairs": f"{_COMMITS} SELECT space, seed, path, n, seed_commits FROM model",
    "cochange_topk": f"{_COMMITS}, tasks AS ({K.SQL_TASKS}), seeds AS (SELECT DISTINCT contract_id AS qid, suite_name AS space, {K.SQL_CLEAN.format(p='s')} AS seed FROM (SELECT contract_id, suite_name, unnest(allowed_paths) AS s FROM tasks WHERE contract_id % 50 = 0) WHERE s IS NOT NULL), m AS (SELECT s.qid, d.path, d.n, d.n / d.seed_commits AS sure, d.seed FROM seeds s JOIN model d USING (space, seed) WHERE NOT EXISTS (SELECT 1 FROM seeds x WHERE x.qid = s.qid AND x.seed = d.path)), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY sure DESC, seed) = 1) SELECT qid, path, n, round(least(0.8, sure), 6) AS confidence, seed, row_number() OVER (PARTITION BY qid ORDER BY sure DESC, n DESC, path) AS rank FROM b QUALIFY rank <= 8",
    "pagerank_fixed10": _pagerank_sql(10),
    "fusion_topn": f"WITH p AS (SELECT lower(trim(task_id, ' \t\r\n')) AS task, {K.SQL_CLEAN.format(p='path')} AS clean, confidence, reason, write_id FROM (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY landed_at DESC, reason DESC NULLS LAST) rn FROM predicted_writes WHERE write_id IS NOT NULL) WHERE rn = 1 AND confidence IS NOT NULL AND NOT isnan(confidence)), f AS (SELECT task, clean, reason, min(write_id) AS place, max(confidence) AS c FROM p WHERE task IS NOT NULL AND clean IS NOT NULL GROUP BY ALL), g AS (SELECT task, clean AS path, greatest(0.0, least(1.0, max(c))) AS confidence, coalesce(string_agg(reason, '; ' ORDER BY place) FILTER (reason <> ''), '') AS reason FROM f GROUP BY ALL) SELECT task, path, confidence, reason, row_number() OVER (PARTITION BY task ORDER BY starts_with(lower(trim(reason)), 'graph expansion'), confidence DESC, path) AS rank FROM g QUALIFY rank <= 8",
    "random_topk": f"{_IR} SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY md5(qid::VARCHAR || ':' || doc), doc) AS rank FROM queries, corpus QUALIFY rank <= 5",
    "path_words": f"{_IR} SELECT token, sum(tf)::BIGINT AS n FROM tf GROUP BY token",
    "name_forms": f"WITH s AS (SELECT DISTINCT suite_name, {_TOKENS.format(t='suite_name')} AS t FROM runs WHERE suite_name IS NOT NULL) SELECT suite_name, trim(regexp_replace(lower(suite_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, array_to_string(t, '_') AS snake, array_to_string([CASE WHEN i = 1 THEN w ELSE upper(w[1]) || w[2:] END for w, i in t], '') AS camel FROM s",
    "token_estimates": "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents WHERE text IS NOT NULL",
}
