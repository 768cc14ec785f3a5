"""Ranking targets for tasks: lexical, by co-change, by vectors, by links; and fusing the ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.blocks import best_by_overlap, best_by_words
from pathloom.operators.staging import Stages, broadcast_if_small

# ---- fixed values that results depend on --------------------------------------------------------

K1, B, EPSILON = 1.5, 0.75, 0.25  # of BM25 as commonly published, with a floor for common words
SYNONYMS = {
    "navigation": ["nav", "sidebar", "menu"],
    "menu": ["navigation", "nav", "sidebar"],
    "database": ["db", "prisma", "sql"],
    "auth": ["authentication", "login", "oauth"],
}
LEXICAL_TOP, LEXICAL_CAP = 8, 0.78
COCHANGE_SUPPORT, COCHANGE_CAP, COCHANGE_TOP = 3, 0.8, 8
VECTOR_FLOOR = 0.18
ALPHA, TOLERANCE, MAX_ITERATIONS = 0.85, 1e-8, 100
EXPAND_FROM, EXPAND_AT = 0.72, 0.92

# -------------------------------------------------------------------------------------------------


#: Queries of a block and parts of the vectors, where queries are too many to go to every task.
QUERY_BLOCK, VECTOR_PARTS = 4096, 64


def top(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; map tasks pass on ``n`` rows of a group at most."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def with_synonyms(tokens: Column) -> Column:
    """Tokens followed by the synonyms of each."""
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.concat(tokens, F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def bm25(corpus: DataFrame, queries: DataFrame, n: int = LEXICAL_TOP) -> DataFrame:
    """(qid, doc, score, confidence, rank): the ``n`` documents that fit each query best.

    ``corpus``: doc, tokens; ``queries``: qid, tokens, whose repeats count.  Words in more than
    half of the documents weigh a fraction of the mean weight.  A score is at least the number
    of distinct common words.  Scores are rounded to 6 places before ranking, equal ones decided
    by doc.  Documents without common words are not ranked.
    """
    stages = Stages(corpus.sparkSession, "bm25")
    sizes = corpus.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("tokens")).alias("avgdl"))
    df = corpus.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(sizes))
    idf = stages.put(df.withColumn("idf", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
    mean = idf.agg(F.avg("idf").alias("mean"))
    weight = idf.crossJoin(F.broadcast(mean)).select("token", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("qid", F.explode("tokens").alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qf"))
    asked = stages.put(asked.join(weight, "token").select("qid", "token", (F.col("qf") * F.col("idf")).alias("weight"), "avgdl"), "asked")
    # postings and queries meet in blocks, else every pair with a common word would be shuffled
    met = best_by_words(corpus, asked, n, (K1, B))
    scored = met.select("qid", "doc", F.greatest(F.round("raw", 6), F.col("common").cast("double")).alias("score"))
    best = top(scored.where("score > 0"), ["qid"], [F.desc("score"), F.asc("doc")], n)
    return best.withColumn("confidence", F.least(F.lit(LEXICAL_CAP), 0.25 + F.log1p("score") / 5.5))


def token_overlap(corpus: DataFrame, queries: DataFrame, n: int = LEXICAL_TOP) -> DataFrame:
    """(qid, doc, common, rank): documents by the number of distinct words shared with the query."""
    return top(best_by_overlap(corpus, queries, n), ["qid"], [F.desc("common"), F.asc("doc")], n)


def cosine_top(vectors: DataFrame, queries: DataFrame, n: int, floor: float = VECTOR_FLOOR) -> DataFrame:
    """(qid, vec_id, similarity, rank): the nearest vectors to each query by cosine, of the first
    2 n those above ``floor``.

    Queries (qid, query) go to every task if they are few.  Else queries are cut into blocks and
    vectors into parts, and every block meets every part in a task of its own; a task keeps the
    best of a query.  Vectors that are null, of another length or without length are passed over.
    """
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    q = queries.where("query IS NOT NULL").select("qid", "query", length(F.col("query")).alias("ql")).where("ql > 0")
    v = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", length(F.col("embedding")).alias("vl")).where("vl > 0")
    small = broadcast_if_small(q)
    if small is q:
        blocks = -(-q.count() // QUERY_BLOCK)
        q = q.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(VECTOR_PARTS - 1))))
        v = v.withColumn("_p", F.pmod(F.xxhash64("vec_id"), F.lit(VECTOR_PARTS)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = v.join(q, ["_b", "_p"]).where((F.size("embedding") == F.size("query")) & (F.col("vec_id") != F.col("qid")))
    else:
        met = v.join(small, (F.size("embedding") == F.size("query")) & (F.col("vec_id") != F.col("qid")))
    dot = F.aggregate(F.zip_with("embedding", "query", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    near = met.select("qid", "vec_id", F.round(dot / F.col("vl") / F.col("ql"), 6).alias("similarity"))
    return top(near, ["qid"], [F.desc("similarity"), F.asc("vec_id")], 2 * n).where(F.col("similarity") >= floor).where(F.col("rank") <= n)


def cochange_counts(commits: DataFrame, support: int = COCHANGE_SUPPORT) -> DataFrame:
    """(space, seed, path, n, seed_commits): how often two files change in one commit, at least
    ``support`` times, and how often the first one does.  ``commits``: space, commit, path.

    Files in fewer commits than ``support`` can't be in such a pair and are left out first.
    """
    c = commits.dropna().select("space", "commit", "path").distinct()
    per = c.groupBy("space", "path").agg(F.count(F.lit(1)).alias("seed_commits")).where(F.col("seed_commits") >= support)
    kept = c.join(per.select("space", "path"), ["space", "path"])
    # each unordered pair is counted once
    a, b = kept.withColumnRenamed("path", "x"), kept.withColumnRenamed("path", "y")
    n = a.join(b, ["space", "commit"]).where("x < y").groupBy("space", "x", "y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    both = n.select("space", F.explode(F.array(F.struct(F.col("x").alias("seed"), F.col("y").alias("path")), F.struct(F.col("y").alias("seed"), F.col("x").alias("path")))).alias("p"), "n").select("space", "p.*", "n")
    return both.join(per.withColumnRenamed("path", "seed"), ["space", "seed"])


def cochange_top(model: DataFrame, seeds: DataFrame, n: int = COCHANGE_TOP) -> DataFrame:
    """(qid, path, n, confidence, seed, rank): files that change with a query's seeds, seeds left out.

    ``seeds``: qid, space, seed.  The surest seed counts, the first of equal ones.
    """
    s = seeds.dropna().distinct()
    met = s.join(model, ["space", "seed"]).withColumn("sure", F.col("n") / F.col("seed_commits"))
    new = met.join(s.select("qid", F.col("seed").alias("path")), ["qid", "path"], "left_anti")
    best = top(new, ["qid", "path"], [F.desc("sure"), F.asc("seed")], 1, "_r").drop("_r")
    ranked = top(best, ["qid"], [F.desc("sure"), F.desc("n"), F.asc("path")], n)
    return ranked.select("qid", "path", "n", F.least(F.lit(COCHANGE_CAP), "sure").alias("confidence"), "seed", "rank")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, rank): personalised PageRank over weighted edges.

    ``nodes``: node, weight (its share of the restarts); ``edges``: src, dst, weight between them.
    Rank that reaches nodes without outgoing edges goes to the restarts.  With ``iterations`` so
    many are made, else until all changes sum to less than tolerance times the nodes.
    """
    stages = Stages(nodes.sparkSession, "pagerank")
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    n, weight = total["n"], total["w"] or 1.0
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = e.groupBy("src").agg(F.sum("weight").alias("out"))
    flow = stages.put(e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "flow")
    base = stages.put(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("leads")), "node", "left").select("node", (F.col("weight") / weight).alias("p"), F.coalesce("leads", F.lit(False)).alias("leads")), "base")
    rank = stages.put(base.select("node", "p", "leads", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved")), "rank")
    for _ in range(iterations or MAX_ITERATIONS):
        dangling = rank.where("NOT leads").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("dangling"))
        arriving = flow.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("arriving"))
        new = rank.join(arriving, "node", "left").crossJoin(F.broadcast(dangling))
        value = (1 - ALPHA) * F.col("p") + ALPHA * F.col("dangling") * F.col("p") + ALPHA * F.coalesce("arriving", F.lit(0.0))
        new = stages.put(new.select("node", "p", "leads", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")), "rank")
        stages.drop(rank)
        rank = new
        if iterations is None and rank.agg(F.sum("moved")).first()[0] < n * tolerance:
            break
    return rank.select("node", "rank")


def fuse(predictions: DataFrame, n: int) -> DataFrame:
    """(task, path, confidence, reason, rank): one row per task and path of several predictions.

    ``predictions``: task, path, confidence, reason, place (their order).  The highest confidence
    within 0 and 1 holds; different reasons are joined by "; " as they arrived.  Paths known by
    graph expansion alone come last, then by confidence and path.
    """
    p = predictions.dropna(subset=["task", "path"])
    first = p.groupBy("task", "path", "reason").agg(F.min("place").alias("place"), F.max("confidence").alias("confidence"))
    named = F.when(F.coalesce(F.col("reason"), F.lit("")) != "", F.struct("place", "reason"))
    f = first.groupBy("task", "path").agg(F.max("confidence").alias("c"), F.array_sort(F.collect_list(named)).alias("r"))
    f = f.select("task", "path", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)))).alias("confidence"), F.array_join(F.transform("r", lambda x: x["reason"]), "; ").alias("reason"))
    late = F.startswith(F.lower(F.btrim("reason")), F.lit("graph expansion"))
    return top(f, ["task"], [late.asc(), F.desc("confidence"), F.asc("path")], n)
