"""Choosing among predictions and files: one row per path, merges, slices, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import mentions_test
from pathloom.operators.blocks import sharing
from pathloom.operators.ranking import EXPAND_AT, EXPAND_FROM, top
from pathloom.operators.staging import Stages, broadcast_if_small

# ---- fixed values that results depend on --------------------------------------------------------

HUB_IMPORTERS, HUB_IMPORTS, HUB_DEGREE = 20, 15, 30
MODEL_FILES, PLANNER_FILES, MANIFEST_FILES = 50, 80, 200
STUBS_PER_ANCHOR = 3

# -------------------------------------------------------------------------------------------------


#: A path with more neighbours is a hub, whose neighbours are not listed for each task.
FEW_NEIGHBOURS = 256


def surest(predictions: DataFrame) -> DataFrame:
    """One row per (task, path): the one with the highest confidence, the first of equal ones.

    ``predictions``: task, path, confidence, place and others.  Map tasks pass on a row per key."""
    return top(predictions.dropna(subset=["task", "path"]), ["task", "path"], [F.desc_nulls_last("confidence"), F.asc("place")], 1, "_r").drop("_r")


def reranked(seeds: DataFrame, rerank: DataFrame, firm: str) -> DataFrame:
    """(task, path, confidence, reason): seeds with the confidence that a second ranking gives them,
    unless its reason matches ``firm``; what only the second one has is added.  An empty reason
    of the second keeps the first's.  Both: task, path, confidence, reason, a row per key."""
    a = seeds.select("task", "path", F.col("confidence").alias("c0"), F.col("reason").alias("r0"), F.lit(True).alias("seed"))
    b = rerank.select("task", "path", F.col("confidence").alias("c1"), F.col("reason").alias("r1"), F.lit(True).alias("again"))
    both = a.join(b, ["task", "path"], "full")
    kept = F.col("again").isNull() | (F.col("seed") & F.coalesce(F.col("r1").rlike(firm), F.lit(False)))
    reason = F.when(F.coalesce("r1", F.lit("")) != "", F.col("r1")).otherwise(F.col("r0"))
    return both.select("task", "path", F.when(F.coalesce(kept, F.lit(False)), F.col("c0")).otherwise(F.col("c1")).alias("confidence"), reason.alias("reason"))


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, imports, importers, links, hub): how a file hangs together with others.

    ``edges``: src, dst, kind (import or type)."""
    e = edges.distinct()
    out = e.where("kind = 'import'").groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("imports"))
    into = e.where("kind = 'import'").groupBy(F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("importers"))
    links = e.where("kind = 'type'").groupBy(F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("links"))
    d = files.select("path").distinct().join(out, "path", "left").join(into, "path", "left").join(links, "path", "left").fillna(0)
    hub = (F.col("imports") >= HUB_IMPORTS) | (F.col("importers") >= HUB_IMPORTERS) | (F.col("imports") + F.col("importers") + F.col("links") >= HUB_DEGREE)
    return d.withColumn("hub", hub)


def slices(files: DataFrame) -> DataFrame:
    """(path, model_rank, planner_rank, manifest_rank): places of files in what different readers are
    shown, null beyond what each one is: hotspots first, then by exports, importers or degree.

    ``files``: path, hotspot, exports, importers, degree (numbers).  Each place is found by a top-n of
    its own, so no task orders all files."""
    ranked = None
    for name, by, n in (("model_rank", "exports", MODEL_FILES), ("planner_rank", "importers", PLANNER_FILES), ("manifest_rank", "degree", MANIFEST_FILES)):
        first = [F.desc("hotspot")] if name != "manifest_rank" else []
        best = files.orderBy(*first, F.desc(by), F.asc("path")).limit(n)
        part = top(best.withColumn("_g", F.lit(1)), ["_g"], [*first, F.desc(by), F.asc("path")], n, name).select("path", name)
        ranked = part if ranked is None else ranked.join(part, "path", "full")
    return ranked


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, dst, kind): import edges, their reverse as importer, and type links, once each."""
    back = edges.where("kind = 'import'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("importer").alias("kind"))
    return edges.select("src", "dst", "kind").unionByName(back).where("src <> dst").distinct()


def expanded(fused: DataFrame, around: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, path, confidence, reason): files one edge away from a task's sure paths.

    ``fused``: task, path, confidence; ``around``: src, dst, kind of ``neighbours``; ``tasks``: task, words
    (array of the task's words), tests (whether it is about tests).  A file is added if its path
    shares a word with the task, if a type link leads to it, or imports from two sure paths do;
    test files only for tasks about tests.  Words of paths: ``files``: path, words.

    Neighbours of paths that have few are listed; those of hubs are joined by what would add them:
    the word, the type link, or the second sure path.  What is found of a file that is added are
    all its sure paths."""
    stages = Stages(fused.sparkSession, "expanded")
    sure = stages.put(fused.where(F.col("confidence") >= EXPAND_FROM).select("task", F.col("path").alias("src")).distinct().join(tasks.select("task", "tests"), "task"), "sure")
    edges = stages.put(around.withColumnRenamed("dst", "path").join(files.select("path"), "path").select("src", "path", "kind", mentions_test(F.col("path")).alias("testy")), "edges")
    fits = F.col("tests") | ~F.col("testy")
    row = ["task", "path", "src", "kind"]
    # a file with many neighbours leads each of its tasks to all of them; which of those are added is found without listing them
    hubs = broadcast_if_small(stages.put(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_NEIGHBOURS).select("src"), "hubs"))
    wide, hub_sure = stages.put(edges.join(hubs, "src", "left_semi"), "wide"), stages.put(sure.join(hubs, "src", "left_semi"), "hub_sure")
    by_hub = broadcast_if_small(hub_sure)
    light = stages.put(edges.join(hubs, "src", "left_anti").join(sure, "src").where(fits).select(*row), "light")
    # a shared word: of all sure paths
    asked = tasks.select("task", F.explode(F.array_distinct("words")).alias("word"))
    said = files.select("path", F.explode(F.array_distinct("words")).alias("word")).join(broadcast_if_small(stages.put(asked.select("word").distinct(), "words")), "word", "left_semi")
    alike = edges.join(said, "path").join(sure.join(asked, "task"), ["src", "word"]).where(fits).select(*row)
    # hubs beside paths that other sure paths lead to
    beside = light.select("task", "path").join(by_hub.select("task", "src"), "task").join(wide.select("src", "path", "kind"), ["src", "path"]).select(*row)
    # type links of hubs, and paths that two hubs lead to, one of them by an import or a type link
    linked = wide.where("kind = 'type'").join(by_hub, "src").where(fits).select(*row)
    firmly = F.col("kind").isin("import", "type")
    other = wide.groupBy(F.col("src").alias("other"), "path").agg(F.bool_or(firmly).alias("firmly"))
    shared = wide.join(other, "path").where(F.col("src") != F.col("other")).where(firmly | F.col("firmly")).drop("firmly")
    two = hub_sure.join(by_hub.select("task", F.col("src").alias("other")), "task").where(F.col("src") != F.col("other"))
    both = two.join(shared, ["src", "other"]).where(fits).select(*row)
    none = F.lit(None).cast("string")
    known = fused.select("task", "path", none.alias("src"), none.alias("kind"))
    met = alike.withColumns({"match": F.lit(True), "known": F.lit(False)})
    for part in (light, beside, linked, both, known):
        met = met.unionByName(part.withColumns({"match": F.lit(False), "known": F.lit(part is known)}))
    # rows come path by path, each with the same tasks: parted by path alone they are written in a fraction of the room
    g = met.repartition("path").groupBy("task", "path").agg(F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_set("src")).alias("seeds"), F.bool_or("match").alias("match"), F.bool_or("known").alias("known"))
    firm = F.col("match") | F.array_contains("kinds", "type") | (F.array_contains("kinds", "import") & (F.size("seeds") >= 2))
    reason = F.concat(F.lit("Graph expansion: local import/type edge from high-confidence seed(s) "), F.array_join(F.slice("seeds", 1, 3), ", "), F.lit("."))
    return g.where(~F.col("known") & firm).select("task", "path", F.lit(EXPAND_AT).alias("confidence"), reason.alias("reason"))


def stub_neighbours(ranked: DataFrame, links: DataFrame) -> DataFrame:
    """(task, anchor, path): per ranked path the first type links, by name, that the task lacks.

    ``ranked``: task, path; ``links``: src, dst."""
    near = ranked.select("task", F.col("path").alias("anchor")).join(links.select(F.col("src").alias("anchor"), F.col("dst").alias("path")).distinct(), "anchor")
    new = near.join(ranked.select("task", "path"), ["task", "path"], "left_anti")
    return top(new, ["task", "anchor"], [F.asc("path")], STUBS_PER_ANCHOR, "_r").select("task", "anchor", "path")


def test_links(sources: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, source): tests that import a source, or share a word with it.

    ``sources`` and ``tests``: path, words; ``edges``: src, dst (imports).  Words are joined, so a test
    meets only sources with which it shares one."""
    s = sources.select(F.col("path").alias("source"), F.explode("words").alias("word"))
    t = tests.select(F.col("path").alias("test"), F.explode("words").alias("word"))
    alike = t.join(s, "word").select("test", "source")
    return alike.unionByName(_imported(sources, tests, edges).select("test", "source")).where("test <> source").distinct()


def _imported(sources: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, source, apart): imports from tests to sources, and whether they share no word."""
    t, s = tests.select(F.col("path").alias("test"), F.col("words").alias("_t")), sources.select(F.col("path").alias("source"), F.col("words").alias("_s"))
    return edges.select(F.col("src").alias("test"), F.col("dst").alias("source")).distinct().join(t, "test").join(s, "source").select("test", "source", (~F.coalesce(F.arrays_overlap("_t", "_s"), F.lit(False))).alias("apart"))


def test_counts(sources: DataFrame, tests: DataFrame, edges: DataFrame) -> DataFrame:
    """(test, sources, first): the number of ``test_links`` of each test that has any, and the first by name.

    No path is in both.  Tests with the same words are counted once, without their pairs; imports
    count where no word is shared.  ``words`` hold no null."""
    t = tests.select(F.col("path").alias("test"), F.array_sort(F.array_distinct("words")).alias("qid"))
    some = sharing(sources.select(F.col("path").alias("doc"), "words"), t.select("qid").where("size(qid) > 0").distinct())
    alike = t.join(some, "qid").select("test", "n", "first")
    by_import = _imported(sources, tests, edges).where("apart").select("test", F.lit(1).cast("bigint").alias("n"), F.col("source").alias("first"))
    return alike.unionByName(by_import).groupBy("test").agg(F.sum("n").alias("sources"), F.min("first").alias("first"))
