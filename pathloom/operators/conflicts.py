"""Tasks whose write sets meet: edges, order, levels, burden."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages, broadcast_if_small

#: Edges of a plan up to which it is levelled in one task.
PLAN_EDGES = 200_000


def sharing_pairs(writes: DataFrame) -> DataFrame:
    """Pairs of tasks of one plan that share a path: (plan, i, j, files), i < j, files sorted.

    ``writes``: plan, task, path; repeats count once, nulls never.  The join is on (plan, path);
    AQE splits paths that very many tasks share.
    """
    w = writes.dropna(subset=["plan", "task", "path"]).select("plan", "task", "path").distinct()
    a, b = w.withColumnRenamed("task", "i"), w.withColumnRenamed("task", "j")
    return a.join(b, ["plan", "path"]).where("i < j").groupBy("plan", "i", "j").agg(F.array_sort(F.collect_set("path")).alias("files"))


def conflict_degrees(pairs: DataFrame) -> DataFrame:
    """(plan, task, degree): how many tasks each one shares paths with."""
    ends = pairs.select("plan", F.explode(F.array("i", "j")).alias("task"))
    return ends.groupBy("plan", "task").agg(F.count(F.lit(1)).alias("degree"))


def conflict_edges(writes: DataFrame) -> DataFrame:
    """(plan, predecessor, successor, files): of two tasks that share paths the one with fewer
    conflicts goes first, then the one with the lower index (``task`` is the index)."""
    pairs = sharing_pairs(writes)
    degrees = conflict_degrees(pairs.select("plan", "i", "j"))
    di = degrees.select("plan", F.col("task").alias("i"), F.col("degree").alias("di"))
    dj = degrees.select("plan", F.col("task").alias("j"), F.col("degree").alias("dj"))
    first = F.col("di") <= F.col("dj")  # i < j decides equal degrees
    turned = pairs.select("plan", "i", "j").join(di, ["plan", "i"]).join(dj, ["plan", "j"]).select("plan", "i", "j", first.alias("first"))
    both = turned.join(pairs, ["plan", "i", "j"])
    return both.select("plan", F.when(F.col("first"), F.col("i")).otherwise(F.col("j")).alias("predecessor"), F.when(F.col("first"), F.col("j")).otherwise(F.col("i")).alias("successor"), "files")


def conflict_order(writes: DataFrame) -> DataFrame:
    """``conflict_edges`` as (plan, src, dst), for plans that don't ask which files are shared."""
    w = writes.dropna(subset=["plan", "task", "path"]).select("plan", "task", "path").distinct()
    pairs = w.withColumnRenamed("task", "i").join(w.withColumnRenamed("task", "j"), ["plan", "path"]).where("i < j").select("plan", "i", "j").distinct()
    degrees = conflict_degrees(pairs)
    both = pairs.join(degrees.select("plan", F.col("task").alias("i"), F.col("degree").alias("di")), ["plan", "i"]).join(degrees.select("plan", F.col("task").alias("j"), F.col("degree").alias("dj")), ["plan", "j"])
    first = F.col("di") <= F.col("dj")
    return both.select("plan", F.when(first, F.col("i")).otherwise(F.col("j")).alias("src"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("dst"))


def peers(writes: DataFrame) -> DataFrame:
    """(plan, task, peers): the tasks that each one shares paths with, sorted; empty if none."""
    pairs = sharing_pairs(writes)
    both = pairs.select("plan", F.explode(F.array(F.struct(F.col("i").alias("task"), F.col("j").alias("peer")), F.struct(F.col("j").alias("task"), F.col("i").alias("peer")))).alias("e")).select("plan", "e.*")
    found = both.groupBy("plan", "task").agg(F.array_sort(F.collect_set("peer")).alias("peers"))
    everyone = writes.dropna(subset=["plan", "task"]).select("plan", "task").distinct()
    kind = dict(everyone.dtypes)["task"]
    return everyone.join(found, ["plan", "task"], "left").withColumn("peers", F.coalesce("peers", F.array().cast(f"array<{kind}>")))


def burden(writes: DataFrame) -> DataFrame:
    """Per plan: mentions, unique files, duplicate touches and files touched more than once."""
    per = writes.dropna(subset=["plan", "path"]).groupBy("plan", "path").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("plan").agg(
        F.sum("n").alias("mentions"),
        F.count(F.lit(1)).alias("unique_files"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
        F.count_if(F.col("n") >= 2).alias("overlapping_files"),
    )


def split_plans(edges: DataFrame, stages: Stages) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges of plans that one task can hold, and those of larger plans (None: there are none)."""
    e = stages.put(edges.distinct(), "edges")
    large = stages.put(e.groupBy("plan").count().where(F.col("count") > PLAN_EDGES).select("plan"), "large")
    if large.isEmpty():
        return e, None
    few = broadcast_if_small(large)
    return e.join(few, "plan", "left_anti"), e.join(few, "plan", "left_semi")


def _levels_of_plan(edges: pd.DataFrame) -> pd.DataFrame:
    from collections import defaultdict

    out, waiting = defaultdict(list), defaultdict(int)
    nodes = set(edges["src"]) | set(edges["dst"].dropna())
    for s, d, w in zip(edges["src"], edges["dst"], edges["weight"]):
        if d == d and d is not None:
            out[s].append((d, int(w)))
            waiting[d] += 1
    level = {n: 0 for n in nodes if not waiting[n]}
    queue = list(level)
    for n in queue:
        for d, w in out[n]:
            level[d] = max(level.get(d, 0), level[n] + w)
            waiting[d] -= 1
            if not waiting[d]:
                queue.append(d)
    if len(queue) < len(nodes):
        raise ValueError(f"cycle among the tasks of plan {edges['plan'].iloc[0]!r}")
    kept = [n for n in queue if n >= 0]
    return pd.DataFrame({"plan": edges["plan"].iloc[0], "task": [int(n) for n in kept], "level": [level[n] for n in kept]})


def plan_levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, task, level): the length of the longest path of predecessors.

    ``tasks``: plan, task (long, 0 or more).  ``edges``: plan, src, dst and, if they don't all count
    1, weight; nodes below 0 are barriers between tasks and have no rows.  A plan of up to
    PLAN_EDGES edges is levelled in one task; larger ones by relaxing all their edges in
    parallel until nothing changes.  A cycle is an error.
    """
    stages = Stages(tasks.sparkSession, "levels")
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    small, large = split_plans(edges.select("plan", "src", "dst", weight.cast("int").alias("weight")), stages)
    every = tasks.select("plan", F.col("task").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(0).alias("weight")).distinct()
    if large is not None:
        many = broadcast_if_small(large.select("plan").distinct())
        lone, every = every.join(many, "plan", "left_semi"), every.join(many, "plan", "left_anti")
    out = every.unionByName(small).groupBy("plan").applyInPandas(_levels_of_plan, f"plan {dict(tasks.dtypes)['plan']}, task long, level int")
    if large is None:
        return out
    nodes = lone.select("plan", F.col("src").alias("task")).union(large.select("plan", "src")).union(large.select("plan", "dst")).distinct()
    level = stages.put(nodes.withColumn("level", F.lit(0)), "level")
    most = level.count()
    for _ in range(most + 1):
        pushed = large.join(level, (large["plan"] == level["plan"]) & (large["src"] == level["task"])).select(large["plan"], F.col("dst").alias("task"), (F.col("level") + F.col("weight")).alias("up")).groupBy("plan", "task").agg(F.max("up").alias("up"))
        new = level.join(pushed, ["plan", "task"], "left").select("plan", "task", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved"))
        new = stages.put(new, "level")
        stages.drop(level)
        moved = not new.where("moved").isEmpty()
        level = new.drop("moved")
        level._stage_path = new._stage_path
        if not moved:
            return out.unionByName(level.where("task >= 0").withColumn("level", F.col("level").cast("int")))
    raise ValueError("cycle among the tasks of a large plan")


def groups(levels: DataFrame) -> DataFrame:
    """Execution groups: (plan, group_id, tasks, type, waits_for).  Tasks of a level form a group;
    those alone in a later level are serial; a group waits for the one before."""
    g = levels.groupBy("plan", "level").agg(F.array_sort(F.collect_list("task")).alias("tasks"))
    ranked = g.withColumn("group_id", F.row_number().over(Window.partitionBy("plan").orderBy("level")))
    kind = F.when((F.size("tasks") > 1) | (F.col("level") == 0), "parallel").otherwise("serial")
    return ranked.select("plan", "group_id", "tasks", kind.alias("type"), F.when(F.col("group_id") > 1, F.array(F.col("group_id") - 1)).otherwise(F.array().cast("array<int>")).alias("waits_for"))


def concurrent_pairs(order: DataFrame, pairs: DataFrame, parallelism: list[int]) -> DataFrame:
    """(plan, parallelism, pairs): conflicting pairs that run together if tasks go in batches of
    each size, first come first served.  ``order``: plan, task, place (from 0); ``pairs``: plan, i, j."""
    a = order.select("plan", F.col("task").alias("i"), F.col("place").alias("pi"))
    b = order.select("plan", F.col("task").alias("j"), F.col("place").alias("pj"))
    placed = pairs.select("plan", "i", "j").join(a, ["plan", "i"]).join(b, ["plan", "j"])
    sizes = [F.struct(F.lit(n).alias("parallelism"), (F.floor(F.col("pi") / n) == F.floor(F.col("pj") / n)).cast("long").alias("hit")) for n in parallelism]
    return placed.select("plan", F.explode(F.array(*sizes)).alias("s")).groupBy("plan", "s.parallelism").agg(F.sum("s.hit").alias("pairs"))
