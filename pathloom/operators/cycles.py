"""Order among tasks: cycles, what gives way to break them, and what doesn't."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.conflicts import split_plans
from pathloom.operators.staging import Stages


def components(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Strongly connected components of more than one node, each sorted; without recursion."""
    out: dict[int, list[int]] = {}
    for s, d in edges:
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    held: list[int] = []
    on: set[int] = set()
    found: list[list[int]] = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        held.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    held.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while True:
                        group.append(held.pop())
                        on.discard(group[-1])
                        if group[-1] == node:
                            break
                    if len(group) > 1:
                        found.append(sorted(group))
    return found


def _components_of_plan(part: pd.DataFrame) -> pd.DataFrame:
    found = components(list(zip(part["src"].tolist(), part["dst"].tolist())))
    rows = [(n, g[-1]) for g in found for n in g]
    column = lambda values, kind: pd.Series(values, dtype=kind)  # noqa: E731 - also of no rows
    return pd.DataFrame({"plan": column([part["plan"].iloc[0]] * len(rows), "object"), "node": column([r[0] for r in rows], "int64"), "scc": column([r[1] for r in rows], "int64")})


def _large_components(edges: DataFrame, stages: Stages) -> DataFrame | None:
    """As ``strong_components``, by passes over all edges: nodes that nothing leads to or that lead
    nowhere go; every node takes the greatest one that reaches it (its colour); those that reach
    their colour's own node backwards inside the colour are its component."""
    rest = stages.put(edges.where("src <> dst"), "rest")
    out: DataFrame | None = None
    while True:
        n = rest.count()
        while n:
            inner = rest.select("plan", F.col("src").alias("node")).intersect(rest.select("plan", F.col("dst").alias("node")))
            trimmed = rest.join(inner.withColumnRenamed("node", "src"), ["plan", "src"], "left_semi").join(inner.withColumnRenamed("node", "dst"), ["plan", "dst"], "left_semi")
            trimmed = stages.put(trimmed.select("plan", "src", "dst"), "rest")
            stages.drop(rest)
            rest, before, n = trimmed, n, trimmed.count()
            if n == before:
                break
        if not n:
            return out
        nodes = rest.select("plan", F.col("src").alias("node")).distinct()
        colour = stages.put(nodes.withColumn("scc", F.col("node")).withColumn("moved", F.lit(True)), "colour")
        while not colour.where("moved").isEmpty():
            arriving = rest.join(colour.select("plan", F.col("node").alias("src"), "scc"), ["plan", "src"]).groupBy("plan", F.col("dst").alias("node")).agg(F.max("scc").alias("up"))
            new = colour.join(arriving, ["plan", "node"], "left").select("plan", "node", F.greatest("scc", "up").alias("scc"), (F.col("up") > F.col("scc")).alias("moved"))
            new = stages.put(new, "colour")
            stages.drop(colour)
            colour = new
        ends = lambda c: colour.select("plan", F.col("node").alias(c), "scc")
        inside = stages.put(rest.join(ends("src"), ["plan", "src"]).join(ends("dst"), ["plan", "dst", "scc"]).select("plan", "scc", "src", "dst"), "inside")
        reached = stages.put(colour.where("node = scc").select("plan", "scc", "node"), "reached")
        size, before = reached.count(), 0
        while size > before:
            more = inside.join(reached.withColumnRenamed("node", "dst"), ["plan", "scc", "dst"]).select("plan", "scc", F.col("src").alias("node"))
            new = stages.put(reached.unionByName(more).distinct(), "reached")
            stages.drop(reached)
            reached, before, size = new, size, new.count()
        several = reached.groupBy("plan", "scc").count().where("count > 1").drop("count")
        found = reached.join(several, ["plan", "scc"], "left_semi").select("plan", "node", "scc")
        out = found if out is None else out.unionByName(found)
        gone = reached.select("plan", "node")
        rest = stages.put(rest.join(gone.withColumnRenamed("node", "src"), ["plan", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["plan", "dst"], "left_anti").select("plan", "src", "dst"), "rest")


def strong_components(edges: DataFrame) -> DataFrame:
    """(plan, node, scc): the nodes that reach each other, ``scc`` being the greatest of them; nodes
    by themselves have no row.

    ``edges``: plan, src, dst (longs).  Plans that one task can hold are handled in one each,
    larger ones by passes over all their edges."""
    stages = Stages(edges.sparkSession, "components")
    e = edges.dropna().select("plan", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    small, large = split_plans(e, stages)
    out = small.groupBy("plan").applyInPandas(_components_of_plan, f"plan {dict(e.dtypes)['plan']}, node long, scc long")
    more = _large_components(large, stages) if large is not None else None
    return out if more is None else out.unionByName(more)


#: Nodes that stand between tasks and those that come after all others, outside and inside a component.
BARRIER, INNER_BARRIER = -1, -2


def task_order(tasks: DataFrame, conflicts: DataFrame, declared: DataFrame) -> DataFrame:
    """(plan, src, dst, weight): what every task waits for, for ``plan_levels``.

    ``tasks``: plan, task (long, 0 or more), last (whether it comes after all tasks that don't);
    ``conflicts`` and ``declared``: plan, src, dst.  Conflicts and "last" give way: where they
    make tasks wait for each other, these form a chain in their order.  Declared edges come
    after that and stay as they are, so a cycle through one is left for ``plan_levels`` to
    refuse.  "Last" goes through barrier nodes (weight 0 into them), so it takes one edge per task
    and not one per pair.
    """
    stages = Stages(tasks.sparkSession, "order")
    t = stages.put(tasks.select("plan", F.col("task").cast("long").alias("task"), F.coalesce("last", F.lit(False)).alias("last")).distinct(), "tasks")
    c = stages.put(conflicts.select("plan", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "conflicts")
    first, last = t.where("NOT last").select("plan", "task"), t.where("last").select("plan", "task")
    wall = F.lit(BARRIER).cast("long")
    soft = c.unionByName(first.select("plan", F.col("task").alias("src"), wall.alias("dst"))).unionByName(last.select("plan", wall.alias("src"), F.col("task").alias("dst")))
    scc = stages.put(strong_components(soft), "components")
    of = lambda k: scc.select("plan", F.col("node").alias(k), F.col("scc").alias(f"{k}_scc"))
    kept = c.join(of("src"), ["plan", "src"], "left").join(of("dst"), ["plan", "dst"], "left").where("src_scc IS NULL OR dst_scc IS NULL OR src_scc <> dst_scc").select("plan", "src", "dst", F.lit(1).alias("weight"))
    nxt = F.lead("node").over(Window.partitionBy("plan", "scc").orderBy("node"))
    chain = scc.where("node >= 0").withColumn("dst", nxt).where("dst IS NOT NULL").select("plan", F.col("node").alias("src"), "dst", F.lit(1).alias("weight"))
    # of two sides of a barrier in a component, tasks inside don't wait for tasks inside
    walled = scc.where(F.col("node") == BARRIER).select("plan", F.col("scc").alias("wall_scc"))
    placed = t.join(walled, "plan", "left").join(scc.withColumnRenamed("node", "task"), ["plan", "task"], "left")
    placed = placed.select("plan", "task", "last", F.coalesce(F.col("scc") == F.col("wall_scc"), F.lit(False)).alias("inside"))
    inner = F.lit(INNER_BARRIER).cast("long")
    into = placed.where("NOT last").select("plan", F.col("task").alias("src"), F.explode(F.when(F.col("inside"), F.array(wall)).otherwise(F.array(wall, inner))).alias("dst"), F.lit(0).alias("weight"))
    onward = placed.where("last").select("plan", F.when(F.col("inside"), inner).otherwise(wall).alias("src"), F.col("task").alias("dst"), F.lit(1).alias("weight"))
    wanted = declared.select("plan", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(1).alias("weight"))
    return kept.unionByName(chain).unionByName(into).unionByName(onward).unionByName(wanted)


def declared_edges(wanted: DataFrame, named: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Declared dependencies as (plan, src, dst), and those on names that no task of the plan has:
    (plan, task, name).  With ``strict`` such a name is an error.

    ``wanted``: plan, task, name (of the task before it); ``named``: plan, task, name.  Null names
    ask for nothing."""
    w = wanted.dropna(subset=["name"])
    edges = w.join(named.select("plan", F.col("task").alias("src"), "name"), ["plan", "name"]).select("plan", "src", F.col("task").alias("dst")).distinct()
    unknown = w.join(named.select("plan", "name"), ["plan", "name"], "left_anti").select("plan", "task", "name")
    if strict and (one := unknown.first()) is not None:
        raise ValueError(f"task {one['task']} of plan {one['plan']!r} depends on unknown {one['name']!r}")
    return edges, unknown
