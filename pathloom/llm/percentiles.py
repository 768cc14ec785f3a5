"""Percentiles of very large numeric columns by exact bisection.

The first pass counts every group's values in the cells of one fixed grid (``GRID`` to an
octave), with the smallest and largest value in each.  These counts add up: those of days,
partitions or tables made apart give the counts of all, and bound every percentile without
another look at the rows.

For every wanted order statistic that leaves an interval [lo, hi].  A pass then counts, for each
interval, how many rows fall below each of ``points`` midpoints and keeps the part that holds
the wanted rank, shrunk to the smallest and largest value in it.  It ends when that part holds
one value (exact) or is no wider than ``tolerance``.  No pass moves rows, only counts; rows
outside all intervals are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tables import ident
from pathloom.operators.staging import Stages, broadcast_if_small

#: Cells of the grid to an octave; midpoints of a later pass and interval.
GRID, POINTS = 16, 63
#: Above all codes of finite values, below none: log2 of a double is between -1074 and 1024.
_SHIFT, _INFINITE = 1100 * GRID, 3000 * GRID
_G = ["g0", "g1"]


def grid_cell(x: Column) -> Column:
    """The cell of a value: monotone in it, the same for all tables."""
    size = F.when(F.abs(x) == F.lit(float("inf")), F.lit(_INFINITE)).otherwise(F.floor(F.log2(F.abs(x)) * GRID).cast("int") + _SHIFT)
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def value_cells(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(``keys``, cell, n, low, high): counts that can be kept instead of the rows and added up later.

    Null and NaN values don't count.  A group has a few ten thousand cells at most, whatever its
    rows."""
    x = F.col(value).cast("double")
    kept = rows.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("_x"))
    return kept.groupBy(*keys, grid_cell(F.col("_x")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))


def merge_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of several tables (their union) or of finer groups as cells of ``keys``."""
    return cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _ranks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with ``below``, the values in lower ones, and ``total``; a window over a group's cells."""
    w = Window.partitionBy(*keys)
    return cells.withColumn("below", F.sum("n").over(w.orderBy("cell")) - F.col("n")).withColumn("total", F.sum("n").over(w))


def bounded_percentiles(cells: DataFrame, keys: list[str], pcts: list[float]) -> DataFrame:
    """(``keys``, pct, n, low, high) of merged cells: the percentile lies from low to high.

    Between two order statistics it is interpolated linearly, so the bounds are those of both;
    they differ by a factor of 2 ** (1 / GRID) at most where both are in one cell."""
    at = _ranks(cells, keys).withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts]))).withColumn("pos", F.col("pct") / 100 * (F.col("total") - 1))
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    k0, k1, f = F.floor("pos"), F.ceil("pos"), F.col("pos") - F.floor("pos")
    pick = lambda c, k: F.max(F.when(holds(k), F.col(c)))
    ends = at.groupBy(*keys, "pct", F.col("total").alias("_t")).agg(*[pick(c, k).alias(f"_{c}{i}") for c in ("low", "high") for i, k in ((0, k0), (1, k1))], F.max(f).alias("_f"))
    mid = lambda c: F.when(F.col(f"_{c}0") == F.col(f"_{c}1"), F.col(f"_{c}0")).otherwise(F.col(f"_{c}0") + (F.col(f"_{c}1") - F.col(f"_{c}0")) * F.col("_f"))
    return ends.select(*keys, "pct", F.col("_t").alias("n"), mid("low").alias("low"), mid("high").alias("high"))


def order_statistics(rows: DataFrame, targets: DataFrame, stages: Stages, points: int = POINTS, tolerance: float = 0.0) -> DataFrame:
    """The values of wanted ranks: (g0, g1, rank, value).

    ``rows``: a group (two longs, g0 and g1) and a double ``x``.  ``targets``: g0, g1, ``rank``,
    ``left`` (the rank within the interval, from 0), the interval [lo, hi], all of one sign, and
    ``n``, the rows in it.  Equal rows count each.
    """
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    closed = (F.col("lo") == F.col("hi")) | (F.col("hi") - F.col("lo") <= F.lit(float(tolerance)))
    state = stages.put(targets.select(*_G, "rank", "left", "lo", "hi", "n", closed.alias("closed")), "intervals")
    done: DataFrame | None = None
    active, held = rows.select(*_G, "x"), None
    while True:
        ended = state.where("closed").select(*_G, "rank", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") / 2 + F.col("hi") / 2).alias("value"))
        done = ended if done is None else done.unionByName(ended)
        spans = state.where("NOT closed").select(*_G, "lo", "hi", "n").distinct()
        left = spans.agg(F.count(F.lit(1)).alias("spans"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if not left["spans"]:
            return done
        # intervals of one group are the same or don't meet, so a row is in one at most
        known = broadcast_if_small(spans.drop("n"), left["spans"])
        if held is None or left["rows"] < held / 2:
            before = active
            active, held = stages.put(active.join(known, _G).where(inside).select(*_G, "x"), "active"), left["rows"]
            stages.drop(before)
        part = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (points + 1)), F.lit(points)).cast("int")
        cells = active.join(known, _G).where(inside).groupBy(*_G, "lo", "hi", part.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo2"), F.max("x").alias("hi2"))
        cells = cells.withColumn("below", F.sum("n").over(Window.partitionBy(*_G, "lo", "hi").orderBy("cell")) - F.col("n"))
        going = state.where("NOT closed").select(*_G, "rank", "left", "lo", "hi")
        hit = going.join(cells, [*_G, "lo", "hi"]).where((F.col("below") <= F.col("left")) & (F.col("left") < F.col("below") + F.col("n")))
        narrowed = hit.select(*_G, "rank", (F.col("left") - F.col("below")).alias("left"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "n")
        state = stages.put(narrowed.withColumn("closed", closed), "intervals")


def percentiles(rows: DataFrame, keys: list[str], value: str, pcts: list[float], points: int = POINTS, tolerance: float = 0.0, totals: tuple[list[str], ...] = ()) -> DataFrame:
    """Percentiles per group with linear interpolation between neighbours: (``keys``, level, pct, n, value).

    ``totals`` names further groupings, each by some of ``keys``; their rows have null in the other
    keys and ``level`` 1, 2 ...; that of ``keys`` is 0.  Their counts are added up from those of
    the groups.  Null and NaN values don't count; a group without any other value has no row.
    Infinite values are values like others (between both infinities lies NaN).  Null keys are a
    group.  An empty table gives an empty result.  Columns other than ``keys`` and ``value`` are
    ignored.  ``tolerance`` bounds the error of an order statistic; 0 is exact.
    """
    stages = Stages(rows.sparkSession, "percentiles")
    x = F.col(value).cast("double")
    base = stages.put(rows.where(x.isNotNull() & ~F.isnan(x)).select(*keys, (x + 0.0).alias("x")), "values")
    fine = stages.put(value_cells(base, keys, "x"), "grid")
    kinds = dict(base.dtypes)
    levels = [list(keys), *totals]

    def names(level: int, at: list[str]) -> list[Column]:
        return [*ident(F.lit(level), *[F.col(k) for k in at], names=_G)]

    parts = []
    for level, at in enumerate(levels):
        cells = fine if level == 0 else merge_cells(fine, at)
        shown = [F.col(k) if k in at else F.lit(None).cast(kinds[k]).alias(k) for k in keys]
        parts.append(cells.select(*names(level, at), F.lit(level).alias("level"), *shown, "cell", "n", "low", "high"))
    cells = parts[0]
    for p in parts[1:]:
        cells = cells.unionByName(p)
    cells = stages.put(_ranks(cells, _G), "cells")
    groups = cells.groupBy(*_G).agg(*[F.first(k).alias(k) for k in (*keys, "level")], F.first("total").alias("n"))
    wanted = groups.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
    at = stages.put(wanted.withColumn("pos", F.col("pct") / 100 * (F.col("n") - 1)).withColumn("k0", F.floor("pos")).withColumn("k1", F.ceil("pos")), "wanted")
    ranks = at.select(*_G, F.explode(F.array_distinct(F.array("k0", "k1"))).alias("rank")).distinct()
    targets = ranks.join(cells.select(*_G, "below", "n", "low", "high"), _G).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    targets = targets.select(*_G, "rank", (F.col("rank") - F.col("below")).alias("left"), F.col("low").alias("lo"), F.col("high").alias("hi"), "n")
    # a row belongs to its group and to each of the further groupings
    of = F.explode(F.array(*[F.struct(*names(level, a)) for level, a in enumerate(levels)]))
    found = stages.put(order_statistics(base.select("x", of.alias("g")).select("x", "g.*"), targets, stages, points, tolerance), "found")
    stages.keep(at, found)
    lower = found.select(*_G, F.col("rank").alias("k0"), F.col("value").alias("v0"))
    upper = found.select(*_G, F.col("rank").alias("k1"), F.col("value").alias("v1"))
    out = at.join(lower, [*_G, "k0"]).join(upper, [*_G, "k1"])
    between = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("k0")))
    return out.select(*keys, "level", "pct", "n", between.alias("value"))
