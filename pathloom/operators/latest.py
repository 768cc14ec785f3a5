"""The latest row of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.staging import BROADCAST_ROWS, Stages


def latest(df: DataFrame, keys: list[str], time_col: str, ties: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the latest ``time_col``.

    Rows whose time is null are older than all others.  Equal times are decided by the
    ``ties`` columns, descending with nulls last.  Null keys are a key like any other.  The
    plan is a row_number filter, so each map task passes at most one row per key on: a key
    that holds much of the table does not meet in one task.
    """
    order = [F.col(time_col).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in ties or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    place = "_place"
    while place in df.columns:
        place += "_"
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def latest_of_few_repeats(df: DataFrame, keys: list[str], time_col: str, ties: list[str] | None = None, stages: Stages | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``latest`` for tables in which few keys are repeated and rows are wide.

    Only the keys are shuffled to find the repeated ones.  Where these are at most ``limit``
    they are broadcast, their rows alone go through ``latest`` and the rest stays in place;
    beyond that all rows go through ``latest``.  Rows with a null in a key are dropped.
    """
    whole = df.dropna(subset=keys)
    stages = stages or Stages(df.sparkSession, "latest")
    repeated = stages.put(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys), "repeated")
    n = repeated.count()
    if n == 0:
        return whole
    if n > limit:
        return latest(whole, keys, time_col, ties)
    few = F.broadcast(repeated)
    again = latest(whole.join(few, keys, "left_semi"), keys, time_col, ties)
    return whole.join(few, keys, "left_anti").select(*df.columns).unionByName(again.select(*df.columns))
