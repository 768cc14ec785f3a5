"""Authorising a stream of proposed writes.  An extension: contracts are a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.paths import glob_matches, lexical_path


def verdicts(proposals: DataFrame, contracts: DataFrame) -> DataFrame:
    """(ts, task_id, path, allowed, reason) of each proposal, as it arrives.

    ``proposals``: ts, task_id, path (a stream or a table); ``contracts``: task_id, allowed_paths."""
    n = lexical_path(F.col("path"))
    j = proposals.join(contracts.select("task_id", "allowed_paths"), "task_id", "left").withColumn("n", n)
    hit = F.exists(F.col("allowed_paths"), lambda p: F.coalesce(glob_matches(p, F.col("n.path")), F.lit(False)))
    allowed = F.coalesce(hit, F.lit(False))
    reason = F.when(F.col("allowed_paths").isNull(), "no contract").when(F.col("n.escapes"), "escapes repository root").when(~allowed, "outside allowed paths")
    return j.select("ts", "task_id", "path", allowed.alias("allowed"), reason.alias("reason"))


def blocked_per_window(v: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, task_id, proposed, blocked) per window of event time; rows later than ``late`` are
    dropped by a stream, as its watermark says."""
    w = v.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "task_id")
    return w.agg(F.count(F.lit(1)).alias("proposed"), F.count_if(~F.col("allowed")).alias("blocked")).select(F.col("w.start").alias("start"), "task_id", "proposed", "blocked")
