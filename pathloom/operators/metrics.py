"""Accuracy of predictions, spread over runs, confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages, broadcast_if_small


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def accuracy(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of counts; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def set_counts(predicted: Column, actual: Column) -> list[Column]:
    """tp, fp and fn of two arrays without repeats; a null array is empty."""
    none = F.array().cast("array<string>")
    p, a = F.coalesce(predicted, none), F.coalesce(actual, none)
    return [F.size(F.array_intersect(p, a)).alias("tp"), F.size(F.array_except(p, a)).alias("fp"), F.size(F.array_except(a, p)).alias("fn")]


def pair_accuracy(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Micro counts over (keys, path) of two tables: (keys, tp, fp, fn)."""
    p = predicted.select(*keys, "path").distinct().withColumn("p", F.lit(1))
    a = actual.select(*keys, "path").distinct().withColumn("a", F.lit(1))
    both = p.join(a, [*keys, "path"], "full")
    return both.groupBy(*keys).agg(F.count_if(F.col("p").isNotNull() & F.col("a").isNotNull()).alias("tp"), F.count_if(F.col("a").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def recall_at(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(task, recall, precision) of the first k paths; without truth recall is 1; precision is over k
    whatever the length.  ``ranked``: task, path, rank; ``truth``: task, path; tasks of either count."""
    first = ranked.where(F.col("rank") <= k).select("task", "path").distinct()
    hits = first.join(truth.select("task", "path").distinct(), ["task", "path"]).groupBy("task").agg(F.count(F.lit(1)).alias("hits"))
    sizes = truth.groupBy("task").agg(F.count_distinct("path").alias("size"))
    everyone = ranked.select("task").union(truth.select("task")).distinct()
    t = everyone.join(hits, "task", "left").join(sizes, "task", "left").fillna(0, ["hits", "size"])
    return t.select("task", F.when(F.col("size") == 0, 1.0).otherwise(F.col("hits") / F.greatest("size", F.lit(1))).alias("recall"), (F.col("hits") / k).alias("precision"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample and population deviation, median, linear and nearest-rank percentiles, label.

    One value has no sample deviation: 0.  The label is zero_variance_observation where all
    values are equal, else stochastic."""
    v = F.col(value)
    nearest = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})")
    return df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        F.stddev_pop(v).alias("pstdev"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.975)).alias("p975"),
        nearest.alias("p95_nearest"),
        F.when(F.min(v) == F.max(v), "zero_variance_observation").otherwise("stochastic").alias("variance"),
    )


def _draw(seed: int, parts: list[Column]) -> Column:
    """A number below 2 ** 32 from a hash of ``parts``: the same in every engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap(df: DataFrame, keys: list[str], value: str, order: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """(keys, mean, low, high): the 95 % interval of the mean over resamples of each group.

    Values are numbered by (value, ``order``), so results don't depend on partitions.  Tasks share the
    resamples; a draw is hashed once for all groups and averaged where it is made.  Values stand one
    group after the other, so that a draw finds its value by one number.
    """
    spark = df.sparkSession
    stages = Stages(spark, "bootstrap")
    w = Window.partitionBy(*keys).orderBy(value, *order)
    v = stages.put(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"), (F.row_number().over(w) - 1).cast("long").alias("slot")), "values")
    size = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.avg("value").alias("mean"))
    size = stages.put(size.withColumn("first", F.sum("size").over(Window.orderBy(*keys)) - F.col("size")), "sizes")
    placed = stages.put(v.join(size, keys).select("slot", "first", "size", (F.col("first") + F.col("slot")).alias("place"), "value"), "placed")
    n = placed.count()
    slots, groups, values = (broadcast_if_small(x, n) for x in (placed.select("slot").distinct(), placed.select("slot", "first", "size"), placed.select("place", "value")))
    numbers = spark.range(0, resamples, 1, 4 * spark.sparkContext.defaultParallelism).withColumnRenamed("id", "resample")
    drawn = numbers.crossJoin(slots).select("resample", "slot", _draw(seed, [F.col("resample"), F.col("slot")]).alias("draw"))
    picked = drawn.join(groups, "slot").select("resample", "first", (F.col("first") + F.col("draw") % F.col("size")).alias("place"))
    means = picked.join(values, "place").groupBy("first", "resample").agg(F.avg("value").alias("m"))
    ends = means.groupBy("first").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return size.join(ends, "first").select(*keys, "mean", "low", "high")


def paired_bootstrap(df: DataFrame, unit: str, arm: str, value: str, a: str, b: str, resamples: int, seed: int = 0) -> DataFrame:
    """(mean, low, high) of value(a) - value(b) over the units that have both."""
    one = df.where(F.col(arm) == a).groupBy(unit).agg(F.avg(value).alias("va"))
    two = df.where(F.col(arm) == b).groupBy(unit).agg(F.avg(value).alias("vb"))
    diffs = one.join(two, unit).select(F.lit(1).alias("g"), unit, F.round(F.col("va") - F.col("vb"), 6).alias("d"))
    return bootstrap(diffs, ["g"], "d", [unit], resamples, seed).drop("g")


def paired_bootstraps(df: DataFrame, unit: str, arm: str, value: str, resamples: int, seed: int = 0) -> DataFrame:
    """(a, b, mean, low, high) of value(a) - value(b) for every two arms, a before b by name, over the
    units that have both; a pair that shares fewer than two units has no row."""
    means = Stages(df.sparkSession, "arms").put(df.groupBy(unit, arm).agg(F.avg(value).alias("x")), "means")
    one, two = (means.select(unit, F.col(arm).alias(k), F.col("x").alias(f"v{k}")) for k in "ab")
    diffs = one.join(two, unit).where("a < b").select("a", "b", unit, F.round(F.col("va") - F.col("vb"), 6).alias("d"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("a", "b"))
    return bootstrap(diffs.withColumn("shared", shared).where("shared >= 2"), ["a", "b"], "d", [unit], resamples, seed)


def deltas(df: DataFrame, keys: list[str], arm: str, baseline: str, value: str) -> DataFrame:
    """Each row with its difference to the baseline arm of the same keys; null where there is none."""
    base = df.where(F.col(arm) == baseline).select(*keys, F.col(value).alias("baseline"))
    return df.join(base, keys, "left").withColumn("delta", F.col(value) - F.col("baseline"))
