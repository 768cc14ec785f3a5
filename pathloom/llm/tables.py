"""The test tables as the problems of training data see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions.text import plain_name
from pathloom.operators.latest import latest_of_few_repeats
from pathloom.operators.staging import Stages


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(*values: Column, names: list[str]) -> list[Column]:
    """128 bits that tell values apart, as two longs; nulls count as values of their own."""
    marked = [x for v in values for x in (v.isNull(), v)]
    return [F.xxhash64(F.lit(i), *marked).alias(n) for i, n in enumerate(names)]


def latest_eval_tasks(spark: SparkSession, sf_dir: str, columns: list[str], ties: list[str], stages: Stages) -> DataFrame:
    """eval_tasks, latest by (run_id, task_id) on ingested_at; rows without a key can't have a run."""
    rows = read(spark, sf_dir, "eval_tasks").selectExpr("run_id", "task_id", "ingested_at", *columns)
    return latest_of_few_repeats(rows, ["run_id", "task_id"], "ingested_at", ties, stages)


def plain_strategy(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", plain_name(F.col("strategy")).alias("strategy"))
