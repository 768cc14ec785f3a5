"""Joining intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of rows of equal ``keys`` whose [lo, hi] overlap, ends included: (keys, left_id, right_id).

    Both tables: keys, id, lo, hi (numbers).  Intervals are cut into buckets of ``width``, so that
    a key with very many intervals is spread over tasks; a pair that meets in several buckets is
    given in the first of them only.  Rows with a null end or lo > hi overlap nothing.
    """

    def cut(df: DataFrame, side: str) -> DataFrame:
        good = df.where("lo IS NOT NULL AND hi IS NOT NULL AND lo <= hi")
        first, last = F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)
        return good.select(*keys, F.col("id").alias(f"{side}_id"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"), first.alias(f"{side}_first"), F.explode(F.sequence(first, last)).alias("bucket"))

    met = cut(left, "left").join(cut(right, "right"), [*keys, "bucket"])
    hit = (F.col("left_lo") <= F.col("right_hi")) & (F.col("right_lo") <= F.col("left_hi")) & (F.col("bucket") == F.greatest("left_first", "right_first"))
    return met.where(hit).select(*keys, "left_id", "right_id")
