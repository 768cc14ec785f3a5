"""Patterns among paths and words: templates with one wildcard, words that are nearly alike."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: likeness from which words count as alike.
ALIKE = 85.0


def path_templates(files: DataFrame, least: int = 2) -> DataFrame:
    """(template, members): paths with one run of folders replaced by ``*``, for templates that
    ``least`` paths or more follow.  ``files``: path.  Work is quadratic in the depth of a path only."""
    parts = F.split("path", "/")
    p = files.select("path").where("path IS NOT NULL").distinct().select("path", parts.alias("parts"), (F.size(parts) - 1).alias("depth")).where("depth >= 1")
    spans = p.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("depth") - 1))).withColumn("end", F.explode(F.sequence(F.col("start"), F.col("depth") - 1)))
    head, tail = F.slice("parts", F.lit(1), F.col("start")), F.slice("parts", F.col("end") + 2, F.size("parts") - F.col("end") - 1)
    t = spans.select("path", F.array_join(F.concat(head, F.array(F.lit("*")), tail), "/").alias("template")).distinct()
    return t.groupBy("template").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)


def lcs_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(a: Column, b: Column) -> Column:
    """100 for equal words, less for each letter to insert or delete; in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([200.0 * lcs_length(p, q) / (len(p) + len(q)) if p or q else 100.0 for p, q in zip(x, y)])

    return ratio(a, b)


def alike(asked: DataFrame, known: DataFrame, least: float = ALIKE) -> DataFrame:
    """(word, other, ratio): known words at least ``least`` like an asked one.

    ``asked`` and ``known``: word.  Words so alike differ by few letters put in or taken out, k at
    most for a length; of k + 1 pieces of the one word, one stands whole in the other.  So words
    are joined by pieces, and only those that share one and fit in length are compared."""
    a = asked.where("word <> ''").select("word").distinct()
    bound = least / (200.0 - least)
    n = F.length("word")
    edits = F.floor((1 - least / 100.0) * (n + F.floor(n / bound)) + 1e-9).cast("int")
    pieces = a.withColumn("n", n).withColumn("parts", F.least(edits + 1, n)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.expr("cast(floor(n * i / parts) as int)"), F.expr("cast(floor(n * (i + 1) / parts) as int)")
    pieces = pieces.select("word", F.substring("word", lo + 1, hi - lo).alias("piece"), (hi - lo).alias("size")).distinct()
    sizes = F.broadcast(pieces.select("size").distinct())  # lengths of pieces: a few small numbers
    k = known.where("word <> ''").select(F.col("word").alias("other")).distinct()
    inside = k.join(sizes, F.length("other") >= F.col("size")).select("other", F.explode(F.expr("array_distinct(transform(sequence(1, length(other) - size + 1), p -> substring(other, p, size)))")).alias("piece"))
    low, high = F.ceil(F.length("word") * bound - 1e-9), F.floor(F.length("word") / bound + 1e-9)
    met = inside.join(pieces.select("word", "piece"), "piece").where(F.length("other").between(low, high)).select("word", "other").distinct()
    return met.withColumn("ratio", likeness(F.col("word"), F.col("other"))).where(F.col("ratio") >= least).select("word", "other", "ratio")


def break_even(overhead: Column, saving: Column) -> Column:
    """Tasks from which a saving per task pays for an overhead: 0 if there is none to pay, infinite
    if nothing is saved."""
    return F.when(overhead <= 0, 0.0).when(saving <= 0, math.inf).otherwise(overhead / saving)
