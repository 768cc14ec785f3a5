"""Files linked by the symbols that they name and define, without a row per pair of files.

A file that names a symbol n times leads, with weight n, to every other file that defines it.  A
symbol may be named and defined by a third of all files, so these edges are never made: what
flows through a symbol is summed at the symbol and shared out from there, less what a definer
sent itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.ranking import ALPHA, MAX_ITERATIONS, TOLERANCE
from pathloom.operators.staging import Stages

# ---- fixed values that results depend on --------------------------------------------------------

DEFINITION_CAP, REFERENCE_CAP = 0.82, 0.74

# -------------------------------------------------------------------------------------------------


def _through(references: DataFrame, defined: DataFrame, value: str) -> DataFrame:
    """(file, arriving): what arrives at each definer if references (file, symbol, own symbol
    amount in ``value``) send it to all definers of the symbol but the sender."""
    sums = references.groupBy("symbol").agg(F.sum(value).alias("all"))
    own = references.select("file", "symbol", F.col(value).alias("own"))
    at = defined.join(sums, "symbol").join(own, ["file", "symbol"], "left")
    return at.groupBy("file").agg(F.sum(F.col("all") - F.coalesce("own", F.lit(0.0))).alias("arriving"))


def definer_weights(references: DataFrame, defined: DataFrame) -> DataFrame:
    """(file, weight): how often other files name what a file defines.

    ``references``: file, symbol, n, one row each; ``defined``: file, symbol."""
    d = defined.select("file", "symbol").distinct()
    return _through(references.withColumn("n", F.col("n").cast("double")), d, "n").where("arriving > 0").select("file", F.col("arriving").alias("weight"))


def symbol_pagerank(files: DataFrame, references: DataFrame, defined: DataFrame, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(file, rank): personalised PageRank over the links by symbols.

    ``files``: file, weight (of its restarts); ``references`` and ``defined`` as in ``definer_weights``, of
    these files.  Rank of files that name nothing others define goes to the restarts.  An
    iteration shuffles a number per (file, symbol) that is named and defined, and no pairs.
    """
    stages = Stages(files.sparkSession, "symbols")
    total = files.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    n, weight = total["n"], total["w"] or 1.0
    if not n:
        return files.select("file", F.lit(0.0).alias("rank"))
    d = defined.select("file", "symbol").distinct()
    definers = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("definers"))
    known = references.join(definers, "symbol").join(d.withColumn("mine", F.lit(1)), ["file", "symbol"], "left")
    named = stages.put(known.select("file", "symbol", F.col("n").cast("double").alias("n"), (F.col("definers") - F.coalesce("mine", F.lit(0))).alias("others")), "named")
    d = stages.put(d.join(named.select("symbol").distinct(), "symbol", "left_semi"), "defined")
    out = named.groupBy("file").agg(F.sum(F.col("n") * F.col("others")).alias("out")).where("out > 0")
    flow = stages.put(named.where("others > 0").join(out, "file").select("file", "symbol", (F.col("n") / F.col("out")).alias("share")), "flow")
    base = files.select("file", (F.col("weight") / weight).alias("p")).join(out.select("file", F.lit(True).alias("leads")), "file", "left")
    rank = stages.put(base.select("file", "p", F.coalesce("leads", F.lit(False)).alias("leads"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("moved")), "rank")
    for _ in range(iterations or MAX_ITERATIONS):
        lost = rank.where("NOT leads").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("x")).first()["x"]
        sent = flow.join(rank.select("file", "rank"), "file").select("file", "symbol", (F.col("rank") * F.col("share")).alias("v"))
        new = rank.join(_through(sent, d, "v"), "file", "left")
        value = F.col("p") * (1 - ALPHA + ALPHA * lost) + ALPHA * F.coalesce("arriving", F.lit(0.0))
        new = stages.put(new.select("file", "p", "leads", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved")), "rank")
        stages.drop(rank)
        rank = new
        if iterations is None and rank.agg(F.sum("moved")).first()[0] < n * tolerance:
            break
    return rank.select("file", "rank")


def entity_files(scored: DataFrame, defined: DataFrame, references: DataFrame, n: int) -> DataFrame:
    """(qid, file, confidence, rank): the ``n`` surest files of each query by the symbols that fit it.

    ``scored``: qid, doc (the symbol), score; ``defined``: file, symbol; ``references``: file, symbol.
    A file that defines a symbol is surer than one that names it; of a file's symbols the surest
    counts."""
    from pathloom.operators.ranking import top

    near = lambda cap: F.greatest(F.lit(0.5), F.least(F.lit(cap), F.lit(cap) - 1.0 / (F.col("score") + 3.0)))
    s = scored.select("qid", F.col("doc").alias("symbol"), "score").where("score > 0")
    one = defined.select("file", "symbol").distinct().join(s, "symbol").select("qid", "file", near(DEFINITION_CAP).alias("c"))
    two = references.select("file", "symbol").distinct().join(s, "symbol").select("qid", "file", near(REFERENCE_CAP).alias("c"))
    best = one.unionByName(two).groupBy("qid", "file").agg(F.max(F.round("c", 6)).alias("confidence"))
    return top(best, ["qid"], [F.desc("confidence"), F.asc("file")], n)
