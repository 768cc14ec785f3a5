"""Top N items within every group by simultaneous bisection.

Items have an order-preserving code: the score, then the identifier.  A pass splits the
interval of codes that each group is still unsure about at midpoints, counts the items in
each part, takes the parts that fit whole and goes on with the one that would overfill the
group.  Scores are split until one score is left, identifiers (as byte strings, behind their
common prefix) until the group holds exactly N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.tables import ident as hashed
from pathloom.operators.staging import Stages, broadcast_if_small

#: Midpoints of a pass and group.
POINTS = 127
#: Buckets in which hot groups are looked for, and the share of all rows from which one is hot.
HOT_BUCKETS, HOT_SHARE = 4096, 0.01
#: Parts into which a hot group is spread.
SALTS = 32
#: Bytes of an identifier that make up a code.
CODE_BYTES = 6
#: Groups are told by 128 bits of hash, so what is known of them has a fixed size.
_G = ["g0", "g1"]


def hot_buckets(items: DataFrame, share: float = HOT_SHARE, buckets: int = HOT_BUCKETS) -> tuple[list[int], list[int]]:
    """The hash buckets of (group, identifier) and of groups that hold more than ``share`` of all
    rows: at most 1 / share of each."""
    of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), of(*_G, "id").alias("b")), F.struct(F.lit(1).alias("k"), of(*_G).alias("b"))))
    counts = items.select(both.alias("x")).groupBy("x.k", "x.b").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts if r["k"])
    return tuple(sorted(r["b"] for r in counts if r["k"] == k and r["n"] > max(share * total, 50_000)) for k in (0, 1))


def best_of_repeats(items: DataFrame) -> DataFrame:
    """One row (g0, g1, g, score, id) per group and identifier, with its highest score; spread by
    group, hot groups over salts."""
    pairs, groups = hot_buckets(items)
    if pairs:  # an identifier sent very often in one group is combined before it travels
        often = F.pmod(F.xxhash64(*_G, "id"), F.lit(HOT_BUCKETS)).isin(pairs)
        first = items.where(often).groupBy(*_G, "id").agg(F.max("score").alias("score"), F.first("g").alias("g")).select(*_G, "g", "id", "score")
        items = items.where(~often).select(*_G, "g", "id", "score").unionByName(first)
    salt = F.lit(0)
    if groups:
        hot = F.pmod(F.xxhash64(*_G), F.lit(HOT_BUCKETS)).isin(groups)
        salt = F.when(hot, F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    spread = items.select(*_G, "g", "id", "score", salt.alias("salt")).repartition(*_G, "salt")
    return spread.groupBy(*_G, "salt", "id").agg(F.max("score").alias("score"), F.first("g").alias("g"))


def _score_cell(score: Column, lo: Column, hi: Column, points: int) -> Column:
    """Part 0 holds the highest scores."""
    f = F.try_divide(hi / 2 - score / 2, hi / 2 - lo / 2)
    return F.coalesce(F.least(F.floor(f * (points + 1)), F.lit(points)), F.lit(0)).cast("int")


def _code(ident: Column, skip: Column) -> Column:
    """The next bytes of an identifier, and whether it ends in them, as a number; order-preserving,
    as strings order by bytes."""
    rest = F.substring(F.encode(ident, "UTF-8"), skip + 1, F.lit(CODE_BYTES + 1))
    first = F.conv(F.rpad(F.hex(F.substring(rest, 1, CODE_BYTES)), 2 * CODE_BYTES, "0"), 16, 10).cast("long")
    return first * 8 + F.length(rest)


def _common(a: Column, b: Column, skip: Column) -> Column:
    """A number of bytes in which two strings agree, from ``skip`` on which they are known to."""
    x, y = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")

    def further(n: Column, step: Column) -> Column:
        same = (F.substring(x, n + 1, step) == F.substring(y, n + 1, step)) & (F.length(x) >= n + step)
        return n + F.when(same, step).otherwise(F.lit(0))

    return F.aggregate(F.array(*[F.lit(2**i) for i in range(9, -1, -1)]), skip, further)


def top_n(items: DataFrame, n: int, group: str = "g", score: str = "score", ident: str = "id", points: int = POINTS) -> DataFrame:
    """The ``n`` best identifiers of each group: (g, id, score).

    Higher scores are better; equal scores are decided by the identifier, ascending by code
    point.  An identifier counts once per group, with its highest score.  Rows with a null
    group or identifier, or a null or NaN score, are left out; infinite scores count as the
    largest or smallest double.  Groups with fewer than ``n`` identifiers are kept whole;
    n <= 0 and empty tables give an empty result.
    """
    stages = Stages(items.sparkSession, "topn")
    big = 1.7976931348623157e308
    value = F.col(score).cast("double")
    rows = items.select(*hashed(F.col(group), names=_G), F.col(group).alias("g"), F.col(ident).alias("id"), F.greatest(F.least(value, F.lit(big)), F.lit(-big)).alias("score")).where(
        F.col("g").isNotNull() & F.col("id").isNotNull() & value.isNotNull() & ~F.isnan(value)
    )
    if n <= 0:
        return rows.limit(0).select("g", "id", "score")
    active = stages.put(best_of_repeats(rows).select(*_G, "g", "id", "score"), "items")
    span = active.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if span["lo"] is None:
        return active.select("g", "id", "score")
    taken, waiting, owed = [], [], []
    state, going, k = None, 0, 0
    measures = [F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")]
    while True:
        if state is None:  # all groups split the same interval first, so this pass needs no state
            celled = active.withColumn("cell", _score_cell(F.col("score"), F.lit(span["lo"]), F.lit(span["hi"]), points))
            counts = celled.groupBy(*_G, "cell").agg(*measures).withColumn("need", F.lit(n).cast("long"))
        else:
            celled = active.join(broadcast_if_small(state.select(*_G, "lo", "hi"), going), _G)
            celled = celled.withColumn("cell", _score_cell(F.col("score"), F.col("lo"), F.col("hi"), points)).drop("lo", "hi")
            counts = celled.groupBy(*_G, "cell").agg(*measures).join(broadcast_if_small(state.select(*_G, "need"), going), _G)
        state, won, active, going = _settle(stages, celled, counts, ["lo", "hi"], k)
        taken.append(won)
        if not going:
            break
        tied, state = state.where("lo = hi"), state.where("lo < hi")
        going_on = state.count()
        # groups that are down to one score wait for the identifiers
        if going_on < going:
            few = broadcast_if_small(tied.select(*_G), going - going_on)
            waiting.append(active.join(few, _G, "left_semi") if going_on else active)
            owed.append(tied.select(*_G, "need"))
        if not going_on:
            break
        if going_on < going:
            active = active.join(broadcast_if_small(state.select(*_G), going_on), _G, "left_semi")
        going, k = going_on, k + 1
    if waiting:
        taken += _by_identifier(stages, _union(waiting), _union(owed), points)
    return _union(taken).select("g", "id", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _settle(stages: Stages, celled: DataFrame, counts: DataFrame, keep: list[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Of each group the part in which it fills up (``cut``): parts before it are taken, those
    after it dropped; it is taken too if that fits exactly.  Gives the state of the groups that
    go on, the taken items, the items that go on and the number of groups that do."""
    run = F.sum("n").over(Window.partitionBy(*_G).orderBy("cell"))
    at = counts.withColumn("upto", run).withColumn("before", F.col("upto") - F.col("n"))
    # the last part that starts before the group is full
    last = F.max_by(F.struct("cell", "upto", "before", "need", *keep), "cell")
    cut = at.where("before < need").groupBy(*_G).agg(last.alias("c")).select(*_G, "c.*")
    decided = stages.put(cut.select(*_G, F.col("cell").alias("cut"), (F.col("upto") <= F.col("need")).alias("whole"), (F.col("need") - F.col("before")).alias("need"), *keep), f"cuts{k}")
    sized = broadcast_if_small(decided.select(*_G, "cut", "whole"))
    split = celled.join(sized, _G).where("cell <= cut").withColumn("won", (F.col("cell") < F.col("cut")) | F.col("whole"))
    split = stages.put(split.select(*_G, "g", "id", "score", "won"), f"split{k}")
    state = decided.where("NOT whole").select(*_G, "need", *keep)
    return state, split.where("won").drop("won"), split.where("NOT won").drop("won"), state.count()


def _by_identifier(stages: Stages, active: DataFrame, owed: DataFrame, points: int) -> list[DataFrame]:
    """The ``need`` first identifiers of each group among items of equal score."""
    taken: list[DataFrame] = []
    state = owed.withColumn("skip", F.lit(0))
    going, k = state.count(), 100
    while going:
        few = broadcast_if_small(state, going)
        ends = active.groupBy(*_G).agg(F.min("id").alias("first"), F.max("id").alias("last")).join(few, _G)
        ends = ends.withColumn("skip", _common(F.col("first"), F.col("last"), F.col("skip")))
        ends = ends.select(*_G, "need", "skip", _code(F.col("first"), F.col("skip")).alias("c0"), _code(F.col("last"), F.col("skip")).alias("c1"))
        ends = stages.put(ends, f"ends{k}")
        celled = active.join(broadcast_if_small(ends.drop("need"), going), _G)
        f = F.try_divide((_code(F.col("id"), F.col("skip")) - F.col("c0")).cast("double"), (F.col("c1") - F.col("c0")).cast("double"))
        celled = celled.withColumn("cell", F.coalesce(F.least(F.floor(f * (points + 1)), F.lit(points)), F.lit(0)).cast("int")).select(*_G, "g", "id", "score", "cell")
        # where all codes are equal, the next pass starts behind them
        onward = ends.select(*_G, "need", (F.col("skip") + F.when(F.col("c0") == F.col("c1"), CODE_BYTES).otherwise(0)).alias("skip"))
        counts = celled.groupBy(*_G, "cell").agg(F.count(F.lit(1)).alias("n")).join(broadcast_if_small(onward, going), _G)
        state, won, active, going = _settle(stages, celled, counts, ["skip"], k)
        taken.append(won)
        k += 1
    return taken
