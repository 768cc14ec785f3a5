"""Filling containers of fixed capacity by planning over the histogram of lengths.

The plan is made on counts per length, best fit from the longest down: it never sees items,
so its size depends on the capacity only.  It consists of runs: so many items of a length go
to a range of containers, so many each.  Items then take planned slots by their rank within
their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages, broadcast_if_small

#: Partitions over which the ranks of items of one length are counted.
RANK_PARTS = 256


@dataclass(frozen=True)
class Run:
    """Items of ``length`` with rank ``first`` up to ``last`` (exclusive) go to containers from
    ``container`` on, ``each`` per container."""

    length: int
    first: int
    last: int
    container: int
    each: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best fit decreasing over counts; runs and the number of containers.  Lengths are 1 to capacity.

    Containers are kept in groups of equal free space.  A length goes to the groups with the
    least space that holds it; what is left opens new containers.
    """
    runs: list[Run] = []
    spaces: list[int] = []  # sorted free spaces that have groups
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> (first container, containers)
    opened = 0

    def add(space: int, start: int, n: int) -> None:
        if n and space:
            if space not in groups:
                groups[space] = []
                insort(spaces, space)
            groups[space].append((start, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                start, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
            else:
                space, start = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append(Run(length, rank, rank + full * each, start, each))
                rank += full * each
                left -= full * each
                add(space - each * length, start, full)
            if full < n and left:  # fewer than fit into one more container
                some = min(left, each)
                runs.append(Run(length, rank, rank + some, start + full, each))
                rank += some
                left -= some
                add(space - some * length, start + full, 1)
                full += 1
            add(space, start + full, n - full)
    return runs, opened


def ranked_sizes(items: DataFrame, doc_id: str, size: str, stages: Stages) -> DataFrame:
    """(doc_id, n, rank): items with their place among those of equal size, from 0.

    Items of a size are spread over RANK_PARTS parts, which are ranked apart and put behind each
    other by their counts.  One ranking serves every capacity."""
    base = items.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    spread = stages.put(base.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS)).cast("int")), "items")
    counts = spread.groupBy("n", "part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("n").orderBy("part")) - F.col("c")).drop("c")
    inside = F.row_number().over(Window.partitionBy("n", "part").orderBy("doc_id")) - 1
    return stages.put(spread.withColumn("inside", inside).join(before, ["n", "part"]).select("doc_id", "n", (F.col("before") + F.col("inside")).alias("rank")), "ranked")


def pack(items: DataFrame, doc_id: str, size: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """``pack_all`` for one capacity."""
    return pack_all(items, doc_id, size, [capacity])[0]


def pack_all(items: DataFrame, doc_id: str, size: str, capacities: list[int]) -> list[tuple[DataFrame, DataFrame]]:
    """For each capacity, which items go to which container: (container_id, doc_id, piece_no,
    start_token, n_tokens), and a report of one row: (capacity, items, pieces, containers, tokens, filled).

    An item larger than the capacity is cut into pieces: full ones, which have a container each,
    and the rest, which is placed like an item; others are never cut.  Items without size (null,
    0 or less) go round the containers, of which there is one at least if there are items.
    Item keys are unique; repeated ones are placed as often as they occur, in the same slots'
    order.  An empty table gives no rows and 0 containers.  The driver holds counts per length:
    ``capacity`` numbers at most.

    Items are ranked within their size once.  What is left of an item after its full pieces
    stands, among all pieces of that length, behind those of smaller items, so its rank there
    follows from the histogram of sizes, which joins the items without moving them.
    """
    stages = Stages(items.sparkSession, "packing")
    ranked = ranked_sizes(items, doc_id, size, stages)
    sizes = stages.put(ranked.groupBy("n").agg(F.count(F.lit(1)).alias("c")), "sizes")
    return [_packed(ranked, sizes, int(c), stages) for c in capacities]


def _packed(ranked: DataFrame, sizes: DataFrame, capacity: int, stages: Stages) -> tuple[DataFrame, DataFrame]:
    spark, cap = ranked.sparkSession, F.lit(capacity)
    h = sizes.where("n > 0").withColumn("full", F.floor(F.col("n") / cap)).withColumn("length", F.col("n") - F.col("full") * cap)
    offset = F.sum("c").over(Window.partitionBy("length").orderBy("n")) - F.col("c")
    cut = F.when(F.col("full") > 0, F.col("full") * F.col("c")).otherwise(F.lit(0))
    # sizes above the capacity, of which there are few, are put behind each other
    behind = F.sum(cut).over(Window.partitionBy(F.col("full") > 0).orderBy("n")) - cut
    h = stages.put(h.select("n", "c", "full", "length", offset.alias("offset"), behind.alias("behind")), "lengths")
    histogram = {r["length"]: r["c"] for r in h.where("length > 0").groupBy("length").agg(F.sum("c").alias("c")).collect()}
    total = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.col("c") * F.floor(F.col("n") / cap)), F.lit(0)).alias("full")).first()
    runs, opened = plan(histogram, capacity)
    planned = spark.createDataFrame([(r.length, r.first, r.last, r.container, r.each) for r in runs], "length long, first long, last long, container long, each long")
    placed = ranked.where("n > 0").join(broadcast_if_small(h.drop("c")), "n")
    ends = placed.where("length > 0").select("doc_id", "length", F.col("full").cast("int").alias("piece_no"), (F.col("full") * cap).cast("long").alias("start_token"), (F.col("offset") + F.col("rank")).alias("at"))
    slots = ends.join(broadcast_if_small(planned, len(runs)), "length").where("at >= first AND at < last")
    rest = slots.select((F.col("container") + F.floor((F.col("at") - F.col("first")) / F.col("each"))).alias("container_id"), "doc_id", "piece_no", "start_token", F.col("length").alias("n_tokens"))
    # full pieces: their containers follow the planned ones
    first = F.lit(opened) + F.col("behind") + F.col("rank") * F.col("full")
    pieces = placed.where("full > 0").select("doc_id", first.alias("from"), F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece_no"))
    whole = pieces.select((F.col("from") + F.col("piece_no")).alias("container_id"), "doc_id", "piece_no", (F.col("piece_no") * cap).cast("long").alias("start_token"), cap.cast("long").alias("n_tokens"))
    containers = max(opened + total["full"], 1 if total["items"] else 0)
    none = ranked.where("n = 0").select(F.pmod(F.xxhash64("doc_id"), F.lit(max(containers, 1))).alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"))
    out = rest.unionByName(whole).unionByName(none)
    row = (capacity, total["items"], sum(histogram.values()) + total["full"], containers, total["tokens"], total["tokens"] / float(max(containers, 1) * capacity))
    return out, spark.createDataFrame([row], "capacity int, items long, pieces long, containers long, tokens long, filled double")
