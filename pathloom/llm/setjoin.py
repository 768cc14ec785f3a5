"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Records descend trees.  In a node a record chooses, for each tree, some of its tokens that
are not yet on the path: those whose hash under (node, tree) is below a rate, ``branching`` of
them on average at the root.  Similar records share tokens and so tend to choose the same ones.
A node of few records is compared by brute force; larger ones are split again.  Trees agree on a
node's key (the set of tokens on the path), so what several trees choose is compared once.  Trees
are repeated until a pair at the threshold is missed with a probability of no more than
1 - ``recall`` (``trees_for``).  Candidates that pass a bit-sketch bound are verified exactly.

A record most of whose tokens are on a path is compared with its whole node and leaves it; so
are all records of a node at ``MAX_DEPTH``.  Boilerplate shared by all of a node's records
doesn't make them all meet there: see ``_by_next_token``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages, broadcast_if_small

#: The share of pairs at the threshold that is to be found, and tokens chosen on average per
#: record and tree.
RECALL, BRANCHING = 0.999, 2.0
#: Trees at most: as many as a record's mask of trees has bits.
MAX_TREES = 60
#: Records of a node at each depth up to which it is compared by brute force.
NODE_LIMITS = (64, 128, 256, 512, 1024)
MAX_DEPTH = 6
#: Records of a block where a node is compared in blocks.
BLOCK = 1024
_GRID = 1 << 20


def survival(threshold: float, branching: float = BRANCHING, depth: int = MAX_DEPTH) -> float:
    """The least probability that two sets at the threshold meet in one tree after ``depth`` levels.

    Two sets with similarity t share at least t * size tokens of the larger one, so behind a path
    of d tokens at least t * size - d.  A record chooses its open tokens at a rate of
    ``branching`` * t over that number; the larger set has the smaller rate, so the common
    choices in a node number ``branching`` * t on average or more, at any depth and whatever
    the sizes: a branching process, whose extinction is followed level by level.  Choices are
    binomial; a Poisson number of the same mean has the larger chance of none.
    """
    mean, dead = branching * threshold, 0.0
    for _ in range(depth):
        dead = math.exp(mean * (dead - 1))
    return 1 - dead


def trees_for(threshold: float, recall: float = RECALL, branching: float | None = None) -> tuple[int, float]:
    """Trees and branching for a wanted recall: the branching grows where few tokens are common,
    so that a tree doesn't die out (mean common choices of 1.4 or more)."""
    b = branching or max(BRANCHING, 1.4 / threshold)
    alive = survival(threshold, b)
    need = math.ceil(math.log(1 - recall) / math.log(1 - alive))
    return max(1, min(MAX_TREES, need)), b


def _sketch(tokens: Column, shift: int) -> Column:
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", t, F.lit(shift)).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseOR(bit(t)))


def _choose(state: DataFrame, threshold: float, trees: int, branching: float) -> DataFrame:
    """The children that each record goes on to, with the trees that chose them.

    Tokens are filtered inside the array, so only chosen ones become rows and carry the others."""
    common = F.ceil(F.col("size") * F.lit(threshold) - 1e-9) - F.col("depth")
    below = F.lit(float(branching) * threshold * _GRID) / F.greatest(common, F.lit(1))

    def mask(token: Column) -> Column:
        out = F.lit(0).cast("long")
        # one hash serves three trees, a share of its bits each
        for first in range(0, trees, 3):
            h = F.xxhash64("node", token, F.lit(first))
            for t in range(first, min(first + 3, trees)):
                draw = F.call_function("shiftright", h, F.lit(20 * (t - first))).bitwiseAND(F.lit(_GRID - 1))
                out = out.bitwiseOR(F.when(draw < below, F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long")))
        return out.bitwiseAND(F.col("trees"))

    picks = F.filter(F.transform("rest", lambda t: F.struct(t.alias("token"), mask(t).alias("trees"))), lambda p: p["trees"] != 0)
    chosen = state.withColumn("p", F.explode(picks)).drop("trees").select("*", "p.token", "p.trees")
    # exclusive or, so that the order in which tokens were chosen doesn't matter
    node = F.col("node").bitwiseXOR(F.xxhash64(F.col("token"), F.lit(77)))
    return chosen.select(node.alias("node"), "trees", "rid", "side", "size", (F.col("depth") + 1).alias("depth"), F.array_remove("rest", F.col("token")).alias("rest"), "s0", "s1")


_LEAF = ["node", "rid", "side", "size", "s0", "s1", "n", "probe"]


def _near(threshold: float, two_tables: bool) -> Column:
    """What the sizes and sketches of two records (_a, _b) don't rule out."""
    order = (F.col("side_a") < F.col("side_b")) if two_tables else (F.col("rid_a") < F.col("rid_b"))
    both = F.col("size_a") + F.col("size_b")
    # of sets with Jaccard j, at most (1 - j) / (1 + j) of both sizes lie in one only; differing
    # bits of a sketch come from different such tokens
    apart = both * F.lit((1 - threshold) / (1 + threshold)) + 1e-9
    far = lambda s: F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b")))
    sizes = F.least("size_a", "size_b") + 1e-9 >= F.greatest("size_a", "size_b") * F.lit(threshold)
    return order & (F.col("probe_a") | F.col("probe_b")) & sizes & (far("s0") <= apart) & (far("s1") <= apart)


def _candidates(leaves: DataFrame, threshold: float, two_tables: bool) -> DataFrame:
    """Distinct pairs of a node's records that the sizes and sketches don't rule out.

    Every probing record is compared with every record of its node.  Nodes larger than BLOCK
    are compared block by block: each record is sent to the blocks that it meets."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid", "side"), blocks).cast("int")
    spread = leaves.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = spread.select("node", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "own", "rid", "side", "size", "s0", "s1", "probe")
    a = cells.select("node", "b0", "b1", *[F.col(c).alias(f"{c}_a") for c in ("own", "rid", "side", "size", "s0", "s1", "probe")])
    b = cells.select("node", "b0", "b1", *[F.col(c).alias(f"{c}_b") for c in ("own", "rid", "side", "size", "s0", "s1", "probe")])
    met = a.join(b, ["node", "b0", "b1"]).where(((F.col("b0") == F.col("b1")) | (F.col("own_a") != F.col("own_b"))) & _near(threshold, two_tables))
    return met.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")).distinct()


def _by_next_token(met: DataFrame, stages: Stages, threshold: float, two_tables: bool) -> tuple[DataFrame, DataFrame]:
    """Large nodes compared without all meeting all: leaves, and pairs that need no look.

    Records of a node share the d tokens of its path.  Pairs whose sizes ask for d common tokens
    or fewer are similar by that alone.  Others share a token more, and one among the first
    ``size - ceil(t * size) + 1`` of each if tokens are put in order of how few of the node's
    records have them; so they meet in a node for such a token, and no pair is lost."""
    met = stages.put(met.select("node", "rid", "side", "size", "depth", "rest", "s0", "s1", "probe"), "large")
    most = F.floor(F.col("depth") * F.lit((1 + threshold) / threshold) + 1e-9).cast("int")  # both sizes together
    near = met.select("node", "rid", "side", "size", "depth").where(F.col("depth") >= F.col("size") * F.lit(threshold) - 1e-9)
    a = near.select("node", F.col("rid").alias("a"), F.col("side").alias("sa"), "size")
    partner = F.explode(F.sequence(F.col("depth"), F.greatest(most - F.col("size"), F.col("depth"))))
    b = near.select("node", F.col("rid").alias("b"), F.col("side").alias("sb"), "depth", F.col("size").alias("own"), partner.alias("size"))
    order = F.col("sa") < F.col("sb") if two_tables else F.col("a") < F.col("b")
    pairs = a.join(b.where(F.col("size") + F.col("own") <= F.floor(F.col("depth") * F.lit((1 + threshold) / threshold) + 1e-9)), ["node", "size"]).where(order).select("a", "b")
    token = met.select("node", F.explode("rest").alias("token")).groupBy("node", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    named = met.select("node", "rid", "side", F.explode("rest").alias("token")).join(token, ["node", "token"])
    ranked = named.groupBy("node", "rid", "side").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    # tokens that nobody else has stand first; those of the path last
    lone = F.size("rest") - F.size("order")
    keep = F.least(F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - 1e-9).cast("int") + 1, F.size("rest")) - lone
    short = met.join(ranked, ["node", "rid", "side"]).where(keep > 0).withColumn("p", F.explode(F.slice("order", F.lit(1), F.greatest(keep, F.lit(1)))))
    short = stages.put(short.select(F.xxhash64("node", "p.token").alias("node"), "rid", "side", "size", "s0", "s1", "probe"), "short")
    counts = short.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("x"), F.max("side").alias("y"), F.max("probe").alias("any"))
    counts = counts.where(F.col("any") & (F.expr("x < y") if two_tables else F.col("n") > 1)).select("node", "n")
    return short.join(counts, "node").select(*_LEAF), pairs


def _search(sets: DataFrame, stages: Stages, threshold: float, two_tables: bool, trees: int, branching: float) -> DataFrame:
    """Candidate pairs (a, b) of ``sets``: node, rid, side, tokens (distinct longs)."""
    size = F.size("tokens")
    state = sets.select("node", F.lit((1 << trees) - 1).cast("long").alias("trees"), "rid", "side", size.alias("size"), F.lit(0).alias("depth"), F.col("tokens").alias("rest"), _sketch(F.col("tokens"), 0).alias("s0"), _sketch(F.col("tokens"), 6).alias("s1"))
    leaves: DataFrame | None = None
    pairs: DataFrame | None = None
    for depth in range(1, MAX_DEPTH + 1):
        children = _choose(state, threshold, trees, branching)
        if depth > 1:  # reached over several orders of the same tokens
            first = [F.first(c).alias(c) for c in ("size", "depth", "rest", "s0", "s1")]
            children = children.groupBy("node", "rid", "side").agg(F.bit_or("trees").alias("trees"), *first)
        children = stages.put(children, f"depth{depth}")
        counts = children.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("x"), F.max("side").alias("y"))
        counts = counts.where("x < y" if two_tables else "n > 1").drop("x", "y")
        here = children.join(counts, "node")
        limit = NODE_LIMITS[min(depth, len(NODE_LIMITS)) - 1]
        # all but this part of the record is on the path, so most of its partners are here
        settled = (F.lit(depth) >= F.col("size") * F.lit(threshold)) | (F.size("rest") == 0)
        state = stages.put(here.withColumn("small", F.col("n") <= limit).withColumn("settled", settled), f"nodes{depth}")
        leaf = state.where("small").withColumn("probe", F.lit(True)).select(*_LEAF)
        large = state.where("NOT small")
        last = depth == MAX_DEPTH
        # in large nodes that have settled records, these probe all; at the end all do
        probing = large.where(F.col("settled") | F.lit(last)).select("node").distinct()
        if not probing.isEmpty():
            met = large.join(broadcast_if_small(probing), "node", "left_semi").withColumn("probe", F.col("settled") | F.lit(last))
            parted, sure = _by_next_token(met, stages, threshold, two_tables)
            leaf = leaf.unionByName(parted)
            pairs = sure if pairs is None else pairs.unionByName(sure)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        state = large.where("NOT settled").select("node", "trees", "rid", "side", "size", "depth", "rest", "s0", "s1")
        if last or state.isEmpty():
            break
    found = _candidates(leaves, threshold, two_tables)
    return found if pairs is None else found.unionByName(pairs).distinct()


def similar_sets(left: DataFrame, rid: str, items: str, threshold: float, right: DataFrame | None = None, space: str | None = None, min_size: int = 1, trees: int | None = None, branching: float | None = None, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and pairs of classes with Jaccard similarity ``threshold`` or more.

    ``rid``: a unique key of the record; ``items``: an array of strings, repeats and nulls in
    which don't count.  With ``right`` (same columns) the pairs are between the two tables,
    else within ``left``.  Records of different ``space`` are not compared.  Records with fewer
    than ``min_size`` (at least 1) items, or a null array, are left out; null keys too.

    Gives members (space, side, class_id, rid) and links (space, class_a, class_b, common,
    total, similarity), class_a < class_b unless there are two tables.  Records of one class
    have equal sets, so every pair of members of a class is similar too.  The number of trees
    follows from ``recall``, the least share to be found of pairs at the threshold (more similar
    ones are found more often), unless ``trees`` is given; precision is 1.  Empty tables give
    empty results.
    """
    spark = left.sparkSession
    stages = Stages(spark, "setjoin")
    need, branching = trees_for(threshold, recall, branching)
    trees = trees or need
    sides = [(0, left)] if right is None else [(0, left), (1, right)]
    rows: DataFrame | None = None
    for side, df in sides:
        part = df.select(
            (F.col(space).cast("string") if space else F.lit("")).alias("space"),
            F.lit(side).alias("side"),
            F.col(rid).alias("rid"),
            F.array_sort(F.array_except(F.col(items), F.array(F.lit(None).cast("string")))).alias("items"),
        ).where(F.col("rid").isNotNull() & (F.size("items") >= max(1, min_size)))
        rows = part if rows is None else rows.unionByName(part)
    # equal sets are told by 128 bits of hash and their size
    keyed = stages.put(rows.withColumn("h0", F.xxhash64("space", "items")).withColumn("h1", F.xxhash64(F.lit(1), F.col("space"), F.col("items"))), "records")
    classes = keyed.groupBy("side", "h0", "h1").agg(F.min("rid").alias("class_id"), F.first("space").alias("space"), F.first("items").alias("items"))
    classes = stages.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    named = classes.select("side", "h0", "h1", "class_id")
    members = keyed.join(broadcast_if_small(named), ["side", "h0", "h1"]).select("space", "side", "class_id", "rid")
    tokens = F.transform("items", lambda i: F.xxhash64(i))
    sets = classes.select(F.xxhash64("space").alias("node"), F.col("cid").alias("rid"), "side", F.array_distinct(tokens).alias("tokens"))
    pairs = stages.put(_search(sets, stages, threshold, right is not None, trees, branching), "candidates")
    known = lambda s: classes.select(F.col("cid").alias(s), F.col("class_id").alias(f"class_{s}"), F.col("items").alias(f"items_{s}"), F.col("space").alias(f"space_{s}"))
    full = pairs.join(known("a"), "a").join(known("b"), "b").where("space_a = space_b")
    full = full.withColumn("common", F.size(F.array_intersect("items_a", "items_b"))).withColumn("total", F.size("items_a") + F.size("items_b") - F.col("common"))
    # in whole numbers, so that exactly the threshold counts
    near = F.col("common") * F.lit(1_000_000_000).cast("long") >= F.col("total") * F.lit(round(threshold * 1_000_000_000)).cast("long")
    kept = full.where(near)
    swap = (F.col("class_a") > F.col("class_b")) & F.lit(right is None)
    links = kept.select(
        F.col("space_a").alias("space"),
        F.when(swap, F.col("class_b")).otherwise(F.col("class_a")).alias("class_a"),
        F.when(swap, F.col("class_a")).otherwise(F.col("class_b")).alias("class_b"),
        "common",
        "total",
        (F.col("common") / F.col("total")).alias("similarity"),
    )
    links = stages.put(links, "links")
    stages.keep(keyed, classes, links)
    return members, links


def similar_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """Links within one table between records instead of classes: (space, a, b), a < b, of
    equal sets too.  As many rows as there are such pairs."""
    m = lambda s: members.select("space", F.col("class_id").alias(f"class_{s}"), F.col("rid").alias(f"r{s}"))
    across = links.select("space", "class_a", "class_b").join(m("a"), ["space", "class_a"]).join(m("b"), ["space", "class_b"])
    within = m("a").join(m("b").withColumnRenamed("class_b", "class_a"), ["space", "class_a"]).where("ra < rb")
    pairs = across.select("space", "ra", "rb").unionByName(within.select("space", "ra", "rb"))
    return pairs.select("space", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
