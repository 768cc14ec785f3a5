"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks of like size by hash.  Of these the mix takes a quota:
all blocks in every full repeat, then some; the last one is taken in part.  A tree halves the
shards of the output: at each node the blocks of every source are divided between both halves
like balls drawn from an urn without replacement.  So shards are made independently, each from
its own blocks, in exact number, and look as if the whole had been shuffled; inside a shard
documents are ordered by hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages

#: Blocks of a source at least, blocks to a shard of the output, and tokens of a shard.
BLOCKS, BLOCKS_PER_SHARD, SHARD_TOKENS = 1024, 4, 4_000_000


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: an array (shards, sources) whose columns sum to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = round(total * left / shards)
    there = rng.multivariate_hypergeometric(quotas, take) if total else np.zeros_like(quotas)
    return np.vstack([split_tree(there, left, rng), split_tree(quotas - there, shards - left, rng)])


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int]) -> tuple[float, dict[str, tuple[float, float]]]:
    """The largest total that no source has to be repeated too often for, and per source its
    share of it and its tokens.  Sources without documents (or a share of 0) give nothing; their
    share goes to the others in proportion."""
    usable = {s: w for s, w, r in targets if w and w > 0 and r and r > 0 and available.get(s, 0) > 0}
    weight = sum(usable.values())
    if not weight:
        return 0.0, {}
    limit = {s: available[s] * r / (usable[s] / weight) for s, _, r in targets if s in usable}
    total = min(limit.values())
    return total, {s: (w / weight, total * w / weight) for s, w in usable.items()}


def mix(documents: DataFrame, doc_id: str, source: str, size: str, targets: list[tuple[str, float, int]], seed: int = 0, blocks: int | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that every source has its share of the total size.

    ``targets``: (source, weight, repeats at most); weights need not sum to 1, weights of a source
    named twice add up and the fewer repeats hold.  The total is the largest for which no source
    exceeds its repeats.  Gives the draw (shard, position, doc_id, source, copy_no, n_tokens) and a
    report per target (source, target_share, share, tokens, actual_share, documents, max_copies).
    Documents with a null key, source or without size are not drawn.  A source's size misses its
    quota by at most one document; ``copy_no`` of a document is below the source's repeats.  The
    driver holds numbers per block.  Blocks follow the data (``BLOCKS_PER_SHARD`` for every
    ``shard_tokens`` of the largest source) unless ``blocks`` says how many a source has, so neither a
    shard nor a block grows with it.
    """
    spark = documents.sparkSession
    stages = Stages(spark, "mixing")
    merged: dict[str, tuple[float, int]] = {}
    for s, w, r in targets:
        ow, orr = merged.get(s, (0.0, r))
        merged[s] = (ow + max(0.0, w or 0.0), min(orr, r))
    targets = [(s, w, r) for s, (w, r) in sorted(merged.items())]
    names = [s for s, _, _ in targets]
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    base = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens"))
    base = base.where(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0) & F.col("source").isin(names or [""]))
    base = stages.put(base, "sized")
    available = {r["source"]: r["t"] for r in base.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total, goal = quotas(targets, available)
    shards = max(1, math.ceil(total / shard_tokens))
    blocks = blocks or max(BLOCKS, BLOCKS_PER_SHARD * math.ceil(max(available.values(), default=0) / shard_tokens))
    base = base.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int"))
    sizes = {(r["source"], r["block"]): (r["t"], r["n"]) for r in base.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rng = np.random.default_rng(seed)
    # the blocks taken of each source and copy, and the one that is taken in part
    taken: list[tuple[str, int, int]] = []
    partial: list[tuple[str, int, int, float]] = []
    for s in sorted(goal):
        full, left = divmod(goal[s][1], available[s])
        full = int(full)
        if left > available[s] - 0.5:
            full, left = full + 1, 0.0
        order = [b for (x, b) in sorted(sizes) if x == s]
        for c in range(full):
            taken += [(s, c, b) for b in order]
        for b in rng.permutation(order):
            t = sizes[(s, int(b))][0]
            if t <= left:
                taken.append((s, full, int(b)))
                left -= t
            elif left > 0:
                partial.append((s, full, int(b), left))
                left = 0.0
    # the tree deals out blocks; those drawn by one shard are its own
    per = {s: [x for x in [*taken, *((a, c, b) for a, c, b, _ in partial)] if x[0] == s] for s in sorted(goal)}
    dealt: list[tuple[str, int, int, int]] = []
    if per:
        table = split_tree(np.array([len(per[s]) for s in per], dtype=np.int64), shards, rng)
        for j, s in enumerate(per):
            shuffled = [per[s][i] for i in rng.permutation(len(per[s]))]
            at = 0
            for shard in range(shards):
                dealt += [(*x, shard) for x in shuffled[at : at + int(table[shard, j])]]
                at += int(table[shard, j])
    plan = stages.put(spark.createDataFrame(dealt, "source string, copy_no int, block int, shard int"), "plan")
    # of the partial block, documents are taken in hash order up to the quota
    parts = spark.createDataFrame(partial, "source string, copy_no int, block int, left double")
    ordered = Window.partitionBy("source", "copy_no").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    some = base.join(F.broadcast(parts), ["source", "block"]).withColumn("before", F.coalesce(F.sum("n_tokens").over(ordered), F.lit(0)))
    # the document at the edge counts if more of it lies inside than outside
    cut = some.where(F.col("before") + F.col("n_tokens") / 2 > F.col("left")).select("source", "copy_no", "block", "doc_id")
    drawn = base.join(F.broadcast(plan), ["source", "block"])
    drawn = drawn.join(cut, ["source", "copy_no", "block", "doc_id"], "left_anti")
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy_no"), "doc_id", "copy_no")
    drawn = stages.put(drawn.withColumn("position", F.row_number().over(place) - 1).select("shard", "position", "doc_id", "source", "copy_no", "n_tokens"), "draw")
    stages.keep(drawn)
    wanted = spark.createDataFrame([(s, float(w), float(goal[s][0]) if s in goal else 0.0) for s, w, _ in targets], "source string, target_share double, share double")
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("copy_no") + 1).alias("max_copies"))
    all_ = got.agg(F.sum("tokens").alias("all"))
    report = wanted.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source",
        "target_share",
        "share",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("max_copies", F.lit(0)).alias("max_copies"),
    )
    return drawn, report
