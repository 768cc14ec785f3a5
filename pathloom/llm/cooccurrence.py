"""How often items appear together, by heavy-light decomposition.

Records of a group are cut into blocks.  In each block the frequent (heavy) items get a bit
row over the block's records: pairs of heavy items are counted by popcounts of ANDed rows.
Pairs of rare (light) items are enumerated record by record and counted by hash.  Mixed pairs
are counted by probing the heavy rows at the records of each light item.  The counts of the
three kinds add up over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators.staging import Stages, broadcast_if_small

#: Records of a block; the share of a group's records from which an item is heavy.
BLOCK, HEAVY_SHARE = 8192, 1 / 64
#: Pairs of light items held at once while a block is counted.
_AT_ONCE = 4_000_000
#: Of the arrays of counted pairs, how many are looked at to see that a block holds enough.
_RECENT = 8


def _count_block(rec: np.ndarray, item: np.ndarray, heavy: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b, records) of one block, a pair in one part or several whose counts add up;
    entries are distinct (rec, item)."""
    _, rec = np.unique(rec, return_inverse=True)
    items, code = np.unique(item, return_inverse=True)
    n_rec, n_item = int(rec.max()) + 1, len(items)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, n = (np.concatenate(x) for x in zip(*out))
        out.clear()
        a, b = items[a], items[b]
        return np.minimum(a, b), np.maximum(a, b), n.astype(np.int64)

    hcodes = np.unique(code[heavy])
    words = (n_rec + 63) // 64
    if len(hcodes):
        row = np.full(n_item, -1)
        row[hcodes] = np.arange(len(hcodes))
        bits = np.zeros((len(hcodes), words), np.uint64)
        hr = rec[heavy]
        np.bitwise_or.at(bits, (row[code[heavy]], hr >> 6), np.uint64(1) << (hr & 63).astype(np.uint64))
        for i in range(len(hcodes) - 1):
            both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(both)
            out.append((np.full(len(hit), hcodes[i]), hcodes[i + 1 + hit], both[hit]))
    light = ~heavy
    lr, lc = rec[light], code[light]
    if len(hcodes) and len(lr):
        word, shift = lr >> 6, (lr & 63).astype(np.uint64)
        for i, h in enumerate(hcodes):
            there = (bits[i, word] >> shift) & np.uint64(1)
            both = np.bincount(lc[there.astype(bool)], minlength=1)
            hit = np.flatnonzero(both)
            out.append((np.full(len(hit), h), hit, both[hit]))
    if len(lr):
        order = np.lexsort((lc, lr))
        lr, lc = lr[order], lc[order]
        pending, held = [], 0

        def flush() -> None:
            pairs, n = np.unique(np.concatenate(pending), return_counts=True)
            out.append((pairs // n_item, pairs % n_item, n))

        d = 1
        while d < len(lr):
            near = lr[:-d] == lr[d:]
            if not near.any():
                break
            pending.append(lc[:-d][near].astype(np.int64) * n_item + lc[d:][near])
            held += len(pending[-1])
            if held > _AT_ONCE:
                flush()
                pending, held = [], 0
            if sum(len(n) for *_, n in out[-_RECENT:]) > _AT_ONCE:  # parts of the answer leave before more are made
                yield done()
            d += 1
        if pending:
            flush()
    if out:
        yield done()


_PAIRS = pa.schema([("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive sorted; one is counted as soon as the next one begins."""
    held: list[pa.RecordBatch] = []
    at = None

    def count(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        for a, b, n in _count_block(*(t[c].to_numpy() for c in ("rec", "item", "heavy"))):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at[0])), pa.array(a), pa.array(b), pa.array(n)], schema=_PAIRS)

    for batch in batches:
        if not batch.num_rows:
            continue
        gid, block = batch["gid"].to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((gid[1:] != gid[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(gid)]):
            key = (gid[lo], block[lo])
            if key != at and held:
                yield from count(held)
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from count(held)


def cooccurrence(records: DataFrame, groups: list[str], items: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of items that occur together in at least ``min_count`` records of a group, at least
    ``min_lift`` times as often as chance: (``groups``, item_a, item_b, n, n_a, n_b, n_ab, lift).

    ``records``: one row each, with an array of strings in ``items``; repeats and nulls in it
    count once and never.  Records without items don't count; records with null ``groups``
    form groups of their own.  ``n`` is the number of the group's records; lift is
    n_ab * n / (n_a * n_b).  Empty tables give an empty result.

    Items that cannot reach ``min_count`` or ``min_lift`` with any partner are left out before
    pairs are formed; that loses no pair.
    """
    spark = records.sparkSession
    stages = Stages(spark, "cooccurrence")
    sets = records.select(F.struct(*groups).alias("g"), F.array_except(F.col(items), F.array(F.lit(None).cast("string"))).alias("items")).where(F.size("items") > 0)
    sets = stages.put(sets.withColumn("rec", F.monotonically_increasing_id()), "records")
    sizes = sets.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumn("gid", F.xxhash64("g"))
    sizes = stages.put(sizes, "sizes")
    n_groups = sizes.count()
    if sizes.select("gid").distinct().count() < n_groups:
        raise RuntimeError("two groups have the same hash")
    entries = sets.select("g", "rec", F.explode("items").alias("item"))
    counts = entries.groupBy("g", "item").agg(F.count(F.lit(1)).alias("n_a")).where(F.col("n_a") >= min_count)
    counts = counts.join(broadcast_if_small(sizes, n_groups), "g").where(F.col("n") >= F.col("n_a") * F.lit(float(min_lift)))
    for seed in range(8):
        kept = stages.put(counts.withColumn("id", F.xxhash64("item", F.lit(seed))), "items")
        n_items = kept.count()
        if kept.select("gid", "id").distinct().count() == n_items:
            break
    else:
        raise RuntimeError("items with the same hash under every seed")
    # what is known of an item here has a fixed size: it is found by hashes, not by its text
    second = F.xxhash64(F.lit(99), "item")
    ids = kept.select("gid", "id", second.alias("id2"), (F.col("n_a") >= F.col("n") * HEAVY_SHARE).alias("heavy"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    hashed = entries.select(F.xxhash64("g").alias("gid"), F.xxhash64("item", F.lit(seed)).alias("id"), second.alias("id2"), "rec")
    coded = hashed.join(broadcast_if_small(ids, n_items), ["gid", "id", "id2"])
    blocks = coded.select("gid", F.pmod(F.xxhash64("rec"), F.col("blocks")).alias("block"), "rec", F.col("id").alias("item"), "heavy")
    # (gid, block) holds BLOCK records or so, however large the group is
    parts = blocks.repartition("gid", "block").sortWithinPartitions("gid", "block")
    pairs = parts.mapInArrow(_count_blocks, "gid long, a long, b long, n long")
    together = pairs.groupBy("gid", "a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    # counts go on first; names only to the pairs that are kept, by a join that Spark sizes
    seen = lambda k, n, *more: kept.select("gid", F.col("id").alias(k), F.col("n_a").alias(n), *more)
    lifted = together.join(broadcast_if_small(seen("a", "n_x", "n"), n_items), ["gid", "a"]).join(broadcast_if_small(seen("b", "n_y"), n_items), ["gid", "b"])
    if min_lift > 0:
        lifted = lifted.where(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_x") * F.col("n_y"))
    named = lifted.join(kept.select("gid", F.col("id").alias("a"), F.col("item").alias("x"), "g"), ["gid", "a"]).join(kept.select("gid", F.col("id").alias("b"), F.col("item").alias("y")), ["gid", "b"])
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return named.select(
        *[F.col("g").getField(c).alias(c) for c in groups],
        pick("x", "y").alias("item_a"),
        pick("y", "x").alias("item_b"),
        "n",
        pick("n_x", "n_y").alias("n_a"),
        pick("n_y", "n_x").alias("n_b"),
        "n_ab",
        (F.col("n_ab") * F.col("n") / (F.col("n_x").cast("double") * F.col("n_y"))).alias("lift"),
    )
