"""Documents and queries that all meet: in blocks, each pair of blocks in a task that keeps the best of a query."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and queries of a block at most, and pairs of blocks for each core at least.
DOC_BLOCK, QUERY_BLOCK, PAIRS_PER_CORE = 250_000, 100_000, 2
#: Texts that are hashed at once.
HASHED_AT_ONCE = 16384


def in_blocks(docs: DataFrame, queries: DataFrame, worker: Callable[[pa.Table, pa.Table], pa.Table], schema: str, asked: int = 0) -> DataFrame:
    """What ``worker`` makes of each block of ``docs`` (doc and others) and each block of ``queries``
    (qid and others; all rows of a qid are in one).

    Both sides are copied once for each block of the other; that, and what workers keep, is all
    that is shuffled.  A worker holds a block of documents and one of queries; ``asked``: the number
    of queries, where it grows with the data."""
    n = docs.count()
    d = max(1, -(-n // DOC_BLOCK))
    q = max(1, -(-PAIRS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism // d), -(-asked // QUERY_BLOCK))
    own = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = docs.withColumn("_d", own("doc", d)).withColumn("_q", all_of(q))
    right = queries.withColumn("_q", own("qid", q)).withColumn("_d", all_of(d))
    # the number of parts is given, else small parts would be put together again
    met = [x.withColumn("_g", F.col("_d") * q + F.col("_q")).drop("_d", "_q").repartition(d * q, "_g").groupBy("_g") for x in (left, right)]
    return met[0].cogroup(met[1]).applyInArrow(worker, schema)


class Postings:
    """Where each word of a block's texts occurs: texts in ascending order of ``doc``, words counted."""

    def __init__(self, docs: pa.Table, words: str):
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc", "ascending")])).combine_chunks()
        lists = docs[words].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.docs, self.lists, self.n = docs["doc"], lists, len(docs)
        self.lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        self.code = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        size = max(1, len(self.code))
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, self.n) + np.repeat(np.arange(self.n), self.lengths)
        key, self.times = np.unique(key, return_counts=True)
        self.at = (key % max(1, self.n)).astype(np.int32)
        self.starts = np.searchsorted(key, np.arange(size + 1) * max(1, self.n))

    def of(self, word: str) -> slice:
        i = self.code.get(word)
        return slice(0, 0) if i is None else slice(self.starts[i], self.starts[i + 1])


def sharing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, n, first): the number of documents that share a word with each query, and the first one.

    ``docs``: doc, words; ``queries``: qid, an array of words."""

    def worker(d: pa.Table, q: pa.Table) -> pa.Table:
        index = Postings(d, "words")
        hit = np.zeros(index.n, dtype=bool)
        rows = []
        for words in q["qid"].to_pylist():
            hit[:] = False
            for w in words:
                hit[index.at[index.of(w)]] = True
            if n := int(np.count_nonzero(hit)):
                rows.append((words, n, index.docs[int(hit.argmax())].as_py()))
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.list_(pa.string()), pa.int64(), pa.string()))], names=["qid", "n", "first"])

    met = in_blocks(docs.select("doc", "words"), queries.select("qid"), worker, "qid array<string>, n bigint, first string")
    return met.groupBy("qid").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


# ---- the best documents by weighed words ---------------------------------------------------------

#: What rounding and the order of sums may change of a score.
_SLACK = 1e-5


def _best(index: Postings, parts: np.ndarray, tops: np.ndarray, asked: list[tuple[str, float]], n: int, acc: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, sums, commons) of the ``n`` best documents of a block, equal ones by name; exact.

    A document has the sum over the asked words of weight times the word's part in it; where
    ``counted``, at least the number of common words, rounded to 6 places.  The words that may give
    most come first.  Once all that is left gives less than the n-th sum so far, no further
    document can be among the best, and only those that still can are looked up in the rest.
    ``acc``: room for a sum of each document; ``tops``: the largest part of each word."""
    lists = [(weight * tops[index.code[w]], index.of(w), weight) for w, weight in asked if w in index.code]
    lists.sort(key=lambda x: (-x[0], x[1].stop - x[1].start))
    left = [*np.cumsum([0.0, *(x[0] for x in reversed(lists))])[::-1]]
    bounded = all(weight >= 0 for _, _, weight in lists)
    # below this many a count may still decide
    enough, least, done = float(len(lists)) if counted else 0.0, -np.inf, len(lists)
    acc[:] = 0
    for i, (_, s, weight) in enumerate(lists):
        if bounded and least > enough + _SLACK and left[i] < least - _SLACK:
            done = i
            break
        at = index.at[s]
        now = acc[at] + weight * parts[s]
        acc[at] = now
        if len(now) >= n:
            least = max(least, np.partition(now, len(now) - n)[len(now) - n])
    common = None
    if bounded and least > enough + _SLACK:
        places = np.flatnonzero(acc >= least - left[done] - _SLACK)
        for i in range(done, len(lists)):
            _, s, weight = lists[i]
            at = index.at[s]
            if len(places) * 8 > len(at):
                acc[at] += weight * parts[s]
            else:
                k = np.minimum(np.searchsorted(at, places), len(at) - 1)
                hit = at[k] == places
                acc[places[hit]] += weight * parts[s][k[hit]]
            now = acc[places]
            if len(now) >= n:
                least = max(least, np.partition(now, len(now) - n)[len(now) - n])
            places = places[now >= least - left[i + 1] - _SLACK]
    else:
        common = np.zeros(index.n)
        for _, s, _ in lists:
            common[index.at[s]] += 1
        places = np.flatnonzero(common)
    sums, commons = acc[places], np.zeros(len(places)) if common is None else common[places]
    score = np.maximum(np.floor(sums * 1e6 + 0.5) / 1e6, commons) if counted else sums
    if len(places) > n:
        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
        near = near[np.argsort(-score[near], kind="stable")[:n]]
        places, sums, commons = places[near], sums[near], commons[near]
    return places, sums, commons


def best_by_words(corpus: DataFrame, asked: DataFrame, n: int, norm: tuple[float, float] | None = None) -> DataFrame:
    """(qid, doc, raw, common): of each block of ``corpus`` the ``n`` best documents of each query.

    ``corpus``: doc, tokens; ``asked``: qid, token, weight, a row per pair, and with ``norm`` the mean
    length avgdl.  Without ``norm`` every distinct common word gives its weight to raw; else ``norm`` is
    K1 and B of BM25, by which repeats and lengths change it, and common counts the words, or is 0
    where raw is more than all of them."""

    def worker(d: pa.Table, q: pa.Table) -> pa.Table:
        index = Postings(d, "tokens")
        q = q.sort_by("qid")
        times = index.times.astype(float)
        if norm is None or not len(q):
            parts = np.ones(len(times))
        else:
            k1, b = norm
            parts = times * (k1 + 1) / (times + k1 * (1 - b + b * index.lengths[index.at] / q["avgdl"][0].as_py()))
        tops = np.maximum.reduceat(parts, index.starts[:-1]) if len(parts) else parts
        acc, by = np.zeros(index.n), {}
        for qid, token, weight in zip(q["qid"].to_pylist(), q["token"].to_pylist(), q["weight"].to_pylist(), strict=True):
            by.setdefault(qid, []).append((token, weight))
        got = [_best(index, parts, tops, words, n, acc, norm is not None) for words in by.values()] if len(parts) else []
        whole = [np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in range(3)]
        qids = pa.array(list(by), q.schema.field("qid").type).take(pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), pa.int64()))
        return pa.table([qids, index.docs.take(pa.array(whole[0].astype(np.int64))), pa.array(whole[1].astype(float)), pa.array(whole[2].astype(np.int64))], names=["qid", "doc", "raw", "common"])

    kind = {f.name: f.dataType.simpleString() for f in [*asked.schema, *corpus.schema]}
    return in_blocks(corpus.select("doc", "tokens"), asked, worker, f"qid {kind['qid']}, doc {kind['doc']}, raw double, common bigint")


# ---- the best documents by the number of common words -----------------------------------------------

#: Distinct words up to which a document is listed by its pairs of words; queries, pairs of words,
#: candidates and flags of words at once.
PAIRED_WORDS, QUERIES_AT_ONCE, PAIRS_AT_ONCE, CANDIDATES_AT_ONCE, FLAGS_AT_ONCE = 16, 1 << 14, 1 << 20, 1 << 19, 1 << 25


class Pairs:
    """Documents of few words, listed by two of them, for the most words in common; exact.

    Words are numbered from rare to frequent, those of a document in that order.  A document that
    shares two words with a query or more has a second shared one; where that is at place j of its
    L words (the first is 0), it shares L - j + 1 at most.  Level b lists documents by their
    words at i and j = L - b + 1, for all i before j; levels down to b have all that share b or more."""

    def __init__(self, index: Postings):
        often = np.diff(index.starts)
        self.size, self.docs = len(often), index.n
        self.number = np.empty(self.size, dtype=np.int64)
        self.number[np.argsort(often, kind="stable")] = np.arange(self.size)
        key = np.sort(index.at.astype(np.int64) * self.size + np.repeat(self.number, often))
        doc, word = key // self.size, key % self.size
        lengths = np.bincount(doc, minlength=index.n)
        self.longer = lengths > PAIRED_WORDS
        place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        few = ~self.longer[doc]
        self.lengths = np.where(self.longer, 0, lengths).astype(np.int32)
        self.most = int(self.lengths.max(initial=0))
        # places behind the last word have a number that no query has
        self.words = np.full((self.most, index.n), self.size, dtype=np.int32)
        self.words[place[few], doc[few]] = word[few]
        self.bits = np.zeros(index.n, dtype=np.uint64)
        np.bitwise_or.at(self.bits, doc[few], self._bit(word[few]))
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _bit(words: np.ndarray) -> np.ndarray:
        return np.uint64(1) << (words % 64).astype(np.uint64)

    def level(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, where the documents of each start, documents)."""
        if b not in self.levels:
            docs = np.flatnonzero(self.lengths >= b)
            j = self.lengths[docs] - b + 1
            d, second = np.repeat(docs, j), np.repeat(j, j)
            i = np.arange(len(d)) - np.repeat(np.cumsum(j) - j, j)
            key = self.words[i, d].astype(np.int64) * self.size + self.words[second, d]
            order = np.argsort(key, kind="stable")
            pairs, starts = np.unique(key[order], return_index=True)
            self.levels[b] = pairs, np.append(starts, len(key)), d[order].astype(np.int32)
        return self.levels[b]

    def best(self, who: np.ndarray, words: np.ndarray, queries: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(queries, places, commons) of the ``n`` best documents of each query, equal ones by name, and
        whether a query is done; those that have less than ``n`` documents with two common words are not.

        ``who``, ``words``: the queries, ascending, and the numbers of their words, distinct."""
        flags = np.zeros((queries, self.size + 1), dtype=bool)
        flags[who, words] = True
        flags, bits = flags.ravel(), np.zeros(queries, dtype=np.uint64)
        np.bitwise_or.at(bits, who, self._bit(words))
        ends = np.searchsorted(who, who, side="right")
        others = ends - np.arange(len(who)) - 1
        first = np.repeat(np.arange(len(who)), others)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(others) - others, others)
        a, b = words[first], words[second]
        key, asks = np.minimum(a, b) * self.size + np.maximum(a, b), who[first]
        order = np.argsort(key, kind="stable")
        key, asks = key[order], asks[order]
        # what is found: a query, how many words are not common, a document, in one number that sorts
        row = max(1, self.docs)
        span = (self.most + 1) * row
        found, least = np.zeros(0, dtype=np.int64), np.zeros(queries, dtype=np.int64)
        done = np.zeros(queries, dtype=bool)
        for level in range(self.most, 1, -1):
            if done.any():
                left = ~done[asks]
                key, asks = key[left], asks[left]
            if not len(key):
                break
            pairs, starts, docs = self.level(level)
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            hit = pairs[at] == key
            at, q = at[hit], asks[hit]
            counts = starts[at + 1] - starts[at]
            cuts = np.searchsorted(np.cumsum(counts), np.arange(CANDIDATES_AT_ONCE, counts.sum() + CANDIDATES_AT_ONCE, CANDIDATES_AT_ONCE)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True) if len(at) else ():
                c = counts[lo:hi]
                here = np.repeat(starts[at[lo:hi]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                doc, of = docs[here], np.repeat(q[lo:hi], c)
                # each bit that a query lacks stands for a word at least that is not common
                may = self.lengths[doc] - np.bitwise_count(self.bits[doc] & ~bits[of]) >= least[of]
                doc, of = doc[may], of[may]
                # a document is met by every pair of common words; the first pair counts
                n_common, before, j = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64), self.lengths[doc] - level + 1
                for i in range(self.most):
                    common = flags[of * (self.size + 1) + self.words[i][doc]]
                    n_common += common
                    before += common & (i < j)
                new = (n_common >= least[of]) & (before == 1)
                found = np.sort(np.append(found, of[new] * span + (self.most - n_common[new]) * row + doc[new]))
                by = found // span
                rank = np.arange(len(by)) - np.searchsorted(by, by)
                found, by, rank = (x[rank < n] for x in (found, by, rank))
                last = rank == n - 1
                least[by[last]] = self.most - found[last] % span // row
            done |= least >= level
        by = found // span
        found, by = found[done[by]], by[done[by]]
        return by, found % row, self.most - found % span // row, done


def _overlaps(d: pa.Table, q: pa.Table, n: int) -> pa.Table:
    """(qid, doc, common): at least the ``n`` best of the documents ``d`` (doc, tokens) for each of ``q`` (qid, tokens)."""
    index = Postings(d, "tokens")
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(index.at):
        pairs = Pairs(index)
        parts = [(index, np.arange(index.n))]
        if pairs.longer.any():
            own = np.flatnonzero(pairs.longer)
            parts.append((Postings(pa.table({"doc": index.docs, "tokens": index.lists}).take(pa.array(own)), "tokens"), own))
        for at in range(0, len(q), QUERIES_AT_ONCE):
            got += [(by + at, places, commons) for by, places, commons in _overlaps_of(q.slice(at, QUERIES_AT_ONCE)["tokens"], index, pairs, parts, n)]
    whole = [np.concatenate([g[i] for g in got]).astype(np.int64) if got else np.zeros(0, dtype=np.int64) for i in range(3)]
    return pa.table([q["qid"].take(pa.array(whole[0])), index.docs.take(pa.array(whole[1])), pa.array(whole[2])], names=["qid", "doc", "common"])


def _overlaps_of(tokens: pa.ChunkedArray, index: Postings, pairs: Pairs, parts: list[tuple[Postings, np.ndarray]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, places, commons), several times; ``parts``: all documents and, if there are any, those
    of many words, with their places."""
    lists = tokens.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    counts = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    numbers = np.array([pairs.number[index.code[w]] if w in index.code else -1 for w in names], dtype=np.int64)
    word, who = numbers[coded.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(lists)), counts)
    key = np.unique(who[word >= 0] * pairs.size + word[word >= 0])
    who, word = key // pairs.size, key % pairs.size
    starts = np.searchsorted(who, np.arange(len(lists) + 1))
    # batches of queries, by their pairs of words and the room for their flags
    size = np.cumsum(np.diff(starts) ** 2 // 2 + max(1, pairs.size * PAIRS_AT_ONCE // FLAGS_AT_ONCE))
    at, undone, got = 0, set(), []
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        s = slice(starts[at], starts[to])
        by, places, commons, done = pairs.best(who[s] - at, word[s], to - at, n)
        got.append((by + at, places, commons))
        undone.update(np.flatnonzero(~done & (starts[at + 1 : to + 1] > starts[at:to])) + at)
        at = to
    # what shares too few words is looked for among all, what has many words for all
    named = dict(zip(numbers.tolist(), names, strict=True))
    for (part, own), asked in zip(parts, (undone, {*who} - undone), strict=False):
        ones, acc = np.ones(max(len(part.at), len(part.code))), np.zeros(part.n)
        for i in sorted(asked):
            places, sums, _ = _best(part, ones, ones, [(named[w], 1.0) for w in word[starts[i] : starts[i + 1]].tolist()], n, acc, False)
            got.append((np.full(len(places), i), own[places], sums))
    return got


def best_by_overlap(corpus: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, doc, common): of each block of ``corpus`` at least the ``n`` documents that share the most distinct
    words with each query.  ``corpus``: doc, tokens; ``queries``: qid, tokens, a row per qid."""

    def worker(d: pa.Table, q: pa.Table) -> pa.Table:
        return _overlaps(d, q, n)

    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *corpus.schema]}
    asked = queries.select("qid", F.array_distinct("tokens").alias("tokens"))
    return in_blocks(corpus.select("doc", "tokens"), asked, worker, f"qid {kind['qid']}, doc {kind['doc']}, common bigint", queries.count())


# ---- the least MD5 sums ---------------------------------------------------------------------------

_K = np.array([int(abs(sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(state: list[np.ndarray], words: list[np.ndarray], room: list[np.ndarray]) -> list[np.ndarray]:
    """The states after one block each of 16 words; ``room``: six arrays to work in."""
    a, b, c, d, f, g = room
    for x, s in zip((a, b, c, d), state, strict=True):
        np.copyto(x, s)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            w = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            w = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            w = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            w = 7 * i % 16
        turn = _TURN[kind][i % 4]
        np.add(f, a, out=f)
        np.add(f, words[w], out=f)
        np.add(f, _K[i], out=f)
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [x + s for x, s in zip((a, b, c, d), state, strict=True)]


def _padded(texts: list[bytes], before: int, blocks: int) -> np.ndarray:
    """Words of ``texts``, padded as MD5 has it, behind ``before`` zero bytes: a row for each word."""
    size = 64 * blocks
    whole = b"".join((bytes(before) + t + b"\x80").ljust(size - 8, b"\0") + (8 * (before + len(t))).to_bytes(8, "little") for t in texts)
    return np.ascontiguousarray(np.frombuffer(whole, dtype="<u4").reshape(len(texts), size // 4).T)


def _least_of_chunk(prefixes: list[tuple[int, bytes]], texts: list[bytes], n: int, found: dict[int, list[tuple[str, bytes]]], most: dict[int, int], blocks: int) -> None:
    """Adds to ``found`` the texts whose sum behind a prefix may be among the ``n`` least, by its first
    four bytes; ``most``: what these may be for each query.  Prefixes are equally long."""
    before = len(prefixes[0][1])
    rows = list(_padded(texts, before, blocks))
    room = [np.empty(len(texts), dtype=np.uint32) for _ in range(6)]
    start = [np.full(len(texts), x, dtype=np.uint32) for x in _START]
    for qid, prefix in prefixes:
        head = np.frombuffer(prefix.ljust(-(-before // 4) * 4, b"\0"), dtype="<u4")
        state = start
        for k in range(blocks):
            words = rows[16 * k : 16 * k + 16]
            for i in range(16 * k, min(16 * k + 16, len(head))):
                words[i - 16 * k] = rows[i] | head[i]
            state = _md5_block(state, words, room)
        first = state[0].byteswap()
        if qid not in most and len(texts) > n:
            most[qid] = int(np.partition(first, n - 1)[n - 1])
        had = found.setdefault(qid, [])
        for i in np.flatnonzero(first <= np.uint32(most.get(qid, 0xFFFFFFFF))):
            had.append((md5(prefix + texts[i]).hexdigest(), texts[i]))
        if len(had) > n:
            had.sort()
            del had[n:]
            most[qid] = int(had[-1][0][:8], 16)


def least_hashed(docs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, doc, h): at least the ``n`` documents with the least MD5 sum of "qid:doc" for each query, n
    of each block.  ``docs``: doc; ``queries``: qid, a bigint.

    Sums of a query and thousands of documents are made at once, word by word."""

    def worker(d: pa.Table, q: pa.Table) -> pa.Table:
        by_blocks: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for qid in q["qid"].to_pylist():
            prefix = f"{qid}:".encode()
            by_blocks.setdefault(len(prefix), []).append((qid, prefix))
        texts = sorted((t.encode() for t in d["doc"].to_pylist()), key=len)
        found: dict[int, list[tuple[str, bytes]]] = {}
        most: dict[int, int] = {}
        for before, prefixes in by_blocks.items():
            at = 0
            while at < len(texts):
                blocks = (before + len(texts[at]) + 8) // 64 + 1
                chunk = texts[at : at + HASHED_AT_ONCE]
                while (before + len(chunk[-1]) + 8) // 64 + 1 > blocks:
                    chunk = [t for t in chunk if (before + len(t) + 8) // 64 + 1 == blocks]
                _least_of_chunk(prefixes, chunk, n, found, most, blocks)
                at += len(chunk)
        rows = [(qid, t.decode(), h) for qid, had in found.items() for h, t in sorted(had)[:n]]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["qid", "doc", "h"])

    return in_blocks(docs.select("doc"), queries.select(F.col("qid").cast("bigint").alias("qid")), worker, "qid bigint, doc string, h string")
