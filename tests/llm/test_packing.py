from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm.packing import pack, plan


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.one_of(st.integers(1, 3), st.integers(1, 40)), max_size=12))))
def test_plan_places_every_item_once_and_fits(case):
    capacity, histogram = case
    runs, containers = plan(dict(histogram), capacity)
    load, placed = Counter(), Counter()
    for r in runs:
        for rank in range(r.first, r.last):
            load[r.container + (rank - r.first) // r.each] += r.length
            placed[(r.length, rank)] += 1
    assert placed == Counter((length, i) for length, n in histogram.items() for i in range(n))
    assert all(0 <= c < containers and v <= capacity for c, v in load.items()) and len(load) == containers
    assert containers == one_by_one(histogram, capacity)
    items = [length for length, n in histogram.items() for _ in range(n)]
    if 0 < len(items) <= 7:  # best fit decreasing: no more than 11/9 of the least number and 6/9
        assert containers <= least(sorted(items, reverse=True), capacity) * 11 / 9 + 6 / 9


def one_by_one(histogram, capacity):
    """Containers of best fit decreasing, item by item."""
    free = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [s for s in free if s >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return len(free)


def least(items, capacity):
    """The least number of containers, by trying all ways."""

    def go(i, loads):
        if i == len(items):
            return len(loads)
        tries = [loads[:j] + [x + items[i]] + loads[j + 1 :] for j, x in enumerate(loads) if x + items[i] <= capacity]
        return min(go(i + 1, t) for t in [*tries, [*loads, items[i]]])

    return go(0, [])


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, size long, length int")


@pytest.mark.parametrize("capacity", [1, 7, 100])
def test_items_stay_whole(spark, capacity):
    sizes = [0, None, -3, 1, 7, 8, 50, 99, 100, 101, 250, 700, *range(1, 60), *[5] * 200]
    out, report = pack(frame(spark, list(enumerate(sizes))), "id", "size", capacity)
    rows, r = out.collect(), report.first()
    load = Counter()
    pieces = {}
    for x in rows:
        load[x.container_id] += x.n_tokens
        pieces.setdefault(x.doc_id, []).append((x.piece_no, x.start_token, x.n_tokens))
    assert max(load.values()) <= capacity and max(load) < r.containers
    assert set(pieces) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        s = max(s or 0, 0)
        p = sorted(pieces[i])
        assert len(p) == max(1, -(-s // capacity)) and sum(n for *_, n in p) == s
        at = 0
        for no, (k, start, n) in enumerate(p):
            assert (k, start) == (no, at)
            at += n
    assert r["items"] == len(sizes) and r.tokens == sum(max(s or 0, 0) for s in sizes)


def test_empty(spark):
    out, report = pack(frame(spark, []), "id", "size", 10)
    assert out.count() == 0 and tuple(report.first())[1:5] == (0, 0, 0, 0)
    out, report = pack(frame(spark, [(1, 0)]), "id", "size", 10)
    assert [x.container_id for x in out.collect()] == [0] and report.first().containers == 1


def test_little_room_is_left(spark):
    sizes = [(i, 1 + (i * i) % 97) for i in range(2000)]
    assert pack(frame(spark, sizes), "id", "size", 512)[1].first().filled > 0.99
