import random
from collections import Counter
from itertools import combinations

import pytest
from helpers import LONG, ODD, docs

from docparity.llm import packing


def optimum(items, capacity):
    """Least number of bins, by trying every place for each item."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[i]:
                k = rooms.index(room)
                place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best if items else 0


@pytest.mark.parametrize("seed", range(60))
def test_fixed_bins_are_part_of_an_optimal_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20, 50])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
    fixed, rest = packing.reduced(dict(Counter(items)), capacity)
    taken = Counter(s for bins, n in fixed for s in bins for _ in range(n))
    assert taken + Counter(rest) == Counter(items) and all(sum(b) <= capacity for b, _ in fixed)
    assert sum(n for _, n in fixed) + optimum([s for s, n in rest.items() for _ in range(n)], capacity) == optimum(items, capacity)


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_is_item_by_item_best_fit(seed):
    rng = random.Random(seed)
    capacity = 30
    items = [rng.randint(1, 30) for _ in range(200)]
    rooms = []
    for s in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    got = packing.best_fit(dict(Counter(items)), capacity)
    assert sum(n for _, n in got) == len(rooms) and Counter(capacity - sum(b) for b, n in got for _ in range(n)) == Counter(rooms)


def check(rows, given, capacity):
    want = Counter()
    for d, t in given:
        n = len(t or "")
        if not n:
            want[d, 0, 0, 0] += 1
        for k in range(-(-n // capacity)):
            want[d, k, k * capacity, min(capacity, n - k * capacity)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == want
    places = {}
    for r in rows:
        if r["length"]:
            places.setdefault(r["bin_id"], []).append((r["bin_offset"], r["bin_offset"] + r["length"]))
        else:
            assert r["bin_id"] is None and r["bin_offset"] is None and r["fixed"] is None
    for spans in places.values():
        spans.sort()
        assert spans[0][0] >= 0 and spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert set(places) == set(range(len(places)))
    return len(places)


def test_odd_rows(spark):
    check(packing.pack(docs(spark, ODD)).collect(), ODD, packing.CAPACITY)


def test_empty(spark):
    assert packing.pack(docs(spark, [])).collect() == []
    check(packing.pack(docs(spark, [(1, None)])).collect(), [(1, None)], packing.CAPACITY)


def test_bins_against_brute_force(spark):
    rng = random.Random(3)
    given = [(i % 40, "x" * rng.randint(0, 130)) for i in range(300)]
    n = check(packing.pack(docs(spark, given, extra=False), capacity=100).collect(), given, 100)
    pieces = [min(100, len(t) - k) for _, t in given for k in range(0, len(t), 100)]
    fixed, rest = packing.reduced(dict(Counter(pieces)), 100)
    assert n == sum(k for _, k in fixed) + sum(k for _, k in packing.best_fit(rest, 100)) >= -(-sum(pieces) // 100)


@pytest.mark.parametrize("slots", [packing.BROADCAST_SLOTS, 0])
def test_lengths_that_many_pieces_share(spark, monkeypatch, slots):
    monkeypatch.setattr(packing, "PART_PIECES", 7)
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", slots)
    rng = random.Random(4)
    given = [(rng.choice([None, *range(30)]), "x" * rng.choice([10, 10, 10, 100, 250, 33])) for _ in range(300)]
    rows = packing.pack(docs(spark, given), capacity=100).collect()
    assert check(rows, given, 100) == check(packing.pack(docs(spark, given), capacity=100).collect(), given, 100)
    assert len({(r["bin_id"], r["bin_offset"]) for r in rows}) == len(rows)


def test_capacity_is_a_parameter(spark):
    check(packing.pack(docs(spark, [(1, LONG)]), capacity=7).collect(), [(1, LONG)], 7)


def test_dominance_of_pairs():
    # 6 goes with 4 exactly; 5 with 3 and 2, which no other filling beats
    fixed, rest = packing.reduced({6: 1, 4: 1}, 10)
    assert fixed == [([6, 4], 1)] and rest == {}
    assert all(sum(c) <= 10 for b, _ in fixed for c in combinations(b, len(b)))
