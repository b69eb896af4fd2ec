import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm.packing import configurations, pack, plan_large, plan_small

ROWS = "d string, n bigint"


def check(rows, packed, capacity):
    sizes = {d: max(n or 0, 0) for d, n in rows if d is not None}
    used, seen = defaultdict(int), defaultdict(list)
    for r in packed:
        seen[r["d"]].append((r["first_token"], r["n_tokens"], r["n_pieces"]))
        if r["n_tokens"]:
            used[r["container_id"]] += r["n_tokens"]
        else:
            assert r["container_id"] is None
    assert set(seen) == set(sizes)
    for d, pieces in seen.items():
        pieces.sort()
        assert sum(n for _, n, _ in pieces) == sizes[d]
        assert len(pieces) == max(1, -(-sizes[d] // capacity)) == pieces[0][2]
        assert [p[0] for p in pieces] == [capacity * k for k in range(len(pieces))]
    assert not used or max(used.values()) <= capacity
    return used


def test_every_item_once_and_little_room_left(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", rng.choice([rng.randrange(1, 40), rng.randrange(40, 700), 300])) for i in range(700)] + [("big", 2500), ("exact", 2000), ("none", 0), ("null", None)]
    df = spark.createDataFrame(rows + rows[:20], ROWS).withColumns({c: F.lit(1) for c in ("ident", "size", "key", "piece", "room", "at")})
    used = check(rows, pack(df, "d", "n", 1000).collect(), 1000)
    total = sum(n or 0 for _, n in rows)
    assert len(used) <= 1.05 * -(-total // 1000) + 1


def test_one_size_holds_most_rows(spark):
    rows = [(f"d{i}", 334 if i % 3 else 5) for i in range(300)]
    used = check(rows, pack(spark.createDataFrame(rows, ROWS), "d", "n", 1000).collect(), 1000)
    assert len(used) <= 101


def test_only_small_and_empty(spark):
    rows = [(f"d{i}", i % 9) for i in range(60)]
    used = check(rows, pack(spark.createDataFrame(rows, ROWS), "d", "n", 100).collect(), 100)
    assert len(used) == -(-sum(n for _, n in rows) // 100)
    assert pack(spark.createDataFrame([], ROWS), "d", "n", 100).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(13, 100), st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 8))
def test_plan_large_places_each_rank_once(histogram, groups):
    places, starts, cardinality, n = plan_large(histogram, 100, groups)
    load = defaultdict(int)
    for size, count in histogram.items():
        for rank in range(count):
            group, i = divmod(starts[size] + rank, cardinality)
            at = [base + (i - first) // each for g, first, last, each, base in places if g == group and first <= i < last]
            assert len(at) == 1 and 0 <= at[0] < n
            load[at[0]] += size
    assert max(load.values()) <= 100 and len(load) == n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 40), max_size=8), st.dictionaries(st.integers(0, 100), st.integers(1, 9), max_size=8))
def test_plan_small_fits(histogram, rooms):
    plan, opened = plan_small(histogram, rooms, 100)
    left = {(r, k): r for r, n in rooms.items() for k in range(n)} | {(101, k): 100 for k in range(opened)}
    placed = defaultdict(list)
    for size, first, last, room, rank in plan:
        for i in range(first, last):
            placed[size].append(i)
            left[room, rank + i - first] -= size
    assert all(v >= 0 for v in left.values())
    assert {s: sorted(v) for s, v in placed.items()} == {s: list(range(n)) for s, n in histogram.items()}


def test_configurations_are_near_the_bound():
    sizes, counts = np.array([60, 45, 35, 20]), np.array([100, 120, 90, 200])
    plan = configurations(sizes, counts, 100)
    assert (sum(p * t for p, t in plan) == counts).all()
    assert sum(t for _, t in plan) <= -(-int(sizes @ counts) // 100) + 12
