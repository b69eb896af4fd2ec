import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm.top_n import LoserTree, merge_runs, top_n

ROWS = "g string, s double, i bigint"


def brute(rows, n):
    best = {}
    for g, s, i in rows:
        if g is not None and s is not None and s == s and i is not None:
            own = best.setdefault(g, {})
            own[i] = min(s, own.get(i, s))
    return sorted((g, s, i, r + 1) for g, own in best.items() for r, (s, i) in enumerate(sorted((s, i) for i, s in own.items())[:n]))


def found(df):
    return sorted((r["g"], r["s"], r["i"], r["rank"]) for r in df.collect())


def test_as_brute_force_with_a_hot_group_and_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 50 + [f"g{k}" for k in range(30)]), round(rng.random(), 2), rng.randrange(900)) for _ in range(3000)]
    rows += rows[:300]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    assert found(top_n(df, "g", "s", "i", 5)) == brute(rows, 5)


def test_several_runs_a_task(spark, monkeypatch):
    rows = [(f"g{k % 3}", float(k % 11), k) for k in range(200)]
    assert found(top_n(spark.createDataFrame(rows, ROWS).coalesce(1), "g", "s", "i", 4, buckets=2)) == brute(rows, 4)


def test_a_group_in_very_many_runs_is_merged_level_by_level(spark):
    rng = random.Random(9)
    rows = [("hot" if k % 3 else f"g{k % 40}", float(rng.randrange(50)), k) for k in range(2000)]
    assert found(top_n(spark.createDataFrame(rows, ROWS).repartition(60), "g", "s", "i", 3, buckets=3, fan_in=4)) == brute(rows, 3)


def test_odd_rows(spark):
    rows = [("a", 1.0, 1), ("a", 1.0, 1), ("a", 0.5, 1), ("a", None, 2), ("a", float("nan"), 3), (None, 0.1, 4), ("a", 0.7, None), ("", 0.3, 5), ("long" * 5000, 0.2, 6), ("a", float("-inf"), 7)]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as grp", "2 as score", "3 as run")
    assert found(top_n(df, "g", "s", "i", 2)) == brute(rows, 2)


def test_empty(spark):
    assert top_n(spark.createDataFrame([], ROWS), "g", "s", "i", 3).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_merge_of_sorted_runs(runs, n):
    columns = [tuple(map(list, zip(*sorted(set(r))))) for r in runs]
    expected, seen = [], {}
    for g, s, i in sorted(x for r in runs for x in set(r)):
        own = seen.setdefault(g, [])
        if i not in own and len(own) < n:
            own.append(i)
            expected.append((g, s, i, len(own)))
    assert list(merge_runs(columns, n)) == expected


def test_loser_tree_sorts():
    rng = random.Random(5)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 9))) for _ in range(7)]
    tree, at, out = LoserTree([r[0] for r in runs]), [0] * 7, []
    while (key := tree.keys[w := tree.winner]) is not None:
        out.append(key)
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == sorted(x for r in runs for x in r)
