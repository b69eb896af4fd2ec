import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm.percentiles import percentiles, runs

SHARES = [0.5, 0.9, 0.99]
ROWS = "g string, v double, i bigint"


def exact(values, share):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(round(share * len(ordered), 6))) - 1]


def result(df):
    return {r["grp"]: (r["n"], list(r["values"])) for r in df.collect()}


def data(n=900, seed=1):
    rng = random.Random(seed)
    rows = [("hot", rng.lognormvariate(0, 3), i) for i in range(n)]
    rows += [("tied", float(rng.randrange(3)), 10_000 + i) for i in range(n // 2)]
    rows += [(f"g{i % 40}", rng.random(), 20_000 + i) for i in range(200)]
    return rows


def by_group(rows):
    groups = {}
    for g, v, _ in rows:
        groups.setdefault(g, []).append(v)
    return groups


def test_rounds_give_the_exact_elements(spark):
    rows = data()
    found = result(percentiles(runs(spark.createDataFrame(rows, ROWS), "g", "v", "i", run_rows=32), SHARES, run_rows=32))
    assert found == {g: (len(v), [exact(v, s) for s in SHARES]) for g, v in by_group(rows).items()}


def test_an_id_seen_on_two_days_counts_once(spark):
    rows = [(g, v, i, f"2024-01-{1 + i % 9:02}") for g, v, i in data(400)]
    again = [(g, v, i, "2024-02-01") for g, v, i, _ in rows[::3]] + [("hot", 1.0, None, None), ("hot", 1.0, None, "2024-01-01")]
    df = spark.createDataFrame(rows + again, f"{ROWS}, d string").repartition(3)
    expected = by_group([r[:3] for r in rows] + [("hot", 1.0, None)] * 2)
    state = runs(df, "g", "v", "i", run_rows=16, by="d")
    assert result(percentiles(state, SHARES, run_rows=32)) == {g: (len(v), [exact(v, s) for s in SHARES]) for g, v in expected.items()}
    for g, (n, values) in result(percentiles(runs(df, "g", "v", "i", error=0.1, by="d"), SHARES)).items():
        ordered = sorted(expected[g])
        for s, x in zip(SHARES, values):
            rank = max(1, math.ceil(round(s * n, 6)))
            assert n == len(ordered) and sum(v < x for v in ordered) + 1 - 0.1 * n <= rank <= sum(v <= x for v in ordered) + 0.1 * n


def test_any_split_merges_to_the_same(spark):
    rows = data(300)
    parts = [rows[i::3] for i in range(3)]
    states = [runs(spark.createDataFrame(p, ROWS), "g", "v", "i", run_rows=32) for p in parts]
    merged = states[0].unionByName(states[1]).unionByName(states[2])
    assert result(percentiles(merged, SHARES, run_rows=64)) == {g: (len(v), [exact(v, s) for s in SHARES]) for g, v in by_group(rows).items()}


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_thinned_states_keep_the_stated_error(spark, error):
    rows = [("a", float(i * 7919 % 4001), i) for i in range(4000)]
    state = runs(spark.createDataFrame(rows, ROWS), "g", "v", "i", error=error, run_rows=500)
    kept = state.agg(F.sum(F.size("vals"))).first()[0]
    assert kept < 4000 / 4
    n, values = result(percentiles(state, SHARES, run_rows=100))["a"]
    ordered = sorted(v for _, v, _ in rows)
    assert n == 4000
    for share, value in zip(SHARES, values):
        assert abs(ordered.index(value) + 1 - share * n) <= error * n + 1


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1), ("a", 1.0, 1), ("a", 3.0, 2), ("a", None, 3), ("a", nan, 4), (None, 5.0, 5), ("", 2.0, 6), ("b", inf, 7), ("b", -1.0, 8), ("c", 4.0, None), ("c", 4.0, None), ("d", None, 9)]
    df = spark.createDataFrame(rows, ROWS).withColumn("grp", F.lit("clash")).withColumn("run", F.lit(1)).withColumn("vals", F.lit(2))
    assert result(percentiles(runs(df, "g", "v", "i"), [0.5])) == {"a": (2, [1.0]), "": (1, [2.0]), "b": (2, [-1.0]), "c": (2, [4.0])}


def test_empty(spark):
    assert percentiles(runs(spark.createDataFrame([], ROWS), "g", "v", "i"), SHARES).collect() == []


def test_all_values_equal_in_a_large_group(spark):
    rows = [("a", 2.5, i) for i in range(500)]
    assert result(percentiles(runs(spark.createDataFrame(rows, ROWS), "g", "v", "i", run_rows=16), SHARES, run_rows=16)) == {"a": (500, [2.5] * 3)}
