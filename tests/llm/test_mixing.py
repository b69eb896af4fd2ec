import pytest
from pyspark.sql import functions as F

from strandlake.llm.mixing import capped_mean, keeping_shares, mixture, poisson_steps, reached, shares, spread

DOCS, TARGETS = "ident bigint, source string, n_tokens bigint", "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("rate,cap", [(0.2, 1), (1.3, 2), (0.9, 1), (3.7, 4), (2.0, 9), (900.0, 1000)])
def test_steps_have_the_wanted_mean(rate, cap):
    steps = poisson_steps(rate, cap)
    assert len(steps) == cap and steps == sorted(steps)
    assert abs(sum(1 - b for b in steps) - rate) < 1e-6 * max(1, rate)


def test_rate_beyond_the_cap_uses_everything():
    assert poisson_steps(5.0, 3) == [0.0] * 3
    assert poisson_steps(0.0, 3) == [] == poisson_steps(1.0, 0)
    assert capped_mean(0.5, 1) == pytest.approx(1 - 2.718281828459045**-0.5)


def test_mixture(spark):
    rows = [(i, "large" if i % 10 else "small", 100 + i % 50) for i in range(6000)] + [(7000 + i, "other", 100) for i in range(50)] + [(8000, None, 5), (8001, "large", None)]
    docs = spark.createDataFrame(rows + rows[:100], DOCS).withColumns({c: F.lit(1) for c in ("u", "steps", "copy")})
    docs_once = docs.distinct()
    targets = spark.createDataFrame([("large", 0.75, 2), ("small", 0.2, 4), ("none", 0.05, 3), ("large", 0.75, 2)], TARGETS)
    asked = shares(docs_once, targets)
    by = {r["source"]: r for r in asked.collect()}
    assert len(by) == 3 and by["none"]["own_tokens"] == 0 and not by["none"]["feasible"] and by["large"]["feasible"] and by["small"]["feasible"]
    mixed = mixture(docs, asked).cache()
    copies = mixed.groupBy("ident", "source").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("d"))
    assert copies.where("n <> d or n > case source when 'large' then 2 else 4 end").count() == 0
    got = {r["source"]: r for r in reached(mixed, asked).collect()}
    for source in ("large", "small"):
        assert abs(got[source]["mixed_tokens"] / got[source]["wanted_tokens"] - 1) < 0.1
    assert got["none"]["mixed_tokens"] == 0
    assert sorted(map(tuple, mixture(docs, asked).select("ident", "copy").collect())) == sorted(map(tuple, mixed.select("ident", "copy").collect()))
    order = [r["position"] for r in mixed.collect()]
    assert order == sorted(order)


def test_capped_source_is_used_fully(spark):
    docs = spark.createDataFrame([(i, "a" if i < 10 else "b", 10) for i in range(100)], DOCS)
    asked = shares(docs, spark.createDataFrame([("a", 0.9, 3), ("b", 0.1, 1)], TARGETS))
    got = {r["source"]: r for r in reached(mixture(docs, asked), asked).collect()}
    assert got["a"]["mixed_tokens"] == 300 and not got["a"]["feasible"]


def test_smaller_mixture_keeps_the_shares_of_all_that_can(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(4000)] + [(9000 + i, "c", 10) for i in range(100)], DOCS)
    asked = shares(docs, spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 2)], TARGETS))
    smaller = {r["source"]: r for r in keeping_shares(asked).collect()}
    whole = sum(r["wanted_tokens"] for r in smaller.values() if r["own_tokens"])
    assert abs(smaller["c"]["wanted_tokens"] - 3000) < 1e-6 and abs(whole - 3000 / (0.2 / 0.9)) < 1e-6 and smaller["none"]["rate"] is None
    got = {r["source"]: r["mixed_share"] for r in reached(mixture(docs, keeping_shares(asked)), asked).collect()}
    assert abs(got["a"] - 0.4 / 0.9) < 0.03 and abs(got["b"] - 0.3 / 0.9) < 0.03 and abs(got["c"] - 0.2 / 0.9) < 0.03
    assert keeping_shares(shares(docs, spark.createDataFrame([], TARGETS))).collect() == []


def test_spread_is_that_of_many_seeds(spark):
    docs = spark.createDataFrame([(i, "a", 1 + i % 7) for i in range(200)] + [(900, "z", 4), (901, "a", None)], DOCS)
    asked = shares(docs, spark.createDataFrame([("a", 1.3, 3)], TARGETS))
    row = spread(docs, asked).first()
    sums = [mixture(docs, asked, seed).agg(F.sum("n_tokens")).first()[0] for seed in range(0, 60, 2)]
    mean = sum(sums) / len(sums)
    dev = (sum((x - mean) ** 2 for x in sums) / (len(sums) - 1)) ** 0.5
    assert abs(mean - row["expected_tokens"]) < row["deviation"] and 0.6 < dev / row["deviation"] < 1.5


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    asked = shares(docs, targets)
    assert asked.collect() == [] and mixture(docs, asked).collect() == [] and reached(mixture(docs, asked), asked).collect() == []
