import random

from pyspark.sql import functions as F

from strandlake.operators.skew import hot_keys, per_key, salted_join

ROWS = "imp string, k bigint, node string, stated int, tie bigint"


def brute(rows):
    out = {}
    for imp, k, node, stated, _ in rows:
        own = out.setdefault((imp, k), [0, set(), []])
        own[0] += 1
        own[1].update([node] if node is not None else [])
        own[2] += [stated] if stated is not None else []
    return {key: (n, len(items), min(s, default=None), max(s, default=None)) for key, (n, items, s) in out.items()}


def found(df):
    return {(r["imp"], r["k"]): (r["n_rows"], r["n_items"], r["stated_min"], r["stated_max"]) for r in df.collect()}


def made(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 7 if rng.random() < 0.5 else rng.randrange(300)
        node = None if rng.random() < 0.05 else f"n{rng.randrange(4 if k == 7 and rng.random() < 0.7 else 60)}"
        rows.append((rng.choice(["a", "b", None]), None if rng.random() < 0.02 else k, node, rng.choice([None, 3, 4]), i))
    return rows + rows[:200]


def test_hot_keys_are_cut_and_stitched(spark):
    for seed, parts in ((1, 13), (2, 40)):
        rows = made(seed)
        df = spark.createDataFrame(rows, ROWS).repartition(5)
        assert found(per_key(df, ["imp", "k"], "node", "stated", "tie", parts)) == brute(rows)


def test_one_item_over_many_partitions_and_small_batches(spark):
    rows = [("a", 1, "same", 5, i) for i in range(500)] + [("a", 2, "x", None, 900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert found(per_key(spark.createDataFrame(rows, ROWS), ["imp", "k"], "node", "stated", "tie", 9)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_and_clashing_names(spark):
    assert per_key(spark.createDataFrame([], ROWS), ["imp", "k"], "node", "stated", "tie").collect() == []
    df = spark.createDataFrame([("a", 1, "", 2, None), ("a", 1, "y" * 70_000, 2, None)], ROWS).withColumns({c: F.lit(0) for c in ("part", "first", "last", "bound", "k0", "item")})
    assert found(per_key(df, ["imp", "k"], "node", "stated", "tie")) == {("a", 1): (2, 2, 2, 2)}


def test_salted_join_is_the_join(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.choice([1] * 30 + list(range(40))), i) for i in range(2000)] + [(None, -1)], "key int, i int")
    right = spark.createDataFrame([(k, k % 3) for k in range(0, 40, 2)] + [(1, 9), (None, 1)], "key int, v int")
    assert 1 in hot_keys(left, "key")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, "key", how)
        assert sorted(map(str, salted_join(left, right, "key", "i", how).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    condition = F.col("l.i") > F.col("r.v") * 500
    expected = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & condition, "left_anti").count()
    assert salted_join(left, right, "key", "i", "left_anti", condition).count() == expected
    assert hot_keys(left.limit(0), "key") == []
