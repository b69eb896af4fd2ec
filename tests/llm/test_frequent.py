import random

import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import frequent as module
from strandlake.llm.frequent import frequent

ROWS = "v string, i bigint"


def counts(df, name="v"):
    return {r[name]: r["n_rows"] for r in df.collect()}


def test_strings_with_ids(spark):
    rng = random.Random(2)
    rows = [("top" if k % 3 == 0 else f"m{k % 7}" if k % 3 == 1 else f"rare{rng.random()}", k) for k in range(6000)]
    df = spark.createDataFrame(rows + rows[:500], ROWS).repartition(5)
    expected = {"top": 2000} | {f"m{k}": sum(1 for v, _ in rows if v == f"m{k}") for k in range(7)}
    assert counts(frequent(df, "v", 0.02, "i")) == expected


def test_many_frequent_words_in_few_groups(spark):
    rng = random.Random(4)
    words = [rng.getrandbits(63) for _ in range(60)]
    rows = [(words[k % 60], k) for k in range(6000)] + [(rng.getrandbits(63), k) for k in range(6000, 7000)]
    df = spark.createDataFrame(rows, "v bigint, i bigint")
    assert counts(frequent(df, "v", 0.01, "i", groups=8)) == {w: 100 for w in words}  # nearly all share a group


def test_odd_rows(spark):
    rows = [(None, 1), ("", 2), ("", 3), ("", 3), ("x" * 100_000, 4), ("x" * 100_000, 5), ("a", None), ("a", None), ("b", 6)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("word", "value", "ident", "n_rows", "share")})
    assert counts(frequent(df, "v", 0.25, "i")) == {"": 2, "x" * 100_000: 2, "a": 2}
    assert counts(frequent(df, "v", 0.25)) == {"": 3, "x" * 100_000: 2, "a": 2}


def test_empty(spark):
    assert frequent(spark.createDataFrame([], ROWS), "v", 0.1, "i").collect() == []


def test_code_recovers_from_four_lost_bytes():
    rng = random.Random(6)
    for _ in range(20):
        word = np.array([rng.getrandbits(63)], np.int64)
        code = module.code_bytes(word)[0].astype(np.int64)
        kept = sorted(rng.sample(range(12), 8))
        assert module._solve(module.GENERATOR[kept], code[kept]).astype(np.uint8).tobytes() == word.astype("<i8").tobytes()


def test_negative_words_decode():
    words = np.array([-5], np.int64)
    counts_ = np.zeros((module.PLACES, 16), np.int64)
    counts_[np.arange(module.PLACES), module.symbols(words)[0]] = 100
    assert module._decode(counts_, 50) == [-5]
