import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import curve, sequence
from strandlake.functions.statistics import bh_qvalues, chi2_tail, chi2_yates, odds_ratio, slope_tail, student_tail
from strandlake.functions.text import identifier, kmer_code, kmer_text
from strandlake.sources import config


def test_curve_round_trip_and_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 26), rng.randrange(1 << 28), rng.randrange(4), rng.randrange(1 << 20)) for _ in range(200)]
    df = spark.createDataFrame(rows, "c int, p bigint, s int, t bigint")
    out = df.select("*", curve.encode(F.col("c"), F.col("p"), F.col("s"), F.col("t"), 28).alias("i")).select("*", curve.decode(F.col("i"), 28).alias("d")).collect()
    for r in out:
        assert tuple(r["d"]) == (r["c"], r["p"], r["s"], r["t"])
        assert int(r["i"]) == curve.encode_number(r["c"], r["p"], r["s"], r["t"], 28)
    small = df.select(curve.encode(F.col("c"), F.col("p"), F.col("s"), order=15).alias("i"), "*").first()
    assert small["i"] == curve.encode_number(small["c"], small["p"], small["s"], order=15)
    for _ in range(200):
        a = [rng.randrange(1 << 20) for _ in range(4)]
        b = [x + rng.randrange(1 << 10) for x in a]
        assert curve.encode_number(*a, order=21) <= curve.encode_number(*b, order=21)


@pytest.mark.parametrize("size,budget,scale", [(100, 1000, 0), (10_000, 50, 2), (10_000, None, 1), (5_000_000, None, 2), (10**8, 1, 3)])
def test_adaptive_scale(size, budget, scale):
    assert curve.adaptive_scale(size, budget) == scale


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN", "A", "T")], "s string, r string, a string")
    row = df.select(
        sequence.reverse_complement(F.col("s")).alias("rc"), sequence.variant_class(F.lit("A"), F.lit("ATT")).alias("ins"), sequence.variant_class(F.lit("AA"), F.lit("TT")).alias("cx"),
        sequence.folded(F.lit("A" * 85 + "C"), 80).alias("f"), sequence.folded(F.lit("A" * 80), 80).alias("f80"), sequence.genotype(F.array(F.lit(0), F.lit(1))).alias("g"), sequence.unread_share(F.col("s")).alias("u"),
        *(sequence.chromosome_of_header(F.lit(h)).alias(f"h{i}") for i, h in enumerate(("chr10 x", "chr2", "chromosome_7", "chrX", "chrM", "scaffold"))),
    ).first()
    assert row["rc"] == "NACGT" and row["ins"] == "insertion" and row["cx"] == "complex" and row["g"] == "0/1" and row["u"] == 0.2
    assert row["f"] == "A" * 80 + "\n" + "A" * 5 + "C" and row["f80"] == "A" * 80
    assert [row[f"h{i}"] for i in range(6)] == [10, 2, 7, 23, 25, 25]


def test_kmer_codes(spark):
    texts = ["ACGT" * 7 + "ACG", "T" * 31, "A" * 31, "ACG", "N" * 31, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", kmer_code(F.col("t")).alias("c")).withColumn("back", kmer_text(F.col("c"))).collect()
    assert [r["back"] for r in rows] == [*texts[:3], None, None, None]
    assert rows[2]["c"] == 0 and rows[1]["c"] == 4**31 - 1
    assert spark.createDataFrame([(" a\t",), (" \t",), (None,)], "t string").select(identifier("t").alias("i")).collect() == [("A",), (None,), (None,)]


def test_statistics(spark):
    tables = [(10, 20, 30, 40), (2, 0, 0, 2), (0, 0, 1, 2)]
    df = spark.createDataFrame([tuple(map(float, t)) for t in tables], "a double, b double, c double, d double")
    cells = [F.col(x) for x in "abcd"]
    rows = df.select(chi2_yates(*cells).alias("x"), odds_ratio(*cells).alias("o")).withColumn("p", chi2_tail("x")).collect()
    assert rows[0]["x"] == pytest.approx(0.446428571) and rows[0]["p"] == pytest.approx(0.504035867)
    assert rows[1]["x"] == pytest.approx(1.0) and rows[1]["p"] == pytest.approx(0.317310508) and rows[1]["o"] == 25
    assert rows[2]["x"] is None
    assert student_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and student_tail(0.0, 5) == pytest.approx(1.0)
    one = spark.createDataFrame([(0.5, 12.0), (1.0, 5.0), (0.3, 2.0)], "r double, n double").select(slope_tail("r", "n").alias("p")).collect()
    assert one[0]["p"] == pytest.approx(student_tail(math.sqrt(10), 10)) and one[1]["p"] == pytest.approx(0) and one[2]["p"] is None


def test_bh(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.03, 0.9]
    got = [r["qvalue"] for r in bh_qvalues(spark.createDataFrame([(i, p) for i, p in enumerate(ps)] + [(9, None)], "i int, p double"), "p").orderBy("i").collect()]
    order = sorted(range(6), key=lambda i: ps[i])
    q, best = [0.0] * 6, 1.0
    for rank in range(6, 0, -1):
        best = min(best, ps[order[rank - 1]] * 6 / rank)
        q[order[rank - 1]] = best
    assert got[:6] == pytest.approx(q) and got[6] is None
    many = [(g, ((i * 7919) % 997 / 997) ** 2) for g in ("a", "b") for i in range(300 if g == "a" else 50)]
    rows = bh_qvalues(spark.createDataFrame(many, "g string, p double"), "p", ["g"]).collect()
    for g in ("a", "b"):
        own = sorted(p for k, p in many if k == g)
        expected, best = {}, 1.0
        for rank in range(len(own), 0, -1):
            best = min(best, own[rank - 1] * len(own) / rank)
            expected[own[rank - 1]] = min(best, expected.get(own[rank - 1], 1.0))
        assert {r["p"]: r["qvalue"] for r in rows if r["g"] == g} == pytest.approx(expected)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"processing": {"k": 21}, "own": {"x": 1}}')
    got = config.load(str(tmp_path / "c.json"), curve={"order": 28})
    assert got["processing"]["k"] == 21 and got["processing"]["segment_size"] == 10_000 and got["own"] == {"x": 1} and got["curve"]["order"] == 28


def test_tails_side_by_side_as_one_by_one():
    import numpy as np

    from strandlake.functions.statistics import student_tail, student_tails

    t = np.array([0.0, 0.1, 1.0, 2.5, 9.0, 60.0, np.inf, 0.5])
    df = np.array([1.0, 3.0, 8.0, 30.0, 4.0, 500.0, 7.0, 100000.0])
    assert np.allclose(student_tails(t, df), [student_tail(float(a), float(b)) for a, b in zip(t, df)], rtol=1e-9, atol=1e-300)
    assert len(student_tails(np.array([]), np.array([]))) == 0
