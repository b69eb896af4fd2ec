import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import kmers, standing
from strandlake.operators.seeds import store
from strandlake.plans import core
from strandlake.sources import segments


def letters(dice, n, of="ACGT"):
    return "".join(dice.choice(of) for _ in range(n))


def written(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def family(dice):
    """Nodes, of them copies of two texts (one with a stretch of N), some with a changed end or of other lengths, and one with other letters."""
    one, two = letters(dice, 90), letters(dice, 40) + "N" + letters(dice, 60)
    rows = [(f"c{i:02}", one) for i in range(14)] + [(f"d{i:02}", two + letters(dice, i)) for i in range(12)] + [(f"e{i:02}", one[: 60 + i] + letters(dice, 30)) for i in range(12)]
    return rows + [(f"r{i:02}", letters(dice, 80)) for i in range(20)] + [("a_short", "ACG"), ("b_other", one[:50] + "RYK" + one[50:]), ("z_none", None)]


@pytest.mark.parametrize(("k", "least", "top", "along"), [(11, 0.15, 10, True), (11, 0.5, 3, False), (5, 0.3, 1, True)])
def test_accuracy_is_that_of_all_mappings(spark, monkeypatch, k, least, top, along):
    if not along:
        monkeypatch.setattr(standing, "WANTED", 0)
        monkeypatch.setattr(standing, "LETTERS", 0)
    dice = random.Random(7)
    rows = family(dice)
    nodes = spark.createDataFrame([*rows, rows[0]], "id string, sequence string")
    cut = [(f"{i}_{at}", t[at : at + 45], i, t) for i, t in rows if t for at in range(0, max(1, len(t) - 44), 15)]
    cut += [("wrong", letters(dice, 45), "c00", rows[0][1]), ("changed", rows[40][1][:20] + "A" + rows[40][1][21:45], rows[40][0], rows[40][1]), ("gone", letters(dice, 45), "nowhere", None)]
    reads = spark.createDataFrame(cut, "read_id string, sequence string, true_node string, true_text string")
    want = segments.mapping_accuracy(reads.select("read_id", "sequence", "true_node"), kmers.map_reads(reads, nodes, k, 5, least, top)).first()
    got = standing.accuracy(reads, store(nodes, "id", "nodes"), k, 5, least, top).first()
    assert got["reads"] == want["reads"] == len(cut)
    assert got["accuracy"] == pytest.approx(want["accuracy"], abs=1e-12)
    assert 0 < got["accuracy"] < 1


def test_accuracy_of_names_with_several_texts(spark):
    dice = random.Random(8)
    rows = [("x", letters(dice, 80)), ("x", letters(dice, 90)), ("y", letters(dice, 70))]
    reads = spark.createDataFrame([(f"r{i}", t[:50], i, t) for i, t in rows], "read_id string, sequence string, true_node string, true_text string")
    nodes = spark.createDataFrame(rows, "id string, sequence string")
    want = segments.mapping_accuracy(reads.select("read_id", "sequence", "true_node"), kmers.map_reads(reads, nodes, min_score=0.15)).first()
    assert standing.accuracy(reads, store(nodes, "id", "nodes"), min_score=0.15).first() == want


def test_stored_texts_are_the_given_ones(spark):
    texts = ["ACGTA", "", "acgt", "NNA", "ACGT" * 50, "C", None, "ACGTA"]
    held = store(spark.createDataFrame(list(enumerate(texts)), "id int, sequence string").withColumn("id", F.col("id") % 7), "id", "texts")
    assert sorted((r["id"], r["sequence"]) for r in held.collect()) == [(i, t) for i, t in enumerate(texts[:6])]
    assert held.select("n").distinct().count() == 6


def test_mapping_accuracy_moves_little_more_than_its_texts(spark, tmp_path):
    dice = random.Random(9)
    motif = letters(dice, 70)
    rows = [(f"n{i:05}", letters(dice, 200) + motif + letters(dice, 200)) for i in range(1500)]
    spark.createDataFrame(rows, "id string, sequence string").write.parquet(str(tmp_path / "genome_node.parquet"))
    before = written(spark)
    assert tuple(core.mapping_accuracy(spark, str(tmp_path)).first()) == (3000, 1.0)
    assert written(spark) - before < 2 * sum(len(t) for _, t in rows)
