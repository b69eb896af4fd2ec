"""Nodes from sequences: multi-scale segmentation, and generated test nodes and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import chromosome_of_header


def segments(sequences: DataFrame, individual: str, haplotype: int, source: str, segment: int = 10_000, factors: tuple[int, ...] = (1, 5, 25)) -> DataFrame:
    """Nodes of every scale of sequences (header, sequence): steps of segment x factor, and one node for the whole.

    Coordinates are 0-based half-open. Frequency is 0.5.
    """
    steps = F.array(*(F.struct(F.lit(i).alias("scale_level"), F.lit(segment * f).cast("bigint").alias("step")) for i, f in enumerate(factors)), F.struct(F.lit(len(factors)).alias("scale_level"), F.length("sequence").cast("bigint").alias("step")))
    rows = sequences.where(F.length("sequence") > 0).select(chromosome_of_header(F.col("header")).alias("chromosome"), "sequence", F.inline(steps))
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("sequence").cast("bigint") - 1, F.col("step"))).alias("start_pos"))
    end = F.least(F.col("start_pos") + F.col("step"), F.length("sequence"))
    out = each.withColumn("end_pos", end.cast("bigint"))
    name = F.format_string(f"{individual}_h{haplotype}_{source}_chr%d_%d_%d_%d", "chromosome", "scale_level", "start_pos", "end_pos")
    return out.select(
        name.alias("id"), F.lit(individual).alias("individual_id"), F.lit(haplotype).alias("haplotype"), F.lit(source).alias("assembly_source"), "chromosome", "start_pos", "end_pos", "scale_level",
        F.lit(0.5).alias("frequency"), F.substring("sequence", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int")).alias("sequence"), (F.col("end_pos") - F.col("start_pos")).alias("segment_length"),
    )


def reference_segments(spark: SparkSession, sequence: str, chromosome: int, segment: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes and linear edges of a reference: ids ref_chr{c}_{scale}_{counter}, the counter running over all scales."""
    base = segments(spark.createDataFrame([(f"chr{chromosome}", sequence)], "header string, sequence string"), "reference", 0, "ref", segment, (1, 10, 100))
    counter = F.row_number().over(Window.orderBy("scale_level", "start_pos")) - 1  # the segments of one given string
    nodes = base.withColumn("id", F.format_string(f"ref_chr{chromosome}_%d_%d", "scale_level", counter)).withColumn("frequency", F.lit(1.0))
    before = F.lag("id").over(Window.partitionBy("scale_level").orderBy("start_pos"))
    edges = nodes.select(before.alias("from_id"), F.col("id").alias("to_id"), F.lit("linear").alias("edge_type")).where("from_id is not null")
    return nodes, edges


def benchmark_nodes(spark: SparkSession, n: int) -> DataFrame:
    """n nodes of 1,000 bases in a row on chromosome 1."""
    start = F.col("id") * 1000
    return spark.range(n).select(
        F.format_string("benchmark_node_%d", "id").alias("id"), F.repeat(F.lit("ATCG"), 250).alias("sequence"), F.lit(1).alias("chromosome"), start.alias("start_pos"), (start + 1000).alias("end_pos"),
        F.lit(0).alias("scale_level"), F.lit(0.5).alias("frequency"),
    )


def simulated_nodes(spark: SparkSession, chromosome: int, start: int, end: int, resolution: int = 0, individuals: int = 5) -> DataFrame:
    """Nodes and who has them, for a display without data: node, start_pos, end_pos, individual_id, haplotype, present.

    A region has size / (1000 x (resolution + 1)) nodes, at least 10 and at most 100; a hash leaves 7 of 10 present.
    """
    n = max(10, min(100, (end - start) // (1000 * (resolution + 1))))
    step = (end - start) / n
    rows = spark.range(n).crossJoin(spark.range(individuals * 2).withColumnRenamed("id", "hap"))  # at most 100 x individuals x 2
    return rows.select(
        F.format_string(f"node_{chromosome}_%d", "id").alias("node"), (start + F.floor(F.col("id") * step)).alias("start_pos"), (start + F.floor((F.col("id") + 1) * step)).alias("end_pos"),
        F.format_string("IND_%d", F.floor(F.col("hap") / 2)).alias("individual_id"), (F.col("hap") % 2).cast("int").alias("haplotype"), (F.pmod(F.xxhash64("id", "hap"), F.lit(10)) < 7).alias("present"),
    )


def simulated_reads(nodes: DataFrame, per_node: int, length: int, seed: int = 0) -> DataFrame:
    """Reads cut from nodes (id, sequence) at places that a hash gives, so every run has the same: read_id, sequence, true_node."""
    fit = nodes.where(F.length("sequence") >= length)
    each = fit.select("id", "sequence", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("i"))
    at = F.pmod(F.xxhash64("id", "i", F.lit(seed)), F.length("sequence") - length + 1)
    return each.select(F.format_string("%s_read_%d", "id", "i").alias("read_id"), F.substring("sequence", (at + 1).cast("int"), F.lit(length)).alias("sequence"), F.col("id").alias("true_node"))


def mapping_accuracy(reads: DataFrame, mappings: DataFrame) -> DataFrame:
    """Of simulated reads: how many, and the share that any of their mappings puts on the true node."""
    right = reads.join(mappings.select("read_id", F.col("id").alias("true_node")).distinct(), ["read_id", "true_node"], "left_semi").select("read_id", F.lit(1).alias("hit"))
    return reads.join(right, "read_id", "left").agg(F.count("*").alias("reads"), F.avg(F.coalesce("hit", F.lit(0))).alias("accuracy"))
