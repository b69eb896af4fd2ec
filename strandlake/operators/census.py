"""Aggregates over nodes, edges and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("total_nodes"), F.count_distinct("individual_id").alias("individuals"), F.count_distinct("chromosome").alias("chromosomes"),
        F.min("start_pos").alias("min_pos"), F.max("end_pos").alias("max_pos"), F.avg("frequency").alias("avg_frequency"), F.avg("segment_length").alias("avg_segment_length"),
    )


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def diversity(nodes: DataFrame) -> DataFrame:
    """Per chromosome: individuals, mean and sample deviation of the frequency (0 for a single node), nodes."""
    return nodes.groupBy("chromosome").agg(
        F.count_distinct("individual_id").alias("individuals"), F.avg("frequency").alias("avg_frequency"),
        F.coalesce(F.stddev_samp("frequency"), F.lit(0.0)).alias("std_frequency"), F.count("*").alias("n_nodes"),
    )


def rare_by_chromosome(nodes: DataFrame, below: float = 0.05, sample: int = 5) -> DataFrame:
    """Rare nodes per chromosome and the first few of the individuals that carry them."""
    rare = nodes.where(F.col("frequency") < below)
    people = rare.groupBy("chromosome", "individual_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("chromosome").orderBy("individual_id"))
    first = people.where("individual_id is not null").withColumn("_r", place).where(F.col("_r") <= sample)  # cut before the shuffle, too
    named = first.groupBy("chromosome").agg(F.array_sort(F.collect_list("individual_id")).alias("individuals"))
    counts = people.groupBy("chromosome").agg(F.sum("n").alias("rare_nodes"))
    same = counts.chromosome.eqNullSafe(named.chromosome)
    return counts.join(named, same, "left").select(counts.chromosome, "rare_nodes", F.coalesce("individuals", F.array().cast("array<string>")).alias("individuals"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin 1..bins; a value equal to ``high`` falls into the last."""
    bin_ = F.least(F.lit(bins), F.floor((F.col(value) - low) / ((high - low) / bins)) + 1)
    return df.where(F.col(value).between(low, high)).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def routes(nodes: DataFrame, first: int = 10) -> DataFrame:
    """Per individual and haplotype: length, complexity, rarity (1 - mean frequency), span and the first nodes in order."""
    in_order = Window.partitionBy("individual_id", "haplotype").orderBy("chromosome", "start_pos", "id")
    head = nodes.withColumn("_r", F.row_number().over(in_order)).where(F.col("_r") <= first)  # cut before the shuffle, too
    head = head.groupBy("individual_id", "haplotype").agg(F.array_sort(F.collect_list(F.struct("_r", "id")))["id"].alias("first_nodes"))
    stats = nodes.groupBy("individual_id", "haplotype").agg(
        F.count("*").alias("path_length"), (F.count("*") / 100.0).alias("complexity"), (1 - F.avg("frequency")).alias("rarity"), (F.max("end_pos") - F.min("start_pos")).alias("span")
    )
    return stats.join(head, ["individual_id", "haplotype"])


def annotation_summary(nodes: DataFrame) -> DataFrame:
    """How many nodes carry each kind of fact, in one pass."""
    return nodes.agg(
        F.count("*").alias("total"), F.count("variant_type").alias("with_variant"), F.count("sequence").alias("with_sequence"),
        F.count("frequency").alias("with_frequency"), F.count("deleted_at").alias("retired"),
    )


def structure(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table: kind, n."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of y with x, its line and a label of how strongly they go together."""
    r = F.corr(x, y)
    return df.agg(
        r.alias("correlation"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.when(r > 0.8, "Linear").when(r > 0.5, "Sub-linear").otherwise("Optimal").alias("scaling"),
    )


def performance_rollup(metrics: DataFrame) -> DataFrame:
    """Of operation, seconds, success: runs, success rate, mean, fastest and slowest operation (ties by name)."""
    return metrics.agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("seconds").alias("mean_seconds"),
        F.min(F.struct("seconds", "operation"))["operation"].alias("fastest"), F.max(F.struct("seconds", "operation"))["operation"].alias("slowest"),
    )


def performance_by(metrics: DataFrame, by: str) -> DataFrame:
    """Of operation, seconds, success per group: runs, success rate, mean seconds and the sorted names of its operations."""
    return metrics.groupBy(by).agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("seconds").alias("mean_seconds"), F.array_sort(F.collect_set("operation")).alias("operations")
    )


def edge_totals(edges: DataFrame) -> DataFrame:
    """total_edges, edge_types."""
    return edges.agg(F.count("*").alias("total_edges"), F.count_distinct("edge_type").alias("edge_types"))


def scaling(times: DataFrame) -> DataFrame:
    """Of (suite, size, seconds) per suite the trend() of seconds over size and its label."""
    r = F.corr("size", "seconds")
    return times.groupBy("suite").agg(
        r.alias("correlation"), F.regr_slope(F.col("seconds"), F.col("size")).alias("slope"), F.when(r > 0.8, "Linear").when(r > 0.5, "Sub-linear").otherwise("Optimal").alias("scaling")
    )
