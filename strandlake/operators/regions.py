"""Region predicates and multi-resolution region queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.curve import adaptive_scale, encode_number


def contained(chromosome: int, start: int, end: int, scale: int | None = None) -> Column:
    """Rows that lie within the region; a predicate that reaches the scan."""
    inside = (F.col("chromosome") == chromosome) & (F.col("start_pos") >= start) & (F.col("end_pos") <= end)
    return inside if scale is None else inside & (F.col("scale_level") == scale)


def overlapping(chromosome: int, start: int, end: int) -> Column:
    """Rows that touch the region; both ends count."""
    return (F.col("chromosome") == chromosome) & (F.col("start_pos") <= end) & (F.col("end_pos") >= start)


def curve_region(nodes: DataFrame, chromosome: int, start: int, end: int, scale: int, index: str = "curve_index", order: int = 20) -> DataFrame:
    """Contained rows by way of a stored curve index: the range prunes sorted files, the exact predicate decides.

    Rows without an index are left out.
    """
    low, high = (encode_number(chromosome, p, scale, order=order) for p in (start, end))
    return nodes.where(F.col(index).between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)")) & contained(chromosome, start, end, scale))


def adaptive_region(nodes: DataFrame, chromosome: int, start: int, end: int, budget: int | None = None) -> DataFrame:
    """One row for a region at the resolution its size asks for: scale_used, region_size, node_count, cost."""
    scale = adaptive_scale(end - start, budget)
    return nodes.where(contained(chromosome, start, end, scale)).agg(F.count("*").alias("node_count")).select(
        F.lit(scale).alias("scale_used"), F.lit(end - start).alias("region_size"), "node_count", (F.col("node_count") * (scale + 1)).alias("cost")
    )


def on_chromosome(df: DataFrame, chromosome: int | None) -> DataFrame:
    """df of one chromosome; of all if it is None or 0."""
    return df.where(F.col("chromosome") == chromosome) if chromosome else df


def curve_buckets(nodes: DataFrame, index: str = "curve_index", bits: int = 88) -> DataFrame:
    """Buckets of the stored curve index, its first bits of 112: bucket, n, and the first node id of each."""
    bucket = F.floor(F.col(index) / F.lit(str(1 << bits)).cast("decimal(38,0)")).cast("bigint")
    return nodes.where(F.col(index).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def window_counts(nodes: DataFrame, step: int) -> DataFrame:
    """Rollup of nodes by (chromosome, bin of ``step`` bases): the scale hierarchy computed on demand."""
    return nodes.rollup("chromosome", F.floor(F.col("start_pos") / step).alias("bin")).agg(F.count("*").alias("n"), F.avg("frequency").alias("avg_frequency"))


def restrict_paths(paths: DataFrame, region_nodes: DataFrame) -> DataFrame:
    """path_id, individual_id, haplotype and the path's nodes that are in region_nodes (id), in path order.

    Done by a semi join on the exploded path, so neither side has to be small;
    a path with no such node has an empty array.
    """
    each = paths.select("path_id", F.posexplode("path_nodes").alias("pos", "node"))
    kept = each.join(region_nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    again = kept.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("kept"))
    restricted = F.coalesce(F.col("kept.node"), F.array().cast("array<string>"))
    return paths.select("path_id", "individual_id", "haplotype").join(again, "path_id", "left").select("path_id", "individual_id", "haplotype", restricted.alias("nodes"))
