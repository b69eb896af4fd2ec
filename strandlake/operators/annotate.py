"""Annotations laid over nodes: intervals, genes, clinical facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join


def interval_annotations(intervals: DataFrame, nodes: DataFrame, half_open: bool = False) -> DataFrame:
    """A row for each node and overlapping interval (name, score, chromosome, iv_start, iv_end) with the overlap."""
    pairs = overlap_join(intervals, nodes.select("id", "chromosome", "start_pos", "end_pos"), "chromosome", ("iv_start", "iv_end"), ("start_pos", "end_pos"), half_open=half_open)
    return pairs.select("id", "name", "score", "overlap_start", "overlap_end", "overlap_length")


def as_map(annotations: DataFrame) -> DataFrame:
    """id and annotations, a map from the interval's name to its score and overlap; of equal names the leftmost stays."""
    value = F.struct("score", "overlap_start", "overlap_end", "overlap_length")
    one = annotations.groupBy("id", "name").agg(F.min(F.struct("overlap_start", "overlap_end", value.alias("v"))).alias("m"))
    return one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "m.v")))).alias("annotations"))


def gene_annotations(regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and genes, the sorted ids of the gene regions that overlap a scale-0 node."""
    pairs = overlap_join(regions, nodes.where("scale_level = 0").select("id", "chromosome", "start_pos", "end_pos"), "chromosome", ("gene_start", "gene_end"), ("start_pos", "end_pos"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("gene_id")).alias("genes"))


def clinical(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes with the clinical facts known of their (chromosome, start_pos); null where nothing is known."""
    return nodes.join(known, ["chromosome", "start_pos"], "left")


def route_annotations(paths: DataFrame, annotations: DataFrame, first: int = 10) -> DataFrame:
    """Annotations (node_id, ...) of the first nodes of each path, in one join: path_id, pos, and the annotation's columns."""
    each = paths.select("path_id", F.posexplode(F.slice("path_nodes", 1, first)).alias("pos", "node_id"))
    return each.join(annotations, "node_id")
