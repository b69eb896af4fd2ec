"""Steps put together: batches of regions, annotation and expression runs, reports, and metrics of one's own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import kmer_code, kmer_text
from ..storage import materialise
from .skew import hot_keys, salted_join
from . import annotate, association, census, graph, intervals, kmers, popgen, rnaseq


def batch_regions(nodes: DataFrame, regions: list[tuple[int, int, int]]) -> DataFrame:
    """For each region (at most 100) and individual: nodes within it, their mean frequency. One job for all.

    The regions are a handful of literals, so they are tested on each node's row
    instead of joined.
    """
    if not regions or len(regions) > 100:
        raise ValueError("give 1 to 100 regions")
    for chromosome, start, end in regions:
        if not 1 <= chromosome <= 25 or start < 0 or end <= start:
            raise ValueError(f"no region: chr{chromosome}:{start}-{end}")
    inside = [
        F.when((F.col("chromosome") == c) & (F.col("start_pos") >= s) & (F.col("end_pos") <= e), F.lit(f"chr{c}:{s}-{e}")) for c, s, e in regions
    ]
    each = nodes.select("individual_id", "frequency", F.explode(F.array_compact(F.array(*inside))).alias("region"))
    return each.groupBy("region", "individual_id").agg(F.count("*").alias("n_nodes"), F.avg("frequency").alias("avg_frequency"))


def comprehensive_query(nodes: DataFrame, edges: DataFrame, annotations: DataFrame, chromosome: int, start: int, end: int, **anchor) -> DataFrame:
    """Diploid routes of a region with the annotations (node_id, annotation_type, value) of each route's first ten nodes, path_length and n_annotations."""
    routes = materialise(graph.diploid_routes(nodes, edges, chromosome, start, end, **anchor), "routes")
    keyed = routes.select(F.concat_ws(":", "individual_id", "haplotype").alias("path_id"), F.col("path").alias("path_nodes"))
    facts = annotate.route_annotations(keyed, annotations).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "annotation_type", "value"))).alias("annotations"))
    joined = routes.withColumn("path_id", F.concat_ws(":", "individual_id", "haplotype")).join(facts, "path_id", "left").drop("path_id")
    return joined.withColumn("path_length", F.size("path").cast("bigint")).withColumn("n_annotations", F.coalesce(F.size("annotations"), F.lit(0)).cast("bigint"))


def annotation_run(nodes: DataFrame, interval_sets: dict[str, DataFrame], genes: DataFrame | None = None, clinical: DataFrame | None = None) -> DataFrame:
    """nodes with maps of overlapping intervals per set, gene ids and clinical facts, as far as they are given."""
    out = nodes
    for name, rows in interval_sets.items():
        found = annotate.as_map(annotate.interval_annotations(rows, nodes))
        out = out.join(found.withColumnRenamed("annotations", name), "id", "left")
    if genes is not None:
        out = out.join(annotate.gene_annotations(genes, nodes), "id", "left")
    return out if clinical is None else annotate.clinical(out, clinical)


def rna_run(reads: DataFrame, transcripts: DataFrame, method: str = "em", k: int = 31) -> tuple[DataFrame, DataFrame]:
    """Alignments and gene expression of reads (read_id, sequence) against transcripts (transcript_id, gene_id, sequence)."""
    found = kmers.align(reads, transcripts.select("transcript_id", "sequence"), k).join(transcripts.select("transcript_id", "gene_id"), "transcript_id")
    rows = found.select(F.concat_ws("|", "read_id", "transcript_id").alias("alignment_id"), "read_id", "transcript_id", "gene_id", F.col("score").alias("alignment_score"), "is_unique")
    rows = materialise(rows, "alignments")
    shares = {"em": rnaseq.em_shares, "unique": rnaseq.unique_shares, "proportional": rnaseq.proportional_shares}[method](rows)
    lengths = transcripts.select("transcript_id", F.length("sequence").alias("length"))
    return rows, rnaseq.expression(shares, rows, lengths, reads.count())


def cohort_run(nodes: DataFrame, phenotype: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """Association of variants with a phenotype: tests, the best of them, the significant ones, the inflation."""
    tests = materialise(association.with_pvalues(association.gwas(popgen.dosages(popgen.presence(nodes)), phenotype)), "tests")
    return {"tests": tests, "top": tests.orderBy("pvalue", "site").limit(top), "significant": tests.where("pvalue < 5e-8"), "inflation": association.genomic_inflation(tests)}


def expression_matrix(expression: DataFrame, genes: list[str]) -> DataFrame:
    """individual_id and a column for each of the named genes; 0 where nothing is known."""
    return expression.where(F.col("gene_id").isin(genes)).groupBy("individual_id").pivot("gene_id", genes).agg(F.sum("level")).fillna(0.0)


def gene_positions(known: DataFrame, placed: DataFrame) -> DataFrame:
    """gene_id, chromosome, tss: as known, else the smallest start among the gene's placed rows."""
    low = placed.groupBy("gene_id").agg(F.min(F.struct("chromosome", "start_pos")).alias("p"))
    joined = low.join(known.select("gene_id", F.col("chromosome").alias("k_chr"), F.col("tss").alias("k_tss")), "gene_id", "full")
    return joined.select("gene_id", F.coalesce("k_chr", "p.chromosome").alias("chromosome"), F.coalesce("k_tss", "p.start_pos").alias("tss"))


def containing_nodes(words: DataFrame, nodes: DataFrame, k: int, per_word: int = 10) -> DataFrame:
    """word, id: nodes whose sequence contains the word of k letters A, C, G, T, at most per_word of them by id; an equi join on k-mers. Repeated words count once."""
    coded = words.select(kmer_code(F.col("word"), k).alias("kmer")).where("kmer is not null").distinct()
    held = kmers.kmer_sets(nodes, "id", "sequence", k)
    met = salted_join(held, coded.hint("merge"), "kmer", "id", hot=hot_keys(kmers.kmer_sets(nodes.sample(0.05, 1), "id", "sequence", k), "kmer"))
    found = met.select(kmer_text(F.col("kmer"), k).alias("word"), "id")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where(F.col("_r") <= per_word).drop("_r")


def candidate_nodes(reads: DataFrame, nodes: DataFrame, k: int = 31, top: int = 5, least: int = 1) -> DataFrame:
    """read_id, id, hits, rank: the nodes that share the most k-mers with each read, ties by id."""
    found = kmers.hits(kmers.kmer_sets(reads, "read_id", "sequence", k), kmers.kmer_sets(nodes, "id", "sequence", k), "read_id", "id", least)
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("hits"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def node_scores(mappings: DataFrame) -> DataFrame:
    """id, total: the summed scores of all reads mapped to a node."""
    return mappings.groupBy("id").agg(F.sum("score").alias("total"))


def load_rollup(samples: DataFrame) -> DataFrame:
    """Of (ts, cpu, memory) samples: samples, duration in seconds, mean and greatest load of each."""
    both = [f(c).alias(f"{name}_{c}") for c in ("cpu", "memory") for name, f in (("mean", F.avg), ("max", F.max))]
    return samples.agg(F.count("*").alias("samples"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration"), *both)


def monitor_rollup(samples: DataFrame, by: str) -> DataFrame:
    """Of (ts, value) samples per operation: samples, duration in seconds, mean and greatest value."""
    return samples.groupBy(by).agg(
        F.count("*").alias("samples"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")
    )


def quality_filter(sequences: DataFrame, column: str, min_length: int = 0, max_unread: float = 1.0) -> DataFrame:
    """Rows whose sequence is long enough and not too full of N; null sequences go."""
    from ..functions.sequence import unread_share

    return sequences.where((F.length(column) >= min_length) & (F.coalesce(unread_share(F.col(column)), F.lit(0.0)) <= max_unread))


def shared_sites(present: DataFrame, first: str, second: str) -> DataFrame:
    """Sites that both individuals have."""
    own = lambda who: present.where(F.col("individual_id") == who).select("site").distinct()
    return own(first).join(own(second), "site", "left_semi")


# The shares of the query patterns that a genome database is tuned for.
PATTERNS = {"region": 0.4, "individual": 0.3, "path": 0.2, "annotation": 0.1}
ESSENTIAL = ("curve_index", "chromosome", "individual_id")


def layout(nodes: DataFrame) -> DataFrame:
    """What of the layout serves as an index: name, type, present (whether the table has the column that it stands on)."""
    rows = [("curve_index", "range", "curve_index"), ("genomic_position", "composite", "chromosome"), ("individual_id", "range", "individual_id"), ("node_id", "unique", "id")]
    return nodes.sparkSession.createDataFrame([(n, t, c in nodes.columns) for n, t, c in rows], "name string, type string, present boolean")


def query_patterns(spark: SparkSession) -> DataFrame:
    """pattern, share."""
    return spark.createDataFrame(list(PATTERNS.items()), "pattern string, share double")


def advice(nodes: DataFrame, files_sorted: bool = False, memory_share: float = 0.0, slow_patterns: list[str] | None = None, most: int = 100_000, full: float = 0.8) -> DataFrame:
    """What to change: rule, advice. By the number of nodes, memory in use, slow query patterns, and columns that are missing."""
    out = []
    if not files_sorted:
        out.append(("sorted_files", "sort files by chromosome, scale_level, start_pos (sinks.exports.write_nodes)"))
    if nodes.count() > most:
        out.append(("composite_layout", "partition by chromosome and scale_level"))
    if memory_share > full:
        out.append(("memory", "give executors more memory, or use more and smaller partitions"))
    out += [("pattern", f"lay tables out for {p} queries, {PATTERNS[p]:.0%} of all") for p in slow_patterns or [] if PATTERNS.get(p, 0) >= 0.2]
    out += [("missing_index", f"store {c}") for c in ESSENTIAL if c not in nodes.columns]
    return nodes.sparkSession.createDataFrame(out, "rule string, advice string")


def timed(operations: dict[str, Callable[[], DataFrame]], spark: SparkSession) -> DataFrame:
    """Runs each operation to its last row: operation, seconds, success, rows. For census.performance_rollup()."""
    taken = []
    for name, make in operations.items():
        began, seen, rows = time.perf_counter(), Observation(), None
        try:
            make().observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
            rows = seen.get["n"]
        except Exception:  # the report says that it failed
            pass
        taken.append((name, time.perf_counter() - began, rows is not None, rows))
    return spark.createDataFrame(taken, "operation string, seconds double, success boolean, rows bigint")


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "overview": census.overview, "diversity": census.diversity, "annotations": census.annotation_summary, "edge_totals": census.edge_totals, "degrees": graph.degrees, "hubs": graph.hubs, "trails": graph.trail_counts,
    "site_frequencies": popgen.site_frequencies, "dosages": popgen.dosages,
}


def register_metric(spark: SparkSession, name: str, function: Callable, kind: str | None = None) -> None:
    """Adds a metric: a function of a DataFrame, or with ``kind`` (a return type) a scalar function of Series, Arrow batch by Arrow batch, for SQL."""
    if kind is None:
        METRICS[name] = function
    else:
        spark.udf.register(name, F.pandas_udf(function, kind))


def metric(name: str, df: DataFrame) -> DataFrame:
    """The metric of that name; a KeyError names those there are."""
    if name not in METRICS:
        raise KeyError(f"no metric {name}; there are {', '.join(sorted(METRICS))}")
    return METRICS[name](df)


def annotation_log(annotated: DataFrame, steps: list[str]) -> DataFrame:
    """Of annotation_run(): step and how many nodes it gave something to."""
    counts = annotated.agg(*(F.count_if(F.col(s).isNotNull()).alias(s) for s in steps))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(s).alias("step"), F.col(s).alias("nodes")) for s in steps))))


def grouped_points(points: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """What a scatter plot by label draws first: label, n, centre_x, centre_y, and the box of its points."""
    return points.groupBy(label).agg(
        F.count("*").alias("n"), F.avg(x).alias("centre_x"), F.avg(y).alias("centre_y"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y")
    )


def exclusive_windows(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions (gene_id, chromosome, gene_start, gene_end) that no node touches."""
    touched = intervals.overlap_join(regions, nodes.select("id", "chromosome", "start_pos", "end_pos"), "chromosome", ("gene_start", "gene_end"), ("start_pos", "end_pos")).select("gene_id").distinct()
    return regions.join(touched, "gene_id", "left_anti")
