"""Transcripts and their expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..storage import materialise
from .intervals import containment_join


def build_transcripts(regions: DataFrame, nodes: DataFrame, max_fill: int = 1000) -> DataFrame:
    """transcript_id, gene_id, individual_id, haplotype, sequence, length of each gene region on each haplotype.

    Scale-0 nodes within the region in order of start; a gap to the end before (at first
    the region's start) is filled with at most ``max_fill`` N, overlaps are just
    joined; on the minus strand the result is reverse complemented. Empty
    sequences do not occur. A group holds one region's nodes of one haplotype.
    """
    inside = containment_join(regions, nodes.where("scale_level = 0 and sequence is not null"), "chromosome", ("gene_start", "gene_end"), ("start_pos", "end_pos"))
    in_order = Window.partitionBy("gene_id", "individual_id", "haplotype").orderBy("start_pos", "id")
    gap = F.col("start_pos") - F.coalesce(F.lag("end_pos").over(in_order), F.col("gene_start"))
    pieces = inside.withColumn("piece", F.concat(F.repeat(F.lit("N"), F.greatest(F.lit(0), F.least(F.lit(max_fill), gap)).cast("int")), F.col("sequence")))
    joined = pieces.groupBy("gene_id", "individual_id", "haplotype", "chromosome", "strand").agg(F.array_sort(F.collect_list(F.struct("start_pos", "id", "piece"))).alias("p"))
    text = F.array_join(F.col("p.piece"), "")
    out = joined.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text))
    name = F.format_string("%s_%s_h%d", "gene_id", "individual_id", "haplotype")
    return out.where("sequence <> ''").select(name.alias("transcript_id"), "gene_id", "individual_id", "haplotype", "sequence", F.length("sequence").cast("bigint").alias("length"))


def unique_shares(alignments: DataFrame) -> DataFrame:
    """gene_id, transcript_id, theta: share of the gene's uniquely aligned reads."""
    counts = alignments.where("is_unique").groupBy("gene_id", "transcript_id").agg(F.count("*").alias("n"))
    return counts.withColumn("theta", F.col("n") / F.sum("n").over(Window.partitionBy("gene_id"))).select("gene_id", "transcript_id", "theta")


def _by_read(alignments: DataFrame) -> DataFrame:
    """alignments with in_read, how many alignments the read has in the gene."""
    counts = alignments.groupBy("gene_id", "read_id").agg(F.count("*").alias("in_read"))
    return alignments.join(counts, ["gene_id", "read_id"])


def proportional_shares(alignments: DataFrame) -> DataFrame:
    """gene_id, transcript_id, theta: a transcript's share p of reads aligned once, plus p / n for its last read aligned n > 1 times.

    Transcripts without such a read are left out; "last" is by alignment_id.
    """
    counted = _by_read(alignments)
    once = counted.where("in_read = 1").groupBy("gene_id", "transcript_id").agg(F.count("*").alias("n"))
    share = once.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("gene_id")))
    last = counted.where("in_read > 1").groupBy("gene_id", "transcript_id").agg(F.max_by("in_read", "alignment_id").alias("in_read"))
    return share.join(last, ["gene_id", "transcript_id"]).select("gene_id", "transcript_id", (F.col("p") + F.col("p") / F.col("in_read")).alias("theta"))


def em_shares(alignments: DataFrame, iterations: int = 50, tolerance: float = 1e-6, unrolled: int = 4) -> DataFrame:
    """gene_id, transcript_id, theta by expectation maximisation, for all genes at once.

    Reads that are aligned once weigh 1 whatever their score, so they enter as one
    count a transcript; only the others are carried through the iterations. A gene
    stops when no theta moves by more than the tolerance. Lineage is cut every
    ``unrolled`` iterations.
    """
    counted = materialise(_by_read(alignments).select("gene_id", "read_id", "transcript_id", "alignment_score", "in_read"), "aligned")
    fixed = counted.where("in_read = 1").groupBy("gene_id", "transcript_id").agg(F.count("*").alias("fixed"))
    many = counted.where("in_read > 1")
    names = counted.select("gene_id", "transcript_id").distinct().join(fixed, ["gene_id", "transcript_id"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(0)))
    theta = materialise(names.withColumn("theta", F.lit(1.0)).withColumn("moved", F.lit(1.0)), "theta")
    done = None
    for _ in range(0, iterations, unrolled):
        for _ in range(unrolled):
            weighed = many.join(theta.select("gene_id", "transcript_id", "theta"), ["gene_id", "transcript_id"]).withColumn("w", F.col("theta") * F.col("alignment_score"))
            total = weighed.groupBy("gene_id", "read_id").agg(F.sum("w").alias("all_w")).where("all_w > 0")
            shared = weighed.join(total, ["gene_id", "read_id"]).groupBy("gene_id", "transcript_id").agg(F.sum(F.col("w") / F.col("all_w")).alias("expected"))
            new = theta.join(shared, ["gene_id", "transcript_id"], "left").withColumn("e", F.col("fixed") + F.coalesce("expected", F.lit(0.0)))
            by_gene = F.sum("e").over(Window.partitionBy("gene_id"))
            now = F.when(by_gene > 0, F.col("e") / by_gene).otherwise(F.col("theta"))
            theta = new.select("gene_id", "transcript_id", "fixed", now.alias("theta"), F.abs(now - F.col("theta")).alias("moved"))
        theta = materialise(theta.withColumn("most", F.max("moved").over(Window.partitionBy("gene_id"))), "theta")
        still = theta.where(F.col("most") > tolerance).drop("most")
        ready = theta.where(F.col("most") <= tolerance).drop("most")
        done = ready if done is None else done.unionByName(ready)
        theta = still
        if theta.isEmpty():
            break
    return done.unionByName(theta).select("gene_id", "transcript_id", "theta")


def expression(shares: DataFrame, alignments: DataFrame, lengths: DataFrame, total_reads: int) -> DataFrame:
    """Per gene: total_expression, raw_counts, effective_length, fpkm, tpm, ci_low, ci_high.

    ``lengths``: transcript_id, length. The effective length is the mean length weighed by
    theta, over transcripts of known length; 1000 if that is 0. A gene with
    alignments but no shares has expression 0.
    """
    raw = alignments.groupBy("gene_id").agg(F.count("*").alias("raw_counts"))
    sums = shares.join(lengths, "transcript_id", "left").groupBy("gene_id").agg(F.sum("theta").alias("total"), F.sum(F.col("theta") * F.coalesce("length", F.lit(0))).alias("weighed"))
    joined = raw.join(sums, "gene_id", "left").withColumn("total_expression", F.coalesce("total", F.lit(0.0)))
    length = F.coalesce(F.nullif(F.try_divide(F.col("weighed"), F.col("total")), F.lit(0.0)), F.lit(1000.0))
    out = joined.withColumn("effective_length", length).withColumn("fpkm", F.col("raw_counts") * 1e9 / (F.col("effective_length") * total_reads))
    return out.select(
        "gene_id", "total_expression", "raw_counts", "effective_length", "fpkm", F.col("fpkm").alias("tpm"), (F.col("total_expression") * 0.9).alias("ci_low"), (F.col("total_expression") * 1.1).alias("ci_high")
    )


def allele_expression(shares: DataFrame, transcripts: DataFrame) -> DataFrame:
    """gene_id, allele (individual and haplotype), expression; by columns, not by taking ids apart."""
    keyed = shares.join(transcripts.select("transcript_id", "individual_id", "haplotype").distinct(), "transcript_id")
    return keyed.groupBy("gene_id", F.concat_ws("_h", "individual_id", F.col("haplotype").cast("string")).alias("allele")).agg(F.sum("theta").alias("expression"))


def summary(results: DataFrame, alignments: DataFrame) -> DataFrame:
    """Genes, expressed genes, mean and median expression, alignments, unique and multiple ones and their shares."""
    genes = results.agg(
        F.count("*").alias("genes"), F.count_if(F.col("total_expression") > 0).alias("expressed"), F.avg("total_expression").alias("mean_expression"), F.median("total_expression").alias("median_expression")
    )
    reads = alignments.agg(F.count("*").alias("alignments"), F.count_if("is_unique").alias("unique_alignments"))
    joined = genes.join(F.broadcast(reads))  # one row each
    joined = joined.withColumn("multi_alignments", F.col("alignments") - F.col("unique_alignments"))
    return joined.withColumns({f"{kind}_rate": F.try_divide(F.col(f"{kind}_alignments"), F.col("alignments")) for kind in ("unique", "multi")})
