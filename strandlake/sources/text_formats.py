"""FASTA, FASTQ, VCF and BED as DataFrames. Compressed files (.gz) are read as they are, in one task each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import chromosome_number, genotype, variant_class


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """header, sequence: a row for each record, lines joined; of equal headers in a file the last record stays.

    Records without a header or without letters are dropped. A record is one row,
    so it must fit in memory; the files are split at record starts.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("v"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))
    parts = raw.select("file", "n", F.trim(F.regexp_replace(F.split("v", "\n", 2)[0], "\r", "")).alias("header"), F.regexp_replace(F.coalesce(F.get(F.split("v", "\n", 2), 1), F.lit("")), r"\s", "").alias("sequence"))
    kept = parts.where("header <> '' and sequence <> ''")
    return kept.groupBy("file", "header").agg(F.max_by("sequence", "n").alias("sequence")).select("header", "sequence")


def numbered_lines(spark: SparkSession, path: str | list[str], keep: Column | None = None) -> DataFrame:
    """file, line (0-based), value of text files that may be split over tasks; with ``keep`` only such lines, numbered among themselves.

    Lines of one block stand together in order; the blocks' line counts, a row for each
    block, give every block's first line number.
    """
    lines = spark.read.text(path)
    lines = (lines if keep is None else lines.where(keep)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("count"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("file", "block", (before - F.col("first")).alias("shift")), ["file", "block"]).select("file", (F.col("n") + F.col("shift")).alias("line"), "value")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """read_id, sequence, quality, ordinal of four-line records; an incomplete last record is left out."""
    at = F.pmod("line", F.lit(4))
    part = lambda i: F.max(F.when(at == i, F.trim(F.regexp_replace("value", "\r", "")))).alias(f"p{i}")
    rows = numbered_lines(spark, path).groupBy("file", F.floor(F.col("line") / 4).alias("ordinal")).agg(part(0), part(1), part(3), F.count("*").alias("n"))
    return rows.where("n = 4").select(F.expr("substr(p0, 2)").alias("read_id"), F.col("p1").alias("sequence"), F.col("p3").alias("quality"), "ordinal")


def inline_reads(spark: SparkSession, sequences: list[str]) -> DataFrame:
    """Reads given as strings: ids api_read_0, ..., and the best quality throughout."""
    numbered = spark.createDataFrame(list(enumerate(sequences)), "ordinal bigint, sequence string")
    return numbered.select(F.format_string("api_read_%d", "ordinal").alias("read_id"), "sequence", F.repeat(F.lit("I"), F.length("sequence")).alias("quality"), "ordinal")


def vcf(spark: SparkSession, path: str, individuals: dict[str, str] | None = None) -> DataFrame:
    """A node for each allele other than the reference on each haplotype of each sample.

    Columns: id, individual_id, haplotype, chromosome, start_pos, end_pos (1-based,
    inclusive), scale_level, frequency (of the allele over 2 x samples), sequence,
    variant_type, vcf_info. Records without ALT are skipped; the genotype's text is
    read, phased or not; "." is no allele. ``individuals`` renames samples.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("##"))
    header = lines.where(F.col("value").startswith("#CHROM")).first()
    samples = header["value"].rstrip("\r\n").split("\t")[9:] if header else []
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    records = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alts"), f[5].try_cast("double").alias("qual"), f[6].alias("filter"),
        F.split(f[8], ":").alias("format"), F.slice(f, 10, max(1, len(samples))).alias("calls"),
    ).where(F.col("alts")[0] != ".")
    gt = lambda call: F.transform(F.split(F.get(F.split(call, ":"), F.array_position("format", "GT").cast("int") - 1), r"[/|]"), lambda a: a.try_cast("int"))
    called = records.withColumn("gts", F.transform("calls", gt))
    names = F.array(*(F.lit((individuals or {}).get(s, s)) for s in samples)) if samples else F.array().cast("array<string>")
    every = called.withColumn("alleles", F.flatten("gts")).select("*", F.posexplode("gts").alias("sample", "gt"))
    each = every.select("*", F.posexplode("gt").alias("haplotype", "allele")).where("allele > 0")
    alt = F.get("alts", F.col("allele") - 1)
    share = F.size(F.filter("alleles", lambda a: a == F.col("allele"))) / (2.0 * max(1, len(samples)))
    person = F.get(names, F.col("sample"))
    out = each.withColumn("alt", alt).withColumn("individual_id", person).where("alt is not null")
    name = F.format_string("vcf_%s_%d_%s_h%d_%d", "chrom", "pos", "individual_id", "haplotype", "allele")
    return out.select(
        name.alias("id"), "individual_id", "haplotype", chromosome_number(F.col("chrom")).alias("chromosome"), F.col("pos").alias("start_pos"), (F.col("pos") + F.length("alt") - 1).alias("end_pos"),
        F.lit(0).alias("scale_level"), share.alias("frequency"), F.col("alt").alias("sequence"), variant_class(F.col("ref"), F.col("alt")).alias("variant_type"),
        F.struct("qual", "filter", "ref", "alt", genotype(F.col("gt")).alias("genotype")).alias("vcf_info"),
    )


def bed(spark: SparkSession, path: str, annotation: str = "annotation") -> DataFrame:
    """chromosome, iv_start, iv_end, name (default annotation_ordinal, among its file's intervals), score (default 1000) of each interval."""
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    rows = numbered_lines(spark, path, (F.col("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    given = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit(""))
    name = F.coalesce(given(3), F.format_string(f"{annotation}_%d", "line"))
    return rows.select(
        chromosome_number(f[0]).alias("chromosome"), f[1].cast("bigint").alias("iv_start"), f[2].cast("bigint").alias("iv_end"), name.alias("name"), F.coalesce(given(4).try_cast("double"), F.lit(1000.0)).alias("score")
    )


def gene_regions(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, chromosome, gene_start, gene_end, strand (default +) from a JSON list."""
    rows = spark.read.schema("gene_id string, chromosome int, start bigint, end bigint, strand string").json(path, multiLine=True)
    return rows.select("gene_id", "chromosome", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), F.coalesce("strand", F.lit("+")).alias("strand"))
