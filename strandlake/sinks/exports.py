"""Rows of VCF, BED and FASTA exports, and writers."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import folded
from ..operators.temporal import merge_maps
from ..storage import children, drop_path, exists


def vcf_rows(nodes: DataFrame) -> DataFrame:
    """One record for each (chromosome, start_pos): chrom, pos, ref, alt, qual, filter, info, and calls, the genotypes (individual_id, gt) of those that have the variant.

    ALT is the sorted set of sequences, AF that of the first node by id, rounded half up. A
    genotype marks haplotypes 0 and 1; individuals that are not listed are 0/0, so a record grows with its carriers, not with the cohort.
    """
    at = nodes.groupBy("chromosome", "start_pos").agg(F.array_sort(F.collect_set("sequence")).alias("alts"), F.min_by("frequency", "id").alias("af"))
    carried = nodes.where("haplotype in (0, 1)").groupBy("chromosome", "start_pos", "individual_id").agg(
        F.max(F.when(F.col("haplotype") == 0, 1).otherwise(0)).alias("h0"), F.max(F.when(F.col("haplotype") == 1, 1).otherwise(0)).alias("h1")
    )
    calls = carried.groupBy("chromosome", "start_pos").agg(F.collect_list(F.struct("individual_id", F.format_string("%d/%d", "h0", "h1").alias("gt"))).alias("calls"))
    return at.join(calls, ["chromosome", "start_pos"], "left").select(
        F.col("chromosome").cast("string").alias("chrom"), F.col("start_pos").alias("pos"), F.lit("N").alias("ref"), F.array_join("alts", ",").alias("alt"), F.lit(60).alias("qual"), F.lit("PASS").alias("filter"),
        F.format_string("AF=%.3f", "af").alias("info"), "calls",
    )


def vcf_text(nodes: DataFrame, samples: list[str]) -> tuple[list[str], DataFrame]:
    """Header lines and the records as text, sorted by place, with a column for each of the samples; those without the variant are 0/0.

    A text file with a column for each sample needs their names on the driver, so the caller lists them.
    """
    names = sorted(samples)
    # The lines of a VCF header.
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    order = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    rows = vcf_rows(nodes).withColumn("by_name", F.map_from_entries("calls"))
    rows = rows.withColumn("gts", F.transform(order, lambda n: F.coalesce(F.try_element_at("by_name", n), F.lit("0/0"))))
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.col("qual").cast("string"), "filter", "info", F.lit("GT"), F.array_join("gts", "\t"))
    return head, rows.orderBy(F.col("chrom").cast("int"), "pos").select(line.alias("value"))


def simple_vcf(nodes: DataFrame) -> DataFrame:
    """A line for each node with its first ten letters as ALT and its frequency in decimal notation, "." where there is none."""
    share = F.coalesce(F.rtrim(F.col("frequency").cast("decimal(18,9)").cast("string"), F.lit("0")), F.lit("."))
    return nodes.select(F.concat_ws("\t", F.col("chromosome").cast("string"), F.col("start_pos").cast("string"), "id", F.lit("N"), F.substring("sequence", 1, 10), F.lit("60"), F.lit("PASS"), F.concat(F.lit("AF="), share), F.lit("GT"), F.lit("0/1")).alias("value"))


def bed_rows(nodes: DataFrame, annotation: str | None = None) -> DataFrame:
    """chrom, chrom_start, chrom_end, name, score; with ``annotation`` only nodes with a map key that contains it."""
    rows = nodes if annotation is None else nodes.where(F.exists(F.map_keys("annotations"), lambda k: F.contains(k, F.lit(annotation))))
    return rows.select(F.format_string("chr%d", "chromosome").alias("chrom"), (F.col("start_pos") - 1).alias("chrom_start"), F.col("end_pos").alias("chrom_end"), F.col("individual_id").alias("name"), (F.col("frequency") * 1000).cast("int").alias("score"))


def fasta_records(nodes: DataFrame, width: int | None = 80) -> DataFrame:
    """header and sequence of each chromosome and haplotype of each individual, rebuilt from scale-0 nodes in order.

    A gap to the end before is filled with N, one fewer than its length; the first end is 0.
    Lines have ``width`` letters; None gives one line.
    """
    from pyspark.sql import Window

    rows = nodes.where("scale_level = 0 and sequence is not null")
    in_order = Window.partitionBy("individual_id", "chromosome", "haplotype").orderBy("start_pos", "id")
    gap = F.col("start_pos") - F.lag("end_pos", 1, 0).over(in_order) - 1
    pieces = rows.withColumn("piece", F.concat(F.repeat(F.lit("N"), F.greatest(gap, F.lit(0)).cast("int")), F.col("sequence")))
    joined = pieces.groupBy("individual_id", "chromosome", "haplotype").agg(F.array_sort(F.collect_list(F.struct("start_pos", "id", "piece"))).alias("p"))
    text = F.array_join(F.col("p.piece"), "")
    header = F.format_string(">chr%d_h%d_%s", "chromosome", "haplotype", "individual_id")
    return joined.select(header.alias("header"), (text if width is None else folded(text, width)).alias("sequence"))


def write_nodes(nodes: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes by chromosome and scale, sorted by place within files: region predicates then prune folders and row groups."""
    nodes.repartition("chromosome", "scale_level", F.floor(F.col("start_pos") / 50_000_000)).sortWithinPartitions("chromosome", "scale_level", "start_pos").write.mode(mode).partitionBy("chromosome", "scale_level").parquet(path)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) whose ends both exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def individuals(nodes: DataFrame) -> DataFrame:
    """A row for each individual: assembly_source (the first by name), import_date (the earliest), genome_status, haplotypes."""
    return nodes.groupBy(F.col("individual_id").alias("id")).agg(
        F.min("assembly_source").alias("assembly_source"), F.min("created_at").alias("import_date"), F.lit("complete").alias("genome_status"), F.count_distinct("haplotype").alias("haplotypes")
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """old with the rows of new put in: a given value replaces, a null keeps; new keys are added.

    Where a key can come more than once, ``newest`` names the column of new whose largest value says which row holds;
    without it each key must come once in new. Of a key that stands in old several times each row is updated.
    """
    values = [c for c in old.columns if c not in keys]
    if newest:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max(F.struct(newest, *(c for c in rest if c != newest))).alias("_top")).select(*keys, "_top.*")
    fresh = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values if c in new.columns))
    joined = old.join(fresh, keys, "full")
    return joined.select(*keys, *((F.coalesce(f"_new_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in values))


class ResultCache:
    """Results as tables in a shared folder, kept for a time under a name; the folder itself is the catalogue, so it outlives the application."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 3600):
        self.spark, self.folder, self.seconds = spark, folder.rstrip("/"), seconds

    def get(self, name: str, make, seconds: float | None = None) -> DataFrame:
        """The table of that name, made by ``make()`` if it is missing or too old; ``seconds`` says how long a new one is kept."""
        home = f"{self.folder}/{name}"
        for entry in reversed(children(self.spark, home)):
            until = float(entry.split("=")[1].split("-")[0])
            if until > time.time() and exists(self.spark, f"{home}/{entry}/_SUCCESS"):
                return self.spark.read.parquet(f"{home}/{entry}")
            if until <= time.time():
                drop_path(self.spark, f"{home}/{entry}")
        path = f"{home}/until={time.time() + (self.seconds if seconds is None else seconds):.3f}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        return self.spark.read.parquet(path)


def assert_unique(df: DataFrame, *keys: str) -> None:
    """Raises if two rows share the keys."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} is not unique")


def write_kmers(kmers: DataFrame, path: str) -> None:
    """k-mers by import_id; an import that is written again replaces its own rows and no others, and repeated rows are written once."""
    kmers.distinct().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(path)


def merged_annotations(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes (id, annotations map) with new entries (id, name, value) put in; of equal names the new value wins, of several new ones the largest."""
    one = new.where("name is not null").groupBy("id", "name").agg(F.max("value").alias("value"))
    fresh = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_new"))
    return nodes.join(fresh, "id", "left").withColumn("annotations", merge_maps(F.col("annotations"), F.col("_new"))).drop("_new")


def appended(nodes: DataFrame, new: DataFrame, column: str, order: str) -> DataFrame:
    """nodes (id, ``column`` array) with the values of new (id, value, ``order``) put at the end, in that order; a null array counts as empty."""
    more = new.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order, "value")))["value"].alias("_new"))
    kind = nodes.schema[column].dataType
    none = F.array().cast(kind)
    return nodes.join(more, "id", "left").withColumn(column, F.concat(F.coalesce(column, none), F.coalesce(F.col("_new").cast(kind), none))).drop("_new")


def eqtl_rows(tests: DataFrame) -> DataFrame:
    """tests with their allele frequencies (ref_frequency, alt_frequency) as JSON, ready to be appended."""
    return tests.withColumn("allele_frequencies", F.to_json(F.struct(F.col("ref_frequency").alias("ref"), F.col("alt_frequency").alias("alt")))).drop("ref_frequency", "alt_frequency")


def append_rows(rows: DataFrame, path: str) -> int:
    """Adds rows to a table; returns how many."""
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header; arrays, maps and structs as JSON. Returns the number of rows."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    seen = Observation()
    df.withColumns({c: F.to_json(c) for c in nested}).observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(path)
    return seen.get["n"]


def write_json(df: DataFrame, path: str) -> int:
    """A JSON object for each row and line. Returns the number of rows."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def json_rows(df: DataFrame) -> DataFrame:
    """A JSON object for each row: value. Null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def csv_rows(df: DataFrame) -> DataFrame:
    """A line for each row: value; nulls are empty, texts with commas, quotes or line ends are quoted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = lambda c: F.when(text(c).rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    return df.select(F.concat_ws(",", *(quoted(c) for c in df.columns)).alias("value"))


def transcript_fasta(transcripts: DataFrame, width: int = 80) -> DataFrame:
    """A FASTA record for each transcript with a sequence: transcript_id and value, the header line and lines of ``width`` letters."""
    rows = transcripts.where(F.length("sequence") > 0)
    return rows.select("transcript_id", F.concat(F.lit(">"), "transcript_id", F.lit("\n"), folded(F.col("sequence"), width)).alias("value"))


def write_transcripts(transcripts: DataFrame, path: str, each: bool = False) -> None:
    """transcript_fasta() as text, in order of id; ``each`` gives a folder for each transcript, for a few of them only."""
    rows = transcript_fasta(transcripts)
    if each:
        rows.write.mode("overwrite").partitionBy("transcript_id").text(path)
    else:
        rows.repartitionByRange("transcript_id").sortWithinPartitions("transcript_id").select("value").write.mode("overwrite").text(path)


def without_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """nodes whose id does not start with the prefix, such as those of a benchmark."""
    return nodes.where(~F.coalesce(F.startswith("id", F.lit(prefix)), F.lit(False)))


def in_curve_order(nodes: DataFrame, index: str = "curve_index") -> DataFrame:
    """nodes along the curve, ties by id; rows without an index come last."""
    return nodes.orderBy(F.col(index).asc_nulls_last(), "id")


def in_genome_order(nodes: DataFrame) -> DataFrame:
    """nodes by chromosome, start, individual and haplotype, ties by id; nulls last."""
    return nodes.orderBy(*(F.col(c).asc_nulls_last() for c in ("chromosome", "start_pos", "individual_id", "haplotype", "id")))
