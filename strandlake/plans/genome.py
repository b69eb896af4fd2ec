"""The genome tables as the operators want them, with the same tables as SQL for the oracle.

Repeated rows are collapsed, sequences are in upper case, target ids are trimmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier
from .tables import table

NODE = ["id", "individual_id", "haplotype", "assembly_source", "import_id", "chromosome", "start_pos", "end_pos", "scale_level", "frequency", "segment_length", "variant_type", "created_at", "deleted_at"]


def nodes(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    """Distinct nodes; ``cols`` narrows the scan."""
    rows = table(spark, folder, "genome_node")
    own = [c for c in (cols or (*NODE, "sequence"))]
    return rows.select("id", *(F.upper("sequence").alias("sequence") if c == "sequence" else F.col(c) for c in own if c != "id")).distinct()


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct edges that name both ends; the ends are in the spelling of identifier()."""
    rows = table(spark, folder, "genome_edge").withColumn("from_node", identifier("from_node")).withColumn("to_node", identifier("to_node"))
    return rows.where("to_node is not null and from_node is not null").distinct()


def transcripts(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    """Distinct transcripts, ids in the spelling of identifier(); ``cols`` narrows the scan."""
    rows = table(spark, folder, "transcript_variant")
    rows = rows.select("transcript_id", *(c for c in cols if c != "transcript_id")) if cols else rows
    own = {"transcript_id": identifier("transcript_id"), "gene_id": identifier("gene_id"), "sequence": F.upper("sequence")}
    return rows.select(*(own.get(c, F.col(c)).alias(c) for c in rows.columns)).distinct()


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each path_id; node ids in the spelling of identifier(), null where a path names none."""
    rows = table(spark, folder, "genome_path").withColumn("path_nodes", F.transform("path_nodes", identifier))
    return rows.groupBy("path_id").agg(F.min("individual_id").alias("individual_id"), F.min("haplotype").alias("haplotype"), F.min("path_nodes").alias("path_nodes"))


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Variant calls at exact positions that many haplotypes share, laid out as nodes: the sales of a part by a supplier stand for a site on an individual's haplotype."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        F.concat(F.lit("IND_"), "l_suppkey").alias("individual_id"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("haplotype"), (F.pmod("l_partkey", F.lit(24)) + 1).cast("int").alias("chromosome"),
        (F.col("l_partkey") * 5000).alias("start_pos"), F.lit(0).alias("scale_level"), F.round(F.abs("l_discount") * 10, 1).alias("frequency"),
        F.when(F.col("l_returnflag") == "A", "SNP").when(F.col("l_returnflag") == "R", "deletion").alias("variant_type"),
    )


def call_populations(spark: SparkSession, folder: str) -> DataFrame:
    """The population of each individual of calls(): the region of the supplier's nation."""
    people = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return people.select(F.concat(F.lit("IND_"), "s_suppkey").alias("individual_id"), F.col("r_name").alias("population"))


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "transcript_alignment")
    return rows.withColumn("transcript_variant_id", identifier("transcript_variant_id")).withColumn("gene_id", identifier("gene_id")).distinct()


def gene_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Gene regions laid over the nodes' coordinates, from the parts table."""
    start = F.pmod(F.col("p_partkey") * 3989, F.lit(8_900_000))
    return table(spark, folder, "part").select(
        F.format_string("GENE_%d", "p_partkey").alias("gene_id"), (F.pmod("p_partkey", F.lit(24)) + 1).cast("int").alias("chromosome"),
        start.alias("gene_start"), (start + F.col("p_size") * 100).alias("gene_end"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def populations(spark: SparkSession, folder: str, groups: int = 3) -> DataFrame:
    """Each individual's population, by its number."""
    number = F.substring("individual_id", 4, 20).cast("bigint")
    people = table(spark, folder, "genome_node").select("individual_id").distinct()
    return people.select("individual_id", F.concat(F.lit("POP"), F.pmod(F.floor(number / 3), F.lit(groups)).cast("string")).alias("population"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation events: node_id, annotation_type, value, meta (JSON), ts."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("u_"), F.col("user_id")).alias("node_id"), F.col("event_type").alias("annotation_type"), "value", F.col("props").alias("meta"), "ts", "event_id"
    )


PRELUDE = """
with call_pop as (select 'IND_' || s_suppkey as individual_id, r_name as population from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
node as (select distinct id, individual_id, haplotype, assembly_source, import_id, chromosome, start_pos, end_pos, scale_level,
  frequency, segment_length, variant_type, created_at, deleted_at, upper(sequence) as sequence from genome_node),
edge as (select distinct * replace (upper(trim(from_node, ' ' || chr(9))) as from_node, upper(trim(to_node, ' ' || chr(9))) as to_node)
  from genome_edge where trim(to_node, ' ' || chr(9)) <> '' and trim(from_node, ' ' || chr(9)) <> ''),
tv as (select distinct * replace (upper(sequence) as sequence, nullif(upper(trim(transcript_id, ' ' || chr(9))), '') as transcript_id, nullif(upper(trim(gene_id, ' ' || chr(9))), '') as gene_id) from transcript_variant),
gp as (select path_id, min(individual_id) as individual_id, min(haplotype) as haplotype, min([nullif(upper(trim(x, ' ' || chr(9))), '') for x in path_nodes]) as path_nodes from genome_path group by 1),
gn as (select distinct upper(trim(id, ' ' || chr(9))) as id, chromosome, variant_type from genome_node),
aln as (select distinct * replace (nullif(upper(trim(transcript_variant_id, ' ' || chr(9))), '') as transcript_variant_id,
  nullif(upper(trim(gene_id, ' ' || chr(9))), '') as gene_id) from transcript_alignment),
region as (select 'GENE_' || p_partkey as gene_id, (p_partkey % 24 + 1)::int as chromosome, (p_partkey * 3989) % 8900000 as gene_start,
  (p_partkey * 3989) % 8900000 + p_size * 100 as gene_end, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part),
pop as (select distinct individual_id, 'POP' || ((substr(individual_id, 4)::bigint // 3) % 3) as population from genome_node),
call as (select 'IND_' || l_suppkey as individual_id, (l_linenumber % 2)::int as haplotype, (l_partkey % 24 + 1)::int as chromosome, l_partkey * 5000 as start_pos, round(abs(l_discount) * 10, 1) as frequency,
  case l_returnflag when 'A' then 'SNP' when 'R' then 'deletion' end as variant_type from lineitem),
event as (select 'u_' || user_id as node_id, event_type as annotation_type, value, props as meta, ts, event_id from events)
"""
