"""The queries of the general training-data problems: skewed keys (2) and orphan references (6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kmer_code, kmer_text, kmer_valid, trimmed
from ..operators.orphans import OrphanTracker, deletions, parents, references
from ..operators.skew import per_key
from .tables import table


def _kmer_counts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.upper(trimmed("sequence"))
    rows = table(spark, folder, "kmer").where(kmer_valid(text)).select("import_id", kmer_code(text, checked=True).alias("code"), "node_id", "node_count", "kmer_id")
    return per_key(rows, ["import_id", "code"], "node_id", "node_count", "kmer_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    wrong = (F.col("stated_min") != F.col("n_items")) | (F.col("stated_max") != F.col("n_items"))
    return _kmer_counts(spark, folder).where(wrong).select("import_id", kmer_text(F.col("code")).alias("sequence"))


def p2_kmer_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _kmer_counts(spark, folder).select("import_id", kmer_text(F.col("code")).alias("sequence"), F.col("n_items").alias("n_nodes"), F.col("stated_max").alias("stated"))


EPOCHS = 3


def _tracker(spark: SparkSession, folder: str) -> OrphanTracker:
    """The tables' rows in the order in which they came, a third of each table at a time. What the tables say of a row's deletion arrives as an event of its own, a batch after the row."""
    names = ["genome_path", "genome_edge", "transcript_alignment", "genome_node", "transcript_variant"]
    sizes = reduce(DataFrame.unionAll, [table(spark, folder, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]).collect()  # from the files' footers
    size = {r["name"]: max(r["n"], 1) for r in sizes}

    def arriving(name: str, *columns: str) -> DataFrame:
        place = F.floor(F.col("_metadata.row_index") * EPOCHS / F.lit(size[name]))
        return table(spark, folder, name).select(*columns, F.least(place, F.lit(EPOCHS - 1)).cast("int").alias("batch"))

    refs = (
        references(arriving("genome_path", "path_id", "path_nodes", "created_at"), "genome_path", "path_id", "path_nodes", "created_at", "node", "batch")
        .unionByName(references(arriving("genome_edge", "edge_id", "to_node", "created_at"), "genome_edge", "edge_id", "to_node", "created_at", "node", "batch"))
        .unionByName(references(arriving("transcript_alignment", "alignment_id", "transcript_variant_id", "created_at"), "transcript_alignment", "alignment_id", "transcript_variant_id", "created_at", "transcript", "batch"))
    )
    targets = [(arriving("genome_node", "id", "created_at", "deleted_at"), "id", "node"), (arriving("transcript_variant", "transcript_id", "created_at", "deleted_at"), "transcript_id", "transcript")]
    born = reduce(DataFrame.unionByName, [parents(df, row_id, "created_at", None, kind, "batch") for df, row_id, kind in targets])
    gone = reduce(DataFrame.unionByName, [deletions(df, row_id, "created_at", "deleted_at", kind, "batch") for df, row_id, kind in targets])
    tracker = OrphanTracker(spark).stage(refs, born, gone.withColumn("batch", F.col("batch") + 1))
    for batch in range(EPOCHS + 1):
        tracker.take(batch)
    return tracker


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _tracker(spark, folder).open()


def p6_orphans_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return _tracker(spark, folder).snapshot()


def p6_history(spark: SparkSession, folder: str) -> DataFrame:
    """The open orphans per table and month after each batch."""
    return _tracker(spark, folder).history()


QUERIES = {f.__name__: f for f in (p2_found, p2_kmer_nodes, p6_found, p6_orphans_by_month, p6_history)}

_KMER = """
with k as (select import_id, upper(trim(sequence, ' ' || chr(9))) as sequence, node_id, node_count from kmer),
c as (select import_id, sequence, count(distinct node_id) as n_nodes, min(node_count) as low, max(node_count) as high
      from k where regexp_full_match(sequence, '[ACGT]{31}') group by 1, 2)
"""

_ORPHANS = """
with r as (
  select 'genome_path' as ref_table, path_id as ref_id, i as ref_pos, path_nodes[i + 1] as target, 'node' as kind, created_at
  from (select *, unnest(range(len(path_nodes)))::int as i from genome_path)
  union all select 'genome_edge', edge_id, 0, to_node, 'node', created_at from genome_edge
  union all select 'transcript_alignment', alignment_id, 0, transcript_variant_id, 'transcript', created_at from transcript_alignment),
k as (select distinct ref_table, ref_id, ref_pos, kind, upper(trim(target, ' ' || chr(9))) as key, created_at from r
      where trim(target, ' ' || chr(9)) <> ''),
t as (select 'node' as kind, upper(trim(id, ' ' || chr(9))) as key, created_at, deleted_at from genome_node
      union all select 'transcript', upper(trim(transcript_id, ' ' || chr(9))), created_at, deleted_at from transcript_variant),
o as (select distinct ref_table, ref_id, ref_pos, strftime(created_at, '%Y-%m') as period from k where not exists (
      select 1 from t where t.kind = k.kind and t.key = k.key and t.created_at <= k.created_at
      and (t.deleted_at is null or t.deleted_at > k.created_at)))
"""

ORACLE = {
    "p2_found": _KMER + "select import_id, sequence from c where low <> n_nodes or high <> n_nodes",
    "p2_kmer_nodes": _KMER + "select import_id, sequence, n_nodes, high as stated from c",
    "p6_found": _ORPHANS + "select ref_table, ref_id, ref_pos, period from o",
    "p6_orphans_by_month": _ORPHANS
    + """, a as (select ref_table, strftime(created_at, '%Y-%m') as period, count(distinct (ref_id, ref_pos)) as n_refs from k group by 1, 2),
    b as (select ref_table, period, count(*) as n_orphans from o group by 1, 2)
    select a.ref_table, a.period, n_refs, coalesce(n_orphans, 0) as n_orphans from a left join b
    on a.ref_table = b.ref_table and a.period is not distinct from b.period""",
}
