"""The queries of the subpackage's problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identifier, kmer_code, kmer_text, kmer_valid, label, trimmed
from ..operators.skew import salted_join
from ..plans.tables import table
from ..storage import materialise
from .exact_spans import shared_bases, shared_classes, shared_pairs, without_shared
from .frequent import frequent
from .mixing import keeping_shares, mixture, reached, shares, spread
from .packing import pack
from .percentiles import percentiles, runs
from .reading import reading_levels
from .tokens import token_count
from .top_n import top_n

SHARES = [0.5, 0.9, 0.95, 0.99]


def _tpm(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "expression_result").select(identifier("gene_id").alias("gene_id"), "tpm", "result_id")
    fit = (F.col("tpm") >= 0) & (F.col("tpm") < float("inf"))
    return percentiles(runs(rows.where(fit), "gene_id", "tpm", "result_id"), SHARES)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    median, high = F.get("values", 0), F.get("values", 3)
    return _tpm(spark, folder).where((median > 0) & (high >= 1000 * median)).select(F.col("grp").alias("gene_id"))


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _tpm(spark, folder).select(F.col("grp").alias("gene_id"), "n", *(F.get("values", i).alias(f"p{round(s * 100)}") for i, s in enumerate(SHARES)))


DAY_ERROR = 0.02


def p1_days(spark: SparkSession, folder: str) -> DataFrame:
    """Per gene n, the percentiles from states of single days with a rank error of at most DAY_ERROR x n, and whether their true ranks are within it."""
    rows = table(spark, folder, "expression_result").where((F.col("tpm") >= 0) & (F.col("tpm") < float("inf")))
    rows = rows.select(identifier("gene_id").alias("gene_id"), "tpm", "result_id", F.to_date("analysis_ts").alias("day")).where("gene_id is not null")
    found = materialise(percentiles(runs(rows, "gene_id", "tpm", "result_id", DAY_ERROR, by="day"), SHARES, 256), "days")
    each = found.select(F.col("grp").alias("gene_id"), "n", F.posexplode("values").alias("i", "value"))
    true = rows.select("gene_id", "tpm", "result_id").distinct()
    at = salted_join(true, each, "gene_id", "result_id").groupBy("gene_id", "n", "i").agg(F.count_if(F.col("tpm") < F.col("value")).alias("below"), F.count_if(F.col("tpm") <= F.col("value")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.element_at(F.array(*(F.lit(s) for s in SHARES)), F.col("i") + 1) * F.col("n"), 6)))
    within = (F.col("below") + 1 - DAY_ERROR * F.col("n") <= rank) & (rank <= F.col("upto") + DAY_ERROR * F.col("n"))
    return at.groupBy("gene_id", "n").agg(F.count_if(~within).alias("outside"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_pairs(table(spark, folder, "genome_node"), "id", "sequence")


def p3_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_bases(table(spark, folder, "genome_node"), "id", "sequence")


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Of each node with a shared stretch: how many classes of stretches it is in, and with how many other classes those are linked."""
    members, links = shared_classes(table(spark, folder, "genome_node"), "id", "sequence")
    ends = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("class"))
    degree = ends.groupBy("class").agg(F.count("*").alias("links"))
    some = members.join(links.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi")
    return some.join(degree, "class", "left").groupBy(F.col("ident").alias("id")).agg(F.count("*").alias("classes"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


def p3_removed(spark: SparkSession, folder: str) -> DataFrame:
    """How many letters each node loses when its shared stretches are taken out, and what is left of it."""
    return without_shared(table(spark, folder, "genome_node"), "id", "sequence").select("id", "removed", F.length("sequence").alias("left"))


def _best(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "eqtl_result").select(identifier("gene_id").alias("gene_id"), "pvalue", "eqtl_id")
    return top_n(rows.where("pvalue >= 0 and pvalue <= 1"), "gene_id", "pvalue", "eqtl_id", 5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder).select("gene_id", "eqtl_id")


def p4_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return _best(spark, folder)


def _frequent(spark: SparkSession, folder: str) -> DataFrame:
    text = F.upper(trimmed("sequence"))
    rows = table(spark, folder, "kmer").where(kmer_valid(text)).select(kmer_code(text, checked=True).alias("code"), "kmer_id")
    return frequent(rows, "code", 0.002, "kmer_id").withColumn("sequence", kmer_text(F.col("code")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select("sequence")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder).select("sequence", "n_rows", F.round("share", 6).alias("share"))


CAPACITY = 2048


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").select("doc_id", token_count("text").alias("n_tokens"))
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    packed = _packed(spark, folder).where("container_id is not null")
    filled = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    out = filled.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.withColumn("fill", F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing, counted: every count of faults is 0."""
    sized = table(spark, folder, "documents").select("doc_id", token_count("text").alias("all_tokens"))
    sized = materialise(sized, "sizes")
    packed = materialise(pack(sized, "doc_id", "all_tokens", CAPACITY), "packed")
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count_if(F.col("n_tokens") == CAPACITY).alias("whole"), F.count("*").alias("items"))
    containers = used.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    in_order = Window.partitionBy("doc_id").orderBy("first_token")
    pieces = packed.withColumn("gap", F.col("first_token") - F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens")).over(in_order), F.lit(0)))
    per_doc = pieces.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count("*").alias("n"), F.max(F.abs("gap")).alias("gap"))
    own = sized.join(per_doc, "doc_id", "full")
    needed = F.greatest(F.lit(1), F.ceil(F.col("all_tokens") / CAPACITY))
    faults = own.agg(
        F.count("*").alias("documents"), F.count_if(~F.col("placed").eqNullSafe(F.col("all_tokens"))).alias("tokens_lost"),
        F.count_if(~F.col("n").eqNullSafe(needed)).alias("badly_cut"), F.count_if(F.col("gap") != 0).alias("gaps"),
    )
    full = F.col("tokens") >= 0.95 * (F.col("containers") - 1) * CAPACITY  # at most a twentieth of the room is unused
    return faults.join(containers).select("documents", "tokens_lost", "badly_cut", "gaps", "overfull", full.alias("filled"))


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and what the targets ask; the sizes are taken once."""
    sized = table(spark, folder, "documents").select(F.col("doc_id").alias("ident"), label("source").alias("source"), token_count("text").alias("n_tokens"))
    sized = materialise(sized, "sizes")
    return sized, shares(sized, table(spark, folder, "mix_target").withColumn("source", label("source")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    sized, asked = _sources(spark, folder)
    full = reached(mixture(sized, asked), asked).where("mixed_tokens = own_tokens * max_repeats")  # every document as often as it may be
    return full.where("mixed_tokens < wanted_tokens").select("source")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(*_sources(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, asked = _sources(spark, folder)
    return reached(mixture(sized, asked), asked)


def p8_kept_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The smaller mixture, in which every source that can has its target share."""
    sized, asked = _sources(spark, folder)
    smaller = keeping_shares(asked)
    return reached(mixture(sized, smaller), smaller)


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Per target source: the documents used too often (none), copies that are not numbered 1 to n (none), and whether its tokens lie within 4.5 standard deviations of what was to be drawn."""
    sized, asked = _sources(spark, folder)
    mixed = materialise(mixture(sized, asked), "mixture")
    uses = mixed.groupBy("source", "ident").agg(F.count("*").alias("n"), F.max("copy").alias("top")).join(asked.select("source", "max_repeats"), "source")
    faults = uses.groupBy("source").agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("n") != F.col("top")).alias("misnumbered"))
    near = reached(mixed, asked).join(spread(sized, asked), "source", "left").join(faults, "source", "left")
    off = F.abs(F.col("mixed_tokens") - F.coalesce("expected_tokens", F.lit(0.0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return near.select("source", zero("too_often"), zero("misnumbered"), (off <= 4.5 * F.coalesce("deviation", F.lit(0.0)) + 1e-6).alias("as_drawn"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    ratings = table(spark, folder, "reading_label").select(F.col("doc_id").alias("ident"), "rater", F.col("reading_level").alias("level"))
    return reading_levels(table(spark, folder, "documents"), "doc_id", "text", ratings)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).where("specialist").select("doc_id")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p1_days, p3_found, p3_shared, p3_classes, p3_removed, p4_found, p4_ranked, p5_found, p5_counts, p7_found, p7_containers, p7_fill, p7_invariants, p8_found, p8_mixture, p8_shares, p8_kept_shares, p8_invariants, p9_found, p9_levels)}

_TPM = """
with r as (select distinct result_id, upper(trim(gene_id, ' ' || chr(9))) as gene_id, tpm from expression_result
           where isfinite(tpm) and tpm >= 0 and trim(gene_id, ' ' || chr(9)) <> ''),
o as (select gene_id, tpm, row_number() over (partition by gene_id order by tpm) as i, count(*) over (partition by gene_id) as n from r),
q as (select gene_id, n, max(tpm) filter (i = greatest(1, (50 * n + 99) // 100)) as p50, max(tpm) filter (i = (90 * n + 99) // 100) as p90,
      max(tpm) filter (i = (95 * n + 99) // 100) as p95, max(tpm) filter (i = (99 * n + 99) // 100) as p99 from o group by 1, 2)
"""
_BEST = """
with r as (select distinct upper(trim(gene_id, ' ' || chr(9))) as gene_id, eqtl_id, pvalue from eqtl_result
           where pvalue >= 0 and pvalue <= 1 and trim(gene_id, ' ' || chr(9)) <> ''),
o as (select *, row_number() over (partition by gene_id order by pvalue, eqtl_id)::int as rank from r)
"""
_FREQUENT = """
with k as (select distinct kmer_id, upper(trim(sequence, ' ' || chr(9))) as sequence from kmer
           where regexp_full_match(upper(trim(sequence, ' ' || chr(9))), '[ACGT]{31}')),
c as (select sequence, count(*) as n_rows, round(count(*) / (select count(*) from k), 6) as share from k group by 1
      having count(*) >= 0.002 * (select count(*) from k))
"""
_SHARED = """
with d as (select distinct id, regexp_replace(upper(sequence), '[^ACGT]', 'N', 'g') as s from genome_node where sequence is not null and id is not null),
w as (select id, s, i, substr(s, i::int + 1, 120) as word from (select id, s, unnest(range(length(s) - 119)) as i from d where length(s) >= 120) where not contains(substr(s, i::int + 1, 120), 'N')),
m as (select word from w group by 1 having count(distinct id) > 1),
p as (select w.id, w.s, w.i, w.word from w join m using (word)),
c as (select id, s, count(*) as n from (select distinct id, s, i + j as at from p, (select unnest(range(120)) as j)) group by 1, 2)
"""
ORACLE = {
    "p3_found": _SHARED + "select distinct a.id as id_a, b.id as id_b from p a join p b on a.word = b.word and a.id < b.id",
    "p3_shared": _SHARED + "select d.id, sum(length(d.s)) as length, sum(coalesce(c.n, 0)) as shared from d left join c using (id, s) group by 1",
    "p3_removed": _SHARED + "select d.id, coalesce(c.n, 0) as removed, length(d.s) - coalesce(c.n, 0) as left from d left join c using (id, s)",
    "p1_found": _TPM + "select gene_id from q where p50 > 0 and p99 >= 1000 * p50",
    "p1_days": _TPM + "select gene_id, n, 0 as outside from q",
    "p1_percentiles": _TPM + "select * from q",
    "p4_found": _BEST + "select gene_id, eqtl_id from o where rank <= 5",
    "p4_ranked": _BEST + "select gene_id, pvalue, eqtl_id, rank from o where rank <= 5",
    "p5_found": _FREQUENT + "select sequence from c",
    "p5_counts": _FREQUENT + "select * from c",
    "p7_invariants": "select count(*) as documents, 0 as tokens_lost, 0 as badly_cut, 0 as gaps, 0 as overfull, true as filled from documents",
    "p8_invariants": "select lower(trim(source, ' ' || chr(9))) as source, 0 as too_often, 0 as misnumbered, true as as_drawn from mix_target",
}
