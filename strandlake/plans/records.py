"""Queries of writers, exports, suites and whole runs, each through what it writes or puts together, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curve
from ..functions.text import kmer_valid, trimmed
from ..operators import annotate, association, kmers, pipelines, popgen, regions, temporal
from ..sinks import exports
from ..sources import segments
from ..storage import materialise, new_path
from .core import _phenotype, _present, _rna_reads, _targets, _tiled, r6
from .genome import PRELUDE, calls, events, gene_regions, nodes, transcripts
from .tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = PRELUDE + sql
        return f

    return register


# --- writers, read back


_KMERS = """, k as (select distinct import_id, upper(trim(sequence, ' ' || chr(9))) as sequence, node_id, found_pos from kmer where regexp_full_match(upper(trim(sequence, ' ' || chr(9))), '[ACGT]{31}'))"""


@query(_KMERS + " select import_id, count(*) as occurrences, count(distinct sequence) as kmers from k group by 1")
def kmer_store(spark: SparkSession, d: str) -> DataFrame:
    """k-mers written by import, one import written twice, and counted from the store."""
    text = F.upper(trimmed("sequence"))
    rows = table(spark, d, "kmer").where(kmer_valid(text)).select("import_id", text.alias("sequence"), "node_id", "found_pos")
    path = new_path(spark, "kmers")
    exports.write_kmers(rows, path)
    exports.write_kmers(rows.where(F.col("import_id") == rows.agg(F.min("import_id")).first()[0]), path)
    return spark.read.parquet(path).groupBy("import_id").agg(F.count("*").alias("occurrences"), F.count_distinct("sequence").alias("kmers"))


@query("select chromosome, scale_level, count(*) as n, min(start_pos) as first, max(end_pos) as last from node group by 1, 2")
def node_store(spark, d):
    """Nodes written by chromosome and scale, in order of place, and summed up from the store."""
    path = new_path(spark, "nodes")
    exports.write_nodes(nodes(spark, d, "individual_id", "haplotype", "chromosome", "start_pos", "end_pos", "scale_level"), path)
    rows = spark.read.parquet(path).groupBy("chromosome", "scale_level").agg(F.count("*").alias("n"), F.min("start_pos").alias("first"), F.max("end_pos").alias("last"))
    return rows.select("chromosome", "scale_level", "n", "first", "last")


_STORED = "chromosome = 1 and start_pos >= 1000000 and end_pos <= 7000000"


@query(f"select id, start_pos from node where {_STORED} and scale_level = 0")
def region_from_store(spark, d):
    """A region of one scale from nodes stored with their curve index and sorted by it: the folder is chosen by name, row groups by the index's range."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "scale_level").withColumn("curve_index", curve.encode(F.col("chromosome"), F.col("start_pos"), F.col("scale_level"), order=28))
    path = new_path(spark, "curve")
    rows.repartition("chromosome", "scale_level").sortWithinPartitions("chromosome", "scale_level", "curve_index").write.partitionBy("chromosome", "scale_level").parquet(path)
    return regions.curve_region(spark.read.parquet(path), 1, 1_000_000, 7_000_000, 0, order=28).select("id", "start_pos")


@query("select id, start_pos, row_number() over (order by chromosome, start_pos, individual_id, haplotype, id) as place from node qualify place <= 1000")
def genome_order(spark, d):
    """The first thousand nodes in the genome's order."""
    rows = exports.in_genome_order(nodes(spark, d, "chromosome", "start_pos", "individual_id", "haplotype")).limit(1000)
    return rows.select("id", "start_pos", F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_last() for c in ("chromosome", "start_pos", "individual_id", "haplotype", "id")))).cast("bigint").alias("place"))  # a thousand rows


@query("select id, start_pos from node where scale_level = 0 and chromosome = 1 order by start_pos, id limit 100")
def curve_order(spark, d):
    """The first hundred nodes of one chromosome and scale along the curve, which there is the order of starts."""
    rows = nodes(spark, d, "chromosome", "start_pos", "scale_level").where("scale_level = 0 and chromosome = 1")
    return exports.in_curve_order(rows.withColumn("curve_index", curve.encode(F.col("chromosome"), F.col("start_pos"), F.col("scale_level"), order=28))).limit(100).select("id", "start_pos")


@query("""select id, list_sort(list_concat(case when any_value(v) is null then [] else ['variant=' || any_value(v)] end, list(distinct g))) as annotations from (
  select n.id, n.variant_type as v, r.gene_id || '=' || round(least(gene_end, end_pos) - greatest(gene_start, start_pos) + 1)::bigint as g
  from node n join region r on n.chromosome = r.chromosome and gene_start <= end_pos and gene_end >= start_pos) group by 1""")
def node_annotations(spark, d):
    """Nodes' annotation maps after an update with the genes that overlap them."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "variant_type")
    own = rows.select("id", F.when(F.col("variant_type").isNotNull(), F.create_map(F.lit("variant"), F.col("variant_type"))).alias("annotations"))
    found = annotate.interval_annotations(gene_regions(spark, d).select(F.col("gene_id").alias("name"), F.lit(0.0).alias("score"), "chromosome", F.col("gene_start").alias("iv_start"), F.col("gene_end").alias("iv_end")), rows)
    new = found.select("id", "name", F.col("overlap_length").cast("string").alias("value"))
    out = exports.merged_annotations(own.join(new.select("id").distinct(), "id", "left_semi"), new)
    return out.select("id", F.array_sort(F.transform(F.map_entries("annotations"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("annotations"))


@query("""select n.id, list(r.gene_id order by r.gene_start, r.gene_id) as genes from node n join region r on n.chromosome = r.chromosome and gene_start <= end_pos and gene_end >= start_pos group by 1""")
def node_gene_lists(spark, d):
    """Nodes' gene lists after genes were put at their end, in order of place."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos")
    found = annotate.interval_annotations(gene_regions(spark, d).select(F.col("gene_id").alias("name"), F.lit(0.0).alias("score"), "chromosome", F.col("gene_start").alias("iv_start"), F.col("gene_end").alias("iv_end")), rows)
    placed = found.join(gene_regions(spark, d).select(F.col("gene_id").alias("name"), "gene_start"), "name").select("id", F.col("name").alias("value"), F.struct("gene_start", "name").alias("place"))
    empty = rows.select("id", F.lit(None).cast("array<string>").alias("genes")).join(placed.select("id").distinct(), "id", "left_semi")
    return exports.appended(empty, placed, "genes", "place")


_EXPRESSED = """, x as (select distinct result_id, upper(trim(gene_id, ' ' || chr(9))) as gene_id, sample_id, total_expression, analysis_ts from expression_result where trim(gene_id, ' ' || chr(9)) <> '')"""


@query(_EXPRESSED + " select gene_id, max({'t': analysis_ts, 'r': result_id, 'v': total_expression}).v as total_expression, max(analysis_ts) as analysis_ts from x group by 1")
def gene_upsert(spark, d):
    """A row for each gene, its values those of the newest result: results put into an empty table, then all of them once more."""
    rows = _expressed(spark, d).select("gene_id", "total_expression", "analysis_ts", "result_id")
    new = rows.withColumn("newest", F.struct("analysis_ts", "result_id")).drop("result_id")
    empty = new.select("gene_id", "total_expression", "analysis_ts").where("false")
    once = exports.upsert(empty, new, ["gene_id"], "newest")
    return exports.upsert(once, new, ["gene_id"], "newest")


def _expressed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "expression_result").withColumn("gene_id", F.upper(trimmed("gene_id"))).where("gene_id <> ''")
    return rows.select("result_id", "gene_id", "sample_id", "total_expression", "tpm", "analysis_ts").distinct()


@query("""select gene_id, count(*) as n, min(f) as first from (select distinct eqtl_id, upper(trim(gene_id, ' ' || chr(9))) as gene_id, allele_frequencies as f from eqtl_result where trim(gene_id, ' ' || chr(9)) <> '' and allele_frequencies is not null) group by 1""".replace("min(f)", "min(json_extract_string(f, '$.alt')::double)"))
def eqtl_store(spark, d):
    """eQTL rows appended in two parts, with their frequencies as JSON, and read back."""
    rows = table(spark, d, "eqtl_result").where("allele_frequencies is not null").select("eqtl_id", F.upper(trimmed("gene_id")).alias("gene_id"), F.from_json("allele_frequencies", "ref double, alt double").alias("f")).where("gene_id <> ''").distinct()
    flat = exports.eqtl_rows(rows.select("eqtl_id", "gene_id", F.col("f.ref").alias("ref_frequency"), F.col("f.alt").alias("alt_frequency")))
    path = new_path(spark, "eqtl")
    for part in (0, 1):
        exports.append_rows(flat.where(F.pmod("eqtl_id", F.lit(2)) == part), path)
    back = spark.read.parquet(path)
    return back.groupBy("gene_id").agg(F.count("*").alias("n"), F.min(F.get_json_object("allele_frequencies", "$.alt").cast("double")).alias("first"))


@query("select node_id, annotation_type, count(*) as n, max_by(value, (ts, event_id)) as value, max(meta) as meta from (select node_id, annotation_type, value, ts, event_id, '{\"event_id\":' || event_id || '}' as meta from event) group by 1, 2")
def annotation_store(spark, d):
    """Time-stamped annotations with tags, appended and read back: how many, and the newest value."""
    path = new_path(spark, "annotations")
    exports.append_rows(temporal.annotation(events(spark, d), "node_id", "annotation_type", "value", "ts", ["event_id"]), path)
    back = spark.read.parquet(path).withColumn("event_id", F.get_json_object("meta", "$.event_id").cast("bigint"))
    return temporal.latest(back).drop("ts").join(back.groupBy("node_id", "annotation_type").agg(F.count("*").alias("n"), F.max("meta").alias("meta")), ["node_id", "annotation_type"])


# --- exports


@query(f"""select '"' || id || '",' || start_pos || ',' || coalesce(frequency::decimal(18, 9)::varchar, '') as value from (select id || ', "' || individual_id || '"' as id, start_pos, frequency from node where {_STORED})""".replace("'\"' || id || '\",'", "'\"' || replace(id, '\"', '\"\"') || '\",'"))
def csv_export(spark, d):
    """A region's nodes as CSV lines."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "individual_id", "frequency").where(regions.contained(1, 1_000_000, 7_000_000))
    return exports.csv_rows(rows.select(F.concat("id", F.lit(', "'), "individual_id", F.lit('"')).alias("id"), "start_pos", F.col("frequency").cast("decimal(18,9)").alias("frequency")))


@query(f"select to_json({{'id': id, 'start_pos': start_pos, 'scale_level': scale_level}})::varchar as value, count(*) over () as n from node where {_STORED}")
def json_export(spark, d):
    """A region's nodes as JSON lines, with the number of rows that the writer counted."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "scale_level").where(regions.contained(1, 1_000_000, 7_000_000)).select("id", "start_pos", "scale_level")
    path = new_path(spark, "json")
    n = exports.write_json(rows, path)
    return exports.json_rows(spark.read.schema(rows.schema).json(path)).withColumn("n", F.lit(n).cast("bigint"))


@query("select id, start_pos, frequency from node where chromosome = 2")
def csv_roundtrip(spark, d):
    """A chromosome's nodes written as CSV and read back."""
    rows = nodes(spark, d, "chromosome", "start_pos", "frequency").where("chromosome = 2").drop("chromosome")
    path = new_path(spark, "csv")
    exports.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("select transcript_id, length(sequence) + (length(sequence) - 1) // 80 + length(transcript_id) + 2 as letters, md5(sequence) as digest from tv where sequence <> ''")
def transcript_fasta(spark, d):
    """Each transcript's FASTA record: its length and the digest of its letters without line ends."""
    rows = exports.transcript_fasta(transcripts(spark, d, "sequence"))
    body = F.replace(F.element_at(F.split("value", "\n", 2), 2), F.lit("\n"), F.lit(""))
    return rows.select("transcript_id", F.length("value").cast("bigint").alias("letters"), F.md5(body).alias("digest"))


@query("select 'chr' || chromosome as chrom, start_pos - 1 as chrom_start, end_pos as chrom_end, individual_id as name, trunc(frequency * 1000)::int as score from node where variant_type like '%tion%'")
def bed_of_annotated(spark, d):
    """BED rows of the nodes with an annotation whose name contains "tion" (an insertion or deletion)."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "individual_id", "frequency", "variant_type")
    return exports.bed_rows(rows.withColumn("annotations", F.when(F.col("variant_type").isNotNull(), F.create_map("variant_type", F.lit("yes")))), "tion")


# --- filters, listings and suites


@query("select chromosome, start_pos, variant_type, count(*) as n, min(id) as first_id, min_by(frequency, id) as frequency from node where scale_level = 0 and variant_type is not null group by 1, 2, 3")
def variant_sites(spark, d):
    return popgen.site_facts(nodes(spark, d, "chromosome", "start_pos", "scale_level", "variant_type", "frequency"))


@query("select 0 as asked, count(*) as n from node union all select 7, count(*) from node where chromosome = 7")
def optional_chromosome(spark, d):
    rows = nodes(spark, d, "chromosome")
    return reduce(DataFrame.unionAll, [regions.on_chromosome(rows, c).agg(F.lit(c).alias("asked"), F.count("*").alias("n")) for c in (0, 7)])


@query("select id from node where id not like 'IND000011%'")
def without_prefix(spark, d):
    return exports.without_prefix(nodes(spark, d, "chromosome"), "IND000011").select("id")


@query("select n as nodes, count(*) as made, sum(length(s)) as letters, max((i + 1) * 1000) as last from (values (100), (500), (1000), (5000)) t(n), lateral (select unnest(range(t.n)) as i, repeat('ATCG', 250) as s) group by 1")
def import_suite(spark, d):
    """The import suite's nodes, written, counted from what was written, and taken out again."""
    out = []
    for n in (100, 500, 1000, 5000):
        path = new_path(spark, "import")
        segments.benchmark_nodes(spark, n).write.parquet(path)
        back = spark.read.parquet(path)
        assert exports.without_prefix(back, "benchmark_node_").isEmpty()
        out.append(back.agg(F.lit(n).alias("nodes"), F.count("*").alias("made"), F.sum(F.length("sequence")).alias("letters"), F.max("end_pos").alias("last")))
    return reduce(DataFrame.unionAll, out)


@query("select n as asked, count(*) as got, max(id) as last from (values (100), (1000), (10000), (50000)) t(n) join (select id, row_number() over (order by id) as r from node) on r <= t.n group by 1")
def limit_suite(spark, d):
    """The first rows by id, for each of the suite's limits."""
    rows = nodes(spark, d, "scale_level").select("id")
    return reduce(DataFrame.unionAll, [rows.orderBy("id").limit(n).agg(F.lit(n).alias("asked"), F.count("*").alias("got"), F.max("id").alias("last")) for n in (100, 1000, 10_000, 50_000)])


@query("select eqtl_id, pvalue from (select distinct eqtl_id, pvalue from eqtl_result where pvalue >= 0 and pvalue <= 1) order by pvalue, eqtl_id limit 10")
def eqtl_best(spark, d):
    rows = table(spark, d, "eqtl_result").where("pvalue >= 0 and pvalue <= 1").select("eqtl_id", "pvalue").distinct()
    return rows.orderBy("pvalue", "eqtl_id").limit(10)


@query(_EXPRESSED.replace("total_expression, analysis_ts from", "total_expression, analysis_ts, tpm from") + " select gene_id, round(avg(total_expression), 6) as mean_expression, count(*) as n from x where isfinite(total_expression) group by 1 order by avg(total_expression) desc, 1 limit 5")
def top_genes(spark, d):
    rows = _expressed(spark, d).where(~F.isnan("total_expression") & (F.abs("total_expression") < float("inf")))
    return rows.groupBy("gene_id").agg(F.avg("total_expression").alias("m"), F.count("*").alias("n")).orderBy(F.desc("m"), "gene_id").limit(5).select("gene_id", r6("m", "mean_expression"), "n")


@query()
def mapping_of_first_reads(spark, d):
    """A caller's request with limits: the first 20 reads and up to 3 results for each."""
    return kmers.map_reads(kmers.first_reads(_tiled(spark, d), 20), nodes(spark, d, "sequence"), min_score=0.2, top=3).select("read_id", "id", "hits", r6("score", "score"), "rank")


@query("select bucket, count(*) as n, min(id) as first_id from (select id, floor(start_pos / 4194304)::bigint as bucket from node where scale_level = 0 and chromosome = 1) group by 1")
def start_buckets(spark, d):
    """Buckets by the first bits of the curve index of one chromosome and scale, named by the starts that they hold."""
    rows = nodes(spark, d, "chromosome", "start_pos", "scale_level").where("scale_level = 0 and chromosome = 1").withColumn("curve_index", curve.encode(F.col("chromosome"), F.col("start_pos"), F.col("scale_level"), order=28))
    found = regions.curve_buckets(rows, bits=88)
    return found.select(curve.decode(F.col("bucket").cast("decimal(38,0)") * F.lit(str(1 << 88)).cast("decimal(38,0)"), 28)["position"].alias("p"), "n", "first_id").select(F.floor(F.col("p") / 4_194_304).alias("bucket"), "n", "first_id")


@query("""select least(99, greatest(0, user_id % 100)) as cpu_min, count(*) as samples, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) as duration, round(avg(value), 6) as mean_cpu, max(value) as max_cpu, round(avg(user_id), 6) as mean_memory, max(user_id) as max_memory from events group by 1""".replace("least(99, greatest(0, user_id % 100)) as cpu_min, ", "").replace(" group by 1", ""))
def load_rollup(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cpu"), F.col("user_id").alias("memory"))
    return pipelines.load_rollup(rows).withColumns({c: F.round(c, 6) for c in ("duration", "mean_cpu", "mean_memory")})


# --- runs


@query("""select n.id, n.chromosome, n.start_pos, n.variant_type, case when n.start_pos % 10 = 0 then 'known' end as significance from node n where n.variant_type is not null""")
def clinical_facts(spark, d):
    """Variant nodes with what is known of every tenth place."""
    rows = nodes(spark, d, "chromosome", "start_pos", "variant_type").where("variant_type is not null")
    known = rows.where("start_pos % 10 = 0").select("chromosome", "start_pos", F.lit("known").alias("significance")).distinct()
    return annotate.clinical(rows, known)


@query("""select 'genes' as step, count(distinct n.id) as nodes from node n join region r on n.chromosome = r.chromosome and gene_start <= end_pos and gene_end >= start_pos where n.scale_level = 0
  union all select 'exons', count(distinct n.id) from node n join region r on n.chromosome = r.chromosome and gene_start <= end_pos and gene_start + 500 >= start_pos
  union all select 'significance', count(*) from node where start_pos % 10 = 0""")
def annotation_run(spark, d):
    """Intervals, genes and clinical facts laid over all nodes: how many nodes each step gave something to."""
    rows = nodes(spark, d, "chromosome", "start_pos", "end_pos", "scale_level")
    exons = gene_regions(spark, d).select(F.col("gene_id").alias("name"), F.lit(1.0).alias("score"), "chromosome", F.col("gene_start").alias("iv_start"), (F.col("gene_start") + 500).alias("iv_end"))
    known = rows.where("start_pos % 10 = 0").select("chromosome", "start_pos", F.lit("known").alias("significance")).distinct()
    return pipelines.annotation_log(pipelines.annotation_run(rows, {"exons": exons}, gene_regions(spark, d), known), ["exons", "genes", "significance"])


@query()
def rna_run(spark, d):
    """Reads that cover all transcripts, aligned, quantified by expectation maximisation and summed up by gene, with the rate of mapping."""
    reads = materialise(_rna_reads(spark, d), "reads")
    found, genes = pipelines.rna_run(reads, _targets(spark, d))
    total = genes.agg(F.count("*").alias("genes"), r6(F.sum("total_expression"), "total_expression"), F.sum("raw_counts").alias("raw_counts"))
    n = F.lit(reads.count())
    return total.withColumn("reads", n).withColumn("mapping_rate", F.round(F.col("raw_counts") / n, 6))


@query()
def cohort_run(spark, d):
    """What an association run over the calls yields: tests, significant ones, the inflation, the smallest p."""
    tests = materialise(association.with_pvalues(association.gwas(popgen.dosages(_present(spark, d)), _phenotype(spark, d))), "tests")
    sums = tests.agg(F.count("*").alias("tests"), F.count_if(F.col("pvalue") < 5e-8).alias("significant"), F.min("pvalue").alias("least_p"))
    return sums.join(F.broadcast(association.genomic_inflation(tests)))  # one row each


@query("select count(distinct individual_id) as individuals from call where individual_id in ('IND_1', 'IND_2', 'IND_3') and variant_type is not null and frequency > 0")
def cohort_members(spark, d):
    """Calls of a listed cohort."""
    listed = spark.createDataFrame([("IND_1",), ("IND_2",), ("IND_3",), ("IND_3",), ("nobody",)], "individual_id string")
    return popgen.cohort(popgen.presence(calls(spark, d)), listed).agg(F.count_distinct("individual_id").alias("individuals"))


@query("select name, type, true as present from (values ('curve_index', 'range'), ('genomic_position', 'composite'), ('individual_id', 'range'), ('node_id', 'unique')) t(name, type)")
def layout_index(spark, d):
    rows = nodes(spark, d).withColumn("curve_index", curve.encode(F.col("chromosome"), F.col("start_pos"), F.col("scale_level"), order=28))
    return pipelines.layout(rows)


@query("select pattern, share from (values ('region', 0.4::double), ('individual', 0.3), ('path', 0.2), ('annotation', 0.1)) t(pattern, share)")
def query_patterns(spark, d):
    return pipelines.query_patterns(spark)


@query("""select rule, count(*) as n from (select 'sorted_files' as rule union all select 'composite_layout' from node having count(*) > 500 union all select 'memory' union all select 'pattern' union all select 'pattern' union all select 'missing_index') where rule is not null group by 1""".replace("select 'composite_layout' from node having count(*) > 500", "select case when count(*) > 500 then 'composite_layout' end from node"))
def layout_advice(spark, d):
    rows = nodes(spark, d)
    return pipelines.advice(rows, memory_share=0.9, slow_patterns=["region", "path", "annotation"], most=500).groupBy("rule").agg(F.count("*").alias("n"))


@query("select 3 as runs, round(2 / 3.0::double, 6) as success_rate, (select count(*) from node) as rows")
def timed_suite(spark, d):
    """Two queries that succeed and one that fails, timed: how many, how many succeeded, the rows of the first."""
    rows = nodes(spark, d, "chromosome")

    def fails() -> DataFrame:
        raise ValueError("meant to fail")

    taken = pipelines.timed({"nodes": lambda: rows, "chr1": lambda: rows.where("chromosome = 1"), "bad": fails}, spark)
    return taken.agg(F.count("*").cast("int").alias("runs"), r6(F.avg(F.col("success").cast("double")), "success_rate"), F.max("rows").alias("rows"))


@query("select variant_type, count(*) as n, round(avg(start_pos), 4) as centre_x, round(avg(frequency), 6) as centre_y, min(start_pos) as min_x, max(start_pos) as max_x, min(frequency) as min_y, max(frequency) as max_y from node group by 1")
def grouped_points(spark, d):
    rows = pipelines.grouped_points(nodes(spark, d, "variant_type", "start_pos", "frequency"), "variant_type", "start_pos", "frequency")
    return rows.withColumns({"centre_x": F.round("centre_x", 4), "centre_y": F.round("centre_y", 6)})


@query("select chromosome, max(frequency) as top_frequency from node group by 1")
def own_metric(spark, d):
    """A metric of the user's own, registered by name and called."""
    pipelines.register_metric(spark, "top_frequency", lambda df: df.groupBy("chromosome").agg(F.max("frequency").alias("top_frequency")))
    return pipelines.metric("top_frequency", nodes(spark, d, "chromosome", "frequency"))


@query()
def simulated_display(spark, d):
    return segments.simulated_nodes(spark, 1, 1_000_000, 1_050_000)
