from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandlake.operators.annotate import as_map, interval_annotations
from strandlake.sinks import exports
from strandlake.sources import segments, text_formats

DATA = Path(__file__).parent / "data"


def test_fasta(spark):
    rows = {r["header"]: r["sequence"] for r in text_formats.fasta(spark, str(DATA / "tiny.fa")).collect()}
    assert rows == {"chr10 first": "ACGTACG", "chr2": "CCCC", "chrM mito": "GGG"}


def test_fastq(spark, tmp_path):
    rows = text_formats.fastq(spark, str(DATA / "tiny.fastq")).orderBy("ordinal").collect()
    assert [(r["read_id"], r["sequence"], r["quality"]) for r in rows] == [("r1", "ACGT", "IIII"), ("r2", "ACGN", "@III"), ("r3", "TTTT", "IIII"), ("r4", "GGGG", "IIII")]
    many = tmp_path / "many.fastq"
    many.write_text("".join(f"@q{i}\n{'ACGT' * (i % 5 + 1)}\n+\n{'I' * (4 * (i % 5 + 1))}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = text_formats.fastq(spark, str(many)).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["read_id"] for r in rows] == [f"q{i}" for i in range(2000)]
    assert all(len(r["sequence"]) == len(r["quality"]) for r in rows)
    assert [r["read_id"] for r in text_formats.inline_reads(spark, ["AC", "G"]).orderBy("ordinal").collect()] == ["api_read_0", "api_read_1"]


def test_vcf_bed_and_overlaps(spark):
    nodes = text_formats.vcf(spark, str(DATA / "tiny.vcf"), {"Sample1": "IND1"}).cache()
    rows = nodes.collect()
    assert len(rows) == 5
    by_type = {r["sequence"]: (r["variant_type"], r["frequency"], r["end_pos"]) for r in rows}
    assert by_type == {"T": ("SNP", 0.75, 1000000), "C": ("SNP", 0.25, 1000010), "CTTT": ("insertion", 0.25, 1000023)}
    assert {r["id"] for r in rows if r["sequence"] == "T"} == {"vcf_1_1000000_IND1_h1_1", "vcf_1_1000000_Sample2_h0_1", "vcf_1_1000000_Sample2_h1_1"}
    bed = text_formats.bed(spark, str(DATA / "tiny.bed"))
    assert sorted((r["name"], r["score"]) for r in bed.collect()) == [("G3", 1000.0), ("GENE1", 800.0), ("annotation_1", 1000.0)]
    found = interval_annotations(bed, nodes)
    assert sorted((r["name"], r["overlap_length"]) for r in found.collect()) == [("GENE1", 1)] * 4 + [("GENE1", 4)]
    assert all(set(r["annotations"]) == {"GENE1"} for r in as_map(found).collect())
    head, body = exports.vcf_text(nodes, ["Sample2", "IND1"])
    assert head[-1].endswith("FORMAT\tIND1\tSample2")
    assert [r["value"].split("\t") for r in body.collect()] == [
        ["1", "1000000", ".", "N", "T", "60", "PASS", "AF=0.750", "GT", "0/1", "1/1"],
        ["1", "1000010", ".", "N", "C", "60", "PASS", "AF=0.250", "GT", "0/0", "0/1"],
        ["1", "1000020", ".", "N", "CTTT", "60", "PASS", "AF=0.250", "GT", "0/1", "0/0"],
    ]
    assert exports.simple_vcf(nodes).count() == 5
    assert exports.bed_rows(nodes).where("score = 750").count() == 3


def test_gene_regions(spark):
    assert [(r["gene_id"], r["strand"]) for r in text_formats.gene_regions(spark, str(DATA / "genes.json")).orderBy("gene_id").collect()] == [("APOE", "+"), ("BRCA1", "-")]


def test_segments(spark):
    nodes, edges = segments.reference_segments(spark, "ATCGATCGATCG" * 1000, 1)
    assert {r["scale_level"]: r["n"] for r in nodes.groupBy("scale_level").agg(F.count("*").alias("n")).collect()} == {0: 120, 1: 12, 2: 2, 3: 1}
    assert edges.count() == 131
    whole = nodes.where("scale_level = 0").orderBy("start_pos").select("sequence").collect()
    assert "".join(r[0] for r in whole) == "ATCGATCGATCG" * 1000
    assert segments.benchmark_nodes(spark, 100).agg(F.sum(F.length("sequence"))).first()[0] == 100_000
    reads = segments.simulated_reads(segments.benchmark_nodes(spark, 5), 3, 50)
    assert reads.count() == 15 and reads.collect() == reads.collect()
    perfect = reads.select("read_id", F.col("true_node").alias("id"))
    assert segments.mapping_accuracy(reads, perfect).first()["accuracy"] == 1.0


def test_writers(spark, tmp_path):
    nodes = segments.benchmark_nodes(spark, 20)
    exports.write_nodes(nodes, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).where("chromosome = 1 and start_pos < 5000").count() == 5
    edges = spark.createDataFrame([("benchmark_node_0", "benchmark_node_1"), ("benchmark_node_0", "gone")], "from_id string, to_id string")
    assert exports.valid_edges(edges, nodes).count() == 1
    old = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    new = spark.createDataFrame([("b", 9, None), ("c", 5, 6)], "k string, x int, y int")
    assert {tuple(r) for r in exports.upsert(old, new, ["k"]).collect()} == {("a", 1, 2), ("b", 9, 4), ("c", 5, 6)}
    exports.assert_unique(old, "k")
    with pytest.raises(ValueError):
        exports.assert_unique(old.unionAll(old), "k")
    cache, calls = exports.ResultCache(spark, str(tmp_path / "c")), []
    for _ in range(2):
        assert cache.get("n", lambda: calls.append(1) or old).count() == 2
    assert calls == [1]


def test_kmers_written_again_do_not_double(spark, tmp_path):
    rows = [("i1", "ACGT", "n1"), ("i1", "ACGT", "n1"), ("i2", "CCCC", "n2")]
    df, path = spark.createDataFrame(rows, "import_id string, sequence string, node_id string"), str(tmp_path / "k")
    exports.write_kmers(df, path)
    exports.write_kmers(df.where("import_id = 'i1'"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("import_id", "sequence", "node_id").collect()) == [("i1", "ACGT", "n1"), ("i2", "CCCC", "n2")]


def test_annotations_and_lists_grow(spark):
    nodes = spark.createDataFrame([("a", {"x": "1"}, ["p"]), ("b", None, None), ("c", {"y": "2"}, [])], "id string, annotations map<string,string>, tags array<string>")
    new = spark.createDataFrame([("a", "x", "9"), ("a", "z", "3"), ("b", "x", "5"), ("b", "x", "4"), ("nobody", "x", "1"), ("c", None, "7")], "id string, name string, value string")
    assert {r["id"]: r["annotations"] for r in exports.merged_annotations(nodes, new).collect()} == {"a": {"x": "9", "z": "3"}, "b": {"x": "5"}, "c": {"y": "2"}}
    more = spark.createDataFrame([("a", "r", 2), ("a", "q", 1), ("b", "s", 1)], "id string, value string, place int")
    assert {r["id"]: r["tags"] for r in exports.appended(nodes, more, "tags", "place").collect()} == {"a": ["p", "q", "r"], "b": ["s"], "c": []}


def test_upsert_takes_the_newest_of_repeated_keys(spark):
    old = spark.createDataFrame([("g1", 1.0, "x"), ("g2", 2.0, "y")], "gene string, level double, note string")
    new = spark.createDataFrame([("g1", 5.0, None, 2), ("g1", 4.0, "z", 1), ("g3", None, "w", 1)], "gene string, level double, note string, at int")
    assert sorted(map(tuple, exports.upsert(old, new, ["gene"], "at").collect())) == [("g1", 5.0, "x"), ("g2", 2.0, "y"), ("g3", None, "w")]


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', [1, 2]), (2, None, None), (3, "line\nend", [])], "i int, t string, xs array<int>")
    assert exports.write_csv(df, str(tmp_path / "c")) == 3 and exports.write_json(df, str(tmp_path / "j")) == 3
    assert sorted(r["i"] for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()) == [1, 2, 3]
    assert [r["value"] for r in exports.csv_rows(df.select("i", "t")).collect()] == ['1,"a ""b"", c"', "2,", '3,"line\nend"']
    assert [r["value"] for r in exports.json_rows(df.select("i", "t")).collect()][1] == '{"i":2}'
    assert exports.append_rows(df, str(tmp_path / "p")) + exports.append_rows(df, str(tmp_path / "p")) == spark.read.parquet(str(tmp_path / "p")).count()
    assert exports.write_json(df.where("false"), str(tmp_path / "none")) == 0


def test_transcript_records(spark, tmp_path):
    df = spark.createDataFrame([("t1", "ACGT" * 30), ("t2", None), ("t3", ""), ("t4", "AC")], "transcript_id string, sequence string")
    rows = {r["transcript_id"]: r["value"] for r in exports.transcript_fasta(df).collect()}
    assert rows == {"t1": ">t1\n" + "ACGT" * 20 + "\n" + "ACGT" * 10, "t4": ">t4\nAC"}
    exports.write_transcripts(df, str(tmp_path / "all"))
    assert sorted(text_formats.fasta(spark, str(tmp_path / "all")).select("header").collect()) == [("t1",), ("t4",)]
    exports.write_transcripts(df, str(tmp_path / "each"), each=True)
    assert (tmp_path / "each" / "transcript_id=t4").is_dir()


def test_cache_outlives_its_object(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    folder = f"file://{tmp_path}/cache"
    assert exports.ResultCache(spark, folder).get("route", make, 7200).count() == 3
    assert exports.ResultCache(spark, folder).get("route", make).count() == 3 and len(made) == 1
    assert exports.ResultCache(spark, folder).get("short", make, -1).count() == 3
    exports.ResultCache(spark, folder).get("short", make)
    assert len(made) == 3


def test_compressed_files_and_intervals_of_many_blocks(spark, tmp_path):
    import gzip

    for name in ("tiny.fa", "tiny.fastq", "tiny.bed"):
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress((DATA / name).read_bytes()))
    assert sorted(text_formats.fasta(spark, str(tmp_path / "tiny.fa.gz")).collect()) == sorted(text_formats.fasta(spark, str(DATA / "tiny.fa")).collect())
    assert sorted(text_formats.bed(spark, str(tmp_path / "tiny.bed.gz")).collect()) == sorted(text_formats.bed(spark, str(DATA / "tiny.bed")).collect())
    assert text_formats.fastq(spark, str(tmp_path / "tiny.fastq.gz")).count() == 4
    (tmp_path / "many.bed").write_text("".join(f"# {i}\nchr1\t{i}\t{i + 5}\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = text_formats.bed(spark, str(tmp_path / "many.bed"), "iv").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["name"]: r["iv_start"] for r in rows} == {f"iv_{i}": i for i in range(2000)}
