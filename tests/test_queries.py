import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from strandlake.plans import core, dealt, records

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "region_query_scale0", "region_query_curve", "curve_encode", "chromosome_diversity", "rare_variants_by_chr", "individual_routes", "linear_edges", "trail_counts", "interval_overlap_annot", "proximity_selfjoin",
    "fst_pairwise", "gwas_chi2", "eqtl_regression", "kmer_index_counts", "fpkm", "annotation_latest", "annotation_sessions", "cosine_topk", "vcf_export_rows", "p2_found", "p6_found",
]


def test_registry():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert {*core.QUERIES, *dealt.QUERIES, *records.QUERIES} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    compare(spark, name, FOLDER)


LARGER = "/root/testdata/sf0.01"
# Joins with a table of one row, or of at most 25.
ONE_ROW = {
    "cohort_run", "allele_freq_maf", "fst_mean", "hamming_distance", "rna_summary", "trail_counts", "gwas_chi2", "gwas_pvalue", "gwas_lambda", "simulated_display",
}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted({*core.QUERIES, *dealt.QUERIES, *records.QUERIES}))
def test_every_query_has_rows_and_those_of_its_sql(spark, name):
    if name in entry.oracle_sql():
        df, rows = compare(spark, name, LARGER)
    else:
        df = entry.queries()[name](spark, LARGER)
        rows = df.take(1)
    assert rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan or name.removesuffix("_binned").removesuffix("_exact") in ONE_ROW


def compare(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    done = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    expected = done.fetchall()
    df = entry.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)

    def plain(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        if isinstance(v, str) or hasattr(v, "year"):
            return str(v)
        return f"{float(v) + 0.0:.5g}" if not isinstance(v, int) else str(v)

    key = lambda row: tuple(plain(row[c]) for c in sorted(columns))
    rows = df.collect()
    assert sorted(key(r.asDict()) for r in rows) == sorted(key(dict(zip(columns, r))) for r in expected)
    return df, rows
