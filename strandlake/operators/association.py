"""Case/control tests and eQTL regressions from sufficient counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import bh_qvalues, chi2_tail, chi2_yates, odds_ratio, slope_tail
from ..storage import ship


def gwas(dosages: DataFrame, phenotype: DataFrame) -> DataFrame:
    """Per site: a, b, c, d (cases and controls with and without), chi2, odds_ratio, beta, mean_dosage.

    ``phenotype``: individual_id, is_case. Individuals without the variant are
    counted, not listed. Sites that everyone or no one has the same way, and sites
    with an empty expected cell, are left out.
    """
    people = phenotype.agg(F.count_if("is_case").alias("cases"), F.count_if(~F.col("is_case")).alias("controls"))
    seen = dosages.join(phenotype, "individual_id").groupBy("site").agg(
        F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("c"), F.sum("dosage").alias("total"), F.sum(F.col("dosage") * F.col("dosage")).alias("squares")
    )
    full = seen.join(F.broadcast(people)).withColumn("b", F.col("cases") - F.col("a")).withColumn("d", F.col("controls") - F.col("c"))  # one row
    n = F.col("cases") + F.col("controls")
    varies = F.col("squares") * n != F.col("total") * F.col("total")
    cells = [F.col(x).cast("double") for x in ("a", "b", "c", "d")]
    chi2, ratio = chi2_yates(*cells), odds_ratio(*cells)
    tested = full.where(varies).select("site", "a", "b", "c", "d", chi2.alias("chi2"), ratio.alias("odds_ratio"), F.when(ratio > 0, F.ln(ratio)).otherwise(0.0).alias("beta"), (F.col("total") / n).alias("mean_dosage"))
    return tested.where(F.col("chi2").isNotNull())


def with_pvalues(tests: DataFrame) -> DataFrame:
    """tests with pvalue; each distinct chi2 crosses to Python once."""
    ship(tests.sparkSession)
    return tests.join(tests.select("chi2").distinct().withColumn("pvalue", chi2_tail("chi2")), "chi2")


def genomic_inflation(tests: DataFrame) -> DataFrame:
    """lambda_gc: the median of -2 ln p over p > 0, over 0.456; 1 without tests."""
    return tests.where("pvalue > 0").agg(F.coalesce(F.median(-2 * F.ln("pvalue")) / 0.456 + 0.0, F.lit(1.0)).alias("lambda_gc"))


def manhattan(tests: DataFrame, chromosome: str, position: str, p: str) -> DataFrame:
    """tests with x (position on the line of all chromosomes) and y (-log10 p; 50 for p <= 0)."""
    lengths = tests.groupBy(chromosome).agg((F.max(position) + 1_000_000).alias("_length"))
    before = F.coalesce(F.sum("_length").over(Window.orderBy(chromosome).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each chromosome
    placed = tests.join(lengths.select(chromosome, before.alias("_offset")), chromosome)
    y = F.when(F.col(p) > 0, -F.log10(p)).otherwise(50.0)
    return placed.withColumn("x", F.col(position) + F.col("_offset")).withColumn("y", y).drop("_offset")


def eqtl(genotypes: DataFrame, expression: DataFrame, cis: DataFrame, least: int = 10) -> DataFrame:
    """Per (gene_id, site) pair of ``cis``: n, slope, r2, direction of expression on genotype.

    ``genotypes``: individual_id, site, dosage (missing means 0); ``expression``:
    individual_id, gene_id, level. Null and NaN levels are left out; pairs with fewer
    than ``least`` individuals or one genotype only are not tested. Individuals
    without the variant enter through totals per gene, so no dense matrix arises.
    """
    y = expression.where(F.col("level").isNotNull() & ~F.isnan("level"))
    totals = y.groupBy("gene_id").agg(F.count("*").alias("n"), F.sum("level").alias("sy"), F.sum(F.col("level") * F.col("level")).alias("syy"))
    met = cis.join(genotypes, "site").join(y, ["gene_id", "individual_id"])
    x = F.col("dosage").cast("double")
    sums = met.groupBy("gene_id", "site").agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * F.col("level")).alias("sxy"))
    joined = sums.join(totals, "gene_id").where(F.col("n") >= least)
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    tested = joined.where(vx > 0).select("gene_id", "site", "n", (cov / vx).alias("slope"), F.when(vy > 0, cov * cov / (vx * vy)).otherwise(0.0).alias("r2"), (F.col("sx") / (2 * F.col("n"))).alias("alt_frequency"))
    return tested.withColumn("direction", F.when(F.col("slope") > 0, "positive").otherwise("negative"))


def eqtl_significant(tests: DataFrame, below: float = 0.05, all_tests: bool = False) -> DataFrame:
    """Tests with p below the limit and their q-values, taken over the kept tests or over all."""
    ship(tests.sparkSession)
    p = tests.withColumn("pvalue", slope_tail(F.col("r2"), F.col("n").cast("double")))
    return bh_qvalues(p, "pvalue").where(F.col("pvalue") < below) if all_tests else bh_qvalues(p.where(F.col("pvalue") < below), "pvalue")
