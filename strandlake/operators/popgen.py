"""Population genetics on the long table of who has which variant; no matrix is ever built.

``presence`` has a row for each haplotype (hap) and site where the variant is
present. Counts per site and the number of haplotypes are enough for every measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join


def presence(nodes: DataFrame, site: Column | None = None) -> DataFrame:
    """hap, individual_id, haplotype, site of scale-0 variants whose mean frequency is above 0."""
    at = F.concat_ws("_", "chromosome", "start_pos") if site is None else site
    rows = nodes.where((F.col("scale_level") == 0) & F.col("variant_type").isNotNull())
    keyed = rows.groupBy("individual_id", "haplotype", at.alias("site")).agg(F.avg("frequency").alias("f")).where("f > 0")
    return keyed.select(F.concat_ws("_h", "individual_id", F.col("haplotype").cast("string")).alias("hap"), "individual_id", "haplotype", "site")


def site_frequencies(present: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group and site: carriers, n_hap (haplotypes of the group with any variant), p."""
    keys = by or []
    n = present.groupBy(*keys).agg(F.count_distinct("hap").alias("n_hap"))
    counts = present.groupBy(*keys, "site").agg(F.count("*").alias("carriers"))
    joined = counts.join(n, keys) if keys else counts.join(F.broadcast(n))  # one row
    return joined.withColumn("p", F.col("carriers") / F.col("n_hap"))


def common_sites(frequencies: DataFrame, least: float = 0.05) -> DataFrame:
    return frequencies.where(F.col("p").between(least, 1 - least))


def metrics(present: DataFrame, by: str) -> DataFrame:
    """Per population: population_size (haplotypes), sites, expected_het, observed_het, fis, pi, tajimas_d.

    observed_het compares the two haplotypes of an individual, over the population's sites.
    """
    freq = site_frequencies(present, [by])
    n, k = F.col("n_hap"), F.col("carriers")
    stats = freq.groupBy(by, "n_hap").agg(
        F.count("*").alias("sites"), F.avg(2 * F.col("p") * (1 - F.col("p"))).alias("expected_het"),
        F.count_if((k > 0) & (k < n)).alias("segregating"), F.sum(k * (n - k)).alias("differing"),
    )
    pairs = F.col("n_hap") * (F.col("n_hap") - 1) / 2
    a1 = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_hap") - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    expected = F.col("segregating") / a1
    d = F.when((F.col("n_hap") < 3) | (F.col("segregating") == 0), 0.0).otherwise((F.col("differing") / pairs - expected) / F.sqrt(expected))
    both = present.groupBy(by, "individual_id", "site").agg(F.count_distinct("haplotype").alias("h"))
    people = present.groupBy(by, "individual_id").agg(F.count_distinct("haplotype").alias("haps")).where("haps = 2")
    seen = both.join(people, [by, "individual_id"]).groupBy(by).agg(F.count_if(F.col("h") == 1).alias("mixed"), F.count_distinct("individual_id").alias("people"))
    out = stats.join(seen, by, "left").withColumn("observed_het", F.coalesce(F.col("mixed") / (F.col("people") * F.col("sites")), F.lit(0.0)))
    fis = F.when(F.col("expected_het") > 0, (F.col("expected_het") - F.col("observed_het")) / F.col("expected_het")).otherwise(0.0)
    return out.select(by, F.col("n_hap").alias("population_size"), "sites", "expected_het", "observed_het", fis.alias("fis"), F.col("expected_het").alias("pi"), d.alias("tajimas_d"))


def fst(present: DataFrame, by: str) -> DataFrame:
    """pop_a < pop_b and the mean over their common sites of ((p - q) / 2)^2 / (p(1-p) + q(1-q)), where that is defined."""
    freq = site_frequencies(present, [by]).select(by, "site", "p")
    a, b = freq.select(F.col(by).alias("pop_a"), "site", F.col("p").alias("p")), freq.select(F.col(by).alias("pop_b"), "site", F.col("p").alias("q"))
    both = a.join(b, "site").where("pop_a < pop_b")
    below = F.col("p") * (1 - F.col("p")) + F.col("q") * (1 - F.col("q"))
    value = F.when(below > 0, F.pow((F.col("p") - F.col("q")) / 2, F.lit(2)) / below)
    return both.groupBy("pop_a", "pop_b").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("fst"), F.count("*").alias("common_sites"))


def specific(present: DataFrame, by: str, population: str) -> DataFrame:
    """Sites of the population that no other population has."""
    own = present.where(F.col(by) == population).select("site").distinct()
    return own.join(present.where(F.col(by) != population).select("site").distinct(), "site", "left_anti")


def hamming(present: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Pairs of haplotypes that have a site in common, and the share of all sites at which they differ: hap_a, hap_b, distance.

    From set sizes: two haplotypes differ at n_a + n_b - 2 common sites, so pairs without a
    common site, which are not listed, differ at n_a + n_b of them. With ``queries`` (hap) each of those is held against
    all others; without, every pair comes once, hap_a < hap_b. Sites that many haplotypes have are spread over many tasks.
    """
    sizes = present.groupBy("hap").agg(F.count("*").alias("n"))
    total = present.agg(F.count_distinct("site").alias("sites"))
    own = present if queries is None else present.join(queries.select("hap").distinct(), "hap", "left_semi")
    a, b = own.select(F.col("hap").alias("hap_a"), "site"), present.select(F.col("hap").alias("hap_b"), "site")
    apart = F.col("hap_a") < F.col("hap_b") if queries is None else F.col("hap_a") != F.col("hap_b")
    common = salted_join(b, a, "site", "hap_b", on=apart).groupBy("hap_a", "hap_b").agg(F.count("*").alias("common"))
    sized = common.join(sizes.select(F.col("hap").alias("hap_a"), F.col("n").alias("n_a")), "hap_a").join(sizes.select(F.col("hap").alias("hap_b"), F.col("n").alias("n_b")), "hap_b")
    joined = sized.join(F.broadcast(total))  # one row
    return joined.select("hap_a", "hap_b", ((F.col("n_a") + F.col("n_b") - 2 * F.col("common")) / F.col("sites")).alias("distance"))


def hap_sites(present: DataFrame) -> DataFrame:
    """hap, n (its sites), sites (of all): what tells the distance of the pairs that hamming() does not list, (n_a + n_b) / sites."""
    total = present.agg(F.count_distinct("site").alias("sites"))
    return present.groupBy("hap").agg(F.count("*").alias("n")).join(F.broadcast(total))  # one row


def mean_fst(pairs: DataFrame) -> DataFrame:
    """Of fst(): pairs of populations and the mean of their values, 0 without pairs."""
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.avg("fst"), F.lit(0.0)).alias("mean_fst"))


def cohort(present: DataFrame, individuals: DataFrame) -> DataFrame:
    """present of the listed individuals (individual_id) only."""
    return present.join(individuals.select("individual_id").distinct(), "individual_id", "left_semi").select(*present.columns)


def site_facts(nodes: DataFrame, chromosome: int | None = None) -> DataFrame:
    """Variant sites with their kind: chromosome, start_pos, variant_type, n (nodes), and the facts of the first node by id: id, frequency.

    A chromosome of None or 0 means all.
    """
    rows = nodes.where((F.col("scale_level") == 0) & F.col("variant_type").isNotNull())
    rows = rows.where(F.col("chromosome") == chromosome) if chromosome else rows
    first = F.min(F.struct("id", "frequency")).alias("f")
    return rows.groupBy("chromosome", "start_pos", "variant_type").agg(F.count("*").alias("n"), first).select("chromosome", "start_pos", "variant_type", "n", F.col("f.id").alias("first_id"), F.col("f.frequency").alias("frequency"))


def diversity_report(present: DataFrame, by: str) -> DataFrame:
    """metrics() of each population with its own sites (specific_sites, that no other population has) and the mean Fst with the others."""
    owners = present.select("site", by).distinct().groupBy("site").agg(F.count("*").alias("pops"), F.min(by).alias(by)).where("pops = 1")
    own = owners.groupBy(by).agg(F.count("*").alias("specific_sites"))
    pairs = fst(present, by)
    each = pairs.select(F.explode(F.array("pop_a", "pop_b")).alias(by), "fst").groupBy(by).agg(F.avg("fst").alias("mean_fst"))
    out = metrics(present, by).join(own, by, "left").join(each, by, "left")
    return out.withColumn("specific_sites", F.coalesce("specific_sites", F.lit(0))).withColumn("mean_fst", F.coalesce("mean_fst", F.lit(0.0)))


def dosages(present: DataFrame) -> DataFrame:
    """individual_id, site, dosage: on how many haplotypes the variant is, at most 2."""
    return present.groupBy("individual_id", "site").agg(F.least(F.lit(2), F.count("*")).cast("int").alias("dosage"))
