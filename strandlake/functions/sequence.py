"""Scalar functions on sequences, chromosome names and variants, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(c: Column) -> Column:
    """Letters other than A, C, G, T stay."""
    return F.reverse(F.translate(c, "ACGT", "TGCA"))


def chromosome_number(name: Column) -> Column:
    """1 to 22, X 23, Y 24, M or MT 25, anything else 0; with or without 'chr'."""
    bare = F.upper(F.regexp_replace(F.trim(name), "(?i)^chr", ""))
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)))


def chromosome_of_header(header: Column) -> Column:
    """The chromosome that a FASTA header names: chr7, chromosome_7, chrX, ...; 25 if none."""
    name = F.lower(F.regexp_extract(header, r"(?i)(?:chr|chromosome_)(\d+|x|y)(?![a-z0-9])", 1))
    return F.when(name == "x", 23).when(name == "y", 24).when(name.try_cast("int").between(1, 24), name.try_cast("int")).otherwise(25)


def variant_class(ref: Column, alt: Column) -> Column:
    """SNP, insertion, deletion or complex, from the alleles' lengths."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNP").when(r < a, "insertion").when(r > a, "deletion").otherwise("complex")


def genotype(haplotypes: Column) -> Column:
    """a/b of an array of allele numbers; a single one stands alone."""
    return F.array_join(haplotypes.cast("array<string>"), "/")


def route_signature(nodes: Column) -> Column:
    """16 hex digits that identify a path of node ids."""
    return F.substring(F.sha2(F.array_join(nodes, "->"), 256), 1, 16)


def folded(sequence: Column, width: int = 80) -> Column:
    """Lines of at most ``width`` letters."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")


def region_text(chromosome: Column, start: Column, end: Column) -> Column:
    return F.format_string("chr%d:%d-%d", chromosome, start, end)


def unread_share(sequence: Column) -> Column:
    """The share of N in the sequence; null if it is empty."""
    return F.try_divide(F.length(sequence) - F.length(F.replace(sequence, F.lit("N"), F.lit(""))), F.length(sequence))
