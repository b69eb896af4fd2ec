"""Normal forms of identifiers and sequences, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"


def trimmed(c: Column | str) -> Column:
    """Without spaces and tabs at both ends."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def identifier(c: Column | str) -> Column:
    """Trimmed and upper case; null where nothing is left."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def label(c: Column | str) -> Column:
    """Trimmed and lower case; null where nothing is left."""
    return F.nullif(F.lower(trimmed(c)), F.lit(""))


def kmer_valid(c: Column, k: int = 31) -> Column:
    """Whether the string is exactly k letters A, C, G, T."""
    return (F.length(c) == k) & (F.translate(c, "ACGT", "") == "")


def kmer_code(c: Column, k: int = 31, checked: bool = False) -> Column:
    """A k-mer (k <= 31) over A, C, G, T as a bigint of two bits a letter; null for any other string.

    The code is exact and keeps the letters' order, so it can stand for the
    string in every shuffle, sort and comparison at an eighth of the bytes. Rows
    that kmer_valid() has kept are ``checked``: to filter them by a null code
    instead would compute the code twice.
    """
    if k > 31:
        raise ValueError("a bigint holds at most 31 letters")
    code = F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("bigint")
    return code if checked else F.when(kmer_valid(c, k), code)


def kmer_text(code: Column, k: int = 31) -> Column:
    """The letters of a kmer_code()."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")
