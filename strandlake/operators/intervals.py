"""Interval and distance joins as hash joins on bins.

A range condition alone would be planned as a nested loop over all pairs. Both
sides are instead exploded to the bins they touch and joined on (key, bin); a pair
that meets in several bins is kept only in the bin of its later start, so no
distinct is needed. Bins should be about as wide as the wider side's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / width).cast("bigint")


def _binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    first, last = _bin(start, width), _bin(end, width)
    return df.where(start.isNotNull() & end.isNotNull() & (end >= start)).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, l_range: tuple[str, str], r_range: tuple[str, str], width: int = 10_000, half_open: bool = False) -> DataFrame:
    """Pairs of equal ``key`` whose intervals overlap, with overlap_start, overlap_end and overlap_length.

    By default both ends belong to an interval; with half_open the ends do not.
    The columns of both sides must have different names, except the key. Null or
    reversed intervals match nothing.
    """
    (ls, le), (rs, re) = l_range, r_range
    inner = 1 if half_open else 0
    a = _binned(left, F.col(ls), F.col(le) - inner, width)
    b = _binned(right, F.col(rs), F.col(re) - inner, width)
    first, last = F.greatest(ls, rs), F.least(le, re)
    pairs = a.join(b, [key, "_bin"]).where((F.col("_bin") == _bin(first, width)) & (first <= last - inner))
    return pairs.drop("_bin").withColumn("overlap_start", first).withColumn("overlap_end", last).withColumn("overlap_length", last - first + 1 - inner)


def containment_join(outer: DataFrame, inner: DataFrame, key: str, o_range: tuple[str, str], i_range: tuple[str, str], width: int = 10_000) -> DataFrame:
    """Pairs of equal ``key`` where the inner interval lies within the outer one; only the outer side is exploded."""
    (os, oe), (is_, ie) = o_range, i_range
    a = _binned(outer, F.col(os), F.col(oe), width)
    b = inner.withColumn("_bin", _bin(F.col(is_), width))
    return a.join(b, [key, "_bin"]).where((F.col(is_) >= F.col(os)) & (F.col(ie) <= F.col(oe))).drop("_bin")


def distance_join(left: DataFrame, right: DataFrame, key: str, l_pos: str, r_pos: str, within: int, closed: bool = False) -> DataFrame:
    """Pairs of equal ``key`` whose positions differ by less than ``within`` (at most, if closed).

    Bins of that width: the right side looks into its own bin and both neighbours,
    so a pair meets once.
    """
    width = within + 1 if closed else within
    a = left.withColumn("_bin", _bin(F.col(l_pos), width))
    own = _bin(F.col(r_pos), width)
    b = right.withColumn("_bin", F.explode(F.array(own - 1, own, own + 1)))
    gap = F.abs(F.col(l_pos) - F.col(r_pos))
    return a.join(b, [key, "_bin"]).where(gap <= within if closed else gap < within).drop("_bin")
