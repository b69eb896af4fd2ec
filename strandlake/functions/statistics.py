"""Tests and corrections. Statistics are plain columns; only tail probabilities need a function that SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import materialise


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi square of the table [[a, b], [c, d]] with Yates' correction; null if an expected count is 0."""
    n = a + b + c + d
    expected = [(a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n]
    terms = []
    for seen, e in zip((a, b, c, d), expected):
        off = F.abs(seen - e)
        terms.append(F.pow(off - F.least(F.lit(0.5), off), F.lit(2)) / e)
    empty = F.least(a + b, c + d, a + c, b + d) == 0
    return F.when(~empty, terms[0] + terms[1] + terms[2] + terms[3])


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(a d) / (b c); half is added to each count if b or c is 0."""
    h = F.when((b == 0) | (c == 0), 0.5).otherwise(0.0)
    return (a + h) * (d + h) / ((b + h) * (c + h))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(chi square with one degree of freedom >= x); each value of a batch is worked out once."""
    values, place = np.unique(x.to_numpy(dtype="float64", na_value=np.nan), return_inverse=True)
    return pd.Series(np.array([math.erfc(math.sqrt(v / 2)) if v == v else math.nan for v in values])[place] if len(values) else values)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def student_tail(t: float, df: float) -> float:
    """Two-sided P(|T| >= |t|) for Student's T with df degrees of freedom."""
    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a * math.log(x) if x > 0 else -math.inf) + (b * math.log1p(-x) if x < 1 else -math.inf))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tails(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """student_tail() of arrays; the continued fraction runs for all values side by side."""
    x = np.where(np.isinf(t), 0.0, df / (df + np.where(np.isinf(t), 0.0, t) ** 2))
    a, b = df / 2, np.full(len(df), 0.5)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(df) else a
    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(abs(v) > tiny, v, tiny)
    c, d = np.ones(len(df)), 1 / guard(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / guard(1 + num * d)
            c = guard(1 + num / c)
            h = h * d * c
        if not len(df) or (abs(d * c - 1) < 1e-15).all():
            break
    part = front * h / p
    return np.where(swap, 1 - part, part)


@F.pandas_udf(DoubleType())
def slope_tail(r2: pd.Series, n: pd.Series) -> pd.Series:
    """The p-value of a regression slope, from r squared and the number of points."""
    r, k = r2.to_numpy("float64", na_value=np.nan), n.to_numpy("float64", na_value=np.nan)
    fit = (r == r) & (k > 2)
    t2 = np.where(fit & (r < 1), r * (k - 2) / np.where(r < 1, 1 - r, 1), np.inf)
    return pd.Series(np.where(fit, student_tails(np.sqrt(t2), np.where(fit, k - 2, 1.0)), np.nan))


def bh_qvalues(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """df with ``qvalue``: the smallest p n / rank over this and all larger p, at most 1; null where p is null.

    With ``by`` the correction is within groups. Equal p-values get equal q-values.
    The distinct p-values are range partitioned; ranks and minima are taken
    within the partitions and carried over between them by a row for each
    partition, so no task sees a whole group.
    """
    keys = by or []
    distinct = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_n"))
    ranged = materialise(distinct.repartitionByRange(*keys, p).withColumn("_part", F.spark_partition_id()), "ranged")
    within, parts = Window.partitionBy(*keys, "_part"), Window.partitionBy(*keys)
    sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    before = F.coalesce(F.sum("_in").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_part", before.alias("_before"), F.sum("_in").over(parts).alias("_all"))
    ranked = ranged.join(sums, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.sum("_n").over(within.orderBy(p)))
    ranked = ranked.withColumn("_v", F.col(p) * F.col("_all") / F.col("_rank"))
    least = ranked.groupBy(*keys, "_part").agg(F.min("_v").alias("_least"))
    after = F.min("_least").over(parts.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    least = least.select(*keys, "_part", after.alias("_after"))
    q = F.least(F.lit(1.0), F.min("_v").over(within.orderBy(F.desc(p))), F.col("_after"))  # least() passes over nulls
    return df.join(ranked.join(least, [*keys, "_part"]).select(*keys, p, q.alias("qvalue")), [*keys, p], "left")
