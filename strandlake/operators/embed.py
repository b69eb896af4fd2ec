"""Path embeddings and their neighbours."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def path_embedding(paths: DataFrame, features: DataFrame, size: int = 100) -> DataFrame:
    """path_id and embedding: mean, population deviation, maximum and minimum of the nodes' vectors, cut to ``size``.

    ``features``: id, features (array). Nodes without a vector are skipped; a path
    without any gets zeros.
    """
    each = paths.select("path_id", F.explode("path_nodes").alias("id")).join(features, "id")
    dims = each.select("path_id", F.posexplode("features").alias("dim", "x"))
    stats = dims.groupBy("path_id", "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"), F.max("x").alias("top"), F.min("x").alias("low"))
    rows = stats.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "dev", "top", "low"))).alias("s"))
    parts = F.concat(F.col("s.mean"), F.col("s.dev"), F.col("s.top").cast("array<double>"), F.col("s.low").cast("array<double>"))
    vectors = rows.select("path_id", F.slice(parts, 1, size).alias("embedding"))
    return paths.select("path_id").join(vectors, "path_id", "left").select("path_id", F.coalesce("embedding", F.array_repeat(F.lit(0.0), size)).alias("embedding"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either has length 0."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def similar(vectors: DataFrame, query: list[float], ident: str, vector: str, k: int) -> DataFrame:
    """The k rows most like one query vector; a bounded heap in each task, no sort of the table. Ties by id."""
    scored = vectors.select(ident, cosine(F.col(vector).cast("array<double>"), F.array(*(F.lit(float(x)) for x in query))).alias("similarity"))
    return scored.where("similarity is not null").orderBy(F.desc("similarity"), ident).limit(k)


def clusters(vectors: DataFrame, ident: str, vector: str, k: int = 50, dims: int = 50, seed: int = 42) -> DataFrame:
    """ident, cluster: k-means on the first ``dims`` principal components of the centred vectors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    first = rows.first()
    if first is None:
        return vectors.select(ident, F.lit(0).alias("cluster"))
    stages, column = [StandardScaler(inputCol="v", outputCol="centred", withMean=True, withStd=False)], "centred"
    if len(first["v"]) > dims:
        stages.append(PCA(k=dims, inputCol="centred", outputCol="main"))
        column = "main"
    stages.append(KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster"))
    return Pipeline(stages=stages).fit(rows).transform(rows).select(ident, "cluster")


def main_components(cells: DataFrame, row: str, column: str, dims: int, seed: int = 42, more: int = 10) -> DataFrame:
    """row, scores: the first ``dims`` principal component scores of a sparse 0/1 matrix given as its cells (row, column), columns centred.

    Randomised subspace iteration: each column gets dims + more hash-seeded normal numbers, rows sum those of
    their columns, and two rounds of multiplying with the matrix and its transpose follow. Every product is
    a join and a grouped sum, so neither the number of rows nor that of columns is limited; only
    matrices of dims + more squared come to the driver.
    """
    size = dims + more
    cells = materialise(cells.select(F.col(row).alias("r"), F.col(column).alias("c")).distinct(), "cells")
    names = [f"y{j}" for j in range(size)]

    def normal(j: int) -> Column:
        u, v = (F.pmod(F.xxhash64("c", F.lit(seed), F.lit(j), F.lit(k)), F.lit(1 << 30)) / F.lit(float(1 << 30)) for k in (0, 1))
        return F.sqrt(-2 * F.ln(u + 1e-10)) * F.cos(2 * math.pi * v)

    def centred(y: DataFrame) -> DataFrame:
        y = materialise(y, "scores")
        mean = y.agg(*(F.avg(n).alias(n) for n in names)).first()
        return y.select("r", *((F.col(n) - F.lit(float(mean[n] or 0.0))).alias(n) for n in names))

    def times(y: DataFrame) -> DataFrame:  # centred matrix x its transpose x y
        z = cells.join(y, "r").groupBy("c").agg(*(F.sum(n).alias(n) for n in names))
        return centred(cells.join(z, "c").groupBy("r").agg(*(F.sum(n).alias(n) for n in names)))

    def inner(a: DataFrame, b: DataFrame) -> np.ndarray:
        both = a.join(b.select("r", *(F.col(n).alias(f"b{n}") for n in names)), "r")
        sums = both.agg(*(F.sum(F.col(m) * F.col(f"b{n}")) for m in names for n in names)).first()
        return np.array([x or 0.0 for x in sums], float).reshape(size, size)

    def turned(y: DataFrame, by: np.ndarray) -> DataFrame:
        return y.select("r", *(sum((F.col(m) * F.lit(float(by[i, j])) for i, m in enumerate(names)), F.lit(0.0)).alias(n) for j, n in enumerate(names)))

    def orthonormal(y: DataFrame) -> DataFrame:
        values, vectors = np.linalg.eigh(inner(y, y))
        keep = values > max(values.max(), 0) * 1e-12
        scale = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0.0)
        return materialise(turned(y, vectors * scale), "basis")

    y = centred(cells.groupBy("r").agg(*(F.sum(normal(j)).alias(n) for j, n in enumerate(names))))
    for _ in range(2):
        y = times(orthonormal(y))
    basis = orthonormal(y)
    values, vectors = np.linalg.eigh(inner(basis, times(basis)))
    order = np.argsort(-values)
    spread = np.sqrt(np.maximum(values[order], 0))
    scores = turned(basis, vectors[:, order] * spread)
    return scores.select(F.col("r").alias(row), F.array(*names[:dims]).alias("scores"))


def population_structure(present: DataFrame, k: int = 5, dims: int = 10, least: float = 0.05, seed: int = 42) -> DataFrame:
    """hap, cluster: k-means on the main components of haplotypes over all their common sites."""
    from .popgen import common_sites, site_frequencies

    common = common_sites(site_frequencies(present), least).select("site")
    cells = present.join(common, "site", "left_semi")
    if cells.isEmpty():
        return cells.select("hap", F.lit(0).alias("cluster")).distinct()
    return clusters(main_components(cells, "hap", "site", dims, seed), "hap", "scores", k, dims, seed)
