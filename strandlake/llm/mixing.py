"""Mixing sources to target shares by Poisson replication.

A source's documents must on average be used rate = wanted tokens / own tokens
times. Each document draws its number of copies by inverting a Poisson
distribution at a uniform number that is a hash of its id and a seed, so the draw
needs no state and is the same on every run. Copies beyond the source's cap are
cut, and the Poisson mean is raised so that the mean after the cut is the rate.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import small


def _poisson(rate: float, k: int) -> float:
    return math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))


def capped_mean(rate: float, cap: int) -> float:
    """The mean of min(X, cap) for a Poisson X with mean rate."""
    chances = [_poisson(rate, k) for k in range(cap)]
    return sum(k * p for k, p in enumerate(chances)) + cap * max(0.0, 1 - sum(chances))


def poisson_steps(rate: float, cap: int) -> list[float]:
    """Increasing bounds b: a uniform u stands for as many copies as there are bounds at or below it.

    With a rate at or above the cap every document is used cap times.
    """
    if rate <= 0 or cap <= 0:
        return []
    if rate >= cap:
        return [0.0] * cap
    low, high = rate, rate
    while capped_mean(high, cap) < rate * (1 - 1e-12):
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    return [min(b, 1.0) for b in accumulate(_poisson(high, k) for k in range(cap))]


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def shares(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """What the targets ask of each source.

    ``sizes``: source, n_tokens for each document. ``targets``: source, target_share,
    max_repeats. Result for each row of targets: source, target_share, max_repeats,
    own_tokens, wanted_tokens, rate, feasible. ``total`` is the size of the mixture;
    by default all tokens of documents whose source is a target. A source without documents has
    0 tokens and is feasible only if nothing is wanted. Null sources match nothing;
    null sizes count as 0; repeated rows of targets count once.
    """
    targets = targets.select("source", "target_share", "max_repeats").where("source is not null").distinct()
    own = sizes.groupBy("source").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("own_tokens"))
    both = targets.join(own, "source", "left").withColumn("own_tokens", F.coalesce("own_tokens", F.lit(0)))
    if total is None:
        total = both.select("source", "own_tokens").distinct().agg(F.sum("own_tokens")).first()[0] or 0
    wanted = F.col("target_share") * F.lit(total)
    return both.select(
        "source", "target_share", "max_repeats", "own_tokens", wanted.alias("wanted_tokens"),
        F.when(F.col("own_tokens") > 0, wanted / F.col("own_tokens")).alias("rate"),
        (F.col("own_tokens") * F.col("max_repeats") >= wanted).alias("feasible"),
    )


def keeping_shares(asked: DataFrame) -> DataFrame:
    """shares() for a smaller mixture, in which every source that can reach its target share has it exactly.

    The sources that cannot are used to their caps; with F the summed share of the others, the whole is
    caps / (1 - F). A smaller whole may make further sources able, so this is repeated, at most once for each source.
    Sources without documents are left out and the other shares scaled to a sum of 1.
    Read by the driver: one row for each target source. The result has the columns of shares().
    """
    rows = [r.asDict() for r in asked.collect()]
    held = [r for r in rows if r["own_tokens"] > 0 and r["target_share"] > 0]
    scale = sum(r["target_share"] for r in held)
    share = {id(r): r["target_share"] / scale for r in held}
    cap = lambda r: r["own_tokens"] * max(r["max_repeats"] or 0, 0)
    whole = sum(r["wanted_tokens"] for r in rows)
    for _ in rows:
        short = [r for r in held if cap(r) < share[id(r)] * whole * (1 - 1e-12)]
        if not short:
            break
        rest = sum(share[id(r)] for r in held) - sum(share[id(r)] for r in short)
        whole = sum(cap(r) for r in short) / max(1 - rest, 1e-12)
    for r in rows:
        wanted = share[id(r)] * whole if id(r) in share else 0.0
        r["wanted_tokens"], r["feasible"] = wanted, cap(r) >= wanted * (1 - 1e-9)
        r["rate"] = wanted / r["own_tokens"] if r["own_tokens"] else None
    return asked.sparkSession.createDataFrame([tuple(r[c] for c in asked.columns) for r in rows], asked.schema)


def spread(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """source, expected_tokens and deviation: mean and standard deviation of a source's tokens over all seeds of mixture().

    A document of n tokens adds n times its draw, and draws are independent, so the
    deviation is that of one draw times the root of the summed squares of the sizes.
    """
    spark = documents.sparkSession
    rows = []
    for r in asked.collect():  # one row for each target source
        bounds = poisson_steps(r["rate"] or 0.0, int(r["max_repeats"] or 0))
        mean = float(sum(1 - b for b in bounds))
        rows.append((r["source"], mean, math.sqrt(max(0.0, sum((2 * k + 1) * (1 - b) for k, b in enumerate(bounds)) - mean * mean))))
    one = small(spark.createDataFrame(rows, "source string, mean double, dev double"), len(rows))  # as many rows as there are targets
    n = F.coalesce("n_tokens", F.lit(0)).cast("double")
    sums = documents.select("ident", "source", "n_tokens").distinct().groupBy("source").agg(F.sum(n).alias("s"), F.sum(n * n).alias("ss"))
    return sums.join(one, "source").select("source", (F.col("mean") * F.col("s")).alias("expected_tokens"), (F.col("dev") * F.sqrt("ss")).alias("deviation"))


def mixture(documents: DataFrame, asked: DataFrame, seed: int = 0) -> DataFrame:
    """The mixture, in a random order over all sources: ident, copy (from 1), source, n_tokens, position.

    ``documents``: ident, source, n_tokens; ``asked``: shares(), one row for each source of
    the mixture, read by the driver. No document is used more than max_repeats
    times. ``position`` is a hash; the rows are range partitioned and sorted by it.
    Repeated documents count once; an empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = [(r["source"], poisson_steps(r["rate"] or 0.0, int(r["max_repeats"] or 0))) for r in asked.collect()]
    steps = small(spark.createDataFrame(rows, "source string, steps array<double>"), len(rows))  # as many rows as there are targets
    u = _uniform(F.col("ident"), F.lit(seed))
    drawn = documents.select("ident", "source", "n_tokens").distinct().join(steps, "source")
    copies = drawn.withColumn("u", u).withColumn("n", F.size(F.filter("steps", lambda b: b <= F.col("u")))).where("n > 0")
    each = copies.select("ident", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "source", "n_tokens")
    return each.withColumn("position", F.xxhash64("ident", "copy", F.lit(seed + 1))).repartitionByRange("position").sortWithinPartitions("position")


def reached(mixed: DataFrame, asked: DataFrame) -> DataFrame:
    """shares() with the tokens and the share each source really has in the mixture: mixed_tokens, mixed_share."""
    own = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    joined = asked.join(own, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    every = F.sum("mixed_tokens").over(Window.partitionBy())  # a row for each target
    return joined.withColumn("mixed_share", F.try_divide(F.col("mixed_tokens"), every))
