"""Percentiles per group by distributed multi-select over mergeable runs.

A run is a sorted array of at most a few thousand values of one group, each of
weight ``step``. Runs are the state: those of different days, files or partitions
are put together by a union. A group with one run is read off directly. For the
others, round by round, every run of a still open range proposes its median, the
weighted median of the proposals becomes the range's pivot, each run is cut by
binary search into less, equal and greater, and the pieces that hold no sought
rank are thrown away; what is left shrinks by a constant share a round. A range
that fits one run is gathered and read off.

With ``error`` 0 runs hold all values and the result is exact. Otherwise a run of
m values keeps the middle one of every block of 2 x error x m, which moves a
rank by at most error x m, so by at most error x n over all runs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_of, salted_join
from ..storage import materialise, release

RUN = 4096
FAN_IN = 512


def runs(df: DataFrame, group: str, value: str, ident: str | None = None, error: float = 0.0, run_rows: int = RUN, by: str | None = None) -> DataFrame:
    """Mergeable state of df: grp, run, step, vals (sorted), with n the values that went in.

    With ``by`` (a day, a file) the state is that of each of its values put side by side, as if
    each had been made on its own, and an id that comes again on a later day counts on the first only;
    a null ``by`` is a day of its own.

    Null groups, null and NaN values take no part; infinities and negative values
    are values. With ``ident`` each id counts once (of conflicting facts for an id each
    counts); rows with a null id count one by one. To merge states, unite them;
    an id must then stand in one state only. Other columns are ignored.
    """
    g, v = F.col(f"`{group}`"), F.col(f"`{value}`").cast("double")
    part = F.col(f"`{by}`").cast("string") if by else F.lit(None).cast("string")
    rows = df.where(g.isNotNull() & v.isNotNull() & ~F.isnan(v)).select(g.cast("string").alias("grp"), v.alias("v"), part.alias("part"), *([F.col(f"`{ident}`").alias("id")] if ident else []))
    if ident:
        rows = rows.withColumn("lone", F.when(F.col("id").isNull(), F.monotonically_increasing_id()))
        rows = rows.groupBy("grp", "v", "id", "lone").agg(F.min("part").alias("part")) if by else rows.distinct()
        spread = F.xxhash64("id", "lone")
    else:
        spread = F.monotonically_increasing_id()
    unit = F.concat_ws("\x01", "grp", "part") if by else F.col("grp")
    rows = materialise(rows.select("grp", unit.alias("unit"), "v", spread.alias("spread")), "values")
    counts = rows.groupBy("unit").agg(F.count("*").alias("n"))
    counts = materialise(counts, "counts")
    many = counts.where(F.col("n") > run_rows)
    cut = salted_join(rows, many, "unit", "spread", "left", hot=hot_of(counts, "unit", "n"))
    pieces = F.coalesce(F.ceil(F.col("n") / run_rows), F.lit(1))
    sorted_runs = cut.groupBy("grp", "unit", F.pmod("spread", pieces).alias("run")).agg(F.array_sort(F.collect_list("v")).alias("vals"))
    if not error:
        return sorted_runs.select("grp", "run", F.lit(1).cast("bigint").alias("step"), "vals", F.size("vals").cast("bigint").alias("n"))
    m = F.size("vals")
    step = F.greatest(F.lit(1), F.floor(m * 2 * error)).cast("int")
    blocks = F.floor(m / step).cast("int")
    kept = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.get("vals", (j * step + F.floor(step / 2)).cast("int")))
    rest = F.slice("vals", blocks * step + 1, m - blocks * step)
    both = F.array(F.struct(step.cast("bigint").alias("step"), kept.alias("vals")), F.struct(F.lit(1).cast("bigint").alias("step"), rest.alias("vals")))
    thinned = sorted_runs.select("grp", "run", F.explode(both).alias("s")).where("size(s.vals) > 0")
    return thinned.select("grp", "run", "s.step", "s.vals", (F.size("s.vals") * F.col("s.step")).alias("n"))


def _below(vals: str, pivot: str, equal: bool) -> Column:
    """How many elements of the sorted array are below the pivot, or at most equal to it; by binary search."""
    steps = F.ceil(F.log2(F.size(vals) + 1)).cast("int") + 1
    start = F.struct(F.lit(0).alias("lo"), F.size(vals).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.get(vals, mid) <= F.col(pivot) if equal else F.get(vals, mid) < F.col(pivot)
        return (
            F.when(s["lo"] >= s["hi"], s)
            .when(under, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda s: s["lo"])


def _at_weight(items: Column, rank: Column) -> Column:
    """Of (v, w) structs sorted by v, the v at which the summed weight reaches rank."""
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("double").alias("v"))

    def take(s: Column, x: Column) -> Column:
        return F.struct((s["sum"] + x["w"]).alias("sum"), F.when(s["sum"] < rank, x["v"]).otherwise(s["v"]).alias("v"))

    return F.aggregate(items, start, take, lambda s: s["v"])


def _pivots(state: DataFrame, most_runs: int) -> DataFrame:
    """The weighted median of the runs' medians per range; of at most FAN_IN proposals at a time."""
    mid = F.get("vals", F.floor((F.size("vals") - 1) / 2).cast("int"))
    proposals = state.select("grp", "seg", "run", F.struct(mid.alias("v"), (F.size("vals") * F.col("step")).alias("w")).alias("p"))
    while True:
        last = most_runs <= FAN_IN
        parts = 1 if last else -(-most_runs // (FAN_IN // 2))
        part = F.lit(0).cast("bigint") if last else F.pmod(F.xxhash64("run"), F.lit(parts))
        of = proposals.groupBy("grp", "seg", part.alias("run")).agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("p.w").alias("w"))
        proposals = of.select("grp", "seg", "run", F.struct(_at_weight(F.col("ps"), F.ceil(F.col("w") / 2)).alias("v"), F.col("w").alias("w")).alias("p"))
        if last:
            return proposals.select("grp", "seg", F.col("p.v").alias("pivot"))
        most_runs = parts


def _read_off(gathered: Column, targets: Column) -> Column:
    """(i, v) for each target (i, rank) of a range whose (v, w) are all at hand."""
    return F.transform(targets, lambda t: F.struct(t["i"].alias("i"), _at_weight(gathered, t["rank"]).alias("v")))


def percentiles(state: DataFrame, shares: list[float], run_rows: int = RUN) -> DataFrame:
    """Per group: grp, n and values, the elements at rank ceil(share x n) for each of the shares (at least rank 1).

    ``state`` is a union of runs(). A group in more than one of them is one group.
    Groups without values do not occur. Ties need no care: equal values are one value.
    Beyond the error of the states nothing is lost.
    """
    names = [f"s{i}" for i in range(len(shares))]
    state = materialise(state.withColumn("run", F.xxhash64("run", F.col("vals")[0], F.monotonically_increasing_id())), "runs")
    totals = state.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("n_runs"), F.sum(F.size("vals")).alias("size"))
    ranks = [F.greatest(F.lit(1), F.ceil(F.round(F.lit(s) * F.col("n"), 6))).cast("bigint") for s in shares]
    totals = materialise(totals.select("*", F.array(*(F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, r in enumerate(ranks))).alias("targets")), "targets")
    weighted = F.transform("vals", lambda v: F.struct(v.alias("v"), F.col("step").alias("w")))

    def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:  # no more than run_rows values a range
        return rows.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(weighted))).alias("all"))

    small = F.col("size") <= run_rows
    lone = totals.where(small & (F.col("n_runs") == 1)).select("grp", "n", "targets")
    direct = state.join(lone, "grp").select(
        "grp", lone.n, F.transform("targets", lambda t: F.get("vals", F.floor((t["rank"] - 1) / F.col("step")).cast("int"))).alias("values")
    )
    few = totals.where(small & (F.col("n_runs") > 1)).select("grp", "targets")
    answers = [gathered(state.join(few.select("grp"), "grp", "left_semi"), ["grp"]).join(few, "grp").select("grp", F.explode(_read_off(F.col("all"), F.col("targets"))).alias("a"))]

    large = totals.where(~small)
    targets = materialise(large.select("grp", F.lit("").alias("seg"), "targets", "n_runs"), "open")
    open_ = salted_join(state, large.select("grp"), "grp", "run", "left_semi").select("grp", F.lit("").alias("seg"), "run", "step", "vals")
    while most := targets.agg(F.max("n_runs")).first()[0]:
        pivots = _pivots(open_, most)
        keyed = _to_runs(open_, pivots)
        cuts = keyed.select("*", _below("vals", "pivot", False).alias("lt"), _below("vals", "pivot", True).alias("le"))
        cuts = materialise(cuts, "cuts")
        sums = cuts.groupBy("grp", "seg").agg(
            F.first("pivot").alias("pivot"), F.sum(F.col("lt") * F.col("step")).alias("less"), F.sum(F.col("le") * F.col("step")).alias("upto"),
            F.sum("lt").alias("n_left"), F.sum(F.size("vals") - F.col("le")).alias("n_right"), F.count_if(F.col("lt") > 0).alias("runs_left"), F.count_if(F.size("vals") > F.col("le")).alias("runs_right"),
        )
        ranked = targets.join(sums, ["grp", "seg"])
        left = F.filter("targets", lambda t: t["rank"] <= F.col("less"))
        hit = F.filter("targets", lambda t: (t["rank"] > F.col("less")) & (t["rank"] <= F.col("upto")))
        right = F.transform(F.filter("targets", lambda t: t["rank"] > F.col("upto")), lambda t: F.struct(t["i"].alias("i"), (t["rank"] - F.col("upto")).alias("rank")))
        sides = F.array(
            F.struct(F.lit("l").alias("side"), left.alias("targets"), F.col("n_left").alias("size"), F.col("runs_left").alias("n_runs")),
            F.struct(F.lit("r").alias("side"), right.alias("targets"), F.col("n_right").alias("size"), F.col("runs_right").alias("n_runs")),
        )
        ranked = materialise(ranked.select("grp", "seg", "pivot", hit.alias("hit"), F.filter(sides, lambda s: F.size(s["targets"]) > 0).alias("sides")), "ranked")
        answers.append(ranked.select("grp", F.explode("hit").alias("t"), "pivot").select("grp", F.struct(F.col("t.i").alias("i"), F.col("pivot").alias("v")).alias("a")))
        new = ranked.select("grp", "seg", F.explode("sides").alias("s")).select("grp", "seg", "s.*")
        pieces = F.array(
            F.struct(F.lit("l").alias("side"), F.slice("vals", 1, F.col("lt")).alias("vals")),
            F.struct(F.lit("r").alias("side"), F.slice("vals", F.col("le") + 1, F.size("vals") - F.col("le")).alias("vals")),
        )
        moved = cuts.select("grp", "seg", "run", "step", F.explode(pieces).alias("p")).where("size(p.vals) > 0").select("grp", "seg", "run", "step", "p.*")
        kept = materialise(_to_runs(moved, new.select("grp", "seg", "side", "size"), ["side"]).withColumn("seg", F.concat("seg", "side")), "kept")
        release(cuts)
        new = new.withColumn("seg", F.concat("seg", "side"))
        done = new.where(F.col("size") <= run_rows).select("grp", "seg", "targets")
        at_hand = gathered(kept.where(F.col("size") <= run_rows), ["grp", "seg"])
        answers.append(at_hand.join(done, ["grp", "seg"]).select("grp", F.explode(_read_off(F.col("all"), F.col("targets"))).alias("a")))
        open_ = kept.where(F.col("size") > run_rows).select("grp", "seg", "run", "step", "vals")
        targets = materialise(new.where(F.col("size") > run_rows).select("grp", "seg", "targets", "n_runs"), "open")

    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    sought = found.groupBy("grp").agg(*(F.max(F.when(F.col("a.i") == i, F.col("a.v"))).alias(c) for i, c in enumerate(names)))
    rest = sought.join(totals.select("grp", "n"), "grp").select("grp", "n", F.array(*names).alias("values"))
    return direct.unionByName(rest)


def _to_runs(rows: DataFrame, ranges: DataFrame, more: list[str] = []) -> DataFrame:
    """rows joined with their ranges; a range of very many runs is spread over many tasks."""
    keys = ["grp", "seg", *more]
    one = rows.withColumn("range", F.concat_ws("\x01", *keys))
    other = ranges.withColumn("range", F.concat_ws("\x01", *keys)).drop(*keys)
    return salted_join(one, other, "range", "run").drop("range")
