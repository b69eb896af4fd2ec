"""Packing texts into containers of fixed capacity by linear grouping.

Only the number of items of each size matters for the plan, and there are no more
sizes than tokens in a container; so the driver plans on a histogram of bounded
size, and the plan is carried out on the items by their rank within their size.

1. A text above the capacity is cut: full pieces, each alone, and a rest.
2. Large items, in order of size, fall into groups of equal cardinality and count
   as the group's largest size. Column generation finds the configurations (how
   many items of each group share a container) that need the fewest containers.
3. The items take the configurations' places in order of rank.
4. Small items go, largest first, to the container with the least room that still
   holds them, by the real room left; many equal items move at once.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import small
from ..storage import materialise, ship

GROUPS = 64
SMALL = 8  # an item is small if SMALL of them fit into a container
SALTS = 64
LONGEST_RANK = 1 << 48  # ranks within a size stay below it


def ranked(df: DataFrame, size: str, ident: str, name: str) -> DataFrame:
    """df with each row's 0-based rank among the rows of its size. A size that most rows share is ranked in parts: SALTS, or twice the session's shuffle partitions."""
    salts = max(SALTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    counts = salted.groupBy(size, "_salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(size).alias("_size"), F.col("_salt").alias("_part"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(ident)) - 1
    joined = salted.withColumn("_own", own).join(starts, (F.col(size) == F.col("_size")) & (F.col("_salt") == F.col("_part")))
    return joined.withColumn(name, F.col("_before") + F.col("_own")).drop("_salt", "_size", "_part", "_before", "_own")


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """The counts a with sizes . a <= capacity whose summed value is greatest."""
    best, back = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        step = np.full((len(sizes), capacity + 1), -1.0)
        for i, (s, v) in enumerate(zip(sizes, values)):
            step[i, s:] = best[: capacity + 1 - s] + v
        pick = step.argmax(axis=0)
        top = step[pick, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        back.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    for picks in reversed(back):
        if picks[room] >= 0:
            pattern[picks[room]] += 1
            room -= int(sizes[picks[room]])
    return pattern


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that all items of few sizes are placed; near the fewest containers."""
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * len(sizes)):
        amounts, duals = np.linalg.solve(basis, counts), np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = _best_pattern(sizes, duals, capacity)
        if duals @ new <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, new)
        ratio = np.where(change > 1e-12, amounts / np.where(change > 1e-12, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    amounts = np.maximum(np.linalg.solve(basis, counts), 0)
    plan, left = [], counts.astype(np.int64).copy()
    for pattern, amount in sorted(zip(basis.T.astype(np.int64), amounts), key=lambda x: -x[1]):
        used = pattern > 0
        times = min([int(amount + 1e-9), *(left[used] // pattern[used])]) if used.any() else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # a few containers for what rounding left over: the largest that fits, again and again
        pattern, room = np.zeros_like(left), capacity
        for i in np.argsort(-sizes, kind="stable"):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def plan_large(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple], dict[int, int], int, int]:
    """Places for the large items: rows (group, first, last, each, container), ranks before each size, cardinality, containers.

    Item i of a group with first <= i < last goes to container + (i - first) // each.
    """
    order = sorted(histogram, reverse=True)
    starts = dict(zip(order, np.cumsum([0] + [histogram[s] for s in order])[:-1].tolist()))
    total = sum(histogram.values())
    if not total:
        return [], {}, 1, 0
    cardinality = -(-total // groups)
    sizes, counts = [], []
    for first in range(0, total, cardinality):  # the largest size of the group is that of its first item
        sizes.append(next(s for s in order if starts[s] <= first < starts[s] + histogram[s]))
        counts.append(min(cardinality, total - first))
    distinct = sorted(set(sizes), reverse=True)
    summed = np.array([sum(c for s, c in zip(sizes, counts) if s == d) for d in distinct])
    places, taken, container = [], [0] * len(distinct), 0
    slots: list[list[tuple[int, int, int, int]]] = [[] for _ in distinct]
    for pattern, times in configurations(np.array(distinct), summed, capacity):
        for k in np.flatnonzero(pattern):
            slots[k].append((taken[k], taken[k] + int(pattern[k]) * times, int(pattern[k]), container))
            taken[k] += int(pattern[k]) * times
        container += times
    offset: dict[int, int] = defaultdict(int)
    for g, (s, c) in enumerate(zip(sizes, counts)):  # groups of one size share that size's places
        k, base = distinct.index(s), offset[s]
        for first, last, each, at in slots[k]:
            if first < base + c and last > base:
                places.append((g, first - base, last - base, each, at))
        offset[s] += c
    return places, starts, cardinality, container


def plan_small(histogram: dict[int, int], rooms: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Best fit in bulk: rows (size, first, last, room, rank) and the number of new containers.

    Items first <= i < last of a size go to the containers that had ``room`` left and
    rank ``rank`` + i - first among those; new containers have room capacity + 1.
    """
    pools: dict[int, list[list[int]]] = {r: [[r, 0, n]] for r, n in rooms.items() if r > 0}
    order = sorted(pools)
    plan, opened = [], 0

    def put(room: int, origin: int, first: int, n: int) -> None:
        if room <= 0:
            return
        if room not in pools:
            pools[room] = []
            insort(order, room)
        last = pools[room][-1] if pools[room] else None
        if last and last[0] == origin and last[1] + last[2] == first:
            last[2] += n
        else:
            pools[room].append([origin, first, n])

    for size in sorted(histogram, reverse=True):
        done, total = 0, histogram[size]
        while done < total:
            at = bisect_left(order, size)
            if at == len(order):
                n = -(-(total - done) // (capacity // size))
                put(capacity, capacity + 1, opened, n)
                opened += n
                continue
            room = order[at]
            pieces, rest = pools[room], []
            for i, (origin, first, n) in enumerate(pieces):
                n_now = min(n, total - done)
                plan.append((size, done, done + n_now, origin, first))
                put(room - size, origin, first, n_now)
                done += n_now
                if n_now < n:
                    rest = [[origin, first + n_now, n - n_now], *pieces[i + 1 :]]
                if done == total:
                    rest = rest or pieces[i + 1 :]
                    break
            if rest:
                pools[room] = rest
            else:
                del pools[room]
                order.remove(room)
    return plan, opened


def pack(df: DataFrame, ident: str, size: str, capacity: int, groups: int = GROUPS) -> DataFrame:
    """Each item's pieces and their containers: ident, piece, first_token, n_tokens, n_pieces, container_id.

    ``ident`` must be unique; rows that repeat an id with the same size count once.
    Null sizes count as 0. An item of size 0 takes no room and gets no container
    (null). Only an item above the capacity is cut, into the fewest pieces. Ties
    go by id. An empty table gives no rows. No container exceeds the capacity.
    The driver sees three histograms of at most ``capacity`` rows.
    """
    spark = df.sparkSession
    n = F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("bigint")
    items = df.select(F.col(f"`{ident}`").alias("ident"), n.alias("size")).distinct()
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    cut = items.withColumn("n_pieces", pieces).select("ident", "size", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    cut = cut.select("ident", "piece", "n_pieces", first.alias("first_token"), F.least(F.lit(capacity), F.col("size") - first).cast("int").alias("n_tokens"))
    cut = materialise(cut.withColumn("key", F.struct("ident", "piece")), "pieces")
    counted = {r["n_tokens"]: r["count"] for r in cut.groupBy("n_tokens").count().collect()}
    limit = capacity // SMALL
    places, starts, cardinality, n_large = plan_large({s: c for s, c in counted.items() if s > limit}, capacity, groups)
    placed = _place_large(spark, cut.where(F.col("n_tokens") > limit), places, starts, cardinality)
    rooms = ranked(placed.groupBy("at").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("room")), "room", "at", "place")
    rooms = materialise(rooms, "rooms")
    left = {r["room"]: r["count"] for r in rooms.groupBy("room").count().collect()}
    plan, opened = plan_small({s: c for s, c in counted.items() if 0 < s <= limit}, left, capacity)
    bases = dict(zip([*sorted(left), capacity + 1], np.cumsum([0, *(left[r] for r in sorted(left))]).tolist()))
    base = F.create_map(*(F.lit(x) for pair in bases.items() for x in pair))
    container = base[F.col("room")] + F.col("place")
    large = placed.join(rooms, "at").select("key", container.cast("bigint").alias("container_id"))
    few = ranked(cut.where((F.col("n_tokens") > 0) & (F.col("n_tokens") <= limit)), "n_tokens", "key", "place")
    small = _place_small(few.select("key", "n_tokens", "place"), [(size, first, bases[room] + rank) for size, first, _, room, rank in plan])
    none = cut.where("n_tokens = 0").select("key", F.lit(None).cast("bigint").alias("container_id"))
    at = large.unionByName(small).unionByName(none)
    return cut.join(at, "key").select(F.col("ident").alias(ident), "piece", "first_token", "n_tokens", "n_pieces", "container_id")


def _place_large(spark: SparkSession, items: DataFrame, places: list[tuple], starts: dict[int, int], cardinality: int) -> DataFrame:
    table = spark.createDataFrame(places, "grp int, first bigint, last bigint, each int, base bigint")
    before = F.create_map(*(F.lit(x) for pair in (starts or {0: 0}).items() for x in pair))
    rank = before[F.col("n_tokens")] + F.col("place")
    at = ranked(items, "n_tokens", "key", "place").withColumn("rank", rank).withColumn("grp", F.floor(F.col("rank") / cardinality).cast("int")).withColumn("i", F.col("rank") % cardinality)
    joined = at.join(small(table, len(places)), "grp").where((F.col("i") >= F.col("first")) & (F.col("i") < F.col("last")))  # at most a row for each group and configuration
    return joined.select("key", "n_tokens", (F.col("base") + F.floor((F.col("i") - F.col("first")) / F.col("each"))).cast("bigint").alias("at"))


def _place_small(items: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """key and container_id of small items (key, n_tokens, place) by the plan's rows (size, first rank, container).

    Each item looks its interval up by binary search, so no row meets more than one
    line of the plan, whatever size most rows have. The plan was made by the driver
    from histograms of at most the capacity's number of rows, and is sent once to each executor.
    """
    ship(items.sparkSession)
    order = sorted(plan)
    begins = np.array([size * LONGEST_RANK + first for size, first, _ in order], np.int64)
    starts = np.array([container for *_, container in order], np.int64)
    sent = items.sparkSession.sparkContext.broadcast((begins, starts))
    key = items.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, starts = sent.value
        for batch in batches:
            if batch.num_rows:
                at = batch.column(1).to_numpy().astype(np.int64) * LONGEST_RANK + batch.column(2).to_numpy()
                line = np.searchsorted(begins, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts[line] + at - begins[line])], ["key", "container_id"])

    return items.mapInArrow(place, f"key {key}, container_id bigint")
