"""The best N items of every group by merging sorted runs with a loser tree.

Each task sorts its rows into runs ordered by (group, score, id) and keeps N
distinct items a group, so the largest group sends no more than N rows from any
run. The runs are stored, cut into buckets by group, and merged FAN_IN at a time by
a loser tree; after N outputs of a group every run that still stands in that group
is moved by binary search to its next group. What a merge leaves is a run again,
so a group in very many runs is merged level by level: no task ever holds more
than FAN_IN runs of a bucket, and the number of buckets follows from the stored
runs' size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, ship

RUN_BYTES = 16 << 20  # of Arrow rows that are sorted into one run
FAN_IN = 64
BUCKET_ROWS = 500_000  # of all runs together
RUN = "grp string, score double, ident bigint, run bigint"


class LoserTree:
    """A tournament over k cursors: the winner has the smallest key; None is larger than any key."""

    def __init__(self, keys: list):
        self.keys, self.k = keys, len(keys)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and x < y)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (b, a) if self._less(b, a) else (a, b)
        return won

    def replace(self, key) -> None:
        """Gives the winner its next key and plays its matches again."""
        keys, losers, i = self.keys, self.losers, self.winner
        keys[i] = key
        node = (i + self.k) >> 1
        while node:
            j = losers[node]
            other = keys[j]
            if other is not None and (key is None or other < key):
                losers[node], i, key = i, j, other
            node >>= 1
        self.winner = i


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place in the sorted list of distinct values."""
    encoded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[encoded.indices.to_numpy()], encoded.dictionary.take(pa.array(order))


def _run(rows: pa.Table, n: int, number: int) -> Iterator[pa.RecordBatch]:
    group, names = _codes(rows.column(0))
    score, ident = rows.column(1).to_numpy(), rows.column(2).to_numpy()
    order = np.lexsort((score, ident, group))  # of an id's repeats the best score stays
    g, i = group[order], ident[order]
    order = order[np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]))]
    order = order[np.lexsort((ident[order], score[order], group[order]))]
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    order = order[place < n]
    table = pa.table({"grp": names.take(pa.array(group[order])), "score": score[order], "ident": ident[order], "run": np.full(len(order), number, np.int64)})
    yield from table.to_batches(max_chunksize=20_000)


def _runs(n: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES:
                yield from _run(pa.Table.from_batches(held), n, number)
                number, held, size = number + 1, [], 0
        if size:
            yield from _run(pa.Table.from_batches(held), n, number)

    return make


def merge_runs(runs: list[tuple[list, list, list]], n: int) -> Iterator[tuple[int, float, int, int]]:
    """(group, score, id, rank) of each group's n best items; a run is three lists ordered by (group, score, id)."""
    at = [0] * len(runs)
    tree = LoserTree([(r[0][0], r[1][0], r[2][0]) for r in runs])
    current, taken, seen = None, 0, set()
    while (key := tree.keys[w := tree.winner]) is not None:
        groups, scores, idents = runs[w]
        if key[0] != current:
            current, taken, seen = key[0], 0, set()
        if taken < n:
            if key[2] not in seen:
                seen.add(key[2])
                taken += 1
                yield key[0], key[1], key[2], taken
            at[w] += 1
        else:
            at[w] = bisect_right(groups, current, at[w])
        i = at[w]
        tree.replace((groups[i], scores[i], idents[i]) if i < len(groups) else None)


def _merged(rows: pa.Table, n: int) -> pa.Table:
    """The runs of one table merged: grp, score, ident, rank."""
    group, names = _codes(rows.column(0))
    score, ident, run = (rows.column(i).to_numpy() for i in (1, 2, 3))
    by_run = np.argsort(run, kind="stable")  # a run's rows arrive in its order
    runs = []
    for part in np.split(by_run, np.flatnonzero(np.diff(run[by_run])) + 1):
        g, s, i = group[part], score[part], ident[part]
        ahead = (g[1:] > g[:-1]) | ((g[1:] == g[:-1]) & ((s[1:] > s[:-1]) | ((s[1:] == s[:-1]) & (i[1:] > i[:-1]))))
        if not ahead.all():
            order = np.lexsort((i, s, g))
            g, s, i = g[order], s[order], i[order]
        runs.append((g.tolist(), s.tolist(), i.tolist()))
    g, s, i, rank = zip(*merge_runs(runs, n))
    return pa.table({"grp": names.take(pa.array(g, pa.int64())), "score": pa.array(s, pa.float64()), "ident": pa.array(i, pa.int64()), "rank": pa.array(rank, pa.int32())})


def _merge(n: int, last: bool):
    """Merges the rows of each (bucket, merge) as they arrive, one after the other: to ranked items, or to a run with the merge's number."""

    def flush(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        done = _merged(pa.Table.from_batches(held).drop_columns(["bucket", "merge"]), n)
        if not last:
            done = done.drop_columns(["rank"]).append_column("run", pa.array(np.full(len(done), number, np.int64)))
        yield from done.to_batches(max_chunksize=20_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = [], None
        for batch in batches:
            bucket, number = batch.column("bucket").to_numpy(), batch.column("merge").to_numpy()
            ends = [*(np.flatnonzero((bucket[1:] != bucket[:-1]) | (number[1:] != number[:-1])) + 1), batch.num_rows]
            start = 0
            for end in ends:
                if end == start:
                    continue
                if held and unit != (bucket[start], number[start]):
                    yield from flush(held, int(unit[1]))
                    held = []
                unit = (bucket[start], number[start])
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from flush(held, int(unit[1]))

    return merge


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, buckets: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Per group the n items with the smallest score; on equal scores the smaller id goes first.

    Result: group, score (double), id (bigint), rank (1 to n), under df's names.
    Rows with a null group, score or id and with a NaN score take no part. Each id
    counts once in a group, with its smallest score. Groups with fewer than n items
    give all of them; an empty table gives no rows. For the largest scores pass the
    negated score. A merge holds at most n rows of each of its bucket's groups from
    each of ``fan_in`` runs; ``buckets`` (default: one for BUCKET_ROWS stored rows, at
    least the session's shuffle partitions) says how many buckets there are.
    """
    spark = df.sparkSession
    ship(spark)
    g, s, i = (F.col(f"`{c}`") for c in (group, score, ident))
    rows = df.select(g.cast("string").alias("grp"), s.cast("double").alias("score"), i.cast("bigint").alias("ident"))
    rows = rows.where("grp is not null and score is not null and not isnan(score) and ident is not null")
    runs = materialise(rows.mapInArrow(_runs(n), RUN), "runs")
    stored, most = runs.agg(F.count("*"), F.approx_count_distinct("run")).first()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int").alias("bucket")

    def merged(runs: DataFrame, merges: int, schema: str) -> DataFrame:
        number = F.pmod(F.xxhash64("run"), F.lit(merges)).cast("bigint").alias("merge")
        units = runs.select("grp", "score", "ident", "run", bucket, number).repartition("bucket", "merge").sortWithinPartitions("bucket", "merge", "run", "grp", "score", "ident")
        return units.mapInArrow(_merge(n, schema != RUN), schema)

    while most > fan_in:
        most = -(-most // (fan_in // 2))  # twice as many as needed: the hash does not cut evenly
        runs = materialise(merged(runs, most, RUN), "runs")
    return merged(runs, 1, "grp string, score double, ident bigint, rank int").select(
        F.col("grp").alias(group), F.col("score").alias(score), F.col("ident").alias(ident), "rank"
    )
