"""Per-key results and joins that do not depend on how the keys are spread.

``per_key`` aggregates by range partitioning on the composite of key and
secondary order: the range bounds are quantiles of a sample of the composite, so
a key that holds a third of all rows is cut into as many ranges as it deserves.
Each partition then folds its sorted rows into one partial state per key, and
only the states at partition bounds, at most two a partition, are stitched.

``salted_join`` splits the hot keys of the large side, and copies only the rows
of those keys on the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise, ship


def _changes(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the row before; null equals null."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.fill_null(pc.not_equal(before, after), True)
    return pc.and_(differs, pc.invert(pc.and_(pc.is_null(before), pc.is_null(after)))).to_numpy(zero_copy_only=False)


def _fold(n_keys: int, schema: pa.Schema):
    """Sorted rows (keys, item, stated) of one partition to one state per key."""
    names = [f"k{i}" for i in range(n_keys)]

    def emit(states: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(states, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict | None = None  # the key that the last batch ended with
        opening = True  # whether held is the partition's first key
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, item, stated = [batch.column(i) for i in range(n_keys)], batch.column(n_keys), batch.column(n_keys + 1)
            new_key = np.ones(n, bool)
            new_item = np.ones(n, bool)
            if n > 1:
                new_key[1:] = np.logical_or.reduce([_changes(k) for k in keys])
                new_item[1:] = new_key[1:] | _changes(item)
            starts = np.flatnonzero(new_key)
            ends = np.append(starts[1:], n)
            new_item &= pc.is_valid(item).to_numpy(zero_copy_only=False)
            distinct = np.add.reduceat(new_item.astype(np.int64), starts)
            known = pc.is_valid(stated).to_numpy(zero_copy_only=False)
            values = pc.fill_null(stated, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            top = np.iinfo(np.int64)
            low = np.minimum.reduceat(np.where(known, values, top.max), starts)
            high = np.maximum.reduceat(np.where(known, values, top.min), starts)
            some = np.logical_or.reduceat(known, starts)
            first, last = item.take(pa.array(starts)), item.take(pa.array(ends - 1))

            def one(i: int) -> dict:
                return {
                    **{c: k[int(starts[i])].as_py() for c, k in zip(names, keys)},
                    "part": part, "n_rows": int(ends[i] - starts[i]), "n_items": int(distinct[i]),
                    "low": int(low[i]) if some[i] else None, "high": int(high[i]) if some[i] else None,
                    "first": first[i].as_py(), "last": last[i].as_py(), "bound": False,
                }

            state = one(0)
            if held is not None and all(held[c] == state[c] for c in names):
                same = held["last"] is not None and held["last"] == state["first"]
                held["n_rows"] += state["n_rows"]
                held["n_items"] += state["n_items"] - same
                held["last"] = state["last"]
                held["low"] = min((x for x in (held["low"], state["low"]) if x is not None), default=None)
                held["high"] = max((x for x in (held["high"], state["high"]) if x is not None), default=None)
            else:
                if held is not None:
                    yield emit([held | {"bound": opening}])
                    opening = False
                held = state
            if len(starts) > 1:
                yield emit([held | {"bound": opening}])
                opening = False
                inner = slice(1, len(starts) - 1)
                at = pa.array(starts[inner])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(k.take(at) for k in keys),
                            pa.array(np.full(len(at), part, np.int32)),
                            pa.array(ends[inner] - starts[inner]), pa.array(distinct[inner]),
                            pa.array(low[inner], mask=~some[inner]), pa.array(high[inner], mask=~some[inner]),
                            pa.nulls(len(at), schema.field("first").type), pa.nulls(len(at), schema.field("last").type),
                            pa.array(np.zeros(len(at), bool)),
                        ],
                        schema=schema,
                    )
                held = one(len(starts) - 1)
        if held is not None:
            yield emit([held | {"bound": True}])

    return run


def per_key(df: DataFrame, keys: list[str], item: str, stated: str, tie: str, partitions: int | None = None) -> DataFrame:
    """Rows, distinct items and the range of a stated number for every key.

    Result: the key columns, n_rows, n_items (distinct non-null ``item``),
    stated_min and stated_max (of the non-null ``stated``, a whole number).
    ``tie`` makes the composite order unique, so that even one (key, item) pair
    with very many rows can be cut; it may hold nulls or repeats.

    A null key is a key of its own. A null item counts as a row but as no item.
    Repeated rows count as rows, not as items. An empty table gives no rows. Keys
    must not be floating point. Other columns are dropped, so their names are free.
    """
    ship(df.sparkSession)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)),
        F.col(f"`{item}`").alias("item"), F.col(f"`{stated}`").cast("bigint").alias("stated"), F.col(f"`{tie}`").alias("tie"),
    )
    rows = materialise(rows, "keyed")  # the range bounds are sampled from what the partitioning then reads again
    order = [*names, "item", "tie"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    types = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType(
        [T.StructField(n, types[n]) for n in names]
        + [T.StructField("part", T.IntegerType()), T.StructField("n_rows", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
        + [T.StructField("first", types["item"]), T.StructField("last", types["item"]), T.StructField("bound", T.BooleanType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    folded = ranged.sortWithinPartitions(*names, "item").drop("tie").mapInArrow(_fold(len(keys), to_arrow_schema(schema)), schema)
    states = materialise(folded, "states")
    in_order = Window.partitionBy(*names).orderBy("part")
    seam = (F.lag("last").over(in_order) == F.col("first")).cast("bigint")  # the bound cuts one item in two
    stitched = (
        states.where("bound")
        .withColumn("n_items", F.col("n_items") - F.coalesce(seam, F.lit(0)))
        .groupBy(*names)
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_items").alias("n_items"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    inner = states.where("not bound").select(*names, "n_rows", "n_items", "low", "high")
    return inner.unionByName(stitched).select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)), "n_rows", "n_items", F.col("low").alias("stated_min"), F.col("high").alias("stated_max")
    )


MOST_HOT = 1000


MOST_SENT = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has, as its maker counted, at most MOST_SENT rows (some tens of MB of a few numbers each); else the planner chooses."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def hot_of(counts: DataFrame, key: str, n: str) -> list:
    """Of keys with their counts those with more than 1/MOST_HOT of all rows, in one pass: at most MOST_HOT values, whatever the size."""
    seen = Observation()
    top = counts.where(F.col(key).isNotNull()).observe(seen, F.sum(n).alias("total")).orderBy(F.desc(n)).limit(MOST_HOT).select(key, n).collect()
    return [r[0] for r in top if r[1] > max(seen.get["total"] / MOST_HOT, 1)] if top else []


def hot_keys(df: DataFrame, key: str) -> list:
    """The keys with more than 1/MOST_HOT of all rows; df is read once."""
    return hot_of(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")), key, "_n")


def salted_join(large: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", on=None, salts: int = 32, hot: list | None = None) -> DataFrame:
    """large joined with small on ``key`` (and the condition ``on``), with large's hot keys spread over ``salts`` tasks.

    ``spread`` is a column of large that varies within a key. ``how`` may be inner,
    left, left_semi or left_anti; null keys match nothing. Only the hot keys, at most
    MOST_HOT values, come to the driver; a caller that knows them passes ``hot``. Both sides keep their columns under the
    aliases ``l`` and ``r``, which ``on`` can use.
    """
    match = F.col(f"l.{key}") == F.col(f"r.{key}")
    hot = hot_keys(large, key) if hot is None else hot
    if hot:
        is_hot = F.col(key).isin(hot)  # a hash set
        large = large.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
        copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        small = small.withColumn("_salt", F.explode(copies))
        match = match & (F.col("l._salt") == F.col("r._salt"))
    joined = large.alias("l").join(small.alias("r"), match if on is None else match & on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_salt")
    return joined.drop(F.col("r._salt"), F.col("l._salt"), F.col(f"r.{key}")) if hot else joined.drop(F.col(f"r.{key}"))
