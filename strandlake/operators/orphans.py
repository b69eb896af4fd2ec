"""References without a live target, kept up to date as rows arrive.

The tracker's state lies in a folder that all executors share: the log of references, the
births and the deletions of parents, each as one delta a batch, and the pending
orphans. A batch touches only what it can change:

* new references probe the parents,
* arriving parents are held against the pending references,
* deletions reopen references of their keys from the log.

A batch counts once it is marked complete; after a restart the tracker goes on from the
marked batches, and a batch that is replayed is passed over.

Everything is keyed by the target's identifier, and hot targets (a node with
very many incoming edges, there or missing) are salted in every one of these joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifier
from ..storage import children, exists, mark, new_path
from .skew import hot_keys, salted_join

REFS = "ref_table string, ref_id string, ref_pos int, key string, at timestamp"
PARENTS = "key string, live_from timestamp, live_to timestamp"
DEATHS = "key string, live_from timestamp, died timestamp"
COUNTS = "ref_table string, period string, n_orphans bigint"


def references(df: DataFrame, table: str, ref_id: str, target: str, at: str, kind: str, batch: str | None = None) -> DataFrame:
    """Rows of df as references to targets of ``kind``.

    ``target`` is a string column or an array of them; of an array each element is
    a reference at its 0-based place. Null and blank targets are no references.
    A null ``at`` is kept: nothing can be live then, so such a reference is an
    orphan of no period. An empty or null array gives nothing. ``batch`` names a column to keep, the batch of each row.
    """
    many = dict(df.dtypes)[target].startswith("array")
    number = [F.col(f"`{batch}`").alias("batch")] if batch else []
    own = df.select(F.col(f"`{ref_id}`").alias("ref_id"), F.col(f"`{at}`").alias("at"), F.col(f"`{target}`").alias("target"), *number)
    own = own.select("ref_id", "at", F.posexplode("target").alias("ref_pos", "one"), *number) if many else own.withColumn("ref_pos", F.lit(0)).withColumnRenamed("target", "one")
    key = identifier("one")
    return own.where(key.isNotNull()).select(
        F.lit(table).alias("ref_table"), F.col("ref_id").cast("string"), F.col("ref_pos").cast("int"), F.concat(F.lit(f"{kind}:"), key).alias("key"), F.col("at").cast("timestamp"), *number
    )


def parents(df: DataFrame, row_id: str, born: str, died: str | None, kind: str, batch: str | None = None) -> DataFrame:
    """Rows of df as targets; blank ids are none, and rows without ``born`` are never live. Without ``died`` deletions come as events."""
    key, number = identifier(row_id), [F.col(f"`{batch}`").alias("batch")] if batch else []
    end = F.col(died) if died else F.lit(None)
    return df.where(key.isNotNull() & F.col(born).isNotNull()).select(
        F.concat(F.lit(f"{kind}:"), key).alias("key"), F.col(born).cast("timestamp").alias("live_from"), end.cast("timestamp").alias("live_to"), *number
    )


def deletions(df: DataFrame, row_id: str, born: str, died: str, kind: str, batch: str | None = None) -> DataFrame:
    """Rows of df with a ``died`` as events of their own: each ends the life of its target that began at ``born``."""
    key, number = identifier(row_id), [F.col(f"`{batch}`").alias("batch")] if batch else []
    return df.where(key.isNotNull() & F.col(born).isNotNull() & F.col(died).isNotNull()).select(
        F.concat(F.lit(f"{kind}:"), key).alias("key"), F.col(born).cast("timestamp").alias("live_from"), F.col(died).cast("timestamp").alias("died"), *number
    )


class OrphanTracker:
    """Pending-orphan state. A reference is an orphan if no row of its target is live at its time.

    The result does not depend on how the arrivals are cut into batches or on
    their order. Repeated arrivals change nothing but the log's length; open()
    returns distinct rows. Empty batches are allowed. ``state`` names a folder to keep the state in and
    to go on from; without it the state is gone with the application.
    """

    def __init__(self, spark: SparkSession, state: str | None = None):
        self.spark = spark
        self.folder = state.rstrip("/") if state else new_path(spark, "orphans")
        self.done = [int(name.split("=")[1]) for name in children(spark, f"{self.folder}/done")]
        self.done.sort()
        self._hot = set(hot_keys(self._read("refs", REFS, self.done), "key")) if self.done else set()

    def _path(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}/batch={batch}"

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        """One scan over the deltas of these batches."""
        there = {int(name.split("=")[1]) for name in children(self.spark, f"{self.folder}/{kind}") if "=" in name}
        paths = [self._path(kind, b) for b in batches if b in there]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, refs: DataFrame, born: DataFrame, deleted: DataFrame) -> OrphanTracker:
        """Writes the deltas of many batches at once, in one scan of each table; the rows name their ``batch``. take() then takes them in."""
        for kind, rows, schema in (("refs", refs, REFS), ("births", born, PARENTS), ("deaths", deleted, DEATHS)):
            columns = [c.split()[0] for c in schema.split(", ")]
            rows.select("batch", *columns).write.mode("overwrite").partitionBy("batch").parquet(f"{self.folder}/{kind}")
        self._hot |= set(hot_keys(self._read("refs", REFS, [int(n.split("=")[1]) for n in children(self.spark, f"{self.folder}/refs") if "=" in n]), "key"))
        return self

    def advance(self, refs: DataFrame | None = None, born: DataFrame | None = None, deleted: DataFrame | None = None, batch: int | None = None) -> OrphanTracker:
        """Takes in a batch: references, parent rows, and deletions (key, died, and live_from if known).

        A deletion closes the period of its key that began at its live_from; without one,
        all periods of the key that are open at its time. A batch number that is complete already is passed over.
        """
        batch = (self.done[-1] + 1 if self.done else 0) if batch is None else batch
        if batch in self.done:
            return self
        if refs is not None:
            refs.select("ref_table", "ref_id", "ref_pos", "key", "at").write.mode("overwrite").parquet(self._path("refs", batch))
            self._hot |= set(hot_keys(self._read("refs", REFS, [batch]), "key"))
        if born is not None:
            born.select("key", "live_from", "live_to").distinct().write.mode("overwrite").parquet(self._path("births", batch))
        if deleted is not None:
            began = F.col("live_from") if "live_from" in deleted.columns else F.lit(None).cast("timestamp")
            deleted.select("key", began.alias("live_from"), "died").distinct().write.mode("overwrite").parquet(self._path("deaths", batch))
        return self.take(batch)

    def _lives(self, births: DataFrame, batches: list[int]) -> DataFrame:
        """births with the deletions of these batches applied."""
        deaths = self._read("deaths", DEATHS, batches).withColumnRenamed("key", "of").withColumnRenamed("live_from", "began")
        ends = (F.col("key") == F.col("of")) & F.when(F.col("began").isNull(), F.col("died") >= F.col("live_from")).otherwise(F.col("began") == F.col("live_from"))
        closed = births.distinct().join(deaths, ends, "left").groupBy("key", "live_from", "live_to").agg(F.min("died").alias("died"))
        return closed.select("key", "live_from", F.least("live_to", "died").alias("live_to"))

    def _orphans(self, refs: DataFrame, lives: DataFrame) -> DataFrame:
        live = (F.col("r.live_from") <= F.col("l.at")) & (F.col("r.live_to").isNull() | (F.col("r.live_to") > F.col("l.at")))
        columns = refs.columns
        return salted_join(refs, lives, "key", "ref_id", "left_anti", live, hot=sorted(self._hot)).select(*columns)

    def take(self, batch: int) -> OrphanTracker:
        """Works the deltas of a written batch into the pending state."""
        if batch in self.done:
            return self
        before, now = list(self.done), [*self.done, batch]
        has = {kind: exists(self.spark, self._path(kind, batch)) for kind in ("refs", "births", "deaths")}
        kept, check = self._pending(), []
        if has["births"]:
            kept = self._orphans(kept, self._lives(self._read("births", PARENTS, [batch]), now))
        if has["refs"]:
            check.append(self._read("refs", REFS, [batch]))
        if has["deaths"] and before:
            ends = self._read("deaths", DEATHS, [batch]).groupBy("key").agg(F.min("died").alias("died"))
            check.append(salted_join(self._read("refs", REFS, before), ends, "key", "ref_id", "left_semi", F.col("r.died") <= F.col("l.at"), hot=sorted(self._hot)).select(*kept.columns))
        if check:
            again = self._orphans(reduce(DataFrame.unionByName, check), self._lives(self._read("births", PARENTS, now), now))
            kept = kept.unionByName(again)
        kept.distinct().write.mode("overwrite").parquet(self._path("pending", batch))
        pending = self._read("pending", REFS, [batch])
        counts = pending.groupBy("ref_table", _period()).agg(F.count_distinct("ref_id", "ref_pos").alias("n_orphans"))
        counts.coalesce(1).write.mode("overwrite").parquet(self._path("counts", batch))  # a row for each table and month
        mark(self.spark, self._path("done", batch))
        self.done = sorted(now)
        return self

    def _pending(self) -> DataFrame:
        return self._read("pending", REFS, self.done[-1:])

    def open(self) -> DataFrame:
        """The orphans as of now: ref_table, ref_id, ref_pos, period ('yyyy-MM' of the reference)."""
        return self._pending().select("ref_table", "ref_id", "ref_pos", _period()).distinct()

    def history(self) -> DataFrame:
        """The counts after each batch: batch, ref_table, period, n_orphans."""
        parts = [self._read("counts", COUNTS, [b]).select(F.lit(b).alias("batch"), "ref_table", "period", "n_orphans") for b in self.done]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"batch int, {COUNTS}")

    def snapshot(self) -> DataFrame:
        """Counts per table and period: ref_table, period, n_refs (with a target named), n_orphans."""
        every = self._read("refs", REFS, self.done).groupBy("ref_table", _period()).agg(F.count_distinct("ref_id", "ref_pos").alias("n_refs"))
        lost = self.open().groupBy("ref_table", "period").agg(F.count("*").alias("n_orphans"))
        same = (every.ref_table == lost.ref_table) & every.period.eqNullSafe(lost.period)
        return every.join(lost, same, "left").select(every.ref_table, every.period, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))


def _period() -> Column:
    return F.date_format("at", "yyyy-MM").alias("period")
