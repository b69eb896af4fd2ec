"""Annotation events as streams: the batch operators of operators.temporal on readStream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import temporal
from ..operators.orphans import OrphanTracker


def read(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files as they arrive in the folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(df: DataFrame, mode: str, sink: str, checkpoint: str, name: str | None = None, every: str | None = None) -> StreamingQuery:
    """Starts a query; without ``every`` it takes what is there and ends."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    return writer.format("memory").start() if sink == "memory" else writer.format("parquet").start(sink)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    return temporal.tumbling(events, width, late)


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return temporal.sessions(events, gap, late)


def latest(events: DataFrame) -> DataFrame:
    """The newest value per (node_id, annotation_type), to be written in update or complete mode."""
    return temporal.latest(events)


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, remembered for the watermark's delay only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def track_orphans(arrivals: DataFrame, tracker: OrphanTracker, checkpoint: str) -> StreamingQuery:
    """Feeds arriving rows to a tracker, batch by batch.

    ``arrivals`` are references (REFS), or any of references, births and deletions as
    orphan_events() puts them. The tracker should keep its state in a folder: after a restart with the
    same checkpoint it goes on from there, and a batch that the stream replays is passed over.
    """
    mixed = "kind" in arrivals.columns

    def take(batch: DataFrame, number: int) -> None:
        if not mixed:
            tracker.advance(batch, batch=number)
            return
        of = lambda kind: batch.where(F.col("kind") == kind)
        tracker.advance(of("ref"), of("birth"), of("death"), batch=number)

    return arrivals.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_events(refs: DataFrame | None = None, born: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """References, births and deletions as rows of one table or stream, told apart by ``kind``."""
    given = [df.withColumn("kind", F.lit(kind)) for kind, df in (("ref", refs), ("birth", born), ("death", deleted)) if df is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), given)


def map_read_stream(reads: DataFrame, node_kmers: DataFrame, k: int = 31, least: int = 5, at: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Arriving reads (read_id, sequence) against a static k-mer table (kmer, id): read_id, id, hits, in complete or update mode.

    With ``at``, the reads' time, a read's hits are kept as state only until the watermark
    has passed it by ``late``, so state does not grow without end, and append mode is possible.
    """
    from ..operators.kmers import kmers

    static = node_kmers.select("kmer", "id").distinct()
    if at is None:
        return kmers(reads, "read_id", "sequence", k).join(static, "kmer").groupBy("read_id", "id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    keyed = reads.select(F.struct("read_id", at).alias("read"), "sequence")
    found = kmers(keyed, "read", "sequence", k).join(static, "kmer").select("read.read_id", F.col(f"read.{at}").alias(at), "id").withWatermark(at, late)
    return found.groupBy(F.window(at, late), "read_id", "id").agg(F.count("*").alias("hits")).where(F.col("hits") >= least).select("read_id", "id", "hits")
