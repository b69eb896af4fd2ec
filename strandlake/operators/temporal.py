"""Time-stamped annotations: windows of time, latest values, bins and sessions. Each works on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(events: DataFrame, anchor: Column, days: int = 30, node: str | None = None) -> DataFrame:
    """Events of the ``days`` before the anchor (which is included), newest first in ties of time by type."""
    rows = events.where((F.col("ts") > anchor - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= anchor))
    return rows if node is None else rows.where(F.col("node_id") == node)


def latest(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """The newest value of each (node_id, annotation_type): value, ts; of equal times the largest ``tie``."""
    top = F.max(F.struct("ts", tie, "value")).alias("t")
    return events.groupBy("node_id", "annotation_type").agg(top).select("node_id", "annotation_type", "t.value", "t.ts")


def annotation_map(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """node_id and annotations, a map from type to its newest {value, ts}."""
    entries = F.array_sort(F.collect_list(F.struct("annotation_type", F.struct("value", "ts"))))
    return latest(events, tie).groupBy("node_id").agg(F.map_from_entries(entries).alias("annotations"))


def annotation(events: DataFrame, node: str, kind: str, value: str, ts: str, tags: list[str] | None = None) -> DataFrame:
    """Rows as time-stamped annotations, ready to be appended (sinks.exports.append_rows): node_id, annotation_type, value, ts, and meta, the tags as JSON."""
    meta = F.to_json(F.struct(*tags)) if tags else F.lit(None).cast("string")
    return events.select(F.col(node).alias("node_id"), F.col(kind).alias("annotation_type"), F.col(value).cast("double").alias("value"), F.col(ts).alias("ts"), meta.alias("meta"))


def merge_maps(old: Column, new: Column) -> Column:
    """Both maps' entries; those of ``new`` win. Null counts as empty."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums per type and window; with ``late``, for streams, a watermark of that delay."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width), "annotation_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "annotation_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width, step), "annotation_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "annotation_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str | None = None) -> DataFrame:
    """Sessions per node: a pause of ``gap`` or more starts a new one."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.session_window("ts", gap), "node_id").agg(F.count("*").alias("n"))
    return out.select("node_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
