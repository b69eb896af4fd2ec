from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandlake.operators import temporal
from strandlake.operators.kmers import kmers
from strandlake.operators.orphans import PARENTS, REFS, OrphanTracker
from strandlake.streaming import annotations as stream

EVENTS = "event_id bigint, node_id string, annotation_type string, value double, ts timestamp"
T0 = datetime(2024, 1, 1)


def rows(n=60):
    return [(i, f"n{i % 3}", "ab"[i % 2], float(i), T0 + timedelta(minutes=37 * i)) for i in range(n)]


def write(spark, path, data, parts=3):
    for i in range(parts):
        chunk = data[i * len(data) // parts : (i + 1) * len(data) // parts]
        spark.createDataFrame(chunk, EVENTS).coalesce(1).write.mode("append").parquet(str(path))


def drain(query, spark, name):
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_match_batches(spark, tmp_path):
    write(spark, tmp_path / "in", rows())
    batch = spark.read.schema(EVENTS).parquet(str(tmp_path / "in"))
    events = stream.read(spark, str(tmp_path / "in"), EVENTS)
    query = stream.start(stream.latest(events), "complete", "memory", str(tmp_path / "c1"), "latest_values")
    assert sorted(map(str, drain(query, spark, "latest_values").collect())) == sorted(map(str, temporal.latest(batch).collect()))
    query = stream.start(temporal.tumbling(events), "complete", "memory", str(tmp_path / "c2"), "per_day")
    assert sorted(map(str, drain(query, spark, "per_day").collect())) == sorted(map(str, temporal.tumbling(batch).collect()))


def test_watermarked_windows_and_distinct(spark, tmp_path):
    data = rows()
    write(spark, tmp_path / "in", data + data[-5:])
    events = stream.read(spark, str(tmp_path / "in"), EVENTS)
    query = stream.start(stream.distinct_events(events), "append", "memory", str(tmp_path / "c1"), "distinct_rows")
    assert drain(query, spark, "distinct_rows").count() == len(data)
    query = stream.start(stream.tumbling(events), "append", "memory", str(tmp_path / "c2"), "closed_days")
    assert drain(query, spark, "closed_days").agg(F.max("window_start")).first()[0] < T0 + timedelta(days=2)
    query = stream.start(stream.sessions(events, "30 minutes"), "append", "memory", str(tmp_path / "c3"), "closed_sessions")
    assert drain(query, spark, "closed_sessions").count() > 0


def test_reads_against_a_static_index(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "ACGTTGCAACGGTTAACC"), ("n2", "TTTTTTTTTTTTTTTTTT")], "id string, sequence string")
    spark.createDataFrame([("r1", "CGTTGCAACGG")], "read_id string, sequence string").write.parquet(str(tmp_path / "reads"))
    reads = stream.read(spark, str(tmp_path / "reads"), "read_id string, sequence string")
    query = stream.start(stream.map_read_stream(reads, kmers(nodes, "id", "sequence", 7), 7, 3), "complete", "memory", str(tmp_path / "c"), "mapped_reads")
    assert [tuple(r) for r in drain(query, spark, "mapped_reads").collect()] == [("r1", "n1", 5)]


def test_orphans_from_a_stream(spark, tmp_path):
    tracker = OrphanTracker(spark).advance(born=spark.createDataFrame([("node:A", T0, None)], PARENTS))
    spark.createDataFrame([("edge", "e1", 0, "node:A", T0), ("edge", "e2", 0, "node:B", T0)], REFS).write.parquet(str(tmp_path / "refs"))
    stream.track_orphans(stream.read(spark, str(tmp_path / "refs"), REFS), tracker, str(tmp_path / "c")).awaitTermination(120)
    assert [r["ref_id"] for r in tracker.open().collect()] == ["e2"]


def test_orphan_events_survive_a_restart(spark, tmp_path):
    schema = f"{REFS}, live_from timestamp, live_to timestamp, died timestamp, kind string"
    none = (None,) * 3
    ref = lambda i, key, hours: ("edge", i, 0, key, T0 + timedelta(hours=hours), *none, "ref")
    birth = lambda key: (None, None, None, key, None, T0, None, None, "birth")
    death = lambda key, hours: (None, None, None, key, None, T0, None, T0 + timedelta(hours=hours), "death")
    run = lambda tracker: stream.track_orphans(stream.read(spark, str(tmp_path / "in"), schema), tracker, str(tmp_path / "c")).awaitTermination(120)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = f"file://{tmp_path}/state"
    put([ref("e1", "node:A", 1), ref("e2", "node:A", 9), ref("e3", "node:B", 1)])
    run(OrphanTracker(spark, state))
    put([birth("node:A"), birth("node:B")])
    put([death("node:A", 5)])
    run(OrphanTracker(spark, state))
    assert [r["ref_id"] for r in OrphanTracker(spark, state).open().collect()] == ["e2"]


def test_read_stream_with_a_watermark_forgets(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "ACGTTGCAACGGTTAACC")], "id string, sequence string")
    for i, hours in enumerate((0, 5, 9)):
        spark.createDataFrame([(f"r{i}", "CGTTGCAACGG", T0 + timedelta(hours=hours))], "read_id string, sequence string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    reads = stream.read(spark, str(tmp_path / "reads"), "read_id string, sequence string, at timestamp")
    query = stream.start(stream.map_read_stream(reads, kmers(nodes, "id", "sequence", 7), 7, 3, at="at"), "append", "memory", str(tmp_path / "c"), "closed_reads")
    assert {tuple(r) for r in drain(query, spark, "closed_reads").collect()} <= {(f"r{i}", "n1", 5) for i in range(3)} and spark.table("closed_reads").count() >= 1
