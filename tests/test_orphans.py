import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandlake.operators.orphans import DEATHS, PARENTS, REFS, OrphanTracker, parents, references

T0 = datetime(2024, 1, 1)


def day(k):
    return T0 + timedelta(days=k)


def brute(refs, born):
    return {
        (t, i, p, f"{at:%Y-%m}" if at else None)
        for t, i, p, key, at in refs
        if at is None or not any(k == key and a <= at and (b is None or b > at) for k, a, b in born)
    }


def made(seed):
    rng = random.Random(seed)
    born = [(f"node:N{rng.randrange(25)}", day(rng.randrange(300)), rng.choice([None, day(rng.randrange(300, 500))])) for _ in range(40)]
    refs = [("edge", f"e{i}", 0, "node:N1" if rng.random() < 0.4 else f"node:N{rng.randrange(30)}", day(rng.randrange(500))) for i in range(250)]
    return refs + refs[:20] + [("edge", "null", 0, "node:N1", None)], born + born[:5]


def opened(tracker):
    return {tuple(r) for r in tracker.open().collect()}


def test_batches_in_any_order_give_the_same(spark):
    refs, born = made(1)
    expected = brute(refs, born)
    ref_df = lambda rows: spark.createDataFrame(rows, REFS)
    born_df = lambda rows: spark.createDataFrame(rows, PARENTS)
    assert opened(OrphanTracker(spark).advance(ref_df(refs), born_df(born))) == expected
    late = OrphanTracker(spark).advance(ref_df(refs[:150])).advance(None, born_df(born[:30])).advance(ref_df(refs[150:]), born_df(born[30:])).advance(ref_df([]), born_df([]))
    assert opened(late) == expected
    snapshot = {(r["ref_table"], r["period"]): (r["n_refs"], r["n_orphans"]) for r in late.snapshot().collect()}
    for (_, period), (n, lost) in snapshot.items():
        assert n == len({i for t, i, p, k, at in refs if (f"{at:%Y-%m}" if at else None) == period})
        assert lost == len([x for x in expected if x[3] == period])


def test_deletion_reopens_and_arrival_resolves(spark):
    refs = spark.createDataFrame([("edge", "e1", 0, "node:A", day(10)), ("edge", "e2", 0, "node:A", day(30))], REFS)
    tracker = OrphanTracker(spark).advance(refs)
    assert len(opened(tracker)) == 2
    tracker.advance(born=spark.createDataFrame([("node:A", day(5), None)], PARENTS))
    assert opened(tracker) == set()
    tracker.advance(deleted=spark.createDataFrame([("node:A", day(20)), ("node:B", day(1))], "key string, died timestamp"))
    assert opened(tracker) == {("edge", "e2", 0, "2024-01")}


def test_spellings_and_odd_rows(spark):
    rows = [("p1", [" n1\t", "N2", None, "", " \t", "n1"], day(3)), ("p2", [], day(3)), ("p3", None, day(3)), ("p1", [" n1\t", "N2", None, "", " \t", "n1"], day(3))]
    df = spark.createDataFrame(rows, "id string, nodes array<string>, at timestamp").withColumns({c: F.lit(1) for c in ("key", "target", "ref_pos", "one")})
    node = spark.createDataFrame([("n1 ", day(1), None), ("n2", day(4), None), (" ", day(1), None), (None, day(1), None), ("n9", None, None)], "id string, born timestamp, died timestamp")
    tracker = OrphanTracker(spark).advance(references(df, "path", "id", "nodes", "at", "node"), parents(node, "id", "born", "died", "node"))
    assert opened(tracker) == {("path", "p1", 1, "2024-01")}


def test_nothing(spark):
    assert opened(OrphanTracker(spark)) == set()
    assert opened(OrphanTracker(spark).advance(spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS))) == set()


def test_deletions_as_events_give_the_same_as_rows_that_know_their_end(spark):
    refs, born = made(2)
    expected = brute(refs, born)
    births = [(k, a, None) for k, a, _ in born]
    deaths = [(k, a, b) for k, a, b in born if b is not None]
    ref_df, born_df, death_df = (lambda rows, s=s: spark.createDataFrame(rows, s) for s in (REFS, PARENTS, DEATHS))
    seen = OrphanTracker(spark).advance(ref_df(refs[:120]), born_df(births[:20]), death_df(deaths[:5]))
    seen.advance(deleted=death_df(deaths[10:])).advance(ref_df(refs[120:]), born_df(births[20:])).advance(deleted=death_df(deaths[5:10]))
    assert opened(seen) == expected
    last = {(r["ref_table"], r["period"]): r["n_orphans"] for r in seen.history().where("batch = 3").collect()}
    assert last == {("edge", p): len([x for x in expected if x[3] == p]) for p in {x[3] for x in expected}}
    assert seen.history().select("batch").distinct().count() == 4


def test_staged_batches(spark):
    refs, born = made(3)
    numbered = lambda rows, schema: spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows)], f"{schema}, batch int")
    deaths = [(k, a, b) for k, a, b in born if b is not None]
    tracker = OrphanTracker(spark).stage(numbered(refs, REFS), numbered([(k, a, None) for k, a, _ in born], PARENTS), numbered(deaths, DEATHS))
    for batch in range(4):
        tracker.take(batch)
    assert opened(tracker) == brute(refs, born)


def test_restart_goes_on_and_a_replayed_batch_is_passed_over(spark, tmp_path):
    refs, born = made(4)
    state = f"file://{tmp_path}/state"
    first = OrphanTracker(spark, state).advance(spark.createDataFrame(refs[:150], REFS), spark.createDataFrame(born[:20], PARENTS), batch=0)
    before = opened(first)
    again = OrphanTracker(spark, state)
    assert opened(again) == before and again.done == [0]
    again.advance(spark.createDataFrame(refs, REFS), batch=0)
    assert opened(again) == before
    again.advance(spark.createDataFrame(refs[150:], REFS), spark.createDataFrame(born[20:], PARENTS), batch=1)
    assert opened(OrphanTracker(spark, state)) == brute(refs, born)


def test_an_unfinished_batch_is_taken_anew(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    tracker = OrphanTracker(spark, state)
    spark.createDataFrame([("edge", "half", 0, "node:A", day(1))], REFS).write.parquet(f"{state}/refs/batch=0")  # as if the driver had died here
    tracker = OrphanTracker(spark, state)
    assert opened(tracker) == set()
    tracker.advance(spark.createDataFrame([("edge", "whole", 0, "node:A", day(1))], REFS), batch=0)
    assert opened(tracker) == {("edge", "whole", 0, "2024-01")}
