import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.llm.exact_spans import SuffixAutomaton, _least_places, match_shard, shared_bases, shared_classes, shared_pairs, without_reference, without_shared

ROWS = "id string, s string"


def brute(rows, least):
    """Pairs and shared letters by way of the set of windows of each row."""
    windows, where = {}, {}
    for ident, s in {(i, s) for i, s in rows if i is not None and s is not None}:
        s = s.upper()
        for k in range(len(s) - least + 1):
            w = s[k : k + least]
            if set(w) <= set("ACGT"):
                windows.setdefault(w, set()).add(ident)
                where.setdefault((ident, s), []).append((k, w))
    pairs = {(a, b) for ids in windows.values() for a in ids for b in ids if a < b}
    shared = {}
    for (ident, _), places in where.items():
        covered = {k + j for k, w in places if len(windows[w]) > 1 for j in range(least)}
        shared[ident] = shared.get(ident, 0) + len(covered)
    return pairs, shared


def made(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    common = [text(rng.randrange(38, 90)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [text(rng.randrange(0, 60)), rng.choice(["", "A" * 39, "N" * 50, "AC" * 30, *common, rng.choice(common)[3:-2]])]
        s = "".join(parts)
        rows.append((f"n{i}", s.lower() if i % 5 == 0 else s))
    return rows + rows[:5]


def test_pairs_and_bases_as_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        pairs, shared = brute(rows, 40)
        df = spark.createDataFrame(rows, ROWS).repartition(3)
        assert {(r[0], r[1]) for r in shared_pairs(df, "id", "s", 40, 20).collect()} == pairs
        assert pairs
        assert {r["id"]: r["shared"] for r in shared_bases(df, "id", "s", 40, 20).collect() if r["shared"]} == {i: n for i, n in shared.items() if n}


def test_crowded_seed(spark, monkeypatch):
    import strandlake.llm.exact_spans as module

    monkeypatch.setattr(module, "CROWD", 4)
    rng = random.Random(9)
    core = "".join(rng.choice("ACGT") for _ in range(45))
    rows = [(f"n{i:02}", "".join(rng.choice("ACGT") for _ in range(20)) + core[i % 4 :] + "".join(rng.choice("ACGT") for _ in range(20))) for i in range(30)]
    pairs, shared = brute(rows, 40)
    df = spark.createDataFrame(rows, ROWS)
    assert {(r[0], r[1]) for r in shared_pairs(df, "id", "s", 40, 20).collect()} == pairs
    assert {r["id"]: r["shared"] for r in shared_bases(df, "id", "s", 40, 20).collect()} == shared


def test_odd_rows(spark):
    s = "ACGTTGCAAC" * 6
    rows = [("a", s), ("a", s), ("b", s.lower()), (None, s), ("c", None), ("d", ""), ("e", "ACG"), ("f", "N" * 200), ("g", s + "x" + s), ("h", "é" * 50)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("doc", "owner", "text", "key", "keys")})
    assert sorted(tuple(r) for r in shared_pairs(df, "id", "s", 40, 20).collect()) == [("a", "b"), ("a", "g"), ("b", "g")]
    assert {r["id"]: r["shared"] for r in shared_bases(df, "id", "s", 40, 20).collect()} == {"a": 60, "b": 60, "d": 0, "e": 0, "f": 0, "g": 120, "h": 0}


def test_empty(spark):
    assert shared_pairs(spark.createDataFrame([], ROWS), "id", "s").collect() == []
    assert shared_bases(spark.createDataFrame([], ROWS), "id", "s").collect() == []


def test_repeat_within_one_record_is_not_shared(spark):
    s = "ACGTTGCAACGGTACCATTGACCGTTAGCCATGCATTACGGA"
    df = spark.createDataFrame([("a", s + "N" + s), ("b", "A" * 100)], ROWS)
    assert shared_pairs(df, "id", "s", 40, 20).collect() == []
    assert {r["shared"] for r in shared_bases(df, "id", "s", 40, 20).collect()} == {0}


def test_a_sequence_longer_than_a_chunk(spark, monkeypatch):
    import strandlake.llm.exact_spans as module

    monkeypatch.setattr(module, "CHUNK", 256)
    rng = random.Random(11)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    scan = module.Scanner(40, 20)
    import pyarrow as pa

    texts = pa.array([long, long[200:300], "ACG", long[500:620] + "N" + long[10:60]])
    seen = {}
    for record, start, seed, place, whole in scan.windows(texts, True):
        for r, k, h, p, w in zip(record, start, seed, place, whole):
            assert k <= p <= k + 20
            seen[int(r), int(k)] = (int(h), int(w))
    assert {k for r, k in seen if r == 0} == set(range(2961))
    assert all(seen[1, k] == seen[0, 200 + k] for k in range(61))
    assert {k for r, k in seen if r == 3} == {*range(81), *range(121, 132)}
    assert all(seen[3, 121 + k] == seen[0, 10 + k] for k in range(11))


def test_automaton_finds_longest_matches():
    rng = random.Random(8)
    code = lambda n: bytes(rng.randrange(4) for _ in range(n))
    texts = [code(60) for _ in range(5)]
    automaton = SuffixAutomaton(texts)
    query = code(20) + texts[2][10:40] + code(10) + texts[4][:25]
    ends = {e for e, _ in automaton.statistics(query, 12)}
    assert ends == {e for e in range(12, len(query) + 1) if any(query[e - 12 : e] in t for t in texts)}


def test_match_shard_of_one_owner_gives_nothing():
    text = bytes(i % 4 for i in range(50))
    assert list(match_shard([(1, text, 7, 7)], 40)) == []
    assert list(match_shard([(1, text, 7, 7), (2, text[:45], 7, 7)], 40)) == []


def test_classes_and_links_give_the_pairs(spark):
    rows = made(4)
    pairs, _ = brute(rows, 40)
    members, links = shared_classes(spark.createDataFrame(rows, ROWS), "id", "s", 40, 20)
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], set()).add(r["ident"])
    found = {(min(x, y), max(x, y)) for r in links.collect() for x in of[r["a"]] for y in of[r["b"]] if x != y}
    assert found == pairs


def covered(s, texts, least):
    """Places of s in stretches of at least ``least`` letters that stand in one of the texts."""
    out = set()
    for k in range(len(s) - least + 1):
        w = s[k : k + least]
        if set(w) <= set("ACGT") and any(w in t for t in texts):
            out.update(range(k, k + least))
    return out


def test_removal_of_shared_stretches(spark):
    rows = made(5)
    distinct = {(i, "".join(c if c in "ACGT" else "N" for c in s.upper())) for i, s in rows}
    expected = []
    for ident, s in distinct:
        gone = covered(s, [t for j, t in distinct if j != ident], 40)
        expected.append((ident, "".join(c for k, c in enumerate(s) if k not in gone), len(gone)))
    found = without_shared(spark.createDataFrame(rows, ROWS), "id", "s", 40, 20).collect()
    assert sorted((r["id"], r["s"], r["removed"]) for r in found) == sorted(expected)
    assert any(n for *_, n in expected)


def test_streaming_past_a_broadcast_reference(spark, monkeypatch):
    import strandlake.llm.exact_spans as module

    monkeypatch.setattr(module, "SHARD_LETTERS", 150)
    rng = random.Random(12)
    text = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    reference = [text(400), text(90).lower() + "N" + text(60), "AC" * 40, ""]
    upper = [r.upper() for r in reference]
    rows = [(f"n{i}", text(30) + upper[0][i * 7 : i * 7 + 25 + i] + text(20) + upper[1][80 - i : 100] + "ACAC" * (i % 15) + "N" + upper[0][:120]) for i in range(40)] + [("none", None), ("empty", ""), (None, upper[0])]
    found = {r["id"]: (r["s"], r["removed"]) for r in without_reference(spark.createDataFrame(rows, ROWS), "id", "s", reference, 30).collect()}
    for ident, s in rows:
        if ident is not None and s is not None:
            gone = covered(s, upper, 30)
            assert found[ident] == ("".join(c for k, c in enumerate(s) if k not in gone), len(gone))
    long = [("x", text(3000) + upper[0] + text(2500))]
    assert without_reference(spark.createDataFrame(long, ROWS), "id", "s", reference, 30).first()["removed"] >= 400
    assert without_reference(spark.createDataFrame(rows, ROWS), "id", "s", [], 30).where("removed > 0").count() == 0


def test_least_places():
    import numpy as np

    rng = np.random.default_rng(3)
    for span in (1, 2, 3, 7, 8, 21, 57):
        values = rng.integers(0, 9, 200).astype(np.uint64)
        assert _least_places(values, span).tolist() == [k + int(values[k : k + span].argmin()) for k in range(200 - span + 1)]


def test_scanning_takes_little_memory():
    from strandlake.llm.exact_spans import Scanner

    dice = random.Random(4)
    text = pa.array(["".join(dice.choices("ACGT", k=1000))] * 3000)
    tracemalloc.start()
    windows = sum(len(w[0]) for w in Scanner(120, 64).windows(text, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == 3000 * 881
    assert peak < 100_000_000
