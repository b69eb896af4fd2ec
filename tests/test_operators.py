import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.text import kmer_code
from strandlake.operators import annotate, association, embed, graph, intervals, kmers, popgen, regions, rnaseq, temporal

EDGES = "edge_id string, from_node string, to_node string, edge_type string, frequency double, recombination_rate double"


def test_interval_joins_as_nested_loops(spark):
    rng = random.Random(1)
    left = [(rng.randrange(3), i, s := rng.randrange(3000), s + rng.randrange(400)) for i in range(80)]
    right = [(rng.randrange(3), i, s := rng.randrange(3000), s + rng.randrange(90)) for i in range(120)] + [(0, 999, 50, None), (0, 998, 60, 10)]
    a, b = spark.createDataFrame(left, "k int, a int, ls bigint, le bigint"), spark.createDataFrame(right, "k int, b int, rs bigint, re bigint")
    whole = [r for r in right if r[3] is not None and r[3] >= r[2]]
    pairs = lambda test: sorted((x[1], y[1]) for x in left for y in whole if x[0] == y[0] and test(x, y))
    got = lambda df: sorted((r["a"], r["b"]) for r in df.collect())
    over = intervals.overlap_join(a, b, "k", ("ls", "le"), ("rs", "re"), width=100)
    assert got(over) == pairs(lambda x, y: x[2] <= y[3] and x[3] >= y[2])
    assert all(r["overlap_length"] == min(r["le"], r["re"]) - max(r["ls"], r["rs"]) + 1 for r in over.collect())
    half = intervals.overlap_join(a, b, "k", ("ls", "le"), ("rs", "re"), width=64, half_open=True)
    assert got(half) == pairs(lambda x, y: max(x[2], y[2]) < min(x[3], y[3]))
    assert got(intervals.containment_join(a, b, "k", ("ls", "le"), ("rs", "re"), width=77)) == pairs(lambda x, y: y[2] >= x[2] and y[3] <= x[3])
    assert got(intervals.distance_join(a, b.where("b < 900"), "k", "ls", "rs", 50)) == pairs(lambda x, y: abs(x[2] - y[2]) < 50)
    assert got(intervals.distance_join(a, b.where("b < 900"), "k", "ls", "rs", 50, closed=True)) == pairs(lambda x, y: abs(x[2] - y[2]) <= 50)
    assert "NestedLoop" not in over._jdf.queryExecution().executedPlan().toString()


def graph_rows(seed, n=14, m=45):
    rng = random.Random(seed)
    return [(f"e{i}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["linear", "inversion"]), rng.choice([0.001, 0.4, 0.9]), None) for i in range(m)]


def bfs(rows, source, target, hops, keep):
    level = {source: (source,)}
    seen = {source}
    for _ in range(hops + 1):
        if target in level:
            return list(level[target])
        nxt = {}
        for node, path in level.items():
            for _, a, b, kind, f, _ in rows:
                if a == node and keep(kind, f) and b not in seen:
                    nxt[b] = min(nxt.get(b, (*path, b)), (*path, b))
        seen |= set(nxt)
        level = nxt
    return None


def test_shortest_paths_as_breadth_first_search(spark):
    rows = graph_rows(5)
    routes = [(f"{s}>{t}", f"n{s}", f"n{t}") for s in range(6) for t in range(6)]
    found = graph.shortest_paths(spark.createDataFrame(rows, EDGES), spark.createDataFrame(routes, "route string, source string, target string"), 4, F.col("frequency") > 0.01)
    got = {r["route"]: list(r["path"]) for r in found.collect()}
    expected = {r: p for r, s, t in routes if (p := bfs(rows, s, t, 4, lambda k, f: f > 0.01))}
    assert got == expected


def test_trails_hubs_and_rare_paths(spark):
    rows = graph_rows(7, 6, 16) + [("loop", "n1", "n1", "linear", 0.9, None)]
    df = spark.createDataFrame(rows, EDGES)
    two = [(a, b) for a in rows for b in rows if a[2] == b[1] and a[0] != b[0]]
    three = [(a, b, c) for a, b in two for c in rows if b[2] == c[1] and c[0] not in (a[0], b[0])]
    assert {r["hops"]: r["trails"] for r in graph.trail_counts(df).collect()} == {1: len(rows), 2: len(two), 3: len(three)}
    nodes = spark.createDataFrame([(f"n{i}", i / 10) for i in range(6)], "id string, frequency double")
    rare = {"n0", "n1", "n2"}
    assert graph.rare_paths(nodes, df, 0.25, 2).count() == sum({a[1], a[2], b[2]} <= rare for a, b in two)
    assert [r["out_degree"] for r in graph.hubs(df, 2).collect()] == sorted((n for n in (sum(r[1] == f"n{i}" for r in rows) for i in range(6)) if n > 2), reverse=True)


def test_linear_edges_and_diploid_routes(spark):
    nodes = [(f"a{i}", "I", "s", 1, 0, 0, i * 100, i * 100 + (100 if i != 2 else 50), 0.9) for i in range(6)]
    df = spark.createDataFrame(nodes, "id string, individual_id string, assembly_source string, chromosome int, haplotype int, scale_level int, start_pos bigint, end_pos bigint, frequency double")
    made = graph.linear_edges(df, 20)
    assert sorted((r["from_id"], r["to_id"], r["distance"]) for r in made.collect()) == [("a0", "a1", 0), ("a1", "a2", 0), ("a3", "a4", 0), ("a4", "a5", 0)]
    edges = spark.createDataFrame([(f"e{i}", f"a{i}", f"a{i + 1}", "linear", 0.5, None) for i in range(5)] + [("x", "a1", "b", "inversion", 0.3, 0.1), ("y", "b", "a3", "linear", 0.3, None)], EDGES)
    routes = {r["haplotype"]: (r["path"], r["score"]) for r in graph.diploid_routes(df, edges, 1, 0, 590, around=10).collect()}
    assert routes["maternal"][0] == [f"a{i}" for i in range(6)]
    assert set(routes) == {"maternal"}  # the paternal route would need the maternal one's inner nodes
    wide = edges.unionByName(spark.createDataFrame([("z", "a0", "b", "inversion", 0.3, 0.1), ("w", "b", "a5", "linear", 0.3, None)], EDGES))
    routes = {r["haplotype"]: (r["path"], r["score"]) for r in graph.diploid_routes(df, wide, 1, 0, 590, around=10).collect()}
    assert routes["paternal"][0] == ["a0", "b", "a5"] and routes["paternal"][1] == pytest.approx(0.3 * 1.1 * 0.3)


def test_mapping_and_alignment_as_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", text(120)) for i in range(6)]
    reads = []
    for i in range(25):
        s = list(targets[i % 6][1][(k := rng.randrange(60)) : k + 50])
        for _ in range(i % 5):
            s[rng.randrange(50)] = rng.choice("ACGT")
        reads.append((f"r{i}", "".join(s)))
    reads += [("short", "ACG"), ("none", text(50))]
    k = 11
    got = {(r["read_id"], r["transcript_id"]): (r["start"], r["mismatches"], r["is_unique"]) for r in kmers.align(spark.createDataFrame(reads, "read_id string, sequence string"), spark.createDataFrame(targets, "transcript_id string, sequence string"), k=k).collect()}
    expected = {}
    for rid, r in reads:
        for tid, t in targets:
            words = {t[i : i + k] for i in range(len(t) - k + 1)}
            hits = sum(r[i : i + k] in words for i in range(len(r) - k + 1))
            if hits >= kmers.candidate_threshold(len(r), k):
                best = min((sum(a != b for a, b in zip(r, t[s:])), s) for s in range(len(t) - len(r) + 1))
                if best[0] <= 3 and 1 - best[0] / len(r) >= 0.8:
                    expected[rid, tid] = (best[1], best[0])
    assert {key: v[:2] for key, v in got.items()} == expected and expected
    assert all(v[2] == (sum(key[0] == other[0] for other in got) == 1) for key, v in got.items())
    nodes = spark.createDataFrame(targets, "id string, sequence string")
    mapped = kmers.map_reads(spark.createDataFrame([("r", targets[2][1][:100]), ("n", "N" * 90)], "read_id string, sequence string"), nodes, k, 5, 0.5)
    assert [(r["read_id"], r["id"], r["rank"]) for r in mapped.collect()] == [("r", "t2", 1)]
    report = kmers.mapping_report(spark.createDataFrame([("r",), ("n",)], "read_id string"), mapped).first()
    assert report["mapped_reads"] == 1 and report["mapping_rate"] == 0.5


def test_population_measures_as_matrices(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    haps = [(f"I{i}", h, "ABC"[i % 3]) for i in range(9) for h in (0, 1)]
    matrix = (rng.random((18, 30)) < rng.random(30)).astype(int)
    matrix[:, 0] = 1
    rows = [(f"{p}_h{h}", p, h, str(s), pop) for (p, h, pop), line in zip(haps, matrix) for s in np.flatnonzero(line)]
    present = spark.createDataFrame(rows, "hap string, individual_id string, haplotype int, site string, population string")
    got = {r["population"]: r for r in popgen.metrics(present, "population").collect()}
    for pop in "ABC":
        m = matrix[[x[2] == pop for x in haps]]
        m = m[:, m.any(axis=0)]
        p, n = m.mean(axis=0), len(m)
        seg = (m.any(axis=0) & ~m.all(axis=0)).sum()
        pi = np.mean([(m[i] != m[j]).sum() for i in range(n) for j in range(i + 1, n)])
        a1 = sum(1 / i for i in range(1, n))
        assert got[pop]["population_size"] == n and got[pop]["expected_het"] == pytest.approx((2 * p * (1 - p)).mean())
        assert got[pop]["tajimas_d"] == pytest.approx((pi - seg / a1) / np.sqrt(seg / a1))
        assert got[pop]["observed_het"] == pytest.approx(np.mean([(m[i] != m[i + 1]).mean() for i in range(0, n, 2)]))
    distances = {(r["hap_a"], r["hap_b"]): r["distance"] for r in popgen.hamming(present.drop("population")).collect()}
    names = [f"{p}_h{h}" for p, h, _ in haps]
    assert distances == pytest.approx({(names[i], names[j]): (matrix[i] != matrix[j]).mean() * 30 / matrix.any(axis=0).sum() for i in range(18) for j in range(18) if names[i] < names[j]})
    assert {r["site"] for r in popgen.specific(present, "population", "A").collect()} == {str(s) for s in range(30) if matrix[[x[2] == "A" for x in haps], s].any() and not matrix[[x[2] != "A" for x in haps], s].any()}


def test_gwas_perfect_split(spark):
    dose = spark.createDataFrame([("HG002", "s", 1), ("HG00096", "s", 2), ("HG002", "all", 1), ("HG00096", "all", 1), ("HG00733", "all", 1), ("HG00097", "all", 1)], "individual_id string, site string, dosage int")
    people = spark.createDataFrame([("HG002", True), ("HG00096", True), ("HG00733", False), ("HG00097", False)], "individual_id string, is_case boolean")
    rows = association.with_pvalues(association.gwas(dose, people)).collect()
    assert len(rows) == 1 and rows[0]["chi2"] == pytest.approx(1.0) and rows[0]["odds_ratio"] == 25 and rows[0]["pvalue"] == pytest.approx(0.317310508)
    assert association.genomic_inflation(association.with_pvalues(association.gwas(dose.limit(0), people))).first()[0] == 1.0


def test_eqtl_as_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 20)
    y = 2.0 * x + rng.normal(size=20)
    geno = spark.createDataFrame([(f"I{i}", "s", int(v)) for i, v in enumerate(x) if v], "individual_id string, site string, dosage int")
    expr = spark.createDataFrame([(f"I{i}", "g", float(v)) for i, v in enumerate(y)] + [("I99", "g", float("nan")), ("I98", "g", None)], "individual_id string, gene_id string, level double")
    cis = spark.createDataFrame([("g", "s")], "gene_id string, site string")
    row = association.eqtl(geno, expr, cis).first()
    slope, _ = np.polyfit(x, y, 1)
    assert row["n"] == 20 and row["slope"] == pytest.approx(slope) and row["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2) and row["direction"] == "positive"
    assert association.eqtl_significant(association.eqtl(geno, expr, cis)).first()["qvalue"] < 0.05


def em(rows, iterations):
    theta = {t: 1.0 for _, t, _ in rows}
    for _ in range(iterations):
        counts = dict.fromkeys(theta, 0.0)
        for r, t, s in rows:
            total = sum(theta[b] * c for a, b, c in rows if a == r)
            counts[t] += theta[t] * s / total
        all_ = sum(counts.values())
        theta = {t: c / all_ for t, c in counts.items()}
    return theta


def test_quantification(spark):
    rows = [("r1", "t1", 0.9), ("r2", "t1", 0.9), ("r2", "t2", 0.8), ("r3", "t2", 1.0), ("r4", "t3", 0.7), ("r4", "t1", 0.9), ("r5", "t1", 0.8)]
    table = [(f"a{i}", r, t, "g", s, sum(x[0] == r for x in rows) == 1) for i, (r, t, s) in enumerate(rows)]
    df = spark.createDataFrame(table, "alignment_id string, read_id string, transcript_id string, gene_id string, alignment_score double, is_unique boolean")
    got = {r["transcript_id"]: r["theta"] for r in rnaseq.em_shares(df, 4, unrolled=2).collect()}
    assert got == pytest.approx(em(rows, 4)) and sum(got.values()) == pytest.approx(1)
    assert {r["transcript_id"]: r["theta"] for r in rnaseq.unique_shares(df).collect()} == pytest.approx({"t1": 2 / 3, "t2": 1 / 3})
    assert {r["transcript_id"]: r["theta"] for r in rnaseq.proportional_shares(df).collect()} == pytest.approx({"t1": 2 / 3 * 1.5, "t2": 1 / 3 * 1.5})
    lengths = spark.createDataFrame([("t1", 600), ("t2", 300)], "transcript_id string, length bigint")
    row = rnaseq.expression(rnaseq.unique_shares(df), df, lengths, 1000).first()
    assert row["effective_length"] == pytest.approx(500) and row["raw_counts"] == 7 and row["fpkm"] == pytest.approx(7e9 / (500 * 1000))


def test_transcripts(spark):
    nodes = spark.createDataFrame([("a", "I", 0, 1, 10, 14, 0, "ACGT"), ("b", "I", 0, 1, 16, 20, 0, "GGGG"), ("c", "I", 1, 1, 12, 14, 0, "TT"), ("d", "I", 0, 1, 50, 54, 0, "AAAA")], "id string, individual_id string, haplotype int, chromosome int, start_pos bigint, end_pos bigint, scale_level int, sequence string")
    genes = spark.createDataFrame([("g", 1, 9, 30, "+"), ("m", 1, 9, 15, "-")], "gene_id string, chromosome int, gene_start bigint, gene_end bigint, strand string")
    got = {r["transcript_id"]: r["sequence"] for r in rnaseq.build_transcripts(genes, nodes).collect()}
    assert got == {"g_I_h0": "NACGTNNGGGG", "g_I_h1": "NNNTT", "m_I_h0": "ACGTN", "m_I_h1": "AANNN"}


def test_embeddings(spark):
    paths = spark.createDataFrame([("p", ["a", "b", "x"]), ("q", ["x"])], "path_id string, path_nodes array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0])], "id string, features array<double>")
    got = {r["path_id"]: list(r["embedding"]) for r in embed.path_embedding(paths, vectors, 6).collect()}
    assert got == {"p": [2.0, 4.0, 1.0, 2.0, 3.0, 6.0], "q": [0.0] * 6}
    other = vectors.unionByName(spark.createDataFrame([("c", [5.0, 1.0]), ("z", [0.0, 0.0])], "id string, features array<double>"))
    assert [r["id"] for r in embed.similar(other, [4.0, 1.0], "id", "features", 2).collect()] == ["c", "a"]
    points = spark.createDataFrame([(i, [float(i // 5 * 10), 1.0, float(i % 5) / 9]) for i in range(10)], "i int, v array<double>")
    groups = {}
    for r in embed.clusters(points, "i", "v", 2, 2).collect():
        groups.setdefault(r["cluster"], set()).add(r["i"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_maps_and_paths(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as x, map('b', 3, 'c', 4) as y, cast(null as map<string,int>) as n")
    row = df.select(temporal.merge_maps(F.col("x"), F.col("y")).alias("m"), temporal.merge_maps(F.col("n"), F.col("y")).alias("k")).first()
    assert row["m"] == {"a": 1, "b": 3, "c": 4} and row["k"] == {"b": 3, "c": 4}
    paths = spark.createDataFrame([("p", "I", 0, ["n3", "n1", "n2", "n1"]), ("q", "I", 1, ["z"])], "path_id string, individual_id string, haplotype int, path_nodes array<string>")
    inside = spark.createDataFrame([("n1",), ("n3",)], "id string")
    assert {r["path_id"]: list(r["nodes"]) for r in regions.restrict_paths(paths, inside).collect()} == {"p": ["n3", "n1", "n1"], "q": []}
    facts = spark.createDataFrame([("n1", "x")], "node_id string, value string")
    assert sorted(r["pos"] for r in annotate.route_annotations(paths, facts, 3).collect()) == [1]


def test_codes_are_rolled_as_kmer_code(spark):
    rng = random.Random(21)
    rows = [(f"s{i}", "".join(rng.choice("ACGTacgtN" if i % 2 else "ACGT") for _ in range(rng.randrange(0, 90)))) for i in range(40)] + [("null", None), ("long", "ACGT" * 3000), ("odd", "ACGé" * 20)]
    df = spark.createDataFrame(rows, "id string, sequence string").repartition(3)
    for k in (1, 5, 16, 31):
        plain = df.select("id", F.explode(F.sequence(F.lit(1), F.length("sequence") - k + 1)).alias("i"), F.upper("sequence").alias("s")).where(F.length("s") >= k)
        expected = plain.select("id", kmer_code(F.substring("s", F.col("i"), F.lit(k)), k).alias("kmer"), (F.col("i") - 1).cast("bigint").alias("position")).where("kmer is not null")
        found = kmers.kmers(df, "id", "sequence", k, coded=True)
        ascii_only = "id <> 'odd'" if k > 3 else "true"
        assert sorted(map(tuple, found.where(ascii_only).select("id", "kmer").collect())) == sorted(map(tuple, expected.where(ascii_only).select("id", "kmer").collect()))
        sets = {(r["id"], r["kmer"]): r["times"] for r in kmers.kmer_sets(df, "id", "sequence", k).collect()}
        assert sum(sets.values()) == expected.count() and len(sets) == expected.select("id", "kmer").distinct().count()


def test_main_components_as_svd(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    group = rng.integers(0, 3, 60)
    x = (rng.random((60, 200)) < np.array([0.1, 0.5, 0.9])[(group[:, None] + np.arange(200)) % 3]).astype(float)
    cells = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(x))], "hap int, site int")
    got = {r["hap"]: r["scores"] for r in embed.main_components(cells, "hap", "site", 3).collect()}
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    found = np.array([got[i] for i in range(60)])
    for j in range(2):
        assert abs(abs(np.corrcoef(found[:, j], u[:, j])[0, 1]) - 1) < 1e-3 and abs(np.linalg.norm(found[:, j]) / s[j] - 1) < 1e-2


def test_trails_and_best_routes_as_search(spark):
    rows = graph_rows(8, 9, 16)
    edges = spark.createDataFrame(rows, EDGES)
    ends = {e[0]: e[1:3] for e in rows}
    level, expected = [[e] for e in ends if ends[e][0] in ("n0", "n1")], []
    for _ in range(4):
        expected += level
        level = [[*t, e] for t in level for e in ends if e not in t and ends[t[-1]][1] == ends[e][0]]
    found = graph.trails_from(edges, spark.createDataFrame([("n0",), ("n1",), ("n0",)], "id string"), 4).collect()
    assert sorted(r["used"] for r in found) == sorted(expected) and all(r["hops"] == len(r["used"]) == len(r["path"]) - 1 for r in found)
    routes = spark.createDataFrame([(f"{a}>{b}", a, b) for a in ("n0", "n1") for b in ("n2", "n3", "n4")], "route string, source string, target string")
    best = graph.best_routes(edges, routes, ["linear"], top=3).collect()
    every = {r["route"]: r["score"] for r in graph.shortest_paths(edges, routes, 50, (F.col("frequency") > 0.01) & (F.col("edge_type") == "linear")).collect()}
    assert [(r["route"], r["score"]) for r in best] == sorted(every.items(), key=lambda x: (-x[1], x[0]))[:3]


def test_mapping_as_brute_force_in_repeats(spark):
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    repeat = text(60)
    nodes = [(f"n{i}", text(rng.randrange(20, 60)) + (repeat if i % 2 else "") + text(rng.randrange(0, 50)) + ("N" * 5 if i % 5 == 0 else "")) for i in range(30)]
    reads = []
    for i in range(60):
        s = rng.choice(nodes)[1]
        at = rng.randrange(0, max(1, len(s) - 60))
        cut = list(s[at : at + rng.randrange(30, 90)])
        for _ in range(rng.randrange(0, 3)):
            cut[rng.randrange(len(cut))] = rng.choice("ACGT")
        reads.append((f"r{i}", "".join(cut).lower() if i % 4 == 0 else "".join(cut)))
    reads += [("whole", nodes[1][1]), ("twice", repeat[:20] * 3), ("none", None), ("short", "ACG"), reads[3]]
    k = 11
    for least in (0.1, 0.5, 0.8):
        expected = []
        for rid, r in {x for x in reads if x[1]}:
            r, own = r.upper(), []
            for nid, n in nodes:
                held = {n[i : i + k] for i in range(len(n) - k + 1) if "N" not in n[i : i + k]}
                hits = sum(r[i : i + k] in held for i in range(len(r) - k + 1))
                score = min(1.0, (hits / max(1, len(r) - k + 1) + (0.2 if r in n else 0.0)) * min(len(r), len(n)) / max(len(r), len(n)))
                if hits >= 5 and score >= least:
                    own.append((-score, nid, hits))
            expected += [(rid, nid, hits, rank) for rank, (_, nid, hits) in enumerate(sorted(own)[:10], 1)]
        found = kmers.map_reads(spark.createDataFrame(reads, "read_id string, sequence string"), spark.createDataFrame(nodes, "id string, sequence string"), k, 5, least).collect()
        assert sorted((r["read_id"], r["id"], r["hits"], r["rank"]) for r in found) == sorted(expected) and expected
