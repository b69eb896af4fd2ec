"""Queries on small tables whose results a shortened job would lose."""

import random

from strandlake.operators import graph, popgen
from strandlake.plans import core

NODES = "id string, individual_id string, haplotype int, chromosome int, start_pos long, end_pos long, scale_level int, frequency double, variant_type string, sequence string"
EDGES = "edge_id string, from_node string, to_node string, edge_type string, frequency double, recombination_rate double"


def write(spark, folder, nodes, edges):
    spark.createDataFrame(nodes, NODES).write.parquet(f"{folder}/genome_node.parquet")
    spark.createDataFrame(edges, EDGES).write.parquet(f"{folder}/genome_edge.parquet")
    return str(folder)


def chain(names):
    return [(f"E{i}", a, b, "linear", 0.5, 0.0) for i, (a, b) in enumerate(zip(names, names[1:]))]


def test_inferred_path_of_more_than_four_edges(spark, tmp_path):
    rng = random.Random(3)
    names = [f"N{i}" for i in range(8)]
    nodes = [(n, "IND1", 0, 1, 1000 * i, 1000 * i + 319, 0, 0.5, None, "".join(rng.choice("ACGT") for _ in range(320))) for i, n in enumerate(names)]
    order = [names[0], *reversed(names[1:-1]), names[-1]]  # not the order of the nodes, which is what stands in for a missing path
    rows = core.inferred_paths(spark, write(spark, tmp_path, nodes, chain(order))).collect()
    assert [(r["route"], r["path"], r["connected"]) for r in rows] == [("IND1_h0", order, True)]


def test_shortest_routes_as_breadth_first_search(spark, tmp_path):
    rng = random.Random(5)
    names = [f"N{i:02}" for i in range(14)]
    edges = chain(names) + [(f"F{i}", "N00", f"A{i}", "linear", 0.5, 0.0) for i in range(2)] + [(f"T{i}", f"B{i}", "N13", "linear", 0.5, 0.0) for i in range(2)]
    edges += [(f"R{i}", rng.choice(names[:4]), rng.choice(names[:4]), "linear", rng.choice([0.005, 0.5]), 0.0) for i in range(8)]
    found = {r["route"]: (r["hops"], r["path"]) for r in core.shortest_route_whole(spark, write(spark, tmp_path, [], edges)).collect()}
    steps = {(a, b) for _, a, b, _, f, _ in edges if f > 0.01}
    count = lambda k: sorted((-sum(e[k] == n for e in edges), n) for n in {e[k] for e in edges})[:5]
    expected = {}
    for _, source in count(1):
        level, seen, hops = {source: [source]}, {source}, 0
        reached = {}
        while level:
            reached |= {n: (hops, p) for n, p in level.items()}
            grown = {}
            for p in sorted(level.values()):
                for _, b in sorted(x for x in steps if x[0] == p[-1]):
                    if b not in seen:
                        grown[b] = min(grown.get(b, [*p, b]), [*p, b])
            level, hops = grown, hops + 1
            seen |= set(level)
        expected |= {f"{source}>{target}": reached[target] for _, target in count(2) if target in reached}
    assert found == expected and max(h for h, _ in found.values()) > 4


def test_diploid_route_of_more_than_twenty_edges(spark):
    names = [f"N{i:02}" for i in range(23)]
    nodes = [(n, "IND1", 0, 1, 1000 * i, 1000 * i + 99, 0, 0.9, None, None) for i, n in enumerate(names)]
    rows = graph.diploid_routes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(chain(names), EDGES), 1, 0, 22_050).collect()
    assert [(r["haplotype"], r["path"]) for r in rows] == [("maternal", names)]


def test_rare_trails_of_three_to_five_edges(spark, tmp_path):
    names = [f"N{i}" for i in range(7)]
    nodes = [(n, "IND1", 0, 1, 0, 99, 0, 0.1, None, None) for n in names] + [("M", "IND1", 0, 1, 0, 99, 0, 0.9, None, None)]
    edges = [*chain(names), ("X", "N2", "N1", "linear", 0.5, 0.0), ("Y", "N6", "M", "linear", 0.5, 0.0)]
    ends = {e[0]: e[1:3] for e in edges if "M" not in e}
    expected = [[e] for e in ends]
    for length in range(2, 6):
        expected += [[*t, e] for t in expected if len(t) == length - 1 for e in ends if e not in t and ends[t[-1]][1] == ends[e][0]]
    found = core.rare_trails(spark, write(spark, tmp_path, nodes, edges)).collect()
    assert sorted(r["used"] for r in found) == sorted(t for t in expected if len(t) >= 3)
    assert all(r["path"] == [ends[r["used"][0]][0], *(ends[e][1] for e in r["used"])] for r in found)


def test_exact_sites_are_not_merged(spark, tmp_path):
    at = {"IND1": [100, 900], "IND2": [100, 5000], "IND3": [7000]}  # all within one bin of 20 kb
    nodes = [(f"{i}{p}", i, 0, 1, p, p + 9, 0, 0.5, "SNP", None) for i, places in at.items() for p in places]
    folder = write(spark, tmp_path, nodes, chain(["A", "B"]))
    found = core.QUERIES["presence_matrix_long_exact"](spark, folder).collect()
    assert sorted((r["individual_id"], r["site"]) for r in found) == sorted((i, f"1_{p}") for i, places in at.items() for p in places)
    apart = popgen.hamming(core.QUERIES["presence_matrix_long_exact"](spark, folder)).collect()
    assert {(r["hap_a"], r["hap_b"]): r["distance"] for r in apart} == {("IND1_h0", "IND2_h0"): 0.5}
    sizes = {r["hap"]: r["n"] / r["sites"] for r in popgen.hap_sites(core.QUERIES["presence_matrix_long_exact"](spark, folder)).collect()}  # pairs without a common site
    assert sizes["IND1_h0"] + sizes["IND3_h0"] == sizes["IND2_h0"] + sizes["IND3_h0"] == 0.75
