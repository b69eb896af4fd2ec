"""Edges, bounded path search and routes. A graph may have several edges between two nodes; none is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..storage import materialise, new_path
from .skew import hot_keys, salted_join


def linear_edges(nodes: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Edges to the next node of the same individual, source, chromosome, haplotype and scale, if its start is near this end."""
    in_line = Window.partitionBy("individual_id", "assembly_source", "chromosome", "haplotype", "scale_level").orderBy("start_pos", "id")
    ahead = nodes.select("id", "end_pos", F.lead("id").over(in_line).alias("to_id"), F.lead("start_pos").over(in_line).alias("_next"))
    return ahead.where(F.col("_next") <= F.col("end_pos") + max_gap).select(
        F.col("id").alias("from_id"), "to_id", F.lit("linear").alias("edge_type"), F.lit(1.0).alias("frequency"), (F.col("_next") - F.col("end_pos")).alias("distance")
    )


def variant_edges(nodes: DataFrame, variants: DataFrame, self_loops: bool = False) -> DataFrame:
    """Edges from each node within a structural variant's span to the variant's node (variants: id, chromosome, start_pos, end_pos)."""
    from .intervals import containment_join

    spans = variants.select(F.col("id").alias("to_id"), "chromosome", F.col("start_pos").alias("sv_start"), F.col("end_pos").alias("sv_end"))
    inside = containment_join(spans, nodes.select("id", "chromosome", "start_pos", "end_pos"), "chromosome", ("sv_start", "sv_end"), ("start_pos", "end_pos"))
    kept = inside if self_loops else inside.where(F.col("id") != F.col("to_id"))
    return kept.select(F.col("id").alias("from_id"), "to_id", F.lit("variant").alias("edge_type"))


def variant_node(individual: str, haplotype: int, source: str, variants: DataFrame) -> DataFrame:
    """Scale-0 nodes of structural variants (variant_type, chromosome, start_pos, end_pos, sequence, frequency), with ids sv_{type}_chr{c}_{start}_{number}.

    The number counts a variant among those of the same type and place, by their end and sequence.
    """
    same = Window.partitionBy("variant_type", "chromosome", "start_pos").orderBy("end_pos", "sequence")
    name = F.format_string("sv_%s_chr%d_%d_%d", "variant_type", "chromosome", "start_pos", F.row_number().over(same) - 1)
    return variants.select(
        name.alias("id"), F.lit(individual).alias("individual_id"), F.lit(haplotype).alias("haplotype"), F.lit(source).alias("assembly_source"), "chromosome", "start_pos", "end_pos",
        F.lit(0).alias("scale_level"), "frequency", "sequence", "variant_type",
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    first = edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi")
    return first.join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree."""
    out = edges.groupBy(F.col("from_node").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("to_node").alias("id")).agg(F.count("*").alias("in_degree"))
    return out.join(into, "id", "full").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def hubs(edges: DataFrame, above: int = 3, top: int = 20) -> DataFrame:
    return degrees(edges).where(F.col("out_degree") > above).orderBy(F.desc("out_degree"), "id").limit(top).select("id", "out_degree")


def trail_counts(edges: DataFrame) -> DataFrame:
    """How many trails (no edge twice) of 1, 2 and 3 edges the graph has: hops, trails.

    Counted from degrees, not by listing: an edge e2 from b to c is the middle of
    (edges into b other than e2) x (edges out of c other than e2) trails, less the
    choices that take one edge twice.
    """
    loops = F.sum(F.when(F.col("from_node") == F.col("to_node"), 1).otherwise(0))
    deg = degrees(edges)
    one = edges.agg(F.count("*").alias("trails")).select(F.lit(1).alias("hops"), "trails")
    two = deg.agg(F.sum(F.col("in_degree") * F.col("out_degree")).alias("pairs")).join(edges.agg(loops.alias("loops"))).select(F.lit(2).alias("hops"), (F.col("pairs") - F.col("loops")).alias("trails"))
    per_pair = edges.groupBy("from_node", "to_node").agg(F.count("*").alias("n"))
    back = per_pair.select(F.col("from_node").alias("to_node"), F.col("to_node").alias("from_node"), F.col("n").alias("n_back"))
    middle = per_pair.join(back, ["from_node", "to_node"], "left").join(deg.select(F.col("id").alias("from_node"), F.col("in_degree").alias("into")), "from_node")
    middle = middle.join(deg.select(F.col("id").alias("to_node"), F.col("out_degree").alias("out")), "to_node")
    own = F.when(F.col("from_node") == F.col("to_node"), 1).otherwise(0)
    each = (F.col("into") - own) * (F.col("out") - own) - (F.coalesce("n_back", F.lit(0)) - own)
    three = middle.agg(F.sum(F.col("n") * each).alias("trails")).select(F.lit(3).alias("hops"), "trails")
    return one.unionAll(two).unionAll(three)


def shortest_paths(edges: DataFrame, routes: DataFrame, max_hops: int = 20, keep: Column | None = None, avoid: DataFrame | None = None) -> DataFrame:
    """For each route (route, source, target) a path of fewest edges: route, path, hops, score.

    Breadth first for all routes at once: one join a level on the frontier, which
    never returns to a visited node. Of equal paths the one with the smallest list
    of node ids wins. ``keep`` filters edges, ``avoid`` (route, node) nodes, before
    the search. The score is the product of frequency x (1 + recombination rate). A route
    from a node to itself has no edges and score 1; routes without a path do not occur.
    """
    rate = F.coalesce("recombination_rate", F.lit(0.0)) if "recombination_rate" in edges.columns else F.lit(0.0)
    steps = (edges if keep is None else edges.where(keep)).select("from_node", "to_node", (F.coalesce("frequency", F.lit(0.0)) * (1 + rate)).alias("weight"))
    steps = materialise(steps.groupBy("from_node", "to_node").agg(F.max("weight").alias("weight")), "steps")
    hot = hot_keys(steps, "from_node")  # hubs: their edges are spread over many tasks
    frontier = routes.select("route", "target", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(1.0).alias("score"))
    spark, levels = edges.sparkSession, []

    def read(*paths: str) -> DataFrame:  # one scan however many levels there are, so plans stay small on the driver
        return spark.read.schema(frontier.schema).parquet(*paths)

    for _ in range(max_hops + 1):
        levels.append(new_path(spark, "frontier"))
        seen = Observation()
        frontier.observe(seen, F.count("*").alias("rows")).write.parquet(levels[-1])
        if not seen.get["rows"]:
            break
        level, at_target = read(levels[-1]), F.col("node") == F.col("target")
        frontier = level.join(level.where(at_target).select("route"), "route", "left_anti")
        met = salted_join(steps.withColumnRenamed("from_node", "node"), frontier, "node", "to_node", hot=hot)
        grown = met.select("route", "target", F.col("to_node").alias("node"), F.concat("path", F.array("to_node")).alias("path"), (F.col("score") * F.col("weight")).alias("score"))
        grown = grown.join(read(*levels).select("route", "node"), ["route", "node"], "left_anti")
        if avoid is not None:
            grown = grown.join(avoid.select("route", "node"), ["route", "node"], "left_anti")
        frontier = grown.groupBy("route", "target", "node").agg(F.min_by(F.struct("path", "score"), "path").alias("b")).select("route", "target", "node", "b.path", "b.score")
    out = read(*levels).where(F.col("node") == F.col("target"))
    return out.select("route", "path", (F.size("path") - 1).alias("hops"), "score")


def rare_paths(nodes: DataFrame, edges: DataFrame, below: float, hops: int, most: int | None = None) -> DataFrame:
    """Trails of ``hops`` to ``most`` edges (``hops`` only, by default) whose nodes all have a frequency below the limit: path, edge ids. Nodes are filtered first."""
    inside = induced(edges, nodes.where(F.col("frequency") < below)).select("edge_id", "from_node", "to_node")
    inside = materialise(inside, "rare")
    paths = inside.select(F.array("from_node", "to_node").alias("path"), F.array("edge_id").alias("used"), F.col("to_node").alias("at"))
    return reduce(DataFrame.unionByName, [t.select("path", "used") for n, t in enumerate(_trails(paths, inside, most or hops), 1) if n >= hops])


def _trails(paths: DataFrame, edges: DataFrame, most: int) -> list[DataFrame]:
    """The trails (path, used, at) of each length, from those of one edge; the edges of hubs are spread over many tasks."""
    step = edges.select("edge_id", F.col("from_node").alias("at"), F.col("to_node").alias("then"))
    hot, out = hot_keys(step, "at"), [paths]
    for _ in range(1, most):
        met = salted_join(step, paths, "at", "edge_id", on=~F.array_contains("r.used", F.col("l.edge_id")), hot=hot)
        paths = met.select(F.concat("path", F.array("then")).alias("path"), F.concat("used", F.array("edge_id")).alias("used"), F.col("then").alias("at"))
        paths = materialise(paths, "trails")  # the next length starts from these
        out.append(paths)
    return out


def trails_from(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """Trails (no edge twice) of 1 to ``most`` edges from the start nodes (id): hops, path, used. Their number can grow as degree ** most; choose few starts."""
    edges = materialise(edges.select("edge_id", "from_node", "to_node"), "edges")
    first = edges.join(starts.select(F.col("id").alias("from_node")).distinct(), "from_node", "left_semi")
    first = first.select(F.array("from_node", "to_node").alias("path"), F.array("edge_id").alias("used"), F.col("to_node").alias("at"))
    return reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("hops"), "path", "used") for n, t in enumerate(_trails(first, edges, most), 1)])


def best_routes(edges: DataFrame, routes: DataFrame, types: list[str] | None = None, max_hops: int = 50, above: float = 0.01, top: int = 10) -> DataFrame:
    """The shortest_paths() over edges of the given types and frequencies above the limit, those of the highest score first; ties by route."""
    keep = F.col("frequency") > above
    found = shortest_paths(edges, routes, max_hops, keep & F.col("edge_type").isin(types) if types else keep)
    return found.orderBy(F.desc("score"), "route").limit(top)


def anchors(nodes: DataFrame, chromosome: int, position: int, around: int = 100, above: float = 0.8) -> DataFrame:
    """Per individual the first common scale-0 node near the position: individual_id, id."""
    near = nodes.where((F.col("chromosome") == chromosome) & (F.col("scale_level") == 0) & (F.col("frequency") > above))
    near = near.where((F.col("start_pos") <= position + around) & (F.col("end_pos") >= position - around))
    return near.groupBy("individual_id").agg(F.min(F.struct("start_pos", "id"))["id"].alias("id"))


def diploid_routes(nodes: DataFrame, edges: DataFrame, chromosome: int, start: int, end: int, around: int = 100, above: float = 0.8, max_hops: int = 100) -> DataFrame:
    """Maternal and paternal route of every individual between its anchors: individual_id, haplotype, path, hops, score.

    The maternal route uses edges of frequency >= 0.01 without inversions; the
    paternal one frequencies >= 0.005, inversions too, and none of the maternal route's inner nodes.
    Individuals without anchors or without a route do not occur.
    """
    first, last = anchors(nodes, chromosome, start, around, above), anchors(nodes, chromosome, end, around, above)
    routes = first.select(F.col("individual_id").alias("route"), F.col("id").alias("source")).join(last.select(F.col("individual_id").alias("route"), F.col("id").alias("target")), "route")
    routes = materialise(routes, "routes")
    mother = materialise(shortest_paths(edges, routes, max_hops, (F.col("frequency") >= 0.01) & (F.col("edge_type") != "inversion")), "maternal")
    inner = mother.select("route", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("node"))
    father = shortest_paths(edges, routes, max_hops, F.col("frequency") >= 0.005, inner)
    both = mother.withColumn("haplotype", F.lit("maternal")).unionByName(father.withColumn("haplotype", F.lit("paternal")))
    return both.select(F.col("route").alias("individual_id"), "haplotype", "path", "hops", "score")


def inferred_paths(mappings: DataFrame, nodes: DataFrame, edges: DataFrame, chromosome: int, start: int, end: int, max_hops: int = 20) -> DataFrame:
    """Per haplotype the path between the first and last mapped node within the region; if there is none, the nodes in order."""
    inside = nodes.join(mappings.select("id").distinct(), "id", "left_semi").where((F.col("chromosome") == chromosome) & (F.col("start_pos") >= start) & (F.col("end_pos") <= end))
    inside = materialise(inside.select("id", "individual_id", "haplotype", "start_pos"), "inside")
    key = F.concat_ws("_h", "individual_id", F.col("haplotype").cast("string")).alias("route")
    ends = inside.groupBy(key).agg(F.min(F.struct("start_pos", "id"))["id"].alias("source"), F.max(F.struct("start_pos", "id"))["id"].alias("target"))
    direct = shortest_paths(edges, ends, max_hops, F.col("frequency") > 0.01)
    in_order = inside.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "id"))), lambda x: x["id"]).alias("nodes"))
    return in_order.join(direct, "route", "left").select("route", F.coalesce("path", "nodes").alias("path"), F.col("path").isNotNull().alias("connected"))
