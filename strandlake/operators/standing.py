"""Where reads stand among the nodes, from seeds, without listing all pairs: the accuracy of mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import segments
from ..storage import materialise, ship
from .kmers import BONUS, _shared, _windows, kmer_sets, map_reads, score
from .seeds import _read_blocks, _sorted_blocks, buckets, seed_blocks, seeds

WANTED, LETTERS = 1 << 20, 1 << 22  # k-mers and letters of reads that go along with a function
_READ = "read_id string, true_node string, r bigint, size int, own_size int, hits bigint, valid bigint, whole boolean, bucket int, data binary"


def _with_own(k: int, count: int):
    """Of (read_id, sequence, true_node, true_text): a row for each read, with its hits on its own node, and the blocks of the reads' seeds: seed, r, windows, and 1 if its node doesn't hold it whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in batches:
            name, read, true, own = (batch.column(i) for i in range(4))
            size = len(read)
            read = pc.fill_null(read.cast(pa.string()), "")
            row, seed, _, windows = seeds(read, k)
            valid = np.bincount(row, windows, size).astype(np.int64)
            whole = np.array([b is not None and a in b for a, b in zip(read.to_pylist(), own.to_pylist())], bool)
            hits = np.where(whole, valid, 0)
            if len(rest := np.flatnonzero(~whole & pc.is_valid(own).to_numpy(zero_copy_only=False))):
                part = pa.RecordBatch.from_arrays([pa.array(rest), pa.array(rest), read.take(pa.array(rest)), own.take(pa.array(rest))], ["r", "n", "read", "node"])
                hits[rest] = next(_shared(k)(iter([part]))).column(2).to_numpy()
            made = list(_sorted_blocks([seed, base + row.astype(np.int64), windows, (~whole).astype(np.int64)[row]], count))
            none = lambda n, t: pa.nulls(n, t)
            length = lambda x: pc.fill_null(pc.utf8_length(x.cast(pa.string())), 0).cast(pa.int32())
            names = [x.split()[0] for x in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([
                name.cast(pa.string()), true.cast(pa.string()), pa.array(base + np.arange(size)), length(read), length(own), pa.array(hits), pa.array(valid), pa.array(whole), none(size, pa.int32()), none(size, pa.binary())
            ], names)
            yield pa.RecordBatch.from_arrays([
                none(len(made), pa.string()), none(len(made), pa.string()), none(len(made), pa.int64()), none(len(made), pa.int32()), none(len(made), pa.int32()), none(len(made), pa.int64()), none(len(made), pa.int64()), none(len(made), pa.bool_()),
                pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())
            ], names)
            base += size

    return run


def _sides(table: pa.Table) -> tuple[list[bytes], list[bytes]]:
    """The blocks of the nodes and of the reads in a bucket."""
    side, data = table.column("side").to_pylist(), table.column("data").to_pylist()
    return [x for s, x in zip(side, data) if s == 0], [x for s, x in zip(side, data) if s == 1]


def _shared_seeds(table: pa.Table) -> pa.Table:
    """r, seed, windows, nodes: the reads' seeds that two nodes have, or one if the read's own node is not among them."""
    nodes, reads = _sides(table)
    (held,), (seed, r, windows, alone) = _read_blocks(nodes, 1), _read_blocks(reads, 4)
    known, times = np.unique(held, return_counts=True)
    fit, found = np.zeros(len(seed), bool), np.zeros(len(seed), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, seed), len(known) - 1)
        found = np.where(known[at] == seed, times[at], 0) - 1 + alone
        fit = found > 0
    return pa.table({"r": r[fit], "seed": seed[fit], "windows": windows[fit], "nodes": found[fit]})


def _within(nodes: list[bytes], reads: list[bytes], most: int = 0):
    """The numbers of the nodes in the order of seed and length, and of each seed of a read: r, windows, and the first and last of those nodes with a length from low to high, or of ``most`` of them about the read's size."""
    (seed, n, length), (wanted, r, windows, low, high, size) = _read_blocks(nodes, 3), _read_blocks(reads, 6)
    fit = np.isin(seed, wanted)
    seed, n, length = seed[fit], n[fit], length[fit]
    key = seed << 31 | length
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    a, b = np.searchsorted(key, wanted << 31 | low), np.searchsorted(key, wanted << 31 | high, "right")
    if most:
        a = np.maximum(a, np.minimum(np.searchsorted(key, wanted << 31 | size) - most // 2, b - most))
        b = np.minimum(b, a + most)
    return n, r, windows, a, b


def _surplus(top: int):
    """r, surplus: over the read's windows, how many nodes of fitting length may have each, at most ``top``, summed up."""

    def run(table: pa.Table) -> pa.Table:
        _, r, windows, a, b = _within(*_sides(table))
        each, inverse = np.unique(r, return_inverse=True)
        return pa.table({"r": each, "surplus": np.bincount(inverse, np.minimum(b - a, top) * windows, len(each)).astype(np.int64)})

    return run


def _pairs(most: int = 0):
    """r, n, windows: the nodes of fitting length, or ``most`` of them, that have the read's seeds."""

    def run(table: pa.Table) -> pa.Table:
        n, r, windows, a, b = _within(*_sides(table), most)
        times = np.maximum(b - a, 0)
        at = np.arange(times.sum()) + np.repeat(a - np.append(0, np.cumsum(times))[:-1], times)
        return pa.table({"r": np.repeat(r, times), "n": n[at], "windows": np.repeat(windows, times)})

    return run


def _hits(k: int):
    """Of (r, n, read, node, ...): the hits of the pairs, and what else they come with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                r, n, hits = next(_shared(k)(iter([part]))).columns
                yield pa.RecordBatch.from_arrays([r, n, hits, *part.columns[4:]], ["r", "n", "hits", *part.schema.names[4:]])

    return run


def _against(k: int, numbers: np.ndarray, texts: list[str]):
    """Of (r, id, text): with the reads of these numbers, in rising order, what _hits() gives; reads and nodes that come again in a batch are cut up once."""
    parts = [np.concatenate(x) for x in zip(*_windows(pa.array(texts, pa.string()), k))] or [np.zeros(0, np.int64)] * 3
    mine, mine_code = parts[0], parts[2]
    valid = np.bincount(mine, minlength=len(texts))
    starts = np.append(0, np.cumsum(valid))
    sizes = np.array([len(t) for t in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = np.searchsorted(numbers, batch.column(0).to_numpy())
            node = batch.column(2).dictionary_encode()
            each, hits = node.indices.to_numpy(), np.zeros(batch.num_rows, np.int64)
            if held := [(row, code) for row, _, code in _windows(node.dictionary, k)]:
                row, code = (np.concatenate(x) for x in zip(*held))
                names, place = np.unique(code, return_inverse=True)
                keys = np.unique(row * len(names) + place)
                at = np.minimum(np.searchsorted(names, mine_code), len(names) - 1)
                rank = np.where(names[at] == mine_code, at, -1)
                for first in range(0, batch.num_rows, 2000):
                    one, other = read[first : first + 2000], each[first : first + 2000]
                    pair = np.repeat(np.arange(len(one)), valid[one])
                    window = np.arange(len(pair)) + np.repeat(starts[one] - np.append(0, np.cumsum(valid[one]))[:-1], valid[one])
                    pair, window = pair[rank[window] >= 0], window[rank[window] >= 0]
                    key = other[pair] * len(names) + rank[window]
                    met = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    hits[first : first + 2000] = np.bincount(pair[met], minlength=len(one))
            whole = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(hits == valid[read]):
                whole[i] = texts[read[i]] in batch.column(2)[int(i)].as_py()
            length = pc.utf8_length(batch.column(2)).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits), pa.array(sizes[read].astype(np.int32)), length, pa.array(whole)], ["r", "id", "hits", "a", "b", "whole"])

    return run


def _blocks_of_rows(count: int):
    """The blocks of rows whose first column is a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            made = list(_sorted_blocks([columns[0].astype(np.uint32), *columns[1:]], count))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "data"])

    return run


def _met(nodes: DataFrame, reads: DataFrame, work, schema: str) -> DataFrame:
    both = nodes.withColumn("side", F.lit(0)).unionByName(reads.withColumn("side", F.lit(1)))
    return both.groupBy("bucket").applyInArrow(work, schema)


def accuracy(reads: DataFrame, nodes: DataFrame, k: int = 31, min_hits: int = 5, min_score: float = 0.8, top: int = 10) -> DataFrame:
    """reads, accuracy: what segments.mapping_accuracy() says of map_reads(), for reads that come with the text of their true node.

    ``reads``: read_id, sequence, true_node, true_text, distinct; ``nodes``: what store() gives. A read is on its true node unless that falls short
    of the limits, or ``top`` other nodes score more. Each of these holds so many of the read's windows that the read's own score follows
    from them. How many nodes may have a window is known from its seed, so for most reads a sum over seeds rules that out, for most
    others the same sum over the nodes of such lengths as can reach their score; the rest are held against all those nodes.
    """
    ship(reads.sparkSession)
    spark, count = reads.sparkSession, buckets(nodes)
    made = materialise(reads.select("read_id", "sequence", "true_node", "true_text").mapInArrow(_with_own(k, count), _READ), "reads")
    own = made.where("r is not null").withColumn("score", F.when((F.col("size") > 0) & (F.col("own_size") > 0), score(F.col("hits"), F.col("size"), F.col("own_size"), F.col("whole"), k)))
    own = own.withColumn("mapped", F.coalesce((F.col("hits") >= min_hits) & (F.col("score") >= min_score), F.lit(False)))
    names = nodes.stored.groupBy("ident").count().where("count > 1").unionByName(own.groupBy(F.col("read_id").alias("ident")).count().where("count > 1"))
    if not names.isEmpty():  # a name of several texts: mappings are told apart by name only
        return segments.mapping_accuracy(reads.select("read_id", "sequence", "true_node"), map_reads(reads, nodes, k, min_hits, min_score, top))
    shared = _met(seed_blocks(nodes, k, count), made.where("bucket is not null").select("bucket", "data"), _shared_seeds, "r bigint, seed bigint, windows bigint, nodes bigint")
    shared = materialise(shared, "shared")
    sums = shared.groupBy("r").agg(F.sum("windows").alias("shared"), F.sum(F.least("nodes", F.lit(top)) * F.col("windows")).alias("surplus"))
    rated = sums.hint("merge").join(own.where("mapped"), "r").withColumn("need", F.greatest(F.lit(min_hits), F.least("valid", F.ceil(F.col("score") * (F.col("size") - k + 1) - 1e-6))))
    doubt = materialise(_limited(rated.select("r", "read_id", "true_node", "score", "need", "size", "valid", "whole", "shared", "surplus"), k, top), "doubt")
    lost = own.select("r").limit(0)
    if not doubt.isEmpty():
        lost = _outdone(doubt, shared, reads, nodes, k, count, min_hits, top)
    each = own.select(F.lit(1).alias("read"), F.col("mapped").cast("int").alias("right")).unionByName(lost.select(F.lit(0).alias("read"), F.lit(-1).alias("right")))
    return each.agg(F.coalesce(F.sum("read"), F.lit(0)).alias("reads"), F.try_divide(F.sum("right"), F.sum("read")).alias("accuracy"))


def _limited(rated: DataFrame, k: int, top: int) -> DataFrame:
    """Of reads with the windows that other nodes may have (shared), and these times the nodes (surplus): those that ``top`` nodes may come before, and such nodes' lengths."""
    most = F.least("shared", "valid") / (F.col("size") - k + 1) + F.when(F.col("shared") >= F.col("valid"), BONUS).otherwise(0.0)
    ratio = F.col("score") * (1 - 1e-9) / most
    kept = rated.where((F.col("surplus") >= top * F.col("need")) & (F.col("shared") >= F.col("need"))).withColumn("ratio", ratio).where("ratio <= 1")
    return kept.withColumns({"low": F.floor(F.col("ratio") * F.col("size")), "high": F.least(F.ceil(F.col("size") / F.col("ratio")), F.lit((1 << 31) - 1))}).drop("ratio", "shared", "surplus")


def _counted(k: int, wanted: np.ndarray):
    """kmer, nodes: in how many of the texts each of the wanted k-mers is."""
    some = np.zeros(1 << 22, bool)
    some[wanted % len(some)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            met = [np.zeros(0, np.int64)]
            for row, _, code in _windows(batch.column(0), k):
                fit = np.flatnonzero(some[code & len(some) - 1])
                at = np.minimum(np.searchsorted(wanted, code[fit]), len(wanted) - 1)
                same = wanted[at] == code[fit]
                met.append(row[fit][same] * len(wanted) + at[same])
            total += np.bincount(np.unique(np.concatenate(met)) % len(wanted), minlength=len(wanted))
        has = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[has]), pa.array(total[has])], ["kmer", "nodes"])

    return run


def _counted_out(doubt: DataFrame, text: DataFrame, nodes: DataFrame, k: int, top: int) -> DataFrame:
    """The doubt that is left when the k-mers themselves are counted, not their seeds; where they are too many to go along with a function, all of it."""
    own = materialise(kmer_sets(text, "r", "read_text", k), "kmers")
    wanted = own.select("kmer").distinct().limit(WANTED + 1).toArrow().column(0).to_numpy()
    if not 0 < len(wanted) <= WANTED:
        return doubt
    known = nodes.select("sequence").mapInArrow(_counted(k, np.sort(wanted)), "kmer bigint, nodes bigint").groupBy("kmer").agg(F.sum("nodes").alias("nodes"))
    others = F.col("nodes") - F.when(F.col("whole"), 1).otherwise(0)
    each = own.join(known.hint("merge"), "kmer").join(doubt.select("r", "whole"), "r").where(others > 0)
    sums = each.groupBy("r").agg(F.sum("times").alias("shared"), F.sum(F.least(others, F.lit(top)) * F.col("times")).alias("surplus"))
    return materialise(_limited(sums.join(doubt.drop("low", "high"), "r"), k, top), "doubt")


def _outdone(doubt: DataFrame, shared: DataFrame, reads: DataFrame, nodes: DataFrame, k: int, count: int, min_hits: int, top: int) -> DataFrame:
    """r of the reads for which ``top`` nodes come before the true one. Such a node's length lies from low to high, since the ratio of lengths weighs its score.

    A read is first held against a few nodes that have its widest seed; only if these aren't enough, against all that may come before.
    """
    limits = ("low", "high", "size")

    def asked(of: DataFrame, widest: bool = False) -> DataFrame:
        rows = shared.groupBy("r", "seed").agg(F.sum("windows").alias("windows")).hint("merge").join(of.select("r", *limits), "r")
        if widest:
            rows = rows.groupBy("r", *limits).agg(F.max(F.struct("windows", "seed")).alias("x")).select("r", *limits, "x.windows", "x.seed")
        return rows.select("seed", "r", "windows", *limits).mapInArrow(_blocks_of_rows(count), "bucket int, data binary")

    def before(pairs: DataFrame, of: DataFrame) -> DataFrame:
        """r of the reads that enough of the nodes come before."""
        node = nodes.select("n", "id", F.col("sequence").alias("node_text"))
        own = text.join(of, "r").select("r", "read_text")
        if (own.agg(F.sum(F.length("read_text"))).first()[0] or 0) <= LETTERS:
            mine = own.orderBy("r").toArrow()
            both = pairs.hint("merge").join(node, "n").select("r", "id", "node_text")
            hits = both.mapInArrow(_against(k, mine.column(0).to_numpy(), mine.column(1).to_pylist()), "r bigint, id string, hits bigint, a int, b int, whole boolean")
            hits = hits.where(F.col("hits") >= min_hits).join(of.select("r", "true_node", F.col("score").alias("own")), "r").where("id <> true_node")
        else:
            both = pairs.join(of.join(text, "r"), "r").join(node, "n").where("id <> true_node")
            given = both.select("r", "n", "read_text", "node_text", "id", "true_node", F.col("score").alias("own"), F.length("read_text").alias("a"), F.length("node_text").alias("b"), F.contains("node_text", "read_text").alias("whole"))
            hits = given.mapInArrow(_hits(k), "r bigint, n bigint, hits bigint, id string, true_node string, own double, a int, b int, whole boolean").where(F.col("hits") >= min_hits)
        rated = hits.withColumn("score", score(F.col("hits"), F.col("a"), F.col("b"), F.col("whole"), k))
        above = rated.where((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("id") < F.col("true_node"))))
        return above.groupBy("r").count().where(F.col("count") >= top).select("r")

    held = materialise(seed_blocks(nodes, k, count, True), "seeds")
    left = _met(held, asked(doubt), _surplus(top), "r bigint, surplus bigint").groupBy("r").agg(F.sum("surplus").alias("surplus"))
    doubt = materialise(left.hint("merge").join(doubt, "r").where(F.col("surplus") >= top * F.col("need")).drop("surplus"), "doubt")
    text = materialise(doubt.select("r", "read_id").join(reads.select("read_id", F.col("sequence").alias("read_text")), "read_id").drop("read_id"), "texts")
    doubt = _counted_out(doubt, text, nodes, k, top)
    if doubt.isEmpty():
        return doubt.select("r")
    kind = "r bigint, n bigint, windows bigint"
    lost = materialise(before(_met(held, asked(doubt, True), _pairs(4 * top), kind).select("r", "n"), doubt), "lost")
    doubt = materialise(doubt.join(lost, "r", "left_anti"), "doubt")
    if doubt.isEmpty():
        return lost
    pairs = _met(held, asked(doubt), _pairs(), kind).groupBy("r", "n").agg(F.sum("windows").alias("windows"))
    pairs = pairs.join(doubt.select("r", "need"), "r").where(F.col("windows") >= F.col("need")).select("r", "n")
    return lost.unionByName(before(pairs, doubt))
