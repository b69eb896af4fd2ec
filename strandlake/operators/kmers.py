"""k-mer index, read mapping and its scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise, ship
from .skew import hot_keys, salted_join

CHUNK = 1 << 21  # letters worked on at a time
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _windows(text: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, start, code) of every window of k letters A, C, G, T of a column of strings; codes as kmer_code()."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    flat = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    for first in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        letters = _CODE[flat[first : min(first + CHUNK + k - 1, int(offsets[-1]))]]
        n = len(letters) - k + 1
        if n <= 0:
            continue
        bad = np.concatenate([[0], np.cumsum(letters > 3)])
        codes, done, power, size = np.zeros(n, np.int64), 0, letters.astype(np.int64) & 3, 1
        while True:  # windows of 1, 2, 4, ... letters; those in k's binary form are put together
            if k & size:
                codes = codes * (1 << 2 * size) + power[done : done + n]
                done += size
            if size * 2 > k:
                break
            power = power[:-size] * (1 << 2 * size) + power[size:]
            size *= 2
        at = np.arange(first, first + n)
        row = np.searchsorted(offsets, at, "right") - 1
        fit = np.flatnonzero((at + k <= offsets[row + 1]) & (bad[k:] == bad[:-k]))
        if len(fit):
            yield row[fit], at[fit] - offsets[row[fit]], codes[fit]


def _all(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column(2).to_numpy()
            for row, start, code in _windows(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(code), pa.array(begin[row] + start)], ["ident", "kmer", "position"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [x for row, _, code in _windows(batch.column(1), k) for x in [(row, code)]]
            if not held:
                continue
            row, code = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            firsts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
            times = np.diff(np.append(firsts, len(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[firsts])), pa.array(code[firsts]), pa.array(times.astype(np.int32))], ["ident", "kmer", "times"])

    return run


def _spread(df: DataFrame, ident: str) -> DataFrame:
    """A sequence becomes many rows, so the rows are first spread over all tasks, however few files or bytes they came from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), ident)


def kmers(df: DataFrame, ident: str, sequence: str, k: int, start: Column | None = None, upper: bool = True, skip_n: bool = True, coded: bool = False) -> DataFrame:
    """ident, kmer, position: every window of k letters; none of a sequence that is null or shorter than k.

    With ``coded`` (k at most 31) a k-mer is its exact kmer_code(), and windows with other letters
    than A, C, G, T (of any case) are left out; codes are rolled over whole batches of sequences.
    """
    begin = (F.lit(0) if start is None else start).cast("bigint").alias("_start")
    if coded:
        if k > 31:
            raise ValueError("a bigint holds at most 31 letters")
        ship(df.sparkSession)
        rows = _spread(df.where(F.length(sequence) >= k).select(F.col(ident).alias("ident"), F.col(sequence).alias("text"), begin), "ident")
        key = rows.schema["ident"].dataType.simpleString()
        return rows.mapInArrow(_all(k), f"ident {key}, kmer bigint, position bigint").withColumnRenamed("ident", ident)
    text = F.upper(sequence) if upper else F.col(sequence)
    rows = _spread(df.where(F.length(sequence) >= k).select(F.col(ident), text.alias("_text"), begin), ident)
    each = rows.select(ident, "_text", "_start", F.explode(F.sequence(F.lit(0), F.length("_text") - k)).alias("_i"))
    out = each.select(ident, F.substring("_text", F.col("_i") + 1, F.lit(k)).alias("kmer"), (F.col("_start") + F.col("_i")).alias("position"))
    return out.where(~F.contains("kmer", F.lit("N"))) if skip_n else out


def kmer_sets(df: DataFrame, ident: str, sequence: str, k: int) -> DataFrame:
    """ident, kmer (coded), times: each row's distinct k-mers and how often it has them, found within the row, without a shuffle of k-mers."""
    ship(df.sparkSession)
    rows = _spread(df.where(F.length(sequence) >= k).select(F.col(ident).alias("ident"), F.col(sequence).alias("text")), "ident")
    key = rows.schema["ident"].dataType.simpleString()
    return rows.mapInArrow(_sets(k), f"ident {key}, kmer bigint, times int").withColumnRenamed("ident", ident)


def index(kmer_rows: DataFrame, node: str) -> DataFrame:
    """kmer, node_count: in how many nodes each k-mer occurs. Of kmer_sets() a node should be one row."""
    n = F.count("*") if "times" in kmer_rows.columns else F.count_distinct(node)
    return kmer_rows.groupBy("kmer").agg(n.alias("node_count"))


def hits(read_kmers: DataFrame, node_kmers: DataFrame, read: str, node: str, least: int, hot: list | None = None) -> DataFrame:
    """read, node, hits: the read's k-mers (repeats count) that the node has (once), where there are at least ``least``.

    Both sides are kmer_sets(); other k-mer rows are counted or made distinct first. The join is
    shuffled, whatever a planner guesses of the rows' size, and ``hot`` k-mers, which many
    nodes have, are spread over many tasks.
    """
    per_read = read_kmers if "times" in read_kmers.columns else read_kmers.groupBy(read, "kmer").agg(F.count("*").alias("times"))
    per_node = node_kmers.select(node, "kmer") if "times" in node_kmers.columns else node_kmers.select(node, "kmer").distinct()
    met = salted_join(per_node, per_read.hint("merge"), "kmer", node, hot=hot or [])
    return met.groupBy(read, node).agg(F.sum("times").alias("hits")).where(F.col("hits") >= least)


def _numbered(df: DataFrame, ident: str, label: str) -> DataFrame:
    """The distinct (ident, sequence) with a number each, which stands for the id in the joins of k-mers."""
    return materialise(df.select(ident, "sequence").distinct().withColumn("n", F.monotonically_increasing_id()), label)


def mapping_score(hits_: Column, read: Column, node: Column, k: int) -> Column:
    """Share of the read's k-mers that hit, plus 0.2 if the node holds the whole read, weighed by the lengths' ratio; at most 1."""
    return score(hits_, F.length(read), F.length(node), F.contains(node, read), k)


def score(hits_: Column, read: Column, node: Column, whole: Column, k: int) -> Column:
    """mapping_score() from the lengths of both, and whether the node holds the read."""
    windows = read - k + 1
    share = F.when(windows > 0, hits_ / windows).otherwise(0.0) + F.when(whole, BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), share * F.least(read, node) / F.greatest(read, node))


FEW = 0.3
BONUS = 0.2  # of a read that a node holds whole


def _shared(k: int):
    """Of (r, n, read, node): r, n and hits, how many of the read's windows the node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (list(_windows(batch.column(i), k)) for i in (2, 3))
            hits = np.zeros(batch.num_rows, np.int64)
            if one and other:
                (row, _, code), (row2, _, code2) = ((np.concatenate(x) for x in zip(*side)) for side in (one, other))
                names, place = np.unique(np.concatenate([code, code2]), return_inverse=True)
                held = np.isin(row * len(names) + place[: len(code)], row2 * len(names) + place[len(code) :])
                hits = np.bincount(row[held], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits.astype(np.int64))], ["r", "n", "hits"])

    return run


def _candidates(one: DataFrame, other: DataFrame, k: int, min_hits: int, min_score: float) -> DataFrame:
    """Pairs (r, n) among which are all that can reach the score.

    A node of at least that score has at least (min_score - BONUS) x windows of a read's windows. So of the windows that
    any node has, all but that many may be missing, and among a read's rarest ones, one more than may be missing, there is one that the
    node has. Only these are joined: k-mers of repeats, which very many nodes have, come in where a read has little else.
    """
    need = F.greatest(F.lit(min_hits), F.ceil((min_score - BONUS) * (F.length("sequence") - k + 1) - 1e-6)).alias("need")
    reads = kmer_sets(one.where(F.length("sequence") >= k), "n", "sequence", k).withColumnRenamed("n", "r")
    held = materialise(kmer_sets(other, "n", "sequence", k).drop("times"), "kmers")
    known = held.groupBy("kmer").agg(F.count("*").alias("nodes"))
    seen = reads.join(known.hint("merge"), "kmer").join(one.select(F.col("n").alias("r"), need), "r")
    by_read = Window.partitionBy("r")
    rarest = by_read.orderBy("nodes", "kmer").rowsBetween(Window.unboundedPreceding, -1)
    spare = F.sum("times").over(by_read) - F.col("need")  # windows that a node may lack
    kept = seen.select("r", "kmer", spare.alias("spare"), F.coalesce(F.sum("times").over(rarest), F.lit(0)).alias("before"))
    kept = kept.where((F.col("spare") >= 0) & (F.col("before") <= F.col("spare"))).select("r", "kmer")
    return salted_join(held, kept.hint("merge"), "kmer", "n", hot=hot_keys(held.sample(0.05, 1), "kmer")).select("r", "n").distinct()


def map_reads(reads: DataFrame, nodes: DataFrame, k: int = 31, min_hits: int = 5, min_score: float = 0.8, top: int = 10) -> DataFrame:
    """The best nodes of each read: read_id, id, hits, score, rank; ties by node id.

    ``reads``: read_id, sequence; ``nodes``: id, sequence; k at most 31. A hit is a window of the read, of A, C, G, T, that the
    node has. Repeated rows count once, null sequences map nowhere. Texts are looked up for candidates only.
    """
    one, other = _numbered(reads, "read_id", "reads"), _numbered(nodes, "id", "nodes")
    a = one.select(F.col("n").alias("r"), "read_id", F.upper("sequence").alias("read_text"))
    b = other.select("n", "id", F.upper("sequence").alias("node_text"))
    if min_score - BONUS < FEW:  # a read's rarest windows would be nearly all of them
        hot = hot_keys(kmer_sets(other.sample(0.05, 1), "n", "sequence", k), "kmer")  # they only steer the plan
        found = hits(kmer_sets(one, "n", "sequence", k).withColumnRenamed("n", "r"), kmer_sets(other, "n", "sequence", k), "r", "n", min_hits, hot)
    else:
        ratio = F.least(F.length("read_text"), F.length("node_text")) / F.greatest(F.length("read_text"), F.length("node_text"))
        pairs = _candidates(one, other, k, min_hits, min_score)
        fit = pairs.join(a.drop("read_id"), "r").join(b.drop("id"), "n").where(ratio * (1 + BONUS) >= min_score - 1e-6)
        found = fit.select("r", "n", "read_text", "node_text").mapInArrow(_shared(k), "r bigint, n bigint, hits bigint").where(F.col("hits") >= min_hits)
    with_text = found.join(a, "r").join(b, "n")
    scored = with_text.select("read_id", "id", "hits", mapping_score(F.col("hits"), F.col("read_text"), F.col("node_text"), k).alias("score")).where(F.col("score") >= min_score)
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def first_reads(reads: DataFrame, most: int) -> DataFrame:
    """The first ``most`` reads by id, for a caller that wants no more mapped; a negative number means all."""
    return reads if most < 0 else reads.orderBy("read_id").limit(most)


def mapping_report(reads: DataFrame, mappings: DataFrame) -> DataFrame:
    """total_reads, mapped_reads, mapping_rate, mean_best_score."""
    best = mappings.groupBy("read_id").agg(F.max("score").alias("best"))
    joined = reads.select("read_id").join(best, "read_id", "left")
    return joined.agg(
        F.count("*").alias("total_reads"), F.count("best").alias("mapped_reads"), (F.count("best") / F.count("*")).alias("mapping_rate"), F.avg("best").alias("mean_best_score")
    )


def candidate_threshold(length: int, k: int) -> int:
    """How many k-mers a read must share with a transcript to be aligned to it."""
    return max(3, (length - k + 1) // 10)


def _slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (r, t, read, target): r, t, start and mismatches of the read's best place in the target, the earliest of equals."""
    for batch in batches:
        best = []
        for read, target in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(x.as_py().encode(), np.uint8) for x in (read, target))
            least, start = len(a) + 1, 0
            step = max(1, CHUNK // len(a))  # places compared at a time
            for first in range(0, len(b) - len(a) + 1, step):
                part = np.lib.stride_tricks.sliding_window_view(b[first : first + step + len(a) - 1], len(a))
                off = (part != a).sum(axis=1)
                if off.min() < least:
                    least, start = int(off.min()), first + int(off.argmin())
            best.append((start, least))
        start, least = zip(*best) if best else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int32()), pa.array(least, pa.int32())], ["r", "t", "start", "mismatches"])


def align(reads: DataFrame, targets: DataFrame, k: int = 31, max_mismatches: int = 3, min_score: float = 0.8, top: int = 10) -> DataFrame:
    """Ungapped alignments: read_id, transcript_id, start, mismatches, score, mapq, is_unique.

    Only pairs that share enough k-mers (of A, C, G, T) are slid along each other, in Arrow batches; the best window counts,
    the earliest of equals. ``reads``: read_id, sequence; ``targets``: transcript_id, sequence. Letter case counts as in
    the sequences given; repeated rows count once.
    """
    one, other = _numbered(reads, "read_id", "reads"), _numbered(targets, "transcript_id", "targets")
    hot = hot_keys(kmer_sets(other.sample(0.05, 1), "n", "sequence", k), "kmer")  # they only steer the plan
    found = hits(kmer_sets(one, "n", "sequence", k).withColumnRenamed("n", "r"), kmer_sets(other, "n", "sequence", k).withColumnRenamed("n", "t"), "r", "t", 3, hot)
    pairs = found.join(one.select(F.col("n").alias("r"), F.col("sequence").alias("read")), "r").join(other.select(F.col("n").alias("t"), F.col("sequence").alias("target")), "t")
    enough = F.greatest(F.lit(3), F.floor((F.length("read") - k + 1) / 10))
    pairs = pairs.where((F.col("hits") >= enough) & (F.length("target") >= F.length("read"))).select("r", "t", "read", "target")
    best = pairs.mapInArrow(_slide, "r bigint, t bigint, start int, mismatches int").where(F.col("mismatches") <= max_mismatches)
    named = best.join(one.select(F.col("n").alias("r"), "read_id", F.length("sequence").alias("size")), "r").join(other.select(F.col("n").alias("t"), "transcript_id"), "t")
    score = (F.col("size") - F.col("mismatches")) / F.col("size")
    kept = named.select("read_id", "transcript_id", "start", "mismatches", score.alias("score"), F.floor(score * 60).cast("int").alias("mapq")).where(F.col("score") >= min_score)
    by_read = Window.partitionBy("read_id")
    ranked = kept.withColumn("rank", F.row_number().over(by_read.orderBy(F.desc("score"), "transcript_id"))).where(F.col("rank") <= top)
    return ranked.withColumn("is_unique", F.count("*").over(by_read) == 1).drop("rank")
