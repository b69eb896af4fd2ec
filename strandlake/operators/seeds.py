"""Seeds: what stands for a sequence's k-mers where moving them all would cost too much.

A window of k letters is filed under the least, by a hash, of its parts of m letters. Neighbouring windows mostly
share it, so a sequence has a seed for about every nine windows, and two sequences with a common window have its seed in common.
Seeds move in packed blocks, a block for each bucket of seeds and batch of sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise, ship
from .kmers import _CODE, CHUNK

_LETTERS = np.frombuffer(b"ACGT", np.uint8)
_FOUR = _LETTERS[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]  # the letters of a byte
_PLAIN = np.full(256, 4, np.uint8)
_PLAIN[_LETTERS] = np.arange(4)
BASES = 1 << 24  # letters a bucket of seeds stands for, on average
_CODEC = pa.Codec("zstd", compression_level=1)


def _flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and the bytes they point into."""
    text = text.cast(pa.large_binary())
    return np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1], np.frombuffer(text.buffers()[2] or b"", np.uint8)


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each letter goes if every text begins at a multiple of four; where every text then begins, and the end."""
    starts = np.append(0, np.cumsum((sizes + 3) // 4 * 4))
    return np.arange(sizes.sum()) + np.repeat(starts[:-1] - np.append(0, np.cumsum(sizes))[:-1], sizes), starts


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, flat = _flat(batch.column(1))
        letters = _PLAIN[flat[offsets[0] : offsets[-1]]]
        sizes = np.diff(offsets)
        to, starts = _places(sizes)
        out = np.zeros(starts[-1], np.uint8)
        out[to] = letters & 3
        four = out.reshape(-1, 4)
        packed = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
        other = np.append(0, np.cumsum(letters > 3))
        odd = pa.array(other[offsets[1:] - offsets[0]] > other[offsets[:-1] - offsets[0]])
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts // 4), pa.py_buffer(packed)]).cast(pa.binary())
        text = batch.column(1).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes.astype(np.int32)), pc.if_else(odd, pa.scalar(None, pa.binary()), binary), pc.if_else(odd, text, pa.scalar(None, pa.string()))], ["ident", "size", "packed", "raw"]
        )


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        odd = pc.is_valid(batch.column(3))
        sizes = np.where(odd.to_numpy(zero_copy_only=False), 0, batch.column(1).to_numpy()).astype(np.int64)
        offsets, flat = _flat(pc.fill_null(batch.column(2), b""))
        letters = _FOUR[flat[offsets[0] : offsets[-1]]].reshape(-1)[_places(sizes)[0]]
        ends = np.append(0, np.cumsum(sizes))
        text = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pc.if_else(odd, batch.column(3), text)], ["ident", "n", "sequence"])


def store(df: DataFrame, ident: str, label: str) -> DataFrame:
    """The distinct (ident, sequence), with a number n each, in storage; sequences that are null are left out.

    Texts of A, C, G, T move and are kept at two bits a letter, others as they are. The result is n, ident, sequence;
    its attribute ``stored`` is the packed table, for what needs no texts.
    """
    ship(df.sparkSession)
    rows = df.where(F.col("sequence").isNotNull()).select(F.col(ident).alias("ident"), "sequence")
    packed = rows.mapInArrow(_pack, f"ident {rows.schema['ident'].dataType.simpleString()}, size int, packed binary, raw string").distinct()
    kept = materialise(packed.withColumn("n", F.monotonically_increasing_id()), label)
    out = kept.mapInArrow(_unpack, f"ident {rows.schema['ident'].dataType.simpleString()}, n bigint, sequence string").withColumnRenamed("ident", ident)
    out.stored = kept
    return out


def _rolled(letters: np.ndarray, m: int) -> np.ndarray:
    """The codes of all parts of m letters, m at most 16."""
    n = len(letters) - m + 1
    codes, done, power, size = np.zeros(n, np.uint32), 0, letters & np.uint32(3), 1
    while True:
        if m & size:
            codes = (codes << np.uint32(2 * size)) + power[done : done + n] if done else power[:n].copy()
            done += size
        if size * 2 > m:
            return codes
        power = (power[:-size] << np.uint32(2 * size)) + power[size:]
        size *= 2


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def seeds(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, seed, first window and number of windows of every run of windows (of A, C, G, T) with one seed, in the order of the texts."""
    m = min(16, (k + 1) // 2)
    offsets, flat = _flat(text)
    held = []
    for first in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        letters = _CODE[flat[first : min(first + CHUNK + k - 1, int(offsets[-1]))]]
        n = len(letters) - k + 1
        if n <= 0:
            continue
        mixed = _rolled(letters.astype(np.uint32), m) ^ np.uint32(0x5BD1E995)  # or a run of A would be the least of all, far beyond itself
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1)  # an odd factor keeps codes apart
        least = _least(mixed ^ mixed >> np.uint32(13), k - m + 1)
        low, high = np.searchsorted(offsets, first, "right") - 1, np.searchsorted(offsets, first + n, "left")
        begin, end = (np.clip(x - first, 0, n) for x in (offsets[low:high], offsets[low + 1 : high + 1]))
        row = np.repeat(np.arange(low, high, dtype=np.int32), end - begin)
        step = np.zeros(n + 1, np.int32)  # windows that run over a text's end don't count
        np.add.at(step, np.clip(np.maximum(offsets[low:high], offsets[low + 1 : high + 1] - k + 1) - first, 0, n), 1)
        np.add.at(step, end, -1)
        fit = np.cumsum(step[:n]) == 0
        bad = np.append(np.int32(0), np.cumsum(letters > 3, dtype=np.int32))
        if bad[-1]:
            fit &= bad[k:] == bad[:-k]
        new = fit.copy()
        new[1:] &= (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~fit[:-1]
        at = np.flatnonzero(new)
        if len(at):
            total = np.append(0, np.cumsum(fit))
            held.append((row[at], least[at], at + first - offsets[row[at]], np.diff(np.append(total[at], total[n]))))
    if not held:
        return tuple(np.zeros(0, t) for t in (np.int32, np.uint32, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*held))


def _sorted_blocks(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Bucket and block of rows; the first column is the seeds. In a block rows are in the order of seeds and columns hold differences, compressed."""
    bucket = ((columns[0] * np.uint32(0x85EBCA6B)) >> np.uint32(8)).astype(np.int64) % buckets
    order = np.lexsort((*columns[::-1], bucket))
    columns, bucket = [c[order] for c in columns], bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(starts, [*starts[1:], len(bucket)]):
        raw, head = b"", [b - a]
        for i, c in enumerate(columns):
            part = c[a:b].astype(np.int64)
            base = int(part.min()) if i else 0
            part = np.diff(part, prepend=0) if not i else part - base
            kind = np.uint32 if part.max() < 1 << 32 else np.uint64
            head += [base, np.dtype(kind).itemsize]
            raw += part.astype(kind).view(np.uint8).reshape(b - a, -1).T.tobytes()  # bytes of one weight lie together
        yield int(bucket[a]), np.array([len(head), *head], np.int64).tobytes() + _CODEC.compress(raw, asbytes=True)


def _read_blocks(blocks: list[bytes], width: int) -> list[np.ndarray]:
    out = []
    for block in blocks:
        head = np.frombuffer(block, np.int64, int(np.frombuffer(block, np.int64, 1)[0]), 8)
        n, at, parts = int(head[0]), 0, []
        raw = _CODEC.decompress(block[8 + 8 * len(head) :], n * int(head[2::2].sum()), asbytes=True)
        for i, (base, size) in enumerate(zip(head[1::2].tolist(), head[2::2].tolist())):
            part = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, -1).T).view(np.uint32 if size == 4 else np.uint64).reshape(-1).astype(np.int64)
            parts.append(part + base if i else np.cumsum(part))
            at += size * n
        out.append(parts)
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * width


def buckets(df: DataFrame) -> int:
    """How many buckets the seeds of the texts want, so that one fits a task's memory."""
    total = df.agg(F.sum(F.length("sequence"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BASES)


def _once(row: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((seed, row))
    row, seed = row[order], seed[order]
    first = np.append(True, (row[1:] != row[:-1]) | (seed[1:] != seed[:-1]))[: len(row)]
    return row[first], seed[first]


def _blocks_of(k: int, count: int, named: bool):
    """Of (n, sequence): the blocks of the sequences' distinct seeds, with their numbers and lengths if ``named``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, seed = _once(*seeds(batch.column(1), k)[:2])
            columns = [seed, batch.column(0).to_numpy()[row], np.diff(_flat(batch.column(1))[0])[row]] if named else [seed]
            made = list(_sorted_blocks(columns, count))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], ["bucket", "data"])

    return run


def seed_blocks(df: DataFrame, k: int, count: int, named: bool = False) -> DataFrame:
    """bucket, data of n, sequence."""
    return df.select("n", "sequence").mapInArrow(_blocks_of(k, count, named), "bucket int, data binary")
