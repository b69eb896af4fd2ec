"""Heavy hitters by code-based identification, in memory that does not grow with the column.

Values are 64-bit words. A word is spread over eight bytes and protected by four
bytes of a Reed-Solomon code over GF(256); the 24 half-bytes of the code word are
its symbols. Each of ROWS hash functions sends the word to one of GROUPS groups,
and the group counts, for each of the 24 places, how often each of the 16 symbols
was seen. A frequent word makes its own symbol heavy at every place of its group,
so reading the heavy symbols place by place spells the word; where two frequent
words share a group, the doubtful bytes are treated as erasures and recovered by
the code. Candidates are then counted exactly.

The counters never undercount, so the exact counts give a proof of completeness:
take the found words out of the counters; if every group of one row keeps a place
without a heavy symbol, no frequent word was missed. Groups for which the proof
fails are counted out exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import small
from ..storage import materialise, ship

DATA, PARITY = 8, 4
PLACES = 2 * (DATA + PARITY)
ROWS = 3
FIELD_POLYNOMIAL = 0x11D


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (FIELD_POLYNOMIAL if x & 0x80 else 0)
    return exp, log


EXP, LOG = _field()


def _times(a, b):
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return np.where((a == 0) | (b == 0), 0, EXP[(LOG[a] + LOG[b]) % 255])


def _solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """matrix x = right over GF(256); None if singular."""
    m = np.concatenate([matrix, right[:, None]], axis=1).astype(np.int64)
    for i in range(len(m)):
        pivot = next((j for j in range(i, len(m)) if m[j, i]), None)
        if pivot is None:
            return None
        m[[i, pivot]] = m[[pivot, i]]
        m[i] = _times(m[i], EXP[255 - LOG[m[i, i]]])
        for j in range(len(m)):
            if j != i and m[j, i]:
                m[j] ^= _times(m[i], m[j, i])
    return m[:, -1]


def _generator() -> np.ndarray:
    """12 x 8: the identity above a Cauchy matrix, so that any 8 rows are independent."""
    cauchy = np.array([[EXP[255 - LOG[(DATA + p) ^ d]] for d in range(DATA)] for p in range(PARITY)])
    return np.concatenate([np.eye(DATA, dtype=np.int64), cauchy])


GENERATOR = _generator()
PARITY_TABLES = np.array([[_times(np.arange(256), GENERATOR[DATA + p, d]) for d in range(DATA)] for p in range(PARITY)], np.uint8)


def code_bytes(words: np.ndarray) -> np.ndarray:
    """n x 12 code bytes of n 64-bit words."""
    data = words.astype("<i8").view(np.uint8).reshape(-1, DATA)
    parity = np.zeros((len(data), PARITY), np.uint8)
    for p, d in product(range(PARITY), range(DATA)):
        parity[:, p] ^= PARITY_TABLES[p, d][data[:, d]]
    return np.concatenate([data, parity], axis=1)


def symbols(words: np.ndarray) -> np.ndarray:
    """n x 24 half-bytes of the code words."""
    code = code_bytes(words)
    return np.stack([code >> 4, code & 15], axis=2).reshape(len(code), PLACES)


def groups_of(words: np.ndarray, row: int, groups: int) -> np.ndarray:
    x = words.astype(np.uint64) + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(groups)).astype(np.int64)


def _sketch(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, PLACES, groups * 16), np.int64)
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False)
            seen = symbols(words).astype(np.int64)
            for row in range(ROWS):
                base = groups_of(words, row, groups) * 16
                for place in range(PLACES):
                    counts[row, place] += np.bincount(base + seen[:, place], minlength=groups * 16)
        cells = counts.reshape(ROWS, PLACES, groups, 16).transpose(0, 2, 1, 3).reshape(ROWS * groups, PLACES * 16)
        used = np.flatnonzero(cells.any(axis=1))
        for some in np.array_split(used, max(1, len(used) // 512)):
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cells[i].tobytes() for i in some], pa.binary())], ["cell", "counts"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of each cell; holds one array for each cell of the partition, however many rows come."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one = np.frombuffer(counts, np.int64)
            held[cell] = held[cell] + one if cell in held else one
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["cell", "counts"])


def _decode(counts: np.ndarray, least: float) -> list[int]:
    """The words that the heavy symbols of one group (24 x 16 counts) spell."""
    left, found = counts.astype(np.float64), []
    for _ in range(int(counts[0].sum() / least) + 1):
        ranked = np.sort(left, axis=1)
        if ranked[:, -1].min() < least:
            break
        best = left.argmax(axis=1)
        doubt = (ranked[:, -2] / ranked[:, -1]).reshape(-1, 2).max(axis=1)
        sure = np.sort(np.argsort(doubt, kind="stable")[:DATA])
        code = best[0::2] * 16 + best[1::2]
        data = _solve(GENERATOR[sure], code[sure])
        if data is None:
            break
        word = int(data.astype(np.uint8).tobytes()[::-1].hex(), 16)
        found.append(word - (1 << 64) if word >> 63 else word)
        spelled = symbols(np.array(found[-1:], np.int64))[0]
        own = left[np.arange(PLACES), spelled]
        left[np.arange(PLACES), spelled] -= max(min(own.min(), ranked[:, -1].min()), least)
    return found


def frequent(df: DataFrame, value: str, share: float, ident: str | None = None, groups: int | None = None, word: Column | None = None) -> DataFrame:
    """The values that make up at least ``share`` of all counted rows: value, n_rows, share.

    Null values are not counted. With ``ident`` each id counts once (of conflicting
    values for an id each counts); rows with a null id count one by one. An empty
    table gives no rows. Other columns are ignored. Empty and very long strings are
    values like any other: strings are identified by a 64-bit hash and counted as
    themselves; a bigint column, or ``word`` given for it, is its own identity.

    Memory: ROWS x groups x 24 x 16 counters a task, where ``groups`` is at least
    1/share; as many, once, on the driver. The result has at most 1/share rows.
    """
    spark = df.sparkSession
    ship(spark)
    groups = groups or max(64, 1 << int(np.ceil(np.log2(1 / share))))
    own = word is None and dict(df.dtypes)[value] == "bigint"
    code = word if word is not None else F.col(f"`{value}`") if own else F.xxhash64(F.col(f"`{value}`"))
    rows = df.where(F.col(f"`{value}`").isNotNull()).select(
        code.alias("word"), *([] if own or word is not None else [F.col(f"`{value}`").alias("value")]), *([F.col(f"`{ident}`").alias("ident")] if ident else [])
    )
    if ident:
        rows = rows.withColumn("lone", F.when(F.col("ident").isNull(), F.monotonically_increasing_id())).distinct().drop("ident", "lone")
    rows = materialise(rows, "values")
    parts = rows.select("word").mapInArrow(_sketch(groups), "cell int, counts binary")
    merged = parts.repartition("cell").mapInArrow(_merge, "cell int, counts binary").collect()  # ROWS x groups cells of 3 KB
    counts = np.zeros((ROWS, groups, PLACES, 16), np.int64)
    for cell, blob in merged:
        counts[cell // groups, cell % groups] = np.frombuffer(blob, np.int64).reshape(PLACES, 16)
    total = int(counts[0, :, 0].sum())
    least = max(share * total, 1)
    spelled = {w for row in range(ROWS) for g in range(groups) for w in _decode(counts[row, g], least) if groups_of(np.array([w], np.int64), row, groups)[0] == g}
    names = ["word"] if own or word is not None else ["word", "value"]

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy(*names).agg(F.count("*").alias("n_rows"))

    candidates = small(spark.createDataFrame([(w,) for w in spelled], "word bigint"), len(spelled))  # at most ROWS/share words for each group
    exact = materialise(counted(rows.join(candidates, "word", "left_semi")), "exact")
    doubtful = _unproved(counts, exact.groupBy("word").agg(F.sum("n_rows")).collect(), least, groups)
    if len(doubtful):  # words of these groups of the first row, counted one and all
        group = _group_udf(groups)(F.col("word"))
        rest = rows.join(candidates, "word", "left_anti").where(group.isin([int(g) for g in doubtful]))
        exact = exact.unionByName(counted(rest))
    name = value if own or word is not None else "value"
    picked = exact.where(F.col("n_rows") >= F.lit(share * total)).withColumn("share", F.col("n_rows") / F.lit(max(total, 1)))
    return picked.select(F.col(names[-1]).alias(name if word is None else "word"), "n_rows", "share").withColumnRenamed("value", value)


def _unproved(counts: np.ndarray, exact: list, least: float, groups: int) -> np.ndarray:
    """Groups of the first row that could hide a frequent word; none if any row proves that there is no such word."""
    left = counts.copy()
    if exact:
        words = np.array([w for w, _ in exact], np.int64)
        for row in range(ROWS):
            for g, spelled, n in zip(groups_of(words, row, groups), symbols(words), (n for _, n in exact)):
                left[row, g, np.arange(PLACES), spelled] -= n
    open_ = left.max(axis=3).min(axis=2) >= least  # ROWS x groups
    return np.flatnonzero(open_[0]) if open_.any(axis=1).all() else np.array([], np.int64)


def _group_udf(groups: int):
    @F.pandas_udf("int")
    def group(words):
        import pandas as pd

        return pd.Series(groups_of(words.to_numpy(), 0, groups).astype(np.int32))

    return group
