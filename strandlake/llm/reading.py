"""Reading level by a familiar-word formula.

Difficulty grows with the share of words outside a list of familiar words and with the
average length of sentences. A word is familiar if it stands in at least a given share
of all documents, whoever wrote or rated them; the list is a matter of document
frequency alone. How common a word must be to count as familiar is not known
beforehand, so there are LISTS nested lists, from words of nearly every document to
words of one document in two hundred, and the formula weighs the shares outside each.
Its weights, for each step of the scale, are fitted on rated documents.

Mark-up is dropped, a line end ends a sentence, letter case is ignored, and
strings that are no words (numbers, codes with digits, sequence letters) do not
count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise, ship

LISTS = 88
COMMONEST, RAREST = 0.98, 0.005  # shares of all documents: the bounds of the first and of the last list
BOUNDS = np.exp(np.linspace(np.log(COMMONEST), np.log(RAREST), LISTS))
SHOWN = int(np.argmin(abs(BOUNDS - 0.05)))  # the list that the result's ``unfamiliar`` refers to
MOST_RATED = 20_000
LEVELS = 5
STEPS = range(1, LEVELS)  # step c parts the levels up to c from those above
LAY = 3  # levels up to this one are for lay readers

MARKUP = re.compile(r"<[^<>]*>|&[a-zA-Z]{2,8};|https?://\S+")
LETTERS = re.compile(r"\b[ACGTUN]{8,}\b")
WORD = re.compile(r"(?<![^\W_])[^\W\d_]+(?:['’][^\W\d_]+)*(?![^\W_])")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[\r\n]+")
LETTER = re.compile(r"[^\W\d_]")


def plain(text: str) -> str:
    """Lower case text without mark-up and without runs of sequence letters."""
    if "<" in text or "&" in text or "://" in text:
        text = MARKUP.sub(" ", text)
    return LETTERS.sub(" ", text).lower()


def words(text: str) -> list[str]:
    """The words of a plain() text."""
    return WORD.findall(text)


def sentence_count(text: str) -> int:
    """Stretches with a word in them between full stops, question and exclamation marks and line ends."""
    return sum(1 for s in SENTENCE.split(text) if LETTER.search(s))


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (ident, text): ident, sentences, the distinct words and how often each occurs."""
    for batch in batches:
        sentences, sizes, found, times = [], [0], [], []
        for text in batch.column(1):
            text = plain(text.as_py() or "")
            counted = Counter(words(text))
            sentences.append(sentence_count(text))
            found.extend(counted.keys())
            times.extend(counted.values())
            sizes.append(len(found))
        at = pa.array(sizes, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((found, pa.string()), (times, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sentences, pa.int32()), *lists], ["ident", "sentences", "words", "times"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists of distinct words: word and the documents of the batch that have it."""
    for batch in batches:
        counts = pc.value_counts(batch.column(0).flatten())
        yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["word", "n"])


def _shares(place: dict[str, int]):
    """Of taken-apart documents: ident, n_words, sentence (mean words) and the shares of words outside each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists, times = batch.column(2), batch.column(3).flatten().to_numpy()
            own = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            first = np.array([place.get(w, LISTS) for w in coded.dictionary.to_pylist()], np.int64)  # the first list that has the word
            seen = np.bincount(own * (LISTS + 1) + first[coded.indices.to_numpy()] if len(own) else own, times, n * (LISTS + 1)).reshape(n, LISTS + 1)
            total = seen.sum(axis=1)
            some = np.maximum(total, 1)
            outside = 1 - np.cumsum(seen[:, :LISTS], axis=1) / some[:, None]
            mean = total / np.maximum(batch.column(1).to_numpy(), 1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(outside.ravel()), LISTS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.astype(np.int64)), pa.array(mean), flat], ["ident", "n_words", "sentence", "outside"])

    return run


def _familiar(apart: DataFrame) -> dict[str, int]:
    """word to the first of the lists that has it, from the document frequencies over all documents.

    The words of a document are counted once, so at most (mean distinct words of a
    document) / RAREST words stand in that share of the documents: for texts of 1,000
    distinct words at most 200,000, however many documents there are. They come to the
    driver; all rarer words, whose number grows with the corpus, do not.
    """
    n = apart.where(F.size("words") > 0).count()
    counts = apart.select("words").mapInArrow(_document_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    common = counts.where(F.col("n") >= F.lit(RAREST * n)).collect()
    return {r["word"]: int(np.argmax(BOUNDS * n <= r["n"] + 1e-9)) for r in common}


def _design(outside, sentence) -> np.ndarray:
    return np.column_stack([np.asarray(outside, float).reshape(-1, LISTS), np.log1p(np.asarray(sentence, float))])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of the columns of x, then the constant; the ridge is on standardised columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, hold = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(hold), z.T @ (p - y) + hold * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    own = w[:-1] / spread
    return np.append(own, w[-1] - own @ mean)


def _above(weights: np.ndarray) -> Column:
    """Whether a step's formula puts the document above it."""
    dot = F.aggregate(F.zip_with("outside", F.array(*(F.lit(float(w)) for w in weights[:LISTS])), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return dot + F.lit(float(weights[LISTS])) * F.log1p("sentence") + F.lit(float(weights[-1])) > 0


def reading_levels(df: DataFrame, ident: str, text: str, ratings: DataFrame) -> DataFrame:
    """Each document's ident, unfamiliar, sentence, level (1 to 5) and specialist (whether it is above level LAY).

    ``unfamiliar`` is the share of words that stand in fewer than a twentieth of all documents, ``sentence`` the mean words of a sentence.
    ``ratings``: ident, rater, level. A rater's repeated rating counts once, null
    levels not at all, and of several the median holds. The weights are fitted on at most MOST_RATED
    rated documents, taken by the hash of their id; all else covers all documents.
    A text that is null, empty or without words gets nulls. Repeated rows of df count
    once. With no ratings of both kinds level and specialist are null. An empty table gives
    no rows.
    """
    spark = df.sparkSession
    ship(spark)
    base = df.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{text}`").alias("text"))
    if not base.groupBy("ident").count().where("count > 1").isEmpty():  # else whole texts need not be shuffled
        base = base.distinct()
    key = base.schema["ident"].dataType.simpleString()
    apart = materialise(base.mapInArrow(_take_apart, f"ident {key}, sentences int, words array<string>, times array<int>"), "words")
    shares = materialise(apart.mapInArrow(_shares(_familiar(apart)), f"ident {key}, n_words bigint, sentence double, outside array<double>"), "shares")
    median = ratings.where("level is not null and ident is not null").select("ident", "rater", "level").distinct().groupBy("ident").agg(F.median("level").alias("rated"))
    rated = shares.where("n_words > 0").join(median, "ident").orderBy(F.xxhash64("ident"), "ident").limit(MOST_RATED).collect()
    some = F.col("n_words") > 0
    unfamiliar, sentence = (F.when(some, c) for c in (F.get("outside", SHOWN), F.col("sentence")))
    level, above = F.lit(None).cast(T.IntegerType()), F.lit(None).cast(T.BooleanType())
    if len({r["rated"] > LAY for r in rated}) == 2:
        x, y = _design([r["outside"] for r in rated], [r["sentence"] for r in rated]), np.array([float(r["rated"]) for r in rated])
        steps = {c: _above(_logistic(x, (y > c).astype(float))) for c in STEPS}
        low, high = (sum((steps[c].cast("int") for c in STEPS if side(c)), F.lit(first)) for side, first in ((lambda c: c < LAY, 1), (lambda c: c > LAY, LAY + 1)))
        above = F.when(some, steps[LAY])
        level = F.when(some, F.when(steps[LAY], high).otherwise(low))
    return shares.select(F.col("ident").alias(ident), unfamiliar.alias("unfamiliar"), sentence.alias("sentence"), level.alias("level"), above.alias("specialist"))
