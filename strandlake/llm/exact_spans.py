"""Spans of at least a given length that stand letter for letter in several records.

Suffix automata of shards of the corpus give, for every position of a record streamed
through them, the longest suffix that occurs in the shard. To stream every record
through every shard costs corpus x corpus, so records are first routed:

* Seeds. Of the seed-mers in every window of the least length the one with the
  smallest hash is its seed. Equal windows have equal seeds, so a window whose seed
  stands in one record only is shared with none. Most of the corpus ends here.
* Windows. For what is left, whole windows are hashed, and those that stand in
  one record only go too. Seeds of repeats (a run of one letter) do not survive this.
* Shards. The stretches around one seed are a shard. Equal stretches are one class,
  however many records hold it. The automaton of a shard's classes is built, its
  states are marked with the classes and records in which they occur, and every
  class is streamed through it. A shard of one class needs no automaton.
* Crowded seeds. Where a seed has more than CROWD classes, each window of the least
  length is a class of its own, found by grouping the windows' letters: the work is
  linear in the classes, whatever their number.

Hashes only route; what comes out was matched letter by letter.

A reference set of limited size goes the direct way: spans_in_reference() sends each
shard's automaton to all executors and streams every record through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, hot_of, salted_join
from ..storage import materialise, ship

CHUNK = 1 << 18  # letters worked on at a time, some 40 MB
CROWD = 400
SHARD_LETTERS = 1 << 20  # of a reference in one automaton, at most some 60 MB
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTERS = "ACGT"
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(LETTERS):
    CODES[ord(_c)] = _i


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _least_places(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of each ``span`` values in a row, the first of equals; by windows of doubling width."""
    least, place, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        lower = least[step:] < least[:-step]
        least, place = np.where(lower, least[step:], least[:-step]), np.where(lower, place[step:], place[:-step])
        size += step
    return place


class Scanner:
    """The valid windows of a batch of sequences, a chunk of them at a time."""

    def __init__(self, least: int, seed: int):
        self.least, self.seed = least, seed
        self.up, self.down = _powers(BASE, CHUNK + least), _powers(INVERSE, CHUNK + least)

    def _hashes(self, sums: np.ndarray, k: int) -> np.ndarray:
        raw = (sums[k:] - sums[:-k]) * self.down[: len(sums) - k]
        return _mix(raw)

    def windows(self, text: pa.StringArray, whole: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(record, start, seed hash, seed start, hash of the window if asked for) of windows of A, C, G, T."""
        text = text.cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        flat = CODES[np.frombuffer(text.buffers()[2] or b"", np.uint8)]
        for first in range(int(offsets[0]), int(offsets[-1]), CHUNK):
            codes = flat[first : min(first + CHUNK + self.least - 1, int(offsets[-1]))]
            n = len(codes) - self.least + 1
            if n <= 0:
                continue
            at = np.arange(first, first + n)
            record = np.searchsorted(offsets, at, "right") - 1
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            fit = (at + self.least <= offsets[record + 1]) & (bad[self.least :] == bad[: -self.least])
            good = np.flatnonzero(fit)
            if not len(good):
                continue
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], dtype=np.uint64)])
            seeds = self._hashes(sums, self.seed)
            span = self.least - self.seed + 1
            place = _least_places(seeds, span)[good]
            start = at[good] - offsets[record[good]]
            yield record[good], start, seeds[place].view(np.int64), place + first - offsets[record[good]], self._hashes(sums, self.least)[good].view(np.int64) if whole else None


def _seeds(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(least, seed)
        for batch in batches:
            docs, owners = (batch.column(i).to_numpy() for i in (0, 1))
            for record, _, value, place, _ in scan.windows(batch.column(2), False):
                new = np.append(True, (record[1:] != record[:-1]) | (place[1:] != place[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(value[new]), pa.array(docs[record[new]]), pa.array(owners[record[new]])], ["key", "doc", "owner"])

    return run


def _members(keys: pa.ListArray, record: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is in its record's list; the record number is mixed into both, at worst a few too many stay."""
    lengths = keys.value_lengths().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lengths)), lengths).astype(np.uint64)
    held = _mix(keys.flatten().to_numpy().view(np.uint64) + of * BASE)
    return np.isin(_mix(value.view(np.uint64) + record.astype(np.uint64) * BASE), held)


def _windows(least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(least, seed)
        for batch in batches:
            docs, owners = (batch.column(i).to_numpy() for i in (0, 1))
            for record, _, value, _, whole in scan.windows(batch.column(2), True):
                hit = _members(batch.column(3), record, value)
                yield pa.RecordBatch.from_arrays([pa.array(whole[hit]), pa.array(docs[record[hit]]), pa.array(owners[record[hit]])], ["key", "doc", "owner"])

    return run


def _stretches(least: int, seed: int):
    """Per seed place of a record the stretch that its surviving windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(least, seed)
        for batch in batches:
            docs, owners, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            letters = memoryview(text.buffers()[2] or b"")
            for record, start, value, place, whole in scan.windows(text, True):
                hit = np.flatnonzero(_members(batch.column(3), record, whole))
                if not len(hit):
                    continue
                r, p = record[hit], place[hit]
                firsts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
                lasts = np.append(firsts[1:], len(hit)) - 1
                a, b, r = start[hit][firsts], start[hit][lasts] + least, r[firsts]
                pieces = [str(letters[x:y], "ascii") for x, y in zip(offsets[r] + a, offsets[r] + b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[hit][firsts]), pa.array(docs[r]), pa.array(owners[r]), pa.array(a), pa.array(pieces, pa.string())], ["key", "doc", "owner", "start", "text"]
                )

    return run


class SuffixAutomaton:
    """Of several texts over A, C, G, T; transitions of state s are at 4 s to 4 s + 3."""

    def __init__(self, texts: list[bytes]):
        self.next, self.link, self.length = [-1] * 4, [-1], [0]
        for text in texts:
            last = 0
            for c in text:
                last = self._extend(last, c)

    def _state(self, length: int, link: int, following: list[int]) -> int:
        self.next += following
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[4 * last + c]
        if known >= 0 and length[known] == length[last] + 1:
            return known
        if known >= 0:
            return self._clone(last, c, known)
        new = self._state(length[last] + 1, 0, [-1] * 4)
        p = last
        while p >= 0 and nxt[4 * p + c] < 0:
            nxt[4 * p + c] = new
            p = link[p]
        if p >= 0:
            q = nxt[4 * p + c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, link[q], nxt[4 * q : 4 * q + 4])
        link[q] = copy
        while p >= 0 and nxt[4 * p + c] == q:
            nxt[4 * p + c] = copy
            p = link[p]
        return copy

    def statistics(self, text: bytes, least: int) -> Iterator[tuple[int, int]]:
        """(end, state) for each end at which the longest match has at least the least length; the state is that of its suffix of the least length."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for i, c in enumerate(text):
            while state and nxt[4 * state + c] < 0:
                state = link[state]
                matched = length[state]
            if nxt[4 * state + c] >= 0:
                state = nxt[4 * state + c]
                matched += 1
            if matched >= least:
                at = state
                while length[link[at]] >= least:
                    at = link[at]
                yield i + 1, at


def match_shard(classes: list[tuple[int, bytes, int, int]], least: int) -> Iterator[tuple[int, int | None, int | None, int | None]]:
    """Links (a, b, null, null) between classes with a common window, a <= b, and shared spans (a, null, start, end).

    A class is (name, text, smallest and largest owner).
    """
    if len(classes) == 1:  # its records have all of it
        name, text, low, high = classes[0]
        if low < high and len(text) >= least:
            yield name, name, None, None
            yield name, None, 0, len(text)
        return
    automaton = SuffixAutomaton([c[1] for c in classes])
    held: dict[int, list] = {}
    ends = []  # of each class, so that it is streamed once
    for name, text, low, high in classes:
        own = list(automaton.statistics(text, least))
        ends.append(own)
        for _, state in own:
            mark = held.setdefault(state, [low, high, []])
            mark[0], mark[1] = min(mark[0], low), max(mark[1], high)
            if not mark[2] or mark[2][-1] != name:
                mark[2].append(name)
    for (name, *_), own in zip(classes, ends):
        linked, spans = set(), []
        for end, state in own:
            first, last, names = held[state]
            if first < last:
                linked.update(names)
                if spans and spans[-1][1] >= end - least:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([end - least, end])
        for other in linked:
            if name <= other:
                yield name, other, None, None
        for start, end in spans:
            yield name, None, start, end


def _match(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, classes, out = None, [], []

        def flush() -> None:
            if classes:
                out.extend((shard, *x) for x in match_shard(classes, least))

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["key", "a", "b", "span_start", "span_end"])

        table = bytes.maketrans(b"ACGT", bytes(range(4)))
        for batch in batches:
            for key, name, text, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if key != shard:
                    flush()
                    shard, classes = key, []
                classes.append((name, text.encode().translate(table), low, high))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        flush()
        if out:
            yield batch_of(out)

    return run


def _in_several(keyed: DataFrame) -> DataFrame:
    """keyed (key, doc, owner) without the keys of a single owner, as the list of keys of each doc."""
    several = keyed.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count("*").alias("n")).where("low < high")
    several = materialise(several, "several")
    kept = salted_join(keyed, several.select("key"), "key", "doc", "left_semi", hot=hot_of(several, "key", "n"))
    return kept.groupBy("doc").agg(F.collect_set("key").alias("keys"))  # no more than the doc has places


def _matches(df: DataFrame, ident: str, sequence: str, least: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc, owner, ident, text), members (class, doc, start) and matches (a, b, span_start, span_end); a class is named key:name."""
    ship(df.sparkSession)
    text = F.regexp_replace(F.upper(F.col(f"`{sequence}`")), "[^ACGT]", "N")
    docs = df.select(F.col(f"`{ident}`").alias("ident"), text.alias("text")).where(F.col("ident").isNotNull() & F.col("text").isNotNull()).distinct()
    docs = materialise(docs.select(F.monotonically_increasing_id().alias("doc"), F.xxhash64("ident").alias("owner"), "ident", "text"), "docs")
    cols, out = ["doc", "owner", "text"], "key bigint, doc bigint, owner bigint"
    seeds = materialise(docs.select(*cols).mapInArrow(_seeds(least, seed), out), "seeds")
    hit = docs.join(_in_several(seeds), "doc").select(*cols, "keys")
    whole = materialise(hit.mapInArrow(_windows(least, seed), out), "windows")
    hit = docs.join(_in_several(whole), "doc").select(*cols, "keys")
    stretches = hit.mapInArrow(_stretches(least, seed), f"{out}, start bigint, text string")
    stretches = materialise(stretches.withColumn("name", F.xxhash64("text")), "stretches")
    classes = materialise(stretches.groupBy("key", "name", "text").agg(F.min("owner").alias("low"), F.max("owner").alias("high")), "classes")
    crowded = classes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD)
    crowded = materialise(crowded, "crowded")
    named = F.concat_ws(":", "key", "name").alias("class")
    links = "key bigint, a bigint, b bigint, span_start bigint, span_end bigint"
    few, members = classes, stretches
    if some := not crowded.isEmpty():
        hot = hot_of(crowded, "key", "n")
        few, members = (salted_join(x, crowded.select("key"), "key", "name", "left_anti", hot=hot) for x in (classes, stretches))
    shards = few.select("key", "name", "text", "low", "high").repartition("key").sortWithinPartitions("key", "name")
    matches = shards.mapInArrow(_match(least), links)
    a, b = (F.concat_ws(":", "key", c) for c in ("a", "b"))
    matches = matches.select(a.alias("a"), F.when(F.col("b").isNotNull(), b).alias("b"), "span_start", "span_end")
    members = members.select(named, "doc", "start")
    if some:
        each = salted_join(stretches, crowded.select("key"), "key", "doc", "left_semi", hot=hot)
        each = each.select("key", "doc", "owner", "start", F.explode(F.sequence(F.lit(0), F.length("text") - least)).alias("i"), "text")
        each = each.select(F.concat_ws(":", "key", F.substring("text", F.col("i") + 1, F.lit(least))).alias("class"), "doc", "owner", (F.col("start") + F.col("i")).alias("start"))
        each = materialise(each, "crowd")
        several = each.groupBy("class").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.count("*").alias("n")).where("low < high")
        several = materialise(several, "shared")
        own = salted_join(each, several.select("class"), "class", "doc", "left_semi", hot=hot_of(several, "class", "n"))
        members = members.unionByName(own.select("class", "doc", "start"))
        none = F.lit(None).cast("bigint")
        matches = matches.unionByName(several.select(F.col("class").alias("a"), F.col("class").alias("b"), none.alias("span_start"), none.alias("span_end")))
        whole_window = several.select(F.col("class").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("span_start"), F.lit(least).cast("bigint").alias("span_end"))
        matches = matches.unionByName(whole_window)
    return docs, members, materialise(matches, "matches")


def shared_classes(df: DataFrame, ident: str, sequence: str, least: int = 120, seed: int = 64) -> tuple[DataFrame, DataFrame]:
    """The same as shared_pairs() without listing pairs: membership (class, ident) and links (a, b) of classes, a <= b.

    Two ids have a common stretch if they are members of linked classes; a class
    linked with itself joins all its members. Their size is that of the input,
    however many records hold a stretch.
    """
    docs, members, matches = _matches(df, ident, sequence, least, seed)
    links = matches.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = members.join(docs.select("doc", "ident"), "doc").select("class", "ident").distinct()
    return named, links


def shared_pairs(df: DataFrame, ident: str, sequence: str, least: int = 120, seed: int = 64) -> DataFrame:
    """Pairs of different ids, id_a < id_b, whose sequences have a common stretch of at least ``least`` letters A, C, G, T.

    Letter case does not count; any other letter matches nothing, not even itself.
    Rows with a null id or sequence, and sequences shorter than ``least``, pair with
    nothing. Repeated rows count once; of an id with several sequences each counts.
    An empty table gives no rows. ``seed`` (at most ``least``) trades routing effort for selectivity.
    Classes that hold many of the records are spread over many tasks, since their pairs are many.
    """
    named, links = shared_classes(df, ident, sequence, least, seed)
    named, links = materialise(named, "named"), materialise(links, "links")
    hot = hot_keys(named, "class")
    one, two = named.select("class", F.col("ident").alias("one")), named.select("class", F.col("ident").alias("two"))
    within = salted_join(one.join(links.where("a = b").select(F.col("a").alias("class")), "class", "left_semi"), two, "class", "one", on=F.col("one") < F.col("two"), hot=hot)
    across = salted_join(one, links.where("a <> b").select(F.col("a").alias("class"), "b"), "class", "one", hot=hot)
    across = salted_join(across.select("one", F.col("b").alias("class")), two, "class", "one", on=F.col("one") != F.col("two"), hot=hot)
    pairs = within.select("one", "two").unionByName(across.select("one", "two"))
    return pairs.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b")).distinct()


def _spans(docs: DataFrame, members: DataFrame, matches: DataFrame) -> DataFrame:
    """doc, first, last: the shared spans of each doc, those that overlap or touch joined to one."""
    spans = matches.where("b is null").select(F.col("a").alias("class"), "span_start", "span_end").distinct()
    placed = salted_join(members, spans, "class", "doc")
    return _joined(placed.select("doc", (F.col("start") + F.col("span_start")).alias("first"), (F.col("start") + F.col("span_end")).alias("last")))


def _joined(placed: DataFrame) -> DataFrame:
    """Spans (doc, first, last) with those that overlap or touch joined to one."""
    before = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.coalesce(F.max("last").over(before), F.lit(-1)) < F.col("first")).cast("int")
    number = F.sum("opens").over(Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.distinct().withColumn("opens", opens).withColumn("number", number)
    return numbered.groupBy("doc", "number").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("number")


def shared_bases(df: DataFrame, ident: str, sequence: str, least: int = 120, seed: int = 64) -> DataFrame:
    """Per id: ident, length and shared, how many of its letters lie in stretches shared with another id.

    As shared_pairs(); ids without a shared stretch have 0, and of an id with
    several sequences lengths and shared letters add up.
    """
    docs, members, matches = _matches(df, ident, sequence, least, seed)
    per_doc = _spans(docs, members, matches).groupBy("doc").agg(F.sum(F.col("last") - F.col("first")).alias("shared"))
    return docs.join(per_doc, "doc", "left").groupBy(F.col("ident").alias(ident)).agg(F.sum(F.length("text")).alias("length"), F.sum(F.coalesce("shared", F.lit(0))).alias("shared"))


def _cut(docs: DataFrame, spans: DataFrame, ident: str, sequence: str) -> DataFrame:
    of = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"))  # no more than the doc's length / least
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col("_spans.last"))
    begins = F.concat(F.col("_spans.first"), F.array(F.length("text").cast("bigint")))
    pieces = F.transform(ends, lambda e, i: F.substring("text", (e + 1).cast("int"), (F.get(begins, i) - e).cast("int")))
    left = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    cut = docs.join(of, "doc", "left").select("ident", F.length("text").alias("_length"), left.alias("_left"))
    return cut.select(F.col("ident").alias(ident), F.col("_left").alias(sequence), (F.col("_length") - F.length("_left")).alias("removed"))


def without_shared(df: DataFrame, ident: str, sequence: str, least: int = 120, seed: int = 64) -> DataFrame:
    """ident, sequence without its stretches shared with another id, and removed, the number of letters taken out.

    Each of an id's distinct sequences gives a row, in upper case, other letters than A, C, G, T as N. As shared_pairs() otherwise.
    """
    docs, members, matches = _matches(df, ident, sequence, least, seed)
    return _cut(docs, _spans(docs, members, matches), ident, sequence)


class ArrayAutomaton:
    """A SuffixAutomaton as arrays, through which many texts are streamed side by side."""

    def __init__(self, texts: list[bytes]):
        made = SuffixAutomaton(texts)
        self.next, self.link, self.length = np.array(made.next, np.int32), np.array(made.link, np.int32), np.array(made.length, np.int32)

    def matched(self, rows: np.ndarray) -> np.ndarray:
        """Matching statistics: for each place of each row (codes, 4 for any other letter) the longest suffix up to it that the texts have."""
        state = np.zeros(len(rows), np.int32)
        size = np.zeros(len(rows), np.int32)
        out = np.zeros(rows.shape, np.int32)
        for i in range(rows.shape[1]):
            c = rows[:, i]
            state[c > 3] = size[c > 3] = 0
            live = np.flatnonzero(c < 4)
            then = self.next[4 * state[live] + c[live]]
            while len(stuck := np.flatnonzero((then < 0) & (state[live] > 0))):
                at = live[stuck]
                state[at] = self.link[state[at]]
                size[at] = self.length[state[at]]
                then[stuck] = self.next[4 * state[at] + c[at]]
            on = live[then >= 0]
            state[on] = then[then >= 0]
            size[on] += 1
            out[:, i] = size
        return out


def _stream(sent, least: int):
    """Of (doc, start, text): spans (doc, first, last) of at least ``least`` letters that the broadcast automaton has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, begin = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [CODES[np.frombuffer(t.encode(), np.uint8)] for t in batch.column(2).to_pylist()]
            found = []
            order = np.argsort([len(t) for t in texts])
            for part in np.array_split(order, -(-len(order) // 512)):
                rows = np.full((len(part), len(texts[part[-1]])), 4, np.uint8)
                for k, i in enumerate(part):
                    rows[k, : len(texts[i])] = texts[i]
                size = sent.value.matched(rows)
                row, end = np.nonzero(size >= least)
                found.append((docs[part[row]], begin[part[row]] + end + 1 - size[row, end], begin[part[row]] + end + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], ["doc", "first", "last"])

    return run


def spans_in_reference(df: DataFrame, ident: str, sequence: str, reference: list[str], least: int = 120, piece: int = 2000) -> tuple[DataFrame, DataFrame]:
    """docs (doc, ident, text) and spans (doc, first, last): the maximal stretches of at least ``least`` letters that stand in a text of the reference.

    The reference is held by the caller, so it is of limited size; it is cut into shards of
    at most SHARD_LETTERS (a longer text into pieces that overlap by least - 1 letters), and every record is
    streamed through each shard's automaton, which is broadcast. Longer records are streamed in
    pieces that overlap in the same way, so one long record is not one task's work.
    Letter case and other letters as in shared_pairs().
    """
    spark = df.sparkSession
    ship(spark)
    text = F.regexp_replace(F.upper(F.col(f"`{sequence}`")), "[^ACGT]", "N")
    docs = df.select(F.col(f"`{ident}`").alias("ident"), text.alias("text")).where(F.col("ident").isNotNull() & F.col("text").isNotNull()).distinct()
    docs = materialise(docs.withColumn("doc", F.monotonically_increasing_id()), "docs")
    step = max(piece, 2 * least) - least + 1
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - least, F.lit(0)), F.lit(step))).alias("start")
    cut = docs.where(F.length("text") >= least).select("doc", starts, "text")
    cut = cut.select("doc", F.col("start").cast("bigint").alias("start"), F.substring("text", F.col("start") + 1, F.lit(step + least - 1)).alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc", "start")
    shards, size = [[]], 0
    for whole in reference:
        for run in "".join(c if c in LETTERS else " " for c in whole.upper()).split():
            for at in range(0, max(len(run) - least + 1, 0), SHARD_LETTERS - least + 1):
                part = run[at : at + SHARD_LETTERS].encode().translate(bytes.maketrans(b"ACGT", bytes(range(4))))
                if size + len(part) > SHARD_LETTERS and shards[-1]:
                    shards.append([])
                    size = 0
                shards[-1].append(part)
                size += len(part)
    found = None
    for texts in shards:
        if texts:
            sent = spark.sparkContext.broadcast(ArrayAutomaton(texts))
            one = materialise(cut.mapInArrow(_stream(sent, least), "doc bigint, first bigint, last bigint").groupBy("doc", "first").agg(F.max("last").alias("last")), "reference")
            sent.unpersist()
            found = one if found is None else found.unionByName(one)
    found = spark.createDataFrame([], "doc bigint, first bigint, last bigint") if found is None else found
    return docs, _joined(found)


def without_reference(df: DataFrame, ident: str, sequence: str, reference: list[str], least: int = 120) -> DataFrame:
    """ident, sequence without the stretches that stand in the reference, and removed; as spans_in_reference()."""
    docs, spans = spans_in_reference(df, ident, sequence, reference, least)
    return _cut(docs, spans, ident, sequence)
