"""Dedup of long repeated byte strings by suffix order.

A string of ``length`` bytes that starts in two places is a repeat. Suffixes are
only compared where a repeat is possible:

* Each window of ``length`` bytes has a minimizer: the 64-byte gram of least hash in
  it. Neighbouring windows with one minimizer make a region. Equal windows
  have equal minimizers, so they lie in regions of one class.
* Regions of equal bytes are one content, whose bytes are sorted once. It stands in
  suffix order with two positions, those of its first and its last region.
* The contents are sorted by suffix, classes packed together: ranks of 8, 24, 72, ..
  bytes by prefix doubling, then the windows by their whole length. Longest previous
  factors follow from the longest common prefixes of neighbours in that order and from
  the previous and next smaller position, found by pointer jumping. The same array
  read from the last position to the first has the longest later factors. A window
  whose factor is long enough has an earlier copy, or a later one.
* What holds for the last region of a content holds for all but the first: the first
  one is before them, and what is before the last one in other contents is not needed.
* A class with very many contents (a common passage in ever new surroundings) would be
  too much for a task and is dealt out: its windows are grouped by 128-bit hash, after
  blocks of windows whose common core occurs once have been left out.

Keeping the first copy removes the windows with an earlier copy; keeping none
removes all windows that have another one. Order is by id, then position.

Defined cases: a null or short text has no repeat. Repeated rows are copies of one
another, but when the first copy is kept, all rows that equal it keep theirs. A null
id comes after all others. Texts of any length are read in parts that overlap by a
window; a part is 1 MiB. Columns of the input but the text are carried along. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import shuffle_tasks, spread, written
from tracewell.llm.spans import SPANS, cut, marked, spans_array

LENGTH = 400
GRAM = 64

# Contents of one class that are sorted in one task, bytes sorted at once, and
# windows of a block of a class that is too large.
CLASS_CONTENTS = 1_000
SORT_BYTES = 1 << 17
BLOCK_WINDOWS = 32

REGIONS = "mh long, c1 long, c2 long, doc long, mark long, start long, n int, m int"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n, size = len(values), 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    last = n - width + 1
    return np.minimum(values[:last], values[width - size : width - size + last])


def regions(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each region of texts laid end to end: hash of the minimizer, two hashes of
    the bytes, first window, number of windows, place of the minimizer from there,
    and the text it is in."""
    gram = min(GRAM, length)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none, none, none
    one = X.RangeHash(data, 1)
    hashes = X.mix((one.sums[gram:] - one.sums[: len(data) - gram + 1]) * one.down[: len(data) - gram + 1])
    bits = X._U(len(data).bit_length())
    places = np.arange(len(hashes), dtype=np.uint64)
    # Low bits are the place, so the first of equal minima is taken.
    least = _sliding_least((hashes >> bits << bits) | places, length - gram + 1)
    at = (least & ((X._U(1) << bits) - X._U(1))).astype(np.int64)
    sizes = np.diff(ends)
    full = sizes >= length
    edge = np.zeros(len(at) + 1, np.int8)
    np.add.at(edge, ends[:-1][full], 1)
    np.add.at(edge, (ends[1:][full] - length + 1), -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    # Two texts never share a minimizer's place, so a new text is a new region.
    starts = np.flatnonzero(new)
    stops = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    bound = stops - 1 + length
    owner = np.searchsorted(ends, starts, side="right") - 1
    return hashes[at[starts]], one.of(starts, bound), X.RangeHash(data, 2).of(starts, bound), starts, stops - starts, at[starts] - starts, owner


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Texts to work on together: the first one, a byte range and the offsets in it.

    A giant text comes in parts that overlap by all but one byte of a window.
    """
    for first, last in X.runs_of_texts(offsets, X.BLOCK_BYTES // 2):
        low, high = int(offsets[first]), int(offsets[last])
        if last - first > 1 or high - low <= X.BLOCK_BYTES:
            yield first, low, high, offsets[first : last + 1] - low
            continue
        for part in range(low, high, X.BLOCK_BYTES):
            stop = min(part + X.BLOCK_BYTES + length - 1, high)
            yield first, part, stop, np.array([0, stop - part])


def _regions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REGIONS.split(", ")]
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        docs, marks = X.ids_of(batch.column("doc")), X.ids_of(batch.column("mark"))
        for first, low, high, ends in _parts(offsets, length):
            mh, c1, c2, starts, n, m, owner = regions(data[low:high], ends, length)
            owner = owner + first
            places = starts + low - offsets[owner]
            columns = [X.as_long(mh), X.as_long(c1), X.as_long(c2), docs[owner], marks[owner], places, n.astype(np.int32), m.astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=names)


def _dense(values: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal ones alike."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.zeros(len(values), np.uint64)
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(values), np.uint64)
    ranks[order] = np.cumsum(new)
    return ranks


class SuffixOrder:
    """Windows of a byte string in the order of their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.starts, self.length, self.data = starts, length, data
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        value = np.zeros(len(data), np.uint64)
        step = min(8, length)
        for i in range(step):
            value = (value << X._U(8)) | padded[i : i + len(data)]
        # Ranks of runs of 8, 24, 72, .. bytes, as many ranks to a number as fit; runs
        # over the end count as they stand.
        self.ranks = {step: _dense(value)}
        while True:
            r = self.ranks[step]
            bits = max(len(r).bit_length(), 16)
            parts = min(64 // bits, length // step)
            if parts < 2:
                break
            value = np.zeros(len(r), np.uint64)
            for i in range(parts):
                behind = np.zeros(len(r), np.uint64)
                behind[: max(len(r) - i * step, 0)] = r[i * step :]
                value = (value << X._U(bits)) | behind
            step *= parts
            self.ranks[step] = _dense(value)
        top = self.ranks[step]
        pair = (top[starts] << X._U(32)) | top[starts + (length - step)]
        self.rank = _dense(pair)

    def common_prefixes(self, order: np.ndarray, least: int = 0) -> np.ndarray:
        """Longest common prefix of each window and the one before it, up to the length.

        Prefixes of no more than ``least`` bytes may come out as none.
        """
        a, b = self.starts[order[1:]], self.starts[order[:-1]]
        steps = [s for s in self.ranks if s <= least]
        if steps:
            r, out = self.ranks[max(steps)], np.zeros(len(order), np.int64)
            alike = np.flatnonzero(r[a] == r[b])
            out[alike + 1] = self._prefixes(order[alike + 1], order[alike])
            return out
        return np.concatenate([[0], self._prefixes(order[1:], order[:-1])])

    def _prefixes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b = self.starts[first], self.starts[second]
        got = np.zeros(len(a), np.int64)
        for step in sorted(self.ranks, reverse=True):
            r, end = self.ranks[step], len(self.ranks[step])
            for _ in range(3):
                room = got + step <= self.length
                same = room & (r[np.minimum(a + got, end - 1)] == r[np.minimum(b + got, end - 1)])
                got[same] += step
        # What is left is shorter than the shortest rank: byte by byte.
        going = np.ones(len(a), bool)
        for _ in range(min(self.ranks) - 1):
            at = np.minimum(got, self.length - 1)
            going &= (got < self.length) & (self.data[a + at] == self.data[b + at])
            got[going] += 1
        got[self.rank[first] == self.rank[second]] = self.length
        return got


def longest_previous_factors(order: np.ndarray, prefixes: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the longest prefix it shares with one at a smaller position,
    and that window (-1 if it shares nothing).

    Of all windows with smaller positions, the nearest ones before and after it in
    suffix order share the most. Both are found by jumping: a candidate that is
    not smaller is replaced by its own candidate, along with the least prefix on the way.
    """
    n = len(order)
    place = position[order]
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for direction in (-1, 1):
        jump = np.arange(n) + direction
        shared = prefixes.copy() if direction < 0 else np.append(prefixes[1:], 0)
        todo = np.flatnonzero(shared > 0)
        while True:
            step = jump[todo]
            # Sharing anything, the candidate is inside.
            going = place[step] > place[todo]
            todo, step = todo[going], step[going]
            if not len(todo):
                break
            # All read the state before the round, so a round doubles the jumps.
            least, target = np.minimum(shared[todo], shared[step]), jump[step]
            shared[todo], jump[todo] = least, target
            todo = todo[least > 0]
        ok = (jump >= 0) & (jump < n)
        ok &= place[np.where(ok, jump, 0)] < place
        better = ok & (shared > best)
        best[better], source[better] = shared[better], jump[better]
    lpf, sources = np.empty(n, np.int64), np.empty(n, np.int64)
    lpf[order] = best
    sources[order] = np.where(source >= 0, order[source], -1)
    return lpf, sources


def copies_of(
    data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, firsts: tuple[np.ndarray, np.ndarray],
    lasts: tuple[np.ndarray, np.ndarray], several: np.ndarray, length: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contents laid end to end: which windows of the first region have an earlier
    copy, which of them any, and which windows of the last region an earlier one.

    ``firsts`` and ``lasts`` are (id, start) of those regions; the last one counts where
    the content has ``several``.
    """
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    # One entry for each window of a first region, then those of the last regions.
    again = np.flatnonzero(np.repeat(several, counts))
    region = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(bounds[:-1], counts) + inside
    window = np.concatenate([np.arange(len(starts)), again])
    suffixes = SuffixOrder(data, starts, length)
    # Regions are disjoint, so their order is that of all their windows.
    sizes = np.concatenate([counts, np.where(several, counts, 0)])
    by_place = np.lexsort((np.concatenate([firsts[1], lasts[1]]), np.concatenate([firsts[0], lasts[0]])))
    base = np.empty(len(sizes), np.int64)
    base[by_place] = np.cumsum(sizes[by_place]) - sizes[by_place]
    position = np.concatenate([base[region] + inside, base[len(counts) + region[again]] + inside[again]])
    order = np.argsort((suffixes.rank[window] << X._U(32)) | position.astype(np.uint64))
    prefixes = suffixes.common_prefixes(window[order], min(GRAM, length - 1))
    earlier = longest_previous_factors(order, prefixes, position)[0] >= length
    later = longest_previous_factors(order, prefixes, len(position) - 1 - position)[0] >= length
    n, repeated = len(starts), np.zeros(len(starts), bool)
    repeated[again] = earlier[n:]
    return earlier[:n], earlier[:n] | later[:n], repeated


def _sorted(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contents in order of their class: the windows of each that have copies."""

    def flush(rows: list) -> pa.RecordBatch:
        _, c1, c2, raw, *numbers = zip(*rows, strict=True)
        bounds = np.cumsum([0, *map(len, raw)])
        doc, start, counts, last_doc, last_start, many = (np.array(x, np.int64) for x in numbers)
        data = np.frombuffer(b"".join(raw), np.uint8)
        flags = copies_of(data, bounds, counts, (doc, start), (last_doc, last_start), many > 1, length)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        of = lambda x: spans_array([X.spans_of(x[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return pa.record_batch([pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *map(of, flags)], names=["c1", "c2", "later", "shared", "again"])

    held, size = [], 0
    names = ("mh", "c1", "c2", "bytes", "doc", "start", "n", "last_doc", "last_start", "many")
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and held[-1][:3] == row[:3]:
                continue  # the slice of an equal row
            if size >= SORT_BYTES and held[-1][0] != row[0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the contents that are wanted of each text."""
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in SLICES.split(", ")]
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        out = []
        for i, (doc, wanted) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
            for w in wanted:
                at = offsets[i] + w["start"]
                raw = data[at : at + w["n"] - 1 + length].tobytes()
                out.append((w["mh"], w["c1"], w["c2"], doc, w["start"], w["n"], w["m"], w["large"], w["last_doc"], w["last_start"], w["many"], raw))
            if len(out) > 5_000 or (out and i == batch.num_rows - 1):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []


SLICES = (
    "mh long, c1 long, c2 long, doc long, start long, n int, m int, large boolean, "
    "last_doc long, last_start long, many int, bytes binary"
)


def blocks_of(data: np.ndarray, n: int, m: int, length: int, windows: int = BLOCK_WINDOWS):
    """First and last + 1 window of each block of a region, and its core's hash.

    Blocks are counted from the minimizer, so equal windows are in equal blocks. The
    core, all bytes that every window of such a block has, tells most of them apart.
    """
    windows = min(windows, length)
    block = (m - np.arange(n)) // windows
    edges = np.flatnonzero(np.diff(block, prepend=block[0] + 1, append=block[-1] - 1))
    first, last = edges[:-1], edges[1:]
    core = m - block[first] * windows
    hashes = X.RangeHash(data, 1).of(core, core + length - windows + 1)
    return first, last, X.mix(hashes + block[first].astype(np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ("c1", "c2", "doc", "start", "many", "n", "m", "bytes")
    kinds = [*[pa.int64()] * 5, *[pa.int32()] * 3, pa.binary()]
    for batch in batches:
        out = []
        for c1, c2, doc, start, many, n, m, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            first, last, keys = blocks_of(np.frombuffer(raw, np.uint8), n, m, length)
            for a, b, k in zip(first.tolist(), last.tolist(), X.as_long(keys).tolist(), strict=True):
                out.append((k, c1, c2, doc, start, many, a, b - a, raw[a : b - 1 + length]))
        if out:
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["k", "c1", "c2", "doc", "start", "many", "off", "n", "bytes"],
            )


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.packed(batch.column("bytes"))
        n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[:-1][row] + place
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        off = of("off") + place
        columns = [X.as_long(X.RangeHash(data, 1).of(at, at + length)), X.as_long(X.RangeHash(data, 2).of(at, at + length))]
        columns += [of("c1"), of("c2"), of("doc"), of("start") + off, off.astype(np.int32), of("many").astype(np.int32)]
        yield pa.record_batch([pa.array(c) for c in columns], names=["w1", "w2", "c1", "c2", "doc", "at", "off", "many"])


def _window_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(windows: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flags = np.zeros(max(windows, default=-1) + 1, bool)
        flags[windows] = True
        return X.spans_of(flags)

    for batch in batches:
        columns = [spans_array([spans(w) for w in batch.column(c).to_pylist()]) for c in ("later", "shared", "again")]
        yield pa.record_batch([batch.column("c1"), batch.column("c2"), *columns], names=["c1", "c2", "later", "shared", "again"])


# Windows of a content: those of its first region with an earlier copy and with any
# copy, those of its other regions.
FOUND = f"c1 long, c2 long, later {SPANS}, shared {SPANS}, again {SPANS}"


def _copies_in_large(large: DataFrame, length: int) -> DataFrame:
    """As _sorted, for classes of too many contents: no key gathers its rows here."""
    kind = "k long, c1 long, c2 long, doc long, start long, many int, off int, n int, bytes binary"
    blocks = written(large.mapInArrow(lambda it: _blocks(it, length), kind), "blocks")
    twice = written(blocks.groupBy("k").agg(F.sum("many").alias("all")).where("all > 1").select("k"), "twice")
    kind = "w1 long, w2 long, c1 long, c2 long, doc long, at long, off int, many int"
    windows = written(blocks.join(twice, "k").drop("k").mapInArrow(lambda it: _windows(it, length), kind), "windows")
    first = windows.groupBy("w1", "w2").agg(F.sum("many").alias("all"), F.min(F.struct("doc", "at")).alias("first")).where("all > 1")
    later = F.struct("doc", "at") != F.col("first")
    copies = windows.join(written(first, "first"), ["w1", "w2"]).select("c1", "c2", "off", later.alias("later"), (F.col("many") > 1).alias("again"))
    # One group is one content: at most as many windows as a region has.
    some = lambda flag: F.collect_list(F.when(F.col(flag), F.col("off"))).alias(flag)
    lists = copies.groupBy("c1", "c2").agg(some("later"), F.collect_list("off").alias("shared"), some("again"))
    return lists.mapInArrow(_window_spans, FOUND)


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for spans in batch.column("spans").to_pylist():
            lists.append(X.merged(np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64)))
        yield pa.record_batch([batch.column("doc"), batch.column("mark"), spans_array(lists)], names=["doc", "mark", "spans"])


def repeated_strings(
    df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_first: bool = True,
    class_contents: int = CLASS_CONTENTS,
) -> DataFrame:
    """(doc, mark, spans): the byte ranges of each text that repeats cover."""
    spark = df.sparkSession
    texts = spread(marked(df, id, text))
    found = written(texts.mapInArrow(lambda it: _regions(it, length), REGIONS), "regions")
    # Both sides of the joins are tables, so that Spark can split hot keys.
    twice = written(found.groupBy("mh").agg(F.count("*").alias("many")).where("many > 1").select("mh"), "twice")
    classes = written(found.join(twice, "mh"), "classes")
    place = F.struct("doc", "start", "mark")
    contents = classes.groupBy("mh", "c1", "c2").agg(
        F.when(F.count("*") > 1, 2).otherwise(1).alias("many"), F.min(place).alias("first"), F.max(place).alias("last"),
        F.first("n").alias("n"), F.first("m").alias("m"),
    )
    contents = written(contents, "contents")
    large = written(contents.groupBy("mh").agg(F.count("*").alias("contents")).where(F.col("contents") > class_contents).select("mh", F.lit(True).alias("large")), "large")
    wanted = contents.join(large, "mh", "left").select(
        F.col("first.doc").alias("doc"), F.col("first.mark").alias("mark"),
        F.struct(
            "mh", "c1", "c2", "first.start", "n", "m", F.coalesce("large", F.lit(False)).alias("large"),
            F.col("last.doc").alias("last_doc"), F.col("last.start").alias("last_start"), "many",
        ).alias("w"),
    )
    # A group is one text, which has no more regions than bytes.
    lists = written(wanted.groupBy("doc", "mark").agg(F.collect_list("w").alias("wanted")), "wanted")
    any_large = not large.isEmpty()
    # Equal rows of one id give a slice twice; what reads the slices skips it.
    slices = texts.join(lists.hint("merge"), ["doc", "mark"]).select("doc", "text", "wanted").mapInArrow(lambda it: _slices(it, length), SLICES)
    if any_large:
        slices = written(slices, "slices")
    small = slices.where("NOT large").repartition(shuffle_tasks(spark), "mh").sortWithinPartitions("mh", "c1", "c2")
    copies = small.mapInArrow(lambda it: _sorted(it, length), FOUND)
    if any_large:
        copies = copies.union(_copies_in_large(slices.where("large").dropDuplicates(["c1", "c2"]), length))
    copies = copies.where(F.size("shared") > 0).join(contents.select("c1", "c2", "first"), ["c1", "c2"])
    told = classes.join(written(copies, "copies"), ["c1", "c2"])
    windows = F.when(place == F.col("first"), F.col("later" if keep_first else "shared")).otherwise(F.col("again"))
    spans = told.select("doc", "mark", "start", F.explode(windows).alias("w")).select(
        "doc", "mark", F.struct((F.col("start") + F.col("w.start")).alias("start"), (F.col("start") + F.col("w.end") + (length - 1)).alias("end")).alias("span")
    )
    return spans.groupBy("doc", "mark").agg(F.collect_list("span").alias("spans")).mapInArrow(_merged_spans, f"doc long, mark long, spans {SPANS}")


def without_repeated_strings(
    df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "cut", length: int = LENGTH, keep_first: bool = True, **options: int
) -> DataFrame:
    """All rows, and a struct: n_bytes, spans (what goes), kept (the bytes left)."""
    return cut(df, repeated_strings(df, id, text, length, keep_first, **options), id, text, name)
