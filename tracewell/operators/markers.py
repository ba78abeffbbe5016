"""Which texts contain which markers, by an index on q-grams.

A text that contains a marker contains each run of bytes (gram) of it. So a
marker is anchored on one of its grams, the one that the fewest texts have, and
a text is compared only with the markers whose anchor stands in it, at the place
where it stands. A marker has grams of the largest of ``SIZES`` that fits into
it: any marker, a word, a part of one, or a single character, can be looked up.

How many texts have a gram is counted over all texts first. A marker with a gram
that no text has is contained in none, and is looked for no further.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.skew import BROADCAST_CHARS, _written, salted_join

# Bytes of a gram. Each doubles the one before, and eight fit a number.
SIZES = (1, 2, 4, 8)

# Bytes of text that are looked at at once.
BLOCK = 1 << 20

# Bytes of texts whose grams a task holds at once.
PIECE = 2 << 20

# A filter has so many bits for a gram, and no more than so many in all.
BITS_EACH, MOST_BITS = 16, 1 << 27

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """The gram at each byte as a number, exact; none for the last size - 1 bytes."""
    out = data.astype(np.uint64)
    step = 1
    while step < size:
        out = out[:-step] | (out[step:] << np.uint64(8 * step)) if len(out) > step else out[:0]
        step *= 2
    return out


def size_of(length: int) -> int:
    """Bytes of the grams of a marker of so many bytes."""
    return max((s for s in SIZES if s <= length), default=0)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets in them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterable[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of at most ``PIECE`` bytes of text; a longer text is one by itself.

    What a task holds for the grams of its texts is bounded by the slice, not by the batch.
    """
    for batch in batches:
        _, ends = packed(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def windows(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of bounded size that overlap by less than a gram."""
    first, last = int(ends[0]), int(ends[-1])
    for at in range(first, last, BLOCK):
        yield at, min(at + BLOCK + SIZES[-1] - 1, last)


class Filter:
    """Tells quickly that a gram is not among the wanted ones; may err the other way."""

    def __init__(self, words: np.ndarray):
        self.words = words  # 64-bit words, a power of two of them
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    @staticmethod
    def bits_for(grams: int) -> int:
        return max(1 << 10, min(MOST_BITS, 1 << (grams * BITS_EACH).bit_length()))

    @staticmethod
    def of(grams: np.ndarray) -> Filter:
        bits = Filter.bits_for(len(grams))
        made = Filter(np.zeros(bits // 64, np.uint64))
        place = made.places(grams)
        np.bitwise_or.at(made.words, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        return made

    def places(self, grams: np.ndarray) -> np.ndarray:
        return (grams * _SCRAMBLE) >> self.shift

    def maybe(self, grams: np.ndarray) -> np.ndarray:
        place = self.places(grams)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def wanted_grams(
    data: np.ndarray, ends: np.ndarray, filters: dict[int, Filter]
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, text, place and gram wherever a filter lets one pass; grams never cross texts."""
    for at, stop in windows(ends):
        for size, chosen in filters.items():
            grams = codes(data[at:stop], size)[:BLOCK]
            places = np.flatnonzero(chosen.maybe(grams))
            grams = grams[places]
            places = places + at
            text = np.searchsorted(ends, places, side="right") - 1
            inside = places + size <= ends[text + 1]
            yield size, text[inside], places[inside], grams[inside]


# --- a table of markers small enough to be sent ------------------------------------


class Index:
    """Markers as bytes, by their number, and the grams they are anchored on."""

    def __init__(self, markers: Sequence[bytes]):
        self.markers = list(markers)
        self.grams: dict[int, np.ndarray] = {}
        owners: dict[int, list[np.ndarray]] = {s: [] for s in SIZES}
        values: dict[int, list[np.ndarray]] = {s: [] for s in SIZES}
        places: dict[int, list[np.ndarray]] = {s: [] for s in SIZES}
        for i, m in enumerate(self.markers):
            if not (size := size_of(len(m))):
                continue
            found, first = np.unique(codes(np.frombuffer(m, np.uint8), size), return_index=True)
            values[size].append(found)
            places[size].append(first)
            owners[size].append(np.full(len(found), i))
        # (gram, place in the marker, marker), of each size
        self.rows = {s: tuple(np.concatenate(x[s]) for x in (values, places, owners)) for s in SIZES if values[s]}
        self.grams = {s: np.unique(rows[0]) for s, rows in self.rows.items()}

    def filters(self) -> dict[int, Filter]:
        return {s: Filter.of(g) for s, g in self.grams.items()}

    def anchored(self, frequency: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each marker's rarest gram, its place and the marker, sorted by gram; of equals the one
        nearest the marker's start. Markers with a gram of frequency 0 are left out."""
        out = {}
        for size, (grams, places, owners) in self.rows.items():
            often = frequency[size][np.searchsorted(self.grams[size], grams)]
            order = np.lexsort((places, often, owners))
            first = order[np.flatnonzero(np.diff(owners[order], prepend=-1))]
            first = first[often[first] > 0]
            by_gram = first[np.argsort(grams[first], kind="stable")]
            if len(by_gram):
                out[size] = grams[by_gram], places[by_gram], owners[by_gram]
        return out

    def by_markers(self) -> dict[int, np.ndarray]:
        """How many markers have a gram: a guess where texts cannot be counted."""
        return {s: np.bincount(np.searchsorted(self.grams[s], rows[0]), minlength=len(self.grams[s])) for s, rows in self.rows.items()}


def _frequencies(texts: DataFrame, index: Index) -> dict[int, np.ndarray]:
    """How many texts have each gram of the markers."""
    offsets = dict(zip(index.grams, np.cumsum([0, *map(len, index.grams.values())]).tolist(), strict=False))
    total = sum(map(len, index.grams.values()))
    grams = index.grams

    def count(batches):
        counts = np.zeros(total, np.int64)
        filters = {s: Filter.of(g) for s, g in grams.items()}
        for batch in pieces(batches, 0):
            data, ends = packed(batch.column(0))
            seen: dict[int, list[np.ndarray]] = {s: [] for s in grams}
            for size, text, _, found in wanted_grams(data, ends, filters):
                known = grams[size]
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                seen[size].append(np.unique(text[hit] * len(known) + at[hit]))
            for size, parts in seen.items():
                if parts:
                    pairs = np.unique(np.concatenate(parts))
                    counts[offsets[size] : offsets[size] + len(grams[size])] += np.bincount(pairs % len(grams[size]), minlength=len(grams[size]))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["gram", "texts"])

    counts = np.zeros(total, np.int64)
    found = texts.select("__text").mapInArrow(count, "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))
    rows = found.toArrow()
    counts[rows.column("gram").to_numpy()] = rows.column("texts").to_numpy()
    return {s: counts[offsets[s] : offsets[s] + len(g)] for s, g in grams.items()}


def _search(batches, markers: list[bytes], anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Pairs of a row and the number of a marker its text contains, each once."""
    filters = {s: Filter.of(a[0]) for s, a in anchors.items()}
    lengths = np.array([len(m) for m in markers])
    for batch in pieces(batches, "__text"):
        data, ends = packed(batch.column("__text"))
        raw = data.tobytes() if len(data) else b""
        first, last = ends[:-1].tolist(), ends[1:].tolist()
        found: set[tuple[int, int]] = set()
        for size, text, place, gram in wanted_grams(data, ends, filters):
            grams, within, owners = anchors[size]
            low, high = np.searchsorted(grams, gram), np.searchsorted(grams, gram, side="right")
            times = high - low
            which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            text, start, owner = np.repeat(text, times), np.repeat(place, times) - within[which], owners[which]
            # A marker that is a gram has been found; the others are compared.
            whole = lengths[owner] == size
            for t, m in np.unique(np.stack([text[whole], owner[whole]], axis=1), axis=0).tolist():
                found.add((t, m))
            for t, s, m in zip(text[~whole].tolist(), start[~whole].tolist(), owner[~whole].tolist(), strict=True):
                if (t, m) not in found:
                    stop = s + len(markers[m])
                    if s >= first[t] and stop <= last[t] and raw[s:stop] == markers[m]:
                        found.add((t, m))
        pairs = sorted(found)
        rows = batch.column("__row").take(pa.array([t for t, _ in pairs], pa.int64()))
        yield pa.record_batch([rows, pa.array([m for _, m in pairs], pa.int64())], names=["__row", "__number"])


def found_by_index(texts: DataFrame, keep: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """``keep`` and ``__marker`` of each text that contains one of the markers (none empty).

    The markers are sent to every task, so the caller has checked their size.
    Texts are read twice and never moved; those of a stream, which can be read
    only once, go without counted frequencies.
    """
    markers = list(markers)
    raw = [m.encode() for m in markers]
    index = Index(raw)
    anchors = index.anchored(index.by_markers() if texts.isStreaming else _frequencies(texts, index))
    rows = texts.where("__text IS NOT NULL").select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("__row"), "__text")
    kind = rows.schema["__row"].dataType.simpleString()
    pairs = rows.mapInArrow(lambda it: _search(it, raw, anchors), f"__row {kind}, __number long")
    names = texts.sparkSession.createDataFrame(list(enumerate(markers)), "__number long, __marker string")
    kept = [F.col(f"__row.k{i}").alias(c) for i, c in enumerate(keep)]
    return pairs.join(F.broadcast(names), "__number").select(*kept, "__marker")


# --- more markers than can be sent -------------------------------------------------


def _marker_grams(batches):
    """Each gram of a marker once."""
    for batch in batches:
        markers = batch.column(0).to_pylist()
        out = [(m, s, np.unique(codes(np.frombuffer(m.encode(), np.uint8), s))) for m in markers if (s := size_of(len(m.encode())))]
        times = [len(g) for _, _, g in out]
        grams = np.concatenate([g for _, _, g in out]) if out else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(out)), times)
        yield pa.record_batch(
            [
                pa.array([m for m, _, _ in out], pa.string()).take(pa.array(owner)),
                pa.array(np.repeat([s for _, s, _ in out], times).astype(np.int32) if out else [], pa.int32()),
                pa.array(grams.view(np.int64)),
            ],
            names=["__marker", "size", "gram"],
        )


def _filters(grams: DataFrame) -> dict[int, Filter]:
    """A filter of each size, of at most ``MOST_BITS``, put together by Spark."""
    out = {}
    counts = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()}
    for size, n in counts.items():
        bits = Filter.bits_for(n)
        empty = Filter(np.zeros(bits // 64, np.uint64))

        def words(batches, empty=empty):
            for batch in batches:
                place = empty.places(batch.column(0).to_numpy().view(np.uint64))
                yield pa.record_batch(
                    [pa.array((place >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))],
                    names=["word", "bits"],
                )

        rows = (
            grams.where(F.col("size") == size).select("gram").mapInArrow(words, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        )
        empty.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        out[size] = empty
    return out


def _grams_of_texts(filters: dict[int, Filter], pairs: bool):
    """Distinct grams of each text that pass the filters, by text or counted."""

    def task(batches):
        for batch in pieces(batches, "__text"):
            data, ends = packed(batch.column("__text"))
            seen: dict[int, list[np.ndarray]] = {}
            for size, text, _, gram in wanted_grams(data, ends, filters):
                both = np.stack([text.astype(np.uint64), gram])
                seen.setdefault(size, []).append(np.unique(both, axis=1))
            for size, parts in seen.items():
                text, gram = np.unique(np.concatenate(parts, axis=1), axis=1)
                if pairs:
                    keys = batch.column("__key").take(pa.array(text.astype(np.int64)))
                else:
                    gram, n = np.unique(gram, return_counts=True)
                    keys = pa.array(n.astype(np.int64))
                yield pa.record_batch([keys, pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64))], names=["value", "size", "gram"])

    return task


def found_by_join(texts: DataFrame, keep: Sequence[str], markers: DataFrame, rows_per_task: int) -> DataFrame:
    """As ``found_by_index``, for any number of markers (a table of distinct ``__marker``, none empty).

    Only filters of bounded size are sent. Grams that pass meet the anchors by a
    join that deals out hot grams; texts move once, by a hash of theirs.
    """
    texts = texts.where("__text IS NOT NULL").withColumn("__key", F.xxhash64("__text"))
    schema = "value long, size int, gram long"
    grams = markers.select("__marker").mapInArrow(_marker_grams, "__marker string, size int, gram long")
    every = _filters(grams.select("size", "gram").distinct())
    frequency = texts.select("__text").mapInArrow(_grams_of_texts(every, False), schema).groupBy("size", "gram").agg(F.sum("value").alias("texts"))
    counted = grams.join(frequency, ["size", "gram"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    anchors = (
        counted.groupBy("__marker", "size").agg(F.min(F.struct("texts", "gram")).alias("rarest"))
        .where("rarest.texts > 0").select("__marker", "size", F.col("rarest.gram").alias("gram"))
    )
    # Tables, as each use of them would read all texts again.
    anchors = _written(anchors, "anchors")
    few = _filters(anchors.select("size", "gram").distinct())
    hits = texts.select("__key", "__text").mapInArrow(_grams_of_texts(few, True), schema).withColumnRenamed("value", "__key")
    hits = _written(hits, "grams")
    pairs = salted_join(hits, anchors, ["size", "gram"], "inner", ["__key"], rows_per_task).select("__key", "__marker").distinct()
    met = salted_join(texts, pairs, ["__key"], "inner", list(keep), rows_per_task)
    return met.where(F.contains("__text", "__marker")).select(*keep, "__marker")


def portions(markers: Iterable[str]) -> list[list[str]]:
    """Markers in lists of bounded length, for streams, which meet them one list after another."""
    out: list[list[str]] = [[]]
    chars = 0
    for m in markers:
        if chars + len(m) > BROADCAST_CHARS and out[-1]:
            out.append([])
            chars = 0
        out[-1].append(m)
        chars += len(m)
    return out

