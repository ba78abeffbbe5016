"""Line dedup: lines that many documents share stay in one of them only.

Method: every line's key is hashed to 128 bits; the hashes are range-partitioned
with a secondary sort by document (largest first) and position; each range is
streamed once, the first document of a key keeps its lines, later ones lose
them once a third document has been seen. What comes back is a compressed keep
bitmap per document that loses lines, never text. A second step lays the
bitmaps over the texts.

Defined cases: a null or empty text is one empty line. Rows of one ``id`` count
as one document, and all of them lose what it loses; rows without an id are in no
document and come back whole. Of lines with one key in one document all stay or
all go, so there are no ties. Texts of any length are read in parts of 1 MiB that end
at line breaks; a longer line is hashed block by block. Other columns of the input are carried along by
``without_repeated_lines`` and ignored by ``repeated_lines``; working columns
have names of their own, so nothing clashes. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import as_row, from_row, pick, pieces, row_type, spread, whole, written

# The contract's numbers.
MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3

# Lines of one range; more lines make more ranges, not longer ones.
RANGE_LINES = 500_000

LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])
LINES_DDL = "h1 long, h2 long, doc long, mark long, pos int"


def line_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, the text each is in and its place there."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([ends[:-1], breaks + 1])
    stops = np.concatenate([ends[1:], breaks])
    starts.sort()
    # A text's last line ends where the text does; an empty text has one line.
    stops.sort()
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(breaks, ends)) + 1)
    place = np.arange(len(starts)) - np.searchsorted(owner, owner)
    return starts, stops, owner, place


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Texts to work on together: the first one, where it starts, the offsets from there,
    and how many lines of the text came before.

    A text longer than a block comes in parts that end before a line break, each of
    about a block or of one longer line.
    """
    for first, last in X.runs_of_texts(offsets, X.BLOCK_BYTES):
        low, high = int(offsets[first]), int(offsets[last])
        if last - first > 1 or high - low <= X.BLOCK_BYTES:
            yield first, low, offsets[first : last + 1] - low, 0
            continue
        before = 0
        while True:
            at, stop, lines = low, high, 1
            while at + X.BLOCK_BYTES < high:
                breaks = np.flatnonzero(data[at : at + X.BLOCK_BYTES] == 0x0A)
                if len(breaks):
                    stop, lines = at + int(breaks[-1]), len(breaks)
                    if at > low:  # a line longer than a block, alone
                        stop, lines = at + int(breaks[0]), 1
                    break
                at += X.BLOCK_BYTES
            else:
                # The rest has no more than a block, or goes on a line that is longer.
                breaks = np.flatnonzero(data[at:high] == 0x0A)
                if at > low and len(breaks):
                    stop = at + int(breaks[0])
            yield first, low, np.array([0, stop - low]), before
            if stop == high:
                break
            low, before = stop + 1, before + lines


def _long_line(line: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the key of a line longer than a block, and its place, if it counts."""
    solid = ~X._IS_SPACE[line]
    if solid.any():
        key = line[int(solid.argmax()) : len(line) - int(solid[::-1].argmax())]
        if np.count_nonzero((key & 0xC0) != 0x80) >= least:
            return X.long_hash(key, 1), X.long_hash(key, 2), np.zeros(1, np.int64)
    none = np.empty(0, np.uint64)
    return none, none, none.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        docs, marks = X.ids_of(batch.column("doc")), X.ids_of(batch.column("mark"))
        for first, low, ends, before in _parts(data, offsets):
            block = X.lowered(data[low : low + ends[-1]])
            if len(block) > X.BLOCK_BYTES and len(ends) == 2 and not (block == 0x0A).any():
                h1, h2, place = _long_line(block, least)
                owner = place
            else:
                starts, stops, owner, place = line_bounds(block, ends)
                solid = np.flatnonzero(~X._IS_SPACE[block])
                left, right = np.searchsorted(solid, starts), np.searchsorted(solid, stops)
                some = np.flatnonzero(left < right)
                s, e = solid[left[some]], solid[right[some] - 1] + 1
                points = np.concatenate([[0], np.cumsum((block & 0xC0) != 0x80)])
                long = points[e] - points[s] >= least
                some, s, e = some[long], s[long], e[long]
                h1, h2 = X.RangeHash(block, 1).of(s, e), X.RangeHash(block, 2).of(s, e)
                owner, place = owner[some], place[some]
            at = first + owner
            yield pa.record_batch([X.as_long(h1), X.as_long(h2), docs[at], marks[at], (before + place).astype(np.int32)], schema=LINES)


def line_keys(texts: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """(h1, h2, doc, mark, pos) of every line with a long enough key.

    ``texts`` has doc, mark and text; mark tells texts of one id apart.
    """
    return texts.where("doc IS NOT NULL").mapInArrow(lambda it: _keys(it, min_code_points), LINES_DDL)


# Lines of one key that a range holds on to before it passes them on as open.
HELD_LINES = 50_000


def _stream(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Lines to drop (kind 0) and lines this range cannot decide (kind 1).

    The last key of a batch waits for the next one, so every other key is seen
    whole. The first and the last key of the range may go on in a neighbour, and
    a key of very many lines is not held: their lines come back as open.
    """

    def rows(columns: np.ndarray, kind: int) -> pa.RecordBatch:
        arrays = [pa.array(np.full(columns.shape[1], kind, np.int8))]
        arrays += [pa.array(columns[i]) for i in range(4)] + [pa.array(columns[4].astype(np.int32))]
        return pa.record_batch(arrays, names=["kind", *LINES.names])

    held = np.empty((5, 0), np.int64)
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in LINES.names])
        columns = np.concatenate([held, columns], axis=1)
        if open_key is None:
            open_key = columns[0, 0], columns[1, 0]
        is_open = (columns[0] == open_key[0]) & (columns[1] == open_key[1])
        if is_open.any():
            yield rows(columns[:, is_open], 1)
            columns = columns[:, ~is_open]
        if not columns.shape[1]:
            held = columns
            continue
        h1, h2, doc = columns[:3]
        last = (h1 == h1[-1]) & (h2 == h2[-1])
        held, columns = columns[:, last], columns[:, ~last]
        if held.shape[1] > HELD_LINES:
            yield rows(held, 1)
            open_key, held = (held[0, 0], held[1, 0]), held[:, :0]
        if columns.shape[1]:
            drop = later_lines(*columns[:3], least)
            if drop.any():
                yield rows(columns[:, drop], 0)
    if held.shape[1]:
        yield rows(held, 1)


def later_lines(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Which of the sorted lines are not of their key's first document.

    Only keys that ``least`` documents have count.
    """
    new_key = np.ones(len(h1), bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    key = np.cumsum(new_key) - 1
    number = np.cumsum(new_doc)
    number -= number[np.flatnonzero(new_key)][key] - 1
    total = np.zeros(key[-1] + 1, np.int64)
    np.maximum.at(total, key, number)
    return (number > 1) & (total[key] >= least)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            keep = np.ones((max(places) + 8) // 8 * 8, bool)
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch.column("doc"), batch.column("mark"), pa.array(maps, pa.binary())], names=["doc", "mark", "keep"])


def repeated_lines(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
    range_lines: int = RANGE_LINES,
) -> DataFrame:
    """Keep bitmaps: (doc, mark, keep) for each text that loses lines.

    ``keep`` is zlib-compressed, one bit a line from the first on, 1 for lines
    that stay; lines beyond its end stay. ``mark`` is the 64-bit hash of the text.
    """
    spark = df.sparkSession
    texts = spread(pick(df, doc=id, text=text)).select(F.col("doc").cast("long"), F.xxhash64(whole("text")).alias("mark"), whole("text").alias("text"))
    lines = written(line_keys(texts, min_code_points), "lines")
    ranges = pieces(spark, lines.count(), range_lines)
    ordered = lines.repartitionByRange(ranges, "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "mark", "pos")
    streamed = written(ordered.mapInArrow(lambda it: _stream(it, min_documents), f"kind byte, {LINES_DDL}"), "streamed")
    # Keys at the edges of ranges: few keys, any number of lines. Counted with
    # partial aggregation; their lines are joined, which AQE can split.
    undecided = streamed.where("kind = 1").drop("kind")
    shared = (
        undecided.select("h1", "h2", "doc").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_documents).select("h1", "h2", "keeper")
    )
    late = undecided.join(shared, ["h1", "h2"]).where("doc <> keeper")
    dropped = streamed.where("kind = 0").select("doc", "mark", "pos").unionByName(late.select("doc", "mark", "pos"))
    # One group is one text, so the lists are bounded by its lines.
    places = dropped.groupBy("doc", "mark").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(_bitmaps, "doc long, mark long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[list[str], int]:
    """The lines of a text that its bitmap keeps, and how many there were."""
    lines = text.split("\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, totals, drops = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            lines, total = kept_lines(text, keep)
            texts.append(text if len(lines) == total else "\n".join(lines))
            totals.append(total)
            drops.append(total - len(lines))
        yield pa.record_batch(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(drops, pa.int64())],
            names=["row", "kept", "n_lines", "n_dropped"],
        )


def without_repeated_lines(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    counts: str | None = None,
    **options: int,
) -> DataFrame:
    """All rows and columns, the text without the lines that its bitmap drops.

    ``counts`` names a struct column to add: n_lines before dropping, n_dropped.
    """
    bitmaps = repeated_lines(df, id, text, **options).toDF("of_doc", "of_mark", "keep")
    others = [c for c in df.columns if c not in (text, counts)]
    texts = df.select(as_row(others), F.col(f"`{id}`").cast("long").alias("doc"), whole(F.col(f"`{text}`")).alias("text"))
    joined = texts.join(bitmaps, (F.col("doc") == F.col("of_doc")) & (F.xxhash64("text") == F.col("of_mark")), "left")
    rows = joined.select("row", "text", "keep")
    out = rows.mapInArrow(_apply, f"{row_type(rows)}, kept string, n_lines long, n_dropped long")
    by_name = dict(zip(others, from_row(others), strict=True)) | {text: F.col("kept").alias(text)}
    columns = [by_name[c] for c in df.columns if c in by_name]
    if counts:
        columns.append(F.struct("n_lines", "n_dropped").alias(counts))
    return out.select(*columns)
