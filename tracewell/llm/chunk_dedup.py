"""Substring dedup by content-defined chunks.

Method: a gear hash rolls over the bytes of a text; where some of its bits are zero
a chunk ends, if it is not too short, and a chunk that grows too long is cut. The
cuts follow the content, so an insertion changes the chunks around it and no others.
Chunks are told apart by their digest; the first copy (least id, then least
position) stays, later ones go, within a text as well.

A run of repeated chunks then grows to both sides, byte by byte, as far as the text
goes on like the first copy of the chunk at that edge, so the parts of a passage that
share chunks with its surroundings are found as well. The bytes at an edge are fetched
in rounds, more of them for the edges that are not done.

Only runs that are long enough once grown count, so a stock phrase is left alone.
Chunks are counted by digest with partial aggregation; only those found twice
are joined back, which AQE can split however many copies there are. A repeated passage
in which no chunk lies whole in two copies is not found: the chunks are small, so that
this is rare from 50 words on (measured in the README).

Defined cases: a null or empty text has no chunks. Repeated rows (equal id and
text) count once and are all cut alike. A null id comes after all others. Columns of the input but the text are carried along. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import spread, written
from tracewell.llm.spans import NO_ID, SPANS, cut, marked, spans_array

# Bytes: the gear hash's memory, least and most of a chunk, and least of a grown run of
# repeated chunks. One position in 16 may end a chunk, so chunks have 32 on average.
WINDOW = 16
MIN_CHUNK = 16
MAX_CHUNK = 256
MIN_RUN = 96
CUT_BITS = X._U(0b1111 << 27)

GEAR = X.mix(np.arange(1, 257, dtype=np.uint64) * X._ODD)

# Bytes first fetched at an edge of a run, and how many times more in each later round.
NEAR = 256
NEAR_TIMES = 8
# Room to the right of a text's last run: its length is not known there.
NO_END = 1 << 40

CHUNKS = "d1 long, d2 long, doc long, mark long, start long, size int"
EDGES = "doc long, mark long, at long, right boolean, room long, of_doc long, of_mark long, of_at long"


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Sum of the gear values of the last WINDOW bytes, each shifted by its age."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] = h[step:] + (h[:-step] << X._U(step)) if len(h) > step else h[step:]
        step *= 2
    return h


def chunk_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of the chunks of texts laid end to end, and their text."""
    marks = np.flatnonzero((gear_hash(data) & CUT_BITS) == 0) + 1
    first = np.searchsorted(marks, ends[:-1], side="right").tolist()
    last = np.searchsorted(marks, ends[1:], side="left").tolist()
    places, bounds = marks.tolist(), ends.tolist()
    starts, stops, owner = [], [], []
    for i in range(len(first)):
        at, end = bounds[i], bounds[i + 1]
        for place in (*places[first[i] : last[i]], end):
            while place - at > MAX_CHUNK:
                starts.append(at)
                at += MAX_CHUNK
                stops.append(at)
                owner.append(i)
            # A mark within the first bytes knows bytes of the text before: too short anyway.
            if place - at >= MIN_CHUNK or (place == end and place > at):
                starts.append(at)
                stops.append(place)
                owner.append(i)
                at = place
    return starts, stops, owner


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        docs, marks = X.ids_of(batch.column("doc")), X.ids_of(batch.column("mark"))
        for first, last in X.runs_of_texts(offsets):
            block = data[offsets[first] : offsets[last]]
            ends = offsets[first : last + 1] - offsets[first]
            starts, stops, owner = chunk_bounds(block, ends)
            raw = block.tobytes()
            digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts, stops, strict=True)])
            two = np.frombuffer(digests, np.int64).reshape(-1, 2)
            owner, starts, stops = np.array(owner, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)
            size = stops - starts
            whole_ = size >= MIN_CHUNK
            columns = [two[:, 0], two[:, 1], docs[first:last][owner], marks[first:last][owner], starts - ends[owner], size.astype(np.int32)]
            yield pa.record_batch([pa.array(c[whole_]) for c in columns], names=names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where runs of repeated chunks begin and end, if a later copy does, and the place in the first copy."""
    names = [c.split()[0] for c in EDGES.split(", ")]
    for batch in batches:
        out = []
        for doc, mark, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "chunks")), strict=True):
            chunks.sort(key=lambda c: c["start"])
            for i, c in enumerate(chunks):
                start, end, first = c["start"], c["start"] + c["size"], c["first_start"]
                before = chunks[i - 1]["start"] + chunks[i - 1]["size"] if i else 0
                after = chunks[i + 1]["start"] if i + 1 < len(chunks) else NO_END
                if c["again"] and before < start and first:
                    out.append((doc, mark, start, False, start - before, c["first_doc"], c["first_mark"], first))
                if c["again"] and end < after:
                    out.append((doc, mark, end, True, after - end, c["first_doc"], c["first_mark"], first + c["size"]))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, pa.bool_() if n == "right" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before or after the asked places of each text."""
    kinds = {"doc": pa.int64(), "mark": pa.int64(), "at": pa.int64(), "right": pa.bool_(), "near": pa.binary()}
    made = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        rows, held = [], 0
        for i, (doc, mark, places) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "places")), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            for p in places:
                at, ask = p["at"], p["ask"]
                near = (text[at : at + ask] if p["right"] else text[max(at - ask, 0) : at]).tobytes()
                rows.append((doc, mark, at, p["right"], near))
                held += len(near)
                if held > X.BLOCK_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)


def alike(a: bytes, b: bytes, right: bool) -> int:
    """How many bytes two strings share at their beginnings, or else at their ends."""
    n = min(len(a), len(b))
    a, b = (a[:n], b[:n]) if right else (a[len(a) - n :][::-1], b[len(b) - n :][::-1])
    if a == b:
        return n
    return int((np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)).argmax())


def _lengths(batches: Iterator[pa.RecordBatch], near: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EDGES.split(", ")]
    for batch in batches:
        lengths = [alike(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("near", "of_near", "right")), strict=True)]
        more = [n == near and near < room for n, room in zip(lengths, batch.column("room").to_pylist(), strict=True)]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(lengths, pa.int64()), pa.array(more, pa.bool_())], names=[*names, "length", "more"])


def _grown(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges, and the length to which each grows: all that is alike."""
    columns = [c.split()[0] for c in EDGES.split(", ")]
    done, near = None, NEAR
    while True:
        ask = F.least("room", F.lit(near)).alias("ask")
        own = edges.select("doc", "mark", "at", "right", ask)
        of = edges.select(F.col("of_doc").alias("doc"), F.col("of_mark").alias("mark"), F.col("of_at").alias("at"), "right", ask)
        places = own.union(of).groupBy("doc", "mark", "at", "right").agg(F.max("ask").alias("ask"))
        # A group is the places of one text, at most two for each of its chunks.
        lists = written(places.groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "right", "ask")).alias("places")), "places")
        asked = texts.join(lists, ["doc", "mark"]).select("doc", "mark", "places", "text")
        # Repeated rows answer alike.
        found = written(asked.mapInArrow(_near, "doc long, mark long, at long, right boolean, near binary").distinct(), "near")
        there = found.select(*[F.col(c).alias(f"of_{c}") for c in ("doc", "mark", "at", "near")], F.col("right"))
        both = edges.join(found, ["doc", "mark", "at", "right"]).join(there, ["of_doc", "of_mark", "of_at", "right"])
        # What is asked for the first copy serves several edges: one may ask for less.
        sides = both.select(*columns, "near", "of_near")
        out = written(sides.mapInArrow(lambda it, n=near: _lengths(it, n), f"{EDGES}, length long, more boolean"), "grown")
        ready = out.where("NOT more").select(*columns, "length")
        done = ready if done is None else done.union(ready)
        edges, near = out.where("more").select(*columns), near * NEAR_TIMES
        if edges.isEmpty():
            return done


def runs(starts: np.ndarray, ends: np.ndarray, again: np.ndarray, min_run: int):
    """Of a text's repeated ranges: bytes in long enough runs, what of them goes, and the ranges that do."""
    first, last = X.merged(starts, ends)
    run = np.searchsorted(first, starts, side="right") - 1
    long = (last - first >= min_run)[run] if len(first) else again
    gone = long & again
    return int((last - first)[last - first >= min_run].sum()), X.merged(starts[gone], ends[gone]), np.flatnonzero(gone)


def _per_text(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, spans, sources = [], [], []
        for chunks, grown in zip(batch.column("chunks").to_pylist(), batch.column("grown").to_pylist(), strict=True):
            ranges = [(c["start"], c["start"] + c["size"], c["again"]) for c in chunks]
            ranges += [(g["at"], g["at"] + g["length"], g["again"]) if g["right"] else (g["at"] - g["length"], g["at"], g["again"]) for g in grown or () if g["length"]]
            starts, ends, again = (np.array(c, k) for c, k in zip(zip(*ranges, strict=True), (np.int64, np.int64, bool), strict=True))
            n, gone, which = runs(starts, ends, again, min_run)
            shared.append(n)
            spans.append(gone)
            sources.append(sorted({chunks[i]["first_doc"] for i in which if i < len(chunks)} - {NO_ID}))
        yield pa.record_batch(
            [batch.column("doc"), batch.column("mark"), spans_array(spans), pa.array(shared, pa.int64()), pa.array(sources, pa.list_(pa.int64()))],
            names=["doc", "mark", "spans", "n_shared", "sources"],
        )


def repeated_chunks(df: DataFrame, id: str = "doc_id", text: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc, mark, spans, n_shared, sources) of each text with a repeated chunk.

    ``spans`` go; ``n_shared`` counts the bytes that are found elsewhere too, those
    that stay as first copies included; ``sources`` are the ids of the first copies.
    """
    texts = spread(marked(df, id, text))
    chunks = texts.mapInArrow(_chunks, CHUNKS)
    twice = chunks.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    repeats = written(chunks.join(twice, "d1").distinct(), "repeats")
    first = repeats.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start", "mark")).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = repeats.join(first, ["d1", "d2"]).select(
        "doc", "mark",
        F.struct(
            "start", "size", (F.struct("doc", "start", "mark") != F.col("first")).alias("again"),
            F.col("first.doc").alias("first_doc"), F.col("first.mark").alias("first_mark"), F.col("first.start").alias("first_start"),
        ).alias("chunk"),
    )
    # A group is one text: its list is bounded by its length.
    lists = written(copies.groupBy("doc", "mark").agg(F.collect_list("chunk").alias("chunks")), "lists")
    grown = _grown(written(lists.mapInArrow(_edges, EDGES), "edges"), texts)
    # What a copy has in common with the first one beyond their chunks is shared there, too.
    first = grown.groupBy("of_doc", "of_mark", "of_at", "right").agg(F.max("length").alias("length"))
    growth = lambda at, again: F.struct(F.col(at).alias("at"), "right", "length", F.lit(again).alias("again")).alias("growth")
    growths = grown.select("doc", "mark", growth("at", True)).union(first.select("of_doc", "of_mark", growth("of_at", False)))
    found = lists.join(growths.groupBy("doc", "mark").agg(F.collect_list("growth").alias("grown")), ["doc", "mark"], "left")
    return found.mapInArrow(lambda it: _per_text(it, min_run), f"doc long, mark long, spans {SPANS}, n_shared long, sources array<long>")


def without_repeated_chunks(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "cut", min_run: int = MIN_RUN) -> DataFrame:
    """All rows, and a struct: n_bytes, spans, kept, n_shared, sources."""
    return cut(df, repeated_chunks(df, id, text, min_run), id, text, name, ["n_shared", "sources"])
