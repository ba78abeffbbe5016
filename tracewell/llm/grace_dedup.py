"""Exact dedup by a Grace hash join of the texts with themselves.

Method: each batch of rows is put into an open-addressing table that compares
complete contents, so copies in one batch send one content on. Contents are then
dealt out by their digest, and each task works on its share: contents that are too
many for the memory go to spill files by further digits of the digest, again and
again, until a file fits a table. Which row of a table's entry stays is then told
to all rows of the group over a join on the batch's own entry, which no more rows
share than a batch has; a group of any size is never gathered.

Texts are compared without white space. The row with the most code points stays,
then the one of the least id, then the first. Spill files live in the task's own
temporary folder and go with the task; a lost task starts anew.

Defined cases: null counts as empty, and empty texts are equal. Null ids come after
all others when the least is sought. Repeated rows are rows of the group like any
other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import TASK_BYTES, pick, pieces, spread, whole, written

# Bytes of distinct contents one table may hold, and files a spill is dealt to.
TABLE_BYTES = 48 << 20
FAN_OUT = 16
DIGEST_DIGITS = 64

NO_ID = (1 << 63) - 1

# What a table knows of a row: digest, content, rows, code points, id, row number, members.
Record = tuple[bytes, bytes, int, int, int, int, list[int]]

FOUND = "row long, rep long, doc long, digest binary, content binary, size long, n long, points long, best_doc long, best_row long"


class Table:
    """Open addressing with linear probing; entries are equal if their contents are."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, record: Record) -> int:
        """Puts a record in, or joins it to its equal; returns the entry's number."""
        digest, content, n, points, doc, row, members = record
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "big") & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[0] == digest and entry[1] == content:
                entry[2] += n
                if (-points, doc, row) < (-entry[3], entry[4], entry[5]):
                    entry[3:6] = points, doc, row
                entry[6].extend(members)
                return found
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, n, points, doc, row, list(members)])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.grow()
        return len(self.entries) - 1

    def grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][:8], "big") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def grouped(records: Iterable[Record], memory: int, level: int = 0) -> Iterator[list]:
    """The entries of all records, spilled by digits of the digest while too large."""
    table = Table()
    records = iter(records)
    for record in records:
        table.add(record)
        # A single content, however long, would come into one file again and again.
        if table.bytes > memory and len(table.entries) > 1 and level < DIGEST_DIGITS:
            break
    else:
        yield from table.entries
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(Path(folder, str(i)), "wb") for i in range(FAN_OUT)]  # noqa: SIM115
        try:
            for source in (table.entries, records):
                for record in source:
                    pickle.dump(tuple(record), files[int(record[0].hex()[level], 16) % FAN_OUT], pickle.HIGHEST_PROTOCOL)
                table.entries = []
        finally:
            for f in files:
                f.close()
        del table
        for f in files:
            yield from grouped(_read(f.name), memory, level + 1)
            Path(f.name).unlink()


def _read(name: str) -> Iterator[Record]:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def without_space(data: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts without white space, and their n + 1 offsets."""
    solid = ~X._IS_SPACE[data]
    kept = np.concatenate([[0], np.cumsum(solid)])
    return data[solid].tobytes(), kept[ends]


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        rows = batch.column("row").to_pylist()
        docs = batch.column("doc").fill_null(NO_ID).to_pylist()
        for first, last in X.runs_of_texts(offsets, 8 * X.BLOCK_BYTES):
            block = data[offsets[first] : offsets[last]]
            ends = offsets[first : last + 1] - offsets[first]
            points = np.diff(np.concatenate([[0], np.cumsum((block & 0xC0) != 0x80)])[ends]).tolist()
            solid, bounds = without_space(block, ends)
            table, entry_of, digests = Table(), [], []
            for i in range(last - first):
                content = solid[bounds[i] : bounds[i + 1]]
                digest = hashlib.sha256(content).digest()
                digests.append(digest)
                entry_of.append(table.add((digest, content, 1, points[i], docs[first + i], rows[first + i], [rows[first + i]])))
            out = []
            for i, e in enumerate(entry_of):
                entry, row, doc = table.entries[e], rows[first + i], docs[first + i]
                rep = entry[6][0]
                if row == rep:
                    out.append((row, rep, doc, digests[i], entry[1], len(entry[1]), *entry[2:6]))
                else:
                    out.append((row, rep, doc, digests[i], None, 0, None, None, None, None))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in FOUND.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _over_batches(batches: Iterator[pa.RecordBatch], memory: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[Record]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield from zip(*(part.column(n).to_pylist() for n in ("digest", "content", "n", "points", "best_doc", "best_row")), ([r] for r in part.column("row").to_pylist()), strict=True)

    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["rep", "keep_doc", "keep_row", "group_size"])

    for entry in grouped(records(), memory):
        out.extend((member, entry[4], entry[5], entry[2]) for member in entry[6])
        if len(out) > 20_000:
            yield flush()
    if out:
        yield flush()


def duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``df``: doc, keep_id, group_size, kept, text_sha256."""
    spark = df.sparkSession
    rows = spread(pick(df, doc=id, text=text)).select(
        F.monotonically_increasing_id().alias("row"), F.col("doc").cast("long"), whole("text").alias("text")
    )
    found = written(rows.mapInArrow(_within_batches, FOUND), "grace")
    total = found.agg(F.sum("size")).first()[0]
    contents = found.where("content IS NOT NULL").select("digest", "content", "n", "points", "best_doc", "best_row", "row")
    dealt = contents.repartition(pieces(spark, total, TASK_BYTES), "digest")
    told = dealt.mapInArrow(lambda it: _over_batches(it, table_bytes), "rep long, keep_doc long, keep_row long, group_size long")
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select("row", "rep", "doc", "digest").join(told, "rep").select(
        no_id("doc").alias("doc"), no_id("keep_doc").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
