"""Cutting byte ranges out of texts, the ranges being rows of another table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import as_row, from_row, row_type, whole

SPANS = "array<struct<start: long, end: long>>"

# Stands for a null id, so that such rows come after all others.
NO_ID = (1 << 63) - 1


def id_or_last(id: str) -> F.Column:
    return F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID))


def marked(df: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, mark, text): mark tells texts of one id apart, copies are alike."""
    return df.select(
        id_or_last(id).alias("doc"), F.xxhash64(whole(F.col(f"`{text}`"))).alias("mark"),
        whole(F.col(f"`{text}`")).alias("text"),
    )


def spans_array(lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One list of (start, end) for each text."""
    offsets = np.cumsum([0, *(len(s) for s, _ in lists)]).astype(np.int32)
    none = np.empty(0, np.int64)
    starts = np.concatenate([none, *(s for s, _ in lists)]).astype(np.int64)
    ends = np.concatenate([none, *(e for _, e in lists)]).astype(np.int64)
    pairs = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        kept = []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            edges = [0, *(x for s in spans or () for x in (s["start"], s["end"])), len(text)]
            kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
        sizes = pa.array(np.diff(offsets))
        yield pa.record_batch([*(batch.column(c) for c in ("row", "extra", "spans")), sizes, pa.array(kept, pa.binary())], names=["row", "extra", "spans", "n_bytes", "kept"])


def cut(df: DataFrame, spans: DataFrame, id: str, text: str, name: str, extra: list[str] | None = None) -> DataFrame:
    """All rows and columns of ``df`` but the text, and a struct ``name``.

    ``spans`` has doc, mark, spans (disjoint, in order) and the ``extra`` columns.
    The struct has n_bytes, spans, kept (what is left, as bytes) and the extra ones.
    """
    extra = extra or []
    columns = [c for c in df.columns if c not in (text, name)]
    found = spans.select(F.col("doc").alias("of_doc"), F.col("mark").alias("of_mark"), "spans", as_row(extra).alias("extra"))
    texts = df.select(as_row(columns), id_or_last(id).alias("doc"), whole(F.col(f"`{text}`")).alias("text"))
    joined = texts.join(found, (F.col("doc") == F.col("of_doc")) & (F.xxhash64("text") == F.col("of_mark")), "left")
    rows = joined.select("row", "extra", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), "text")
    kinds = f"{row_type(rows)}, extra {rows.schema['extra'].dataType.simpleString()}, spans {SPANS}, n_bytes long, kept binary"
    out = rows.mapInArrow(_cut, kinds)
    more = [F.col(f"extra.c{i}").alias(c) for i, c in enumerate(extra)]
    return out.select(*from_row(columns), F.struct("n_bytes", "spans", "kept", *more).alias(name))


def removed(spans: str) -> F.Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
