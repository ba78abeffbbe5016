"""Byte-level BPE by replaying the merges over a corpus of distinct pieces.

Method: the distinct pieces of a block of texts are laid end to end as bytes. An
inverted index leads from each pair of neighbours that can merge to the positions
where it stands; merges are applied in rank order to all positions of a pair at
once, and only the neighbours of what has merged are looked up anew. Texts are
then put together from their pieces. Each task replays the pieces of its own
texts, so nothing is shuffled; what a worker has replayed it remembers, up to a
bound.

Defined cases: a null or empty text has no tokens. Any text comes back from its
tokens byte by byte. Other columns are carried along as they are; the added column
replaces one of its name. Repeated rows are encoded alike. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import as_row, from_row, row_type, spread

# Pieces whose tokens a worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000

# Pieces of a very long text that are looked at together.
PIECES_AT_ONCE = 500_000
LONG_TEXT = 4 << 20

# Bytes of texts whose pieces are replayed together, and places of a pair from which
# on they are merged as arrays.
BLOCK = 2 << 20
TOGETHER = 64


def distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.diff(values, prepend=-1) != 0]


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


class Tokens:
    """The bytes of the tokens, all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = {i: t for t, i in ranks.items()}
        lengths = np.zeros(size + 1, np.int64)
        for i, t in tokens.items():
            lengths[i + 1] = len(t)
        self.ends = np.cumsum(lengths)
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        first = self.ends[ids]
        lengths = self.ends[ids + 1] - first
        total = int(lengths.sum())
        at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return self.bytes[np.repeat(first, lengths) + at]

    def column(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids; null is empty."""
        ids = ids.fill_null([])
        parts = []
        for at in range(0, len(ids), 256):
            part = ids.slice(at, 256)
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data = self.decode(flat)
            lengths = np.asarray(part.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            ends = np.concatenate([[0], np.cumsum(self.ends[flat + 1] - self.ends[flat])])
            offsets = ends[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())]
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), buffers).cast(pa.binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


class Merges:
    """Ranks of tokens, and which pairs of tokens merge into which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a * self.size + b] = rank
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([self.pairs[k] for k in keys.tolist()], np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                first[a, b] = ranks.get(bytes([a, b]), -1)
        self.byte_pairs = first
        self.text = Tokens(ranks)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word as 32-bit numbers, all words merged together in rank order."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(words)
        ends = np.cumsum(lengths)
        follows = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        solid = lengths > 0
        follows[ends[solid] - 1] = -1
        before[(ends - lengths)[solid]] = -1
        tok = self.byte_ids[data]
        # The same memory twice: single places are read as plain numbers, many at once
        # as arrays.
        t, nx, pv = memoryview(tok), memoryview(follows), memoryview(before)
        single: dict[int, list[int]] = {}
        many: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(ranks: np.ndarray, places: np.ndarray) -> None:
            """Enters places of pairs that merge (rank 0 and up) into the index."""
            has = ranks >= 0
            ranks, places = ranks[has], places[has]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            edges = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                r, part = int(ranks[i]), places[i:j]
                if r not in single and r not in many:
                    heapq.heappush(queue, r)
                many.setdefault(r, []).append(part)

        if n > 1:
            put(np.where(follows[:-1] > 0, self.byte_pairs[data[:-1], data[1:]], -1), np.arange(n - 1))
        size, merged = self.size, self.pairs.get
        starts = np.zeros(n, bool)
        odd: set[int] = set()  # words in which a pair of lower rank came up
        while queue:
            r = heapq.heappop(queue)
            some = single.pop(r, [])
            places = np.concatenate([*many.pop(r, ()), np.array(some, np.int64)]) if r in many else some
            if len(places) >= TOGETHER:
                p = distinct(np.array(places, np.int64))
                q = follows[p]
                ok = (tok[p] >= 0) & (q >= 0)
                p, q = p[ok], q[ok]
                ok = self.rank_of(tok[p], tok[q]) == r
                p, q = p[ok], q[ok]
                starts[p] = True
                overlap = starts[q].any()
                starts[p] = False
                if overlap:
                    # A token repeats itself: the pairs overlap, the first goes first.
                    places = p.tolist()
                else:
                    after, left = follows[q], before[p]
                    tok[p], tok[q], follows[p] = r, -1, after
                    before[after[after >= 0]] = p[after >= 0]
                    touched = distinct(np.concatenate([p[after >= 0], left[left >= 0]]))
                    new = self.rank_of(tok[touched], tok[follows[touched]])
                    low = (new >= 0) & (new < r)
                    if low.any():
                        odd.update(np.searchsorted(ends, touched[low], side="right").tolist())
                    put(new, touched)
                    continue
            for p in sorted(places):
                a, q = t[p], nx[p]
                if a < 0 or q < 0 or merged(a * size + t[q]) != r:
                    continue
                after, left = nx[q], pv[p]
                t[p], t[q], nx[p] = r, -1, after
                if after >= 0:
                    pv[after] = p
                for place in (p if after >= 0 else -1, left):
                    if place >= 0 and (r2 := merged(t[place] * size + t[nx[place]])) is not None:
                        if r2 < r:
                            odd.add(int(np.searchsorted(ends, place, side="right")))
                        if r2 in single:
                            single[r2].append(place)
                        else:
                            if r2 not in many:
                                heapq.heappush(queue, r2)
                            single[r2] = [place]
        alive = tok >= 0
        cuts = 4 * np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]
        raw, cuts = tok[alive].astype(np.int32).tobytes(), cuts.tolist()
        out = [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        # There the lower pair goes before what else has its rank: one by one.
        for i in odd:
            out[i] = np.array(self.one_by_one(words[i]), np.int32).tobytes()
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which each pair merges, -1 if it does not."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def one_by_one(self, word: bytes) -> tuple[int, ...]:
        """A word's tokens, the pair of least rank merged first, then the leftmost."""
        tokens = [self.ranks[bytes([b])] for b in word]
        while len(tokens) > 1:
            ranks = [self.pairs.get(a * self.size + b, self.size) for a, b in zip(tokens, tokens[1:], strict=False)]
            least = min(ranks)
            if least == self.size:
                break
            i = ranks.index(least)
            tokens[i : i + 2] = [least]
        return tuple(tokens)


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = list(pieces)
        raw = [p.encode() for p in new]
        # A piece that is a token is that token; the others are merged.
        whole = [self.merges.ranks.get(b) for b in raw]
        rest = [i for i, w in enumerate(whole) if w is None]
        for i, ids in zip(rest, self.merges.replay([raw[i] for i in rest]), strict=True):
            self.known[new[i]] = ids
        for p, w in zip(new, whole, strict=True):
            if w is not None:
                self.known[p] = w.to_bytes(4, sys.byteorder)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        short = [self.pattern.findall(t) if len(t) <= LONG_TEXT else None for t in texts]
        self.learn({p for pieces in short if pieces for p in pieces})
        known = self.known
        out = [None if p is None else np.frombuffer(b"".join([known[x] for x in p]), np.int32) for p in short]
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self.long(texts[i])
        return out

    def long(self, text: str) -> np.ndarray:
        found, parts = self.pattern.finditer(text), []
        while pieces := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
            self.learn(set(pieces))
            parts.append(np.frombuffer(b"".join([self.known[x] for x in pieces]), np.int32))
        return np.concatenate(parts)


_WORKER: dict[tuple[int, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary; made once in each worker."""
    key = hash(content), pattern
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(Merges(ranks_of(content)), pattern)
    return _WORKER[key]


def _encode(batches: Iterator[pa.RecordBatch], content, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(content.value, pattern)
    for batch in batches:
        _, ends = X.packed(batch.column("in"))
        for first, last in X.runs_of_texts(ends, BLOCK):
            part = batch.slice(first, last - first)
            ids = coder.encode([t or "" for t in part.column("in").to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.record_batch([part.column("row"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))], names=["row", "out"])


_TOKENS: dict[int, Tokens] = {}


def _decode(batches: Iterator[pa.RecordBatch], content, pattern: str) -> Iterator[pa.RecordBatch]:
    key = hash(content.value)
    if key not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[key] = Tokens(ranks_of(content.value))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.record_batch([part.column("row"), _TOKENS[key].column(part.column("in"))], names=["row", "out"])


def _both_ways(batches: Iterator[pa.RecordBatch], content, pattern: str) -> Iterator[pa.RecordBatch]:
    """Ids, and the bytes that those ids decode to, by one worker."""
    tokens = encoder(content.value, pattern).merges.text
    for batch in _encode(batches, content, pattern):
        ids = batch.column("out")
        made = pa.StructArray.from_arrays([ids, tokens.column(ids)], ["ids", "data"])
        yield pa.record_batch([batch.column("row"), made], names=["row", "out"])


def _mapped(df: DataFrame, source: str, name: str, kind: str, vocabulary: bytes, pattern: str, work, drop: bool) -> DataFrame:
    content = df.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size
    columns = [c for c in df.columns if c != name and not (drop and c == source)]
    rows = df.select(as_row(columns), F.col(f"`{source}`").alias("in"))
    out = rows.mapInArrow(lambda it: work(it, content, pattern), f"{row_type(rows)}, out {kind}")
    return out.select(*from_row(columns), F.col("out").alias(name))


def encoded(
    df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", name: str = "token_ids", keep_text: bool = True
) -> DataFrame:
    """All rows and columns and ``name``, the token ids of the text.

    ``vocabulary`` is the content of a rank file; without ``keep_text`` the text
    column is left out.
    """
    return _mapped(spread(df), text, name, "array<int>", vocabulary, pattern, _encode, not keep_text)


def decoded(df: DataFrame, vocabulary: bytes, pattern: str, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """All rows and columns and ``name``, the bytes that the ids stand for."""
    return _mapped(df, ids, name, "binary", vocabulary, pattern, _decode, False)


def encoded_and_decoded(
    df: DataFrame, vocabulary: bytes, pattern: str, text: str = "text", name: str = "token_ids", data: str = "decoded", keep_text: bool = True
) -> DataFrame:
    """``encoded`` and ``decoded`` with a single worker for each task, which halves their memory."""
    out = _mapped(spread(df), text, "__coded", "struct<ids: array<int>, data: binary>", vocabulary, pattern, _both_ways, not keep_text)
    kept = [F.col(f"`{c}`") for c in out.columns if c not in ("__coded", name, data)]
    return out.select(*kept, F.col("__coded.ids").alias(name), F.col("__coded.data").alias(data))


def digests(df: DataFrame, ids: str = "token_ids", data: str = "decoded") -> DataFrame:
    """n_tokens, and SHA-256 of the ids as text and of the decoded bytes."""
    return df.withColumns({
        "n_tokens": F.size(ids).cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256),
        "decoded_sha256": F.sha2(data, 256),
    })
