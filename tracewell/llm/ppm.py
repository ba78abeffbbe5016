"""LM scoring by prediction by partial matching over bytes.

Method: a trie of byte contexts, up to a few bytes deep, holds how often each byte (or
the end of the text) followed. A symbol is looked for in the longest context that
was seen; where it is missing an escape is coded, estimated from the number of
distinct symbols there (method D: half a count is taken from each), and the next shorter context is asked without the
symbols already ruled out. A text's score is the base-10 logarithm of its probability.

The model grows with the corpus, so no task holds it whole. Texts are dealt to
chunks. A chunk sends the contexts and words it has, with their counts in its
training texts, to buckets by hash; a bucket sums them and answers each chunk about
its own ones; the chunk then scores its texts. What moves is distinct contexts and
words per chunk, packed in arrays, and the texts once.

Texts are lower-cased (A-Z); words are what stands between white space, joined by
one space for the model. Beside the score there is a unigram score with add-one
smoothing, whose tokens are the words and one end per text.

Defined cases: a null or blank text has the end only. Texts whose CRC-32 of the id, as
text, leaves ``held_out`` modulo ``folds`` are scored but not learnt from; a null id counts as
an empty string. Nothing is ordered or chosen, so there are no ties. Repeated rows are learnt from and scored one by one. Other
columns are carried along. An empty table gives no rows; without training texts every
symbol is as likely as any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import as_row, from_row, row_type, shuffle_tasks, spread, whole

# Bytes of context, at most six, and the symbol that ends a text.
ORDER = 5
END = 256
SYMBOLS = 257

# A code has the symbol in its low nine bits, then the context, then its length.
DEPTH = X._U(57)

# Bytes of texts in a chunk.
CHUNK_BYTES = 24 << 20
LEAST_CHUNK_BYTES = 4 << 20

FOLDS = 7
HELD_OUT = 2

END_WORD = X._U(0x5851F42D4C957F2D)


def normalised(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts, each followed by its end; how many each text has; and
    each symbol's place in its text."""
    n = len(ends) - 1
    low = X.lowered(data)
    starts, stops, counts = X.word_bounds(low, ends)
    inside = ~X._IS_SPACE[low]
    # The byte after a word stands for the one space, unless the word is the last.
    last = np.cumsum(counts)[counts > 0] - 1
    between = np.ones(len(stops), bool)
    between[last] = False
    keep = inside.copy()
    keep[stops[between]] = True
    symbols = low.astype(np.uint16)
    symbols[stops[between]] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    sizes = np.diff(kept) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(bounds[-1]), END, np.uint16)
    body = np.ones(len(out), bool)
    body[bounds[1:] - 1] = False
    out[body] = symbols[keep]
    place = np.arange(len(out)) - np.repeat(bounds[:-1], sizes)
    return out, sizes, place if n else place


def codes(symbols: np.ndarray, place: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each symbol: length of its context, the context's bytes, the symbol."""
    depth = np.minimum(place, order).astype(np.uint64)
    value = symbols.astype(np.uint64)
    context = np.zeros(len(symbols), np.uint64)
    for back in range(1, order + 1):
        behind = np.zeros(len(symbols), np.uint64)
        behind[back:] = value[:-back] if back < len(value) else value[:0]
        context |= np.where(place >= back, behind, X._U(0)) << X._U(8 * (back - 1))
    return (depth << DEPTH) | (context << X._U(9)) | value


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs (or its summed weight)."""
    if not len(values):
        return values, np.empty(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if weights is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights, first)


def shortened(entries: np.ndarray, length: int) -> np.ndarray:
    """Codes of the same symbols after the last ``length`` bytes of their contexts."""
    context = (entries >> X._U(9)) & X._U((1 << (8 * length)) - 1)
    return (X._U(length) << DEPTH) | (context << X._U(9)) | (entries & X._U(511))


def all_lengths(top: np.ndarray, counts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all context lengths, from those of the longest ones."""
    depth = (top >> DEPTH).astype(np.int64)
    parts = [counted(shortened(top[depth >= k], k), counts[depth >= k]) for k in range(order + 1)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Model:
    """Scores codes against entries: sorted (context, symbol) codes and counts."""

    def __init__(self, entries: np.ndarray, counts: np.ndarray):
        self.entries, self.counts = entries, counts.astype(np.int64)
        self.contexts, first = np.unique(entries >> X._U(9), return_index=True)
        if len(entries):
            self.total = np.add.reduceat(self.counts, first)
            self.distinct = np.diff(np.append(first, len(entries)))
            # Per context: how often its own symbols follow its shorter context.
            length = entries >> DEPTH
            known = np.zeros(len(entries), np.int64)
            for k in np.unique(length):
                if k:
                    own = length == k
                    known[own] = self.count(shortened(entries[own], int(k) - 1))
            self.ruled_out = np.add.reduceat(known, first)

    def count(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.entries):
            return np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
        return np.where(self.entries[at] == wanted, self.counts[at], 0)

    def score(self, wanted: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log10 of the probability of each code's symbol in its context."""
        out = np.zeros(len(wanted))
        depth = (wanted >> DEPTH).astype(np.int64)
        open_ = np.ones(len(wanted), bool)
        ruled_total, ruled_distinct = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        for k in range(order, -1, -1):
            if not len(self.contexts):
                break
            at = np.flatnonzero(open_ & (depth >= k))
            code = shortened(wanted[at], k)
            context = code >> X._U(9)
            found = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            seen = self.contexts[found] == context
            at, code, found = at[seen], code[seen], found[seen]
            total = self.total[found] - ruled_total[at]
            distinct = self.distinct[found] - ruled_distinct[at]
            times = self.count(code)
            hit = times > 0
            out[at[hit]] += np.log10((2 * times[hit] - 1) / (2 * total[hit]))
            open_[at[hit]] = False
            miss = ~hit & (distinct > 0)
            out[at[miss]] += np.log10(distinct[miss] / (2 * total[miss]))
            rest = at[~hit]
            ruled_total[rest] = self.ruled_out[found[~hit]]
            ruled_distinct[rest] = self.distinct[found[~hit]]
        out[open_] -= np.log10(np.maximum(SYMBOLS - ruled_distinct[open_], 1))
        return out


class Trie:
    """The same model as a plain trie, which can also learn while it scores."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.nodes: dict[bytes, dict[int, int]] = {}

    def add(self, symbols: list[int], i: int) -> None:
        for k in range(min(i, self.order) + 1):
            followers = self.nodes.setdefault(bytes(symbols[i - k : i]), {})
            followers[symbols[i]] = followers.get(symbols[i], 0) + 1

    def score_symbol(self, symbols: list[int], i: int) -> float:
        ruled_out: set[int] = set()
        score = 0.0
        for k in range(min(i, self.order), -1, -1):
            followers = self.nodes.get(bytes(symbols[i - k : i]))
            if not followers:
                continue
            left = {s: c for s, c in followers.items() if s not in ruled_out}
            bottom = 2 * sum(left.values())
            if symbols[i] in left:
                return score + math.log10((2 * left[symbols[i]] - 1) / bottom)
            if left:
                score += math.log10(len(left) / bottom)
            ruled_out |= followers.keys()
        return score - math.log10(max(SYMBOLS - len(ruled_out), 1))

    def learn(self, symbols: list[int]) -> None:
        for i in range(len(symbols)):
            self.add(symbols, i)

    def score(self, symbols: list[int], adaptive: bool = False) -> float:
        total = 0.0
        for i in range(len(symbols)):
            total += self.score_symbol(symbols, i)
            if adaptive:
                self.add(symbols, i)
        return total


def symbols_of(text: str | None) -> list[int]:
    raw = (text or "").encode()
    return normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()


def _adaptive(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [Trie(order).score(symbols_of(t), adaptive=True) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])


def adaptive_scores(df: DataFrame, text: str = "text", name: str = "score", order: int = ORDER) -> DataFrame:
    """All rows and columns and ``name``: each text's score by a model that starts empty
    and learns from the text itself as it goes."""
    columns = [c for c in df.columns if c != name]
    rows = spread(df).select(as_row(columns), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(lambda it: _adaptive(it, order), f"{row_type(rows)}, score double")
    return out.select(*from_row(columns), F.col("score").alias(name))


# --- over the corpus ---------------------------------------------------------


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of the texts, each text's end included, and their counts."""
    low = X.lowered(data)
    starts, stops, counts = X.word_bounds(low, ends)
    hashes = X.RangeHash(low).of(starts, stops)
    bounds = np.cumsum(counts + 1) - 1
    out = np.empty(len(hashes) + len(counts), np.uint64)
    body = np.ones(len(out), bool)
    body[bounds] = False
    out[bounds] = END_WORD
    out[body] = hashes
    return out, counts + 1


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the training texts, and a row with their number."""
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        held = np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
        found, tokens = [], 0
        for first, last in X.runs_of_texts(offsets):
            hashes, counts = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            learnt = np.repeat(~held[first:last], counts)
            tokens += int(learnt.sum())
            found.append(np.unique(hashes[learnt]))
        words = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        yield pa.record_batch([pa.array([*X.as_long(words).tolist(), None], pa.int64()), pa.array([*[0] * len(words), tokens], pa.int64())], names=["word", "tokens"])


GRAMS = "kind byte, bucket long, chunk long, keys binary, counts binary"
ANSWERS = "chunk long, kind byte, keys binary, counts binary"
WORD, CONTEXT = 0, 1


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys and counts as bytes; of contexts each is named once, not per symbol."""
    few = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    packed_counts = bytes([few.itemsize]) + few.tobytes()
    if kind == WORD:
        return keys.tobytes(), packed_counts
    contexts = keys >> X._U(9)
    first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(keys))).astype(np.uint16)
    symbols = (keys & X._U(511)).astype(np.uint16)
    return np.uint64(len(first)).tobytes() + contexts[first].tobytes() + sizes.tobytes() + symbols.tobytes(), packed_counts


def _unpacked(kind: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(counts, f"u{counts[0]}", offset=1).astype(np.int64)
    if kind == WORD:
        return np.frombuffer(keys, np.uint64), found
    n = int(np.frombuffer(keys, np.uint64, 1)[0])
    contexts = np.frombuffer(keys, np.uint64, n, 8)
    sizes = np.frombuffer(keys, np.uint16, n, 8 + 8 * n)
    symbols = np.frombuffer(keys, np.uint16, offset=8 + 10 * n)
    return (np.repeat(contexts, sizes) << X._U(9)) | symbols.astype(np.uint64), found


def _blocks(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = X.packed(table.column("text"))
    for first, last in X.runs_of_texts(offsets):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def _held(table: pa.Table) -> np.ndarray:
    return np.asarray(table.column("held").combine_chunks().to_numpy(zero_copy_only=False), bool)


def _summed(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = zip(*parts, strict=True)
    return counted(np.concatenate(keys), np.concatenate(counts))


def _grams(table: pa.Table, chunk: int, order: int, buckets: int) -> pa.Table:
    """What a chunk has: words and context entries, with counts in training texts."""
    held = _held(table)
    words, tops = [], []
    for first, last, data, ends in _blocks(table):
        hashes, counts = word_hashes(data, ends)
        symbols, sizes, place = normalised(data, ends)
        all_codes = codes(symbols, place, order)
        for values, lengths, into in ((hashes, counts, words), (all_codes, sizes, tops)):
            learnt = np.repeat(~held[first:last], lengths)
            into.append(counted(values[learnt]))
            others = counted(values[~learnt])[0]
            into.append((others, np.zeros(len(others), np.int64)))
    rows = []
    for kind, (keys, counts) in ((WORD, _summed(words)), (CONTEXT, all_lengths(*_summed(tops), order))):
        # The entries of one context belong to one bucket.
        bucket = (X.mix(keys if kind == WORD else keys >> X._U(9)) % X._U(buckets)).astype(np.int64)
        by = np.lexsort((keys, bucket))
        keys, counts, bucket = keys[by], counts[by], bucket[by]
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows.append((kind, int(bucket[a]), chunk, *_packed(kind, keys[a:b], counts[a:b])))
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "bucket", "chunk", "keys", "counts"])


def _answers(table: pa.Table) -> pa.Table:
    """What a bucket knows of what each chunk has asked for."""
    kind = table.column("kind")[0].as_py()
    given = [_unpacked(kind, k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    keys, counts = _summed(given)
    keys, counts = keys[counts > 0], counts[counts > 0]
    out_keys, out_counts = [], []
    for want, _ in given:
        if kind == WORD:
            at = np.searchsorted(keys, want)
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want)] if len(keys) else at[:0]
        else:
            context = np.unique(want >> X._U(9))
            low = np.searchsorted(keys, context << X._U(9))
            size = np.searchsorted(keys, (context + X._U(1)) << X._U(9)) - low
            at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        for into, part in zip((out_keys, out_counts), _packed(kind, keys[at], counts[at]), strict=True):
            into.append(part)
    return pa.table(
        [table.column("chunk"), pa.array([kind] * len(given), pa.int8()), pa.array(out_keys, pa.binary()), pa.array(out_counts, pa.binary())],
        names=["chunk", "kind", "keys", "counts"],
    )


def _known(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)) if table.num_rows else table
    parts = [_unpacked(kind, k, c) for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
    keys = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)])
    counts = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nothing marked as never null, as schema strings have it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return kind


def _scores(texts: pa.Table, answers: pa.Table, order: int, n: int, v: int) -> pa.Table:
    words, times = _known(answers, WORD)
    model = Model(*_known(answers, CONTEXT))
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for _, _, data, ends in _blocks(texts):
        hashes, counts = word_hashes(data, ends)
        at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
        c = np.where(words[at] == hashes, times[at], 0) if len(words) else np.zeros(len(hashes), np.int64)
        firsts = np.cumsum(counts) - counts
        columns[0].append(counts)
        columns[1].append(np.add.reduceat((c > 0).astype(np.int64), firsts))
        columns[2].append(np.add.reduceat(np.log10((c + 1) / (n + v + 1)), firsts))
        symbols, sizes, place = normalised(data, ends)
        values = codes(symbols, place, order)
        by = np.argsort(values)
        ordered = values[by]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        scores = np.empty(len(values))
        scores[by] = model.score(ordered[new], order)[np.cumsum(new) - 1]
        columns[3].append(np.add.reduceat(scores, np.cumsum(sizes) - sizes))
    made = [np.concatenate(c) if c else np.empty(0) for c in columns]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table(
        [texts.column("row").cast(_nullable(texts.column("row").type)), texts.column("held"), *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))],
        names=["row", "held", "n_tokens", "n_known", "base_score", "score"],
    )


def scored(
    df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "lm", order: int = ORDER,
    folds: int = FOLDS, held_out: int = HELD_OUT, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """All rows and columns but the text, and a struct ``name``: held_out, n_tokens,
    n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in (text, name)]
    as_text = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    held = (F.crc32(as_text.cast("binary")) % folds == held_out).alias("held")
    texts = spread(df).select(as_row(columns), as_text.alias("id"), held, whole(F.col(f"`{text}`")).alias("text"))
    counts = texts.select("held", "text").mapInArrow(_vocabulary, "word long, tokens long")
    v, n = counts.agg(F.count_distinct("word"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    # Small chunks repeat what they ask for, so few cores are better than tiny ones.
    size = int(size or 0)
    chunks = max(1, -(-size // chunk_bytes), min(shuffle_tasks(spark), -(-size // LEAST_CHUNK_BYTES)))
    # Any chunk will do for a row; rows of one id, or without one, are dealt out by text
    # and by where they come from.
    chunk = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(chunks)).alias("chunk")
    dealt = texts.select(chunk, "row", "held", "text").repartition(chunks, "chunk")
    # Both uses of the dealt texts take the same columns, so that they move only once.
    grams = dealt.groupBy("chunk").applyInArrow(
        lambda key, table: _grams(table, key[0].as_py(), order, chunks), GRAMS
    )
    answers = grams.groupBy("kind", "bucket").applyInArrow(_answers, ANSWERS)
    ddl = f"{row_type(texts)}, held boolean, n_tokens long, n_known long, base_score double, score double"
    result = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda texts, answers: _scores(texts, answers, order, n, v), ddl
    )
    made = F.struct(
        F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
    return result.select(*from_row(columns), made.alias(name))
