"""N-gram Jaccard join: which texts share enough of their shingles, by PartEnum.

Method: sets are dealt to size bands (powers of two; a set that may have a partner
in the band below signs there too). Within a band the domain of shingles is
partitioned by hash, and a signature is the projection of a set onto a few of the
partitions. Two similar sets differ in at most k partitions, k following from
the sizes and the similarity, so some choice of partitions has equal projections:

* small bands: k + 2 partitions, one signature for every subset of two of them;
* other bands: as many partitions as the band's least size, each a subset of its
  own. In an order of projections that all sets share, at most k of the first ones of
  a set differ from a similar set, so the first k + 1 that are not empty have one
  that both sign.

A set with too few partitions that are not empty also signs its first k + 1 single
shingles; two such sets meet there. So no link is missed.

Passages that many texts share make large classes of texts that are not similar. So
sets sign somewhat more than k + 1 projections: similar sets then share several
signatures, and a set with fewer large classes than that meets all its partners in
small ones. The other sets sign once more, the projections of large classes last.

Texts that share a signature are not paired with one another: each is compared
with the class's first member. Only where that comparison fails and the two are in
no common component is a member compared with the rest of its class. A comparison
first bounds the intersection from small bitmaps of the sets, which never rules out
a link, and then intersects whole sets. Links become components.

Defined cases: a null or blank text has no shingles and no link. Fewer words than
a shingle has make one shingle. Each row without an id takes part and gives a row with a
null id; the component of such rows alone is null. Sizes are compared in whole numbers,
so a similarity that equals the least one is a link. Rows of one id
give one row; if their texts differ, a link of any of them is a link of the id and
the largest set is reported. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm import textops as X
from tracewell.llm.common import pick, shuffle_tasks, spread, whole, written
from tracewell.llm.components import components

WORDS = 5
PERCENT = 75

# Members from which on a class is large. It only steers how links are found.
LARGE_CLASS = 16

# Members up to which those of a class meet one by one; queries and members of a block
# of the others.
WIDE_CLASS = 32
QUERY_BLOCK = 500
MEMBER_BLOCK = 2_000

# Members a set is compared with in one task, and ids that may be broadcast to
# the scan of the texts; more ids shuffle the texts instead.
GROUP_MEMBERS = 500
BROADCAST_IDS = 1_000_000

# Crowded signatures, 8 bytes each, that are sent to every task; beyond it they are joined.
BROADCAST_SIGNATURES = 2_000_000

# Rows without an id get keys from here on, made of their text. Ids may lie there, too.
NO_ID_KEYS = (1 << 63) - (1 << 60)

# Bands up to this power of two take subsets of two partitions.
SMALL_BAND = 3


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and how many."""
    low = X.lowered(data)
    starts, stops, counts = X.word_bounds(low, ends)
    hashes = X.RangeHash(low).of(starts, stops)
    runs = X.combined(hashes, words)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(runs):
        inside = owner[: len(runs)] == owner[words - 1 :]
        runs, run_owner = runs[inside], owner[: len(inside)][inside]
    else:
        run_owner = owner[:0]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        # The whole sequence as one shingle; its length is part of the hash.
        first = np.cumsum(counts) - counts
        value = np.zeros(len(short), np.uint64)
        for i in range(words - 1):
            has = counts[short] > i
            at = np.where(has, first[short] + i, 0)
            value = np.where(has, X.mix(value * X._ODD + hashes[at] + X._U(i + 1)), value)
        runs, run_owner = np.concatenate([runs, value]), np.concatenate([run_owner, short])
    order = np.lexsort((runs, run_owner))
    runs, run_owner = runs[order], run_owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (run_owner[1:] != run_owner[:-1])
    runs, run_owner = runs[new], run_owner[new]
    return runs, np.bincount(run_owner, minlength=len(counts))


def most_different(n: np.ndarray, percent: int, larger: bool) -> np.ndarray:
    """In how many shingles a set of n and a similar one can differ."""
    return 2 * n * (100 - percent) // (100 + percent) if larger else n * (100 - percent) // percent


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, laid end to end."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Signed(NamedTuple):
    """Signatures: the set each is of, the list it stands in (band and kind), how many
    of a list a similar set can lack, and how many signatures such two share at least."""

    sig: np.ndarray
    of: np.ndarray
    list_: np.ndarray
    lacks: np.ndarray
    shares: np.ndarray


# Kinds of lists: subsets of two partitions, partitions, single shingles.
SUBSETS, PARTITIONS, SINGLES = 0, 1, 2
WHOLE_LIST = 1 << 20


def signatures(sets: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, all_: bool = False) -> Signed:
    """Signatures of the sets; with ``all_`` of whole lists, else of their beginnings."""
    firsts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes)
    log2 = lambda x: np.frexp(x.astype(float))[1].astype(np.int64) - 1
    home = log2(sizes[some])
    below = log2(-(-sizes[some] * percent // 100))
    two = below < home
    # One entry for each set and band it signs in.
    of = np.concatenate([some, some[two]])
    band = np.concatenate([home, below[two]])
    larger = np.concatenate([np.zeros(len(some), bool), np.ones(int(two.sum()), bool)])
    n = sizes[of]
    k = np.where(larger, most_different(n, percent, True), most_different(n, percent, False))
    parts: list[Signed] = []

    def put(entry: np.ndarray, sig: np.ndarray, kind: int) -> None:
        """A list of each entry: its beginning, in the order of the signatures."""
        lengths = np.bincount(entry, minlength=len(of))
        more = (1 << band) // 8 + 1
        wanted = lengths if kind == SUBSETS or all_ else np.minimum(lengths, k + more)
        lacks = np.full(len(of), WHOLE_LIST) if kind == SUBSETS else k
        shares = np.ones(len(of), np.int64) if kind == SUBSETS else wanted - k
        order = np.lexsort((sig, entry))
        chosen = order[_ranges(lengths) < np.repeat(wanted, lengths)]
        e = entry[chosen]
        parts.append(Signed(sig[chosen], of[e], 4 * band[e] + kind, lacks[e], np.maximum(shares[e], 1)))

    for small in (True, False):
        mine = np.flatnonzero((band <= SMALL_BAND) == small)
        if not len(mine):
            continue
        e = np.repeat(mine, n[mine])
        value = sets[np.repeat(firsts[of[mine]], n[mine]) + _ranges(n[mine])]
        b = band[e]
        full = np.zeros(len(of), np.int64)
        if small:
            entries, sigs = [], []
            for j in np.unique(band[mine]):
                # The largest k in the band, from the largest set on either side.
                top = (2 << int(j)) - 1
                most = max(int(most_different(np.array(top), percent, False)), int(most_different(np.array(top * 100 // percent), percent, True)))
                count = most + 2
                rows = mine[band[mine] == j]
                v = value[b == j]
                cell = np.searchsorted(rows, e[b == j]) * count + (X.mix(v) % X._U(count)).astype(np.int64)
                sums = np.zeros(len(rows) * count, np.uint64)
                np.add.at(sums, cell, X.mix(v + X._U(3)))
                filled = np.bincount(cell, minlength=len(sums)).reshape(-1, count) > 0
                sums = sums.reshape(-1, count)
                full[rows] = filled.sum(axis=1)
                for subset in combinations(range(count), 2):
                    tag = X.mix(np.array([(int(j) << 32) + subset[0] * 4096 + subset[1] + 1], np.uint64))[0]
                    has = filled[:, subset[0]] | filled[:, subset[1]]
                    entries.append(rows[has])
                    sigs.append(X.mix(sums[:, subset[0]] * X._ODD + sums[:, subset[1]] + tag)[has])
            put(np.concatenate(entries), np.concatenate(sigs), SUBSETS)
        else:
            # Sets are sorted, so the top bits cut them into runs.
            part = value >> (X._U(64) - b.astype(np.uint64))
            new = np.ones(len(value), bool)
            new[1:] = (part[1:] != part[:-1]) | (e[1:] != e[:-1])
            run = np.flatnonzero(new)
            sums = np.add.reduceat(X.mix(value + X._U(3)), run)
            full = np.bincount(e[run], minlength=len(of))
            put(e[run], X.mix(sums + X.mix(part[run] * X._U(64) + b[run].astype(np.uint64) + X._U(5))), PARTITIONS)
        # Sets with too few partitions also sign single shingles.
        unlucky = (full <= k)[e]
        if unlucky.any():
            put(e[unlucky], X.mix(X.mix(value[unlucky] + X._U(11)) + b[unlucky].astype(np.uint64)), SINGLES)
    if not parts:
        none = np.empty(0, np.int64)
        return Signed(none.view(np.uint64), none, none, none, none)
    return Signed(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        docs = X.ids_of(batch.column("doc"))
        for first, last in X.runs_of_texts(offsets):
            ends = offsets[first : last + 1] - offsets[first]
            yield docs[first:last], *shingle_sets(data[offsets[first] : offsets[last]], ends, words)


def _set_hashes(sets: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    out = []
    for seed in (21, 22):
        sums = np.concatenate([[0], np.cumsum(X.mix(sets + X._U(seed)))]).astype(np.uint64)
        out.append(X.mix(sums[ends] - sums[ends - sizes]))
    return out


def _bitmaps(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set a bitmap of at least two bits a shingle, a power of two long."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1, 3)
    ends = np.concatenate([[0], np.cumsum(1 << bits)])
    place = X.mix(sets + X._U(7)) >> np.repeat((64 - bits).astype(np.uint64), sizes)
    flags = np.zeros(ends[-1], bool)
    flags[np.repeat(ends[:-1], sizes) + place.astype(np.int64)] = True
    packed = np.packbits(flags).tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _folded(bits: bytes, size: int) -> bytes:
    """A bitmap of fewer bits, of the same set."""
    while len(bits) > size:
        bits = np.packbits(np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, 2).any(axis=1)).tobytes()
    return bits


def most_in_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """An upper bound of the intersection: a bit both have stands for one common
    shingle, and for one more only if both have put several shingles there."""
    size = min(len(a), len(b))
    x, y = (int.from_bytes(_folded(v, size), "big") for v in (a, b))
    return (x & y).bit_count() + min(n_a - x.bit_count(), n_b - y.bit_count())


def _info(batches, words):
    for docs, sets, sizes in _blocks(batches, words):
        h1, h2 = _set_hashes(sets, sizes)
        columns = [pa.array(docs), pa.array(sizes), pa.array(X.as_long(h1)), pa.array(X.as_long(h2)), pa.array(_bitmaps(sets, sizes), pa.binary())]
        yield pa.record_batch(columns, names=["doc", "n", "h1", "h2", "bits"])


def _maybe(batches, percent):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)
        enough = [(100 + percent) * most_in_common(a, n, b, m) >= percent * (n + m) for a, n, b, m in rows]
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(enough, pa.bool_())], names=["a", "b", "maybe"])


def _signed(batches, words, percent):
    for docs, sets, sizes in _blocks(batches, words):
        h1, h2 = _set_hashes(sets, sizes)
        # Copies within the block sign once; all copies are linked by their hashes.
        _, once = np.unique(h1 ^ (h2 << X._U(1)), return_index=True)
        alone = np.zeros(len(sizes), bool)
        alone[once] = True
        made = signatures(sets[np.repeat(alone, sizes)], np.where(alone, sizes, 0), percent)
        # A list and how much of it is shared, in one number: rows are many.
        entry = (made.list_ << 32) | made.shares
        yield pa.record_batch([pa.array(X.as_long(made.sig)), pa.array(docs[made.of]), pa.array(entry)], names=["sig", "doc", "entry"])


def _first_of_each(sig: np.ndarray, of: np.ndarray, lists: np.ndarray, lacks: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Places of the lacks + 1 signatures of each (text, list), crowded ones last."""
    at = np.minimum(np.searchsorted(late, sig), max(len(late) - 1, 0))
    crowded = late[at] == sig if len(late) else np.zeros(len(sig), bool)
    order = np.lexsort((sig, crowded, lists, of))
    group = of[order] << 16 | lists[order]
    new = np.diff(group, prepend=-1) != 0
    other = new | (np.diff(sig[order], prepend=0) != 0)
    rank = np.cumsum(other)
    start = np.maximum.accumulate(np.where(new, rank, 0))
    return order[rank - start <= lacks[order]]


def _signed_again(batches, words, percent, late=None):
    """Signatures of the lists that are wanted of each text: all, or, where the crowded
    ones are known (``late``, sorted, broadcast), only those that are needed."""
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        docs, lists = X.ids_of(batch.column("doc")), batch.column("lists").to_pylist()
        for first, last in X.runs_of_texts(offsets, X.BLOCK_BYTES // 2):
            sets, sizes = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words)
            made = signatures(sets, sizes, percent, all_=True)
            pairs = np.array([i << 16 | x for i, wanted in enumerate(lists[first:last]) for x in wanted], np.int64)
            keep = np.isin(made.of << 16 | made.list_, pairs)
            of = made.of[keep]
            # The set's own hash: rows of one id may differ in text.
            mark = X.as_long(_set_hashes(sets, sizes)[0])[of]
            columns = [X.as_long(made.sig[keep]), docs[first:last][of], mark, made.list_[keep].astype(np.int32), made.lacks[keep].astype(np.int32)]
            if late is not None:
                needed = _first_of_each(columns[0], of, columns[3].astype(np.int64), columns[4], late.value)
                columns = [c[needed] for c in columns]
            yield pa.record_batch([pa.array(c) for c in columns], names=["sig", "doc", "mark", "list", "lacks"])


def _folded_rows(rows: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits, one a row."""
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, 2).any(axis=2)
    return np.packbits(bits, axis=1)


def _block(table: pa.Table, percent: int) -> pa.Table:
    """Queries against members of one block: the pairs their bitmaps do not rule out."""
    is_query = np.asarray(table.column("is_query").combine_chunks().to_numpy(zero_copy_only=False), bool)
    column = lambda c: np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False), np.int64)
    doc, n, label = column("doc"), column("n"), column("label")
    raw = table.column("bits").to_pylist()
    sizes = np.array([len(x) for x in raw])
    out_a, out_b = [], []
    # Bitmaps of one length make a matrix; the next longer ones are folded once.
    by_size = {}
    for size in np.unique(sizes[~is_query]):
        at = np.flatnonzero(~is_query & (sizes == size))
        by_size[int(size)] = at, np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), -1)
    folded = {size // 2: (at, _folded_rows(rows)) for size, (at, rows) in by_size.items() if size > 1}
    for q in np.flatnonzero(is_query):
        own = len(raw[q])
        half = _folded(raw[q], own // 2) if own > 1 else raw[q]
        for bits, group in ((raw[q], by_size.get(own)), (raw[q], folded.get(own)), (half, by_size.get(own // 2))):
            if group is None:
                continue
            at, rows = group
            mine = np.frombuffer(bits, np.uint8)
            counts = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
            both = np.bitwise_count(rows & mine).sum(axis=1, dtype=np.int64)
            most = both + np.minimum(n[at] - counts, n[q] - int(np.bitwise_count(mine).sum()))
            ok = ((100 + percent) * most >= percent * (n[at] + n[q])) & (label[at] != label[q])
            ok &= 100 * np.minimum(n[at], n[q]) >= percent * np.maximum(n[at], n[q])
            out_a.append(np.maximum(doc[at[ok]], doc[q]))
            out_b.append(np.minimum(doc[at[ok]], doc[q]))
    none = np.empty(0, np.int64)
    return pa.table([pa.array(np.concatenate([none, *out_a])), pa.array(np.concatenate([none, *out_b]))], names=["a", "b"])


def _in_blocks(wide: DataFrame, lone: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Lone members of wide classes against all members of classes that hang together.

    The lone ones are queries; they meet the others in blocks of bounded size, and
    only pairs that their bitmaps do not rule out become rows.
    """
    family = written(components(wide.select("doc", "hub")), "families").toDF("doc", "family")
    docs = wide.select("doc", "label").distinct().join(family, "doc", "left").withColumn("family", F.coalesce("family", "doc"))
    asked = docs.join(lone.select("doc").distinct().withColumn("is_query", F.lit(True)), "doc", "left")
    known = written(asked.withColumn("is_query", F.coalesce("is_query", F.lit(False))).join(info.select("doc", "n", "bits"), "doc"), "wide")
    sizes = known.groupBy("family").agg(
        F.ceil(F.count_if("is_query") / QUERY_BLOCK).cast("int").alias("q_blocks"), F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("m_blocks")
    ).where("q_blocks > 0")
    placed = known.join(sizes, "family")
    at = lambda blocks: F.pmod(F.xxhash64("doc"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ("family", "doc", "label", "n", "bits")
    queries = placed.where("is_query").select(*columns, F.lit(True).alias("is_query"), at("q_blocks").alias("q"), every("m_blocks").alias("m"))
    members = placed.select(*columns, F.lit(False).alias("is_query"), every("q_blocks").alias("q"), at("m_blocks").alias("m"))
    pairs = queries.unionByName(members).groupBy("family", "q", "m").applyInArrow(lambda table: _block(table, percent), "a long, b long")
    return pairs.distinct()


def _sets(batches, words):
    """Rows of doc, text and the groups it is wanted in, with the set for the text."""
    for batch in batches:
        data, offsets = X.packed(batch.column("text"))
        for first, last in X.runs_of_texts(offsets):
            sets, sizes = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], words)
            ends = np.cumsum(sizes)
            raw = [sets[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            part = batch.slice(first, last - first)
            yield pa.record_batch([part.column("doc"), pa.array(raw, pa.binary()), part.column("groups")], names=["doc", "shingles", "groups"])


def _compared(batches, percent):
    """Rows sorted by group, the group's centre first: is each member similar to it?"""
    centre, of = None, None
    for batch in batches:
        out = []
        for b, salt, is_centre, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("b", "salt", "centre", "doc", "shingles")), strict=True):
            shingles = np.frombuffer(raw, np.uint64)
            if is_centre:
                # An id whose rows differ in text has several sets.
                centre = [shingles] if of != (b, salt) else [*centre, shingles]
                of = b, salt
            elif of == (b, salt):
                for other in centre:
                    both = len(np.intersect1d(shingles, other, assume_unique=True))
                    out.append((doc, b, 100 * both >= percent * (len(shingles) + len(other) - both)))
        if out:
            x, y, ok = zip(*out, strict=True)
            yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps do not rule out."""
    of = lambda c: info.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "bits_a", "n_a", "bits_b", "n_b")
    rows = rows.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return rows.mapInArrow(lambda it: _maybe(it, percent), "a long, b long, maybe boolean").where("maybe").select("a", "b").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Every set goes to the groups it is compared in: b is the centre of a group, and
    a centre with many members is repeated for every few hundred of them.
    """
    spark = texts.sparkSession
    centres = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("salts"))
    salted = pairs.join(centres, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    group = lambda centre: F.struct("b", "salt", F.lit(centre).alias("centre"))
    places = salted.select(F.col("a").alias("doc"), group(False).alias("g")).union(
        salted.select("b", "salt").distinct().select(F.col("b").alias("doc"), group(True).alias("g"))
    )
    wanted = written(places.groupBy("doc").agg(F.collect_list("g").alias("groups")), "wanted")
    sets = _named(texts, wanted).select("doc", "text", "groups")
    kind = "groups array<struct<b: long, salt: int, centre: boolean>>"
    rows = sets.mapInArrow(lambda it: _sets(it, words), f"doc long, shingles binary, {kind}").select("doc", "shingles", F.explode("groups").alias("g"))
    rows = rows.select("g.b", "g.salt", "g.centre", "doc", "shingles")
    dealt = rows.repartition(shuffle_tasks(spark), "b", "salt").sortWithinPartitions("b", "salt", F.desc("centre"))
    found = dealt.mapInArrow(lambda it: _compared(it, percent), "a long, b long, ok boolean")
    return found.where("ok").select("a", "b").distinct()


def _named(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the ids in a written table, broadcast if they are few."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc")


def _one_of_each_set(ids: DataFrame, info: DataFrame) -> DataFrame:
    """Of ids that have one and the same set, and no other, the least; all others stay.

    Equal sets have equal signatures, and their documents are linked as copies.
    """
    sets = info.where("n > 0").join(ids.select("doc"), "doc", "left_semi").groupBy("doc").agg(
        F.collect_set(F.struct("h1", "h2")).alias("sets")
    )
    single = sets.where(F.size("sets") == 1).groupBy("sets").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    spare = sets.join(single.where("n > 1"), "sets").where("doc <> least").select("doc")
    return ids.join(spare, "doc", "left_anti")


def _classes(
    texts: DataFrame, info: DataFrame, words: int, percent: int, large: int, broadcast_signatures: int = BROADCAST_SIGNATURES
) -> DataFrame:
    """(class, doc, hub) of all classes of several members, written; hub is the least.

    Signatures with the same members are one class. Large classes are left to the
    sets that could have a partner in no other class; those sign once more.
    """
    signed = texts.mapInArrow(lambda it: _signed(it, words, percent), "sig long, doc long, entry long")
    members = Window.partitionBy("sig")
    kept = (F.count("*").over(members).alias("members"), F.min("doc").over(members).alias("hub"), F.bit_xor(F.xxhash64("doc")).over(members).alias("content"))
    # Were two classes taken for one, only more members would be compared.
    as_class = lambda df: df.select(F.xxhash64("content", "members", "hub").alias("class"), "doc", "hub")
    found = written(signed.select("*", *kept).where("members > 1"), "classes")
    small = as_class(found.where(F.col("members") <= large))
    crowded = found.where(F.col("members") > large)
    open_lists = crowded.groupBy("doc", "entry").agg(F.count_distinct("sig").alias("n")).where("n >= entry & 4294967295")
    ids = open_lists.groupBy("doc").agg(F.collect_set(F.shiftright("entry", 32).cast("int")).alias("lists"))
    again = _named(texts, written(_one_of_each_set(written(ids, "open"), info), "crowded")).select("doc", "text", "lists")
    kind = "sig long, doc long, mark long, list int, lacks int"
    known = written(crowded.select("sig").distinct(), "late")
    if known.count() <= broadcast_signatures:
        numbers = np.sort(known.toArrow().column("sig").to_numpy())
        late = texts.sparkSession.sparkContext.broadcast(numbers)
        first = again.mapInArrow(lambda it: _signed_again(it, words, percent, late), kind).select("sig", "doc")
    else:
        rows = again.mapInArrow(lambda it: _signed_again(it, words, percent), kind)
        marked = rows.join(known.withColumn("late", F.lit(True)), "sig", "left")
        order = Window.partitionBy("doc", "mark", "list").orderBy(F.coalesce("late", F.lit(False)), "sig")
        first = marked.withColumn("place", F.dense_rank().over(order)).where("place <= lacks + 1").select("sig", "doc")
    anew = as_class(first.select("*", *kept).where("members > 1"))
    return written(small.union(anew).distinct(), "classes")


def key_of(id: str, text: str) -> F.Column:
    """The id, or else a key that rows without an id share if they have one text."""
    made = F.lit(NO_ID_KEYS) + F.xxhash64(whole(text)).bitwiseAND(F.lit((1 << 60) - 1))
    return F.coalesce(F.col(f"`{id}`").cast("long"), made)


def similar_documents(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, large_class: int = LARGE_CLASS
) -> DataFrame:
    """(doc, n_shingles, component) of every id, and of every row without one;
    component is the least id it is linked with, over any number of links."""
    groups = similar_keys(df, id, text, words, percent, large_class)
    # Rows without an id stay as many as they are.
    each = groups.withColumn("row", F.explode(F.sequence(F.lit(1), F.greatest("no_id", F.lit(1)).cast("int"))))
    return each.select(F.when(F.col("no_id") == 0, F.col("key")).alias("doc"), "n_shingles", F.when(F.col("named"), F.col("first")).alias("component"))


def similar_keys(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, large_class: int = LARGE_CLASS
) -> DataFrame:
    """(key, no_id, n_shingles, first, named) of every key that ``key_of`` gives.

    ``no_id`` counts the rows without an id, ``first`` is the key of the component's
    least id, or of its first row if it has no id, which ``named`` tells.
    """
    picked = pick(df, doc=id, text=text)
    out = _components_of(spread(picked).select(key_of("doc", "text").alias("doc"), whole("text").alias("text")), words, percent, large_class)
    nulls = written(picked.where("doc IS NULL").groupBy(key_of("doc", "text").alias("key")).agg(F.count("*").alias("no_id")), "no_id")
    out = out.select(F.col("doc").alias("key"), "n_shingles", "component")
    if nulls.isEmpty():
        return out.select("key", F.lit(0).cast("long").alias("no_id"), "n_shingles", F.col("component").alias("first"), F.lit(True).alias("named"))
    known = written(out.join(nulls, "key", "left").withColumn("no_id", F.coalesce("no_id", F.lit(0))), "keys")
    least = known.where(F.col("component") >= NO_ID_KEYS).groupBy("component").agg(F.min(F.when(F.col("no_id") == 0, F.col("key"))).alias("least"))
    return known.join(least, "component", "left").select(
        "key", "no_id", "n_shingles", F.coalesce("least", "component").alias("first"),
        (F.col("least").isNotNull() | (F.col("component") < NO_ID_KEYS)).alias("named"),
    )


def _components_of(texts: DataFrame, words: int, percent: int, large_class: int) -> DataFrame:
    """(doc, n_shingles, component) of every doc."""
    info = written(texts.mapInArrow(lambda it: _info(it, words), "doc long, n long, h1 long, h2 long, bits binary"), "sets")

    some = info.where("n > 0")
    first = some.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("h1", "h2", "rep")
    same = some.select("doc", "h1", "h2").join(first, ["h1", "h2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b")).where("a <> b")
    same = written(same, "same")
    known = same.select("a", F.col("b").alias("rep"))

    classes = _classes(texts, info, words, percent, large_class)
    # Of every class, the members beside its first one.
    stars = classes.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    stars = written(_between_firsts(stars, known), "stars")
    found = written(_linked(written(_possible(stars, info, percent), "possible"), texts, words, percent), "linked")
    links = same.union(found)
    labels = written(components(links), "components")

    # Members that failed against the first of their class, and are in another
    # component, meet the rest of it.
    at = lambda c: F.coalesce(F.col(f"{c}_at"), F.col(c))
    label = lambda pairs, c: pairs.join(labels.toDF(c, f"{c}_at"), c, "left")
    apart = lambda pairs: label(label(pairs, "a"), "b").where(at("a") != at("b")).select("a", "b")
    failed = written(apart(stars.join(found, ["a", "b"], "left_anti")), "failed")
    if not failed.isEmpty():
        firsts = classes.join(known.toDF("doc", "doc_rep"), "doc", "left").join(known.toDF("hub", "hub_rep"), "hub", "left")
        firsts = firsts.select("class", F.coalesce("doc_rep", "doc").alias("doc"), F.coalesce("hub_rep", "hub").alias("hub")).distinct()
        firsts = written(firsts.join(labels.toDF("doc", "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc")), "firsts")
        either = failed.union(failed.select("b", "a")).toDF("doc", "hub")
        sizes = firsts.groupBy("class").agg(F.count("*").alias("members"))
        sized = written(firsts.join(sizes, "class"), "sized")
        lone = sized.join(either, ["doc", "hub"], "left_semi").select("class", "doc", F.col("label").alias("own"), "members")
        # Members of narrow classes meet one by one, those of wide ones in blocks.
        rest = sized.where(F.col("members") <= WIDE_CLASS).where("doc <> hub").select("class", F.col("doc").alias("other"), "label")
        meet = lone.where(F.col("members") <= WIDE_CLASS).join(rest, "class").where("label <> own")
        more = meet.select(F.greatest("doc", "other").alias("a"), F.least("doc", "other").alias("b")).distinct()
        possible = _possible(more.join(stars, ["a", "b"], "left_anti"), info, percent)
        wide = sized.where(F.col("members") > WIDE_CLASS)
        if not wide.isEmpty():
            possible = possible.union(_in_blocks(wide, lone.where(F.col("members") > WIDE_CLASS), info, percent)).distinct()
        possible = written(possible.join(stars, ["a", "b"], "left_anti"), "possible")
        if not possible.isEmpty():
            late = written(_linked(possible, texts, words, percent), "late")
            labels = components(links.union(late))
    out = info.groupBy("doc").agg(F.max("n").alias("n_shingles")).join(labels.toDF("doc", "component"), "doc", "left")
    return out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))


def _between_firsts(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of copies as pairs of the first documents with those sets."""
    joined = pairs.join(known.toDF("a", "a_rep"), "a", "left").join(known.toDF("b", "b_rep"), "b", "left")
    a, b = F.coalesce("a_rep", "a"), F.coalesce("b_rep", "b")
    return joined.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
