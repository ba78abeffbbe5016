"""Operators that find repeats, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, ODD, prose, with_odd_columns
from tracewell.llm import chunk_dedup, components, grace_dedup, jaccard_join, line_dedup, suffix_dedup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(seed, n=40):
    r = random.Random(seed)
    base = [prose(r, r.randrange(5, 120)) for _ in range(6)]
    texts = []
    for _ in range(n):
        words = r.choice(base).split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = "x" + str(r.randrange(100))
        texts.append(r.choice(("", prose(r, 8) + "\n")) + " ".join(words) + r.choice(("", "\n" + base[0])))
    return texts


# --- lines -------------------------------------------------------------------


def lines_by_hand(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    kept = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or d == max(holders[key(x)])]
        kept[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return kept


@pytest.mark.parametrize("range_lines", [500_000, 40])
def test_lines(spark, docs, range_lines):
    r = random.Random(3)
    pool = [prose(r, 6) for _ in range(12)] + ["short", "", "  Padded line of some length \t", "é" * 20, "É" * 19]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, pool[0]) for i in range(300)]
    out = line_dedup.without_repeated_lines(with_odd_columns(docs(rows)), counts="counts", range_lines=range_lines)
    got = {x.doc_id: (x.counts.n_lines, x.counts.n_dropped, x.text) for x in out.collect()}
    assert got == lines_by_hand(rows)


@pytest.mark.parametrize("block", [64, 300])
def test_long_texts_in_parts(monkeypatch, block):
    """Parts and whole texts have the same keys, in lines longer than a block as well."""
    r = random.Random(block)
    line = lambda n: "".join(r.choice("abcÄé XYZ\t") for _ in range(n))
    texts = ["\n".join(line(r.choice((0, 3, 25, 60, 700))) for _ in range(r.randrange(1, 30))) + r.choice(("", "\n")) for _ in range(60)]
    texts += [" " * 900 + line(900) + " " * 900, " " * 700, "\n" * 700, "Ä" * 700, "", None]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "mark", "text"])
    keys = lambda: sorted(tuple(x.values()) for b in line_dedup._keys(iter([batch]), 20) for x in b.to_pylist())
    whole = keys()
    monkeypatch.setattr(line_dedup.X, "BLOCK_BYTES", block)
    data, offsets = line_dedup.X.packed(batch.column("text"))
    assert max(x[2][-1] for x in line_dedup._parts(data, offsets) if 0x0A in data[x[1] : x[1] + x[2][-1]]) <= block
    assert whole and keys() == whole


def test_key_over_many_batches():
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 40, 400))
    keys[100:300] = 20
    keys.sort()
    docs = -np.sort(-r.integers(0, 30, 400))
    order = np.lexsort((-docs, keys))
    drop = line_dedup.later_lines(keys[order], keys[order], docs[order], 3)
    for k in np.unique(keys):
        mine = docs[order][keys[order] == k]
        want = (mine != mine.max()) & (len(set(mine.tolist())) >= 3)
        assert (drop[keys[order] == k] == want).all()


def test_lines_rows_of_one_id_and_no_id(docs):
    line = "a line that is long enough"
    out = line_dedup.without_repeated_lines(docs([(1, line), (1, line), (2, line), (None, line), (None, line)]))
    assert [x.text for x in out.collect()] == [line] * 5  # two documents only


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.without_repeated_lines(none).count() == 0
    assert jaccard_join.similar_documents(none).count() == 0
    assert grace_dedup.duplicates(none).count() == 0
    assert chunk_dedup.without_repeated_chunks(none).count() == 0
    assert suffix_dedup.without_repeated_strings(none).count() == 0


# --- shingles ----------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def groups_by_hand(rows, percent=75):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("large_class", [16, 2])
def test_similar_documents(docs, large_class):
    r = random.Random(5)
    rows = list(enumerate(some_texts(5, 90)))
    # Edits of every strength, a passage in ever new surroundings, short texts.
    base = prose(r, 80).split()
    for i in range(60):
        words = list(base)
        for _ in range(i // 3):
            words[r.randrange(len(words))] = "y" + str(r.randrange(1000))
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, prose(r, r.randrange(2, 40)) + " " + " ".join(base[:40]) + " " + prose(r, 10)) for i in range(40)]
    rows += [(3000 + i, prose(random.Random(i // 3), 4 + i % 5 + i // 3)) for i in range(40)]
    rows += [(4000 + i, t) for i, t in enumerate(ODD)] + [(5000 + i, rows[3][1].upper()) for i in range(30)]
    out = jaccard_join.similar_documents(with_odd_columns(docs(rows)), large_class=large_class)
    assert {x.doc: (x.n_shingles, x.component) for x in out.collect()} == groups_by_hand(rows)


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_share_a_signature(seed):
    r = np.random.default_rng(seed)
    for _ in range(150):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        while True:
            c = np.unique(np.concatenate([np.delete(b, r.integers(0, len(b))), r.integers(0, 1 << 63, int(r.integers(0, 3))).astype(np.uint64)])) if len(b) > 1 else b
            both = len(np.intersect1d(a, c))
            if 100 * both < 75 * (len(a) + len(c) - both) or (len(c) == len(b) == 1):
                break
            b = c
        one, two = (jaccard_join.signatures(x, np.array([len(x)])) for x in (a, b))
        common = np.intersect1d(one.sig, two.sig)
        assert len(common)
        # As many as the lists promise, in some list that both have.
        lists = set(one.list_.tolist()) & set(two.list_.tolist())
        assert any(
            len(np.intersect1d(one.sig[one.list_ == x], two.sig[two.list_ == x])) >= min(one.shares[one.list_ == x][0], two.shares[two.list_ == x][0])
            for x in lists
        )


def test_bitmaps_never_rule_out(seed=2):
    r = np.random.default_rng(seed)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 300, int(r.integers(1, 120))).astype(np.uint64)) for _ in range(2))
        bits = jaccard_join._bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert jaccard_join.most_in_common(bits[0], len(a), bits[1], len(b)) >= len(np.intersect1d(a, b))


def test_first_signatures_of_each_list():
    r = np.random.default_rng(4)
    n = 400
    of, lists = r.integers(0, 6, n), r.integers(0, 4, n)
    sig = r.integers(-40, 40, n)
    lacks = (of + lists) % 4
    late = np.unique(r.integers(-40, 40, 30))
    got = jaccard_join._first_of_each(sig, of, lists, lacks, late)
    for o in range(6):
        for x in range(4):
            mine = np.flatnonzero((of == o) & (lists == x))
            order = sorted({(s in set(late.tolist()), s) for s in sig[mine].tolist()})
            wanted = {s for _, s in order[: (o + x) % 4 + 1]}
            assert sorted(sig[i] for i in got if of[i] == o and lists[i] == x) == sorted(s for s in sig[mine].tolist() if s in wanted)
    assert len(jaccard_join._first_of_each(sig[:0], of[:0], lists[:0], lacks[:0], late[:0])) == 0


@pytest.mark.parametrize("sent", [0, 10**6])
def test_crowded_signatures_sent_or_joined(spark, docs, monkeypatch, sent):
    """A family of near copies and copies of them, with classes taken for large early."""
    monkeypatch.setattr(jaccard_join._classes, "__defaults__", (sent,))
    r = random.Random(6)
    base = prose(r, 60).split()
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(r.randrange(3)):
            words[r.randrange(60)] = "other" + str(r.randrange(9))
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[3][1]) for i in range(15)] + [(200 + i, prose(r, 50)) for i in range(5)]
    got = {x.doc: x.component for x in jaccard_join.similar_documents(docs(rows), large_class=3).collect()}
    assert got == {d: first for d, (_, first) in groups_by_hand(rows).items()}


def test_rows_of_one_id(docs):
    text = prose(random.Random(1), 30)
    got = jaccard_join.similar_documents(docs([(5, text), (5, text), (3, text), (None, text), (9, "other text")])).collect()
    assert {(x.doc, x.component) for x in got} == {(3, 3), (5, 3), (9, 9), (None, 3)} and len(got) == 4


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(150)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}


# --- exact copies ------------------------------------------------------------


@pytest.mark.parametrize("table_bytes", [48 << 20, 300])
def test_exact_copies(docs, table_bytes):
    rows = list(enumerate(some_texts(7, 50) + ODD))
    rows += [(500 + i, t.replace(" ", "  ") + "\n" * (i % 3)) for i, t in rows[:20] if t]
    rows += [(700 + i, "copy of a copy") for i in range(200)]
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[bare(t)].append((-len(t or ""), d))
    want = {}
    for d, t in rows:
        group = groups[bare(t)]
        keep = min(group)[1]
        want[d] = (keep, len(group), keep == d, hashlib.sha256(bare(t).encode()).hexdigest())
    out = grace_dedup.duplicates(with_odd_columns(docs(rows)), table_bytes=table_bytes)
    assert {x.doc: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in out.collect()} == want


def test_one_long_content_is_not_spilled(monkeypatch):
    """Copies of a content beyond the memory stay in one table."""
    monkeypatch.setattr(grace_dedup.tempfile, "TemporaryDirectory", None)
    digest, content = hashlib.sha256(b"x").digest(), b"x" * 5_000
    entries = list(grace_dedup.grouped([(digest, content, 1, 5_000, i, i, [i]) for i in range(5)], 1_000))
    assert [(e[2], e[4], e[6]) for e in entries] == [(5, 0, [0, 1, 2, 3, 4])]


def test_equal_digests_of_other_contents():
    record = lambda i, content: (b"\0" * 32, content, 1, 5, i, i, [i])
    records = [record(i, b"ab" if i % 2 else b"cd") for i in range(10)]
    for memory in (10**9, 100):
        found = list(grace_dedup.grouped(records, memory))
        assert sorted((e[1], e[2], e[4]) for e in found) == [(b"ab", 5, 1), (b"cd", 5, 0)]


def test_copies_repeated_rows_and_no_id(docs):
    got = grace_dedup.duplicates(docs([(None, "a b"), (4, "ab"), (4, "ab"), (None, "zz")])).collect()
    assert sorted((str(x.doc), str(x.keep_id), x.group_size) for x in got) == [("4", "None", 3), ("4", "None", 3), ("None", "None", 1), ("None", "None", 3)]
    assert sum(x.kept for x in got) == 2


# --- byte strings ------------------------------------------------------------


def strings_by_hand(rows, length, keep_first):
    places = defaultdict(list)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].append((d, i))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            found = places[b[i : i + length]]
            if len(found) > 1 and not (keep_first and min(found) == (d, i)):
                gone[i : i + length] = True
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("class_contents", [1_000, 1])
def test_repeated_strings(docs, keep_first, class_contents):
    r = random.Random(9)
    passage = prose(r, 40)
    rows = list(enumerate(some_texts(9, 40) + ODD))
    rows += [(300 + i, prose(r, 10) + passage + prose(r, 10)) for i in range(12)]
    length = 100
    out = suffix_dedup.without_repeated_strings(
        with_odd_columns(docs(rows)), length=length, keep_first=keep_first, name="found", class_contents=class_contents
    )
    got = {x.doc_id: bytes(x.found.kept) for x in out.select("doc_id", "found").collect()}
    assert got == strings_by_hand(rows, length, keep_first)


def test_longest_previous_factors():
    r = random.Random(4)
    for _ in range(20):
        data = bytes(r.choice(b"ab") for _ in range(60))
        length = 16
        starts = np.arange(len(data) - length + 1)
        order_of = suffix_dedup.SuffixOrder(np.frombuffer(data, np.uint8), starts, length)
        order = np.lexsort((starts, order_of.rank))
        assert [data[i : i + length] for i in order] == sorted(data[i : i + length] for i in starts)
        lpf, source = suffix_dedup.longest_previous_factors(order, order_of.common_prefixes(order), starts)
        for i in starts:
            shared = [next((k for k in range(length) if data[i + k] != data[j + k]), length) for j in range(i)]
            assert lpf[i] == max(shared, default=0)
            assert not lpf[i] or shared[source[i]] == lpf[i]


@pytest.mark.parametrize("length", [12, 70, 100])
def test_copies_of(length):
    """Factors in both directions, contents with one region and with several."""
    r = random.Random(length)
    for _ in range(20):
        base = bytes(r.choice(b"abc") for _ in range(3 * length))
        contents, at, raw = [], 0, set()
        for _ in range(12):
            a = r.randrange(len(base) - length - 6)
            piece = base[a : a + length + r.randrange(6)] + bytes(r.choice(b"ab") for _ in range(r.randrange(3)))
            if piece in raw:
                continue
            raw.add(piece)
            contents.append(piece)
        regions = []
        for c, piece in enumerate(contents):
            for _ in range(r.choice((1, 1, 2, 4))):
                regions.append(c)
        r.shuffle(regions)
        places = [(p // 5, p % 5 * 1_000) for p in range(len(regions))]
        of = [[p for p, c in zip(places, regions, strict=True) if c == x] for x in range(len(contents))]
        counts = np.array([len(c) - length + 1 for c in contents])
        pair = lambda which: tuple(np.array([which(x)[i] for x in of]) for i in (0, 1))
        got = suffix_dedup.copies_of(
            np.frombuffer(b"".join(contents), np.uint8), np.cumsum([0, *map(len, contents)]), counts, pair(min), pair(max),
            np.array([len(x) > 1 for x in of]), length,
        )
        seen = defaultdict(list)
        for (d, start), c in zip(places, regions, strict=True):
            for i in range(counts[c]):
                seen[contents[c][i : i + length]].append((d, start + i))
        want = [[], [], []]
        for c, x in enumerate(of):
            for i in range(counts[c]):
                copies = seen[contents[c][i : i + length]]
                here = lambda p: (p[0], p[1] + i)
                want[0].append(min(copies) < here(min(x)))
                want[1].append(len(copies) > 1)
                want[2].append(len(x) > 1 and min(copies) < here(max(x)))
        assert [f.tolist() for f in got] == want


def test_a_giant_text_in_parts(docs, monkeypatch):
    r = random.Random(6)
    text = prose(r, 400)
    rows = [(1, text + " " + prose(r, 50) + text[:900]), (2, prose(r, 30) + text[500:1500])]
    monkeypatch.setattr(suffix_dedup.X, "BLOCK_BYTES", 1_000)
    data, offsets = suffix_dedup.X.packed(pa.array([t for _, t in rows]))
    seen = set()
    for first, low, high, ends in suffix_dedup._parts(offsets, 100):
        found = suffix_dedup.regions(data[low:high], ends, 100)
        for start, n, owner in zip(found[3], found[4], found[6], strict=True):
            for i in range(start, start + n):
                seen.add((first + owner, int(low + i - offsets[first + owner])))
    assert seen == {(k, i) for k, (_, t) in enumerate(rows) for i in range(len(t.encode()) - 99)}


def test_crowded_lists_of_an_id_of_many_texts(docs):
    r = random.Random(15)
    rows = []
    for j in range(120):
        words = prose(r, 80 + j % 3).split()
        rows.append((0, " ".join(words)))
        for i in range(6):
            changed = list(words)
            changed[12 * i + 6] = "zz" + str(i)
            rows.append((100 + 6 * j + i, " ".join(changed)))
    out = jaccard_join.similar_documents(docs(rows), large_class=2).collect()
    assert {x.doc: x.component for x in out} == {d: 0 for d, _ in rows}


# --- chunks ------------------------------------------------------------------


def test_repeated_chunks(docs):
    r = random.Random(11)
    passages = [prose(r, 70) for _ in range(4)]
    rows, planted = [], {}
    for i in range(40):
        p = r.randrange(8)
        body = [prose(r, r.randrange(20, 60)) for _ in range(3)]
        if p < 4:
            body.insert(1, passages[p])
            planted[i] = p
        rows.append((i, " ".join(body)))
    rows += [(100, rows[0][1]), (101, None), (102, "")]
    out = {x.doc_id: x.cut for x in chunk_dedup.without_repeated_chunks(docs(rows)).collect()}
    first = {p: min(i for i, q in planted.items() if q == p) for p in set(planted.values())}
    for i, text in rows[:40]:
        removed = out[i].n_bytes - len(out[i].kept)
        if i in planted and first[planted[i]] != i:
            assert removed >= len(passages[planted[i]]) // 2
            assert first[planted[i]] in out[i].sources
        else:
            assert removed == 0 and bytes(out[i].kept).decode() == text
    # Of a copy everything goes but what ends it.
    assert len(out[100].kept) < 64 and out[101].n_bytes == 0 and out[102].n_bytes == 0


def test_passages_of_51_short_words(docs):
    r = random.Random(13)
    short = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 5))) for _ in range(n))
    rows, passages = [], []
    for i in range(60):
        p = short(51)
        passages.append(p)
        for doc in (2 * i, 2 * i + 1):
            rows.append((doc, f"{short(30)} {doc}<{p}>{"ab"[doc % 2]} {short(30)}"))
    # Long passages without any mark in them: the fetched bytes do not reach at once.
    plain = "x" * 3000
    rows += [(200, f"{short(20)} 1{plain}{passages[0]}2"), (201, f"{short(25)} 3{plain}{passages[0]}4")]
    out = {x.doc_id: x.cut for x in chunk_dedup.without_repeated_chunks(docs(rows)).collect()}
    texts = dict(rows)
    found = 0
    for i in range(1, 60):
        p, first, later = passages[i], out[2 * i], out[2 * i + 1]
        if later.n_shared:
            found += 1
            # All of it, on both sides, with the edges that surround it in both.
            assert first.n_shared == later.n_shared == len(p) + 2 and first.spans == [] and later.sources == [2 * i]
            assert bytes(later.kept).decode() == texts[2 * i + 1].replace(f"<{p}>", "")
    assert found >= 58
    assert plain not in bytes(out[201].kept).decode() and passages[0] not in bytes(out[201].kept).decode()


def test_chunks_follow_the_content():
    r = random.Random(12)
    text = prose(r, 800).encode()
    cut = lambda b: {b[i:j] for i, j, _ in zip(*chunk_dedup.chunk_bounds(np.frombuffer(b, np.uint8), np.array([0, len(b)])), strict=True)}
    one, two = cut(text), cut(text[:2000] + b"inserted" + text[2000:])
    assert b"".join(text[i:j] for i, j, _ in zip(*chunk_dedup.chunk_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)])), strict=True)) == text
    assert len(one - two) <= 6
    assert all(len(c) <= chunk_dedup.MAX_CHUNK for c in one)
    # A text is cut alike wherever it lies in a block.
    both = np.frombuffer(b"something else" + text, np.uint8)
    starts, stops, owner = chunk_dedup.chunk_bounds(both, np.array([0, 14, len(both)]))
    assert {bytes(both[i:j]) for i, j, o in zip(starts, stops, owner, strict=True) if o == 1} == one


def test_strings_of_rows_without_id(docs):
    text = prose(random.Random(1), 60)
    out = suffix_dedup.without_repeated_strings(docs([(None, text), (3, text)]), length=50).collect()
    assert {x.doc_id: len(x.cut.kept) for x in out} == {None: 0, 3: len(text)}
    assert suffix_dedup.without_repeated_strings(docs([(1, text), (1, text)]), length=50).where(F.length("cut.kept") > 0).count() == 2
