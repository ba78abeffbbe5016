import random

import numpy as np
import pyarrow as pa
import pytest

from tracewell.operators import ioc, markers


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", markers.SIZES)
def test_codes_are_exact(size):
    data = np.frombuffer("abc é\x00xabc".encode(), np.uint8)
    raw = data.tobytes()
    want = [int.from_bytes(raw[i : i + size], "little") for i in range(len(raw) - size + 1)]
    assert markers.codes(data, size).tolist() == want
    assert markers.codes(data[: size - 1], size).tolist() == []


def test_size_of_a_marker():
    assert [markers.size_of(n) for n in (0, 1, 2, 3, 4, 7, 8, 100)] == [0, 1, 2, 2, 4, 4, 8, 8]


@pytest.mark.parametrize("n", [0, 1, 50, 5000])
def test_filter_never_rules_out(n):
    r = np.random.default_rng(n)
    grams, others = (r.integers(0, 1 << 63, n + k, dtype=np.uint64) for k in (0, 20_000))
    made = markers.Filter.of(grams)
    assert made.maybe(grams).all() and made.maybe(others).mean() < 0.1


def test_anchor_is_the_rarest_gram(spark):
    texts = ["common words"] * 50 + ["common zebra words", "a zebra", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "__text string").repartition(3)
    index = markers.Index([b"common zebra", b"common words", b"never seen here", b"zeb"])
    frequency = markers._frequencies(df.where("__text IS NOT NULL"), index)
    for size, grams in index.grams.items():
        for gram, n in zip(grams.tolist(), frequency[size].tolist()):
            assert n == sum(gram.to_bytes(size, "little") in t.encode() for t in texts if t)
    anchors = index.anchored(frequency)
    got = {int(m): int(g).to_bytes(s, "little") for s, rows in anchors.items() for g, _, m in zip(*rows)}
    # In one text only, with no gram of the frequent word; what no text has is not looked for.
    assert b"z" in got[0] and got[1] == b"common w" and 2 not in got and got[3] == b"ze"


def test_grams_at_the_edges_of_windows(monkeypatch):
    monkeypatch.setattr(markers, "BLOCK", 16)
    r = random.Random(5)
    texts = ["".join(r.choice("abé ") for _ in range(r.randrange(80))) for _ in range(40)] + [None, ""]
    wanted = sorted({t[i : i + n] for t in texts if t for i, n in ((3, 1), (5, 2), (7, 5), (2, 8), (1, 30)) if t[i : i + n]})
    raw = [m.encode() for m in wanted]
    index = markers.Index(raw)
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["__row", "__text"])
    found = list(markers._search(iter([batch.slice(0, 20), batch.slice(20)]), raw, index.anchored(index.by_markers())))
    got = sorted(p for b in found for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert got == sorted((i, j) for i, t in enumerate(texts) if t for j, m in enumerate(wanted) if m in t)


def test_no_nested_loop_above_64_markers(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choice(["ab", "cde", "f", "ghij"]) + str(r.randrange(40)) for _ in range(30))) for i in range(60)]
    short = [(i, m) for i, m in enumerate(sorted({w for _, t in texts for w in t.split(" ")} | {"de1 f", "f2 gh", "é"}))]
    assert len(short) > 64
    docs = spark.createDataFrame(texts, "doc int, content string").repartition(4)
    names = spark.createDataFrame(short, "m int, content_contains string")
    want = sorted((d, m) for d, t in texts for m, k in short if k in t)
    for limits in (ioc.Limits(), ioc.Limits(0, 1, 50)):
        hits = ioc.content_hits(docs, names, keep=["doc"], limits=limits)
        plan = plan_of(hits)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted((x.doc, x.m) for x in hits.collect()) == want


def test_portions():
    assert markers.portions([]) == [[]]
    assert markers.portions(["a", "b"]) == [["a", "b"]]
    big = "x" * (markers.BROADCAST_CHARS // 2 + 1)
    assert [len(p) for p in markers.portions([big, big, "a"])] == [1, 2]


def test_texts_are_looked_at_in_pieces(monkeypatch):
    monkeypatch.setattr(markers, "PIECE", 10)
    texts = ["abc", None, "", "defghij", "k", "l" * 25, "m", ""]
    batch = pa.record_batch([pa.array(texts)], names=["__text"])
    slices = [p.column(0).to_pylist() for p in markers.pieces([batch, batch.slice(0, 0)], "__text")]
    assert [x for p in slices for x in p] == texts
    assert all(sum(len(x or "") for x in p) <= 10 or len(p) == 1 for p in slices)
    data, ends = markers.packed(batch.slice(3, 2).column(0))
    assert data.tobytes() == b"defghijk" and ends.tolist() == [0, 7, 8]


def test_the_join_reads_texts_a_few_times(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    data = [(i, f"text number {i} of many") for i in range(50)]
    texts = spark.createDataFrame(data, "id long, __text string").mapInArrow(counted, "id long, __text string")
    wanted = spark.createDataFrame([("number 7 ",), ("of",), ("no such thing",)], "__marker string")
    found = markers.found_by_join(texts, ["id"], wanted, 10).collect()
    assert sorted((r["id"], r["__marker"]) for r in found) == sorted([(7, "number 7 "), *[(i, "of") for i in range(50)]])
    # Grams counted, anchors met, copies counted, hits compared.
    assert read.value <= 5 * len(data)
