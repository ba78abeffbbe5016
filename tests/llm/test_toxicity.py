"""Toxicity: terms and counts against brute force, the label model on known voters, held-out accuracy."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD, prose, with_odd_columns
from tracewell.llm import QUERIES, toxicity
from tracewell.llm import textops as X

LARGE = "/root/testdata/sf0.1"
LABELS = "doc_id long, toxic int"


def held(i):
    return crc32(str(i).encode()) % 5 == 0


def terms_by_hand(text):
    words = {w for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()) if len(w) >= 3}
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.STARTS if len(w) > n}


def hashed(term):
    kind, word = term
    data = np.frombuffer(word, np.uint8)
    value = X.RangeHash(data, seed=11).of(np.array([0]), np.array([len(data)]))
    return int((X.mix(value + np.uint64(kind)) if kind else value)[0])


TEXTS = ["Über die Ähre, ÜBER und über", "", "a bb ccc dddd eeeee", "x" * 50 + " word", "word Words wordily", "same same same", "1dea!! id-10t"]


def test_terms_like_brute_force():
    data, ends = toxicity._lowered(pa.array([*TEXTS, None]))
    text, kinds, hashes = toxicity.terms_of(data, ends)
    got = Counter(zip(text.tolist(), kinds.tolist(), hashes.tolist()))
    want = {(i, k, hashed((k, w))) for i, t in enumerate(TEXTS) for k, w in terms_by_hand(t)}
    assert set(got) == want and max(got.values()) == 1


def test_counts_like_brute_force(monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BYTES", 64)
    monkeypatch.setattr(toxicity, "HELD_TERMS", 100)
    r = random.Random(2)
    texts = [*TEXTS, *[" ".join(r.choice(["trash", "trasher", "oak", "oaken", "elm"]) for _ in range(r.randrange(60))) for _ in range(30)]]
    labels = [r.randrange(2) for _ in texts]
    batch = pa.record_batch([pa.array(texts), pa.array(labels)], names=["text", "toxic"])
    docs, toxic, kind = Counter(), Counter(), {}
    for part in toxicity._count_terms(iter([batch.slice(0, 9), batch.slice(9)])):
        for term, k, t, d in zip(*(part.column(c).to_pylist() for c in ("term", "kind", "toxic", "docs"))):
            docs[term % (1 << 64)] += d
            toxic[term % (1 << 64)] += t
            kind[term % (1 << 64)] = k
    want_docs, want_toxic = Counter(), Counter()
    for t, label in zip(texts, labels):
        for x in terms_by_hand(t):
            want_docs[hashed(x)] += 1
            want_toxic[hashed(x)] += label
            assert kind[hashed(x)] == x[0]
    assert docs == want_docs and +toxic == +want_toxic


def test_patterns():
    texts = ["plain words here", "WHAT!!!! A MESS!", "f**k this sh*t", "an i d i o t here", "m0ron st4nd", "loooser aab", "", "aaa"]
    raw, ends = X.packed(pa.array(texts))
    counts = toxicity.pattern_counts(raw, ends)
    letters, capitals, words, marks, masked, spaced, inside, stretched = counts.T.tolist()
    assert letters == [sum(c.isalpha() for c in t) for t in texts] and capitals == [sum(c.isupper() for c in t) for t in texts]
    assert marks == [t.count("!") for t in texts] and words[:2] == [3, 3]
    assert [m > 0 for m in masked] == [i == 2 for i in range(8)] and [s > 0 for s in spaced] == [i == 3 for i in range(8)]
    assert [d > 0 for d in inside] == [i == 4 for i in range(8)] and [s > 0 for s in stretched] == [i in (5, 7) for i in range(8)]


def simulated(n, seed=3):
    """Votes of voters with known accuracies; the second half of them copy one voter."""
    r = np.random.default_rng(seed)
    m = len(toxicity.VOTERS)
    toxic = r.random(n) < 0.2
    votes = np.zeros((n, m), np.int8)
    for j in range(8):
        right = r.random(n) < 0.75
        says = np.where(right, toxic, ~toxic)
        votes[:, j] = np.where(r.random(n) < 0.8, np.where(says, 2, 1), 0)
    copied = r.random(n) < 0.95
    for j in range(8, 16):  # eight voters who repeat voter 0
        votes[:, j] = np.where(copied, votes[:, 0], 0)
    return votes, toxic


def test_label_model_finds_accuracies_and_copies(spark):
    votes, toxic = simulated(6000)
    gold = np.where(np.arange(len(votes)) < 300, toxic.astype(int), -1)
    rows = Counter((v.tobytes(), int(g)) for v, g in zip(votes, gold))
    patterns = spark.createDataFrame([(bytearray(v), g, n) for (v, g), n in rows.items()], "votes binary, gold int, n long").repartition(3)
    model = toxicity.label_model(patterns, 20)
    given = model.accuracy[:8, :, 1:] / model.accuracy[:8, :, 1:].sum(axis=2, keepdims=True)
    assert np.abs(given[:, 0, 0] - 0.75).max() < 0.08 and np.abs(given[:, 1, 1] - 0.75).max() < 0.1
    assert abs(model.prior[1] - 0.2) < 0.05
    # The copies hang together in the tree, the independent voters hardly inform of each other.
    assert model.information[8, 9] > 0.2 and np.abs(model.information[np.triu_indices(8, 1)]).max() < 0.02
    far = model.posterior(votes)
    naive = np.where((votes == 2).sum(axis=1) > (votes == 1).sum(axis=1), 1, 0)
    assert ((far >= 0.5) == toxic).mean() > 0.9 > (naive == toxic).mean() + 0.05


def test_posterior_is_the_tree(seed=1):
    """The product over the tree, term by term."""
    votes, toxic = simulated(400, seed)
    hot = np.eye(3)[votes.astype(int)].reshape(len(votes), -1)
    pairs = np.stack([hot[toxic == c].T @ hot[toxic == c] for c in (False, True)])
    model = toxicity.LabelModel.of_counts(pairs, np.array([(~toxic).sum(), toxic.sum()], float))
    assert (model.parent < 0).sum() == 1
    for row, got in list(zip(votes, model.posterior(votes)))[:50]:
        p = model.prior.copy()
        for j, v in enumerate(row):
            p *= np.exp(model.tables[j, :, row[model.parent[j]] if model.parent[j] >= 0 else 0, v])
        assert abs(got - p[1] / p.sum()) < 1e-9
    assert np.allclose(np.exp(model.tables).sum(axis=3), 1)


def test_classifier_separates():
    r = np.random.default_rng(1)
    n, size = 500, 40
    x = r.random((n, size)) < 0.2
    target = (x[:, 3] | x[:, 7]).astype(float)
    rows, terms = np.nonzero(x)
    votes = np.zeros((n, len(toxicity.VOTERS)), np.int8)
    model = toxicity.fit(votes, rows, terms, target, size)
    assert ((model.score(votes, rows, terms) >= 0.5) == target).all()
    assert set(np.argsort(-model.terms)[:2].tolist()) == {3, 7} and not model.votes.any()
    # The gradient at the end is that of a minimum.
    away = model.score(votes, rows, terms) - target
    assert np.abs(np.bincount(terms, weights=away[rows], minlength=size) + 0.3 * model.terms).max() < 0.2


BAD = ["glorbian", "snarfic", "vexulous"]


def planted(n, seed=1):
    """Toxic documents have one of three words, inflected."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        words = prose(r, r.randrange(5, 60)).split()
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "ly", "ness", "!!", "ER"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_of_planted_words(spark, docs):
    rows, labels = planted(800)
    out = {x.doc_id: x.toxicity for x in toxicity.scored(docs(rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert len(out) == 800 and all(out[i].held_out == held(i) for i in out)
    wrong = [i for i, t in labels if out[i].held_out and out[i].predicted != t]
    assert len(wrong) <= 2
    # Labels of held-out rows are not read, and the way the labels travel does not matter.
    flipped = [(i, 1 - t if held(i) else t) for i, t in labels]
    again = toxicity.scored(docs(rows), spark.createDataFrame(flipped, LABELS).repartition(5), broadcast_labels=0).collect()
    assert {x.doc_id: x.toxicity.predicted for x in again} == {i: x.predicted for i, x in out.items()}
    assert max(abs(x.toxicity.score - out[x.doc_id].score) for x in again) < 1e-6


def test_toxicity_of_odd_rows(spark, docs):
    rows, labels = planted(300)
    long = " ".join(prose(random.Random(3), 50) for _ in range(4000))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [rows[0]] * 3 + [(None, rows[0][1]), (None, None)]
    rows += [(2000, long), (2001, long + " glorbian " + long), (2002, "é" * 3000 + "x" * 1000)]
    labels += [(None, 1), (7, None), (5, 1 - labels[5][1]), (9999, 1)] + labels[:3]
    out = toxicity.scored(with_odd_columns(docs(rows)), spark.createDataFrame(labels, LABELS))
    assert out.columns == [*[c for c in with_odd_columns(docs([])).columns if c != "text"], "toxicity"]
    got = out.select("doc_id", "toxicity.*").collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    by = {x.doc_id: x.score for x in got}
    assert len({x.score for x in got if x.doc_id in (0,)}) == 1 and by[2001] > 0.5 > by[2000]
    empty = [by[1000 + i] for i in range(5)]
    assert len(set(empty)) == 1 and empty[0] < 0.5


def test_toxicity_without_rows_or_labels(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.scored(docs([]), none).collect() == []
    assert {x.toxicity.score for x in toxicity.scored(docs([(1, "a"), (2, None)]), none).collect()} == {0.1}
    one_kind = spark.createDataFrame([(i, 0) for i in range(20)], LABELS)
    assert all(x.toxicity.predicted == 0 for x in toxicity.scored(docs([(i, "a") for i in range(20)]), one_kind).collect())


def test_toxicity_of_the_table(spark):
    got = {x.doc_id: x for x in QUERIES["op11_toxicity"](spark, LARGE).collect()}
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    out = [got[i].predicted == t for i, t in labels.items() if got[i].held_out]
    assert np.mean(out) > 0.98
