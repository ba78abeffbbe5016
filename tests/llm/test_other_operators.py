"""Quality rules, BPE, mixing, scoring, page text and the pipeline."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import check
import corpus_pipeline
from tests.llm.conftest import DOCS, ODD, prose, with_odd_columns
from tracewell.llm import ORACLES, QUERIES, bpe, html_crf, jaccard_join, mixing, ppm, quality
from tracewell.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert check.compare(spark, check.connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name]) is None


def test_a_query_for_each():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# --- quality -----------------------------------------------------------------


def test_quality_of_odd_rows(docs):
    r = random.Random(1)
    rows = [(i, prose(r, 60), "en", "a", 0) for i in range(30)] + [(100, "## " * 30 + prose(r, 30), "en", "a", 0), (101, None, None, None, None)]
    rows += [(200 + i, t, None, "b", 1) for i, t in enumerate(ODD)]
    out = {x.doc_id: x.quality for x in quality.judged(with_odd_columns(docs(rows))).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept for i in range(30)) and not out[100].kept and out[101].base_failed
    assert out[201].n_words == 0 and out[208].n_words == 1 and out[209].n_repeat_words == 200


def test_sketch_buckets(spark):
    values = spark.range(0, 3000).union(spark.range(10**6, 10**6 + 50)).toDF("v")
    b = quality.bucket(F.col("v"))
    rows = values.select("v", b.alias("b"), quality.floor_of(b).alias("low")).collect()
    assert all(x.low <= x.v < x.low * 33 / 32 + 1 for x in rows)
    assert len({(x.b, x.low) for x in rows}) == len({x.b for x in rows})


# --- BPE ---------------------------------------------------------------------


def ranks():
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary().splitlines())}


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def test_bpe_as_the_library(docs):
    r = random.Random(2)
    rows = list(enumerate(ODD + [prose(r, 50) for _ in range(20)] + ["don't we'll", "a" * 3000, " " * 500 + "x", "<|endoftext|>"]))
    df = with_odd_columns(docs(rows))
    ids = bpe.encoded(df, vocabulary(), public_tokenizers.PATTERN)
    out = bpe.decoded(ids, vocabulary(), public_tokenizers.PATTERN).collect()
    want = library()
    assert len(out) == len(rows)
    for x in out:
        assert x.token_ids == want.encode_ordinary(x.text or "")
        assert bytes(x.decoded) == (x.text or "").encode()


def test_bpe_both_ways_in_one_worker(docs):
    rows = list(enumerate(ODD + [prose(random.Random(5), 30)])) + [(None, "x y"), (3, "\n")]
    df = with_odd_columns(docs(rows))
    out = bpe.encoded_and_decoded(df, vocabulary(), public_tokenizers.PATTERN)
    assert out.columns == [*df.columns, "token_ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.token_ids == library().encode_ordinary(x.text or "") and bytes(x.decoded) == (x.text or "").encode()
    assert bpe.encoded_and_decoded(docs([]), vocabulary(), public_tokenizers.PATTERN).collect() == []


def test_scoring_of_one_id_and_none(docs):
    """Rows of one id or without one are scored like any others, whatever chunk they come to."""
    r = random.Random(8)
    texts = [prose(r, 40) for _ in range(12)]
    plain = [(i, t) for i, t in enumerate(texts)]
    rows = [(1, t) for t in texts] * 2 + [(None, t) for t in texts]
    for data in (plain, rows):
        few = ppm.scored(docs(data)).select("doc_id", "lm.*").collect()
        many = ppm.scored(docs(data), chunk_bytes=300).select("doc_id", "lm.*").collect()
        key = lambda x: (str(x.doc_id), x.n_tokens, round(x.base_score, 6), round(x.score, 6))
        assert len(few) == len(many) == len(data)
        for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
            assert key(a) == key(b) and abs(a.score - b.score) < 1e-9


def test_replay_in_arrays_and_one_by_one(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdeth' \n.0é") for _ in range(r.randrange(1, 30))).encode() for _ in range(600)]
    merges = bpe.Merges(ranks())
    want = [merges.one_by_one(w) for w in words]
    for together in (1, 30, 10**9):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        assert [tuple(np.frombuffer(x, np.int32).tolist()) for x in merges.replay(words)] == want


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PIECES_AT_ONCE", 7)
    text = prose(random.Random(4), 200)
    coder = bpe.Encoder(bpe.Merges(ranks()), public_tokenizers.PATTERN)
    assert coder.encode([text])[0].tolist() == library().encode_ordinary(text)


# --- mixing ------------------------------------------------------------------


def shares_by_hand(budget, children):
    """Children (weight, cap): what each gets, filling the smallest first."""
    got, left = {}, dict(children)
    while left:
        rest = budget - sum(got.values())
        total = sum(w for w, _ in left.values())
        full = {k: c for k, (w, c) in left.items() if c * total <= w * rest}
        if not full:
            return got | {k: w * rest // total for k, (w, _) in left.items()}
        got |= full
        left = {k: v for k, v in left.items() if k not in full}
    return got


def test_shortages_go_to_siblings_first(spark):
    r = random.Random(5)
    leaves = [(f"d{a}", f"l{b}", r.randrange(1, 500)) for a in range(3) for b in range(4)]
    df = spark.createDataFrame(leaves, "a string, b string, tokens long").select(
        F.concat(F.lit("="), "a").alias("a"), F.concat(F.lit("="), "b").alias("b"), "tokens"
    )
    weights = ({"d0": 5, "d1": 2}, {"l0": 3})
    total = sum(x[2] for x in leaves)
    for percent in (20, 60, 90, 100):
        got = {(x.a[1:], x.b[1:]): x.budget for x in mixing.budgets(df, ["a", "b"], weights, percent, 1).collect()}
        top = shares_by_hand(total * percent // 100, {d: (weights[0].get(d, 1), sum(x[2] for x in leaves if x[0] == d)) for d in ("d0", "d1", "d2")})
        for d, budget in top.items():
            low = shares_by_hand(budget, {x[1]: (weights[1].get(x[1], 1), x[2]) for x in leaves if x[0] == d})
            assert {k[1]: v for k, v in got.items() if k[0] == d} == low


def test_mixing_of_odd_rows(docs, spark):
    rows = [(i, prose(random.Random(i), 1 + i % 9), None if i % 5 == 0 else "en", f"src{i % 3}", None) for i in range(200)]
    rows += [(None, None, "de", None, 1), (7, rows[7][1], *rows[7][2:])]
    out = mixing.mixed(with_odd_columns(docs(rows)), [F.col("lang"), F.col("source")], ({"en": 2}, {"src0": 0}), 150, max_epochs=3)
    got = out.select("doc_id", "source", "mix").collect()
    assert len(got) == len(rows) and len({x.mix.copies for x in got if x.doc_id == 7}) == 1
    assert all(x.mix.copies == 0 for x in got if x.source == "src0")
    assert all(x.mix.copies <= 3 for x in got)
    taken = sum(x.mix.copies * x.mix.tokens for x in got)
    assert taken <= sum(x.mix.tokens for x in got) * 1.5
    assert mixing.mixed(spark.createDataFrame([], DOCS), [F.col("lang")], ({},), 50).count() == 0


# --- scoring -----------------------------------------------------------------


def test_scores_as_a_trie_gives_them(docs):
    r = random.Random(6)
    rows = [(i, prose(r, r.randrange(1, 30))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(3, "a row of an id again")]
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    held = lambda d: crc32(str(d).encode()) % 7 == 2
    counts, trie = Counter(), ppm.Trie()
    for d, t in rows:
        if not held(d):
            counts.update([*tokens(t), None])
            trie.learn(list(" ".join(tokens(t)).encode()) + [ppm.END])
    n, v = sum(counts.values()), len(counts)
    out = ppm.scored(with_odd_columns(docs(rows)), chunk_bytes=3000).select("doc_id", "lm").collect()
    by_id = {}
    for x in out:
        by_id.setdefault(x.doc_id, []).append(x.lm)
    for d, t in rows:
        words = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        score = trie.score(list(" ".join(tokens(t)).encode()) + [ppm.END])
        assert any(
            (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(d), len(words), sum(counts[w] > 0 for w in words), n)
            and g.base_score == pytest.approx(base) and g.score == pytest.approx(score)
            for g in by_id[d]
        )


def test_probabilities_sum_to_one():
    trie = ppm.Trie(2)
    for text in ("abracadabra", "abab", "cab"):
        trie.learn(ppm.symbols_of(text))
    for context in ("", "a", "ab", "zz", "ra"):
        symbols = list(context.encode())
        total = sum(10 ** trie.score_symbol([*symbols, s], len(symbols)) for s in range(ppm.SYMBOLS))
        assert total == pytest.approx(1)


def test_adaptive_scores(docs, spark):
    out = {x.doc_id: x.score for x in ppm.adaptive_scores(docs([(1, "ab " * 60), (2, prose(random.Random(1), 30)), (3, None)])).collect()}
    assert out[1] / 180 > out[2] / len(prose(random.Random(1), 30)) and out[3] == pytest.approx(-math.log10(257))
    assert ppm.scored(spark.createDataFrame([], DOCS)).count() == 0


# --- pages -------------------------------------------------------------------


def test_held_out_pages():
    chain = html_crf.standard_chain()
    wrong = total = 0
    for html in html_crf.labelled_pages(120, seed=12345):
        found = html_crf.blocks(html)
        if found:
            labels = chain.viterbi(chain.emissions([html_crf.features(found)]))
            wrong += int(np.sum(labels != np.array([x[3] for x in found])))
            total += len(found)
    assert wrong <= 0.015 * total


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(1)
    chain = html_crf.Chain({}, np.zeros((0, 2)), r.normal(size=(2, 2)))
    for n in range(1, 8):
        scores = r.normal(size=(n, 2))
        value = lambda y: sum(scores[i, y[i]] for i in range(n)) + sum(chain.steps[y[i - 1], y[i]] for i in range(1, n))
        best = max((tuple(int(b) for b in np.binary_repr(k, n)) for k in range(2**n)), key=value)
        assert tuple(chain.viterbi(scores).tolist()) == best


PAGE = """<html><head><title>T</title><script>var a = "<p>x</p>";</script><style>p{}</style></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to improve your visit.</div>
<article><h1>A title &amp; more</h1><p>First <b>bold</b>er text of the article,<br>which goes on\n  for a while.
<p>Second paragraph &copy it is&nbsp;long enough.</p><div class="ad">Buy now, today only!</div><p>The third ends the story.</p></article>
<aside class="sidebar"><h3>Related</h3><a href="/x">Other story</a></aside>
<section id="comments"><p>Anna says: well written, thanks a lot!</p></section>
<form class="newsletter"><label>Your email</label><button>Send</button></form><footer>&copy; 2020 All rights reserved.</footer>"""


def test_a_page(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "<p>"), (5, "no markup at all in this text, only a sentence."), (6, "<script>never closed")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"row": F.lit(1), "main": F.lit("x")})
    out = {x.page_id: x.text for x in html_crf.main_texts(df).collect()}
    assert out[1] == (
        "A title & more First bolder text of the article, which goes on for a while. "
        "Second paragraph © it is long enough. The third ends the story."
    )
    assert (out[2], out[3], out[4], out[6]) == ("", "", "", "")


def test_pages_without_the_end_of_the_head():
    body = PAGE[PAGE.index("<body") :]
    whole = html_crf.blocks(f"<html><head><title>T</title></head>{body}")
    assert whole
    inner = body[body.index(">") + 1 :]
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>\n", "<head><noscript><link></noscript><title>T</title><body>"):
        found = html_crf.blocks(start + inner)
        assert [text for _, text, _, _ in found] == [text for _, text, _, _ in whole], start
    assert [b[1] for b in html_crf.blocks("<head><title>T</title>Text <b>at once</b>")] == ["Text at once"]
    assert [b[1] for b in html_crf.blocks("<head><noscript><img src=x><p>In</p></noscript><p>Out")] == ["In", "Out"]
    # Scripts and titles in such a head stay silent.
    assert [b[1] for b in html_crf.blocks("<head><script>x</script><style>y</style><template><p>z</p></template><p>Only this")] == ["Only this"]
    assert [b[1] for b in html_crf.blocks("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be")] == ["Let x=2 be"]


def test_words_at_the_end_of_long_classes():
    utility = " ".join(f"px-{i} mt-{i}" for i in range(60))
    (features, *_), = html_crf.blocks(f'<div class="{utility} site-footer">Text</div>')
    assert len(utility) > 200 and "word=footer" in features
    assert html_crf.words_of.cache_info().maxsize


# --- the pipeline ------------------------------------------------------------


def test_pipeline(spark):
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, SMALL).collect()}
    assert out and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
    # Stage by stage on what the stage before has kept, by the operators' own results.
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < docs.count() <= count
        count = docs.count()
    want = library()
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert set(out) == set(texts)
    for d, t in texts.items():
        ids = want.encode_ordinary(t)
        assert (out[d].n_tokens, out[d].token_ids) == (len(ids), ids)
        assert out[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_jaccard_stage_of_rows_without_id_and_repeats(spark, docs):
    r = random.Random(21)
    texts = [prose(r, 40) for _ in range(6)]
    near = texts[0] + " ende"
    rows = [(1, texts[0]), (1, texts[0]), (2, near), (None, near), (None, texts[1]), (None, texts[1]), (None, texts[1] + " ende")]
    # Ids where the keys of rows without one lie, an id of two texts, empty ones.
    rows += [((1 << 63) - 1, texts[2]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[5]), (None, None), (None, "")]
    df = docs(rows)
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.jaccard_stage(spark, df, SMALL).collect()]
    alone = [x for x in kept if x[1] and x[1].startswith(texts[1])]
    empty = [x for x in kept if not x[1]]
    assert len(alone) == 1 and alone[0][0] is None and len(empty) == 1
    rest = sorted((x for x in kept if x not in alone + empty), key=str)
    assert rest == sorted([(1, texts[0]), ((1 << 63) - 1, texts[2]), (7, texts[3]), (7, texts[4]), (None, texts[5])], key=str)
    found = [tuple(x) for x in jaccard_join.similar_documents(df).select("doc", "component").collect()]
    want = [(1, 1), (2, 1), (None, 1), ((1 << 63) - 1,) * 2, (None, (1 << 63) - 1), (7, 7)] + [(None, None)] * 6
    assert sorted(found, key=str) == sorted(want, key=str)
