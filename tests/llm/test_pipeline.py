"""The whole pipeline against the same decisions made by hand, one document at a time."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.conftest import DOCS, prose
from tests.llm.test_other_operators import SMALL, library, shares_by_hand
from tests.llm.test_text_dedup import groups_by_hand, lines_by_hand
from tracewell.llm import ORACLES
from tracewell.llm.queries import MIX_SEED, MIX_WEIGHTS

SPACE = r"[^\x20\x09-\x0D]+"


def some_documents():
    """(id, text, lang, source): a test table, and rows without an id, repeats, near copies."""
    frame = pd.read_parquet(f"{SMALL}/documents.parquet")
    rows = [(int(d), t, x, s) for d, t, x, s in frame[["doc_id", "text", "lang", "source"]].itertuples(index=False)]
    r = random.Random(17)
    source = rows[0][3]
    text = [prose(r, 30 + 5 * i) for i in range(12)]
    line = prose(r, 8)
    rows += [(10**6 + i, f"{text[i]}\n{line}", "en", source) for i in range(5)]
    rows += [(10**6 + 9, f"{text[0]}\n{line}", "en", source)] * 3
    rows += [(10**6 + 10, text[5], "de", None), (10**6 + 11, text[5] + " ende", None, source)]
    rows += [(None, text[5], "de", None), (None, text[6], "en", source), (None, text[6], "en", source), (None, text[7], None, None)]
    rows += [(None, None, "en", source), (10**6 + 12, None, "en", source), (10**6 + 13, "", None, "x")]
    return rows


def good(rows):
    documents = pd.DataFrame(rows, columns=["id", "text", "lang", "source"]).astype(object)
    documents["doc_id"] = range(len(rows))
    documents = documents.where(documents.notna(), None).drop(columns="id").astype({"doc_id": "int64"})
    with duckdb.connect() as con:
        con.register("given", documents)
        con.execute("CREATE VIEW documents AS SELECT doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source FROM given")
        kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op4_quality_rules']})").fetchall() if k}
    return [x for i, x in enumerate(rows) if i in kept]


def without_lines(rows):
    # Equal rows of one id are one document, rows without an id are in none.
    kept = lines_by_hand([(d, t) for d, t in {(d, t) for d, t, *_ in rows if d is not None}])
    return [(d, kept[d][2] if d is not None else t, *rest) for d, t, *rest in rows]


def one_of_each_group(rows):
    once = list(dict.fromkeys(rows))
    keys = [d if d is not None else (1 << 62) + i for i, (d, *_) in enumerate(once)]
    first = groups_by_hand([(k, x[1]) for k, x in zip(keys, once, strict=True)])
    return [x for k, x in zip(keys, once, strict=True) if first[k][1] == k]


def to_weights(rows):
    words = lambda t: len(re.findall(SPACE, t or ""))
    number = lambda s: re.search(r"[0-9]+$", s or "")
    domain = lambda s: f"domain{int(number(s)[0]) % 4}" if number(s) else None
    leaves = defaultdict(list)
    for x in rows:
        leaves[domain(x[3]), x[2], x[3]].append(x)

    def share(budget, level, inside):
        below = defaultdict(dict)
        for path, got in inside.items():
            below[path[level]][path] = got
        children = {n: (MIX_WEIGHTS[level].get(n, 1), sum(words(x[1]) for part in b.values() for x in part)) for n, b in below.items()}
        budgets = shares_by_hand(budget, children)
        if level == 2:
            return {path: budgets[n] for n, b in below.items() for path in b}
        return {path: got for n, b in below.items() for path, got in share(budgets[n], level + 1, b).items()}

    total = sum(words(x[1]) for x in rows)
    kept = []
    for path, budget in share(total * corpus_pipeline.MIX_PERCENT // 100, 0, leaves).items():
        part = leaves[path]
        tokens = sum(words(x[1]) for x in part)
        whole, left = divmod(budget, tokens) if tokens else (0, 0)
        if whole:
            kept += part
            continue
        order = lambda x: hashlib.md5(f"{MIX_SEED}:1:{'' if x[0] is None else x[0]}".encode()).hexdigest()
        taken = 0
        for x in sorted(part, key=lambda x: (order(x), words(x[1]))):
            taken += words(x[1])
            if left and taken <= left:
                kept.append(x)
    return kept


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(*x, len(x[1]) if x[1] else None) for x in some_documents()]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_by_hand(spark, folder):
    given = some_documents()
    stages = [given]
    for stage in (good, without_lines, one_of_each_group, to_weights):
        stages.append(stage(stages[-1]))
    # Every stage has work here, and documents without an id come through.
    assert len(stages[1]) < len(given) and len(stages[4]) < len(stages[3]) < len(stages[2])
    assert {x[1] for x in stages[2]} != {x[1] for x in stages[1]} and any(x[0] is None for x in stages[4])
    encode = library().encode_ordinary
    want = Counter((d, tuple(encode(t))) for d, t, *_ in stages[4])
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, tuple(x.token_ids)) for x in out) == want
