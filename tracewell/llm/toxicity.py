"""Toxicity by weak supervision: many voters, a label model of them, a linear classifier.

1. **Terms.** A text's terms are its distinct lower-cased words (runs of a-z and of all
   characters beyond ASCII, three bytes at least) and the beginnings of 3 to 8 bytes of longer
   ones, as 64-bit hashes; beginnings find inflected forms. All labelled training documents
   count how many toxic and other documents have each term; the ``TERMS`` of the largest
   likelihood ratio are kept.
2. **Voters.** Lexicons of terms, by kind and by how seldom other documents have them, the
   strongest dealt into several parts; one short list of common insults; patterns of bytes
   (shouting, exclamation, masked and spaced letters, digits inside words, stretched letters).
   A voter says toxic or abstains; two say clean, of texts without suspicious terms.
3. **Label model.** Votes depend on the hidden label and, so that voters who see the same thing
   are not counted twice, each on one other voter: the tree of the largest mutual information
   given the label, learnt anew in each round of expectation maximisation. All documents take
   part; a training label, where there is one, is taken as seen. What a round needs are counts
   of pairs of votes by label, (3 * voters)^2 * 2 numbers whatever the corpus, over the distinct
   vote patterns that Spark has counted.
4. **Classifier.** Logistic regression on terms and votes, fitted to the posterior labels of a
   sample of about ``FIT_ROWS`` training documents (those of the least hash of the text), on the
   driver: the one bounded sample. Scores of all rows follow in one pass over ids of terms.

Labels of rows with crc32(id) mod ``FOLDS`` = ``HELD_OUT`` are never read, and label, language,
source and id are no input of a score: equal texts have equal scores. Whole texts are read, in
parts of 1 MiB cut between words (a word beyond that is cut). Texts meet labels by a broadcast of
the labels up to ``BROADCAST_LABELS`` rows, beyond it by a shuffle of the training texts.

Rows: a null text counts as empty, an empty text has the score of no terms. Rows without an id
have no label. Several labels of one id count as the larger; null labels as none. Repeated rows
are scored each. Terms of equal ratio are ordered by hash. Without any labelled training row of
both kinds all scores are the training share of toxic rows, pulled to 0.1. An empty table gives
an empty one. Columns are carried in one struct, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import textops as X
from tracewell.llm.common import as_row, from_row, pick, row_type, spread, whole, written

FOLDS, HELD_OUT = 5, 0
TERMS = 4096
FIT_ROWS = 20_000
BROADCAST_LABELS = 1 << 18
EM_ROUNDS = 8
WORD = 0
STARTS = (3, 4, 5, 6, 7, 8)
LEAST_WORD = 3
# A term votes only if it is in so many toxic training documents.
LEAST_TOXIC = 3
PARTS = 6
# Terms that a worker counts before it hands them on.
HELD_TERMS = 1 << 21

# Common insults of four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb imbecile loser losers scum trash worthless pathetic disgusting clown "
    "idioten trottel dummkopf abschaum widerlich blödmann arschloch versager "
    "imbécile crétin débile connard salaud ordure minable "
    "idiota imbécil estúpido estúpida basura asqueroso payaso tarado"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True
_U = np.uint64


# --- terms -------------------------------------------------------------------


def parts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about 1 MiB: text numbers, bytes, offsets. Long texts are cut between words."""
    for first, last in X.runs_of_texts(ends, X.BLOCK_BYTES):
        a, b = int(ends[first]), int(ends[last])
        if b - a <= 2 * X.BLOCK_BYTES:
            yield np.arange(first, last), data[a:b], ends[first : last + 1] - a
            continue
        while a < b:  # a single text
            stop = min(a + X.BLOCK_BYTES, b)
            if stop < b:
                gaps = np.flatnonzero(~_LETTER[data[a:stop]])
                stop = a + int(gaps[-1]) + 1 if len(gaps) else stop
            yield np.array([first]), data[a:stop], np.array([0, stop - a])
            a = stop


def terms_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, kind and hash of each distinct term of a block of lower-cased texts."""
    n = len(data)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none.astype(np.uint64)
    inside = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stops - starts >= LEAST_WORD
    starts, stops = starts[long], stops[long]
    text = np.searchsorted(ends, starts, side="right") - 1
    ranges = X.RangeHash(data, seed=11)
    words = ranges.of(starts, stops)
    # A word's beginnings are looked at once in each text.
    first = _distinct(text, words)
    starts, stops, text, words = starts[first], stops[first], text[first], words[first]
    texts, kinds, hashes = [text], [np.zeros(len(text), np.int64)], [words]
    for size in STARTS:
        longer = np.flatnonzero(stops - starts > size)
        begin = X.mix(ranges.of(starts[longer], starts[longer] + size) + _U(size))
        keep = _distinct(text[longer], begin)
        texts.append(text[longer][keep])
        kinds.append(np.full(len(keep), size, np.int64))
        hashes.append(begin[keep])
    return np.concatenate(texts), np.concatenate(kinds), np.concatenate(hashes)


def _distinct(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first of equal (text, hash)."""
    # The text's number scrambles the hash: one sort instead of one of two keys.
    _, first = np.unique(hashes ^ X.mix(text.astype(np.uint64) + _U(1)), return_index=True)
    return first


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return X.packed(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))


def insult_terms() -> np.ndarray:
    data = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    _, kinds, hashes = terms_of(data, np.array([0, len(data)]))
    return np.unique(hashes[kinds == WORD])


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return [keys[firsts], *(np.add.reduceat(v[order], firsts) if len(firsts) else v[:0] for v in values)]


def _count_terms(batches) -> Iterator[pa.RecordBatch]:
    """How many toxic and how many documents of this task have each term."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def flush() -> pa.RecordBatch:
        kinds, hashes, toxic, docs = (np.concatenate([h[i] for h in held]) if held else np.empty(0, np.int64) for i in range(4))
        hashes, kind, toxic, docs = _summed(hashes.astype(np.uint64), kinds, toxic, docs)
        kind = kind // np.maximum(docs, 1)  # equal for all of one hash
        held.clear()
        return pa.record_batch([pa.array(X.as_long(hashes)), pa.array(kind), pa.array(toxic), pa.array(docs)], names=["term", "kind", "toxic", "docs"])

    for batch in batches:
        data, ends = _lowered(batch.column("text"))
        labels = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        pending: list[np.ndarray] | None = None
        for texts, block, offsets in parts(data, ends):
            text, kinds, hashes = terms_of(block, offsets)
            found = [texts[text], kinds, hashes]
            if len(texts) == 1 and pending is not None and pending[0][0:1].tolist() == [int(texts[0])]:
                # More of a long text: its terms count once.
                found = [np.concatenate(c) for c in zip(pending, found, strict=True)]
                keep = _distinct(found[0], found[2])
                found = [c[keep] for c in found]
            elif pending is not None:
                held.append(_added(pending, labels))
            pending = found
            rows += len(hashes)
            if rows > HELD_TERMS:
                if held:
                    yield flush()
                rows = 0
        if pending is not None:
            held.append(_added(pending, labels))
    yield flush()


def _added(found: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    text, kinds, hashes = found
    keys, kind, toxic, docs = _summed(hashes, kinds, labels[text], np.ones(len(text), np.int64))
    return [kind, keys, toxic, docs]


@dataclass
class Terms:
    """The chosen terms in the order of their hashes, and what lexicon each votes in."""

    hashes: np.ndarray
    lexicon: np.ndarray  # number of the voter, -1 for none
    suspicious: np.ndarray  # more frequent among toxic documents

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the term, -1 where it is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


KINDS = (WORD, *STARTS)
TIERS = (0.95, 0.8, 0.5)
LEXICONS = [f"kind {k}, share {t}" for k in KINDS for t in TIERS] + [f"strongest, part {i}" for i in range(PARTS)]
PATTERNS = ["insults", "two strongest", "four strongest", "many suspicious", "exclamation", "shouting", "masked", "spaced", "digits inside", "stretched"]
CLEAN = ["nothing suspicious", "no lexicon"]
VOTERS = [*LEXICONS, *PATTERNS, *CLEAN]
ABSTAIN, SAYS_CLEAN, SAYS_TOXIC = 0, 1, 2


def choose_terms(counts: DataFrame, toxic: int, docs: int, most: int = TERMS) -> Terms:
    """The terms that tell most; ``counts`` has term, kind, toxic, docs."""
    other = docs - toxic

    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    a, n = F.col("toxic").cast("double"), F.col("docs").cast("double")
    b = n - a
    gain = cell(a, n * toxic / docs) + cell(b, n * other / docs) + cell(toxic - a, (docs - n) * toxic / docs) + cell(other - b, (docs - n) * other / docs)
    top = counts.where(F.col("docs") >= 2).withColumn("gain", gain).orderBy(F.desc("gain"), "term").limit(most).collect()
    top = sorted(top, key=lambda r: np.int64(r.term).view(np.uint64))
    lexicon, suspicious = [], []
    for r in top:
        share = (r.toxic + 0.5) / (r.docs + 1)
        tier = next((i for i, t in enumerate(TIERS) if share >= t), None)
        votes = tier is not None and r.toxic >= LEAST_TOXIC and share > 2 * toxic / docs and r.gain > 4
        lexicon.append(KINDS.index(r.kind) * len(TIERS) + tier if votes else -1)
        suspicious.append(r.toxic * docs > r.docs * toxic)
    hashes = np.array([r.term for r in top], np.int64).view(np.uint64)
    return Terms(hashes, np.array(lexicon, np.int64), np.array(suspicious, bool))


# --- voters ------------------------------------------------------------------


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])


def pattern_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text: letters, capitals, words, exclamations, masked letters, spaced letters,
    digits inside words, stretched letters. Counts add up over the parts of a text."""
    low = X.lowered(raw)
    letter = _LETTER[low]
    n = len(raw)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(n)  # bytes to the end of the text
    start = np.zeros(n + 1, bool)
    start[ends] = True
    start = start[:n]
    mask = np.isin(low, np.frombuffer(b"*@#$%!", np.uint8))
    digit = np.isin(low, np.frombuffer(b"013457", np.uint8))
    gap = np.isin(low, np.frombuffer(b" .-_", np.uint8))

    def after(flags: np.ndarray, steps: int) -> np.ndarray:
        """What holds so many bytes further on in the same text."""
        return np.concatenate([flags[steps:], np.zeros(min(steps, n), bool)])[:n] & (left > steps)

    opens = letter.copy()
    opens[1:] &= ~letter[:-1] | start[1:]
    masked = letter & after(mask, 1) & (after(letter, 2) | (after(mask, 2) & after(letter, 3)))
    inside = letter & after(digit, 1) & after(letter, 2)
    # a single letter, a gap, a single letter, a gap, a single letter
    spaced = opens & after(gap, 1) & after(letter, 2) & after(gap, 3) & after(letter, 4) & ~after(letter, 5)
    same = np.concatenate([low[1:] == low[:-1], [False]])[:n]
    stretched = letter & (low < 128) & same & after(same, 1) & after(letter, 2)
    capital = (raw >= ord("A")) & (raw <= ord("Z"))
    return np.stack([_per_text(x, ends) for x in (letter, capital, opens, low == ord("!"), masked, spaced, inside, stretched)], axis=1)


def votes_of(counts: np.ndarray, text: np.ndarray, term: np.ndarray, insult: np.ndarray, terms: Terms) -> np.ndarray:
    """Votes (texts x voters) from patterns and found terms; ``insult``: hits of the short list."""
    rows = len(counts)
    out = np.zeros((rows, len(VOTERS)), np.int8)
    column = {name: i for i, name in enumerate(VOTERS)}
    lexicon = terms.lexicon[term] if len(term) else term
    voting = lexicon >= 0
    out[text[voting], lexicon[voting]] = SAYS_TOXIC
    strongest = voting & (lexicon % len(TIERS) == 0)
    part = (X.mix(terms.hashes[term]) % _U(PARTS)).astype(np.int64) if len(term) else term
    out[text[strongest], column["strongest, part 0"] + part[strongest]] = SAYS_TOXIC
    strong = np.bincount(text[strongest], minlength=rows)
    suspicious = np.bincount(text[terms.suspicious[term]] if len(term) else text, minlength=rows)
    letters, capitals, words, marks, masked, spaced, inside, stretched = counts.T
    toxic = {
        "insults": insult > 0, "two strongest": strong >= 2, "four strongest": strong >= 4,
        "many suspicious": suspicious * 50 > words + 50, "exclamation": marks * 10 > words, "shouting": capitals * 2 > letters,
        "masked": masked > 0, "spaced": spaced > 0, "digits inside": inside > 0, "stretched": stretched > 0,
    }
    for name, said in toxic.items():
        out[said, column[name]] = SAYS_TOXIC
    out[suspicious == 0, column["nothing suspicious"]] = SAYS_CLEAN
    out[np.bincount(text[voting], minlength=rows) == 0, column["no lexicon"]] = SAYS_CLEAN
    return out


def _vote(batches, terms: Terms) -> Iterator[pa.RecordBatch]:
    insults = insult_terms()
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = part.num_rows
            counts = np.zeros((rows, 8), np.int64)
            raw, ends = X.packed(part.column("text"))
            for texts, block, offsets in parts(raw, ends):
                np.add.at(counts, texts, pattern_counts(block, offsets))
            insult, text, term = np.zeros(rows, np.int64), [], []
            low, ends = _lowered(part.column("text"))
            for texts, block, offsets in parts(low, ends):
                owner, _, hashes = terms_of(block, offsets)
                insult += np.bincount(texts[owner[np.isin(hashes, insults)]], minlength=rows)
                found = terms.found(hashes)
                text.append(texts[owner[found >= 0]])
                term.append(found[found >= 0])
            # A term of several parts of one text counts once.
            pairs = np.unique(np.concatenate(text or [np.empty(0, np.int64)]) * TERMS_SPAN + np.concatenate(term or [np.empty(0, np.int64)]))
            text, term = pairs // TERMS_SPAN, pairs % TERMS_SPAN
            votes = votes_of(counts, text, term, insult, terms)
            ids = term.astype("<u2")
            stops = np.searchsorted(text, np.arange(rows + 1)) * 2
            yield pa.record_batch(
                [*(part.column(c) for c in ("row", "id", "held", "hash")), _binary(votes.tobytes(), np.arange(rows + 1) * len(VOTERS)), _binary(ids.tobytes(), stops)],
                names=["row", "id", "held", "hash", "votes", "terms"],
            )


TERMS_SPAN = 1 << 16


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers).cast(pa.binary())


def _matrix(column) -> np.ndarray:
    data, _ = X.packed(column)
    return data.view(np.int8).reshape(-1, len(VOTERS))


# --- label model -------------------------------------------------------------

CLASSES = 3  # of votes: abstain, clean, toxic


@dataclass
class LabelModel:
    """P(label), and for each voter P(vote | vote of its parent, label).

    ``pairs`` are weighted counts, label x (voter, vote) x (voter, vote); its blocks hold the
    accuracies (diagonal) and correlations (mutual information given the label) of the voters.
    """

    prior: np.ndarray
    parent: np.ndarray
    tables: np.ndarray  # voter x label x parent's vote x vote, logarithms
    information: np.ndarray
    accuracy: np.ndarray  # voter x label x vote

    @staticmethod
    def of_counts(pairs: np.ndarray, totals: np.ndarray, smooth: float = 1.0) -> LabelModel:
        m = pairs.shape[1] // CLASSES
        cells = pairs.reshape(2, m, CLASSES, m, CLASSES).transpose(1, 3, 0, 2, 4) + smooth / CLASSES  # j, k, label, vote, vote
        joint = cells / cells.sum(axis=(3, 4), keepdims=True)
        left, right = joint.sum(axis=4, keepdims=True), joint.sum(axis=3, keepdims=True)
        prior = (totals + smooth) / (totals + smooth).sum()
        information = ((joint * np.log(joint / (left * right))).sum(axis=(3, 4)) * prior).sum(axis=2)
        # The spanning tree of the largest information, grown from the first voter.
        parent, reach, best, inside = np.full(m, -1), np.zeros(m, np.int64), information[0].copy(), np.zeros(m, bool)
        inside[0] = True
        for _ in range(m - 1):
            j = int(np.argmax(np.where(inside, -np.inf, best)))
            parent[j], inside[j] = reach[j], True
            closer = ~inside & (information[j] > best)
            best[closer], reach[closer] = information[j][closer], j
        singles = np.einsum("jjlaa->jla", cells)
        accuracy = singles / singles.sum(axis=2, keepdims=True)
        tables = np.empty((m, 2, CLASSES, CLASSES))
        for j in range(m):
            if parent[j] < 0:
                tables[j] = np.log(accuracy[j])[:, None, :]
            else:
                table = cells[parent[j], j]  # label, parent's vote, vote
                # Seldom combinations lean on what the voter does by itself.
                table = table + smooth * accuracy[j][:, None, :]
                tables[j] = np.log(table / table.sum(axis=2, keepdims=True))
        return LabelModel(prior, parent, tables, information, accuracy)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        m = votes.shape[1]
        above = np.where(self.parent[None, :] >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        j = np.arange(m)[None, :]
        away = np.log(self.prior[1] / self.prior[0]) + (self.tables[j, 1, above, votes] - self.tables[j, 0, above, votes]).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(away, -500, 500)))


def _weights(votes: np.ndarray, gold: np.ndarray, model: LabelModel | None) -> np.ndarray:
    """P(toxic) of rows whose label is seen (0, 1) or hidden (-1); hidden ones need a model."""
    guess = model.posterior(votes) if model is not None else np.zeros(len(votes))
    return np.where(gold >= 0, gold, guess)


def pair_counts(patterns: DataFrame, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs of votes and rows by label; without a model of labelled rows only."""
    m = len(VOTERS) * CLASSES
    cells = 2 * m * m + 2

    def task(batches):
        pairs, totals = np.zeros((2, m, m)), np.zeros(2)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                votes, n = _matrix(part.column("votes")), part.column("n").to_numpy().astype(float)
                gold = part.column("gold").to_numpy()
                if model is None:
                    n = n * (gold >= 0)
                toxic = _weights(votes, gold, model)
                hot = np.zeros((len(votes), len(VOTERS), CLASSES))
                np.put_along_axis(hot, votes[:, :, None].astype(np.int64), 1.0, axis=2)
                hot = hot.reshape(len(votes), m)
                for label, weight in enumerate((n * (1 - toxic), n * toxic)):
                    pairs[label] += hot.T @ (hot * weight[:, None])
                    totals[label] += weight.sum()
        flat = np.concatenate([pairs.ravel(), totals])
        used = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(flat[used])], names=["cell", "value"])

    flat = np.zeros(cells)
    for cell, value in patterns.mapInArrow(task, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        flat[cell] = value
    return flat[:-2].reshape(2, m, m), flat[-2:]


def label_model(patterns: DataFrame, rounds: int = EM_ROUNDS) -> LabelModel:
    """Fitted to all patterns (votes, gold, n); starts at the labelled ones."""
    model = LabelModel.of_counts(*pair_counts(patterns, None))
    for _ in range(rounds):
        new = LabelModel.of_counts(*pair_counts(patterns, model))
        moved = np.abs(np.exp(new.tables) - np.exp(model.tables)).max()
        model = new
        if moved < 1e-3:
            break
    return model


# --- classifier --------------------------------------------------------------


@dataclass
class Classifier:
    """Weights of the terms and of the votes (voter x vote, abstaining weighs nothing)."""

    terms: np.ndarray
    votes: np.ndarray
    bias: float

    def score(self, votes: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        away = self.bias + np.bincount(rows, weights=self.terms[terms], minlength=len(votes))
        away += self.votes[np.arange(votes.shape[1])[None, :], votes].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(away, -500, 500)))


def fit(votes: np.ndarray, rows: np.ndarray, terms: np.ndarray, target: np.ndarray, size: int, penalty: float = 0.3, steps: int = 300) -> Classifier:
    """Logistic regression on soft labels with a quadratic penalty, by accelerated descent."""
    n, m = votes.shape
    model = Classifier(np.zeros(size), np.zeros((m, CLASSES)), float(np.log((target.sum() + 0.5) / (n - target.sum() + 0.5))))
    columns = [(v, np.flatnonzero(votes[:, j] == v), j) for j in range(m) for v in (SAYS_CLEAN, SAYS_TOXIC)]
    # Step sizes from how often an input is set, which bounds the curvature of each.
    seen = np.bincount(terms, minlength=size)
    width = np.bincount(rows, minlength=n) + m + 1
    spread_terms = np.bincount(terms, weights=width[rows], minlength=size) / 4 + penalty
    heavy = {(v, j): width[at].sum() / 4 + penalty for v, at, j in columns}
    past = [model.terms.copy(), model.votes.copy(), model.bias]
    look = Classifier(model.terms.copy(), model.votes.copy(), model.bias)
    t = 1.0
    for _ in range(steps):
        away = look.score(votes, rows, terms) - target
        new_terms = np.where(seen > 0, look.terms - (np.bincount(terms, weights=away[rows], minlength=size) + penalty * look.terms) / spread_terms, 0)
        new_votes = look.votes.copy()
        for v, at, j in columns:
            new_votes[j, v] -= (away[at].sum() + penalty * look.votes[j, v]) / heavy[v, j]
        new_bias = look.bias - away.sum() / (width.sum() / 4)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        look.terms, look.votes = new_terms + pull * (new_terms - past[0]), new_votes + pull * (new_votes - past[1])
        look.bias = new_bias + pull * (new_bias - past[2])
        past, t = [new_terms, new_votes, new_bias], t_next
    return Classifier(*past)


def _sparse(table_terms) -> tuple[np.ndarray, np.ndarray]:
    data, ends = X.packed(table_terms)
    sizes = np.diff(ends) // 2
    return np.repeat(np.arange(len(sizes)), sizes), np.ascontiguousarray(data).view("<u2").astype(np.int64)


def _score(batches, model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            score = model.score(_matrix(part.column("votes")), *_sparse(part.column("terms")))
            yield pa.record_batch([part.column("row"), part.column("held"), pa.array(score)], names=["row", "held", "score"])


# --- all together ------------------------------------------------------------


def _labels(labels: DataFrame, id: str, label: str, held: Column) -> DataFrame:
    given = pick(labels, id=id, toxic=label).where(F.col("id").isNotNull() & F.col("toxic").isNotNull()).where(~held)
    return given.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def scored(
    df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", name: str = "toxicity",
    folds: int = FOLDS, held_out: int = HELD_OUT, terms: int = TERMS, fit_rows: int = FIT_ROWS, broadcast_labels: int = BROADCAST_LABELS,
) -> DataFrame:
    """All rows and columns but the text, and a struct ``name``: held_out, score, predicted."""
    if terms > TERMS_SPAN:
        raise ValueError(f"at most {TERMS_SPAN} terms")
    columns = [c for c in df.columns if c not in (text, name)]
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")
    held = F.crc32(as_text("id")) % folds == held_out
    texts = spread(df).select(as_row(columns), F.col(f"`{id}`").alias("id"), whole(F.col(f"`{text}`")).alias("text")).withColumn("held", held)
    known = written(_labels(labels, id, label, held), "labels")
    wanted = F.broadcast(known) if known.count() <= broadcast_labels else known
    training = texts.where("NOT held").select("id", "text").join(wanted, "id").select("text", "toxic")
    counts = written(
        training.mapInArrow(_count_terms, "term long, kind long, toxic long, docs long")
        .groupBy("term").agg(F.min("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")),
        "terms",
    )
    toxic, total = texts.where("NOT held").join(wanted, "id").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    made = lambda score: F.struct(F.col("held").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")).alias(name)
    if not 0 < toxic < total:
        return texts.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)], made(F.lit((toxic + 0.1) / (total + 1))))
    chosen = choose_terms(counts, toxic, total, terms)
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    ddl = f"{row_type(texts)}, id {dict(texts.dtypes)['id']}, held boolean, hash long, votes binary, terms binary"
    voted = written(hashed.select("row", "id", "held", "hash", "text").mapInArrow(lambda it: _vote(it, chosen), ddl), "votes")
    seen = voted.select("id", "held", "hash", "votes", "terms").join(wanted, "id", "left").withColumn("gold", F.coalesce("toxic", F.lit(-1)))
    patterns = written(seen.groupBy("votes", "gold").agg(F.count("*").alias("n")), "patterns")
    model = label_model(patterns)
    # About fit_rows training rows, by the hash of the text.
    rows = voted.where("NOT held").count()
    bound = min(1 << 31, (1 << 31) * fit_rows // max(rows, 1) + 1)
    sample = seen.where("NOT held").where(F.pmod("hash", F.lit(1 << 31)) < bound).select("hash", "votes", "terms", "gold").toArrow()
    sample = sample.sort_by([("hash", "ascending"), ("votes", "ascending"), ("gold", "ascending")])
    votes = _matrix(sample.column("votes"))
    target = _weights(votes, sample.column("gold").to_numpy(), model)
    classifier = fit(votes, *_sparse(sample.column("terms")), target, len(chosen.hashes))
    out = voted.select("row", "held", "votes", "terms").mapInArrow(lambda it: _score(it, classifier), f"{row_type(texts)}, held boolean, score double")
    return out.select(*from_row(columns), made(F.col("score")))
