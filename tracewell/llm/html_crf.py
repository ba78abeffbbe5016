"""Main text of web pages by a linear-chain conditional random field over blocks.

Method: a page becomes the sequence of its leaf blocks, runs of text that no block
element divides. A block's features are the tags, class and id words of its ancestors
and a few facts about its text. A two-label chain (main text or not) is trained
on labelled pages by gradient ascent on the conditional likelihood, and a page's best
labelling is found by Viterbi. The pages that come with the package are made from
a grammar of common layouts, so their labels are known; own labelled pages (elements
of the main text marked with ``data-label``) can be used instead.

Training pages are bounded by ``TRAINING_PAGES``; weights are small and of fixed size.
Decoding works on each page alone: nothing is shuffled.

Defined cases: null or empty html gives an empty text. Broken markup is read as
browsers do in the main: unclosed elements end with their parents, an unclosed script
runs to the end, a head ends at the first element or text that it cannot hold. Repeated
rows are read alike; where labels are equally likely a block is not main text. Other
columns are carried along. An empty table gives no rows. White space inside a block becomes one space; blocks are joined
by one space.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import as_row, from_row, row_type, spread, whole

TRAINING_PAGES = 600
ITERATIONS = 120
# Attribute values whose words a worker remembers.
WORDS_KEPT = 1 << 14
SEED = 7

# Elements that divide text, elements that never hold any, and elements whose text
# is not page text, after the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul button label noscript iframe".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT_TAGS = frozenset("head title script style template svg object audio video canvas".split())
# What a head may hold: anything else ends it, though its end tag is left out.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

# An element that opens closes these, if they are open in the same container.
CLOSES = {
    **{t: frozenset({"p"}) for t in BLOCK_TAGS - {"body", "html", "button", "label", "option", "legend", "summary", "title"}},
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
CONTAINERS = frozenset(
    "article aside blockquote body div details fieldset figure footer form header html main nav ol section table td th ul dl".split()
)

SPEAKING = frozenset(f"in={t}" for t in "article aside dialog footer form header main nav section".split())

# Words that tell what a short block is, in the languages at hand.
TELLING = {
    "rights": "copyright rights reserved droits rechte derechos impressum",
    "cookie": "cookie cookies consent privacy datenschutz",
    "share": "share tweet facebook twitter whatsapp teilen partager compartir",
    "sign": "subscribe newsletter login signup register sign password email",
    "advert": "advertisement sponsored advert promoted anzeige publicite publicidad",
    "reply": "reply replies comment comments responder antworten says wrote",
    "more": "related read more next previous menu home search",
}
TELLS = {word: kind for kind, words in TELLING.items() for word in words.split()}

SENTENCE_END = (".", "!", "?", "…", ":", ";", "\"", "”")


class Blocks(HTMLParser):
    """Collects (features, text, label) of the leaf blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Of each open element: tag, features of its blocks, label, words of its own.
        self.stack: list[tuple[str, tuple[str, ...], bool]] = [("", (), False)]
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[tuple[tuple[str, ...], str, int, bool]] = []

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, features, label = self.stack[-1]
                self.found.append((features, text, self.linked, label))
            self.parts, self.linked = [], 0

    def end_head(self, tag: str = "") -> None:
        """Close an open head that cannot hold this element, or else text."""
        if self.silent and self.stack[-1][0] in ("head", "noscript") and tag not in HEAD_TAGS:
            i = next((i for i, (t, _, _) in enumerate(self.stack) if t == "head"), 0)
            if i and len(self.stack) - i <= 2:
                self.close_to(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.end_head(tag)
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.end_block()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in CLOSES.get(tag, ()):
                self.close_to(i)
            elif self.stack[i][0] in CONTAINERS:
                break
        if tag in VOID_TAGS:
            return
        _, features, label = self.stack[-1]
        own = [f"in={tag}"] if tag in BLOCK_TAGS else []
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                own.extend(f"word={w}" for w in words_of(value))
            elif name == "hidden" or (name == "style" and value and "display:none" in value.replace(" ", "")):
                own.append("hidden")
            elif name == "data-label":
                label = True
        own = [f for f in own if f not in features]
        self.stack.append((tag, (*features, *own) if own else features, label))
        self.silent += tag in NO_TEXT_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def close_to(self, i: int) -> None:
        if any(tag in BLOCK_TAGS for tag, _, _ in self.stack[i:]):
            self.end_block()
        for tag, _, _ in self.stack[i:]:
            self.silent -= tag in NO_TEXT_TAGS
            self.links -= tag == "a"
        del self.stack[i:]

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.close_to(i)
                return
        if tag in ("p", "br"):
            self.end_block()

    def handle_data(self, data: str) -> None:
        if self.silent and self.stack[-1][0] == "head" and not data.isspace():
            self.end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


@lru_cache(maxsize=WORDS_KEPT)
def words_of(value: str) -> tuple[str, ...]:
    """Lower-case words of a class or id, cut at signs, capitals and digits."""
    return tuple(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value))


def blocks(html: str) -> list[tuple[tuple[str, ...], str, int, bool]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return parser.found


def step(value: float, edges: tuple[float, ...]) -> int:
    return sum(value >= e for e in edges)


def features(found: list[tuple[tuple[str, ...], str, int, bool]]) -> list[list[str]]:
    """The features of each block of a page."""
    out = []
    n = len(found)
    for i, (ancestors, text, linked, _) in enumerate(found):
        count = text.count(" ") + 1
        links = step(linked / len(text), (0.01, 0.3, 0.7))
        size = step(count, (3, 6, 11, 21, 51))
        # The innermost ancestor that says what it is for.
        near = next((a for a in reversed(ancestors) if a in SPEAKING or a.startswith("word=")), "none")
        own = [
            "any", f"near={near}", f"near={near},{step(count, (6, 21))}", f"links={links}", f"size={size}", f"shape={links},{size}", f"ends={text.endswith(SENTENCE_END)}",
            f"place={step(i / n, (0.1, 0.25, 0.75, 0.9))}",
        ]
        if "©" in text:
            own.append("sign=©")
        if count <= 30:
            own.extend({f"tells={TELLS[w]}" for w in re.findall(r"[a-z]+", text.lower()) if w in TELLS})
        out.append([*ancestors, *own])
    return out


class Chain:
    """Weights of features for both labels, and of steps between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps

    def emissions(self, pages: list[list[list[str]]]) -> np.ndarray:
        """Scores of both labels for all blocks of all pages, end to end."""
        ids, sizes = [], []
        get = self.names.get
        for page in pages:
            for block in page:
                known = [j for f in block if (j := get(f)) is not None]
                ids.extend(known)
                sizes.append(len(known))
        sizes = np.array(sizes, np.int64)
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(self.weights[np.array(ids, np.int64)], axis=0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """The best labels of one page."""
        n = len(scores)
        back = np.zeros((n, 2), np.int64)
        best = scores[0]
        for t in range(1, n):
            through = best[:, None] + self.steps
            back[t] = through.argmax(axis=0)
            best = through.max(axis=0) + scores[t]
        labels = np.zeros(n, np.int64)
        labels[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels

    def main_text(self, htmls: list[str]) -> list[str]:
        found = [blocks(h) for h in htmls]
        scores = self.emissions([features(f) for f in found]) if any(found) else None
        out, at = [], 0
        for page in found:
            labels = self.viterbi(scores[at : at + len(page)]) if page else ()
            at += len(page)
            out.append(" ".join(text for (_, text, _, _), label in zip(page, labels, strict=True) if label))
        return out


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def train(htmls: Iterable[str], iterations: int = ITERATIONS, prior: float = 0.02, least: int = 3) -> Chain:
    """A chain fitted to pages whose main elements have ``data-label``."""
    pages = [p for p in (blocks(h) for h in htmls) if p]
    pages.sort(key=len, reverse=True)
    made = [features(p) for p in pages]
    seen: dict[str, int] = {}
    for page in made:
        for block in page:
            for f in block:
                seen[f] = seen.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= least))}
    # Blocks by place: all first blocks, all second ones, and so on.
    lengths = np.array([len(p) for p in pages])
    longest = int(lengths.max())
    active = [int((lengths > t).sum()) for t in range(longest)]
    ids, sizes, labels = [], [], []
    for t in range(longest):
        for k in range(active[t]):
            known = [names[f] for f in made[k][t] if f in names]
            ids.extend(known)
            sizes.append(len(known))
            labels.append(int(pages[k][t][3]))
    ids, sizes, labels = np.array(ids), np.array(sizes), np.array(labels)
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum([0, *active])
    part = [slice(first[t], first[t + 1]) for t in range(longest)]
    truth = np.eye(2)[labels]
    weights, steps = np.zeros((len(names), 2)), np.zeros((2, 2))
    true_steps = np.zeros((2, 2))
    for t in range(1, longest):
        np.add.at(true_steps, (labels[part[t - 1]][: active[t]], labels[part[t]]), 1)
    state = [np.zeros_like(x) for x in (weights, steps, weights, steps)]
    for round_ in range(1, iterations + 1):
        scores = np.stack([np.bincount(row, weights[ids, y], len(sizes)) for y in (0, 1)], axis=1)
        ahead = [scores[part[0]]]
        for t in range(1, longest):
            ahead.append(_log_sum(ahead[-1][: active[t], :, None] + steps, 1) + scores[part[t]])
        behind = np.zeros((active[-1], 2))
        total = np.empty(len(pages))
        for t in range(longest - 1, -1, -1):
            if t == longest - 1 or active[t + 1] < active[t]:
                grown = np.zeros((active[t], 2))
                grown[: len(behind)] = behind
                start = 0 if t == longest - 1 else active[t + 1]
                total[start : active[t]] = _log_sum(ahead[t][start:], 1)
                behind = grown
            if t == longest - 1:
                marginal = np.empty((len(sizes), 2))
                pair = np.zeros((2, 2))
            marginal[part[t]] = np.exp(ahead[t] + behind - total[: active[t], None])
            if t:
                to = scores[part[t]] + behind
                through = ahead[t - 1][: active[t], :, None] + steps + to[:, None, :]
                pair += np.exp(through - total[: active[t], None, None]).sum(axis=0)
                behind = _log_sum(steps[None] + to[:, None, :], 2)
        missing = truth - marginal
        slope = np.stack([np.bincount(ids, missing[row, y], len(names)) for y in (0, 1)], axis=1) - prior * weights
        slopes = (slope, true_steps - pair - prior * steps)
        # Adam.
        for i, (x, g) in enumerate(zip((weights, steps), slopes, strict=True)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 2] = 0.99 * state[i + 2] + 0.01 * g * g
            x += 0.1 * (state[i] / (1 - 0.9**round_)) / (np.sqrt(state[i + 2] / (1 - 0.99**round_)) + 1e-6)
    return Chain(names, weights, steps)


# --- labelled pages ----------------------------------------------------------

# Names that designers give to the parts of a page.
NAMES = {
    "menu": "nav menu navbar navigation topnav main-menu site-nav mega-menu toolbar tabs breadcrumb breadcrumbs pagination pager toc",
    "header": "header site-header masthead top topbar banner branding logo page-header",
    "footer": "footer site-footer foot bottom colophon copyright legal page-footer credits",
    "side": "sidebar side widget widgets aside rail related recommended popular trending more-stories tags tagcloud archive",
    "notice": "cookie cookies cookie-notice consent gdpr notice alert popup modal overlay message warning disclaimer toast",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner-ad ad-slot commercial adbox",
    "form": "form search search-form login signup subscribe newsletter contact-form register poll survey",
    "comments": "comments comment comment-list discussion responses replies reply disqus thread user-comments feedback reviews",
    "share": "share social sharing share-buttons social-links follow addthis likes",
    "main": "content article post entry story main body text article-body post-content entry-content main-content story-body page-content page wrapper container column",
}
NAMES = {kind: names.split() for kind, names in NAMES.items()}
TAGS = {
    "menu": ("nav", "nav", "div", "ul"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"),
    "side": ("aside", "aside", "div", "section"), "notice": ("div", "div", "section", "dialog", "p"),
    "advert": ("div", "div", "aside", "section", "ins"), "form": ("form", "form", "form", "div"),
    "comments": ("section", "div", "div", "ol"), "share": ("div", "ul", "p"),
}
PHRASES = {
    "notice": "We use cookies to improve your visit. By going on you accept our privacy rules.|This page is out of date.|Please turn on scripts to see all of this page.",
    "footer": "© 2020 All rights reserved.|Copyright by the owners|Impressum Datenschutz|Terms Privacy Contact",
    "form": "Subscribe to our newsletter|Your email|Search|Sign in with your password|Send",
    "share": "Share this|Tweet|Facebook|Follow us",
    "comments": "3 comments|Reply|Anna says: well written, thanks!|Leave a reply",
    "advert": "Advertisement|Sponsored|Buy now, today only!",
    "side": "Related|Most read|Read more",
}


class Page:
    """One random page; elements of the main text carry ``data-label``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.alphabet = self.r.choice(("etaoinshrdlu", "etaoinshrdluéèàç", "enisratdhulöäüß", "eaosrnidlcñóí"))
        self.casing = self.r.choices((str, str.upper), (9, 1))[0]
        self.marks = self.r.choices(("", "!!", "***", " |"), (12, 1, 1, 1))[0]

    def word(self) -> str:
        return "".join(self.r.choices(self.alphabet, k=self.r.randint(1, 10))) + self.marks

    def sentence(self, low: int, high: int) -> str:
        text = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        text = self.casing(text[:1].upper() + text[1:])
        return text + self.r.choices((".", "", "?", "!"), (8, 1, 1, 1))[0]

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence(2, 20) for _ in range(self.r.randint(low, high)))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        if len(words) > 3 and self.r.random() < 0.3:
            i = self.r.randrange(len(words))
            tag = self.r.choice(("b", "i", "em", "strong", "a", "span", "code"))
            words[i] = f"<{tag}>{words[i]}</{tag}>"
        if self.r.random() < 0.1:
            words.insert(self.r.randrange(len(words)), "<br>")
        return " ".join(words)

    def links(self, low: int = 2, high: int = 9) -> str:
        items = [f'<a href="/{i}">{self.casing(self.word())}</a>' for i in range(self.r.randint(low, high))]
        kind = self.r.randrange(3)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if kind == 1 else " ".join(items)

    def named(self, kind: str) -> str:
        name = self.r.choice(NAMES[kind])
        if self.r.random() < 0.3:
            name = name.title().replace("-", "")
        extra = f" {self.r.choice(('box', 'inner', 'left', 'wide', 'col'))}{self.r.randint(1, 9)}" if self.r.random() < 0.4 else ""
        return f' {self.r.choice(("class", "class", "class", "id"))}="{name}{extra}"'

    def part(self, kind: str) -> str:
        tag = self.r.choice(TAGS[kind])
        told = self.named(kind) if self.r.random() < (0.5 if tag in ("nav", "header", "footer", "aside", "form") else 1) else ""
        said = PHRASES.get(kind, "").split("|")
        bits = [f"<p>{self.r.choice(said)}</p>"] if said[0] and self.r.random() < 0.6 else []
        for _ in range(self.r.randint(0 if bits else 1, 3)):
            bits.append({
                "menu": lambda: self.links(), "header": lambda: self.links(1, 4) if self.r.random() < 0.5 else f"<div>{self.sentence(1, 6)}</div>",
                "footer": lambda: self.prose(1, 2) if self.r.random() < 0.6 else self.links(),
                "side": lambda: self.r.choice((f"<h3>{self.sentence(1, 5)}</h3>", self.links(), f"<p>{self.prose(1, 3)}</p>")),
                "form": lambda: f"<label>{self.word()}</label><input name=x><button>{self.word()}</button>",
                "comments": lambda: f"<div><b>{self.word()}</b><p>{self.prose(1, 4)}</p></div>",
                "share": lambda: self.links(),
            }.get(kind, lambda: self.r.choice((self.prose(1, 2), f"<p>{self.prose(1, 3)}</p>", f'<a href="/x">{self.sentence(2, 8)}</a>')))())
        return f"<{tag}{told}>{''.join(bits)}</{tag}>"

    def article(self) -> str:
        r, said = self.r, ' data-label="main"'
        out = [f"<h1{said}>{self.sentence(1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.6:
                out.append(f"<p{said}>{self.inline(self.prose(1, 6))}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.68:
                out.append(f"<p{said}><b>{self.prose(1, 4)}<br>" + ("" if r.random() < 0.7 else self.prose(1, 2)))
            elif kind < 0.75:
                out.append(f"<p{said}>{self.sentence(1, 3)}</p>")
            elif kind < 0.82:
                out.append(f"<h2{said}>{self.sentence(1, 6)}</h2>")
            elif kind < 0.88:
                out.append(f"<ul{said}>" + "".join(f"<li>{self.sentence(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote{said}>{self.prose(1, 3)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table{said}><tr><td>{self.word()}</td><td>{self.sentence(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                out.append(f"<pre{said}>{self.prose(1, 3)}</pre>")
            else:
                out.append(self.part(r.choice(("advert", "share", "side", "form", "notice"))))
        return "".join(out)

    def html(self) -> str:
        r = self.r
        tag = r.choices(("article", "main", "div", "section", "td"), (5, 2, 5, 1, 1))[0]
        told = self.named("main") if tag in ("div", "section", "td") or r.random() < 0.3 else ""
        body = f"<{tag}{told}>{self.article()}</{tag}>"
        if tag == "td":
            body = f"<table><tr><td{self.named('menu')}>{self.links()}</td>{body}</tr></table>"
        elif r.random() < 0.4:
            body = f"<div{self.named('main')}>{body}</div>"
        if r.random() < 0.1:
            body = self.article()
        before = [self.part(k) for k in ("notice", "header", "menu", "advert", "menu", "form", "side") if r.random() < 0.4]
        after = [self.part(k) for k in ("share", "advert", "side", "comments", "form", "notice") if r.random() < 0.35]
        after += [self.part("footer")] if r.random() < 0.8 else []
        r.shuffle(before)
        if r.random() < 0.3:
            body = f"<div{self.named('main')}>{body}{''.join(after[:2])}</div>"
            after = after[2:]
        script = "<script>var a='<p>no</p>';</script><style>p{margin:0}</style>" if r.random() < 0.5 else ""
        return f"<!DOCTYPE html><html><head><title>{self.sentence(1, 6)}</title>{script}</head><body>{''.join(before)}<!-- x -->{body}{''.join(after)}</body></html>"


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    return [Page(seed * 1_000_003 + i).html() for i in range(count)]


@cache
def standard_chain() -> Chain:
    """The chain of the package's own pages; the same on every run."""
    return train(labelled_pages())


def _texts(batches: Iterator[pa.RecordBatch], chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = chain.value.main_text(part.column("html").to_pylist())
            yield pa.record_batch([part.column("row"), pa.array(texts, pa.string())], names=["row", "main"])


def main_texts(df: DataFrame, html: str = "html", name: str = "text", chain: Chain | None = None) -> DataFrame:
    """All rows and columns but the html, and ``name``, the page's main text."""
    # Weights of a fixed number of training pages.
    weights = df.sparkSession.sparkContext.broadcast(chain or standard_chain())
    columns = [c for c in df.columns if c not in (html, name)]
    rows = spread(df).select(as_row(columns), whole(F.col(f"`{html}`")).alias("html"))
    out = rows.mapInArrow(lambda it: _texts(it, weights), f"{row_type(rows)}, main string")
    return out.select(*from_row(columns), F.col("main").alias(name))
