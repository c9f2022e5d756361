"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Method. A page is cut into its leaf blocks: stretches of text between block-level tags.
Scripts, styles, comments and other markup hold no text. A block's features are its
ancestors' tags, the hints in their class and id names, and measures of its text (words,
share of linked text, final signs, digits, place on the page). A chain of two states, kept
or not, scores blocks by their features and neighbours by a transition table. Weights are
fitted by penalised maximum likelihood (forward-backward, Adam) on ``TRAIN_PAGES`` labelled
pages, a documented bound; pages are decoded by Viterbi.

Text. Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and the kept ones joined by one space, in page order.

Null and empty html have an empty text, as have pages without blocks. Broken markup (open
tags, missing ends, stray signs) is read as far as it goes. Repeated rows and null ids are
read row by row; long pages are read whole. No rows: no rows. Columns other than the id,
the url and the html are not read.

Scale. One pass without a shuffle; workers hold a slice of a batch. The weights are a few
hundred numbers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import html_training
from cohortlens.llm.common import ship, slices, table

TRAIN_PAGES, ROUNDS, RATE, PENALTY = 600, 120, 0.15, 1e-3

#: Tags that break a text into blocks. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math title textarea canvas audio video".split())
#: An opening tag closes these open ones, up to the barrier.
CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
CLOSES |= dict.fromkeys(BLOCKS - set(CLOSES) - {"br", "body", "html", "head", "button", "label", "summary", "caption", "legend", "figcaption"}, ("p",))
BARRIER = frozenset("article aside body div footer form header main nav ol section table td th ul dialog".split())
#: Ancestor tags that are features, and hints in class and id names.
TAGS = frozenset(
    "a article aside blockquote button dialog div figcaption figure footer form h1 h2 h3 h4 header label legend li main menu nav ol option p pre section select table td ul".split()
)
HINTS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs topnav toolbar tabs pagination pager",
    "head": "header masthead branding logo hero",
    "foot": "footer copyright colophon legal imprint",
    "side": "sidebar aside widget related recommended recommend recommendation more popular trending",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "note": "cookie cookies notice consent gdpr popup modal alert banner overlay",
    "talk": "comment comments reply replies discussion disqus response responses respond feedback",
    "share": "share sharing social tags tag meta byline author",
    "news": "newsletter subscribe subscription signup login register search form",
    "main": "content article post entry story main text body page",
}
_HINT_OF = {w: k for k, v in HINTS.items() for w in v.split()}

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@lru_cache(maxsize=50_000)
def _hints(attributes: str) -> tuple[str, ...]:
    found = set()
    for m in _NAMES.finditer(attributes):
        for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            if w in _HINT_OF:
                found.add("hint=" + _HINT_OF[w])
    return tuple(sorted(found))


class _Scanner:
    """Tags in order, moving forward only: what was once found to be missing ahead isn't
    looked for again, so broken markup takes time in proportion to its length."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.dead: set[int] = set()  # quotes from which no tag ends
        self.endless: set[str] = set()  # raw elements without an end tag ahead

    def tag_end(self, at: int) -> int:
        """Where the tag's ``>`` stands: the first outside quotes, else the first; -1 if none."""
        if at > self.last:
            return -1
        seen, pos = [], at
        while m := _STOP.search(self.source, pos):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            pos = self.source.find(m[0], m.start() + 1) + 1
            if not pos:
                break
        self.dead.update(seen)
        return self.source.find(">", at)

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, closing, name, attributes) of the next tag; the name is empty for
        comments and declarations."""
        source = self.source
        while m := _OPEN.search(source, at):
            if m[1]:
                end = source.find("-->", m.end())
                return m.start(), len(source) if end < 0 else end + 3, False, "", ""
            if m[3] is None:
                end = source.find(">", m.end())
                return m.start(), len(source) if end < 0 else end + 1, False, "", ""
            end = self.tag_end(m.end())
            if end >= 0:
                return m.start(), end + 1, bool(m[2]), m[3].lower(), source[m.end() : end]
            at = m.end()
        return None

    def raw_end(self, name: str, at: int) -> int:
        """Behind the end tag of a raw element; -1 if there is none."""
        if name in self.endless:
            return -1
        end = re.compile(rf"</{name}\b[^>]*>", re.I).search(self.source, at)
        if end is None:
            self.endless.add(name)
            return -1
        return end.end()


#: Elements whose content runs to the end of the page where no end tag follows.
TO_THE_END = {"script", "style", "textarea", "title"}


def leaf_blocks(source: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, ancestors' features, characters in links) of every block with text."""
    blocks: list[tuple[str, tuple[str, ...], int]] = []
    scan = _Scanner(source)
    stack: list[tuple[str, tuple[str, ...]]] = []
    names: Counter[str] = Counter()  # of the stack's elements
    traits: Counter[str] = Counter()  # their features
    around: list[str] = []  # the stack's blocks
    parts: list[str] = []
    linked, at = 0, 0
    context: tuple[str, ...] | None = None

    def push(name: str, own: tuple[str, ...]) -> None:
        stack.append((name, own))
        names[name] += 1
        traits.update(own)
        if name in BLOCKS:
            around.append(name)

    def pop_to(i: int) -> None:
        while len(stack) > i:
            name, own = stack.pop()
            names[name] -= 1
            if name in BLOCKS:
                around.pop()
            for x in own:
                traits[x] -= 1
                if not traits[x]:
                    del traits[x]

    def close() -> None:
        nonlocal linked, context
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((text, context or (), linked))
        parts.clear()
        linked, context = 0, None

    def add(text: str) -> None:
        nonlocal linked, context
        if not text:
            return
        text = html.unescape(text)  # a reference doesn't go over a tag
        if context is None and not text.isspace():
            context = (*sorted(traits), "own=" + (around[-1] if around else "none"))
        parts.append(text)
        linked += len(text.strip()) * bool(names["a"])

    while True:
        tag = scan.next(at)
        if not tag:
            add(source[at:])
            close()
            return blocks
        begin, end, closing, name, attributes = tag
        add(source[at:begin])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            close()
        if closing:
            if names[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                raw = scan.raw_end(name, at)
                at = raw if raw >= 0 else len(source) if name in TO_THE_END else at
            continue
        if name in CLOSES and any(names[x] for x in CLOSES[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    pop_to(i)
                    break
                if stack[i][0] in BARRIER:
                    break
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        push(name, (("in=" + name,) if name in TAGS else ()) + _hints(attributes))


def _step(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def features(blocks: list[tuple[str, tuple[str, ...], int]]) -> list[list[str]]:
    out = []
    n = len(blocks)
    for i, (text, context, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        size = f"words={_step(words, 2, 4, 8, 16, 40)}"
        link = f"linked={_step(linked / len(text), 0.01, 0.3, 0.7)}"
        out.append([
            *context, "any", size, link, f"end={'stop' if text[-1] in '.!?…:;»”\"' else 'none'}",
            f"digits={_step(sum(c.isdigit() for c in text) / len(text), 0.1, 0.4)}",
            "sign=copy" if "©" in text or "®" in text else "sign=none",
            f"from={_step(i, 1, 3, 8)}", f"to={_step(n - 1 - i, 1, 3, 8)}",
            f"{size}&{link}",
        ])
    return out


class Chain:
    """Weights of the field: features x states, and transitions; state 1 keeps."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    @classmethod
    def fit(cls, sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = ROUNDS) -> Chain:
        names = {x: i for i, x in enumerate(sorted({f for s in sequences for b in s for f in b}))}
        n, longest = len(sequences), max(map(len, sequences))
        width = max(len(b) for s in sequences for b in s)
        feats = np.full((longest, n, width), len(names))  # the last weight is always zero
        gold, real = np.zeros((longest, n), int), np.zeros((longest, n))
        for j, (s, y) in enumerate(zip(sequences, labels, strict=True)):
            for i, b in enumerate(s):
                feats[i, j, : len(b)] = [names[f] for f in b]
            gold[: len(s), j], real[: len(s), j] = y, 1
        pairs = real[1:]
        w, t = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
        moment = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
        seen = np.zeros_like(w)
        np.add.at(seen, (feats, gold[..., None]), real[..., None])
        seen_t = np.array([[((gold[:-1] == a) & (gold[1:] == b) & (pairs > 0)).sum() for b in (0, 1)] for a in (0, 1)], float)
        for step in range(1, rounds + 1):
            e = w[feats].sum(2) * real[..., None]
            fwd, bwd = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
            fwd[0] = e[0]
            for i in range(1, longest):
                to = np.logaddexp(fwd[i - 1, :, :1] + t[0], fwd[i - 1, :, 1:] + t[1]) + e[i]
                fwd[i] = np.where(real[i][:, None] > 0, to, fwd[i - 1])
            for i in range(longest - 2, -1, -1):
                nxt = e[i + 1] + bwd[i + 1]
                to = np.logaddexp(t[:, 0] + nxt[:, :1], t[:, 1] + nxt[:, 1:])
                bwd[i] = np.where(real[i + 1][:, None] > 0, to, 0)
            total = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
            p = np.exp(fwd + bwd - total[:, None]) * real[..., None]
            want = np.stack([np.bincount(feats.ravel(), np.repeat(p[..., s].ravel(), width), len(names) + 1) for s in (0, 1)], 1)
            both = np.exp(fwd[:-1, :, :, None] + t + (e[1:] + bwd[1:])[:, :, None, :] - total[:, None, None]) * pairs[..., None, None]
            for k, (x, grad) in enumerate(((w, (seen - want) / n - PENALTY * w), (t, (seen_t - both.sum((0, 1))) / n - PENALTY * t))):
                moment[0][k][:] = 0.9 * moment[0][k] + 0.1 * grad
                moment[1][k][:] = 0.99 * moment[1][k] + 0.01 * grad**2
                x += RATE * (moment[0][k] / (1 - 0.9**step)) / (np.sqrt(moment[1][k] / (1 - 0.99**step)) + 1e-8)
            w[-1] = 0
        return cls(names, w[:-1], t)

    def viterbi(self, sequence: list[list[str]]) -> list[int]:
        """The best states of one page."""
        if not sequence:
            return []
        (a, b), (c, d) = self.moves.tolist()
        table_ = self._table()
        back: list[tuple[int, int]] = []
        x = y = 0.0
        for i, block in enumerate(sequence):
            u = v = 0.0
            for f in block:
                got = table_.get(f)
                if got:
                    u += got[0]
                    v += got[1]
            if i == 0:
                x, y = u, v
                continue
            p, q = x + a >= y + c, x + b >= y + d
            back.append((0 if p else 1, 0 if q else 1))
            x, y = (x + a if p else y + c) + u, (x + b if q else y + d) + v
        state = 0 if x >= y else 1
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def _table(self) -> dict[str, tuple[float, float]]:
        if not hasattr(self, "_cached"):
            self._cached = {f: tuple(self.weights[i].tolist()) for f, i in self.names.items()}
        return self._cached


def labelled(pages: list[str]) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Feature sequences and states of training pages."""
    xs, ys = [], []
    for p in pages:
        blocks = leaf_blocks(p)
        ys.append([int(html_training.KEEP in t) for t, _, _ in blocks])
        clean = [(t.replace(html_training.KEEP, "").replace(html_training.DROP, "") or "x", c, n) for t, c, n in blocks]
        xs.append(features(clean))
    return xs, ys


@lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES) -> Chain:
    return Chain.fit(*labelled(html_training.pages(pages)))


def main_text(chain: Chain, source: str | None) -> str:
    blocks = leaf_blocks(source or "")
    return " ".join(b[0] for b, keep in zip(blocks, chain.viterbi(features(blocks)), strict=True) if keep)


def _extractor(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(chain, h) for h in part.column("html").to_pylist()]
                cols = [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for each row of ``pages``."""
    ship(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = p.schema["id"].dataType.simpleString()
    out = p.mapInArrow(_extractor(chain or trained()), f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
