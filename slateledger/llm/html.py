"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks: runs of text between tags that begin or end a block, each with the
elements that it lies in. Features are the tags, classes, ids and roles of these elements, and the shape, links and
wording of the text and its neighbours. The field has two labels (main text or not); it is fitted by maximum
likelihood (forward-backward over all pages at once) and decoded by Viterbi.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slateledger.llm.common import arrow_map, table
from slateledger.llm.labelled_pages import MAIN, labelled_pages

#: Labelled pages that the query's model is fitted on, and what generates them.
PAGES, SEED = 800, 11
ROUNDS, RATE, PENALTY = 150, 0.25, 0.02
#: Enclosing elements whose own names count one by one; farther ones count as open tags and names only.
NEAR = 6

#: Elements that begin and end a block (fixed values: HTML's block-level elements and table parts).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without end tags, and elements whose content is no text of the page (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("template svg math select datalist object audio video canvas noscript button".split())
#: What the start of an element ends, if that is open, up to the given bounds (HTML's optional end tags).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
SPACED = frozenset(("br", "img", "wbr", "input"))

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_DIGIT = re.compile("[0-9]")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUES = re.compile(
    r"(?i)\b(cookies?|consent|subscrib\w*|newsletter|comments?|repl(?:y|ies)|shar(?:e|ing)|log ?in|sign (?:in|up)|menu|home|contact|advertis\w*|sponsored|privacy|terms|"
    r"copyright|rights reserved|read more|related|follow us|search|e-?mail|password|previous|next|tags?|©|permalink|ago|said|wrote|at \d|\d\d:\d\d)"
)


def names(attrs: str) -> list[str]:
    """Words of an element's classes, ids and roles; `hidden` where it isn't shown."""
    out = []
    for name, value in _NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if "display:none" in value.replace(" ", "").lower():
                out.append("hidden")
        elif name in ("hidden", "aria-hidden"):
            if name == "hidden" or value.lower() == "true":
                out.append("hidden")
        else:
            out += [p.lower() for p in _PIECE.findall(html.unescape(value))]
    return out


class Block:
    __slots__ = ("text", "links", "inside", "near")

    def __init__(self, text: str, links: int, inside: list[str], near: list[str]):
        self.text, self.links, self.inside, self.near = text, links, inside, near


class Reader:
    """One pass over a page's source; the open elements are a stack, and how often each tag and name is open is counted."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[str]]] = []
        self.open: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.links = 0

    def end_block(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                near = [f"{d}:{x}" for d, (_, own) in enumerate(reversed(self.stack[-NEAR:])) for x in own[:8]]
                self.blocks.append(Block(text, self.links, list(self.open), near))
            self.held, self.links = [], 0

    def push(self, tag: str, attrs: str) -> None:
        own = list(dict.fromkeys([f"<{tag}>", *names(attrs)])) if attrs else [f"<{tag}>"]
        self.stack.append((tag, own))
        for x in own:
            self.open[x] = self.open.get(x, 0) + 1

    def pop(self) -> None:
        for x in self.stack.pop()[1]:
            self.open[x] -= 1
            if not self.open[x]:
                del self.open[x]

    def end(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str] = frozenset()) -> None:
        """Close elements down to the outermost open one of `tags` above the innermost of `bounds`."""
        at = None
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in tags:
                at = k
            elif name in bounds:
                break
        if at is not None:
            while len(self.stack) > at:
                self.pop()

    def close(self, tag: str) -> None:
        if f"<{tag}>" in self.open:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self.held.append(piece)
            if "<a>" in self.open:
                self.links += len(piece.strip())

    def read(self, source: str) -> list[Block]:
        at, size = 0, len(source)
        while at < size:
            lt = source.find("<", at)
            if lt < 0:
                self.text(source[at:])
                break
            m = _TAG.match(source, lt)
            if m is None:
                if (o := _OTHER.match(source, lt)) is not None:
                    self.text(source[at:lt])
                    at = o.end()
                elif lt + 1 < size and source[lt + 1].isascii() and source[lt + 1].isalpha():
                    self.text(source[at:lt])  # a tag that the page's end cuts off
                    break
                else:
                    self.text(source[at : lt + 1])  # a sign, not a tag
                    at = lt + 1
                continue
            self.text(source[at:lt])
            at, tag = m.end(), m[2].lower()
            if tag in SPACED:
                self.held.append(" " if tag != "wbr" else "")
                continue
            if tag in BLOCK:
                self.end_block()
            if m[1]:
                self.close(tag)
            elif tag in RAW or tag in HIDDEN:
                if not m[3].rstrip().endswith("/") or tag in RAW:
                    at = skip(source, at, tag)
            else:
                if tag in BLOCK and "<p>" in self.open:
                    self.end({"p"}, {"button", "td", "th", "caption", "html"})
                if tag in ENDS:
                    self.end(*ENDS[tag])
                if tag not in VOID:
                    self.push(tag, m[3])
        self.end_block()
        return self.blocks


_SKIP = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW | HIDDEN}


def skip(source: str, at: int, tag: str) -> int:
    """Where the element's content has ended; an element that never ends has none, if it isn't raw text."""
    depth, begin = 1, at
    for m in _SKIP[tag].finditer(source, at):
        depth += -1 if m[1] else (tag not in RAW)
        if not depth:
            return m.end()
    return len(source) if tag in RAW else begin


def blocks(source: str | None) -> list[Block]:
    return Reader().read(source or "")


def size_bin(n: int) -> int:
    return bisect.bisect_left((1, 3, 7, 15, 40, 100), n)


#: Bins of texts whose wording is looked at: up to 15 words.
SHORT = frozenset(f"words{k}" for k in range(4))


def features(page: list[Block]) -> list[list[str]]:
    """The names of the features of every block."""
    shape = []
    for b in page:
        n, t = b.text.count(" ") + 1, b.text
        share = b.links / len(t)
        shape.append((f"words{size_bin(n)}", f"links{0 if not share else 1 if share < 0.5 else 2 if share < 0.9 else 3}"))
    out = []
    for k, (b, (words, links)) in enumerate(zip(page, shape, strict=True)):
        t = b.text
        own = ["bias", words, links, words + links, *b.near]
        own += [f"in:{x}" for x in b.inside]
        if words in SHORT:  # what a long text mentions says nothing about its part of the page
            own += [f"cue:{c}" for c in {c.lower() for c in _CUES.findall(t)}]
        own.append("end:" + (t[-1] if t[-1] in ".!?:…»”\"'" else "digit" if t[-1].isdigit() else "other"))
        own.append(f"commas{min(3, t.count(','))}")
        if t.isupper():
            own.append("upper")
        if len(_DIGIT.findall(t)) * 4 > len(t):
            own.append("digits")
        for d, name in ((-1, "before"), (1, "after")):
            if 0 <= k + d < len(page):
                own += [f"{name}:{shape[k + d][0]}", f"{name}:{shape[k + d][1]}"]
            else:
                own.append(f"{name}:none")
        out.append(own)
    return out


class Field:
    """Weights of features by label, and of neighbouring labels."""

    def __init__(self, columns: dict[str, int]):
        self.columns = columns
        self.w = np.zeros((len(columns), 2))
        self.step, self.first, self.last = np.zeros((2, 2)), np.zeros(2), np.zeros(2)

    def rows(self, page: list[Block]) -> list[list[int]]:
        get = self.columns.get
        return [[c for x in dict.fromkeys(own) if (c := get(x)) is not None] for own in features(page)]

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.array([c for r in rows for c in r], np.int64)
        begin = np.cumsum([0, *[len(r) for r in rows]])[:-1]
        return np.add.reduceat(self.w[flat], begin, axis=0)  # every block has the bias

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely ones those with more blocks left out."""
        if not page:
            return []
        s = self.scores(self.rows(page))
        s[0] += self.first
        s[-1] += self.last
        (s00, s01), (s10, s11) = self.step.tolist()
        (a, b), back = s[0].tolist(), []
        for x, y in s[1:].tolist():
            c, d = a + s00, b + s10
            e, f = a + s01, b + s11
            back.append((int(d > c), int(f > e)))
            a, b = max(c, d) + x, max(e, f) + y
        label = [int(b > a)]
        for p in reversed(back):
            label.append(p[label[-1]])
        return label[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximum likelihood over labelled pages (blocks, a 0 or 1 for each), by full steps of Adam. Features that fewer
    than two pages have are left out. Without pages nothing is main text."""
    pages = [(b, y) for b, y in pages if b]
    seen: dict[str, int] = {"bias": 2}
    for b, _ in pages:
        for x in {x for own in features(b) for x in own}:
            seen[x] = seen.get(x, 0) + 1
    field = Field({x: k for k, x in enumerate(sorted(x for x, n in seen.items() if n > 1))})
    if not pages:
        field.w[field.columns["bias"], 0] = 1
        return field
    rows = [r for b, _ in pages for r in field.rows(b)]
    flat = np.array([c for r in rows for c in r], np.int64)
    begin = np.cumsum([0, *[len(r) for r in rows]])
    owner = np.repeat(np.arange(len(rows)), np.diff(begin))
    lens = np.array([len(b) for b, _ in pages])
    at = np.arange(lens.max())[None, :] < lens[:, None]  # pages x blocks, padded
    y = np.zeros(at.shape, np.int64)
    y[at] = np.concatenate([y for _, y in pages])
    gold = np.eye(2)[y] * at[..., None]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    n, t = at.shape
    end = (np.arange(n), lens - 1)
    p = [field.w, field.step, field.first, field.last]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for k in range(1, rounds + 1):
        s = np.zeros((n, t, 2))
        s[at] = np.add.reduceat(field.w[flat], begin[:-1], axis=0)
        s[:, 0] += field.first
        s[end] += field.last
        up, down = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        up[:, 0] = s[:, 0]
        for i in range(1, t):
            nxt = np.logaddexp.reduce(up[:, i - 1, :, None] + field.step, axis=1) + s[:, i]
            up[:, i] = np.where(at[:, i, None], nxt, up[:, i - 1])
        for i in range(t - 2, -1, -1):
            nxt = np.logaddexp.reduce(field.step + (s[:, i + 1] + down[:, i + 1])[:, None, :], axis=2)
            down[:, i] = np.where(at[:, i + 1, None], nxt, 0)
        z = np.logaddexp.reduce(up[:, -1], axis=1)
        one = np.exp(up + down - z[:, None, None]) * at[..., None]
        two = np.exp(up[:, :-1, :, None] + field.step + (s[:, 1:] + down[:, 1:])[:, :, None, :] - z[:, None, None, None]) * at[:, 1:, None, None]
        miss = (one - gold)[at]
        g = [np.stack([np.bincount(flat, miss[owner, c], len(field.w)) for c in (0, 1)], axis=1), two.sum(axis=(0, 1)) - pairs, (one - gold)[:, 0].sum(axis=0), (one - gold)[end].sum(axis=0)]
        for x, d, a, b in zip(p, g, m, v, strict=True):
            d = d / n + penalty / n * x
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return field


def labels(page: list[Block]) -> list[int]:
    """Labels of a generated page; its main blocks carry a mark, which is taken out."""
    out = []
    for b in page:
        out.append(int(MAIN in b.text))
        b.text = b.text.replace(MAIN, "") or "-"
    return out


@functools.lru_cache(4)
def trained(pages: int = PAGES, seed: int = SEED) -> Field:
    """A field fitted on generated labelled pages (a bounded number); the same for the same parameters."""
    return fit([(b, labels(b)) for b in map(blocks, labelled_pages(pages, seed))])


def main_text(source: str | None, field: Field) -> str:
    page = blocks(source)
    return " ".join(b.text for b, y in zip(page, field.decode(page), strict=True) if y)


def extract(pages: DataFrame, field: Field, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns to keep as they are, text and n_chars of every row, null, empty and repeated ones included; text is
    empty where nothing is main text. Other columns, whatever their names, don't enter."""
    shared = pages.sparkSession.sparkContext.broadcast(field)  # as large as the vocabulary of the labelled pages
    src = pages.select(*[pages[c] for c in keep], pages[html_col].cast("string").alias("_html"))
    schema = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = [main_text(t, shared.value) for t in batch.column(len(keep)).to_pylist()]
            yield {**{c: batch.column(k) for k, c in enumerate(keep)}, "text": out, "n_chars": [len(t) for t in out]}

    return arrow_map(src, run, f"{schema}, text string, n_chars long")


def op11_html(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"), trained())
