"""Personal data: detectors over the text as it is and over a deobfuscated form of it.

The deobfuscation is a chain of transducers, each of which rewrites the text and composes a map from
every output character to the source characters that it stands for; spans found in the rewritten
text are mapped back.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from slateledger.llm.common import arrow_map, table, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    """From each @: the run of local characters to its left, as far as the last match; linear in the text."""
    last, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", left, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def ips(text: str) -> Iterator[Span]:
    """Dotted chains of numbers, dealt in fours from the left."""
    for m in _DOTTED.finditer(text):
        chain = m.group()
        if chain.count(".") < 3:
            continue
        pos, parts = m.start(), chain.split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", pos, pos + size
            pos += size + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()


def detect(text: str) -> list[Span]:
    """All spans, by kind as listed, then start; code points, end exclusive."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


# Characters drawn like an ASCII one.
_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуӏԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTXYaesijopcxyldqwhABEZHIKMNOPTYXoav", strict=True))
_ALIKE |= dict.fromkeys("‐‑‒–—―−﹣", "-") | dict.fromkeys("․。｡﹒·", ".") | {"﹫": "@", "﹢": "+"}
_ALIKE |= dict.fromkeys("              　", " ")
_ALIKE |= dict.fromkeys("­​‌‍⁠﻿", "")
_ALIKE |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full width
# Digits as words, in the texts' languages.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
_SPELLED |= {"zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
_SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
_SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9", "más": "+"}
_DOT_WORDS, _AT_WORDS = r"dot|point|punto|punkt", r"at|arroba|arobase|chez|ät"

#: Characters beyond the ones that the texts' languages use: only these can be lookalikes.
_ODD = re.compile("[ ­·Ͱ-῿ -⁯−①-⓿⺀-\U0010ffff]")
# No pattern can be entered twice in one run of spaces or characters, so that each is linear in the text.
_BRACKETED_AT = re.compile(rf"[(\[{{<]\s*+(?:{_AT_WORDS}|@)\s*+[)\]}}>]\s*+", re.I)
_BRACKETED_DOT = re.compile(rf"[(\[{{<]\s*+(?:{_DOT_WORDS}|\.)\s*+[)\]}}>]\s*+", re.I)
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(\s++(?:{_AT_WORDS})\s++)|\s?+@\s?+)[A-Za-z0-9-]++(?:\s++(?:{_DOT_WORDS})\s++[A-Za-z0-9-]++)++", re.I)
_BARE_DOT = re.compile(rf"(?<!\s)\s++(?:{_DOT_WORDS})\s++", re.I)
_BARE_AT = re.compile(r"\s?+@\s?+")
# Suffixes of hosts that a bare disguise may end in, with all of two letters; words that prose has before `at`.
_SUFFIX = re.compile(r"(?:com|org|net|edu|gov|mil|info|biz|name|dev|app|mail|[a-z]{2})", re.I)
_BEFORE_AT = frozenset(
    "a am an are arrive arrived at available be begin blog by call center centre check contact down event found front go going good he her here him hosted hosting house i in is it "
    "laugh link live lives located look looked looking looks me meet meeting mirror my not now office on online only open or out page phone point portal posted project reach read see "
    "service she shop sign site sold someone start starts store talk team that the them there they this to today up us visit was we website were who work worked working works write you "
    "nous vous moi lui est sont page site ich wir uns sie ist sind seite nos me es son sitio está".split()
)
_NUMBERS = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:\s++(?:{_DOT_WORDS})\s++[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.I)
_NAMED_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\s++(?:{_AT_WORDS})\s++)([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)", re.I)
_SIGN, _LETTER = re.compile("[0-9._+-]"), re.compile("[A-Za-z]")
_WORDS = "|".join(sorted(_SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"\b(?:{_WORDS})\b(?:[\x20,.-]++(?:(?:{_WORDS})\b|[0-9]++(?![0-9A-Za-z])))*+", re.I)
_WORD = re.compile(rf"(?:{_WORDS})\b|[0-9]+", re.I)
_TOKEN = re.compile(r"\w+")


class Rewritten:
    """A text and, for each of its characters, the source span [start, end) that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, range(len(text)), range(1, len(text) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new text), in order and apart; every new character stands for the whole of it."""
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            start += [*self.start[at:a], *[self.start[a]] * len(new)] if new else self.start[at:a]
            end += [*self.end[at:a], *[self.end[b - 1]] * len(new)] if new else self.end[at:a]
            at = b
        self.text, self.start, self.end = "".join(text), start, end


def _lookalikes(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        c = m.group()
        new = _ALIKE.get(c)
        if new is None and (d := unicodedata.digit(c, None)) is not None:
            new = str(d)
        if new is None and len(plain := unicodedata.normalize("NFKC", c)) == 1 and plain.isascii():
            new = plain
        if new is not None:
            out.append((m.start(), m.end(), new))
    return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs with at least three spelled digits, as digits."""
    out, tokens = [], _TOKEN.findall(text.lower())
    if _SPELLED.keys().isdisjoint(tokens) or not any(a in _SPELLED and (b in _SPELLED or b[0].isdigit()) for a, b in zip(tokens, tokens[1:], strict=False)):
        return out
    for m in _RUN.finditer(text):
        words = [w.lower() for w in _WORD.findall(m.group())]
        if sum(_SPELLED.get(w, "+") != "+" for w in words) >= 3:
            out.append((m.start(), m.end(), "".join(_SPELLED.get(w, w) for w in words)))
    return out


def _brackets(pattern: re.Pattern, new: str) -> Callable[[str], list[tuple[int, int, str]]]:
    """Bracketed words with the spaces about them."""

    def edits(text: str) -> list[tuple[int, int, str]]:
        out, last = [], 0
        for m in pattern.finditer(text):
            a = m.start()
            while a > last and text[a - 1].isspace():
                a -= 1
            last = m.end()
            out.append((a, last, new))
        return out

    return edits


def _bare(text: str) -> list[tuple[int, int, str]]:
    """`name at host dot com` with spaces about the words: only the whole pattern is rewritten, if it ends in a known
    suffix and the name is none of the words that prose has before `at`. `name.x at host.com` is, too, if the name
    has a digit or sign, as names of mailboxes have and words don't."""
    low = text.lower()
    out = []
    if any(w in low for w in _DOT_WORDS.split("|")):
        for m in _BARE.finditer(text):
            a, b = m.span(1) if m.group(1) is not None else _BARE_AT.search(text, m.start(), m.end()).span()
            if m.group(1) is not None and (text[m.start() : a].lower() in _BEFORE_AT or _SUFFIX.fullmatch(m.group().split()[-1]) is None):
                continue
            out.append((a, b, "@"))
            out += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, b, m.end())]
        out += [(d.start(), d.end(), ".") for m in _NUMBERS.finditer(text) for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    for m in _NAMED_AT.finditer(text):
        name, host = text[m.start() : m.start(1)], m.group(2)
        if _SIGN.search(name) and _LETTER.search(name) and _SUFFIX.fullmatch(host.rpartition(".")[2]):
            out.append((*m.span(1), "@"))
    return _apart(out)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In order, the first of those that overlap."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _letter_by_letter(text: str) -> list[tuple[int, int, str]]:
    """`j o h n @ h o s t . c o m`: single characters with a space each about an @, walked from it to both sides."""
    out, last, at = [], 0, text.find(" @ ")
    single = lambda k: 0 <= k < len(text) and text[k] in _LOCAL and (k == 0 or text[k - 1] == " ") and (k + 1 == len(text) or not (text[k + 1] in _LOCAL))
    while at >= 0:
        left, right = at + 1, at + 1
        while left - 2 >= last and text[left - 1] == " " and single(left - 2):
            left -= 2
        while right + 2 < len(text) and text[right + 1] == " " and single(right + 2):
            right += 2
        if at + 1 - left >= 4 and right - at - 1 >= 6 and "." in text[at + 1 : right + 1]:
            out += [(k, k + 1, "") for k in range(left + 1, right, 2)]
            last = right + 1
        at = text.find(" @ ", max(right, at + 1))
    return out


TRANSDUCERS = (_lookalikes, _brackets(_BRACKETED_AT, "@"), _brackets(_BRACKETED_DOT, "."), _letter_by_letter, _bare, _spelled)


def deobfuscate(text: str) -> Rewritten | None:
    """The text through all transducers; None if none of them has anything to rewrite."""
    out = None
    for step in TRANSDUCERS:
        if edits := step(out.text if out else text):
            out = out or Rewritten(text)
            out.replace(edits)
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that deobfuscation adds); no base span of an added one's kind covers all of it."""
    text = text or ""
    base, added = detect(text), []
    if (plain := deobfuscate(text)) is not None:
        own = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}  # of a kind: in order, apart
        for kind, a, b in detect(plain.text):
            a, b = plain.start[a], plain.end[b - 1]
            at = bisect.bisect_right(own[kind], a, key=lambda s: s[0]) - 1
            if at < 0 or own[kind][at][1] < b:
                added.append((kind, a, b))
    return base, added


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, end), in code points.

    A null text counts as empty and has no spans; repeated rows give repeated results; an empty table gives
    an empty result. Disguised forms may be of any length.
    """
    src = texts(docs, id_col, text_col)
    span = "array<struct<kind:string,start:long,end:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        name = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "base": [name(b) for b, _ in found], "added": [name(a) for _, a in found]}

    return arrow_map(src, scan, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, base {span}, added {span}")


def digest(spans: list[dict]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (order[s["kind"]], s["start"])))


def op10_pii(spark, sf_dir):
    """The counts are of all spans, base and added; n_spans is their sum."""
    found = pii_spans(table(spark, sf_dir, "documents"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            base, added = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            every = [b + a for b, a in zip(base, added, strict=True)]
            yield {"doc_id": batch.column(0), **{f"n_{k}": [sum(s["kind"] == k for s in x) for x in every] for k in KINDS}, "base_sha256": [hashlib.sha256(digest(b).encode()).hexdigest() for b in base], "spans": [digest(x) for x in every], "n_added": [len(a) for a in added], "n_spans": [len(x) for x in every]}

    return arrow_map(found, count, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
