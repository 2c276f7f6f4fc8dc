"""Plain versions of the operators' results, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(n, starts, size):
    gone = [False] * n
    for s in starts:
        gone[s : s + size] = [True] * size
    return gone


def passages(docs, window):
    words = {d: WORD.findall(t or "") for d, t in docs}
    count = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = covered(len(w), [i for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1], window)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def byte_strings(docs, window):
    data = {d: (t or "").encode() for d, t in docs}
    count = Counter(b[i : i + window] for b in data.values() for i in range(len(b) - window + 1))
    out = {}
    for d, b in data.items():
        gone = covered(len(b), [i for i in range(len(b) - window + 1) if count[b[i : i + window]] > 1], window)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


def copies(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    return {d: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=2):
    """prints: {id: fingerprint} -> {id: smallest id reachable}."""
    label = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= most and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def toxic_features(text, fixed, learned, second, reach=4):
    """The vector of a text, word by word and sign by sign; bytes are looked at as Latin-1 characters."""
    import math

    s = (text or "").encode().decode("latin-1")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    words = re.findall("[a-z\x80-\xff]+", low)
    if not words:
        return [0.0] * 19
    n, odd = len(words), []
    for m in re.findall(r"(?<!\S)[A-Za-z]+[0-9@$!|*._#%&-]+[A-Za-z][A-Za-z0-9@$!|*._#%&-]*", s, re.A):
        only = lambda w: "".join(c for c in w if "a" <= c <= "z")
        odd += [only(m.lower().translate(str.maketrans("013457@$!|", "oieastasii"))), only(m.lower())]
    odd += ["".join(c for c in m.lower() if "a" <= c <= "z") for m in re.findall(r"(?<![A-Za-z])(?:[A-Za-z][ .*_-]){3,}[A-Za-z](?![A-Za-z])", s)]
    hits = [k for k, w in enumerate(words) if w in fixed]
    seconds = [k for k, w in enumerate(words) if w in second]
    near = sum(any(abs(k - j) <= reach for j in seconds) for k in hits)
    weights = [learned[w] for w in words if w in learned]
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    single = lambda w: "".join(c for i, c in enumerate(w) if not (i and c == w[i - 1]))
    odd_hits = sum(w in fixed or single(w) in fixed or w in learned for w in odd)
    return [
        1000 * len(hits) / n, math.log(1 + len(hits)), len({words[k] for k in hits}), 1000 * len(weights) / n, 100 * sum(weights) / n, max(weights, default=0), near / max(1, len(hits)), 1000 * len(seconds) / n,
        upper / max(1, upper + lower), len(re.findall(r"\b[A-Z]{3,}\b", s, re.A)) / n, s.count("!") / n, s.count("?") / n, (s.count(".") + s.count(",")) / n, sum(c.isascii() and c.isdigit() for c in s) / len(s),
        sum(c in "@#$%^&*_~|\\<>" for c in s) / n, len(odd) / n, odd_hits, sum(a == b for a, b in zip(words, words[1:])) / n, math.log(1 + n),
    ]
