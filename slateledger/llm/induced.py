"""Suffix and common-prefix arrays of a shard by external induced sorting.

Suffixes that are smaller than their successor after a larger one (LMS) are sorted by the names of the
pieces between them; the order of all others is induced from them in two scans, upwards for the suffixes
larger than their successor (L), downwards for the others (S). A scan takes suffix tuples (position,
common prefix with the tuple before) from a monotone priority queue keyed by first character and
arrival, and puts their predecessors into it; common prefixes go along, one more than the least since
the last put under that character. The queue and the rank tables move to disk beyond a bound.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queue kept in memory; what comes on top of it is on disk.
IN_MEMORY = 16 << 20
#: Names up to this many are sorted by induction again; beyond that there are too few suffixes to a name.
MOST_BUCKETS = 600
#: Tuples taken from the queue at once.
TAKE = 1 << 20
_SYMBOLS = 6


class Spool:
    """Arrays put aside; in memory up to a bound, then in one temporary file, which goes with the object."""

    def __init__(self, limit: int | None = None):
        self.limit, self.held, self.file = IN_MEMORY if limit is None else limit, 0, None

    def put(self, *arrays: np.ndarray) -> tuple:
        size = sum(a.nbytes for a in arrays)
        if self.held + size <= self.limit:
            self.held += size
            return arrays
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        return (at, [(a.dtype, len(a)) for a in arrays])

    def get(self, token: tuple) -> tuple:
        if isinstance(token[0], np.ndarray):
            return token
        self.file.seek(token[0])
        return tuple(np.frombuffer(self.file.read(d.itemsize * n), d) for d, n in token[1])


class Queue:
    """A monotone priority queue of suffix tuples: by first character, then arrival."""

    def __init__(self, alphabet: int, spool: Spool, cap: int):
        self.blocks: list[list[tuple]] = [[] for _ in range(alphabet)]
        self.spool, self.cap = spool, cap
        self.since = np.zeros(alphabet, np.uint16)  # least common prefix since the last put; 0: none yet

    def rest(self, least: int) -> None:
        np.minimum(self.since, least, out=self.since)

    def induce(self, t: np.ndarray, pos: np.ndarray, lcp: np.ndarray, wanted: np.ndarray) -> None:
        """Put the predecessors of the wanted tuples; lcp is with the tuple scanned before."""
        if not len(pos):
            return
        head = np.minimum.accumulate(lcp)
        at = np.flatnonzero(wanted)
        least, fresh = head[-1], np.zeros(0, np.int64)
        if len(at):
            pred = pos[at] - 1
            char = t[pred]
            order = np.argsort(char, kind="stable")
            char = char[order]
            start = np.flatnonzero(np.r_[True, char[1:] != char[:-1]])
            tail = np.minimum.accumulate(lcp[::-1])[::-1]
            fresh = char[start]
            for c, a, b in zip(fresh.tolist(), start.tolist(), [*start[1:].tolist(), len(char)], strict=True):
                own = order[a:b]
                e = at[own]
                new = np.empty(b - a, np.uint16)
                new[0] = min(self.since[c], head[e[0]])
                if b - a > 1:
                    new[1:] = np.minimum.reduceat(lcp, e + 1 if e[-1] + 1 < len(lcp) else e[:-1] + 1)[: b - a - 1]
                if self.blocks[c]:
                    new = np.minimum(new + 1, self.cap).astype(np.uint16)
                else:
                    new[1:] = np.minimum(new[1:] + 1, self.cap)
                    new[0] = 0
                self.blocks[c].append(self.spool.put(pred[own], new))
            last = at[order[np.r_[start[1:], len(char)] - 1]]
            after = np.where(last + 1 < len(lcp), tail[np.minimum(last + 1, len(lcp) - 1)], self.cap)
        self.since = np.minimum(self.since, least)
        if len(fresh):
            self.since[fresh] = after

    def taken(self, c: int, done: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The tuples under c from block `done` on, as one batch of bounded length at least a block."""
        out, n = [], 0
        while done < len(self.blocks[c]) and (n < TAKE or not out):
            out.append(self.spool.get(self.blocks[c][done]))
            n += len(out[-1][0])
            done += 1
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])), done


def direct(t: np.ndarray, a: np.ndarray, b: np.ndarray, have: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b that share `have` characters already, up to cap."""
    out, at = np.minimum(have, cap).astype(np.int64), np.arange(len(a))
    while len(at):
        i, j = a[at] + out[at], b[at] + out[at]
        ok = (out[at] < cap) & (np.maximum(i, j) < len(t))
        at, i, j = at[ok], i[ok], j[ok]
        at = at[t[i] == t[j]]
        out[at] += 1
    return out.astype(np.uint16)


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last is, by its unique smallest character."""
    n = len(t)
    step = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(nxt, n - 2)] > 0
    return out


def names(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the pieces from each LMS position to the next, characters and types, refined word by word."""
    length = np.diff(np.r_[lms, np.int32(len(t) - 1)]) + 1
    bits = max(2, int(t.max()).bit_length() + 1)
    per = max(1, 62 // bits)
    rank, active, w = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        base, left = lms[active] + w * per, length[active] - w * per
        for k in range(per):
            p = np.minimum(base + k, len(t) - 1)
            word = (word << bits) | np.where(left > k, (t[p].astype(np.int64) << 1) + small[p], 0)
        order = np.lexsort((word, rank[active])) if w else np.argsort(word)
        r, v = rank[active][order], word[order]
        group = np.r_[True, r[1:] != r[:-1]]
        sub = np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])]
        i = np.arange(len(r))
        first = np.maximum.accumulate(np.where(group, i, 0))
        rank[active[order]] = r + np.maximum.accumulate(np.where(sub, i, 0)) - first
        w += 1
        active = active[length[active] > w * per]
    distinct, dense = np.unique(rank, return_inverse=True)
    return dense, len(distinct)


def doubling(x: np.ndarray, spool: Spool) -> tuple[np.ndarray, list[tuple[int, tuple]]]:
    """Order of the suffixes of a string of names, and the rank tables (length, ranks) on the way."""
    n = len(x)
    rank, h, tables = x.astype(np.int64), 1, [(1, spool.put(x.astype(np.int32)))]
    while True:
        top = int(rank.max()) + 2
        times, key = 1, rank + 1
        while top ** (times + 1) < 1 << 62 and times < 4:
            shifted = np.zeros(n, np.int64)
            if times * h < n:
                shifted[: n - times * h] = rank[times * h :] + 1
            key, times = key * top + shifted, times + 1
        order = np.argsort(key)
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]])
        h, rank = h * times, new
        tables.append((h, spool.put(rank.astype(np.int32))))
        if int(rank.max()) == n - 1:
            return order, tables


def sorted_lms(t: np.ndarray, lms: np.ndarray, x: np.ndarray, distinct: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS positions in suffix order and their common prefixes with the one before."""
    spool = Spool()
    if distinct == len(x):
        order = np.argsort(x, kind="stable")
        same = np.zeros(len(x), np.int64)
    elif distinct <= MOST_BUCKETS:
        order, got = suffix_array((x + 1).astype(np.uint16), cap, sentinel=True)
        same = got.astype(np.int64)
    else:
        order, tables = doubling(x, spool)
        a, b, same = order[:-1].copy(), order[1:].copy(), np.zeros(len(x), np.int64)
        for h, token in reversed(tables):
            rank = spool.get(token)[0]
            live = np.arange(len(a))
            while len(live):
                live = live[np.maximum(a[live], b[live]) < len(x)]
                live = live[rank[a[live]] == rank[b[live]]]
                a[live] += h
                b[live] += h
                same[live + 1] += h
    p, far = lms[order], np.r_[lms, len(t) - 1]
    have = far[np.minimum(order + same, len(lms))] - p
    lcp = np.zeros(len(p), np.uint16)
    lcp[1:] = direct(t, p[:-1], p[1:], have[1:], cap)
    return p, lcp


def buckets(t: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes in order, bucket by bucket from the largest character down: (positions, common prefix
    with the suffix before). t ends in a unique smallest character 0; prefixes count up to cap."""
    alphabet, spool = int(t.max()) + 1, Spool()
    small = types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    x, distinct = names(t, small, lms)
    p, lcp = sorted_lms(t, lms, x, distinct, cap)
    bounds = np.searchsorted(t[p], np.arange(alphabet + 1))
    large, one = Queue(alphabet, spool, cap), lambda a, b: direct(t, np.array([a]), np.array([b]), np.array([1]), cap)[0]
    ends: list[int] = []
    for c in range(alphabet):
        large.rest(0)
        done, last = 0, -1
        while done < len(large.blocks[c]):
            (pos, own), done = large.taken(c, done)
            large.induce(t, pos, own, (pos > 0) & (t[np.maximum(pos, 1) - 1] >= c))
            last = int(pos[-1])
        ends.append(last)
        a, b = bounds[c], bounds[c + 1]
        if b > a:
            own = lcp[a:b].copy()
            own[0] = one(last, p[a]) if last >= 0 else 0
            large.induce(t, p[a:b], own, np.ones(b - a, bool))
    less = Queue(alphabet, spool, cap)
    less.blocks[0].append((np.array([len(t) - 1], np.int32), np.zeros(1, np.uint16)))
    for c in range(alphabet - 1, -1, -1):
        less.rest(0)
        done, first, s = 0, -1, []
        while done < len(less.blocks[c]):
            (pos, own), done = less.taken(c, done)
            less.induce(t, pos, own, (pos > 0) & (t[np.maximum(pos, 1) - 1] <= c))
            s.append((pos, own))
            first = int(pos[-1])
        border = one(ends[c], first) if first >= 0 and ends[c] >= 0 else np.uint16(0)
        lpos, llcp = [], []
        for token in large.blocks[c]:
            pos, own = spool.get(token)
            lpos.append(pos)
            llcp.append(own)
        if lpos:
            pos, own = np.concatenate(lpos), np.concatenate(llcp)
            down = np.r_[own[1:], border][::-1]
            less.induce(t, pos[::-1], down, ((pos > 0) & (t[np.maximum(pos, 1) - 1] < c))[::-1])
            lpos, llcp = [pos], [own]
        if s:  # downwards, each with its common prefix with the larger one; upwards it is the smaller one's
            pos, own = np.concatenate([a for a, _ in s])[::-1], np.concatenate([b for _, b in s])[::-1]
            lpos.append(pos)
            llcp.append(np.r_[border, own[:-1]].astype(np.uint16))
        if lpos:
            yield np.concatenate(lpos), np.concatenate(llcp)


def suffix_array(t: np.ndarray, cap: int, sentinel: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of t in order and their common prefixes (up to cap) with the one before.

    With sentinel, a smallest character is added for the sort and left out of the result.
    """
    if sentinel:
        t = np.r_[t, np.zeros(1, t.dtype)]
    if len(t) < 2:
        return np.arange(len(t) - sentinel), np.zeros(len(t) - sentinel, np.uint16)
    got = list(buckets(t, cap))[::-1]
    pos, lcp = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    if sentinel:
        pos, lcp = pos[1:], lcp[1:]
    return pos, lcp
