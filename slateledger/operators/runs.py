"""What `raster` does, over lots of pages at once (see `pages`): runs as flat arrays, or pages as bitmaps (page, y, x).

Runs are arrays at (the page's place in the lot), y, x0, x1. Results are those of `raster`.
"""

from __future__ import annotations

import math

import numpy as np

from slateledger.operators.raster import LEAST_AREA, LINE_PIXELS, LINE_SHARE, MAX_ANGLE, TOLERANCE, TOP, _labels

Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def in_order(at: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Runs:
    o = np.lexsort((x1, x0, y, at))
    return at[o], y[o], x0[o], x1[o]


# ------------------------------------------------------------------ tilt


def _round(v: np.ndarray) -> np.ndarray:
    """To whole numbers, halves away from zero."""
    return np.trunc(v + np.copysign(np.nextafter(0.5, 0), v)).astype(np.int64)


def _votes(runs: Runs, n: int, width: int, slope: np.ndarray, cell: float, lo: int, size: int) -> np.ndarray:
    """(page, height): the pixels of the runs on the line of their page's slope through each height."""
    at, y, x0, x1 = runs
    rho = _round((y - ((x0 + x1) / 2 - width / 2) * slope[at]) / cell)
    return np.bincount(at * size + rho - lo, x1 - x0 + 1, n * size).reshape(n, size)


def line_angles(runs: Runs, n: int, width: int, step: float = 0.1, apart: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The pages and angles of the near-level lines of n pages, see raster.text_lines."""
    if not len(runs[0]):
        return np.zeros(0, int), np.zeros(0)
    reach = math.ceil(width / 2 * math.tan(math.radians(MAX_ANGLE + 1))) + 2
    low, high = int(runs[1].min()) - reach, int(runs[1].max()) + reach
    whole = sorted(range(-int(MAX_ANGLE), int(MAX_ANGLE) + 1), key=lambda a: (abs(a), -a))  # of equals the first
    full = [(_votes(runs, n, width, np.full(n, math.tan(math.radians(a))), 8.0, low // 8 - 1, (high - low) // 8 + 4) ** 2).sum(1) for a in whole]
    about = np.array(whole)[np.argmax(full, axis=0)]
    size = high - low + 1
    votes, flat, angle = np.zeros((n, size)), np.full((n, size), np.inf), np.zeros((n, size))
    for k in range(-round(1 / step), round(1 / step) + 1):
        a = np.round(about + k * step, 6)
        got = _votes(runs, n, width, np.tan(np.radians(a)), 1.0, low, size)
        own = np.broadcast_to(a[:, None], got.shape)
        better = (got > 0) & (np.abs(own) <= MAX_ANGLE) & ((got > votes) | ((got == votes) & ((np.abs(own) < flat) | ((np.abs(own) == flat) & (own > angle)))))
        votes[better], flat[better], angle[better] = got[better], np.abs(own)[better], own[better]
    rank = np.where(votes > 0, votes * 1e8 - np.round(np.where(votes > 0, flat, 0) * 1e6), -np.inf)
    best = votes >= max(width // LINE_SHARE, LINE_PIXELS)
    for d in range(1, min(apart, size - 1) + 1):
        best[:, d:] &= rank[:, d:] > rank[:, :-d]  # of equals the upper line
        best[:, :-d] &= rank[:, :-d] >= rank[:, d:]
    page, rho = np.nonzero(best)
    return page, angle[page, rho]


# ------------------------------------------------------------------ components and outlines


def components(runs: Runs) -> np.ndarray:
    """The number of the first run of each run's component; runs in order, those of a row without overlap."""
    at, y, x0, x1 = runs
    wide = int(x1.max(initial=0)) + 3
    row = (at * (int(y.max(initial=0)) + 2) + y) * wide
    lo = np.searchsorted(row + x1, row + wide + x0 - 1, "left")  # of the next row, from the first that ends late enough
    hi = np.searchsorted(row + x0, row + wide + x1 + 1, "right")  # to the last that begins early enough
    hi = np.minimum(hi, np.searchsorted(row, row + wide, "right"))
    n = np.maximum(hi - np.maximum(lo, np.searchsorted(row, row + wide, "left")), 0)
    lo = np.maximum(lo, np.searchsorted(row, row + wide, "left"))
    above = np.repeat(np.arange(len(at)), n)
    below = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(lo, n)
    return _labels(above, below, len(at))


def areas(runs: Runs, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first run of each component, and its pixels."""
    size = np.bincount(label, runs[3] - runs[2] + 1, len(label))
    return (first := np.flatnonzero(size)), size[first]


def simplified(x: np.ndarray, y: np.ndarray, tolerance: float = TOLERANCE, most: int = 6) -> list[tuple[float, float]] | None:
    """An outline's corners, see raster.simplified; none where they are more than `most`."""
    first = int(np.argmax(np.hypot(x - x[0], y - y[0])))
    x, y = np.roll(x, -first), np.roll(y, -first)
    n, second = len(x), int(np.argmax(np.hypot(x - x[0], y - y[0])))
    x, y = np.append(x, x[0]), np.append(y, y[0])
    least = tolerance * np.hypot(np.diff(x), np.diff(y)).sum()
    todo, corners = [(second, n), (0, second)], []
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        size = np.hypot(dx, dy)
        off = np.abs(dx * (y[i] - y[i:j]) - (x[i] - x[i:j]) * dy) / size if size > 0 else np.hypot(x[i:j] - x[i], y[i:j] - y[i])
        k = int(np.argmax(off))
        if off[k] > least:
            todo += [(i + k, j), (i, i + k)]
        else:
            corners.append((float(x[i]), float(y[i])))
        if len(corners) + len(todo) > most + 2 and len(corners) > most:
            return None
    return corners if len(corners) <= most else None


def outlines(runs: Runs, n: int, width: int, height: int) -> list[list[list[dict]]]:
    """For each of n pages the corners of its largest components, in their order, see raster.largest and outline."""
    at, y, x0, x1 = runs
    label = components(runs)
    first, size = areas(runs, label)
    out = [[] for _ in range(n)]
    taken = np.zeros(n, int)
    for c in np.lexsort((first, -size, at[first])):
        p = at[first[c]]
        taken[p] += 1
        if taken[p] > TOP or size[c] < width * height * LEAST_AREA:
            continue
        own = slice(np.searchsorted(at, p), np.searchsorted(at, p, "right"))
        mine = np.flatnonzero(label[own] == first[c]) + own.start
        rows, start = np.unique(y[mine], return_index=True)
        left, right = np.minimum.reduceat(x0[mine], start), np.maximum.reduceat(x1[mine], start)
        got = simplified(np.concatenate((right, left[::-1])).astype(float), np.concatenate((rows, rows[::-1])).astype(float))
        if got is not None:
            out[p].append([{"x": a, "y": b} for a, b in got])
    return out


# ------------------------------------------------------------------ ruled lines


def along(v: np.ndarray, axis: int, length: int) -> np.ndarray:
    """Opening of bitmaps by a straight element: the pixels of stretches of at least `length`."""
    cut = lambda a, lo, hi: a[:, lo:hi] if axis == 1 else a[:, :, lo:hi]
    n = v.shape[axis]
    out = np.zeros_like(v)
    if length > n:
        return out
    have, low = 1, v
    while have < length:  # whether a stretch begins here
        step, m = min(have, length - have), low.shape[axis]
        low = cut(low, 0, m - step) & cut(low, step, m)
        have += step
    cut(out, 0, low.shape[axis])[...] = low
    have = 1
    while have < length:
        step = min(have, length - have)
        cut(out, step, n)[...] |= cut(out, 0, n - step).copy()
        have += step
    return out


def table_pixels(v: np.ndarray) -> list[np.ndarray]:
    """Pixels of level rules, of upright ones, of the mask of both (widened to the right and below), and of what it leaves,
    see raster.table_lines and grid_mask."""
    height, width = v.shape[1:]
    n, m = max(width // 12, 50), max(height // 12, 50)
    level, upright = along(v, 2, 2 * n - 1), along(v, 1, 2 * m - 1)
    mask = level | upright
    mask[:, :, 1:] |= mask[:, :, :-1].copy()
    mask[:, 1:] |= mask[:, :-1].copy()
    return [np.count_nonzero(a, (1, 2)) for a in (level, upright, mask, v & ~mask)]


# ------------------------------------------------------------------ turned pages


def turned(runs: Runs) -> Runs:
    """The same pixels by columns, in order."""
    at, y, x0, x1 = runs
    n = x1 - x0 + 1
    wide, high = int(x1.max(initial=0)) + 1, int(y.max(initial=0)) + 2
    x = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(x0, n)
    dots = np.unique((np.repeat(at, n) * wide + x) * high + np.repeat(y, n))
    new = np.flatnonzero(np.diff(dots, prepend=-2) != 1)
    end = dots[np.append(new[1:], len(dots)) - 1] if len(new) else dots
    first = dots[new]
    return first // (wide * high), first // high % wide, first % high, end % high


def level_lines(runs: Runs, n: int, width: np.ndarray, share: int = 8, gap: int = 20) -> np.ndarray:
    """How many level stretches each of n pages has, see raster.level_lines."""
    at, y, x0, x1 = runs
    if not len(at):
        return np.zeros(n, int)
    wide = int(x1.max()) + gap + 3
    row = (at * (int(y.max()) + 1) + y) * wide
    reach = np.maximum.accumulate(row + x1)
    new = np.append(True, (row[1:] != row[:-1]) | (row[1:] + x0[1:] > reach[:-1] + gap + 1))
    first = np.flatnonzero(new)
    size = np.maximum.reduceat(x1, first) - np.minimum.reduceat(x0, first) + 1
    return np.bincount(at[first], size >= width[at[first]] / share, n).astype(int)
