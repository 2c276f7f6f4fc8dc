"""Whole page images in arrays: the filters of `pixels`, for images that a task can hold, over lots of pages at once.

Spark deals the pages, one row each; `by_lots` hands them to a function as Arrow rows, a few hundred at a time. An image is
an array (height, width, pages of the lot), so that every step goes along the pages. Sums are taken in the order in which
`pixels` takes them, so that both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slateledger.operators.pixels import gaussian
from slateledger.shipping import ship

#: Pages that are worked on at once.
LOT = 256


def by_lots(df: DataFrame, page: list[str], fn: Callable[[pa.RecordBatch], list], schema: str, lot: int = LOT) -> DataFrame:
    """df, a row a page, as the page columns and those (`schema`) that fn makes of each lot of rows."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, lot):
                part = batch.slice(at, lot)
                cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in fn(part)]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in page], *cols], [*page, *names])

    names = [c.split()[0] for c in schema.split(", ")]
    ship(df.sparkSession)
    return df.mapInArrow(run, f"{kinds}, {schema}")


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch[name].to_numpy(zero_copy_only=False)


def items(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and the row of each."""
    col = batch[name]
    return np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False)), col.flatten().to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------ filters; axis 0 is y, 1 is x


def _cut(v: np.ndarray, axis: int, lo: int, hi: int) -> np.ndarray:
    return v[lo:hi] if axis == 0 else v[:, lo:hi]


def padded(v: np.ndarray, axis: int, r: int, border: str) -> np.ndarray:
    """With r more pixels at both ends of an axis: mirrored about the last (reflect), or the last repeated (replicate)."""
    n = v.shape[axis]
    at = np.arange(-r, n + r)
    at = np.clip(at, 0, n - 1) if border == "replicate" else np.where(at < 0, -at, np.where(at >= n, 2 * (n - 1) - at, at))
    return v.take(at, axis)


def convolved(v: np.ndarray, axis: int, weights: list[float], border: str) -> np.ndarray:
    r, n = len(weights) // 2, v.shape[axis]
    p = padded(v.astype(float), axis, r, border)
    total = _cut(p, axis, r, r + n) * weights[r]
    for k in range(1, r + 1):
        pair = _cut(p, axis, r - k, r - k + n) + _cut(p, axis, r + k, r + k + n)
        pair *= weights[r + k]
        total += pair
    return total


def blurred(v: np.ndarray, size: int, border: str = "reflect") -> np.ndarray:
    w = gaussian(size)
    return convolved(convolved(v, 1, w, border), 0, w, border)


def spread(v: np.ndarray, width: int, height: int) -> np.ndarray:
    """The largest value of a rectangle of odd sides about each pixel: maxima of two, four, eight pixels and so on."""
    for axis, size in ((1, width), (0, height)):
        n, have = v.shape[axis], 1
        p = padded(v, axis, size // 2, "replicate")
        while have < size:
            step = min(have, size - have)
            p = np.maximum(_cut(p, axis, 0, p.shape[axis] - step), _cut(p, axis, step, p.shape[axis]))
            have += step
        v = _cut(p, axis, 0, n)
    return v


def square(v: np.ndarray, largest: bool) -> np.ndarray:
    """Dilation (or erosion) by a 2 by 2 element that lies above and left of the pixel."""
    fn = np.maximum if largest else np.minimum
    for axis in (1, 0):
        n, out = v.shape[axis], v.copy()
        fn(_cut(v, axis, 1, n), _cut(v, axis, 0, n - 1), out=_cut(out, axis, 1, n))
        v = out
    return v


def opened(v: np.ndarray) -> np.ndarray:
    return square(square(v, False), True)


def byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(v), 0, 255).astype(np.int32)


def around(v: np.ndarray) -> np.ndarray:
    """The sum of the four neighbours of each pixel; a missing one is mirrored."""
    total = np.zeros_like(v)
    for axis in (0, 1):
        n = v.shape[axis]
        p = padded(v, axis, 1, "reflect" if n > 1 else "replicate")
        total += _cut(p, axis, 0, n) + _cut(p, axis, 2, n + 2)
    return total


def sharpened(v: np.ndarray) -> np.ndarray:
    return np.clip(5 * v - around(v), 0, 255)


# ------------------------------------------------------------------ local contrast and thresholds


def equalized(v: np.ndarray, limit: float, tiles: int = 8) -> np.ndarray:
    """See pixels.equalized: the histograms of all tiles of all pages by one count."""
    height, width, n = v.shape
    tw, th = -(-width // tiles), -(-height // tiles)
    area, page = tw * th, np.arange(n)
    cut = max(1, int(limit * area / 256))
    big = v
    for axis, size, whole in ((0, height, th * tiles), (1, width, tw * tiles)):
        at = np.arange(whole)
        big = big.take(np.where(at >= size, 2 * (size - 1) - at, at), axis) if whole > size else big
    tile = (np.arange(th * tiles) // th)[:, None] * tiles + (np.arange(tw * tiles) // tw)[None, :]
    hist = np.bincount(((tile[:, :, None] * n + page) * 256 + big).ravel(), minlength=tiles * tiles * n * 256).reshape(-1, 256)
    excess = np.maximum(hist - cut, 0).sum(1, keepdims=True)
    batch, rest, value = excess // 256, excess % 256, np.arange(256)
    steps = np.where(rest > 0, np.minimum(rest, value // np.maximum(256 // np.maximum(rest, 1), 1) + 1), 0)
    lut = byte((np.minimum(hist, cut).cumsum(1) + (value + 1) * batch + steps) * (255.0 / area)).astype(np.uint8).ravel()
    fx, fy = np.arange(width) / float(tw) - 0.5, np.arange(height) / float(th) - 0.5
    x1, y1 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    xa, ya = (fx - x1)[None, :, None], (fy - y1)[:, None, None]
    own = page * 256 + v

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        t = np.clip(yy, 0, tiles - 1)[:, None] * tiles + np.clip(xx, 0, tiles - 1)[None, :]
        return lut.take(own + (t * (n * 256))[:, :, None])

    return byte((at(y1, x1) * (1 - xa) + at(y1, x1 + 1) * xa) * (1 - ya) + (at(y1 + 1, x1) * (1 - xa) + at(y1 + 1, x1 + 1) * xa) * ya)


def otsu(v: np.ndarray) -> np.ndarray:
    """The threshold of each page, see pixels.otsu."""
    n, value = v.shape[2], np.arange(256)
    h = np.bincount((np.arange(n) * 256 + v).ravel(), minlength=n * 256).reshape(n, 256).astype(float)
    w, s = h.cumsum(1), (h * value).cumsum(1)
    all_, total = w[:, -1:], s[:, -1:]
    d, both = total * w - all_ * s, w * (all_ - w)
    between = np.where(h == 0, -2.0, np.where(w < all_, d * d / np.where(both > 0, both, 1.0), -1.0))
    return between.argmax(1)


def locally_black(v: np.ndarray, size: int = 21, less: int = 8) -> np.ndarray:
    return np.where(v > byte(blurred(v, size, "replicate")) - less, 255, 0)


def binary(v: np.ndarray, tiles: int = 8) -> np.ndarray:
    """The black-and-white variant, see pixels.binary."""
    return opened(locally_black(sharpened(equalized(v, 3.0, tiles))))


def ocr_binary(v: np.ndarray, tiles: int = 12) -> np.ndarray:
    """The variant for recognition engines, see pixels.ocr_binary."""
    soft = byte(blurred(equalized(v, 4.0, tiles), 3))
    return square(opened(np.where(soft > otsu(soft), 255, 0)), True)


# ------------------------------------------------------------------ light, paper, quality


def shadowless(v: np.ndarray) -> np.ndarray:
    """v over its background, brought to 220, see pixels.shadowless."""
    height, width, _ = v.shape
    back = blurred(spread(v, max(width // 30, 21) | 1, max(height // 30, 21) | 1), 21)
    return np.floor(np.clip(v / (back + 1e-6) * 220.0, 0.0, 255.0)).astype(np.int32)


def measures(v: np.ndarray) -> list[np.ndarray]:
    """Sharpness, contrast, brightness and noise of each page, see pixels.measures."""
    flat = lambda a: a.reshape(-1, a.shape[2])
    p, soft = flat(v).astype(np.int64), flat(blurred(v, 5))
    lap = flat(around(v)).astype(np.int64) - 4 * p
    n = len(p)
    var = lambda a: (n * (a * a).sum(0) - a.sum(0) ** 2).astype(float) / (n * n)
    return [var(lap), np.sqrt(var(p)), p.sum(0) / n, np.abs(p - soft).sum(0) / n]


def lab(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CIE L*, a*, b*, see pixels.lab."""
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / (255.0 * 0.950456)
    y = (0.212671 * r + 0.715160 * g + 0.072169 * b) / 255.0
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / (255.0 * 1.088754)
    f = lambda t: np.where(t > 0.008856, np.power(t, 1 / 3), 7.787 * t + 16 / 116)
    return np.where(y > 0.008856, 116 * np.power(y, 1 / 3) - 16, 903.3 * y), 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def paper(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> list:
    """Share of paper and its median colour (null where it isn't more than a tenth), see pixels.paper."""
    light, a, b = (c.reshape(-1, c.shape[2]) for c in lab(r, g, b))
    is_paper = (light > 75) & (np.abs(a) < 15) & (np.abs(b) < 25)
    n, page = is_paper.sum(0), np.arange(is_paper.shape[1])
    share = n / len(is_paper)

    def middle(c: np.ndarray) -> pa.Array:
        c = np.sort(np.where(is_paper, c, np.inf), 0)
        return pa.array((c[np.maximum(n - 1, 0) // 2, page] + c[np.minimum(n // 2, len(c) - 1), page]) / 2, mask=~(share > 0.10))

    return [share, middle(a), middle(b)]
