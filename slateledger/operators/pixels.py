"""Grey and coloured page images as rows of pixels: filters, local contrast, thresholds, shadows, paper, quality.

An image is a table of page columns, y, x and v (0 to 255), all pixels of a page present. Filters go along rows, then
along columns, as windows; `by_page` deals pages once, and every window of a page's rows or columns is within that.
Constants are the reference's; what differs is stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateledger.functions import scalars as S

#: Fixed small kernels of the usual Gaussian filter; larger ones follow its formula for the deviation.
GAUSS = {3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}


def gaussian(size: int) -> list[float]:
    """Weights of a Gaussian of odd size that sum to one."""
    if size in GAUSS:
        return GAUSS[size]
    sigma, r = 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size // 2
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def by_page(px: DataFrame, page: list[str]) -> DataFrame:
    return px.repartition(*page)


def line(page: list[str], axis: str):
    """The window of an image's row (axis x) or column (axis y)."""
    return Window.partitionBy(*page, "y" if axis == "x" else "x").orderBy(axis)


def padded(px: DataFrame, axis: str, n: int, r: int, border: str) -> DataFrame:
    """With r more pixels at both ends: the nearest ones mirrored about the last (reflect), or the last repeated
    (replicate). r must be below n to mirror."""
    c = F.col(axis)
    none = F.array().cast("array<int>")
    if border == "reflect":
        more = [F.when((c >= 1) & (c <= r), F.array(-c)).otherwise(none), F.when((c >= n - 1 - r) & (c <= n - 2), F.array(2 * (n - 1) - c)).otherwise(none)]
    else:
        more = [F.when(c == 0, F.sequence(F.lit(-r), F.lit(-1))).otherwise(none), F.when(c == n - 1, F.sequence(F.lit(n), F.lit(n + r - 1))).otherwise(none)]
    return px.withColumn(axis, F.explode(F.concat(F.array(c), *more)))


def convolved(px: DataFrame, page: list[str], axis: str, n: int, weights: list[float], border: str = "reflect", v: str = "v", out: str = "v") -> DataFrame:
    """v weighed along one axis of n pixels by an odd, symmetric kernel, as a double."""
    r, w = len(weights) // 2, line(page, axis)
    total = F.col(v) * weights[r]
    for k in range(1, r + 1):
        total = total + (F.lag(v, k).over(w) + F.lead(v, k).over(w)) * weights[r + k]
    return padded(px, axis, n, r, border).withColumn(out, total).where((F.col(axis) >= 0) & (F.col(axis) < n))


def blurred(px: DataFrame, page: list[str], width: int, height: int, size: int, border: str = "reflect", v: str = "v", out: str = "v") -> DataFrame:
    """v under a Gaussian of size by size, not rounded."""
    w, own = gaussian(size), v
    if out != v:
        px, own = px.withColumn(out, F.col(v)), out
    return convolved(convolved(px, page, "x", width, w, border, own, out), page, "y", height, w, border, out, out)


def spread(px: DataFrame, page: list[str], width: int, height: int, largest: bool = True, v: str = "v", out: str = "v") -> DataFrame:
    """The largest (or smallest) v of a rectangle of odd sides about each pixel, within the image."""
    fn = F.max if largest else F.min
    for axis, size, src in (("x", width, v), ("y", height, out)):
        px = px.withColumn(out, fn(src).over(line(page, axis).rowsBetween(-(size // 2), size // 2)))
    return px


def square(px: DataFrame, page: list[str], largest: bool) -> DataFrame:
    """Dilation (or erosion) by a 2 by 2 element that lies above and left of the pixel."""
    fn = F.max if largest else F.min
    for axis in ("x", "y"):
        px = px.withColumn("v", fn("v").over(line(page, axis).rowsBetween(-1, 0)))
    return px


def opened(px: DataFrame, page: list[str]) -> DataFrame:
    """Erosion, then dilation, by the same 2 by 2 element, so that what is left moves on by one pixel."""
    return square(square(px, page, False), page, True)


def byte(v: Column) -> Column:
    """Rounded (halves to even) and held between 0 and 255."""
    return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")


# ------------------------------------------------------------------ local contrast


def equalized(px: DataFrame, page: list[str], width: int, height: int, limit: float, tiles: int = 8) -> DataFrame:
    """Contrast-limited local equalization. Each of tiles by tiles tiles has a histogram, cut at limit times its mean;
    what is cut off is dealt evenly over all values, the rest of that at equal steps. A pixel's value is mapped by
    the cumulated histograms of the four nearest tiles, mixed by distance. Images that the tiles don't divide are
    mirrored at the right and lower edge for the histograms.

    Only the values that a page has are mapped: a page has as many rows of mappings as distinct values.
    """
    tw, th = -(-width // tiles), -(-height // tiles)
    area = tw * th
    cut = max(1, int(limit * area / 256))
    src = px
    for axis, n, whole in (("x", width, tw * tiles), ("y", height, th * tiles)):
        if whole > n:
            c = F.col(axis)
            src = src.withColumn(axis, F.explode(F.concat(F.array(c), F.when((c >= 2 * (n - 1) - (whole - 1)) & (c <= n - 2), F.array(2 * (n - 1) - c)).otherwise(F.array().cast("array<int>")))))
    tile = (F.floor(F.col("y") / th) * tiles + F.floor(F.col("x") / tw)).cast("int")
    counts = src.groupBy(*page, tile.alias("tile"), "v").agg(F.count("*").alias("h"))
    excess = counts.groupBy(*page, "tile").agg(F.sum(F.greatest(F.col("h") - cut, F.lit(0))).alias("_x"))
    values = counts.select(*page, "v").distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles * tiles - 1))))
    rows = values.join(counts, [*page, "tile", "v"], "left").join(excess, [*page, "tile"])
    below = F.sum(F.least(F.coalesce("h", F.lit(0)), F.lit(cut))).over(Window.partitionBy(*page, "tile").orderBy("v"))
    batch = F.floor(F.col("_x") / 256)
    rest = F.col("_x") - batch * 256
    steps = F.when(rest > 0, F.least(rest, F.floor(F.col("v") / F.greatest(F.floor(F.lit(256) / rest), F.lit(1))) + 1)).otherwise(0)
    mapped = byte((below + (F.col("v") + 1) * batch + steps) * (255.0 / area))
    luts = rows.select(*page, "tile", "v", mapped.alias("m")).groupBy(*page, "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "m"))), lambda s: s["m"]).alias("_l"))
    fx, fy = F.col("x") / F.lit(float(tw)) - 0.5, F.col("y") / F.lit(float(th)) - 0.5
    x1, y1 = F.floor(fx), F.floor(fy)
    top, last = F.lit(0), F.lit(tiles - 1)
    at = lambda yy, xx: F.element_at("_l", (F.least(F.greatest(yy, top), last) * tiles + F.least(F.greatest(xx, top), last) + 1).cast("int"))
    xa, ya = fx - x1, fy - y1
    mix = (at(y1, x1) * (1 - xa) + at(y1, x1 + 1) * xa) * (1 - ya) + (at(y1 + 1, x1) * (1 - xa) + at(y1 + 1, x1 + 1) * xa) * ya
    return px.join(luts, [*page, "v"]).select(*page, "y", "x", byte(mix).alias("v"))


# ------------------------------------------------------------------ thresholds


def locally_black(px: DataFrame, page: list[str], width: int, height: int, size: int = 21, less: int = 8) -> DataFrame:
    """255 where v is above the Gaussian mean of its surroundings minus `less`, else 0; edges are repeated."""
    mean = blurred(px, page, width, height, size, "replicate", "v", "_mean")
    return mean.withColumn("v", F.when(F.col("v") > byte(F.col("_mean")) - less, 255).otherwise(0)).drop("_mean")


def otsu(px: DataFrame, page: list[str]) -> DataFrame:
    """(page, threshold): the value that parts each page's histogram with the largest variance between the classes,
    the first of equals; a page of one value has that."""
    counts = px.groupBy(*page, "v").agg(F.count("*").cast("double").alias("h"))
    w, all_ = Window.partitionBy(*page).orderBy("v"), Window.partitionBy(*page)
    c = counts.withColumn("_w", F.sum("h").over(w)).withColumn("_s", F.sum(F.col("h") * F.col("v")).over(w)).withColumn("_n", F.sum("h").over(all_)).withColumn("_t", F.sum(F.col("h") * F.col("v")).over(all_))
    d = F.col("_t") * F.col("_w") - F.col("_n") * F.col("_s")
    between = F.when(F.col("_w") < F.col("_n"), d * d / (F.col("_w") * (F.col("_n") - F.col("_w")))).otherwise(-1.0)
    return c.groupBy(*page).agg(F.max_by("v", F.struct(between, -F.col("v"))).alias("threshold"))


def parted(px: DataFrame, page: list[str]) -> DataFrame:
    """255 above the page's threshold, else 0."""
    return px.join(otsu(px, page), page).withColumn("v", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


def sharpened(px: DataFrame, page: list[str]) -> DataFrame:
    """Five times v less its four neighbours; edges are mirrored."""
    return around(px, page).withColumn("v", F.least(F.greatest(5 * F.col("v") - F.col("_around"), F.lit(0)), F.lit(255)).cast("int")).drop("_around")


def around(px: DataFrame, page: list[str]) -> DataFrame:
    """With _around, the sum of the four neighbours of each pixel; a missing one is mirrored."""
    total = F.lit(0)
    for k, axis in enumerate(("x", "y")):
        w = line(page, axis)
        a, b = F.lag("v").over(w), F.lead("v").over(w)
        px = px.withColumn(f"_a{k}", F.coalesce(a, b) + F.coalesce(b, a))
        total = total + F.coalesce(F.col(f"_a{k}"), 2 * F.col("v"))
    return px.withColumn("_around", total).drop("_a0", "_a1")


def binary(px: DataFrame, page: list[str], width: int, height: int, tiles: int = 8) -> DataFrame:
    """The black-and-white variant: local contrast (3), sharpening, local threshold, opening. Denoising by non-local
    means, which the reference puts after the first step, is left out."""
    return opened(locally_black(sharpened(equalized(by_page(px, page), page, width, height, 3.0, tiles), page), page, width, height), page)


def ocr_binary(px: DataFrame, page: list[str], width: int, height: int, tiles: int = 12) -> DataFrame:
    """The variant for recognition engines: local contrast (4), a slight blur, one threshold a page, opening, dilation."""
    soft = blurred(equalized(by_page(px, page), page, width, height, 4.0, tiles), page, width, height, 3)
    return square(opened(parted(soft.withColumn("v", byte(F.col("v"))), page), page), page, True)


# ------------------------------------------------------------------ light and paper


def shadowless(px: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """v over its background, brought to 220: the background is the largest value of a rectangle of a thirtieth of the
    sides (21 pixels at least, odd) about each pixel, smoothed by a Gaussian of 21 pixels."""
    kw, kh = max(width // 30, 21) | 1, max(height // 30, 21) | 1
    bg = blurred(spread(by_page(px, page), page, kw, kh, True, "v", "_bg"), page, width, height, 21, "reflect", "_bg", "_bg")
    return bg.withColumn("v", F.floor(F.least(F.greatest(F.col("v") / (F.col("_bg") + 1e-6) * 220.0, F.lit(0.0)), F.lit(255.0))).cast("int")).drop("_bg")


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of linear light from 0 to 255 (white point D65)."""
    x = (0.412453 * r + 0.357580 * g + 0.180423 * b) / (255.0 * 0.950456)
    y = (0.212671 * r + 0.715160 * g + 0.072169 * b) / 255.0
    z = (0.019334 * r + 0.119193 * g + 0.950227 * b) / (255.0 * 1.088754)
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return light, 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def paper(px: DataFrame, page: list[str]) -> DataFrame:
    """(page, share, a_cast, b_cast) of coloured pixels (r, g, b): the share of bright pixels of little colour, and their
    median colour; the cast is null where they aren't more than a tenth of the page. Medians are exact."""
    light, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    seen = px.select(*page, light.alias("_l"), a.alias("_a"), b.alias("_b"))
    is_paper = (F.col("_l") > 75) & (F.abs("_a") < 15) & (F.abs("_b") < 25)
    mid = lambda c: F.median(F.when(is_paper, F.col(c)))
    got = seen.groupBy(*page).agg((F.count_if(is_paper) / F.count("*")).alias("share"), mid("_a").alias("_ma"), mid("_b").alias("_mb"))
    enough = F.col("share") > 0.10
    return got.select(*page, "share", F.when(enough, F.col("_ma")).alias("a_cast"), F.when(enough, F.col("_mb")).alias("b_cast"))


def whitened(px: DataFrame, page: list[str]) -> DataFrame:
    """Coloured pixels as light, a, b with four fifths of the paper's cast taken off all of them (held within 127); pages
    with too little paper stay as they are."""
    light, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    less = lambda c, cast: F.least(F.greatest(c - F.coalesce(F.col(cast), F.lit(0.0)) * 0.8, F.lit(-127.0)), F.lit(127.0))
    return px.join(paper(px, page), page).select(*page, "y", "x", light.alias("light"), less(a, "a_cast").alias("a"), less(b, "b_cast").alias("b"))


# ------------------------------------------------------------------ quality


def measures(px: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """(page, sharpness, contrast, brightness, noise, quality): the variance of the Laplacian, the deviation and mean of
    v, the mean distance from v smoothed by five pixels, and the weighted score of them."""
    own = around(by_page(px, page), page).withColumn("_lap", (F.col("_around") - 4 * F.col("v")).cast("long")).withColumn("_v", F.col("v").cast("long"))
    own = blurred(own, page, width, height, 5, "reflect", "v", "_soft")
    n = F.count("*")
    var = lambda c: (n * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)).cast("double") / (n * n)  # noqa: E731 (whole numbers: the same in any order)
    raw = own.groupBy(*page).agg(var("_lap").alias("sharpness"), F.sqrt(var("_v")).alias("contrast"), F.avg("v").alias("brightness"), F.avg(F.abs(F.col("v") - F.col("_soft"))).alias("noise"))
    return raw.withColumn("quality", S.quality_score(*[F.col(c) for c in ("sharpness", "contrast", "brightness", "noise")]))
