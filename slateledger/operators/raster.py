"""Page images as rows of runs: tilt of text lines, outlines of pages, perspective, ruled lines, turned pages.

A raster is a table of page columns and runs (y, x0, x1 inclusive) of the pixels that are set. Pages are independent
of each other, so everything is grouped by page; what is counted within a page is bounded by the image's size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateledger.functions import scalars as S
from slateledger.operators.records import checkpointed

#: Reference rules for tilt: a line's least length as a share of the width and in pixels, the largest angle.
LINE_SHARE, LINE_PIXELS, MAX_ANGLE = 8, 80, 5.0
#: Least share of the image that a page's outline covers, how many components are looked at, tolerance of the outline.
LEAST_AREA, TOP, TOLERANCE = 0.15, 5, 0.02
#: Columns that one key of the search for neighbouring runs covers.
CELL = 256


# ------------------------------------------------------------------ tilt


def votes(runs: DataFrame, page: list[str], width: int, angles: Column, cell: float) -> DataFrame:
    """Accumulators (page, angle, rho, votes): the pixels of the runs on the line of each angle, in degrees, through
    each height rho * cell at the image's middle. A run votes by its centre with its length."""
    middle = (F.col("x0") + F.col("x1")) / 2 - width / 2
    cast = runs.select(*page, middle.alias("_m"), "y", (F.col("x1") - F.col("x0") + 1).alias("_n"), F.explode(angles).alias("angle"))
    rho = F.round((F.col("y") - F.col("_m") * F.tan(F.radians("angle"))) / cell).cast("int")
    return cast.groupBy(*page, "angle", rho.alias("rho")).agg(F.sum("_n").alias("votes"))


def text_lines(runs: DataFrame, page: list[str], width: int, step: float = 0.1, apart: int = 8) -> DataFrame:
    """(page, angle, rho, votes): the near-level lines of each page, of at least an eighth of the width and 80 pixels.

    Degrees come first in whole steps, by the angle whose accumulators are fullest (largest sum of squares), then in
    steps of `step` about that. At each height the angle with most votes counts, and of heights up to `apart`
    pixels from each other the one with most votes; ties go to the flatter, then the upper line.
    """
    whole = F.array(*[F.lit(float(a)) for a in range(-int(MAX_ANGLE), int(MAX_ANGLE) + 1)])
    sharp = votes(runs, page, width, whole, 8.0).groupBy(*page, "angle").agg(F.sum(F.col("votes") * F.col("votes")).alias("s"))
    about = sharp.groupBy(*page).agg(F.max_by("angle", F.struct("s", -F.abs("angle"), "angle")).alias("_about"))
    n = round(1 / step)
    fine = F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.round(F.col("_about") + k * step, 6))
    near = runs.join(about, page)
    cells = votes(near, [*page, "_about"], width, fine, 1.0).where(F.abs("angle") <= MAX_ANGLE)
    at = cells.groupBy(*page, "rho").agg(F.max(F.struct("votes", -F.abs("angle"), "angle")).alias("b")).select(*page, "rho", "b.votes", "b.angle")
    hood = Window.partitionBy(*page).orderBy("rho").rangeBetween(-apart, apart)
    rank = lambda c: F.struct(c, -F.abs("angle"), -F.col("rho"))
    best = at.withColumn("_best", F.max(rank(F.col("votes"))).over(hood)).where(F.col("_best") == rank(F.col("votes"))).drop("_best")
    return best.where(F.col("votes") >= max(width // LINE_SHARE, LINE_PIXELS))


def tilt(runs: DataFrame, page: list[str], width: int) -> DataFrame:
    """(page, angle, lines): the median angle of each page's lines; 0 below 0.3 degrees or 3 lines. Pages without
    lines have no row."""
    return text_lines(runs, page, width).groupBy(*page).agg(F.collect_list("angle").alias("a"), F.count("*").alias("lines")).select(*page, F.round(S.deskew_angle("a"), 6).alias("angle"), "lines")


def level(x: Column, y: Column, angle: Column, width: int) -> tuple[Column, Column]:
    """A point after the page is turned back by its angle about the middle of its width at the top."""
    c, s, m = F.cos(F.radians(angle)), F.sin(F.radians(angle)), F.lit(width / 2)
    return (x - m) * c + y * s + m, y * c - (x - m) * s


# ------------------------------------------------------------------ components and outlines


def touching(runs: DataFrame, page: list[str]) -> DataFrame:
    """(page, above, below): numbers of runs of consecutive rows that touch, corners included. Runs meet by the cells
    of CELL columns that they reach into, not with every run of the next row, and count in the cell where the later of
    them begins."""
    cells = runs.withColumn("_c", F.explode(F.sequence(F.floor(F.col("x0") / CELL), F.floor((F.col("x1") + 1) / CELL))))
    a, b = cells.select(*page, "_c", F.col("y"), F.col("x0").alias("_a0"), F.col("x1").alias("_a1"), F.col("run").alias("above")), cells.select(*page, "_c", (F.col("y") - 1).alias("y"), "x0", "x1", F.col("run").alias("below"))
    met = a.join(b, [*page, "_c", "y"]).where("_a0 <= x1 + 1 and _a1 + 1 >= x0").where(F.col("_c") == F.floor(F.greatest("_a0", "x0") / CELL))
    return met.select(*page, "above", "below")


def _labels(above: np.ndarray, below: np.ndarray, n: int) -> np.ndarray:
    """The smallest run that each run is connected with: labels taken over edges, then followed, until they stay."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[above], label[below])
        new = label.copy()
        np.minimum.at(new, label[above], low)
        np.minimum.at(new, label[below], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(runs: DataFrame, page: list[str]) -> DataFrame:
    """runs with `component`, the number of its first run in reading order, by connection in eight directions."""
    order = Window.partitionBy(*page).orderBy("y", "x0", "x1")
    numbered = runs.withColumn("run", F.row_number().over(order) - 1)
    edges = touching(numbered, page).groupBy(*page).agg(F.collect_list(F.struct("above", "below")).alias("_e"))
    sizes = numbered.groupBy(*page).agg(F.count("*").alias("_n"))

    @F.pandas_udf("array<int>")
    def labels(edge: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for e, k in zip(edge, n, strict=True):
            pairs = np.array([(x["above"], x["below"]) for x in e] if e is not None else [], np.int64).reshape(-1, 2)
            out.append(_labels(pairs[:, 0], pairs[:, 1], k).astype(np.int32))
        return pd.Series(out)

    named = sizes.join(edges, page, "left").select(*page, F.posexplode(labels("_e", "_n")).alias("run", "component"))
    return numbered.join(named, [*page, "run"]).drop("run")


def largest(parts: DataFrame, page: list[str], width: int, height: int, top: int = TOP, least: float = LEAST_AREA) -> DataFrame:
    """(page, component, area, rank): of each page's `top` components by pixels those that cover the least share."""
    area = parts.groupBy(*page, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    rank = F.row_number().over(Window.partitionBy(*page).orderBy(F.desc("area"), "component"))
    return area.withColumn("rank", rank).where(F.col("rank") <= top).where(F.col("area") >= width * height * least)


def outline(parts: DataFrame, page: list[str]) -> DataFrame:
    """(page, component, i, x, y): the outer points of each component's rows, down the right side and up the left."""
    rows = parts.groupBy(*page, "component", "y").agg(F.min("x0").alias("l"), F.max("x1").alias("r"))
    w = Window.partitionBy(*page, "component")
    rows = rows.withColumn("_top", F.min("y").over(w)).withColumn("_h", F.max("y").over(w) - F.col("_top") + 1)
    down = F.col("y") - F.col("_top")
    sides = F.array(F.struct(down.alias("i"), F.col("r").alias("x")), F.struct((2 * F.col("_h") - 1 - down).alias("i"), F.col("l").alias("x")))
    return rows.select(*page, "component", (2 * F.col("_h")).alias("n"), "y", F.inline(sides)).select(*page, "component", "n", "i", "x", "y")


def simplified(points: DataFrame, page: list[str], tolerance: float = TOLERANCE, most: int = 6) -> DataFrame:
    """(page, component, corners): the outline cut to corners, in its order, where at most `most` are left.

    The outline starts in two points: the one farthest from its first, and the one farthest from that. A stretch
    between two corners is cut at the point farthest from their line, while that is more than `tolerance` of
    the perimeter away; ties go to the earlier point. All stretches are cut at once, round by round, over windows of
    the same partitioning; what a round of most - 1 would still cut has more corners than `most`.
    """
    key = [*page, "component"]
    w = Window.partitionBy(*key)
    dist = lambda a, b: F.hypot(F.col("x") - a, F.col("y") - b)
    far = lambda d, over: F.max(F.struct(d.alias("d"), (-F.col("i")).alias("i"), "x", "y")).over(over)
    p = points.withColumn("_f", F.min_by(F.struct("x", "y"), "i").over(w)).withColumn("_a", far(dist(F.col("_f.x"), F.col("_f.y")), w))
    p = p.withColumn("i", F.pmod(F.col("i") + F.col("_a.i"), "n")).withColumn("_a", F.struct(F.col("_a.x").alias("x"), F.col("_a.y").alias("y")))
    p = p.withColumn("_b", far(dist(F.col("_a.x"), F.col("_a.y")), w))
    order = w.orderBy("i")
    ahead = F.coalesce(F.lead(F.struct("x", "y")).over(order), F.col("_a"))
    p = p.withColumn("_step", dist(ahead["x"], ahead["y"])).withColumn("_eps", F.sum("_step").over(w) * tolerance)
    first = F.col("i") < -F.col("_b.i")
    end = lambda i, q: F.struct(i.cast("int").alias("i"), q["x"].alias("x"), q["y"].alias("y"))
    a, b = end(F.lit(0), F.col("_a")), end(-F.col("_b.i"), F.col("_b"))
    p = p.select(*key, "n", "i", "x", "y", "_eps", F.when(first, a).otherwise(b).alias("s"), F.when(first, b).otherwise(end(F.col("n"), F.col("_a"))).alias("e"))
    for _ in range(most - 1):
        dx, dy = F.col("e.x") - F.col("s.x"), F.col("e.y") - F.col("s.y")
        size = F.hypot(dx, dy)
        off = F.when(size > 0, F.abs(dx * (F.col("s.y") - F.col("y")) - (F.col("s.x") - F.col("x")) * dy) / size).otherwise(dist(F.col("s.x"), F.col("s.y")))
        p = p.withColumn("_c", far(off, Window.partitionBy(*key, "s.i")))
        cut, before = F.col("_c.d") > F.col("_eps"), F.col("i") < -F.col("_c.i")
        mid = end(-F.col("_c.i"), F.col("_c"))
        p = p.withColumn("_s", F.when(cut & ~before, mid).otherwise(F.col("s"))).withColumn("e", F.when(cut & before, mid).otherwise(F.col("e"))).withColumn("_d", F.when(cut, 1).otherwise(0)).drop("s", "_c").withColumnRenamed("_s", "s")
    ends = p.groupBy(*key).agg(F.array_sort(F.collect_set("s")).alias("c"), F.max("_d").alias("open"))
    return ends.where((F.size("c") <= most) & ((F.size("c") < most) | (F.col("open") == 0))).select(*key, F.transform("c", lambda q: F.struct(q["x"].cast("double").alias("x"), q["y"].cast("double").alias("y"))).alias("corners"))


def four(corners: Column) -> Column:
    """Corners as they are if there are four; of five the two ends of the shortest side become its middle, in whole
    pixels, ties the first; otherwise null."""
    n = F.size(corners)
    side = lambda k: F.hypot(corners[k]["x"] - corners[(k + 1) % 5]["x"], corners[k]["y"] - corners[(k + 1) % 5]["y"])
    short = F.array_min(F.array(*[F.struct(side(k).alias("d"), F.lit(k).alias("k")) for k in range(5)]))["k"]
    other = (short + 1) % 5
    middle = F.struct(F.floor((F.element_at(corners, short + 1)["x"] + F.element_at(corners, other + 1)["x"]) / 2).cast("double").alias("x"), F.floor((F.element_at(corners, short + 1)["y"] + F.element_at(corners, other + 1)["y"]) / 2).cast("double").alias("y"))
    merged = F.filter(F.transform(corners, lambda c, k: F.when(k == short, middle).when(k != other, c)), lambda c: c.isNotNull())
    return F.when(n == 4, corners).when(n == 5, merged)


def ordered(corners: Column) -> Column:
    """Struct of tl, tr, br, bl: smallest and largest x + y, smallest and largest y - x."""
    pick = lambda key: F.element_at(F.array_sort(F.transform(corners, lambda c: F.struct(key(c).alias("k"), c.alias("c")))), 1)["c"]
    return F.struct(pick(lambda c: c["x"] + c["y"]).alias("tl"), pick(lambda c: c["y"] - c["x"]).alias("tr"), pick(lambda c: -c["x"] - c["y"]).alias("br"), pick(lambda c: c["x"] - c["y"]).alias("bl"))


def page_quads(runs: DataFrame, page: list[str], width: int, height: int, least: int = 200) -> DataFrame:
    """(page, quad, out_w, out_h): the outline with four corners of the largest component that has one, if the page
    that comes of it has at least `least` pixels a side and at most twice the image's."""
    parts = checkpointed(components(runs, page))  # read three times
    big = largest(parts, page, width, height)
    some = parts.join(big.select(*page, "component"), [*page, "component"])
    got = simplified(outline(some, page), page).withColumn("_q", four(F.col("corners"))).where("_q is not null").join(big, [*page, "component"])
    return sized(got.groupBy(*page).agg(F.min_by("_q", "rank").alias("_q")), page, width, height, least)


def sized(found: DataFrame, page: list[str], width: int, height: int, least: int = 200) -> DataFrame:
    """(page, quad, out_w, out_h) of four corners `_q`, where the page that comes of them has a possible size."""
    best = found.select(*page, ordered(F.col("_q")).alias("quad"))
    q, side = F.col("quad"), lambda a, b: F.hypot(F.col(f"quad.{a}.x") - F.col(f"quad.{b}.x"), F.col(f"quad.{a}.y") - F.col(f"quad.{b}.y"))
    sized = best.select(*page, q, F.greatest(side("tr", "tl"), side("br", "bl")).cast("int").alias("out_w"), F.greatest(side("bl", "tl"), side("br", "tr")).cast("int").alias("out_h"))
    return sized.where((F.col("out_w") >= least) & (F.col("out_h") >= least) & (F.col("out_w") <= 2 * width) & (F.col("out_h") <= 2 * height))


# ------------------------------------------------------------------ perspective


def to_quad(quad: Column, w: Column, h: Column) -> list[Column]:
    """The nine numbers of the projective map from the rectangle (0, 0) to (w, h) onto tl, tr, br, bl."""
    p = [(quad[c]["x"], quad[c]["y"]) for c in ("tl", "tr", "br", "bl")]
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    dx1, dx2, dx3, dy1, dy2, dy3 = x1 - x2, x3 - x2, x0 - x1 + x2 - x3, y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    det = dx1 * dy2 - dx2 * dy1
    g, k = (dx3 * dy2 - dx2 * dy3) / det, (dx1 * dy3 - dx3 * dy1) / det
    return [(x1 - x0 + g * x1) / w, (x3 - x0 + k * x3) / h, x0, (y1 - y0 + g * y1) / w, (y3 - y0 + k * y3) / h, y0, g / w, k / h, F.lit(1.0)]


def inverse(m: list[Column]) -> list[Column]:
    """The map back, up to a factor, which a projective map doesn't need."""
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def warped(points: DataFrame, quad: Column, w: Column, h: Column) -> DataFrame:
    """points (x, y, and the quad and size of their page) with u, v: where they come to lie on the rectified page. The
    nine numbers are worked out once a row, in a column of their own."""
    back = points.withColumn("_m", F.array(*inverse(to_quad(quad, w, h))))
    u, v = apply([F.col("_m")[k] for k in range(9)], F.col("x"), F.col("y"))
    return back.withColumn("u", u).withColumn("v", v).drop("_m")


# ------------------------------------------------------------------ ruled lines


def across(runs: DataFrame, length: int) -> DataFrame:
    """What opening by a level element of `length` pixels leaves: the runs that are as long."""
    return runs.where(F.col("x1") - F.col("x0") + 1 >= length)


def turned(runs: DataFrame, page: list[str]) -> DataFrame:
    """The same raster by columns: runs (y: column, x0, x1: rows). Islands of rows by column, from the pixels that
    are set."""
    dots = runs.select(*page, F.col("y").alias("_row"), F.explode(F.sequence("x0", "x1")).alias("y")).distinct()
    order = Window.partitionBy(*page, "y").orderBy("_row")
    return dots.withColumn("_g", F.col("_row") - F.row_number().over(order)).groupBy(*page, "y", "_g").agg(F.min("_row").alias("x0"), F.max("_row").alias("x1")).drop("_g")


def merged(runs: DataFrame, page: list[str]) -> DataFrame:
    """The union of runs: those of a row that overlap or touch become one."""
    order = Window.partitionBy(*page, "y").orderBy("x0", "x1")
    seen = runs.withColumn("_new", (F.col("x0") > F.coalesce(F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    return seen.withColumn("_g", F.sum("_new").over(order)).groupBy(*page, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def full_columns(runs: DataFrame, page: list[str], rows: int) -> DataFrame:
    """(page, block, a, b): the stretches of columns a to b that are set in every row of an aligned block of `rows` rows. Only
    the ends of runs are looked at: how many runs of a block cover a column is the sum of its begins less ends so far. The
    runs of a row must not overlap (merged)."""
    ends = runs.select(*page, F.floor(F.col("y") / rows).cast("int").alias("block"), F.inline(F.array(F.struct(F.col("x0").alias("a"), F.lit(1).alias("d")), F.struct((F.col("x1") + 1).alias("a"), F.lit(-1).alias("d")))))
    order = Window.partitionBy(*page, "block").orderBy("a")
    steps = ends.groupBy(*page, "block", "a").agg(F.sum("d").alias("d")).withColumn("_n", F.sum("d").over(order)).withColumn("b", F.lead("a").over(order) - 1)
    return steps.where(F.col("_n") == rows).select(*page, "block", "a", "b")


def table_lines(runs: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """Runs (and `kind`, level or upright) of ruled lines: opened twice by an element of a twelfth of the side, at
    least 50 pixels, which leaves runs of 2 n - 1 pixels and more. Upright runs come by columns; they fill at least one
    aligned block of n rows, so only columns that do are taken apart into pixels. The runs of a row must not overlap."""
    n, m = max(width // 12, 50), max(height // 12, 50)
    level_ = across(runs, 2 * n - 1).select(*page, F.lit("level").alias("kind"), "y", "x0", "x1")
    full = full_columns(runs, page, m).groupBy(*page).agg(F.array_distinct(F.collect_list(F.struct("a", "b"))).alias("_c"))  # no more than the image's ends of runs
    part = lambda s: F.struct(F.greatest("x0", s["a"]).alias("x0"), F.least("x1", s["b"]).alias("x1"))
    near = runs.join(full, page).select(*page, "y", F.inline(F.transform(F.filter("_c", lambda s: (s["a"] <= F.col("x1")) & (s["b"] >= F.col("x0"))), part)))
    return level_.unionByName(across(turned(near, page), 2 * m - 1).select(*page, F.lit("upright").alias("kind"), "y", "x0", "x1"))


def grid_mask(lines: DataFrame, page: list[str], width: int, height: int) -> DataFrame:
    """The rows of runs that the lines cover, widened by the pixel above and to the left (a 2 by 2 element)."""
    upright = lines.where("kind = 'upright'").drop("kind")
    rows = lines.where("kind = 'level'").drop("kind").unionByName(turned(upright, page))
    wide = rows.withColumn("x1", F.least(F.col("x1") + 1, F.lit(width - 1)))
    two = wide.withColumn("y", F.explode(F.array(F.col("y"), F.col("y") + 1))).where(F.col("y") < height)
    return merged(two, page)


# ------------------------------------------------------------------ turned pages


def level_lines(runs: DataFrame, page: list[str], share: int = 8, gap: int = 20) -> DataFrame:
    """(page, lines): level stretches of at least an eighth of the width `w` of their page, where gaps of up to `gap`
    pixels don't end a stretch."""
    order = Window.partitionBy(*page, "y").orderBy("x0", "x1")
    seen = runs.withColumn("_new", (F.col("x0") > F.coalesce(F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-(1 << 20))) + gap + 1).cast("int"))
    long = seen.withColumn("_g", F.sum("_new").over(order)).groupBy(*page, "w", "y", "_g").agg((F.max("x1") - F.min("x0") + 1).alias("_n"))
    return long.groupBy(*page).agg(F.count_if(F.col("_n") >= F.col("w") / share).alias("lines"))


def turn(original: Column, left: Column, right: Column, aspect: Column) -> Column:
    """By how much a page is to be turned, counter-clockwise: 90 or 270 where it is much higher than wide and has,
    turned so, five level lines and 1.5 times as many as it has now; otherwise 0."""
    better = lambda c: (c > original * 1.5) & (c >= 5)
    return F.when(aspect >= 0.7, 0).when(better(left), 90).when(better(right), 270).otherwise(0)


def auto_turn(runs: DataFrame, page: list[str]) -> DataFrame:
    """(page, lines, lines_turned, turn) of pages with columns w and h. A quarter turn to either side has the same level
    lines, so the first one wins, as in the reference."""
    size = F.first(F.struct("w", "h"))
    now = level_lines(runs, page).withColumnRenamed("lines", "_now")
    cols = turned(runs, page).join(runs.groupBy(*page).agg(size.alias("s")).select(*page, F.col("s.h").alias("w")), page)
    other = level_lines(cols, page).withColumnRenamed("lines", "_other")
    sizes = runs.groupBy(*page).agg(size.alias("s"))
    got = sizes.join(now, page).join(other, page)
    return got.select(*page, F.col("_now").alias("lines"), F.col("_other").alias("lines_turned"), turn(F.col("_now"), F.col("_other"), F.col("_other"), F.col("s.w") / F.col("s.h")).alias("turn"))


def tan(tenths: Column) -> Column:
    """The tangent of an angle in tenths of degrees."""
    return F.tan(tenths * (math.pi / 1800))
