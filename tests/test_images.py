"""Rasters and pixels against plain versions on small random images."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateledger.operators import pixels, raster

PAGE = ["doc_id"]


def runs_of(image):
    """(y, x0, x1) of a boolean image."""
    for y, row in enumerate(image):
        for v, g in itertools.groupby(enumerate(row), key=lambda p: bool(p[1])):
            g = list(g)
            if v:
                yield y, g[0][0], g[-1][0]


def raster_of(spark, images):
    return spark.createDataFrame([(d, *r, 1.5) for d, im in images.items() for r in runs_of(im)], "doc_id long, y int, x0 int, x1 int, area double")


@pytest.fixture(scope="module")
def images():
    r = np.random.default_rng(7)
    out = {k: r.random((24, 150)) < p for k, p in enumerate((0.02, 0.2, 0.45, 0.8))}
    out[9] = np.zeros((24, 150), bool)
    out[10] = np.ones((24, 150), bool)
    snake = np.zeros((24, 150), bool)  # one long component that turns at every other row
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    out[11] = snake
    return out


def components_of(im):
    left, out = {(y, x) for y, x in zip(*np.nonzero(im), strict=True)}, []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            own.add((y, x))
            for q in itertools.product((y - 1, y, y + 1), (x - 1, x, x + 1)):
                if q in left:
                    left.discard(q)
                    todo.append(q)
        out.append(own)
    return out


def test_components(spark, images):
    got = raster.components(raster_of(spark, images).drop("area"), PAGE).groupBy("doc_id", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("a"), F.min("y").alias("y"))
    have = {}
    for r in got.collect():
        have.setdefault(r.doc_id, []).append((r.a, r.y))
    for d, im in images.items():
        assert sorted(have.get(d, [])) == sorted((len(c), min(y for y, _ in c)) for c in components_of(im))
    assert raster.components(raster_of(spark, {9: images[9]}).drop("area"), PAGE).count() == 0


def test_columns_and_unions(spark, images):
    df = raster_of(spark, images).drop("area")
    flip = raster_of(spark, {d: im.T for d, im in images.items()}).drop("area")
    assert sorted(raster.turned(df, PAGE).select("doc_id", "y", "x0", "x1").collect()) == sorted(flip.collect())
    torn = df.unionByName(df.withColumn("x1", F.floor((F.col("x0") + F.col("x1")) / 2).cast("int")))
    assert sorted(raster.merged(torn, PAGE).select("doc_id", "y", "x0", "x1").collect()) == sorted(df.collect())
    want = {(d, b, x) for d, im in images.items() for b in range(6) for x in range(150) if im[4 * b : 4 * b + 4, x].all()}
    full = raster.full_columns(df, PAGE, 4).collect()
    assert {(r.doc_id, r.block, x) for r in full for x in range(r.a, r.b + 1)} == want


def test_opening_by_long_elements(spark):
    r = np.random.default_rng(3)
    images = {}
    for d in range(4):
        im = r.random((260, 240)) < 0.3
        im[r.integers(0, 260, 3), 20:200] = True
        im[5:250, r.integers(0, 240, 4)] = True
        images[d] = im
    got = raster.table_lines(raster_of(spark, images).drop("area"), PAGE, 240, 260).collect()
    for d, im in images.items():
        for kind, src in (("level", im), ("upright", im.T)):
            # opening twice by 50 pixels: all positions that some stretch of 99 set pixels covers
            want = np.zeros_like(src)
            for y, x in itertools.product(range(src.shape[0]), range(src.shape[1] - 98)):
                if src[y, x : x + 99].all():
                    want[y, x : x + 99] = True
            assert sorted((x.y, x.x0, x.x1) for x in got if x.doc_id == d and x.kind == kind) == sorted(runs_of(want))


def simplified(points, tolerance):
    """The outline's corners by recursion."""
    n = len(points)
    dist = lambda a, b: math.hypot(a[0] - b[0], a[1] - b[1])
    far = lambda a: max(range(n), key=lambda i: (dist(points[i], a), -i))
    a = far(points[0])
    p = points[a:] + points[:a]
    b = max(range(n), key=lambda i: (dist(p[i], p[0]), -i))
    eps = tolerance * sum(dist(p[i], p[(i + 1) % n]) for i in range(n))
    p.append(p[0])

    def cut(i, j):
        (x0, y0), (x1, y1) = p[i], p[j]
        size = dist(p[i], p[j])
        off = lambda q: abs((x1 - x0) * (y0 - q[1]) - (x0 - q[0]) * (y1 - y0)) / size if size else dist(p[i], q)
        k = max(range(i, j), key=lambda k: (off(p[k]), -k), default=None)
        return cut(i, k) + cut(k, j) if k is not None and off(p[k]) > eps else [p[i]]

    return cut(0, b) + cut(b, n)


def test_outlines(spark):
    r = random.Random(4)
    shapes = {}
    for d in range(30):
        top, size = r.randint(0, 5), r.randint(2, 60)
        mid, wide = [r.randint(40, 60)], [r.randint(0, 30)]
        for _ in range(size - 1):
            mid.append(max(35, min(65, mid[-1] + r.randint(-2, 2))))
            wide.append(max(0, min(34, wide[-1] + r.randint(-3, 3))))
        shapes[d] = [(top + k, m - w, m + w) for k, (m, w) in enumerate(zip(mid, wide, strict=True))]
    df = spark.createDataFrame([(d, 0, *row) for d, rows in shapes.items() for row in rows], "doc_id long, component int, y int, x0 int, x1 int")
    got = {x.doc_id: [(c.x, c.y) for c in x.corners] for x in raster.simplified(raster.outline(df, PAGE), PAGE, 0.035).collect()}
    kept = 0
    for d, rows in shapes.items():
        want = simplified([(x1, y) for y, _, x1 in rows] + [(x0, y) for y, x0, _ in reversed(rows)], 0.035)
        assert got.get(d) == ([(float(x), float(y)) for x, y in want] if len(want) <= 6 else None), d
        kept += len(want) <= 6
    assert 3 <= kept < 30


def test_four_corners(spark):
    p = lambda *c: [{"x": float(a), "y": float(b)} for a, b in c]
    rows = [(1, p((0, 0), (9, 1), (9, 8), (1, 9))), (2, p((0, 0), (7, 0), (9, 2), (9, 9), (0, 9))), (3, p((0, 0), (5, 5), (0, 9))), (4, p((0, 0), (3, 0), (9, 3), (9, 6), (5, 9), (0, 9))), (5, p((1, 0), (9, 0), (9, 9), (0, 9), (0, 1)))]
    df = spark.createDataFrame(rows, "doc_id long, corners array<struct<x:double,y:double>>").withColumn("q", raster.four(F.col("corners")))
    got = {r.doc_id: r.q and [(c.x, c.y) for c in r.q] for r in df.collect()}
    assert got == {1: [(0, 0), (9, 1), (9, 8), (1, 9)], 2: [(0, 0), (8, 1), (9, 9), (0, 9)], 3: None, 4: None, 5: [(9, 0), (9, 9), (0, 9), (0, 0)]}
    o = df.where("doc_id = 1").select(raster.ordered(F.col("q")).alias("o")).first().o
    assert [(c.x, c.y) for c in (o.tl, o.tr, o.br, o.bl)] == [(0, 0), (9, 1), (9, 8), (1, 9)]


def test_perspective_and_back(spark):
    r = random.Random(1)
    rows = [(k, 300.0, 420.0, r.uniform(0, 300), r.uniform(0, 420), *[{"x": a + r.uniform(-40, 40), "y": b + r.uniform(-40, 40)} for a, b in ((60, 60), (500, 60), (500, 700), (60, 700))]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, w double, h double, u0 double, v0 double, tl struct<x:double,y:double>, tr struct<x:double,y:double>, br struct<x:double,y:double>, bl struct<x:double,y:double>").withColumn("quad", F.struct("tl", "tr", "br", "bl"))
    m = raster.to_quad(F.col("quad"), F.col("w"), F.col("h"))
    x, y = raster.apply(m, F.col("u0"), F.col("v0"))
    corner = raster.apply(m, F.col("w"), F.lit(0.0))
    got = raster.warped(df.withColumn("x", x).withColumn("y", y), F.col("quad"), F.col("w"), F.col("h")).withColumn("c", corner[0]).collect()
    assert all(abs(g.u - g.u0) < 1e-6 and abs(g.v - g.v0) < 1e-6 and abs(g.c - g.tr.x) < 1e-9 for g in got)


def test_levelled_points(spark):
    x, y = raster.level(F.col("x"), F.col("y"), F.lit(2.0), 1000)
    t = math.tan(math.radians(2))
    got = spark.createDataFrame([(a, 60 + (a - 500) * t) for a in (0.0, 300.0, 1000.0)], "x double, y double").select(y.alias("y")).collect()
    assert max(g.y for g in got) - min(g.y for g in got) < 1e-9


# ------------------------------------------------------------------ pixels


def grey(spark, images):
    return spark.createDataFrame([(d, y, x, int(v)) for d, im in images.items() for y, row in enumerate(im) for x, v in enumerate(row)], "doc_id long, y int, x int, v int")


def arrays(df, images, col="v"):
    out = {d: np.zeros(im.shape) for d, im in images.items()}
    for r in df.collect():
        out[r.doc_id][r.y, r.x] = r[col]
    return out


@pytest.fixture(scope="module")
def photos():
    r = np.random.default_rng(5)
    h, w = 30, 26
    shade = np.add.outer(np.arange(h) * 2, np.arange(w)) % 90
    return {0: r.integers(0, 256, (h, w)), 1: 230 - shade, 2: np.full((h, w), 77), 3: np.where(r.random((h, w)) < 0.3, 20, 200 - shade // 2)}


def padded(im, r, border):
    return np.pad(im, r, mode="reflect" if border == "reflect" else "edge")


@pytest.mark.parametrize(("size", "border"), [(3, "reflect"), (5, "replicate"), (21, "reflect"), (21, "replicate")])
def test_blur(spark, photos, size, border):
    w = np.array(pixels.gaussian(size))
    assert abs(w.sum() - 1) < 1e-12
    got = arrays(pixels.blurred(pixels.by_page(grey(spark, photos), PAGE), PAGE, 26, 30, size, border), photos)
    for d, im in photos.items():
        p = padded(im.astype(float), size // 2, border)
        want = np.array([[(p[y : y + size, x : x + size] * np.outer(w, w)).sum() for x in range(26)] for y in range(30)])
        assert np.abs(got[d] - want).max() < 1e-9


def equalized(im, limit, tiles):
    h, w = im.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    big = np.pad(im, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect")
    area, lut = th * tw, np.zeros((tiles, tiles, 256))
    for a, b in itertools.product(range(tiles), range(tiles)):
        hist = np.bincount(big[a * th : (a + 1) * th, b * tw : (b + 1) * tw].ravel(), minlength=256)
        cut = max(1, int(limit * area / 256))
        extra = int(np.maximum(hist - cut, 0).sum())
        hist = np.minimum(hist, cut) + extra // 256
        left = extra % 256
        if left:
            step = max(256 // left, 1)
            for i in range(0, 256, step):
                if left:
                    hist[i] += 1
                    left -= 1
        lut[a, b] = np.minimum(255, np.rint(np.cumsum(hist) * (255.0 / area)))
    out = np.zeros(im.shape)
    hold = lambda k: min(max(k, 0), tiles - 1)
    for y, x in itertools.product(range(h), range(w)):
        fy, fx = y / th - 0.5, x / tw - 0.5
        y1, x1 = math.floor(fy), math.floor(fx)
        ya, xa = fy - y1, fx - x1
        at = lambda a, b: lut[hold(a), hold(b), im[y, x]]  # noqa: B023, E731
        out[y, x] = np.rint((at(y1, x1) * (1 - xa) + at(y1, x1 + 1) * xa) * (1 - ya) + (at(y1 + 1, x1) * (1 - xa) + at(y1 + 1, x1 + 1) * xa) * ya)
    return out


@pytest.mark.parametrize(("limit", "tiles"), [(2.0, 2), (4.0, 4), (30.0, 3)])
def test_local_contrast(spark, photos, limit, tiles):
    got = arrays(pixels.equalized(grey(spark, photos), PAGE, 26, 30, limit, tiles), photos)
    for d, im in photos.items():
        assert (got[d] == equalized(im, limit, tiles)).all()


def test_thresholds(spark, photos):
    df = pixels.by_page(grey(spark, photos), PAGE)
    local = arrays(pixels.locally_black(df, PAGE, 26, 30), photos)
    cut = {r.doc_id: r.threshold for r in pixels.otsu(df, PAGE).collect()}
    w = np.array(pixels.gaussian(21))
    for d, im in photos.items():
        p = padded(im.astype(float), 10, "replicate")
        mean = np.array([[(p[y : y + 21, x : x + 21] * np.outer(w, w)).sum() for x in range(26)] for y in range(30)])
        sure = np.abs(mean - np.floor(mean) - 0.5) > 1e-6
        assert (local[d] == np.where(im > np.rint(mean) - 8, 255, 0))[sure].all()
        best, at = -1.0, int(im.min())
        for t in range(256):
            low, high = im[im <= t], im[im > t]
            if len(low) and len(high):
                s = len(low) * len(high) * (low.mean() - high.mean()) ** 2
                if s > best * (1 + 1e-12):
                    best, at = s, t
        assert cut[d] == at


def test_square_and_spread(spark, photos):
    df = pixels.by_page(grey(spark, photos), PAGE)
    got, wide = arrays(pixels.opened(df, PAGE), photos), arrays(pixels.spread(df, PAGE, 5, 7), photos)
    for d, im in photos.items():
        low = np.array([[im[max(0, y - 1) : y + 1, max(0, x - 1) : x + 1].min() for x in range(26)] for y in range(30)])
        assert (got[d] == np.array([[low[max(0, y - 1) : y + 1, max(0, x - 1) : x + 1].max() for x in range(26)] for y in range(30)])).all()
        assert (wide[d] == np.array([[im[max(0, y - 3) : y + 4, max(0, x - 2) : x + 3].max() for x in range(26)] for y in range(30)])).all()


def test_shadow_and_measures(spark, photos):
    flat = arrays(pixels.shadowless(grey(spark, photos), PAGE, 26, 30), photos)
    assert flat[2].std() == 0 and abs(flat[2].mean() - 220) <= 1
    assert flat[1].std() < photos[1].std()  # the shade is gone, the paper near the white point
    m = {r.doc_id: r for r in pixels.measures(grey(spark, photos), PAGE, 26, 30).collect()}
    for d, im in photos.items():
        p = np.pad(im.astype(float), 1, mode="reflect")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
        assert abs(m[d].sharpness - lap.var()) < 1e-6 and abs(m[d].contrast - im.std()) < 1e-9 and abs(m[d].brightness - im.mean()) < 1e-9
    assert m[2].quality < m[3].quality


def test_white_paper_and_tinted_paper(spark):
    def page(d, rgb, share):
        return [(d, y, x, *map(float, rgb if y * 10 + x < share * 100 else (10, 10, 10))) for y in range(10) for x in range(10)]

    df = spark.createDataFrame(page(1, (240, 240, 240), 0.8) + page(2, (240, 235, 215), 0.8) + page(3, (240, 240, 240), 0.1) + page(4, (200, 40, 40), 1), "doc_id long, y int, x int, r double, g double, b double")
    got = {r.doc_id: r for r in pixels.paper(df, PAGE).collect()}
    assert abs(got[1].a_cast) < 0.01 and abs(got[1].b_cast) < 0.01 and got[2].b_cast > 3 and (got[3].a_cast, got[3].b_cast, got[4].share) == (None, None, 0)
    after = {(r.doc_id, r.y): r for r in pixels.whitened(df, PAGE).where("x = 0").collect()}
    assert abs(after[2, 0].b - 0.2 * got[2].b_cast) < 1e-9 and abs(after[3, 0].b) < 0.01
    assert pixels.paper(df.limit(0), PAGE).count() == 0
