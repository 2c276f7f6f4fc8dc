"""Queries that take pages as a whole: no pixel and no run is a row, and the numbers are those of the plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateledger.operators import pages, pixels, raster, runs
from slateledger.plans import imaging
from tests.test_images import components_of, runs_of

PAGE = ["doc_id"]
SIZE = (26, 30)


def lots(images):
    return np.stack([images[d] for d in sorted(images)], 2).astype(np.int32)


@pytest.fixture(scope="module")
def photos():
    r = np.random.default_rng(8)
    shade = np.add.outer(np.arange(30) * 2, np.arange(26)) % 90
    return {0: r.integers(0, 256, (30, 26)), 1: np.where(r.random((30, 26)) < 0.3, 20, 200 - shade // 2), 2: np.full((30, 26), 77)}


def rows(spark, images):
    return spark.createDataFrame([(d, y, x, int(v)) for d, im in images.items() for y, row in enumerate(im) for x, v in enumerate(row)], "doc_id long, y int, x int, v int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def whole(spark, sf, name):
    """The plan makes no rows of a page, deals its lines once, and gives a row a page."""
    df = imaging.QUERIES[name](spark, sf)
    p = plan(df)
    assert "Generate" not in p and p.count(" Exchange ") == 1
    assert df.count() == imaging.pages(spark, sf).count()


def same(spark, images, got, df):
    """got: an array (y, x, page)."""
    want = np.zeros(got.shape)
    at = {d: k for k, d in enumerate(sorted(images))}
    for r in df.collect():
        want[r.y, r.x, at[r.doc_id]] = r.v
    assert (got == want).all()


def test_local_contrast_by_pages(spark, sf, photos):
    whole(spark, sf, "q_local_contrast")
    for limit, tiles in ((2.0, 2), (4.0, 4), (30.0, 3)):
        same(spark, photos, pages.equalized(lots(photos), limit, tiles), pixels.equalized(rows(spark, photos), PAGE, *SIZE, limit, tiles))


def test_shadows_by_pages(spark, sf, photos):
    whole(spark, sf, "q_shadowless")
    same(spark, photos, pages.shadowless(lots(photos)), pixels.shadowless(rows(spark, photos), PAGE, *SIZE))


def test_black_and_white_by_pages(spark, sf, photos):
    whole(spark, sf, "q_binary_variant")
    same(spark, photos, pages.binary(lots(photos), 4), pixels.binary(rows(spark, photos), PAGE, *SIZE, 4))


def test_thresholds_by_pages(spark, sf, photos):
    whole(spark, sf, "q_ocr_binary")
    same(spark, photos, pages.ocr_binary(lots(photos), 3), pixels.ocr_binary(rows(spark, photos), PAGE, *SIZE, 3))


def test_measures_by_pages(spark, sf, photos):
    whole(spark, sf, "q_page_measures")
    got, want = pages.measures(lots(photos)), {r.doc_id: r for r in pixels.measures(rows(spark, photos), PAGE, *SIZE).collect()}
    for d in photos:
        assert np.allclose([g[d] for g in got], [want[d][c] for c in ("sharpness", "contrast", "brightness", "noise")], 1e-12)


def test_paper_by_pages(spark, sf):
    whole(spark, sf, "q_paper_cast")
    r = np.random.default_rng(2)
    rgb = [np.stack([r.integers(lo, 256, (9, 10)), np.full((9, 10), 20 * k), r.integers(190, 256, (9, 10))], 2).astype(float) for k, lo in ((1, 190), (2, 200), (3, 180))]
    rgb[1][1, :, 0] = rgb[0][1, :, 0]
    df = spark.createDataFrame([(d, *(float(c[y, x, d]) for c in rgb)) for d in range(3) for y in range(9) for x in range(10)], "doc_id long, r double, g double, b double")
    share, a, b = pages.paper(*rgb)
    for w in pixels.paper(df, PAGE).collect():
        assert abs(share[w.doc_id] - w.share) < 1e-12
        for got, want in ((a, w.a_cast), (b, w.b_cast)):
            got = got[w.doc_id].as_py()
            assert got is want or abs(got - want) < 1e-9


def lot_of(images):
    """Boolean images, by page, as runs in order."""
    rows = [(k, *r) for k, d in enumerate(sorted(images)) for r in runs_of(images[d])]
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True))


@pytest.fixture(scope="module")
def specks():
    r = np.random.default_rng(7)
    out = {k: r.random((24, 150)) < p for k, p in enumerate((0.02, 0.2, 0.45, 0.8))}
    out[4] = np.zeros((24, 150), bool)
    out[5] = np.ones((24, 150), bool)
    out[6] = np.zeros((24, 150), bool)  # one long component that turns at every other row
    out[6][::2] = out[6][1::4, -1] = out[6][3::4, 0] = True
    return out


def test_turned_pages(spark, sf, specks):
    whole(spark, sf, "q_auto_turn")
    lot = lot_of(specks)
    assert list(zip(*runs.turned(lot), strict=True)) == list(zip(*lot_of({d: im.T for d, im in specks.items()}), strict=True))
    df = spark.createDataFrame([(*map(int, r), 150) for r in zip(*lot, strict=True)], "doc_id long, y int, x0 int, x1 int, w int")
    for gap in (0, 3, 20):
        want = dict(raster.level_lines(df, PAGE, 8, gap).collect())
        assert runs.level_lines(lot, 7, np.full(7, 150), 8, gap).tolist() == [want.get(d, 0) for d in range(7)]


def test_components_by_pages(spark, sf, specks):
    whole(spark, sf, "q_page_components")
    lot = lot_of(specks)
    first, size = runs.areas(lot, runs.components(lot))
    for d, im in specks.items():
        assert sorted(size[lot[0][first] == d]) == sorted(map(len, components_of(im)))


def test_outlines_by_pages(spark, sf):
    assert plan(imaging.QUERIES["q_page_quads"](spark, sf)).count("Window ") <= 3  # those that number the invoices
    r, images = np.random.default_rng(4), {}
    for d in range(12):
        images[d] = np.zeros((60, 80), bool)
        mid, wide = 40 + r.integers(-1, 2, 60).cumsum().clip(-5, 5), 20 + r.integers(-3, 4, 60).cumsum().clip(-9, 12)
        for y in range(2, int(r.integers(30, 60))):
            images[d][y, mid[y] - wide[y] : mid[y] + wide[y] + 1] = True
    lot = lot_of(images)
    df = spark.createDataFrame([tuple(map(int, x)) for x in zip(*lot, strict=True)], "doc_id long, y int, x0 int, x1 int")
    parts = raster.components(df, PAGE)
    some = parts.join(raster.largest(parts, PAGE, 80, 60), [*PAGE, "component"])
    want = {x.doc_id: [{"x": c.x, "y": c.y} for c in x.corners] for x in raster.simplified(raster.outline(some, PAGE), PAGE).collect()}
    assert [own[0] if own else None for own in runs.outlines(lot, 12, 80, 60)] == [want.get(d) for d in range(12)]


def test_ruled_lines_by_pages(spark, sf):
    whole(spark, sf, "q_table_lines")
    r = np.random.default_rng(3)
    v = r.random((3, 260, 240)) < 0.3
    for d in range(3):
        v[d, r.integers(0, 260, 3), 20:200] = True
        v[d, 5:250, r.integers(0, 240, 4)] = True
    lot = lot_of(dict(enumerate(v)))
    df = spark.createDataFrame([tuple(map(int, x)) for x in zip(*lot, strict=True)], "doc_id long, y int, x0 int, x1 int")
    lines = raster.table_lines(df, PAGE, 240, 260)
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    want = [dict(x.groupBy("doc_id").agg(size).collect()) for x in (lines.where("kind = 'level'"), lines.where("kind = 'upright'"), raster.grid_mask(lines, PAGE, 240, 260))]
    got = runs.table_pixels(v)
    assert [g.tolist() for g in got[:3]] == [[w.get(d, 0) for d in range(3)] for w in want]
    assert all(0 < got[3][d] < v[d].sum() for d in range(3))


def test_tilt_by_pages(spark, sf):
    df = imaging.QUERIES["q_deskew_lines"](spark, sf)
    assert "Generate" not in plan(df) and plan(df).count(" Exchange ") == 1
    r = np.random.default_rng(6)
    rows = [(d, 40 + 25 * k + round((x - 200) * np.tan(np.radians(1.5 * d - 3))) + int(r.integers(-1, 2)), x, x + int(r.integers(3, 12))) for d in range(5) for k in range(1 + 2 * d) for x in range(0, 380, 12)]
    lot = tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
    page, angle = runs.line_angles(lot, 5, 400)
    want = raster.text_lines(spark.createDataFrame([tuple(map(int, x)) for x in rows], "doc_id long, y int, x0 int, x1 int"), PAGE, 400).orderBy("doc_id", "rho").collect()
    assert len(want) > 9 and list(zip(page.tolist(), angle.tolist(), strict=True)) == [(x.doc_id, x.angle) for x in want]
