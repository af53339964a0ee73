import numpy as np
import pytest

from taxaflow.functions import raster as R
from taxaflow.operators import vision
from taxaflow.sources import readers


def plate(h=600, w=800, rects=(((100, 100), (140, 160)), ((300, 200), (350, 280)), ((500, 350), (530, 395)))):
    a = np.full((h, w), 255, np.uint8)
    for (x0, y0), (x1, y1) in rects:
        a[y0 : y1 + 1, x0 : x1 + 1] = 0
    return a


def rows(spark, *imgs):
    data = [(i, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.tobytes()) for i, a in enumerate(imgs)]
    return spark.createDataFrame(data, "image_id long, height int, width int, channels int, data binary")


def test_drawings_on_a_plate(spark):
    imgs = [plate(), plate(200, 200, [((90, 90), (93, 93))]), np.full((400, 400), 255, np.uint8), np.repeat(plate()[..., None], 3, 2)]
    got = vision.drawings(rows(spark, *imgs)).collect()
    assert [sum(r.image_id == i for r in got) for i in range(4)] == [3, 0, 0, 3]
    assert vision.specimens(rows(spark, plate(300, 300, [((50, 50), (150, 150))])), 100, 500).count() == 0
    # on a page with ink below the lower percentile, stretching leaves nothing to cut
    assert vision.specimens(rows(spark, plate())).count() == 0
    sized = vision.specimens(rows(spark, plate(rects=[((50, 50), (250, 200)), ((400, 300), (600, 450))])), size=(128, 128)).collect()
    assert len(sized) == 2 and {(r.crop_h, r.crop_w, len(r.crop)) for r in sized} == {(128, 128, 128 * 128)}


def test_bad_rows_are_skipped(spark):
    bad = spark.createDataFrame([(9, 10, 10, 1, b"xx"), (8, None, None, None, None)], "image_id long, height int, width int, channels int, data binary")
    assert [r.image_id for r in vision.features(rows(spark, plate()).union(bad)).collect()] == [0]
    assert vision.plates(rows(spark, plate()).limit(0)).count() == 0


def test_features_and_types(spark):
    f = vision.image_types(rows(spark, plate(), np.full((50, 60, 3), (20, 60, 200), np.uint8))).orderBy("image_id").collect()
    assert f[0].white_bg_ratio == pytest.approx((600 * 800 - sum((x1 - x0 + 1) * (y1 - y0 + 1) for (x0, y0), (x1, y1) in (((100, 100), (140, 160)), ((300, 200), (350, 280)), ((500, 350), (530, 395))))) / 480000)
    assert f[0].sat_mean == 0 and f[0].blue_dominance == 0 and 0 < f[0].edge_density < 0.01 and (f[0].width, f[0].height) == (800, 600)
    assert f[1].blue_dominance == 1 and f[1].rule == "R2" and f[1].image_type == "MICROSCOPY"


def test_entropy_bound():
    rng = np.random.default_rng(0)
    assert R.features(rng.integers(0, 256, (64, 64, 3)).astype(np.uint8))["hist_entropy"] <= 1.0001


def test_otsu_and_masks():
    a = np.r_[np.full(50, 10), np.full(50, 200)].astype(np.uint8).reshape(10, 10)
    assert 10 <= R.otsu(a) < 200 and R.ink(a).sum() == 50
    m = np.zeros((20, 20), bool)
    m[5:15, 5:15] = True
    m[10, 10] = False
    m[1, 1] = True
    c = R.clean(m)
    assert c[10, 10] and not c[1, 1]
    assert R.ellipse(3).astype(int).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]


def test_components_like_flood_fill():
    rng = np.random.default_rng(1)
    m = rng.random((40, 50)) < 0.45
    labels, boxes = R.components(m)
    seen, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        seen[y, x] = n
        while todo:
            a, b = todo.pop()
            for c in range(max(a - 1, 0), min(a + 2, 40)):
                for d in range(max(b - 1, 0), min(b + 2, 50)):
                    if m[c, d] and not seen[c, d]:
                        seen[c, d] = n
                        todo.append((c, d))
    assert n == len(boxes) and len({(a, b) for a, b in zip(labels[m], seen[m], strict=True)}) == n
    assert sum(b[4] for b in boxes) == m.sum()


def test_contours_of_shapes():
    m = np.zeros((60, 60), bool)
    m[10:31, 10:41] = True
    c = R.contours(m)[0]
    assert (c["x"], c["y"], c["w"], c["h"]) == (10, 10, 31, 21) and c["area"] == 30 * 20 and c["solidity"] == 1 and c["aspect"] == pytest.approx(31 / 21)
    m[10:31, 15:36] = False
    m[25:31, 10:41] = True
    assert R.contours(m)[0]["solidity"] < 0.7
    dot = np.zeros((5, 5), bool)
    dot[2, 2] = True
    assert R.contours(dot)[0]["area"] == 0


def test_merging_boxes(spark):
    assert R.merge_boxes([]) == []
    assert R.merge_boxes([(0, 0, 10, 10), (100, 0, 10, 10)]) == [(0, 0, 10, 10), (100, 0, 10, 10)]
    assert R.merge_boxes([(0, 0, 10, 10), (50, 0, 10, 10)]) == [(0, 0, 10, 10), (50, 0, 10, 10)]
    assert R.merge_boxes([(0, 0, 10, 10), (49, 0, 10, 10)]) == [(0, 0, 59, 10)]
    assert R.merge_boxes([(0, 0, 10, 10), (40, 0, 10, 10), (80, 0, 10, 10)]) == [(0, 0, 90, 10)]
    assert R.merge_boxes([(0, 0, 10, 10), (0, 200, 200, 10), (190, 45, 10, 120)]) == [(0, 0, 200, 210)]
    df = spark.createDataFrame([("p", 1, 0, 0, 10, 10, "a"), ("p", 2, 0, 0, 10, 10, "a"), ("p", 3, 40, 0, 10, 10, "a"), ("q", 4, 500, 0, 9, 9, "a")], "page string, seq int, x int, y int, w int, h int, b string")
    assert sorted(tuple(r) for r in vision.merged_boxes(df, ["page"]).collect()) == [("p", 0, 0, 50, 10), ("q", 500, 0, 9, 9)]


def test_gaps():
    p = np.array([0] * 10 + [5] * 10 + [0] * 7 + [5] * 3 + [0] * 8)
    assert R.gap_centres(p, 0, 8) == [5, 34]


def test_distances_and_splits():
    m = np.zeros((30, 30), bool)
    m[5:25, 5:25] = True
    d = R.distances(m)
    y, x = np.nonzero(~m)
    assert all(d[a, b] == pytest.approx(np.sqrt(((y - a) ** 2 + (x - b) ** 2).min())) for a, b in ((5, 5), (14, 14), (20, 7)))
    m = np.zeros((200, 400), bool)
    yy, xx = np.mgrid[0:200, 0:400]
    m |= (yy - 100) ** 2 + (xx - 100) ** 2 < 80**2
    m |= (yy - 100) ** 2 + (xx - 290) ** 2 < 80**2
    m[95:105, 100:290] = True
    got = sorted(R.watershed_split(m))
    assert len(got) == 2 and abs(got[0][0] - 21) < 4 and got[1][0] > 170
    g = np.zeros((400, 400), bool)
    g[10:180, 10:180] = g[10:180, 220:390] = g[220:390, 10:180] = True
    assert len(R.grid_split(g)) == 3 and R.grid_split(g[:90, :90]) == [] and R.watershed_split(np.zeros((5, 5), bool)) == []


def test_figures_of_a_plate(spark):
    a = plate(1100, 850, [((100, 100), (300, 300)), ((500, 100), (700, 350)), ((100, 700), (300, 1000)), ((400, 600), (404, 606))])
    assert sorted(tuple(r)[2:] for r in vision.plates(rows(spark, a)).collect()) == [(100, 100, 201, 201), (100, 700, 201, 301), (500, 100, 201, 251)]
    assert [tuple(r)[2:] for r in vision.plates(rows(spark, np.full((100, 90), 255, np.uint8))).collect()] == [(0, 0, 90, 100)]


def test_enhancing_keeps_range_and_shape():
    rng = np.random.default_rng(2)
    a = rng.integers(90, 120, (64, 100)).astype(np.uint8)
    b = R.clahe(a)
    assert b.shape == a.shape and b.dtype == np.uint8 and b.std() > a.std()
    assert (R.blur3(np.full((9, 9), 7, np.uint8)) == 7).all()
    assert R.resize(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2).tolist() == [[3, 5], [11, 13]]
    assert R.crop(a, (10, 10, 20, 10), 0.1).shape == (12, 24)


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(3)
    for a in (rng.integers(0, 256, (7, 9)).astype(np.uint8), rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)):
        assert (readers.decode(readers.encode_png(a)) == a).all()
    assert readers.decode(b"P5\n# note\n3 2\n255\n" + bytes(range(6))).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        readers.decode_png(b"GIF89a")
