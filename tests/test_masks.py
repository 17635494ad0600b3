import random

import numpy as np
import pytest
from maskframe.operators import bitmap as B
from maskframe.operators import masks as M
from maskframe.operators import metrics as T
from maskframe.operators import scoring as S
from pyspark.sql import functions as F


def pixels(spark, masks):
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "m string, y int, x int")


def grid(df, shape, name="a"):
    out = np.zeros(shape, bool)
    for r in df.collect():
        if r.m == name:
            out[r.y, r.x] = True
    return out


def dilated(m, r):
    out = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        out[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
    return out


def test_dilate_boundary_translate_against_arrays(spark):
    rng = np.random.default_rng(2)
    m = rng.random((9, 7)) < 0.6
    m[2:6, 1:6] = True
    df = pixels(spark, {"a": m})
    for r in (0, 1, 2):
        assert (grid(M.dilate(df, ["m"], r, 9, 7), m.shape) == dilated(m, r)).all()
    padded = np.pad(m, 1)
    eroded = np.logical_and.reduce([padded[dy : dy + 9, dx : dx + 7] for dy in range(3) for dx in range(3)])
    assert (grid(M.boundary(df, ["m"], 9, 7), m.shape) == (dilated(m, 1) & ~eroded)).all()
    assert (grid(M.translate(df, 2, -1, 9, 7), m.shape) == S.shift(m, 2, -1)).all()


def test_negative_radius(spark):
    with pytest.raises(ValueError, match="non-negative"):
        M.dilate(pixels(spark, {"a": np.ones((2, 2))}), ["m"], -1, 2, 2)


def test_keypoint_one_pixel_off(spark):
    p, t = np.zeros((5, 5)), np.zeros((5, 5))
    p[2, 3] = t[2, 2] = 1
    a, b = pixels(spark, {"a": p}), pixels(spark, {"a": t})
    f1 = [M.tolerant_scores(M.tolerant_counts(a, b, ["m"], r, 5, 5)).first().f1 for r in (0, 1)]
    assert f1 == [0.0, 1.0]


def test_confusion_values_and_empty_conventions(spark):
    rows = [("a", True, True)] * 4 + [("b", True, False)] + [("a", False, False)] * 12 + [("c", False, False)]
    s = {r.ch: r for r in T.scores(T.confusion(
        spark.createDataFrame(rows, "ch string, p boolean, t boolean"), ["ch"], F.col("p"), F.col("t")
    )).collect()}
    assert (s["a"].tp, s["a"].fp, s["b"].fp, s["a"].dice, s["b"].dice, s["c"].dice) == (4, 0, 1, 1.0, 0.0, 0.0)
    o = spark.createDataFrame([(0, 0, 0)], "shared long, only_a long, only_b long")
    assert M.pair_scores(o).first().dice == 1.0


def test_components(spark):
    m = np.zeros((8, 8), bool)
    m[1:3, 2:4] = True
    m[6, 6] = True
    (area, cx, cy, *_), *rest = B.component_rows(m, 2)
    assert (area, cx, cy, rest) == (4, 2.5, 1.5, [])
    points = B.keypoints(pixels(spark, {"k": m}).withColumn("p", F.col("x") / 10), ["m"], 8, 8, 1, "p").orderBy("place").collect()
    assert [(p.x, p.y, p.area, p.confidence) for p in points] == [(2.5, 1.5, 4, 0.3), (6.0, 6.0, 1, 0.6)]
    v = np.zeros((20, 20), bool)
    v[2:7, 2:5] = v[12:16, 9:14] = True
    w = np.zeros((20, 20), bool)
    w[4:9, 4:9] = True
    got = B.number_regions(B.components(pixels(spark, {"vec1": v, "vec2": w}), ["m"], 20, 20, 8), "m").orderBy("region_id").collect()
    assert [r.region_id for r in got] == ["vec1_001", "vec1_002", "vec2_001"]
    assert (got[0].left, got[0].top, got[0].right, got[0].bottom) == (2, 2, 5, 7)


def test_alignment_of_a_shifted_shape(spark):
    u, r = np.zeros((64, 64), bool), np.zeros((64, 64), bool)
    u[24:40, 30:38] = r[8:24, 10:18] = True
    got = M.align_by_centroid(pixels(spark, {"a": u}), pixels(spark, {"a": r}), ["m"], 64, 64).first()
    assert (got.dy, got.dx, got.iou) == (16, 20, 1.0)
    assert S.align(u, np.zeros_like(u)) is None and S.align(u, r)["align_iou"] == 1.0


def test_letterbox_round_trip():
    m = np.random.default_rng(1).random((40, 60)) < 0.5
    box = B.letterbox(m, 120)
    assert box.shape == (120, 120) and not box[:20].any()
    assert ((B.unletterbox(box.astype(float), 40, 60) > 0.5) == m).mean() > 0.9


def test_calibration_and_epochs(spark):
    rng = random.Random(1)
    rows = [(c, rng.random(), rng.random() < 0.4) for c in "ab" for _ in range(200)]
    got = {r.ch: r for r in T.calibrate(spark.createDataFrame(rows, "ch string, p double, t boolean"), "ch", "p", "t").collect()}
    for c in "ab":
        best = (-1.0, 0.0)
        for i in range(17):
            th = 0.10 + i * (0.90 - 0.10) / 16
            tp = sum(p >= th and t for k, p, t in rows if k == c)
            d = 2 * tp / max(1, sum(p >= th for k, p, _ in rows if k == c) + sum(t for k, _, t in rows if k == c))
            best = max(best, (d, -th))
        assert (round(best[0], 9), round(-best[1], 6)) == (got[c].dice, got[c].threshold)
    s = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 3.0, 3.0, 2.0, 2.5, 9.0])], "k string, e int, v double")
    assert tuple(T.best_epoch(s, ["k"], "e", "v", 3).first()) == ("r", 1, 3.0, 5)


def flood(m):
    """Components by repeated spreading of the least label."""
    out = np.where(m, np.arange(m.size).reshape(m.shape), m.size)
    while True:
        p = np.pad(out, 1, constant_values=m.size)
        new = np.where(m, np.minimum.reduce([p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3)]), m.size)
        if (new == out).all():
            return out
        out = new


def test_labels_against_spreading():
    rng = np.random.default_rng(5)
    for _ in range(60):
        m = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < rng.random()
        got, n = B.label(m)
        want = flood(m)
        names = sorted(set(want[m].tolist()))
        assert n == len(names) and (got[m] == np.searchsorted(names, want[m]) + 1).all() and not got[~m].any()
