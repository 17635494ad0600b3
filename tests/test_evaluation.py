import io

import numpy as np
import pytest
from maskframe.operators import evaluation as E
from maskframe.operators import scoring as S
from maskframe.sources import masks as N
from pyspark.sql import functions as F


def long(spark, cubes):
    rows = [(k, S.CHANNELS[c], int(y), int(x)) for k, m in cubes.items() for y, x, c in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "k int, channel string, y int, x int")


def figures(df):
    return {(r.metric, r.channel, r.radius): r.value for r in df.collect()}


def edges(m):
    p = np.pad(m, 1)
    near = [p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3)]
    return np.logical_or.reduce(near) ^ np.logical_and.reduce(near)


def test_channels_score_independently(spark):
    t, p = np.zeros((4, 4, 6), bool), np.zeros((4, 4, 6), bool)
    t[1:3, 1:3, 0] = p[1:3, 1:3, 0] = True
    p[0, 0, 1] = True
    got = {r.channel: r for r in E.evaluate_channels(long(spark, {1: p}), long(spark, {1: t}), ["k"], 4, 4).collect()}
    assert (got["vec1"].tp, got["vec1"].fp, got["vec2"].fp, got["vec1"].dice, got["vec2"].dice, got["vec3"].dice) == (4, 0, 1, 1.0, 0.0, 0.0)
    assert len(got) == 6


def test_random_masks_against_arrays(spark):
    rng = np.random.default_rng(1)
    p, t = ({k: rng.random((9, 8, 6)) < q for k, q in enumerate((0.3, 0.5))} for _ in range(2))
    for m in (*p.values(), *t.values()):
        m[..., 3] = False
    got = figures(E.evaluate(long(spark, p), long(spark, t), ["k"], 9, 8, [0, 1, 1]))
    div = lambda a, b: a / b if b else 0.0
    dice, bf = [], []
    for i in range(6):
        tp, fp, fn = (sum(f(p[k][..., i], t[k][..., i]).sum() for k in p) for f in (lambda a, b: a & b, lambda a, b: a & ~b, lambda a, b: ~a & b))
        dice.append(div(2 * tp, 2 * tp + fp + fn))
        b = [(edges(p[k][..., i]), edges(t[k][..., i])) for k in p]
        btp, brest = sum((x & y).sum() for x, y in b), sum((x ^ y).sum() for x, y in b)
        bf.append(div(2 * btp, 2 * btp + brest))
        assert got["dice", S.CHANNELS[i], None] == pytest.approx(dice[i]) and got["boundary_f1", S.CHANNELS[i], None] == pytest.approx(bf[i])
    assert got["macro_dice", None, None] == pytest.approx(np.mean(dice[:5])) and got["macro_boundary_f1", None, None] == pytest.approx(np.mean(bf[:5])) and got["keypoint_f1", None, None] == pytest.approx(dice[5])
    hit = sum((p[k][..., 5] & S.widen(t[k][..., 5], 1)).sum() for k in p)
    assert got["keypoint_precision", "keypoint", 1] == pytest.approx(hit / sum(p[k][..., 5].sum() for k in p))


def test_keypoint_one_pixel_off(spark):
    p, t = np.zeros((5, 5, 6)), np.zeros((5, 5, 6))
    p[2, 3, 5] = t[2, 2, 5] = 1
    got = figures(E.evaluate(long(spark, {1: p}), long(spark, {1: t}), ["k"], 5, 5, [0, 1]))
    assert (got["keypoint_tolerant_f1", "keypoint", 0], got["keypoint_tolerant_f1", "keypoint", 1]) == (0.0, 1.0)


def test_nothing_to_evaluate(spark):
    none = spark.createDataFrame([], "k int, channel string, y int, x int")
    assert set(figures(E.evaluate(none, none, ["k"], 5, 5, [1])).values()) == {0.0}


def test_thresholds(spark):
    at = E.thresholds({"keypoint": 0.45}, {"best_thresholds": {"vec1": 0.7, "other": 1}})
    assert at == {
        "vec1": 0.7, "vec2": 0.5, "vec3": 0.5, "vec4": 0.5, "vec5": 0.5, "keypoint": 0.45
    } and E.thresholds(None, {"vec2": 0.2})["vec2"] == 0.2
    df = spark.createDataFrame(
        [("vec1", 0.7), ("vec1", 0.69), ("vec2", 0.5), ("x", 1.0), ("vec3", None)], "channel string, p double"
    ).withColumn("p", F.col("p").cast("float"))
    assert [r.channel for r in E.above_threshold(df, at).collect()] == ["vec1", "vec2"]  # 0.7 as a float reaches 0.7 as a float


def test_hard_scores_and_weights(spark):
    m = np.zeros((10, 10, 6))
    m[:4, :5, 0] = 1
    m[:2, :5, 1] = 1
    m[9, 9, 5] = 1
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, reason0 string")
    got = {r.k: (r.hard_score, r.reason) for r in E.hard_scores(rows, long(spark, {1: m}), ["k"]).collect()}
    assert got[1][0] == pytest.approx(100 * 10 / 20 + 4 * 2 + min(200 / 20, 8)) and got[2] == (0.0, E.UNREADABLE_NOTE) and "50.0%" in got[1][1]
    sizes = spark.createDataFrame([(1, 10, 10), (2, 10, 10)], "k int, height int, width int")
    w = {r.channel: (r.positives, r.weight) for r in E.direction_weights(sizes, long(spark, {1: m, 3: m}), ["k"]).collect()}
    assert w["vec1"] == (20, 9.0) and w["vec2"] == (10, 19.0) and w["vec3"] == (0, 100.0)


def test_eligible(spark):
    m = spark.createDataFrame(
        [("a", "true", ""), ("b", "1", None), ("c", "true", "x"), ("d", "yes", ""), ("e", "false", "")],
        "sample_id string, has_all_masks string, errors string"
    )
    s = spark.createDataFrame([("a", "test"), ("b", "val"), ("c", "test"), ("d", "train"), ("e", "val")], "sample_id string, split string")
    assert sorted((r.sample_id, r.split) for r in E.eligible(m, s).collect()) == [("a", "test"), ("b", "val")]


def npy(a):
    f = io.BytesIO()
    np.save(f, a)
    return bytearray(f.getvalue())


def test_masks_from_array_files(spark):
    files, rows = [], []
    for k in "abcde":
        for i, c in enumerate(S.CHANNELS):
            a = np.full((3, 4), i == 2, np.float32)
            if (k, i) == ("b", 3):
                a = np.zeros((4, 4))
            if (k, i) == ("c", 3):
                a = np.zeros((3, 4, 1))
            if (k, i) != ("d", 1):
                files.append((f"file:/r/{k}/{c}.npy", npy(a) if (k, i) != ("e", 0) else bytearray(b"no")))
        rows.append((k, *[f"/r/{k}/{c}.npy" for c in S.CHANNELS]))
    rows.append(("f", None, *[""] * 5))
    m = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{c}_path string" for c in S.CHANNELS))
    got = {r.sample_id: r for r in N.load_masks(m.unionByName(m), spark.createDataFrame(files, "path string, content binary"), "sample_id").collect()}
    assert {k for k, r in got.items() if r.cube is None} == set("bcdef") and (got["a"].height, got["a"].width) == (3, 4)
    assert np.frombuffer(got["a"].cube, np.uint8).reshape(3, 4, 6).sum(axis=(0, 1)).tolist() == [0, 0, 12, 0, 0, 0]


def test_mask_caches(spark, tmp_path):
    m = (np.random.default_rng(1).random((5, 6, 6)) < 0.5).astype(np.uint8)
    np.savez_compressed(tmp_path / "good.npz", binary_masks=m, channels=np.asarray(S.CHANNELS))
    np.savez_compressed(tmp_path / "order.npz", binary_masks=m, channels=np.asarray(S.CHANNELS[::-1]))
    (tmp_path / "bad.npz").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r for r in N.load_caches(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "good.npz": "ok", "order.npz": "bad_channels", "bad.npz": "unreadable"
    } and bytes(got["good.npz"].cube) == m.tobytes()
    cubes = spark.createDataFrame(
        [("r1", "s", "永", 5, 6, bytearray(m.tobytes()))],
        "reference_id string, style_id string, target_char string, height int, width int, cube binary"
    )
    N.write_mask_cache(cubes, str(tmp_path / "cache"), "abc")
    assert N.read_mask_cache(spark, str(tmp_path / "cache"), "abc").where("style_id = 's'").count() == 1 and N.read_mask_cache(spark, str(tmp_path / "cache"), "x").count() == 0


def test_resizing(spark):
    m = (np.random.default_rng(1).random((40, 60, 6)) < 0.5).astype(np.uint8)
    df = spark.createDataFrame([(1, 40, 60, bytearray(m.tobytes())), (2, 40, 60, None)], "k int, height int, width int, cube binary")
    got = {r.k: r for r in N.letterbox_cubes(df, ["k"], 120).collect()}
    box = np.frombuffer(got[1].cube, np.uint8).reshape(120, 120, 6)
    assert not box[:20].any() and (box[20:100:2, ::2] == m).all() and got[2].cube is None
    probs = spark.createDataFrame(
        [(1, 120, 120, 40, 60, bytearray(box.astype(np.float32).tobytes()))],
        "k int, height int, width int, original_height int, original_width int, probabilities binary"
    )
    back = N.restore_probabilities(probs, ["k"])
    cubes = N.threshold_cubes(back, ["k"], dict.fromkeys(S.CHANNELS, 0.5)).first()
    assert (cubes.height, cubes.width) == (40, 60) and (np.frombuffer(cubes.probabilities, np.uint8).reshape(40, 60, 6) == m).mean() > 0.9
    white = spark.createDataFrame([(1, 2, 4, bytearray(b"\xff" * 24))], "k int, height int, width int, rgb binary")
    image = np.frombuffer(N.letterbox_images(white, ["k"], 8).first().rgb, np.uint8).reshape(8, 8, 3)
    assert image[2:6].min() == 255 and image[:2].max() == 0 and image[6:].max() == 0


def test_white_pixel(spark):
    df = spark.createDataFrame([([255, 255, 255, 0, 0, 0],), ([],), (None,)], "px array<int>")
    r = df.select(*[c.alias(n) for c, n in zip(N.normalize_rgb(F.col("px")), "rgb")]).collect()
    assert r[0].r == pytest.approx([(1 - 0.485) / 0.229, -0.485 / 0.229]) and r[0].b == pytest.approx([(1 - 0.406) / 0.225, -0.406 / 0.225]) and not r[1].r and not r[2].r
    assert df.select(N.normalize_rgb(F.col("px"), False)[1]).first()[0] == [1.0, 0.0]
