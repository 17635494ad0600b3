import numpy as np
import pytest
from maskframe.operators import augment as G


def rows(spark, n=3):
    rng = np.random.default_rng(1)
    image, cube = np.full((20, 24, 3), 255, np.uint8), np.zeros((20, 24, 6), np.uint8)
    image[6:12, 5:9] = rng.integers(0, 90)
    cube[6:12, 5:9] = 1
    data = [(i, 20, 24, bytearray(image.tobytes()), bytearray(cube.tobytes())) for i in range(n)] + [(99, 20, 24, None, None)]
    return image, cube, spark.createDataFrame(data, "k int, height int, width int, rgb binary, cube binary")


def arrays(r):
    return np.frombuffer(r.rgb, np.uint8).reshape(20, 24, 3), np.frombuffer(r.cube, np.uint8).reshape(20, 24, 6)


def test_nothing_configured_changes_nothing(spark):
    image, cube, df = rows(spark)
    for r in G.augment(df, "k", {}).collect():
        assert (arrays(r)[0] == image).all() and (arrays(r)[1] == cube).all()


def test_image_and_masks_move_together(spark):
    _, _, df = rows(spark, 12)
    got = {r.k: arrays(r) for r in G.augment(df, "k", {"translate_px": 5, "scale_min": 0.9, "scale_max": 1.1}).collect()}
    assert set(got) == set(range(12)) and len({m.tobytes() for _, m in got.values()}) > 3
    for image, m in got.values():
        assert (m == m[..., :1]).all() and ((image[..., 0] < 170) == (m[..., 0] > 0)).mean() > 0.97
    again = {r.k: arrays(r) for r in G.augment(df.repartition(5), "k", {"translate_px": 5, "scale_min": 0.9, "scale_max": 1.1}).collect()}
    assert all((again[k][1] == got[k][1]).all() for k in got)


def test_looks_change_the_image_alone(spark):
    image, cube, df = rows(spark, 1)
    got, m = arrays(G.augment(
        df, "k", {"brightness_min": 0.5, "brightness_max": 0.5, "blur_probability": 1, "blur_radius_min": 1, "blur_radius_max": 1}
    ).first())
    assert (m == cube).all() and abs(int(got[0, 20, 0]) - 128) <= 1 and 0 < got[5, 6, 0] < 128


def test_turns_and_flips_are_refused():
    for bad in ({"rotation_deg": 2}, {"hflip_probability": 0.5}, {"scale_min": 0}, {"scale_min": 2, "scale_max": 1}):
        with pytest.raises(ValueError):
            G.settings(bad)
