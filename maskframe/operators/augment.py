"""

Direction channels change their meaning under turns and flips, so only shifts and one scale move pixels, alike in the
image and all masks; brightness, contrast and blur change the image alone. Every row draws from its own generator,
seeded by its id, so results do not depend on partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.operators.scoring import CHANNELS

DEFAULTS = {
    "translate_px": 0.0, "scale_min": 1.0, "scale_max": 1.0, "brightness_min": 1.0, "brightness_max": 1.0, "contrast_min": 1.0,
    "contrast_max": 1.0, "blur_probability": 0.0, "blur_radius_min": 0.1, "blur_radius_max": 1.0
}


def settings(config: Mapping[str, float]) -> dict[str, float]:
    """The ranges of ``config`` over the defaults; turns, flips and empty scale ranges raise."""
    if float(config.get("rotation_deg", 0)) or float(config.get("hflip_probability", 0)):
        raise ValueError("turns and flips would change what the direction channels mean")
    out = DEFAULTS | {k: float(v) for k, v in config.items() if k in DEFAULTS}
    if out["scale_min"] <= 0 or out["scale_max"] < out["scale_min"]:
        raise ValueError("the scale range must satisfy 0 < scale_min <= scale_max")
    return out


def moved(image: np.ndarray, cube: np.ndarray, scale: float, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """Image (bilinear, white outside) and cube (nearest, empty outside) scaled about the centre and shifted."""
    h, w = cube.shape[:2]
    y = (np.arange(h) + 0.5 - h / 2 - dy * scale) / scale + h / 2
    x = (np.arange(w) + 0.5 - w / 2 - dx * scale) / scale + w / 2
    inside = ((y >= 0) & (y < h))[:, None] & ((x >= 0) & (x < w))
    at = np.ix_(np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1))
    masks = np.where(inside[..., None], cube[at], 0).astype(np.uint8)
    fy, fx = np.clip(y - 0.5, 0, h - 1), np.clip(x - 0.5, 0, w - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1, wy, wx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (fy - y0)[:, None, None], (fx - x0)[None, :, None]
    top = image[np.ix_(y0, x0)] * (1 - wx) + image[np.ix_(y0, x1)] * wx
    low = image[np.ix_(y1, x0)] * (1 - wx) + image[np.ix_(y1, x1)] * wx
    return np.where(inside[..., None], top * (1 - wy) + low * wy, 255.0), masks


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur, rows and columns one after the other, edges repeated."""
    n = max(1, int(np.ceil(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    for axis in (0, 1):
        padded = np.pad(image, [(n, n) if a == axis else (0, 0) for a in range(3)], mode="edge")
        image = sum(v * np.take(padded, np.arange(i, i + image.shape[axis]), axis=axis) for i, v in enumerate(k / k.sum()))
    return image


def augment(rows: DataFrame, row_id: str, config: Mapping[str, float], seed: int = 0) -> DataFrame:
    """``row_id``, ``height``, ``width``, ``rgb``, ``cube`` changed at random within ``config``; rows with a null image or cube are left out."""
    c, kind = settings(config), rows.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, h, w, raw, cube in b.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(rid).encode())])
                image, m = np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(float), np.frombuffer(cube, np.uint8).reshape(h, w, len(CHANNELS))
                scale, (dx, dy) = rng.uniform(c["scale_min"], c["scale_max"]), rng.uniform(-c["translate_px"], c["translate_px"], 2)
                if (scale, dx, dy) != (1.0, 0.0, 0.0):
                    image, m = moved(image, m, scale, dx, dy)
                image = np.clip(image * rng.uniform(c["brightness_min"], c["brightness_max"]), 0, 255)
                mean = (image @ (0.299, 0.587, 0.114)).mean()
                image = np.clip(mean + (image - mean) * rng.uniform(c["contrast_min"], c["contrast_max"]), 0, 255)
                if rng.random() < c["blur_probability"]:
                    image = blurred(image, rng.uniform(c["blur_radius_min"], c["blur_radius_max"]))
                out.append((rid, h, w, np.rint(image).astype(np.uint8).tobytes(), np.ascontiguousarray(m).tobytes()))
            yield pd.DataFrame(out, columns=["_id", "height", "width", "rgb", "cube"])

    some = rows.where("rgb IS NOT NULL AND cube IS NOT NULL").select(F.col(row_id).alias("_id"), "height", "width", "rgb", "cube")
    return some.mapInPandas(run, f"_id {kind}, height int, width int, rgb binary, cube binary").withColumnRenamed("_id", row_id)
