"""

A cube is ``height * width * 6`` bytes, channels last. Alignment tries 63 scales and turns on each pair and is the
one step that SQL would only do by exploding every pixel 63 times; it runs row by row in Arrow batches, so any
number of pairs is one pass without a shuffle. Everything after alignment is also available on pixel relations,
in :mod:`maskframe.operators.masks`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Channel order of a cube (fixed values): five directions, then keypoints.
CHANNELS = ["vec1", "vec2", "vec3", "vec4", "vec5", "keypoint"]
DIRECTIONS = CHANNELS[:5]
#: Candidates of the alignment, in the order in which the first of equals wins (fixed values).
SCALES = np.linspace(0.80, 1.20, 9)
TURNS = np.linspace(-3.0, 3.0, 7)
#: Weights of mean direction Dice, ink IoU and keypoint F1, and the keypoints' tolerance (fixed values).
WEIGHTS, RADIUS = (0.55, 0.25, 0.20), 3


def geometry(height: int, width: int, scale: float, turn: float) -> tuple[int, int, int, int, float, float]:
    """Scaled height and width, the offsets that centre them, and cosine and sine of the turn."""
    sh, sw = max(1, round(height * scale)), max(1, round(width * scale))
    t = np.deg2rad(turn)
    return sh, sw, (height - sh) // 2, (width - sw) // 2, float(np.cos(t)), float(np.sin(t))


@lru_cache(maxsize=128)
def _source(height: int, width: int, scale: float, turn: float) -> np.ndarray:
    """[M7] For each canvas pixel the pixel it shows after a nearest-neighbour scale and turn about the centre; ``height * width`` for none."""
    sh, sw, oy, ox, c, s = geometry(height, width, scale, turn)
    dy, dx = np.arange(height)[:, None] + 0.5 - height / 2, np.arange(width)[None, :] + 0.5 - width / 2
    y = np.floor(s * dx + c * dy + height / 2).astype(np.int64) - oy
    x = np.floor(c * dx - s * dy + width / 2).astype(np.int64) - ox
    there = (y >= 0) & (y < sh) & (x >= 0) & (x < sw) & (y + oy >= 0) & (y + oy < height) & (x + ox >= 0) & (x + ox < width)
    at = np.floor((y + 0.5) * height / sh).astype(np.int64) * width + np.floor((x + 0.5) * width / sw).astype(np.int64)
    return np.where(there, at, height * width).astype(np.int32)


def scale_turn(mask: np.ndarray, scale: float, turn: float) -> np.ndarray:
    """[M7] Isotropic scale and turn about the centre of a mask or cube, nearest neighbour."""
    h, w = mask.shape[:2]
    flat = np.concatenate([mask.reshape(h * w, -1), np.zeros((1, mask[0, 0].size), mask.dtype)])
    return flat[_source(h, w, scale, turn)].reshape(mask.shape)


def shift(mask: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """[M6] Integer shift of a mask or cube, clipped to the canvas."""
    out = np.zeros_like(mask)
    h, w = mask.shape[:2]
    ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    yt, xt = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    if ys.start < ys.stop and xs.start < xs.stop:
        out[ys, xs] = mask[yt, xt]
    return out


def widen(mask: np.ndarray, radius: int) -> np.ndarray:
    """[M5] Square dilation, rows and columns one after the other."""
    for axis in (0, 1):
        mask = np.logical_or.reduce([shift(mask, *((d, 0) if axis == 0 else (0, d))) for d in range(-radius, radius + 1)])
    return mask


def ink(cube: np.ndarray) -> np.ndarray:
    """[A10] Union of the direction channels."""
    return cube[..., : len(DIRECTIONS)].any(axis=-1)


def center(mask: np.ndarray) -> tuple[float, float]:
    """[A13] Mean x and y."""
    y, x = np.nonzero(mask)
    return float(x.mean()), float(y.mean())


def align(user: np.ndarray, reference: np.ndarray) -> dict | None:
    """[M8, J11, O10] Scale, turn and centroid shift of the reference ink that give the best IoU with the user's, first of equals.

    Candidates whose ink leaves the canvas are passed over; None where none is left or either ink is empty.
    """
    best = None
    if not user.any() or not reference.any():
        return None
    h, w = user.shape
    ux, uy = center(user)
    for s in map(float, SCALES):
        for t in map(float, TURNS):
            m = scale_turn(reference, s, t)
            if not m.any():
                continue
            mx, my = center(m)
            dx, dy = round(ux - mx), round(uy - my)
            m = shift(m, dy, dx)
            iou = float((m & user).sum() / max(1, (m | user).sum()))
            if best is None or iou > best["align_iou"]:
                best = {"scale": s, "turn": t, "dx": dx, "dy": dy, "align_iou": iou}
    return best


def tolerant_f1(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> float:
    """[A14] F1 with a tolerance: 1 for two empty masks, 0 for one."""
    if not a.any() or not b.any():
        return float(a.any() == b.any())
    p, r = (a & widen(b, radius)).sum() / a.sum(), (b & widen(a, radius)).sum() / b.sum()
    return float(2 * p * r / max(1e-8, p + r))


def evidence(user: np.ndarray, reference: np.ndarray) -> tuple[dict, np.ndarray | None]:
    """[A15, M15] Evidence of one pair of cubes and the aligned reference; ``status`` tells why there is none."""
    if user.shape != reference.shape or user.ndim != 3 or user.shape[-1] != len(CHANNELS):
        return {"status": "bad_shape"}, None
    ui, ri = ink(user), ink(reference)
    how = align(ui, ri)
    if how is None:
        return {"status": "empty_mask"}, None
    (ux, uy), (rx, ry) = center(ui), center(ri)
    diagonal = float(np.hypot(*ui.shape))
    moved = shift(scale_turn(reference, how["scale"], how["turn"]), how["dy"], how["dx"])

    def pair(a: np.ndarray, b: np.ndarray, twice: bool) -> float:
        both, n = int((a & b).sum()), int(a.sum() + b.sum())
        return 1.0 if n == 0 else 2 * both / n if twice else both / (n - both)

    dice = [pair(user[..., i], moved[..., i], True) for i in range(len(DIRECTIONS))]
    macro, iou, f1 = sum(dice) / len(dice), pair(ui, ink(moved), False), tolerant_f1(user[..., 5], moved[..., 5])
    out = {
        "status": "ok", "score": 100 * (WEIGHTS[0] * macro + WEIGHTS[1] * iou + WEIGHTS[2] * f1), "macro_dice": macro, "ink_iou": iou, "keypoint_f1": f1,
        "center_distance_pixels": float(np.hypot(ux - rx, uy - ry)), "center_distance": float(np.hypot(ux - rx, uy - ry)) / diagonal,
        "offset_x_pixels": ux - rx, "offset_y_pixels": uy - ry, "offset_x": (ux - rx) / diagonal, "offset_y": (uy - ry) / diagonal,
        "area_ratio": float(ri.sum() / max(1, ui.sum())), **how, **{f"dice_{c}": d for c, d in zip(DIRECTIONS, dice)},
    }
    return out, moved


NUMBERS = [
    "score", "macro_dice", "ink_iou", "keypoint_f1", *[f"dice_{c}" for c in DIRECTIONS], "center_distance_pixels", "center_distance",
    "offset_x_pixels", "offset_y_pixels", "offset_x", "offset_y", "area_ratio", "scale", "turn", "align_iou",
]
EVIDENCE = ", ".join(["status string", *[f"{c} double" for c in NUMBERS], "dx int", "dy int", "aligned binary"])


def score_pairs(pairs: DataFrame, by: list[str], user: str, reference: str) -> DataFrame:
    """[A15, M8, M14, M15] Evidence of every row of ``pairs``: two cubes of bytes with ``height`` and ``width``.

    Returns ``by`` and the columns of ``EVIDENCE``; ``status`` is ``ok``, ``bad_shape`` for cubes that are null or
    of another size than the canvas, or ``empty_mask``; numbers are null for the last two. Repeated rows are scored
    each for itself; other columns do not matter.
    """
    names = ["status", *NUMBERS, "dx", "dy", "aligned"]
    kinds = ", ".join(f"_k{i} {pairs.schema[c].dataType.simpleString()}" for i, c in enumerate(by))

    def cube(raw: bytes | None, h, w) -> np.ndarray:
        if raw is None or pd.isna(h) or pd.isna(w) or len(raw) != int(h) * int(w) * len(CHANNELS):
            return np.zeros(0, bool)
        return np.frombuffer(raw, np.uint8).reshape(int(h), int(w), len(CHANNELS)) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, h, w, u, r in zip(b[[f"_k{i}" for i in range(len(by))]].itertuples(index=False), b["_h"], b["_w"], b["_u"], b["_r"]):
                got, moved = evidence(cube(u, h, w), cube(r, h, w))
                rows.append((*key, *[got.get(n) for n in names[:-1]], None if moved is None else moved.astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=[*b.columns[: len(by)], *names])
            yield out.astype({"dx": "Int32", "dy": "Int32", **{n: "float64" for n in NUMBERS}})

    cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] + [
        F.col("height").alias("_h"), F.col("width").alias("_w"), F.col(user).alias("_u"), F.col(reference).alias("_r")
    ]
    return pairs.select(*cols).mapInPandas(run, f"{kinds}, {EVIDENCE}").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(by)})


def rasterize_cubes(pixels: DataFrame, by: list[str], height: int, width: int, channel: str = "channel") -> DataFrame:
    """[D5 to D4] One row for each mask: ``by``, ``height``, ``width``, ``cube``. Pixels of other channels or off the canvas are left out.

    Pixels come down to one for each place, with a bit for each channel, before they meet in a row; that is bounded by the canvas.
    """
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(1 << i))]), F.col(channel))
    inside = pixels.where(F.col(channel).isin(CHANNELS) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    places = inside.groupBy(*by, "y", "x").agg(F.bit_or(bit).alias("_bits"))
    kinds = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cube = np.zeros((height, width, len(CHANNELS)), np.uint8)
        cube[pdf["y"], pdf["x"]] = (pdf["_bits"].to_numpy()[:, None] >> np.arange(len(CHANNELS))) & 1
        return pd.DataFrame([(*key, height, width, cube.tobytes())], columns=[*by, "height", "width", "cube"])

    return places.groupBy(*by).applyInPandas(run, f"{kinds}, height int, width int, cube binary")


def cube_pixels(cubes: DataFrame, by: list[str], cube: str) -> DataFrame:
    """[D4 to D5] The set pixels of cubes: ``by``, ``channel``, ``y``, ``x``."""
    kinds = ", ".join(f"_k{i} {cubes.schema[c].dataType.simpleString()}" for i, c in enumerate(by))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                *key, h, w, raw = row
                if raw is not None:
                    y, x, c = np.nonzero(np.frombuffer(raw, np.uint8).reshape(h, w, len(CHANNELS)))
                    keys = {f"_k{i}": np.repeat(np.array([v], object), len(y)) for i, v in enumerate(key)}
                    yield pd.DataFrame({**keys, "channel": np.array(CHANNELS, object)[c], "y": y.astype(np.int32), "x": x.astype(np.int32)})

    cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] + [F.col("height"), F.col("width"), F.col(cube).alias("_c")]
    return cubes.select(*cols).mapInPandas(run, f"{kinds}, channel string, y int, x int").withColumnsRenamed({f"_k{i}": c for i, c in enumerate(by)})


def match_band(score: Column) -> Column:
    """[P15] Band of a score (fixed values)."""
    return F.when(score >= 90, "high_reference_match").when(score >= 70, "moderate_reference_match").when(score.isNotNull(), "low_reference_match")


def worst_direction(dice: list[tuple[str, Column]]) -> Column:
    """[A19] Struct ``channel``, ``dice`` of the least Dice, the first of equals; ``vec1`` with 1 where there is none."""
    entries = F.array_compact(F.array(*[
        F.when(d.isNotNull(), F.struct(d.alias("dice"), F.lit(i).alias("i"), F.lit(c).alias("channel"))) for i,
        (c, d) in enumerate(dice)
    ]))
    least = F.array_min(entries)
    return F.struct(F.coalesce(least["channel"], F.lit("vec1")).alias("channel"), F.coalesce(least["dice"], F.lit(1.0)).alias("dice"))
