
from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.bitmap import letterbox, unletterbox
from maskframe.operators.scoring import CHANNELS

#: Means and deviations of the three colours (fixed values).
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def local_path(c: Column) -> Column:
    """A path without its ``file:`` scheme."""
    return F.regexp_replace(c, "^file:/+", "/")


def _array(content: bytes) -> np.ndarray | None:
    try:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        return a if isinstance(a, np.ndarray) and a.ndim == 2 else None
    except (OSError, ValueError, EOFError):
        return None


def load_masks(manifest: DataFrame, files: DataFrame, row_id: str) -> DataFrame:
    """[S7] ``row_id``, ``height``, ``width``, ``cube`` of every manifest row from its six array files (``path``, ``content``).

    A cell is set where the array is above zero. The cube is null where a path is blank or missing, a file is
    unreadable or not two-dimensional, or shapes differ. Files are decoded before they meet their rows.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                a = _array(bytes(content))
                if a is not None:
                    rows.append((path, *a.shape, (a > 0).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "mask"])

    masks = files.select(local_path(F.col("path")).alias("path"), "content").mapInPandas(decode, "path string, h int, w int, mask binary")
    want = manifest.select(
        row_id,
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.trim(f"{c}_path").alias("path")) for i, c in enumerate(CHANNELS)])).alias("x")
    ).select(row_id, "x.i", local_path(F.col("x.path")).alias("path"))
    # A manifest may name a row more than once; six masks of each are enough.
    found = want.distinct().join(masks, "path").groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("i", "h", "w", "mask"))).alias("m"))
    kind = manifest.schema[row_id].dataType.simpleString()

    def stack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, m in zip(b["_k"], b["m"]):
                if [x["i"] for x in m] == list(range(len(CHANNELS))) and len({(x["h"], x["w"]) for x in m}) == 1:
                    h, w = m[0]["h"], m[0]["w"]
                    rows.append((key, h, w, np.stack([np.frombuffer(x["mask"], np.uint8).reshape(h, w) for x in m], axis=-1).tobytes()))
            yield pd.DataFrame(rows, columns=["_k", "height", "width", "cube"])

    cubes = found.select(F.col(row_id).alias("_k"), "m").mapInPandas(
        stack, f"_k {kind}, height int, width int, cube binary"
    ).withColumnRenamed("_k", row_id)
    return manifest.select(row_id).distinct().join(cubes, row_id, "left")


def load_caches(spark: SparkSession, path: str) -> DataFrame:
    """[S8] ``path``, ``status``, ``height``, ``width``, ``cube`` of cached mask archives; ``status`` is ``ok``, ``bad_channels`` or ``unreadable``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                try:
                    with np.load(io.BytesIO(bytes(content)), allow_pickle=False) as z:
                        names, cube = [str(c) for c in z["channels"].tolist()], np.asarray(z["binary_masks"]) > 0
                except (OSError, ValueError, KeyError, EOFError, zipfile.BadZipFile):
                    rows.append((p, "unreadable", None, None, None))
                    continue
                good = names == CHANNELS and cube.ndim == 3 and cube.shape[-1] == len(CHANNELS)
                rows.append((p, "ok", *cube.shape[:2], cube.astype(np.uint8).tobytes()) if good else (p, "bad_channels", None, None, None))
            yield pd.DataFrame(rows, columns=["path", "status", "height", "width", "cube"]).astype({"height": "Int32", "width": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npz").load(path)
    return files.select(local_path(F.col("path")).alias("path"), "content").mapInPandas(
        run, "path string, status string, height int, width int, cube binary"
    )


def write_mask_cache(cubes: DataFrame, path: str, checkpoint: str = "") -> None:
    """[K7, K3] The cache as a table by style: ``reference_id``, ``style_id``, ``target_char``, ``height``, ``width``, ``cube`` and the hash of the model's checkpoint.

    Styles differ widely in size, so each is spread over files by its references.
    """
    cols = ["reference_id", "style_id", "target_char", "height", "width", "cube"]
    cubes.select(*cols, F.lit(checkpoint).alias("checkpoint_sha256")).write.mode("overwrite").partitionBy("style_id").parquet(path)


def read_mask_cache(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame:
    """[K7] The cache; with ``checkpoint`` only what was made by that model."""
    c = spark.read.parquet(path)
    return c if checkpoint is None else c.where(F.col("checkpoint_sha256") == checkpoint)


def _resized(rows: DataFrame, by: list[str], column: str, make: Callable[[pd.Series], tuple[int, int, bytes] | None], extra: list[str]) -> DataFrame:
    """``by``, ``height``, ``width`` and ``column`` made anew from each row; null where ``column`` is."""
    kinds = ", ".join(f"_k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(by))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                got = None if row[len(by)] is None else make(*row[len(by) :])
                out.append((*row[: len(by)], *(got or (None, None, None))))
            yield pd.DataFrame(out, columns=[*b.columns[: len(by)], "height", "width", column]).astype({"height": "Int32", "width": "Int32"})

    cols = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] + [
        F.col(column).alias("_c"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(["height", "width", *extra])]
    ]
    return rows.select(*cols).mapInPandas(
        run, f"{kinds}, height int, width int, {column} binary"
    ).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(by)})


def letterbox_cubes(cubes: DataFrame, by: list[str], size: int, cube: str = "cube") -> DataFrame:
    """[M2] Cubes on a square canvas, nearest neighbour, centred on zeros."""

    def make(raw: bytes, h: int, w: int) -> tuple[int, int, bytes]:
        m = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), len(CHANNELS))
        return size, size, np.stack([letterbox(m[..., i], size) for i in range(m.shape[-1])], axis=-1).tobytes()

    return _resized(cubes, by, cube, make, [])


def letterbox_images(images: DataFrame, by: list[str], size: int, image: str = "rgb") -> DataFrame:
    """[M1] RGB images (three bytes a pixel) on a square canvas of black, bilinear."""

    def make(raw: bytes, h: int, w: int) -> tuple[int, int, bytes]:
        a = np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3)
        s = min(size / w, size / h)
        nw, nh = max(1, round(w * s)), max(1, round(h * s))
        out, top, left = np.zeros((size, size, 3), np.uint8), (size - nh) // 2, (size - nw) // 2
        out[top : top + nh, left : left + nw] = np.rint(np.stack([_bilinear(a[..., i], nh, nw) for i in range(3)], axis=-1)).astype(np.uint8)
        return size, size, out.tobytes()

    return _resized(images, by, image, make, [])


def _bilinear(a: np.ndarray, h: int, w: int) -> np.ndarray:
    fy, fx = np.clip(
        (np.arange(h) + 0.5) * a.shape[0] / h - 0.5, 0, a.shape[0] - 1
    ), np.clip((np.arange(w) + 0.5) * a.shape[1] / w - 0.5, 0, a.shape[1] - 1)
    y, x = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y + 1, a.shape[0] - 1), np.minimum(x + 1, a.shape[1] - 1)
    wy, wx = (fy - y)[:, None], fx - x
    a = a.astype(float)
    return (a[y[:, None], x] * (1 - wx) + a[y[:, None], x1] * wx) * (1 - wy) + (a[y1[:, None], x] * (1 - wx) + a[y1[:, None], x1] * wx) * wy


def restore_probabilities(squares: DataFrame, by: list[str], probabilities: str = "probabilities") -> DataFrame:
    """[M11] Square canvases of six 32-bit probabilities a pixel, brought back to ``original_height`` and ``original_width``, bilinear."""

    def make(raw: bytes, h: int, w: int, oh: int, ow: int) -> tuple[int, int, bytes]:
        p = np.frombuffer(raw, np.float32).reshape(int(h), int(w), len(CHANNELS))
        return int(oh), int(ow), np.stack(
            [unletterbox(p[..., i], int(oh), int(ow)) for i in range(p.shape[-1])], axis=-1
        ).astype(np.float32).tobytes()

    return _resized(squares, by, probabilities, make, ["original_height", "original_width"])


def threshold_cubes(squares: DataFrame, by: list[str], limits: dict[str, float], probabilities: str = "probabilities") -> DataFrame:
    """[P11] Probability canvases as cubes, compared with each channel's threshold in 32-bit floats (column name kept)."""
    at = np.array([limits[c] for c in CHANNELS], np.float32)

    def make(raw: bytes, h: int, w: int) -> tuple[int, int, bytes]:
        return int(h), int(w), (np.frombuffer(raw, np.float32).reshape(int(h), int(w), len(CHANNELS)) >= at).astype(np.uint8).tobytes()

    return _resized(squares, by, probabilities, make, [])


def normalize_rgb(pixels: Column, imagenet: bool = True) -> list[Column]:
    """[M12] Three columns of floats from an array of RGB bytes in row order: each over 255, then by the colour's mean and deviation."""

    def plane(i: int) -> Column:
        part = F.transform(F.sequence(F.lit(0), (F.size(pixels) / 3).cast("int") - 1), lambda k: F.get(pixels, k * 3 + i) / F.lit(255.0))
        return F.when(F.size(pixels) >= 3, F.transform(part, lambda v: (v - F.lit(MEAN[i])) / F.lit(DEVIATION[i])) if imagenet else part)

    return [plane(i) for i in range(3)]
