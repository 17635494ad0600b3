
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.text import whole_number
from maskframe.operators.scoring import CHANNELS
from maskframe.sources.files import IMAGE_NAMES, image_size, npy_shape
from maskframe.sources.masks import local_path

#: File names of the masks in a sample directory (fixed values).
STACKED = "0.npy"
MASKS = dict(zip(CHANNELS, ["mask_1.npy", "mask_2.npy", "mask_3.npy", "mask_4.npy", "mask_5.npy", "mask_key_point.npy"]))
#: Columns of the manifest, in order (fixed values).
COLUMNS = [
    "schema_version", "data_version", "sample_id", "char_id", "char_name", "sample_index", "source_id", "writer_id", "sample_dir", "image_path", "image_width", "image_height",
    "stacked_mask_path", "stacked_mask_shape", *[f"{c}_path" for c in CHANNELS], *[f"{c}_shape" for c in CHANNELS], "has_all_masks", "split_group_key", "errors",
]


def sample_dirs(spark: SparkSession, root: str) -> DataFrame:
    """[S3] ``char_id``, ``sample``, ``sample_dir`` of every directory two levels below ``root``, empty ones too; listed by the driver, names only."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        raise FileNotFoundError(f"no such folder: {root}")
    below = lambda p: sorted((s.getPath() for s in fs.listStatus(p) if s.isDirectory()), key=lambda q: q.getName())
    rows = [(c.getName(), s.getName(), s.toUri().getPath()) for c in below(top) for s in below(c)]
    return spark.createDataFrame(rows, "char_id string, sample string, sample_dir string")


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """[S5, S6] ``path``, ``shape`` (text of an array's), ``width``, ``height``, ``error`` of images and arrays, from their headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                if p.endswith(".npy"):
                    s = npy_shape(bytes(c))
                    rows.append((p, None if s is None else "x".join(map(str, s)), None, None, "bad_npy:ValueError" if s is None else None))
                else:
                    wh = image_size(bytes(c))
                    rows.append((p, None, *(wh or (None, None)), None if wh else "bad_image:UnidentifiedImageError"))
            yield pd.DataFrame(rows, columns=["path", "shape", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    names = [STACKED, *MASKS.values(), *IMAGE_NAMES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    return files.select(local_path(F.col("path")).alias("path"), "content").mapInPandas(
        run, "path string, shape string, width int, height int, error string"
    )


def audit(spark: SparkSession, root: str, data_version: str = "v1") -> DataFrame:
    """[P1] The manifest: ``COLUMNS`` as text, a row for each sample directory; blank where there is nothing."""
    parts = F.split("path", "/")
    f = file_facts(spark, root).select(
        "*", F.element_at(parts, -3).alias("char_id"), F.element_at(parts, -2).alias("sample"),
        F.element_at(parts, -1).alias("name")
    )
    rank = F.array_position(F.array(*map(F.lit, IMAGE_NAMES)), F.col("name"))
    what = F.struct("path", "shape", "width", "height", "error")
    arrays = {"stacked_mask": STACKED, **MASKS}
    g = f.groupBy("char_id", "sample").agg(
        F.min_by(what, F.when(rank > 0, rank)).alias("_image"),
        *[F.max(F.when(F.col("name") == n, what)).alias(f"_{c}") for c, n in arrays.items()]
    )
    d = sample_dirs(spark, root).join(g, ["char_id", "sample"], "left")

    def failing(name: str, missing: str, prefix: str = "") -> Column:
        return F.when(F.col(f"_{name}").isNull(), F.lit(missing)).when(
            F.col(f"_{name}.error").isNotNull(), F.concat(F.lit(prefix), F.col(f"_{name}.error"))
        )

    masks = [failing(c, f"{c}:missing", f"{c}:") for c in CHANNELS]
    shapes = F.array_distinct(F.array_compact(F.array(*[F.col(f"_{c}.shape") for c in CHANNELS])))
    errors = F.array_compact(F.array(
        failing("image", "missing_image"), failing("stacked_mask", "stacked_mask:missing", "stacked_mask:"), *masks,
        F.when(F.size(shapes) > 1, "mask_shape_mismatch")
    ))
    index = whole_number(F.col("sample")).cast("string")
    sample_id = F.concat_ws("/", "char_id", "sample")
    cells = {
        "schema_version": F.lit("1"), "data_version": F.lit(data_version), "sample_id": sample_id, "char_id": F.col("char_id"), "sample_index": index, "sample_dir": F.col("sample_dir"),
        "image_path": F.col("_image.path"), "image_width": F.col("_image.width"), "image_height": F.col("_image.height"), "stacked_mask_path": F.col("_stacked_mask.path"), "stacked_mask_shape": F.col("_stacked_mask.shape"),
        **{f"{c}_path": F.col(f"_{c}.path") for c in CHANNELS}, **{f"{c}_shape": F.col(f"_{c}.shape") for c in CHANNELS},
        "has_all_masks": F.when(
            F.size(F.array_compact(F.array(*masks))) == 0, "true"
        ).otherwise("false"), "split_group_key": F.coalesce(index, sample_id), "errors": F.array_join(errors, "|"),
    }
    return d.select(*[F.coalesce(cells.get(c, F.lit("")).cast("string"), F.lit("")).alias(c) for c in COLUMNS])


def report(manifest: DataFrame) -> DataFrame:
    """[A1] One row: characters, samples, samples with errors, without some mask, and complete ones."""
    bad = F.coalesce("errors", F.lit("")) != ""
    whole = F.col("has_all_masks") == "true"
    return manifest.agg(
        F.count_distinct("char_id").alias("num_char_dirs"), F.count("*").alias("num_samples"), F.count_if(bad).alias("num_samples_with_errors"),
        F.count_if(~F.coalesce(whole, F.lit(False))).alias("num_samples_missing_any_mask"), F.count_if(whole & ~bad).alias("num_complete_samples"),
    )
