
from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENCODINGS = ["utf-8-sig", "utf-8", "gb18030"]
IMAGE_NAMES = ["0.jpg", "image.jpg", "input.jpg", "mask_img.jpg"]


def text_schema(columns: list[str]) -> StructType:
    """[D1] Every cell is text."""
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """[S1] CSV with a header, byte order mark allowed, line breaks in quotes kept; empty cells are empty text."""
    return spark.read.schema(text_schema(columns)).options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path).na.fill("")


def read_csv_any(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """[S2] CSV files in UTF-8 or GB18030, decided for each file as a whole; columns by the file's own header."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                for enc in ENCODINGS:
                    try:
                        text = bytes(content).decode(enc)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError("file is in none of " + ", ".join(ENCODINGS))
                yield pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False).reindex(columns=columns, fill_value="")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, text_schema(columns))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """[K1, D2] Part files with a fixed column order; absent cells are empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def scan_samples(spark: SparkSession, root: str) -> DataFrame:
    """[S3, S4] Files below ``root/<char>/<sample>/`` by sample, with the first image name that exists."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    parts = F.split("path", "/")
    f = f.select("path", F.element_at(parts, -3).alias("char_id"), F.element_at(parts, -2).alias("sample"), F.element_at(parts, -1).alias("name"))
    rank = F.array_position(F.array(*[F.lit(n) for n in IMAGE_NAMES]), F.col("name"))
    return f.groupBy("char_id", "sample").agg(
        F.min_by(F.when(rank > 0, F.col("path")), F.when(rank > 0, rank)).alias("image_path"),
        F.array_sort(F.collect_list("name")).alias("files")
    )


def image_size(content: bytes) -> tuple[int, int] | None:
    """[S5] Width and height from a PNG or JPEG header; None for anything else."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def png_is_rgb(content: Column) -> Column:
    """[R10] ``WIDTHxHEIGHT`` of a PNG of eight-bit RGB, from its header in SQL; null for anything else."""
    head = F.hex(F.substring(content, 1, 26))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10)
    good = (F.substring(head, 1, 16) == "89504E470D0A1A0A") & (F.substring(head, 25, 8) == "49484452") & (F.substring(head, 49, 4) == "0802")
    return F.when(good, F.concat_ws("x", number(33), number(41)))


def npy_shape(content: bytes) -> tuple[int, ...] | None:
    """[S6] Shape from an NPY header; None where there is none."""
    try:
        f = io.BytesIO(content)
        version = np.lib.format.read_magic(f)
        return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
    except (ValueError, EOFError):
        return None


def probe(spark: SparkSession, path: str) -> DataFrame:
    """[S5, S6, R10] ``path``, ``kind``, ``width``, ``height`` of images and arrays; nulls where the header is bad."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                if p.endswith(".npy"):
                    s = npy_shape(bytes(c))
                    rows.append((p, "array", s[1] if s and len(s) > 1 else None, s[0] if s else None))
                else:
                    wh = image_size(bytes(c))
                    rows.append((p, "image", *(wh or (None, None))))
            yield pd.DataFrame(rows, columns=["path", "kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(
        run, "path string, kind string, width int, height int"
    )


#: Limits of an uploaded image and the codes of refusals (fixed values).
MOST_SIDE, BAD_IMAGE, TOO_LARGE = 8192, "40001", "41301"


def check_uploads(files: DataFrame, most_bytes: int) -> DataFrame:
    """[P14] ``path``, ``error_code``, ``message``, ``suffix`` of uploaded files (``path``, ``content``): empty, too large, no PNG or JPEG, or of a wrong size.

    Files in order have no code. Judged by the header; null content is empty.
    """

    def judge(raw: bytes | None) -> tuple:
        if not raw:
            return BAD_IMAGE, "the image is empty", None
        if len(raw) > most_bytes:
            return TOO_LARGE, "the image exceeds the size limit", None
        wh = image_size(bytes(raw))
        if wh is None:
            return BAD_IMAGE, "no PNG or JPEG image", None
        if not all(1 <= v <= MOST_SIDE for v in wh):
            return BAD_IMAGE, "the image dimensions are out of range", None
        return None, None, ".png" if raw[:1] == b"\x89" else ".jpg"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *judge(c)) for p, c in zip(b["path"], b["content"])], columns=["path", "error_code", "message", "suffix"])

    return files.select("path", "content").mapInPandas(run, "path string, error_code string, message string, suffix string")


def stream_files(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """[S12] Files dropped into a folder as a stream of ``path``, ``modificationTime``, ``length``, ``content``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".png", depth: int = 3) -> DataFrame:
    """[S9] Members of archives at one depth with one suffix, their checksums tested: ``archive, member, content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(c))) as z:
                    if (bad := z.testzip()) is not None:
                        raise ValueError(f"damaged member {bad} in {p}")
                    rows = [(p, n, z.read(n)) for n in sorted(z.namelist()) if n.endswith(suffix) and n.count("/") == depth - 1]
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def read_yaml(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """[S10] A list in a small YAML configuration as text rows."""
    import yaml

    items = (yaml.safe_load(Path(path).read_text("utf-8")) or {}).get(key) or []
    return spark.createDataFrame([tuple(None if i.get(c) is None else str(i[c]) for c in columns) for i in items], text_schema(columns))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S11] Whole-file JSON documents under a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def new_content(rows: DataFrame, existing: DataFrame, name: str, digest: str) -> DataFrame:
    """[K6] Rows to write under content-addressed names: those not there yet; a name there with other bytes raises when run."""
    old = existing.select(F.col(name).alias("_n"), F.col(digest).alias("_d"))
    j = rows.dropDuplicates([name, digest]).join(old, F.col(name) == F.col("_n"), "left")
    clash = F.col("_n").isNotNull() & (F.col(digest) != F.col("_d"))
    return j.where(F.when(
        clash, F.raise_error(F.concat(F.lit("other content under "), F.col(name))).cast("boolean")
    ).otherwise(F.col("_n").isNull())).select(*rows.columns)
