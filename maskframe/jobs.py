"""File-to-file runs of the corpus operators: ``python -m maskframe.jobs NAME ...`` on a running or local session.

``audit``, ``split``, ``template``, ``merge``, ``validate`` and ``catalog`` each read and write the project's
files; tables are part files in a folder, except where one file is asked for.
"""

from __future__ import annotations

import argparse
import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import corpus as C
from maskframe.operators import courses as K
from maskframe.operators import rules as R
from maskframe.sources import audit as A
from maskframe.sources import files as S

#: Columns of the split, review and template files (fixed values).
SPLIT_COLUMNS = ["sample_id", "char_id", "sample_index", "group_key", "split"]
FLAGS = ["difficulty_crossing", "difficulty_adhesion", "difficulty_endpoint", "difficulty_line_width", "difficulty_background", "difficulty_style"]
REVIEW_COLUMNS = ["sample_id", "char_id", "sample_index", "split", *FLAGS, "priority", "reviewer", "keep", "notes"]
TEMPLATE_COLUMNS = [
    "sample_id", "char_id", "sample_index", "image_path", "hard_crossing", "hard_adhesion", "hard_endpoint", "hard_line_width",
    "hard_background", "reviewer", "notes"
]
STYLE_COLUMNS = ["style_id", "author_id", "script_style", "enabled"]


def write_one_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """[K1, D2] One file with a byte order mark and a fixed column order, streamed through the driver partition by partition."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    cells = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns])
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        out.writerows(cells.toLocalIterator(prefetchPartitions=True))


def write_report(df: DataFrame, path: str) -> dict:
    """[K2] A table of one row as an indented JSON file, other letters than ASCII kept."""
    found = df.first().asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return found


def audit(spark: SparkSession, root: str, manifest: str, report: str) -> dict:
    """Audit of a folder of samples into a manifest and a report."""
    rows = A.audit(spark, root)
    write_one_csv(rows.orderBy("char_id", "sample_id"), manifest, A.COLUMNS)
    return write_report(A.report(S.read_csv(spark, manifest, A.COLUMNS)), report)


def split(spark: SparkSession, manifest: str, output: str, train: float = 0.70, val: float = 0.15) -> dict:
    """Splits that keep groups together; the counts by split."""
    u = C.usable(S.read_csv(spark, manifest, A.COLUMNS)).withColumn(
        "group_key", C.group_key("writer_id", "source_id", "sample_index", "split_group_key", "sample_id")
    )
    done = C.group_split(u, "group_key", train, val)
    write_one_csv(done.orderBy("char_id", "sample_id"), output, SPLIT_COLUMNS)
    return {r["split"]: r["rows"] for r in C.split_counts(S.read_csv(spark, output, SPLIT_COLUMNS), "group_key").collect()}


def template(spark: SparkSession, manifest: str, output: str, limit: int = 50) -> int:
    """A review template of samples taken in turn from the characters."""
    m = C.strictly_usable(S.read_csv(spark, manifest, A.COLUMNS))
    some = C.round_robin_template(m, "char_id", "sample_index", "sample_id", limit)
    write_one_csv(some.orderBy("place"), output, TEMPLATE_COLUMNS)
    return some.count()


def merge(spark: SparkSession, base: str, review: str, output: str) -> int:
    """Reviews laid over a base review file; an unmatched review or an inadmissible result raises. Returns the rows written."""
    load = lambda p: S.read_csv_any(spark, p, REVIEW_COLUMNS)
    rows = load(base).withColumn("sample_id", C.canonical_sample_id())
    if rows.where("sample_id IS NULL").limit(1).count():
        raise ValueError("cannot recover a canonical sample_id in the base file")
    fields, signals = [*FLAGS, "priority", "reviewer", "keep", "notes"], [*FLAGS, "reviewer", "keep"]
    reviews = load(review).withColumn("review_id", F.monotonically_increasing_id()).select(
        "review_id", "sample_id", "char_id", "sample_index", *[F.trim(f).alias(f) for f in fields]
    )
    new = C.merge_reviews(rows.drop(*fields), reviews, fields, signals)
    old = rows.select("sample_id", *[F.col(f).alias(f"_{f}") for f in fields])
    kept = lambda f: F.when(F.col("review_id").isNull(), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    done = new.join(old, "sample_id").select("sample_id", "char_id", "sample_index", "split", *[kept(f) for f in fields])
    bad = R.review_violations(done.withColumn("review_id", F.col("sample_id")), FLAGS).first()
    if bad is not None:
        raise ValueError(f"{bad['review_id']}: {bad['field']} {bad['message']}")
    write_one_csv(done.orderBy("sample_id"), output, REVIEW_COLUMNS)
    return done.count()


def validate(spark: SparkSession, manifest: str, registry: str, output: str | None = None, require_approved: bool = False) -> dict:
    """Validation of a reference manifest against the registry; with ``output`` the errors are written beside the report."""
    from pyspark.sql.window import Window

    with open(manifest, encoding="utf-8-sig", newline="") as f:
        columns = next(csv.reader(f), [])
    order = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1  # the file is one whole, its rows count from 2
    m = S.read_csv(spark, manifest, columns).withColumn("row", order)
    styles = S.read_yaml(spark, registry, "styles", STYLE_COLUMNS).withColumn("enabled", F.lower("enabled") == "true")
    report = R.manifest_report(m, styles, "row", require_approved=require_approved)
    if output is None:
        return report.first().asDict(recursive=True)
    R.manifest_violations(m, styles, "row", require_approved=require_approved).write.mode("overwrite").json(f"{output}.errors")
    return write_report(report, output)


def catalog(spark: SparkSession, config: str, output: str) -> int:
    """The catalogue of all courses of a configuration, checked, as one JSON file."""
    import yaml

    packs = K.courses(spark, yaml.safe_load(Path(config).read_text("utf-8")) or {})
    home, entries = Path(config).resolve().parent.parent, []
    for p in packs.collect():  # the configuration
        own = packs.where(F.col("course_id") == p.course_id)
        refs = S.read_csv(spark, str(home / p.manifest), ["reference_id", "style_id", "target_char", "image_path", "review_status"])
        K.check_courses(own, refs)
        there = spark.createDataFrame([(p.cache_index,)] if (home / p.cache_index).is_file() else [], "cache_index string")
        entries.append(K.catalog(own, refs, there).first().asDict(recursive=True))
    Path(output).write_text(json.dumps({"schema_version": 1, "courses": entries}, ensure_ascii=False, indent=2), encoding="utf-8")
    return len(entries)


#: Columns of an imported manifest (fixed values).
IMPORT_COLUMNS = [
    "schema_version", "reference_id", "style_id", "target_char", "image_path", "source_type", "source_url", "source_license", "source_work_id", "source_version", "bbox_left", "bbox_top",
    "bbox_right", "bbox_bottom", "author_id", "script_style", "is_synthetic", "review_status", "reviewer", "review_date", "notes",
]


def imported(
    members: DataFrame, styles: DataFrame, archive_hash: str, source: dict[str, str], reviewer: str, review_date: str,
    size: int = 256
) -> DataFrame:
    """[S9, R10, A21] Manifest rows, with ``content``, of the images of an archive (``member``: top/category/character.png).

    ``styles`` maps ``category`` to ``style_id``, ``author_id``, ``script_style``; other categories are left out. A
    name of more than one character, and an image that is not ``size`` by ``size`` RGB, raises when run.
    """
    from maskframe.sources.files import png_is_rgb

    part = F.split("member", "/")
    m = members.select(
        "member", "content", F.element_at(part, -2).alias("category"),
        F.regexp_replace(F.element_at(part, -1), r"\.[^.]*\z", "").alias("target_char")
    ).join(F.broadcast(styles), "category")
    m = m.withColumns({"_wh": png_is_rgb(F.col("content")), "_hash": F.sha2("content", 256)})
    wrong = lambda why: F.raise_error(F.concat(F.col("member"), F.lit(why))).cast("string")
    char = F.when(F.length("target_char") != 1, wrong(": expected a one-character filename")).when(
        ~F.col("_wh").eqNullSafe(F.lit(f"{size}x{size}")), wrong(f": expected a {size}x{size} RGB image")
    ).otherwise(F.col("target_char"))
    code = F.lpad(F.lower(F.hex(F.ascii("target_char"))), 4, "0")
    short = F.substring("_hash", 1, 12)
    fixed = {
        "schema_version": "1", "source_type": "official_open_dataset", "source_version": f"sha256:{archive_hash}",
        "bbox_left": "0", "bbox_top": "0", "bbox_right": str(size), "bbox_bottom": str(size), "is_synthetic": "false",
        "review_status": "approved", "reviewer": reviewer, "review_date": review_date, **source
    }
    cells = {
        **{k: F.lit(v) for k, v in fixed.items()}, "target_char": char, "reference_id": F.concat_ws(":", "style_id", code, short), "image_path": F.concat(
            "style_id", F.lit("/"), "target_char", F.lit("_"), short, F.lit(".png")
        ),
        "notes": F.concat(F.lit("Imported from "), "category", F.lit("; source member: "), "member"),
    }
    return m.select(*[cells.get(c, F.col(c) if c in m.columns else F.lit("")).alias(c) for c in IMPORT_COLUMNS], "content")


def main() -> None:
    parser = argparse.ArgumentParser(prog="maskframe.jobs")
    sub = parser.add_subparsers(dest="name", required=True)
    wants = {
        "audit": ["root", "manifest", "report"], "split": ["manifest", "output"], "template": ["manifest", "output"],
        "merge": ["base", "review", "output"], "validate": ["manifest", "registry"], "catalog": ["config", "output"]
    }
    for name, args in wants.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(f"--{a}", required=True)
        if name == "validate":
            p.add_argument("--output")
            p.add_argument("--require-approved", action="store_true")
        if name == "template":
            p.add_argument("--limit", type=int, default=50)
    args = vars(parser.parse_args())
    name = args.pop("name")
    done = globals()[name](SparkSession.builder.appName(f"maskframe {name}").getOrCreate(), **args)
    print(json.dumps(done, ensure_ascii=False, default=str))
    if name == "validate" and not done["valid"]:
        raise SystemExit(1)


if __name__ == "__main__":
    main()
