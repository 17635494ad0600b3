
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.rules import approved

#: Fields of a course definition (fixed values).
FIELDS = [
    "course_id", "display_name", "style_id", "manifest", "cache_index", "source_dataset", "source_license", "status", "enabled",
    "scoring_label"
]
SCHEMA = ", ".join(f"{f} {'boolean' if f == 'enabled' else 'string'}" for f in FIELDS)


#: Messages of a refused configuration (fixed values).
BAD_VERSION = "course pack schema_version must be 1"
NO_LIST = "course pack config field courses must be a list"
NO_MAPPING = "each course definition must be a mapping"
NO_FIELDS = "course definition missing fields: {}"
TWICE = "duplicate course_id: {}"
EMPTY = "course pack config contains no courses"


class CourseError(ValueError):
    """A course configuration or its references break a rule."""


def _refusal(config: Mapping) -> str | None:
    """The first message that holds for ``config``."""
    if int(config.get("schema_version", 0)) != 1:
        return BAD_VERSION
    items = config.get("courses")
    if not isinstance(items, list):
        return NO_LIST
    ids = [str(i["course_id"]) if isinstance(i, Mapping) and "course_id" in i else None for i in items]
    for k, item in enumerate(items):
        lacking = sorted(set(FIELDS).difference(item)) if isinstance(item, Mapping) else None
        if lacking is None or lacking:
            return NO_MAPPING if lacking is None else NO_FIELDS.format(lacking)
        if ids[k] in ids[:k]:
            return TWICE.format(ids[k])
    return None if items else EMPTY


def courses(spark: SparkSession, config: Mapping) -> DataFrame:
    """[R2] The configured courses, checked: schema version 1, a list of mappings with all fields, no id twice, not empty."""
    if (why := _refusal(config)) is not None:
        raise CourseError(why)
    rows = [tuple(bool(i[f]) if f == "enabled" else str(i[f]) for f in FIELDS) for i in config["courses"]]
    return spark.createDataFrame(rows, SCHEMA)


def course_references(packs: DataFrame, references: DataFrame) -> DataFrame:
    """[J5, P5] Approved references of each course's style: ``course_id`` and the reference's columns; disabled courses have theirs too."""
    few = packs.select("course_id", "style_id")  # a small configuration
    return approved(references).join(F.broadcast(few), "style_id").select("course_id", *references.columns)


def course_violations(packs: DataFrame, references: DataFrame) -> DataFrame:
    """[R3, O11] ``course_id``, ``message``, ``rows``: courses without approved references, with references that lack an id or one character, or with several for a character."""
    r = course_references(packs, references)
    char = F.coalesce("target_char", F.lit(""))
    each = r.groupBy("course_id", char.alias("c")).agg(
        F.count("*").alias("n"), F.count_if((F.length(char) != 1) | (F.coalesce("reference_id", F.lit("")) == "")).alias("bad")
    )
    per = each.groupBy("course_id").agg(F.sum("bad").alias("bad"), F.sum(F.when(F.length("c") == 1, F.col("n") - 1).otherwise(0)).alias("more"))
    j = packs.select("course_id").join(per, "course_id", "left")
    hits = F.array_compact(F.array(
        F.when(F.col("bad").isNull(), F.struct(F.lit("no approved references").alias("message"), F.lit(0).cast("bigint").alias("rows"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("invalid manifest reference").alias("message"), F.col("bad").alias("rows"))),
        F.when(F.col("more") > 0, F.struct(F.lit("multiple approved references").alias("message"), F.col("more").alias("rows"))),
    ))
    return j.select("course_id", F.explode(hits).alias("v")).select("course_id", "v.message", "v.rows")


def check_courses(packs: DataFrame, references: DataFrame) -> None:
    """[R3] Raises for the first course, by id, that breaks a rule."""
    bad = course_violations(packs, references).orderBy("course_id", "message").first()
    if bad is not None:
        raise CourseError(f"course {bad.course_id!r}: {bad.message}")


def find_course(requests: DataFrame, packs: DataFrame, references: DataFrame) -> DataFrame:
    """[R8, R9, P13] Requests (``course_id``, ``target_char``) with ``status`` and, where it is ``found``, ``reference_id``.

    In this order: ``unknown_course``, ``course_disabled``, ``not_one_character``, ``unsupported_character``,
    ``ambiguous_reference``, ``found``. References come down to one row for each course and character first.
    """
    per = course_references(packs, references).groupBy("course_id", "target_char").agg(F.count("*").alias("_n"), F.min("reference_id").alias("_id"))
    few = F.broadcast(packs.select("course_id", F.coalesce("enabled", F.lit(False)).alias("_enabled")))  # a small configuration
    j = requests.join(few, "course_id", "left").join(per, ["course_id", "target_char"], "left")
    status = (
        F.when(F.col("_enabled").isNull(), "unknown_course").when(~F.col("_enabled"), "course_disabled").when(
            F.length(F.coalesce("target_char", F.lit(""))) != 1, "not_one_character"
        )
        .when(F.col("_n").isNull(), "unsupported_character").when(F.col("_n") > 1, "ambiguous_reference").otherwise("found")
    )
    return j.select(*requests.columns, status.alias("status"), F.when(status == "found", F.col("_id")).alias("reference_id"))


def catalog(packs: DataFrame, references: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """[A20] Every course with ``supported_character_count``, ``characters`` (structs of character, reference and image path) and ``cache_available``.

    ``cached`` lists the cache indexes there are (``cache_index``); without it the flag is null. The list holds one
    entry for each distinct character, the one of the least reference id, so it is bounded by the script.
    """
    r = course_references(packs, references).where("target_char IS NOT NULL")
    one = r.groupBy("course_id", "target_char").agg(
        F.min(F.struct(F.col("reference_id").isNull().alias("none"), "reference_id", "image_path")).alias("_r"),
        F.count("*").alias("_n")
    )
    entry = F.struct("target_char", F.col("_r.reference_id").alias("reference_id"), F.col("_r.image_path").alias("reference_image_path"))
    per = one.groupBy("course_id").agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(entry)).alias("characters"))
    out = packs.join(per, "course_id", "left")
    flag = F.lit(None).cast("boolean")
    if cached is not None:
        out = out.join(cached.select("cache_index", F.lit(True).alias("_there")).distinct(), "cache_index", "left")
        flag = F.coalesce("_there", F.lit(False))
    rest = [f for f in FIELDS if f not in ("manifest", "cache_index")]
    return out.select(
        *rest, F.coalesce("_n", F.lit(0)).alias("supported_character_count"), flag.alias("cache_available"),
        F.coalesce("characters", F.array().cast(per.schema["characters"].dataType)).alias("characters")
    )


def missing_caches(entries: DataFrame) -> DataFrame:
    """[A20] Enabled courses whose cache is known to be missing."""
    return entries.where(F.col("enabled") & ~F.col("cache_available")).select("course_id")


#: Codes of refused requests by the outcome of :func:`find_course` and of the cache (fixed values).
CODES = {
    "unknown_course": "40002", "course_disabled": "40002", "unsupported_character": "40901", "ambiguous_reference": "40901", "missing_course_cache": "50301", "reference_mask_file_missing": "50301",
}


def error_code(status: Column) -> Column:
    """[P17] Code of an outcome, ``50001`` for any other failure; null where the reference was found."""
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(status != "found", F.coalesce(F.try_element_at(known, status), F.lit("50001")))
