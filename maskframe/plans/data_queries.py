"""Queries of the two general data problems: dangling references (p1) and records that fail to parse (p4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.text import blank_to_null, relative_path
from maskframe.operators import csv_records as C
from maskframe.operators import orphans as O
from maskframe.sources.tables import table

ALWAYS = -(2**63) + 2


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def reference_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the four reference fields, under one key column ``key`` and a number ``rel``."""
    manifest, cache = table(spark, base, "reference_manifest_template"), table(spark, base, "reference_cache")
    images, styles = table(spark, base, "reference_images"), table(spark, base, "style_registry")
    path = lambda c: F.when(blank_to_null(F.col(c)).isNotNull(), relative_path(F.col(c)))
    key = lambda c: blank_to_null(F.col(c))

    def refs(df: DataFrame, rel: int, name: str, field: str, k: Column, at: str) -> DataFrame:
        when = F.lit(0).cast("bigint") if rel == 3 else micros(at)
        return df.select(
            F.lit(name).alias("table_name"), "row_id", F.lit(field).alias("field_name"),
            F.date_format(F.col(at), "yyyy-MM").alias("month"), F.lit(rel).alias("rel"), k.alias("key"), when.alias("at")
        )

    def parents(df: DataFrame, rel: int, k: Column, start: Column, end: Column) -> DataFrame:
        return df.select(F.lit(rel).alias("rel"), k.alias("key"), start.alias("start"), end.alias("end"))

    m, c = "reference_manifest_template", "reference_cache"
    references = (
        refs(manifest, 0, m, "style_id", key("style_id"), "ingested_at")
        .unionByName(refs(manifest, 1, m, "image_path", path("image_path"), "ingested_at"))
        .unionByName(refs(cache, 2, c, "reference_id", key("reference_id"), "built_at"))
        .unionByName(refs(manifest, 3, m, "reference_id", key("reference_id"), "ingested_at"))
    )
    lives = (
        parents(styles, 0, key("style_id"), micros("added_at"), micros("removed_at"))
        .unionByName(parents(images, 1, path("image_path"), micros("added_at"), micros("removed_at")))
        .unionByName(parents(manifest, 2, key("reference_id"), micros("ingested_at"), micros("withdrawn_at")))
        .unionByName(parents(cache, 3, key("reference_id"), F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))
    )
    return references, lives


def dangling(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    references, lives = reference_tables(spark, base)
    return references, O.orphans(references, lives, ["rel", "key"], "at", F.col("row_id"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return dangling(spark, base)[1].select("table_name", "row_id", "field_name")


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    references, found = dangling(spark, base)
    return O.orphan_report(references.where("key IS NOT NULL"), found, F.col("month")).withColumnRenamed("period", "month")


def unused_parts(spark: SparkSession, base: str) -> DataFrame:
    """Integer keys: parts that no line item refers to."""
    return O.orphan_integers(table(spark, base, "part").select("p_partkey", "p_name"), table(spark, base, "lineitem"), "p_partkey", "l_partkey")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return C.failing_rows(C.classify(table(spark, base, "hardset_review_raw"))).select("raw_id")


def p4_reasons(spark: SparkSession, base: str) -> DataFrame:
    bad = C.failing_rows(C.classify(table(spark, base, "hardset_review_raw")))
    return bad.groupBy("reason").agg(F.count("*").alias("records"))


def p4_valid(spark: SparkSession, base: str) -> DataFrame:
    return C.valid_rows(C.classify(table(spark, base, "hardset_review_raw"))).select(
        "raw_id", "file_name", "sample_id", "char_id", "sample_index", *C.FLAGS, "keep", "split"
    )


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "unused_parts": unused_parts, "p4_found": p4_found, "p4_reasons": p4_reasons,
    "p4_valid": p4_valid
}

_STRIP = r"regexp_replace({c}, '^[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+|[\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+$', '', 'g')"
_KEY = lambda c: "nullif(" + _STRIP.format(c=c) + ", '')"
_PATH = lambda c: "regexp_replace(regexp_replace('/' || regexp_replace(" + _KEY(c) + r", '[\\/]+', '/', 'g'), '(/\.)+(/|$)', '/', 'g'), '^/+|/+$', '', 'g')"
_P1 = f"""
WITH refs AS (
  SELECT 'reference_manifest_template' AS table_name, row_id, 'style_id' AS field_name, ingested_at AS ref_at, 0 AS rel, {_KEY('style_id')} AS k FROM reference_manifest_template
  UNION ALL SELECT 'reference_manifest_template', row_id, 'image_path', ingested_at, 1, {_PATH('image_path')} FROM reference_manifest_template
  UNION ALL SELECT 'reference_cache', row_id, 'reference_id', built_at, 2, {_KEY('reference_id')} FROM reference_cache
  UNION ALL SELECT 'reference_manifest_template', row_id, 'reference_id', ingested_at, 3, {_KEY('reference_id')} FROM reference_manifest_template
), lives AS (
  SELECT 0 AS rel, {_KEY('style_id')} AS k, added_at AS s, coalesce(removed_at, TIMESTAMP '9999-01-01') AS e FROM style_registry
  UNION ALL SELECT 1, {_PATH('image_path')}, added_at, coalesce(removed_at, TIMESTAMP '9999-01-01') FROM reference_images
  UNION ALL SELECT 2, {_KEY('reference_id')}, ingested_at, coalesce(withdrawn_at, TIMESTAMP '9999-01-01') FROM reference_manifest_template
  UNION ALL SELECT 3, {_KEY('reference_id')}, TIMESTAMP '0001-01-01', TIMESTAMP '9999-01-01' FROM reference_cache
), found AS (
  SELECT * FROM refs WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lives WHERE lives.rel = refs.rel AND lives.k = refs.k AND lives.s <= refs.ref_at AND refs.ref_at < lives.e)
)
"""

_P4 = r"""
WITH heads AS (
  SELECT file_name, string_split(regexp_replace(regexp_replace(record_text, '\r$', ''), '^\x{FEFF}', ''), ',') AS names FROM hardset_review_raw WHERE line_no = 1
), body AS (
  SELECT r.*, names, regexp_replace(coalesce(record_text, ''), '\r$', '') AS rec FROM hardset_review_raw r LEFT JOIN heads USING (file_name) WHERE line_no <> 1
), shaped AS (
  SELECT *, regexp_full_match(rec, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') AS quoted_well,
    length(regexp_replace(rec, '"([^"]|"")*"', 'q', 'g')) - length(replace(regexp_replace(rec, '"([^"]|"")*"', 'q', 'g'), ',', '')) + 1 AS n
  FROM body
), cells AS (
  SELECT *, list_transform(regexp_extract_all(',' || rec, ',("(?:[^"]|"")*"|[^",]*)', 1), lambda x: trim(CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS v FROM shaped
), f AS (
  SELECT *, v[list_position(names, 'sample_id')] AS sample_id_t, v[list_position(names, 'keep')] AS keep_t, v[list_position(names, 'difficulty_crossing')] AS crossing_t FROM cells
), judged AS (
  SELECT *, CASE WHEN names IS NULL THEN 'no_header' WHEN NOT quoted_well THEN 'bad_quoting' WHEN n <> len(names) THEN 'wrong_column_count'
    WHEN list_contains(names, 'sample_id') AND NOT regexp_full_match(sample_id_t, '[0-9]+/[0-9]+') THEN 'invalid_sample_id'
    WHEN list_contains(names, 'keep') AND lower(keep_t) NOT IN ('', 'yes', 'no') THEN 'invalid_keep'
    WHEN list_contains(names, 'difficulty_crossing') AND crossing_t NOT IN ('', '0', '1') THEN 'invalid_difficulty_crossing' END AS reason
  FROM f
)
"""

SQL = {
    "p1_found": _P1 + "SELECT table_name, row_id, field_name FROM found",
    "p1_report": _P1
    + """SELECT r.table_name, r.field_name, r.month, r.refs, coalesce(f.orphans, 0) AS orphans, round(coalesce(f.orphans, 0) / r.refs, 6) AS orphan_share
FROM (SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS month, count(*) AS refs FROM refs WHERE k IS NOT NULL GROUP BY ALL) r
LEFT JOIN (SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS month, count(*) AS orphans FROM found GROUP BY ALL) f
ON r.table_name = f.table_name AND r.field_name = f.field_name AND r.month IS NOT DISTINCT FROM f.month""",
    "unused_parts": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    "p4_found": _P4 + "SELECT raw_id FROM judged WHERE reason IS NOT NULL",
    "p4_reasons": _P4 + "SELECT reason, count(*) AS records FROM judged WHERE reason IS NOT NULL GROUP BY reason",
}
