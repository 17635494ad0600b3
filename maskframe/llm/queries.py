"""Queries of the training-corpus operators and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import leaks, mixing, mojibake, quality, splits, varied
from maskframe.sources.tables import table

TEXT_FIELDS = ["notes", "reviewer"]


def p2_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, base, "hardset_review"), "review_id", TEXT_FIELDS)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_restored(spark, base).select("review_id", "field_name")


KEYS = ["char_id", "sample_index"]
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return splits.torn_rows(table(spark, base, "hardset_review"), "review_id", KEYS, "split")


def p3_assign(spark: SparkSession, base: str) -> DataFrame:
    sets = splits.related_sets(table(spark, base, "hardset_review"), "review_id", KEYS)
    return splits.assign_splits(sets, "review_id", SHARES)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return quality.not_prose(table(spark, base, "documents"), table(spark, base, "doc_labels"))


def p8_statistics(spark: SparkSession, base: str) -> DataFrame:
    return quality.statistics(table(spark, base, "documents"))


def p8_rules(spark: SparkSession, base: str) -> DataFrame:
    return quality.rule_report(table(spark, base, "documents"), table(spark, base, "doc_labels"))


FLAGS = ["difficulty_crossing", "difficulty_adhesion", "difficulty_endpoint", "difficulty_line_width", "difficulty_background", "difficulty_style"]
REVIEW_SET = 2000


def p5_subset(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "hardset_review")
    content = [c for c in rows.columns if c not in ("review_id", "ingested_at")]
    return varied.varied_subset(rows, "review_id", "char_id", FLAGS, REVIEW_SET, content).select("review_id", "char_id", *FLAGS, "pick_rank")


def _mixed(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(table(spark, base, "documents"), table(spark, base, "mix_targets"))


def p7_mixture(spark: SparkSession, base: str) -> DataFrame:
    return _mixed(spark, base).select("doc_id", "source", "tokens", "repeats")


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(_mixed(spark, base), table(spark, base, "mix_targets"))


QUERIES = {
    "p2_found": p2_found, "p2_restored": p2_restored, "p3_found": p3_found, "p3_assign": p3_assign, "p5_subset": p5_subset,
    "p6_found": p6_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_rules": p8_rules,
}

_NUM = r"CASE WHEN regexp_full_match(translate(trim({c}), '０１２３４５６７８９．', '0123456789.'), '[0-9]+(\.0*)?') THEN CAST(CAST(translate(trim({c}), '０１２３４５６７８９．', '0123456789.') AS DECIMAL(38, 2)) AS BIGINT) END"
SQL: dict[str, str] = {
    "p3_found": f"""
WITH RECURSIVE v AS (
  SELECT review_id, 'c' || {_NUM.format(c="char_id")} AS a, 's' || {_NUM.format(c="sample_index")} AS b, nullif(lower(trim(split)), '') AS s FROM hardset_review
), e AS (SELECT DISTINCT a AS x, b AS y FROM v WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT DISTINCT b, a FROM v WHERE a IS NOT NULL AND b IS NOT NULL),
lab(x, c) USING KEY (x) AS (
  SELECT x, min(least(x, y)) FROM e GROUP BY x
  UNION
  SELECT e.x, min(l.c) FROM e JOIN lab l ON l.x = e.y JOIN recurring.lab r ON r.x = e.x GROUP BY e.x HAVING min(l.c) < min(r.c)
), rows_ AS (SELECT review_id, s, coalesce(lab.c, v.a, v.b) AS c FROM v LEFT JOIN lab ON lab.x = coalesce(v.a, v.b) WHERE coalesce(v.a, v.b) IS NOT NULL)
SELECT review_id FROM rows_ WHERE c IN (SELECT c FROM rows_ GROUP BY c HAVING count(DISTINCT s) > 1)""",
}
