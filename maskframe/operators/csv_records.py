"""Uploaded CSV records: valid rows typed, failing rows with their reason.

Each record is read permissively under an explicit all-text schema that keeps the raw text of what the
reader calls corrupt. Records the reader takes and that hold no quote have the right shape. The marked ones are
reclassified against their own file header, by quoting and field count; so are, as a supplement, the unmarked
ones with quotes, since the reader is lenient there, and the few records the reader cannot be given at all.
Values are checked last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import whole_number

#: A well-formed quoted field; all quantifiers are possessive, so long fields need no stack.
QUOTED = r'(?<=\A|,)"(?:[^"]++|"")*+"(?=,|\z)'
BAD_QUOTING, BAD_COUNT, NO_HEADER = "bad_quoting", "wrong_column_count", "no_header"
#: Column -> (pattern of admissible values after trimming, reason).
RULES = {
    "sample_id": (r"\A[0-9]+/[0-9]+\z", "invalid_sample_id"),
    "keep": (r"\A(?:[yY][eE][sS]|[nN][oO])?\z", "invalid_keep"),
    "difficulty_crossing": (r"\A[01]?\z", "invalid_difficulty_crossing"),
}
FLAGS = ["difficulty_crossing", "difficulty_adhesion", "difficulty_endpoint", "difficulty_line_width", "difficulty_background", "difficulty_style"]
TEXTS = ["split", "priority", "reviewer", "notes"]
#: The reader's record ends at the first ``lineSep`` and it takes a NUL for a comment: records with either sign are not given to it, nor are empty ones, which it skips.
OPTIONS = {
    "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "true",
    "lineSep": "\x01", "maxCharsPerColumn": "-1", "emptyValue": ""
}
UNREADABLE = r"[\x00\x01]"
#: Records with more separators are not given to the reader, which throws beyond ``maxColumns`` in spite of PERMISSIVE.
MOST_SEPARATORS = 20_000


def bare(c: Column) -> Column:
    """The record without one closing CR; null is an empty record."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\z", "")


def outline(c: Column) -> Column:
    """The record with each well-formed quoted field replaced by one letter: quotes left over are errors, commas count fields."""
    return F.when(F.contains(c, F.lit('"')), F.regexp_replace(c, QUOTED, "q")).otherwise(c)


def width(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(","), F.lit(""))) + 1


def cells_of(c: Column) -> Column:
    """Cells of a well-formed record, by pattern, for records the reader cannot be given."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(r',("(?:[^"]++|"")*+"|[^",]*+)'), F.lit(1))
    return F.transform(
        raw,
        lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    )


def headers(raw: DataFrame) -> DataFrame:
    """``file_name`` and its column names in order, from record 1; of several the one with the lowest ``raw_id``."""
    h = raw.where("line_no = 1").groupBy("file_name").agg(F.min_by("record_text", "raw_id").alias("_h"))
    names = F.split(F.regexp_replace(bare(F.col("_h")), r"\A\x{FEFF}", ""), ",", -1)
    return h.select("file_name", F.transform(names, lambda x: F.lower(F.btrim(F.regexp_replace(x, '"', ""), F.lit(" \t")))).alias("_names"))


def classify(raw: DataFrame) -> DataFrame:
    """Records of ``raw`` (``raw_id, file_name, line_no, record_text``) but headers, with ``reason`` and ``fields``.

    ``reason`` is null for a valid record, else the first failing check: no header, quoting, field count,
    then ``sample_id``, ``keep`` and ``difficulty_crossing`` where the header has them. ``fields`` maps column
    to text for records of the right shape, ``corrupt_text`` keeps the raw text of failing ones, ``marked`` tells
    whether the reader called the record corrupt (null where it was not given to it). A null record is an empty
    one; a null ``line_no`` is no header; repeated rows are judged each for itself. Other columns of ``raw`` are
    kept, unless they are named like a result. An empty table gives no rows.
    """
    heads = headers(raw)
    widest = heads.agg(F.max(F.size("_names"))).first()[0] or 1
    schema = ", ".join(f"c{i} STRING" for i in range(widest)) + ", _corrupt STRING"
    out = [c for c in raw.columns if c not in ("reason", "corrupt_text", "fields", "marked")]
    body = raw.where(~F.col("line_no").eqNullSafe(1)).select(
        F.struct(*out).alias("_row"), "file_name", "record_text"
    ).join(heads, "file_name", "left")
    body = body.withColumn("_text", bare(F.col("record_text")))
    # One schema for all files: records of narrower files get the separators they lack.
    given = F.col("_names").isNotNull() & (F.col("_text") != "") & ~F.col("_text").rlike(UNREADABLE) & (width(F.col("_text")) <= MOST_SEPARATORS)
    padded = F.concat("_text", F.repeat(F.lit(","), F.lit(widest) - F.size("_names")))
    body = body.withColumn("_read", F.from_csv(F.when(given, padded), schema, OPTIONS | {"maxColumns": str(MOST_SEPARATORS + widest)}))
    taken = F.col("_read").isNotNull() & F.col("_read._corrupt").isNull()
    body = body.withColumn("_taken", taken).withColumn("_marked", F.when(F.col("_names").isNotNull() & F.col("_read").isNotNull(), ~taken))
    # What is not proved right by the reader is outlined: marked, not given, or with quotes.
    body = body.withColumn("_outline", F.when(~F.col("_taken") | F.contains("_text", F.lit('"')), outline(F.col("_text"))))
    quoting = F.coalesce(F.contains(F.col("_outline"), F.lit('"')), F.lit(False))
    count = F.coalesce(width(F.col("_outline")) != F.size("_names"), F.lit(False))
    read = F.slice(F.array(*[F.coalesce(F.col(f"_read.c{i}"), F.lit("")) for i in range(widest)]), F.lit(1), F.size("_names"))
    body = body.withColumn("_cells", F.when(~quoting & ~count, F.when(F.col("_taken"), read).otherwise(cells_of(F.col("_text")))))

    def cell(name: str) -> Column:
        at = F.array_position("_names", F.lit(name))
        return F.when(at > 0, F.btrim(F.try_element_at("_cells", at.cast("int")), F.lit(" \t")))

    reason = F.when(F.col("_names").isNull(), NO_HEADER).when(quoting, BAD_QUOTING).when(count, BAD_COUNT)
    for name, (pattern, why) in RULES.items():
        reason = reason.when(~cell(name).rlike(pattern), why)
    body = body.withColumn("reason", reason)
    wanted = {n: cell(n) for n in ("sample_id", "char_id", "sample_index", "keep", *FLAGS, *TEXTS)}
    corrupt = F.when(F.col("reason").isNotNull(), F.col("record_text"))
    judged = F.struct(
        "reason", corrupt.alias("corrupt_text"), F.struct(*[v.alias(n) for n, v in wanted.items()]).alias("fields"),
        F.col("_marked").alias("marked")
    )
    # One-element explode: filters on the verdict stay above it, so the regular expressions run once a record.
    return body.select("_row", F.explode(F.array(judged)).alias("_judged")).select("_row.*", "_judged.*")


def valid_rows(classified: DataFrame) -> DataFrame:
    """The valid records with typed columns; a value that is blank or of another type is null."""
    f = lambda n: F.col(f"fields.{n}")
    text = lambda n: F.when(f(n) != "", f(n)).alias(n)
    return classified.where("reason IS NULL").select(
        "raw_id", "file_name", "line_no", text("sample_id"), whole_number(f("char_id")).alias("char_id"), whole_number(f("sample_index")).alias("sample_index"),
        *[f(n).try_cast("int").alias(n) for n in FLAGS], F.when(
            f("keep") != "", F.lower(f("keep")) == "yes"
        ).alias("keep"), *[text(n) for n in TEXTS],
    )


def failing_rows(classified: DataFrame) -> DataFrame:
    """The failing records with reason and raw text."""
    return classified.where("reason IS NOT NULL").select("raw_id", "file_name", "line_no", "reason", "corrupt_text")
