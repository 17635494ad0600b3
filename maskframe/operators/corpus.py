
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.text import blank_to_null, truthy
from maskframe.plans.checkpoints import Cuts
from maskframe.plans.ranking import global_row_number, number_rows


def usable(manifest: DataFrame) -> DataFrame:
    """[P2] Rows with all masks and no error."""
    return manifest.where(truthy(F.col("has_all_masks")) & (F.coalesce("errors", F.lit("")) == ""))


def strictly_usable(manifest: DataFrame) -> DataFrame:
    """[P3] As :func:`usable`, but only the literal ``true`` counts."""
    return manifest.where((F.col("has_all_masks") == "true") & (F.coalesce("errors", F.lit("")) == ""))


def group_key(*columns: str) -> Column:
    """[P7] First column with text left after trimming; empty when there is none."""
    return F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in columns], F.lit(""))


def audit_group_key() -> Column:
    """[P8] Writer, source, sample index, sample id: the first that is not empty, as it stands."""
    return F.coalesce(
        *[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("writer_id", "source_id", "sample_index", "sample_id")],
        F.lit("")
    )


def stable_key(v: Column) -> Column:
    """[P9] Whole numbers by value, other text by the first 8 hex digits of its SHA-1."""
    return F.coalesce(v.try_cast("bigint"), F.conv(F.substring(F.sha1(v), 1, 8), 16, 10).cast("bigint"))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def group_split(rows: DataFrame, key: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """[O1, J3] ``rows`` with ``split``: whole groups in stable order, cut at half-even rounded shares."""
    groups = rows.select(key).distinct().withColumn("_k", stable_key(F.col(key)))
    ranked = global_row_number(groups, [F.col("_k"), F.col(key)], "_rn")
    n = ranked.agg(F.count("*").alias("_n"))  # one row
    first, second = half_even(F.col("_n") * train), half_even(F.col("_n") * val)
    split = F.when(F.col("_rn") <= first, "train").when(F.col("_rn") <= first + second, "val").otherwise("test")
    named = ranked.crossJoin(F.broadcast(n)).select(key, split.alias("split"))
    return rows.join(named, key)


def split_counts(split: DataFrame, key: str) -> DataFrame:
    """[A2] Rows and groups of each split; distinct groups are counted in two aggregations, not in one set."""
    return split.groupBy("split", key).agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))


def audit_report(manifest: DataFrame) -> DataFrame:
    """[A1] Characters, samples, complete samples, samples with errors, in one pass."""
    bad = F.coalesce("errors", F.lit("")) != ""
    return manifest.agg(
        F.count_distinct("char_id").alias("characters"), F.count("*").alias("samples"), F.count_if((F.col("has_all_masks") == "true") & ~bad).alias("complete"),
        F.count_if(bad).alias("with_errors"), F.count_if(F.coalesce("image_path", F.lit("")) == "").alias("without_image"),
    )


def audit_errors(manifest: DataFrame) -> DataFrame:
    """[A1, P1] Error tokens with the rows that have them."""
    tokens = F.array_distinct(F.filter(F.split("errors", r"\|"), lambda x: x != ""))
    return manifest.select(F.explode(tokens).alias("error")).groupBy("error").agg(F.count("*").alias("samples"))


def mask_errors(manifest: DataFrame, channels: list[str]) -> DataFrame:
    """[P1] The error list rebuilt from the paths and shapes of a manifest row, in audit order."""
    missing = [F.when(F.coalesce(f"{c}_path", F.lit("")) == "", F.lit(f"{c}:missing")) for c in channels]
    shapes = F.array_distinct(F.filter(F.array(*[F.col(f"{c}_shape") for c in channels]), lambda s: F.coalesce(s, F.lit("")) != ""))
    errors = F.array(
        F.when(F.coalesce("image_path", F.lit("")) == "", "missing_image"),
        F.when(F.coalesce("stacked_mask_path", F.lit("")) == "", "stacked_mask:missing"), *missing,
        F.when(F.size(shapes) > 1, "mask_shape_mismatch")
    )
    return manifest.select("manifest_row_id", F.array_join(F.array_compact(errors), "|").alias("found_errors"))


def present_in_both(manifest: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """[J1] Rows whose id is among ``ids``; of repeated ids the last by ``order``."""
    cols = [c for c in manifest.columns if c != key]
    last = manifest.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")
    return last.join(ids.select(key).distinct(), key, "left_semi")


def fair_round_robin(rows: DataFrame, by: str, score: str, row_id: str, split: str, limit: int) -> DataFrame:
    """[O2, O4] Passes over the groups: in a group by split (test, val, train), score and id; groups by their first score.

    Scores are rounded half-even to 6 places before ordering.
    """
    s = F.bround(F.col(score).cast("double"), 6)
    rank = F.when(F.col(split) == "test", 0).when(F.col(split) == "val", 1).otherwise(2)
    r = rows.withColumn("_s", s).withColumn("_p", rank)
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy("_p", F.desc("_s"), row_id))).where(F.col("rn") <= limit)
    heads = r.where("rn = 1").select(by, F.col("_s").alias("_head"))
    return r.join(heads, by).orderBy("rn", F.desc("_head"), by).limit(limit).select(*rows.columns, "rn")


def _cursor_picks(sizes: list[tuple], limit: int) -> list[tuple]:
    """(place, group, rank in the group) of each pick: a cursor over the groups in order, which skips one whenever a group is used up."""
    left, picks = [[g, n, 0] for g, n in sizes if n > 0], []
    while left and len(picks) < limit:
        at = len(picks) % len(left)
        left[at][2] += 1
        picks.append((len(picks) + 1, left[at][0], left[at][2]))
        if left[at][2] == left[at][1]:
            del left[at]
    return picks


def round_robin_template(rows: DataFrame, by: str, order: str, row_id: str, limit: int) -> DataFrame:
    """[O3] ``limit`` rows in turn from the groups in name order, within a group by ``order`` as text; with their ``place``.

    The cursor counts picks and the list of groups shrinks, so a group used up makes it skip the next one. Each
    pick moves it by two groups at most, so the first ``2 * limit + 1`` groups decide; only their sizes are
    gathered. A null group has the empty name.
    """
    name = F.coalesce(F.col(by).cast("string"), F.lit(""))
    sizes = rows.groupBy(name.alias("g")).agg(F.count("*").alias("n")).orderBy("g").limit(2 * limit + 1).collect()  # bounded by the limit
    picks = rows.sparkSession.createDataFrame(_cursor_picks([(r.g, r.n) for r in sizes], limit), "_place int, _g string, _rn int")
    within = Window.partitionBy("_g").orderBy(F.coalesce(F.col(order).cast("string"), F.lit("")), row_id)
    r = rows.withColumn("_g", name).withColumn("_rn", F.row_number().over(within)).where(F.col("_rn") <= limit)
    return r.join(F.broadcast(picks), ["_g", "_rn"]).select(
        *[c for c in rows.columns if c != "place"], F.col("_place").alias("place")
    )


def systematic_sample(rows: DataFrame, order: list[str], m: int) -> DataFrame:
    """[O5] ``m`` rows at evenly spaced positions, truncated; all rows for ``m <= 0`` or ``m >= n``.

    ``order`` are columns that name a row together. Only they are ranked and written; the ``m`` keys found are
    joined back, so the rows themselves are not shuffled. Null keys sort first and are matched as equal.
    """
    cuts = Cuts(rows.sparkSession)
    ranked, n = number_rows(rows.select(*order), [F.col(c) for c in order], "_rn", cuts)
    if m <= 0 or m >= n:
        return rows
    step = F.lit((n - 1) / (m - 1) if m > 1 else 0.0)
    place = F.when(F.col("id") == m - 1, n - 1 if m > 1 else 0).otherwise(F.floor(F.col("id") * step))
    at = rows.sparkSession.range(m).select((place + 1).cast("bigint").alias("_rn")).distinct()
    picked = cuts.cut(ranked.join(at, "_rn", "left_semi").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)]))
    cuts.drop_earlier()
    same = [rows[c].eqNullSafe(picked[f"_k{i}"]) for i, c in enumerate(order)]
    return rows.join(picked, same, "left_semi")


def repeated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """[O11] Second and later rows of each key, by ``order``; blank keys are not compared.

    The first row is found by an aggregate, so a key with very many rows needs no window.
    """
    k = rows.withColumn("_key", blank_to_null(F.col(key))).where("_key IS NOT NULL")
    first = k.groupBy("_key").agg(F.min(order).alias("_first"))
    return k.join(first, "_key").where(F.col(order) > F.col("_first")).select(order, key)


def canonical_sample_id() -> Column:
    """A sample id of the form ``digits/digits``, else rebuilt from ``char_id`` and ``sample_index``; null where that fails too."""
    sid, c, i = (F.coalesce(blank_to_null(F.col(n).cast("string")), F.lit("")) for n in ("sample_id", "char_id", "sample_index"))
    return F.when(sid.rlike(r"\A[0-9]+/[0-9]+\z"), sid).when(c.rlike(r"\A[0-9]+\z") & i.rlike(r"\A[0-9]+\z"), F.concat_ws("/", c, i))


def _touched(reviews: DataFrame, signals: list[str]) -> DataFrame:
    """[R5] Reviews with any signal filled, under their names ``_id``, ``_c``, ``_i``."""
    some = F.lit(False)
    for s in signals:
        some = some | blank_to_null(F.col(s)).isNotNull()
    return reviews.where(some).withColumns({
        "_id": blank_to_null(F.col("sample_id")), "_c": F.coalesce(blank_to_null(F.col("char_id")), F.lit("")),
        "_i": F.coalesce(blank_to_null(F.col("sample_index").cast("string")), F.lit(""))
    })


def _by_names(base: DataFrame, reviews: DataFrame, signals: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base keys (``_sample``, ``_c``, ``_i``), touched reviews of a known sample, and the others."""
    b = base.select(
        F.col("sample_id").alias("_sample"), F.coalesce(blank_to_null(F.col("char_id")), F.lit("")).alias("_c"),
        F.coalesce(blank_to_null(F.col("sample_index").cast("string")), F.lit("")).alias("_i")
    )
    r, ids = _touched(reviews, signals), b.select(F.col("_sample").alias("_id"))
    return b, r.join(ids, "_id", "left_semi"), r.join(ids, "_id", "left_anti")


def unmatched_reviews(base: DataFrame, reviews: DataFrame, signals: list[str]) -> DataFrame:
    """[J4] Touched reviews that match no base row, neither by sample id nor by (char, index)."""
    b, _, lost = _by_names(base, reviews, signals)
    return lost.join(b.select("_c", "_i").distinct(), ["_c", "_i"], "left_anti").select(*reviews.columns)


def merge_reviews(base: DataFrame, reviews: DataFrame, fields: list[str], signals: list[str], strict: bool = True) -> DataFrame:
    """[J4, R5] Reviews laid over base rows: by sample id, else by (char, index); the last review wins.

    ``base`` has ``sample_id, char_id, sample_index``, unique ids; ``reviews`` those, ``fields`` and ``review_id``.
    Untouched reviews (no signal filled) are skipped; blank fields of the winning review erase. Of base rows with
    the same (char, index) the one of the greatest id stands for all. A touched review that matches nothing
    raises at once if ``strict``; else it is left out here and comes out of :func:`unmatched_reviews`.
    """
    if strict and (bad := unmatched_reviews(base, reviews, signals).first()) is not None:
        raise ValueError(f"cannot match reviewed row sample_id={bad['sample_id']!r}, key={(bad['char_id'], bad['sample_index'])!r}")
    b, known, lost = _by_names(base, reviews, signals)
    # Reviews come down to one for each name before any join, so a common sample cannot pile up.
    last = lambda d, *by: d.groupBy(*by).agg(F.max("review_id").alias("_r"), F.max_by(F.struct(*fields), "review_id").alias("_f"))
    named = last(known, "_id").withColumnRenamed("_id", "_sample")
    stands = b.groupBy("_c", "_i").agg(F.max("_sample").alias("_sample"))
    keyed = last(lost, "_c", "_i").join(stands, ["_c", "_i"]).select("_sample", "_r", "_f")
    won = named.unionByName(keyed).groupBy("_sample").agg(F.max("_r").alias("_won"), F.max_by("_f", "_r").alias("_f"))
    j = base.join(won, base["sample_id"] == won["_sample"], "left")
    return j.select(
        *[base[c] for c in base.columns if c not in ("review_id", *fields)], F.col("_won").alias("review_id"),
        *[F.col("_f")[f].alias(f) for f in fields]
    )
