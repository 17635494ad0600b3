"""

Masks are pixel relations ``(mask columns, channel, y, x)``; any number of masks is one job. Counts are summed
over the corpus before ratios are taken, so they merge like those of a meter.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.operators.corpus import usable
from maskframe.operators.masks import boundary
from maskframe.operators.metrics import ratio
from maskframe.operators.scoring import CHANNELS, DIRECTIONS

KEYPOINT = CHANNELS[-1]


def thresholds(defaults: Mapping[str, float] | None = None, calibrated: Mapping | None = None) -> dict[str, float]:
    """[P12] Threshold of every channel: 0.5, the configured one, or the calibrated one (a map, or under ``best_thresholds``)."""
    out = {c: float((defaults or {}).get(c, 0.5)) for c in CHANNELS}
    best = (calibrated or {}).get("best_thresholds", calibrated or {})
    return out | {c: float(best[c]) for c in CHANNELS if c in best}


def above_threshold(probabilities: DataFrame, limits: Mapping[str, float], channel: str = "channel", p: str = "p") -> DataFrame:
    """[P11] Pixels whose probability reaches their channel's threshold, compared in 32-bit floats; unknown channels and nulls never do."""
    at = F.create_map(*[x for c, t in limits.items() for x in (F.lit(c), F.lit(float(t)).cast("float"))])
    return probabilities.where(F.coalesce(F.col(p).cast("float") >= F.try_element_at(at, F.col(channel)), F.lit(False))).drop(p)


def _counts(pred: DataFrame, target: DataFrame, by: list[str], channel: str) -> DataFrame:
    keys = [*by, channel, "y", "x"]
    both = pred.select(*keys, F.lit(1).alias("_k")).unionByName(target.select(*keys, F.lit(2).alias("_k"))).groupBy(*keys).agg(F.bit_or("_k").alias("_k"))
    return both.groupBy(channel).agg(
        F.count_if(F.col("_k") == 3).alias("tp"), F.count_if(F.col("_k") == 1).alias("fp"),
        F.count_if(F.col("_k") == 2).alias("fn")
    )


def evaluate_channels(pred: DataFrame, target: DataFrame, by: list[str], height: int, width: int, channel: str = "channel") -> DataFrame:
    """[A3, A4, A5, A6] One row for each of the six channels: ``tp, fp, fn, dice, iou, precision, recall, boundary_f1``.

    ``by`` names the masks; pixels off the canvas or of other channels are left out, repeated ones count once. A
    ratio without a denominator is 0, so channels that are empty everywhere have zeros.
    """
    some = lambda d: d.where(F.col(channel).isin(CHANNELS) & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(*by, channel, "y", "x")
    p, t = some(pred), some(target)
    edge = _counts(
        boundary(p, [*by, channel], height, width), boundary(t, [*by, channel], height, width), by, channel
    ).toDF(channel, "b1", "b2", "b3")
    names = pred.sparkSession.createDataFrame([(i, c) for i, c in enumerate(CHANNELS)], f"place int, {channel} string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = names.join(_counts(p, t, by, channel), channel, "left").join(edge, channel, "left").select(
        "place", channel, *map(zero, ("tp", "fp", "fn", "b1", "b2", "b3"))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return j.select(
        "place", channel, "tp", "fp", "fn", ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(tp, tp + fp + fn).alias("iou"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * F.col("b1"), 2 * F.col("b1") + F.col("b2") + F.col("b3")).alias("boundary_f1"),
    )


def evaluate(
    pred: DataFrame, target: DataFrame, by: list[str], height: int, width: int, radii: list[int] | None = None,
    channel: str = "channel"
) -> DataFrame:
    """[A4-A7] The meter's figures as rows ``metric``, ``channel``, ``radius``, ``value``.

    ``dice``, ``iou``, ``precision``, ``recall``, ``boundary_f1`` of each channel; ``macro_dice``, ``macro_iou`` and
    ``macro_boundary_f1`` over the five directions; ``keypoint_f1``; and ``keypoint_precision``, ``keypoint_recall``,
    ``keypoint_tolerant_f1`` for each radius.
    """
    per = evaluate_channels(pred, target, by, height, width, channel)
    names = ["dice", "iou", "precision", "recall", "boundary_f1"]
    none = F.lit(None)
    row = lambda m, c, v: F.struct(
        F.lit(m).alias("metric"), c.cast("string").alias("channel"), none.cast("int").alias("radius"), v.alias("value")
    )
    out = per.select(F.explode(F.array(*[row(m, F.col(channel), F.col(m)) for m in names])).alias("m")).select("m.*")
    five = lambda c: F.avg(F.when(F.col(channel) != KEYPOINT, F.col(c)))
    macro = per.agg(
        five("dice").alias("macro_dice"), five("iou").alias("macro_iou"), five("boundary_f1").alias("macro_boundary_f1"),
        F.max(F.when(F.col(channel) == KEYPOINT, F.col("dice"))).alias("keypoint_f1")
    )
    out = out.unionByName(macro.select(F.explode(F.array(*[row(m, none, F.col(m)) for m in macro.columns])).alias("m")).select("m.*"))
    if not radii:
        return out
    points = lambda d: d.where(F.col(channel) == KEYPOINT).select(*by, "y", "x").distinct()
    p, t, sizes = points(pred), points(target), sorted(set(radii))
    one = p.agg(F.count("*").alias("_p"))
    for part in (t.agg(F.count("*").alias("_t")), _within(p, t, by, sizes, "_ph"), _within(t, p, by, sizes, "_th")):
        one = one.crossJoin(part)  # one row each
    rows = []
    for r in sizes:
        q, w = ratio(F.col(f"_ph{r}"), F.col("_p")), ratio(F.col(f"_th{r}"), F.col("_t"))
        values = {"keypoint_precision": q, "keypoint_recall": w, "keypoint_tolerant_f1": ratio(2 * q * w, q + w)}
        rows += [
            F.struct(F.lit(m).alias("metric"), F.lit(KEYPOINT).alias("channel"), F.lit(r).alias("radius"), v.alias("value"))
            for m, v in values.items()
        ]
    return out.unionByName(one.select(F.explode(F.array(*rows)).alias("m")).select("m.*"))


def _within(a: DataFrame, b: DataFrame, by: list[str], radii: list[int], name: str) -> DataFrame:
    """[J10, A7] One row: pixels of ``a`` that have one of ``b`` within each radius, by their distance to the nearest one up to the largest radius."""
    if radii[0] < 0:
        raise ValueError("radius must be non-negative")
    d = F.sequence(F.lit(-radii[-1]), F.lit(radii[-1]))
    near = a.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(d).alias("_dy"))
    near = near.select(*by, "_y", "_x", "_dy", F.explode(d).alias("_dx"))
    near = near.select(
        *by, "_y", "_x", (F.col("_y") + F.col("_dy")).alias("y"), (F.col("_x") + F.col("_dx")).alias("x"),
        F.greatest(F.abs("_dy"), F.abs("_dx")).alias("_d")
    )
    least = near.join(b, [*by, "y", "x"]).groupBy(*by, "_y", "_x").agg(F.min("_d").alias("_d"))
    return least.agg(*[F.count_if(F.col("_d") <= r).alias(f"{name}{r}") for r in radii])


#: Notes beside a score (fixed values).
UNREADABLE_NOTE, SCORE_NOTE = "标签不可读取，需人工确认", "自动候选：多通道重叠 %.1f%%，方向覆盖 %d/5"


def hard_scores(rows: DataFrame, pixels: DataFrame, by: list[str], channel: str = "channel") -> DataFrame:
    """[A16] ``rows`` with ``hard_score`` = 100 overlap / union + 4 occupied directions + min(200 keypoints / union, 8), and ``reason``.

    Overlap are the places in two or more of the five directions, union those in any, at least 1. Rows without
    any pixel, unreadable ones among them, have score 0.
    """
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(1 << i))]), F.col(channel))
    places = pixels.where(F.col(channel).isin(CHANNELS)).groupBy(*by, "y", "x").agg(F.bit_or(bit).alias("b"))
    five = F.col("b").bitwiseAND(31)
    per = places.groupBy(*by).agg(
        F.count_if(five > 0).alias("_n"), F.count_if(F.bit_count(five) >= 2).alias("_two"),
        F.bit_count(F.bit_or(five)).alias("_used"), F.count_if(F.col("b") > 31).alias("_key")
    )
    union = F.greatest("_n", F.lit(1))
    score = 100.0 * F.col("_two") / union + 4.0 * F.col("_used") + F.least(F.col("_key") / union * 200.0, F.lit(8.0))
    note = F.format_string(SCORE_NOTE, 100.0 * F.col("_two") / union, F.col("_used"))
    return rows.join(per, by, "left").select(
        *rows.columns, F.coalesce(score, F.lit(0.0)).alias("hard_score"),
        F.when(F.col("_n").isNull(), UNREADABLE_NOTE).otherwise(note).alias("reason")
    )


def eligible(manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """[P4, J2] Usable rows whose sample is in the validation or test split, with ``split``; a sample has one split, of several the last by name."""
    s = splits.groupBy("sample_id").agg(F.max("split").alias("split")).where(F.col("split").isin("val", "test"))
    return usable(manifest.drop("split")).join(s, "sample_id").select(*[c for c in manifest.columns if c != "split"], "split")


def direction_weights(sizes: DataFrame, pixels: DataFrame, by: list[str], most: float = 100.0, channel: str = "channel") -> DataFrame:
    """[A9] ``channel``, ``positives``, ``ratio``, ``weight`` of the five directions: negatives over positives, within [1, ``most``].

    ``sizes`` has one row for each mask, with ``height`` and ``width``; sample them with ``systematic_sample``.
    Positives below 1 count as 1; masks that are not in ``sizes`` do not count.
    """
    total = sizes.agg(F.coalesce(F.sum(F.col("height").cast("bigint") * F.col("width")), F.lit(0)).alias("_all"))  # one row
    set_ = pixels.where(F.col(channel).isin(DIRECTIONS)).join(sizes.select(*by), by, "left_semi").select(*by, channel, "y", "x").distinct().groupBy(channel).agg(F.count("*").alias("n"))
    names = sizes.sparkSession.createDataFrame([(c,) for c in DIRECTIONS], f"{channel} string")
    j = names.join(set_, channel, "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    weight = F.least(F.greatest((F.col("_all") - F.col("n")) / F.greatest("n", F.lit(1)), F.lit(1.0)), F.lit(most))
    return j.select(channel, F.col("n").alias("positives"), (F.col("n") / F.greatest("_all", F.lit(1))).alias("ratio"), weight.alias("weight"))
