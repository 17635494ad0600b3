
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """[G2] Metrics convention: 0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def pair_ratio(a: Column, b: Column) -> Column:
    """[G2] Pair convention: two empty masks agree, hence 1."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a / b)


def confusion(rows: DataFrame, by: list[str], pred: Column, target: Column) -> DataFrame:
    """[A3, A5] Mergeable counts; partial sums are taken before the shuffle."""
    return rows.groupBy(*by).agg(
        F.count_if(pred & target).alias("tp"), F.count_if(pred & ~target).alias("fp"), F.count_if(~pred & target).alias("fn"),
        F.count_if(~pred & ~target).alias("tn")
    )


def scores(counts: DataFrame, places: int = 9) -> DataFrame:
    """[A4] Dice, IoU, precision and recall over ``tp, fp, fn``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    r = lambda c: F.round(c, places)
    return counts.select(
        "*", r(ratio(2 * tp, 2 * tp + fp + fn)).alias("dice"), r(ratio(tp, tp + fp + fn)).alias("iou"),
        r(ratio(tp, tp + fp)).alias("precision"), r(ratio(tp, tp + fn)).alias("recall")
    )


def calibrate_counts(
    rows: DataFrame, channel: str, p: str, target: str, count: str, lo: float = 0.10, hi: float = 0.90, steps: int = 17
) -> DataFrame:
    """[A8, J12] Threshold of best Dice for each channel, the first of equals, over counted rows.

    Probabilities are bucketed once; counts at a threshold are sums from its bucket upwards, so rows never
    meet the grid of thresholds.
    """
    grid = [lo + i * (hi - lo) / (steps - 1) for i in range(steps)]
    bucket = F.lit(0)
    for i, t in enumerate(grid):
        bucket = F.when(F.col(p) >= F.lit(t), i + 1).otherwise(bucket)
    hist = rows.groupBy(channel, bucket.alias("b")).agg(F.sum(count).alias("n"), F.sum(F.when(F.col(target), F.col(count)).otherwise(0)).alias("pos"))
    per = hist.groupBy(channel).agg(
        F.map_from_entries(F.collect_list(F.struct("b", F.struct("n", "pos")))).alias("h"), F.sum("pos").alias("all_pos")
    )  # at most steps + 1 entries
    at = per.select(channel, "h", "all_pos", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k"))
    up = lambda f: F.aggregate(
        F.sequence("k", F.lit(steps)), F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.coalesce(F.try_element_at("h", i)[f], F.lit(0))
    )
    at = at.withColumn("tp", up("pos")).withColumn("hit", up("n"))
    dice = 2 * F.col("tp") / F.greatest(F.col("hit") + F.col("all_pos"), F.lit(1))
    best = at.withColumn("dice", dice).groupBy(channel).agg(F.max_by(F.struct("k", "dice"), F.struct("dice", -F.col("k"))).alias("b"))
    threshold = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("b.k"))
    return best.select(channel, F.round(threshold, 6).alias("threshold"), F.round("b.dice", 9).alias("dice"))


def calibrate(rows: DataFrame, channel: str, p: str, target: str, lo: float = 0.10, hi: float = 0.90, steps: int = 17) -> DataFrame:
    """[A8] As :func:`calibrate_counts`, over single rows."""
    return calibrate_counts(rows.withColumn("_one", F.lit(1).cast("bigint")), channel, p, target, "_one", lo, hi, steps)


def class_balance(rows: DataFrame, channel: str, most: float = 50.0) -> DataFrame:
    """[A9] Weight of the positives of each class against all other rows, clipped to [1, ``most``]."""
    per = rows.groupBy(channel).agg(F.count("*").alias("positives"))
    total = per.agg(F.sum("positives").alias("total"))  # one row
    raw = (F.col("total") - F.col("positives")) / F.greatest("positives", F.lit(1))
    return per.crossJoin(F.broadcast(total)).select(
        channel, "positives", F.round(F.least(F.greatest(raw, F.lit(1.0)), F.lit(most)), 9).alias("weight")
    )


def best_epoch(series: DataFrame, by: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """[A24] Per series: the epoch of the last strict improvement before ``patience`` epochs without one, and where it stopped."""
    w = Window.partitionBy(*by).orderBy(epoch)
    s = series.withColumn("_i", F.row_number().over(w)).withColumn("_best", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_up", F.when(F.col("_best").isNull() | (F.col(value) > F.col("_best")), F.col("_i")))
    s = s.withColumn("_last", F.last("_up", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_stop", F.col("_i") - F.col("_last") >= patience)
    ends = s.groupBy(*by).agg(F.min(F.when(F.col("_stop"), F.col("_i"))).alias("_at"), F.max("_i").alias("_n"))
    s = s.join(ends, by).where(F.col("_i") <= F.coalesce("_at", "_n"))
    return s.where(F.col("_up").isNotNull()).groupBy(*by).agg(
        F.max_by(epoch, "_i").alias("best_epoch"), F.max(value).alias("best_value"),
        F.first(F.coalesce("_at", "_n")).alias("epochs_run")
    )
