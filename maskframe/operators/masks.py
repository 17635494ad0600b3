
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.operators.metrics import pair_ratio, ratio


def _around(pixels: DataFrame, by: list[str], radius: int) -> DataFrame:
    """Each pixel at every offset up to ``radius`` rows and columns away."""
    if radius < 0:
        raise ValueError("radius must be non-negative")
    d = F.sequence(F.lit(-radius), F.lit(radius))
    return pixels.select(*by, "y", "x", F.explode(d).alias("dy")).select(*by, "y", "x", "dy", F.explode(d).alias("dx")).select(
        *by, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")
    )


def clip(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def dilate(pixels: DataFrame, by: list[str], radius: int, height: int, width: int) -> DataFrame:
    """[M4, M5] Square dilation, clipped to the canvas; radius 0 is the identity."""
    return clip(_around(pixels, by, radius), height, width).distinct()


def boundary(pixels: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """[M3] Canvas cells with at least one, but not all nine, of their 3x3 neighbours set; outside counts as unset."""
    near = clip(_around(pixels.select(*by, "y", "x").distinct(), by, 1), height, width)
    return near.groupBy(*by, "y", "x").agg(F.count("*").alias("_n")).where("_n < 9").select(*by, "y", "x")


def translate(pixels: DataFrame, dy: Column | int, dx: Column | int, height: int, width: int) -> DataFrame:
    """[M6] Integer shift, clipped to the canvas."""
    dy, dx = (v if isinstance(v, Column) else F.lit(v) for v in (dy, dx))
    return clip(pixels.withColumn("y", F.col("y") + dy).withColumn("x", F.col("x") + dx), height, width)


def overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """[J9, U3] ``shared``, ``only_a``, ``only_b`` for each mask, by one aggregation over the union."""
    u = a.select(*by, "y", "x", F.lit(1).alias("_k")).unionByName(b.select(*by, "y", "x", F.lit(2).alias("_k"))).groupBy(*by, "y", "x").agg(F.bit_or("_k").alias("_k"))
    return u.groupBy(*by).agg(
        F.count_if(F.col("_k") == 3).alias("shared"), F.count_if(F.col("_k") == 1).alias("only_a"),
        F.count_if(F.col("_k") == 2).alias("only_b")
    )


def pair_scores(o: DataFrame) -> DataFrame:
    """[A11, A12] Dice and IoU of two masks; two empty ones agree."""
    shared, rest = F.col("shared"), F.col("only_a") + F.col("only_b")
    return o.select("*", pair_ratio(2 * shared, 2 * shared + rest).alias("dice"), pair_ratio(shared, shared + rest).alias("iou"))


def tolerant_counts(pred: DataFrame, target: DataFrame, by: list[str], radius: int, height: int, width: int) -> DataFrame:
    """[A7, J10] Predicted and target pixels, and those with a counterpart within ``radius``; equi-joins on shifted pixels."""
    p, t = pred.select(*by, "y", "x").distinct(), target.select(*by, "y", "x").distinct()
    keys = [*by, "y", "x"]
    parts = [
        p.select(*by, F.lit("p").alias("_k")), t.select(*by, F.lit("t").alias("_k")),
        p.join(dilate(t, by, radius, height, width), keys, "left_semi").select(*by, F.lit("ph").alias("_k")),
        t.join(dilate(p, by, radius, height, width), keys, "left_semi").select(*by, F.lit("th").alias("_k")),
    ]
    u = parts[0]
    for q in parts[1:]:
        u = u.unionByName(q)
    n = lambda k: F.count_if(F.col("_k") == k)
    return u.groupBy(*by).agg(n("p").alias("pred"), n("t").alias("target"), n("ph").alias("pred_hit"), n("th").alias("target_hit"))


def tolerant_scores(counts: DataFrame, places: int = 9) -> DataFrame:
    p, r = ratio(F.col("pred_hit"), F.col("pred")), ratio(F.col("target_hit"), F.col("target"))
    return counts.select(
        "*", F.round(p, places).alias("precision"), F.round(r, places).alias("recall"),
        F.round(ratio(2 * p * r, p + r), places).alias("f1")
    )


def centroids(pixels: DataFrame, by: list[str]) -> DataFrame:
    """[A13] Mean x and y; empty masks have no row."""
    return pixels.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("ink"))


def align_by_centroid(user: DataFrame, reference: DataFrame, by: list[str], height: int, width: int, wiggle: int = 1) -> DataFrame:
    """[M8 translation part, O10] Best shift of the reference onto the user's ink around the rounded centroid difference.

    Candidates are the shifts up to ``wiggle`` away, in row order; the first of best IoU wins.
    """
    cu, cr = centroids(user, by), centroids(reference, by).toDF(*by, "rx", "ry", "rink")
    base = cu.join(cr, by).select(
        *by, "ink", F.bround(F.col("cx") - F.col("rx")).cast("int").alias("bx"),
        F.bround(F.col("cy") - F.col("ry")).cast("int").alias("by_")
    )
    d = F.sequence(F.lit(-wiggle), F.lit(wiggle))
    cand = base.select("*", F.explode(d).alias("oy")).select("*", F.explode(d).alias("ox"))
    cand = cand.select(
        *by, "ink", (F.col("by_") + F.col("oy")).alias("dy"), (F.col("bx") + F.col("ox")).alias("dx"),
        ((F.col("oy") + wiggle) * (2 * wiggle + 1) + F.col("ox") + wiggle).alias("idx")
    )
    moved = clip(
        reference.select(*by, "y", "x").join(cand, by).select(
            *by, "ink", "dy", "dx", "idx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")
        ),
        height, width
    )
    hit = moved.join(user.select(*by, "y", "x").distinct().withColumn("u", F.lit(1)), [*by, "y", "x"], "left")
    s = hit.groupBy(*by, "ink", "dy", "dx", "idx").agg(F.count("u").alias("shared"), F.count("*").alias("moved"))
    iou = F.col("shared") / (F.col("ink") + F.col("moved") - F.col("shared"))
    best = s.withColumn("iou", iou).groupBy(*by).agg(F.max_by(F.struct("dy", "dx", "iou"), F.struct("iou", -F.col("idx"))).alias("b"))
    return best.select(*by, "b.dy", "b.dx", F.round("b.iou", 9).alias("iou"))


def pair_tolerant_scores(counts: DataFrame) -> DataFrame:
    """[A14] Tolerant F1 of single pairs: 1 for two empty masks, 0 for one; elsewhere as :func:`tolerant_scores`."""
    p, r = F.col("pred_hit") / F.col("pred"), F.col("target_hit") / F.col("target")
    f1 = F.when((F.col("pred") == 0) & (F.col("target") == 0), 1.0).when((F.col("pred") == 0) | (F.col("target") == 0), 0.0)
    return counts.select("*", f1.otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-8))).alias("f1"))


#: Names of the nine cells by row and column, and of the two kinds of difference (fixed values).
ROWS, COLUMNS = ["上部", "中部", "下部"], ["左侧", "", "右侧"]
MISSING, EXTRA = "missing_reference_structure", "extra_user_structure"


def region_name(row: Column, col: Column) -> Column:
    """Name of a cell of the 3x3 grid; the middle column is not named."""
    return F.concat(F.element_at(F.array(*map(F.lit, ROWS)), row + 1), F.element_at(F.array(*map(F.lit, COLUMNS)), col + 1))


def dominant_difference(
    user: DataFrame, reference: DataFrame, by: list[str], channel: str, channels: list[str], height: int, width: int
) -> DataFrame:
    """[A18] Per pair the channel and 3x3 grid cell with most missing or most extra pixels: ``channel``, ``row``, ``col``, ``region``, ``kind``, ``pixels``.

    Only ``channels`` count, in their order; of equal cells the first by channel, row and column wins, and within
    a cell missing pixels win over as many extra ones. A pair without any difference has no row.
    """
    mine = lambda d, k: d.where(F.col(channel).isin(channels)).select(*by, channel, "y", "x", F.lit(k).alias("_k"))
    u = mine(user, 1).unionByName(mine(reference, 2)).groupBy(*by, channel, "y", "x").agg(F.bit_or("_k").alias("_k")).where("_k <> 3")

    def cell(c: str, n: int) -> Column:
        return F.when(F.col(c) < n // 3, 0).when(F.col(c) < 2 * n // 3, 1).otherwise(2)

    g = u.groupBy(*by, channel, cell("y", height).alias("row"), cell("x", width).alias("col")).agg(
        F.count_if(F.col("_k") == 2).alias("missing"), F.count_if(F.col("_k") == 1).alias("extra")
    )
    place = F.array_position(F.array(*map(F.lit, channels)), F.col(channel))
    order = F.struct((-F.greatest("missing", "extra")).alias("n"), place.alias("p"), "row", "col")
    kind = F.when(F.col("missing") >= F.col("extra"), MISSING).otherwise(EXTRA)
    what = F.struct(
        F.col(channel).alias("channel"), "row", "col", region_name(F.col("row"), F.col("col")).alias("region"),
        kind.alias("kind"), F.greatest("missing", "extra").alias("pixels")
    )
    return g.groupBy(*by).agg(F.min_by(what, order).alias("_b")).select(*by, "_b.*")


def composite_score(
    user: DataFrame, reference: DataFrame, by: list[str], channel: str, directions: list[str], keypoint: str, radius: int,
    height: int, width: int
) -> DataFrame:
    """[A10-A12, A14, A15] Per pair: mean direction Dice, ink IoU, tolerant keypoint F1, and 100 * (0.55, 0.25, 0.20 of them).

    The masks are taken as aligned. Every pair that has a pixel on either side has a row; channels, ink and
    keypoints that are empty on both sides agree fully, keypoints empty on one side do not agree at all.
    """
    known = F.col(channel).isin(directions)
    n = len(directions)
    both = user.select(*by, channel, "y", "x", F.lit(1).alias("_k")).unionByName(reference.select(*by, channel, "y", "x", F.lit(2).alias("_k")))
    cells = both.groupBy(*by, channel, "y", "x").agg(F.bit_or("_k").alias("_k"))
    dice = cells.where(known).groupBy(*by, channel).agg((2 * F.count_if(F.col("_k") == 3) / (F.count("*") + F.count_if(F.col("_k") == 3))).alias("d"))
    dice = dice.groupBy(*by).agg(((F.sum("d") + (n - F.count("*"))) / n).alias("dice"))
    ink = cells.where(known).groupBy(*by, "y", "x").agg(F.bit_or("_k").alias("_k")).groupBy(*by).agg((F.count_if(F.col("_k") == 3) / F.count("*")).alias("iou"))
    points = lambda d: d.where(F.col(channel) == keypoint).select(*by, "y", "x")
    f1 = pair_tolerant_scores(tolerant_counts(points(user), points(reference), by, radius, height, width)).select(*by, "f1")
    pairs = both.select(*by).distinct()
    one = lambda c: F.coalesce(c, F.lit(1.0))
    j = pairs.join(dice, by, "left").join(ink, by, "left").join(f1, by, "left").select(
        *by, one("dice").alias("macro_dice"), one("iou").alias("ink_iou"), one("f1").alias("keypoint_f1")
    )
    return j.withColumn("score", 100 * (0.55 * F.col("macro_dice") + 0.25 * F.col("ink_iou") + 0.20 * F.col("keypoint_f1")))


def layout(user: DataFrame, reference: DataFrame, by: list[str], height: int, width: int) -> DataFrame:
    """[M15] Of two inks before any alignment: offsets and distance of the centres, in pixels and parts of the diagonal, and the area ratio.

    ``user`` and ``reference`` are ink pixels, one for each place. ``status`` is ``empty_mask``, with null numbers, where a side has none.
    """
    u, r = centroids(user, by), centroids(reference, by).toDF(*by, "rx", "ry", "rink")
    j = u.join(r, by, "full_outer")
    dx, dy, diagonal = F.col("cx") - F.col("rx"), F.col("cy") - F.col("ry"), F.hypot(F.lit(float(height)), F.lit(float(width)))
    return j.select(
        *by, F.when(dx.isNull(), "empty_mask").otherwise("ok").alias("status"), dx.alias("offset_x_pixels"), dy.alias("offset_y_pixels"), F.hypot(dx, dy).alias("center_distance_pixels"),
        (dx / diagonal).alias("offset_x"), (dy / diagonal).alias("offset_y"), (F.hypot(dx, dy) / diagonal).alias("center_distance"), (F.col("rink") / F.greatest("ink", F.lit(1))).alias("area_ratio"),
    )
