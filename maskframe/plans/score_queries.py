"""Queries of scoring, evaluation, findings and course operators, with their SQL equivalents.

Masks are the cells of ``part`` folded onto a small canvas: five mask pairs, each with a learner's and a reference side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import courses as K
from maskframe.operators import evaluation as E
from maskframe.operators import masks as M
from maskframe.operators import rules as R
from maskframe.operators import scoring as S
from maskframe.sources import masks as N
from maskframe.sources.tables import table

HEIGHT, WIDTH = 51, 48
LETTERS = {"E": "vec1", "L": "vec2", "M": "vec3", "P": "vec4", "S": "vec5"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, base) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cells(spark: SparkSession, base: str) -> DataFrame:
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), F.substring("p_type", 1, 1))
    return (
        table(spark, base, "part").select(
            (F.col("p_partkey") % 5).cast("int").alias("pair"), (F.floor(F.col("p_partkey") / 5) % 2).cast("int").alias("side"), F.col("p_size").alias("y"),
            ((F.col("p_partkey") * 7) % WIDTH).cast("int").alias("x"), F.when(
                F.substring("p_brand", -1, 1) == "0", "keypoint"
            ).otherwise(letter).alias("channel"),
        ).distinct()
    )


def _two(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    c = _cells(spark, base)
    return tuple(c.where(F.col("side") == s).drop("side") for s in (0, 1))


def _round(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTERS.items())
_PX = f"""px AS (SELECT DISTINCT CAST(p_partkey % 5 AS INT) AS pair, CAST((p_partkey // 5) % 2 AS INT) AS side, p_size AS y, CAST((p_partkey * 7) % 48 AS INT) AS x,
  CASE WHEN right(p_brand, 1) = '0' THEN 'keypoint' ELSE CASE left(p_type, 1) {_CASE} END END AS channel FROM part),
a AS (SELECT pair, channel, y, x FROM px WHERE side = 0), b AS (SELECT pair, channel, y, x FROM px WHERE side = 1)"""
_PLACES = ", ".join(f"('{c}', {i})" for i, c in enumerate(S.CHANNELS))
_INKS = "ua AS (SELECT DISTINCT pair, y, x FROM a WHERE channel <> 'keypoint'), ub AS (SELECT DISTINCT pair, y, x FROM b WHERE channel <> 'keypoint')"


def _agreement(other: str) -> str:
    """Evidence of ``a`` against the pixels ``other``, for every pair."""
    near = f"SELECT DISTINCT pair, y + dy AS y, x + dx AS x FROM {{t}}, range(-{S.RADIUS}, {S.RADIUS} + 1) v(dy), range(-{S.RADIUS}, {S.RADIUS} + 1) h(dx) WHERE channel = 'keypoint' AND y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 47"
    return f"""o AS (SELECT coalesce(a.pair, m.pair) AS pair, coalesce(a.channel, m.channel) AS channel, count_if(a.y IS NOT NULL AND m.y IS NOT NULL) AS n, count(*) AS u FROM a FULL JOIN {other} m ON a.pair = m.pair AND a.channel = m.channel AND a.y = m.y AND a.x = m.x GROUP BY 1, 2),
d AS (SELECT pair, (sum(2 * n / (n + u)::DOUBLE) + 5 - count(*)) / 5 AS dice FROM o WHERE channel <> 'keypoint' GROUP BY pair),
ma AS (SELECT DISTINCT pair, y, x FROM a WHERE channel <> 'keypoint'), mb AS (SELECT DISTINCT pair, y, x FROM {other} WHERE channel <> 'keypoint'),
i AS (SELECT coalesce(ma.pair, mb.pair) AS pair, count_if(ma.y IS NOT NULL AND mb.y IS NOT NULL) / count(*)::DOUBLE AS iou FROM ma FULL JOIN mb ON ma.pair = mb.pair AND ma.y = mb.y AND ma.x = mb.x GROUP BY 1),
ka AS (SELECT pair, count(*) AS n, count_if((pair, y, x) IN ({near.format(t=other)})) AS hit FROM a WHERE channel = 'keypoint' GROUP BY pair),
kb AS (SELECT pair, count(*) AS n, count_if((pair, y, x) IN ({near.format(t='a')})) AS hit FROM {other} WHERE channel = 'keypoint' GROUP BY pair),
pairs AS (SELECT pair FROM a UNION SELECT pair FROM {other}),
f AS (SELECT pairs.pair, CASE WHEN ka.n IS NULL AND kb.n IS NULL THEN 1.0::DOUBLE WHEN ka.n IS NULL OR kb.n IS NULL THEN 0.0::DOUBLE ELSE 2 * (ka.hit / ka.n::DOUBLE) * (kb.hit / kb.n::DOUBLE) / greatest(ka.hit / ka.n::DOUBLE + kb.hit / kb.n::DOUBLE, 1e-8) END AS f1 FROM pairs LEFT JOIN ka USING (pair) LEFT JOIN kb USING (pair)),
e AS (SELECT pair, coalesce(dice, 1.0) AS dice, coalesce(iou, 1.0) AS iou, f1 FROM f LEFT JOIN d USING (pair) LEFT JOIN i USING (pair))"""


@query(f"WITH {_PX}, {_agreement('b')} SELECT pair, round(dice, 9) AS macro_dice, round(iou, 9) AS ink_iou, round(f1, 9) AS keypoint_f1, round(100 * (0.55::DOUBLE * dice + 0.25::DOUBLE * iou + 0.20::DOUBLE * f1), 6) AS score FROM e")
def composite_score(spark: SparkSession, base: str) -> DataFrame:
    a, b = _two(spark, base)
    s = M.composite_score(a, b, ["pair"], "channel", S.DIRECTIONS, "keypoint", S.RADIUS, HEIGHT, WIDTH)
    return _round(_round(s, "macro_dice", "ink_iou", "keypoint_f1"), "score", places=6)


_LAYOUT = """ca AS (SELECT pair, avg(x) AS ux, avg(y) AS uy, count(*) AS un FROM ua GROUP BY pair), cb AS (SELECT pair, avg(x) AS rx, avg(y) AS ry, count(*) AS rn FROM ub GROUP BY pair),
lay AS (SELECT pair, ux - rx AS dx, uy - ry AS dy, sqrt((ux - rx) * (ux - rx) + (uy - ry) * (uy - ry)) AS r, sqrt(51.0::DOUBLE * 51 + 48 * 48) AS g, rn / un::DOUBLE AS ratio FROM ca FULL JOIN cb USING (pair))"""
_LAYOUT_OUT = "round(dx, 9) AS offset_x_pixels, round(dy, 9) AS offset_y_pixels, round(r, 9) AS center_distance_pixels, round(dx / g, 9) AS offset_x, round(dy / g, 9) AS offset_y, round(r / g, 9) AS center_distance, round(ratio, 9) AS area_ratio"


@query(f"WITH {_PX}, {_INKS}, {_LAYOUT} SELECT pair, CASE WHEN dx IS NULL THEN 'empty_mask' ELSE 'ok' END AS status, {_LAYOUT_OUT} FROM lay")
def mask_layout(spark: SparkSession, base: str) -> DataFrame:
    ink = lambda d: d.where("channel <> 'keypoint'").select("pair", "y", "x").distinct()
    a, b = _two(spark, base)
    out = M.layout(ink(a), ink(b), ["pair"], HEIGHT, WIDTH)
    return _round(out, *[c for c in out.columns if c not in ("pair", "status")])


_CANDIDATES = ", ".join(
    f"({i * len(S.TURNS) + k}, {float(s)!r}::DOUBLE, {float(t)!r}::DOUBLE, {g[0]}, {g[1]}, {g[2]}, {g[3]}, {g[4]!r}::DOUBLE, {g[5]!r}::DOUBLE)"
    for i, s in enumerate(S.SCALES) for k, t in enumerate(S.TURNS) for g in [S.geometry(HEIGHT, WIDTH, float(s), float(t))]
)
_ALIGN = f"""cand(idx, scale, turn, sh, sw, oy, ox, c, s) AS (VALUES {_CANDIDATES}),
g0 AS (SELECT cand.*, vy.y, vx.x, y + 0.5::DOUBLE - 25.5::DOUBLE AS dy, x + 0.5::DOUBLE - 24.0::DOUBLE AS dx FROM cand, range(51) vy(y), range(48) vx(x)),
g1 AS (SELECT *, CAST(floor(s * dx + c * dy + 25.5::DOUBLE) AS INT) - oy AS yy, CAST(floor(c * dx - s * dy + 24.0::DOUBLE) AS INT) - ox AS xx FROM g0),
src AS (SELECT idx, y, x, CAST(floor((yy + 0.5::DOUBLE) * 51 / sh) AS INT) AS sy, CAST(floor((xx + 0.5::DOUBLE) * 48 / sw) AS INT) AS sx FROM g1 WHERE yy >= 0 AND yy < sh AND xx >= 0 AND xx < sw AND yy + oy BETWEEN 0 AND 50 AND xx + ox BETWEEN 0 AND 47),
t AS (SELECT pair, idx, src.y, src.x FROM ub JOIN src ON ub.y = src.sy AND ub.x = src.sx),
tc AS (SELECT pair, idx, avg(x) AS mx, avg(y) AS my FROM t GROUP BY pair, idx),
sh AS (SELECT pair, idx, CAST(round_even(ux - mx, 0) AS INT) AS dx, CAST(round_even(uy - my, 0) AS INT) AS dy, un FROM tc JOIN ca USING (pair)),
m0 AS (SELECT pair, idx, t.y + dy AS y, t.x + dx AS x FROM t JOIN sh USING (pair, idx) WHERE t.y + dy BETWEEN 0 AND 50 AND t.x + dx BETWEEN 0 AND 47),
q AS (SELECT m0.pair, m0.idx, count(ua.y) AS n, count(*) AS k FROM m0 LEFT JOIN ua ON ua.pair = m0.pair AND ua.y = m0.y AND ua.x = m0.x GROUP BY 1, 2),
best AS (SELECT sh.pair, sh.idx, dx, dy, coalesce(n / (un + k - n)::DOUBLE, 0.0) AS align_iou FROM sh LEFT JOIN q USING (pair, idx) QUALIFY row_number() OVER (PARTITION BY sh.pair ORDER BY coalesce(n / (un + k - n)::DOUBLE, 0.0) DESC, sh.idx) = 1),
m1 AS (SELECT b.pair, channel, src.y + dy AS y, src.x + dx AS x FROM b JOIN best ON best.pair = b.pair JOIN src ON src.idx = best.idx AND b.y = src.sy AND b.x = src.sx WHERE src.y + dy BETWEEN 0 AND 50 AND src.x + dx BETWEEN 0 AND 47)"""
_SCORE = "100 * (0.55::DOUBLE * dice + 0.25::DOUBLE * iou + 0.20::DOUBLE * f1)"
_WORST = f"w AS (SELECT pairs.pair, p.name, coalesce(2 * n / (n + u)::DOUBLE, 1.0) AS v FROM pairs, (VALUES {_PLACES}) p(name, place) LEFT JOIN o ON o.pair = pairs.pair AND o.channel = p.name WHERE place < 5 QUALIFY row_number() OVER (PARTITION BY pairs.pair ORDER BY coalesce(2 * n / (n + u)::DOUBLE, 1.0), place) = 1)"
_STYLE = f"WITH {_PX}, {_INKS}, {_LAYOUT}, {_ALIGN}, {_agreement('m1')}, {_WORST}"


def _scored(spark: SparkSession, base: str) -> DataFrame:
    a, b = _two(spark, base)
    u, r = (S.rasterize_cubes(d, ["pair"], HEIGHT, WIDTH) for d in (a, b))
    pairs = u.withColumnRenamed("cube", "user").join(r.select("pair", F.col("cube").alias("reference")), "pair")
    return S.score_pairs(pairs, ["pair"], "user", "reference")


def _worst(s: DataFrame) -> Column:
    return S.worst_direction([(c, F.col(f"dice_{c}")) for c in S.DIRECTIONS])


@query(
    _STYLE + f""" SELECT e.pair, 'ok' AS status, round({_SCORE}, 6) AS score, round(dice, 9) AS macro_dice, round(iou, 9) AS ink_iou, round(f1, 9) AS keypoint_f1, {_LAYOUT_OUT.replace('round(dx,', 'round(lay.dx,').replace('round(dy,', 'round(lay.dy,').replace('dx / g', 'lay.dx / g').replace('dy / g', 'lay.dy / g')},
round(scale, 6) AS scale, turn, best.dx AS dx, best.dy AS dy, round(align_iou, 9) AS align_iou, CASE WHEN {_SCORE} >= 90 THEN 'high_reference_match' WHEN {_SCORE} >= 70 THEN 'moderate_reference_match' ELSE 'low_reference_match' END AS band, w.name AS worst_channel, round(w.v, 9) AS worst_dice
FROM e JOIN lay USING (pair) JOIN best USING (pair) JOIN cand USING (idx) JOIN w USING (pair)"""
)
def style_scores(spark: SparkSession, base: str) -> DataFrame:
    """Alignment over 63 scales and turns, then the whole evidence of each pair."""
    s = _scored(spark, base)
    s = s.select(
        *[c for c in s.columns if c != "aligned" and not c.startswith("dice_")], S.match_band(F.col("score")).alias("band"),
        _worst(s)["channel"].alias("worst_channel"), _worst(s)["dice"].alias("worst_dice")
    )
    places = {c: 6 if c in ("score", "scale") else 9 for c in s.columns if c not in ("pair", "status", "turn", "dx", "dy", "band", "worst_channel")}
    return s.withColumns({c: F.round(c, k) for c, k in places.items()})


_DIFF = f"""x AS (SELECT coalesce(a.pair, m.pair) AS pair, coalesce(a.channel, m.channel) AS channel, coalesce(a.y, m.y) AS y, coalesce(a.x, m.x) AS x, a.y IS NULL AS missing FROM a FULL JOIN {{m}} m ON a.pair = m.pair AND a.channel = m.channel AND a.y = m.y AND a.x = m.x WHERE (a.y IS NULL OR m.y IS NULL) AND coalesce(a.channel, m.channel) <> 'keypoint'),
gr AS (SELECT pair, channel, CASE WHEN y < 17 THEN 0 WHEN y < 34 THEN 1 ELSE 2 END AS "row", CASE WHEN x < 16 THEN 0 WHEN x < 32 THEN 1 ELSE 2 END AS col, count_if(missing) AS mi, count_if(NOT missing) AS ex FROM x GROUP BY ALL),
dom AS (SELECT gr.*, ['上部', '中部', '下部']["row" + 1] || ['左侧', '', '右侧'][col + 1] AS region, CASE WHEN mi >= ex THEN 'missing_reference_structure' ELSE 'extra_user_structure' END AS kind, CAST(greatest(mi, ex) AS BIGINT) AS pixels FROM gr JOIN (VALUES {_PLACES}) p(name, place) ON name = channel
QUALIFY row_number() OVER (PARTITION BY pair ORDER BY greatest(mi, ex) DESC, place, "row", col) = 1)"""


@query(f'WITH {_PX}, {_DIFF.format(m="b")} SELECT pair, channel, "row", col, region, kind, pixels FROM dom')
def dominant_difference(spark: SparkSession, base: str) -> DataFrame:
    a, b = _two(spark, base)
    return M.dominant_difference(a, b, ["pair"], "channel", S.DIRECTIONS, HEIGHT, WIDTH)


def _evidence(spark: SparkSession, base: str) -> DataFrame:
    """Evidence of the scored pairs with the dominant difference against the aligned reference."""
    s = _scored(spark, base)
    aligned = S.cube_pixels(s.select("pair", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), "aligned"), ["pair"], "aligned")
    local = M.dominant_difference(_two(spark, base)[0], aligned, ["pair"], "channel", S.DIRECTIONS, HEIGHT, WIDTH).select(
        "pair", F.col("region").alias("local_region"), F.col("kind").alias("local_kind")
    )
    return s.join(local, "pair", "left").withColumn("worst_dice", _worst(s)["dice"])


def _finding_sql() -> str:
    values = {
        "layout_center_offset": "sqrt(lay.dx / g * (lay.dx / g) + lay.dy / g * (lay.dy / g))",
        "layout_ink_scale": "abs(ln(greatest(ratio, 1e-6)))", "keypoint_relation": "1 - f1",
        "local_direction_structure": "1 - w.v"
    }
    vertical = "CASE WHEN lay.dy > 0 THEN '下' ELSE '上' END"
    side = f"CASE WHEN abs(lay.dx) >= abs(lay.dy) * 0.45::DOUBLE THEN CASE WHEN lay.dx > 0 THEN '右' ELSE '左' END || {vertical} ELSE {vertical} END"
    texts = {
        "layout_center_offset": f"format('{R.CENTER_TEXT.replace('%s', '{}')}', {side})", "layout_ink_scale": f"format('{R.SCALE_TEXT.replace('%s', '{}')}', CASE WHEN ratio > 1 THEN '偏小' ELSE '偏大' END)",
        "keypoint_relation": f"'{R.KEYPOINT_TEXT}'", "local_direction_structure": f"format('{R.LOCAL_TEXT.replace('%s', '{}')}', coalesce(dom.region, '局部'), CASE WHEN dom.kind = 'missing_reference_structure' THEN '缺少' ELSE '多出' END)",
    }
    parts = []
    for n, v in values.items():
        (hi, mid, lo), factor, title, action = R.LIMITS[n]
        parts.append(f"SELECT e.pair, '{n}' AS finding_id, CASE WHEN {v} >= {hi}::DOUBLE THEN 'high' WHEN {v} >= {mid}::DOUBLE THEN 'medium' WHEN {v} >= {lo}::DOUBLE THEN 'low' END AS severity, round(({v}) * {factor}::DOUBLE, 9) AS priority, '{title}' AS title, {texts[n]} AS message, '{action}' AS action FROM e JOIN lay USING (pair) JOIN w USING (pair) LEFT JOIN dom USING (pair)")
    return " UNION ALL ".join(parts)


@query(
    _STYLE + f", {_DIFF.format(m='m1')}, fi AS ({_finding_sql()}) SELECT pair, CAST(row_number() OVER z AS INT) AS rank, finding_id, severity, priority, title, message, action FROM fi WHERE severity IS NOT NULL "
    "WINDOW z AS (PARTITION BY pair ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, priority DESC, finding_id) QUALIFY row_number() OVER z <= 3"
)
def findings_topk(spark: SparkSession, base: str) -> DataFrame:
    return R.findings(_evidence(spark, base), "pair")


@query()
def feedback_documents(spark: SparkSession, base: str) -> DataFrame:
    """The whole contract of each pair as JSON; the text of the documents has no SQL twin."""
    e = _evidence(spark, base).withColumns({
        "course_id": F.lit("grid"), "course_name": F.lit("grid"), "target_char": F.lit("永"), "score": F.round("score", 6)
    })
    return R.feedback_documents(e, R.findings(e, "pair"), "pair")


_RATE = "CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / ({b})::DOUBLE END"
_F1 = _RATE.format(a="2 * tp", b="2 * tp + fp + fn")


def _tally(left: str, right: str, name: str) -> str:
    return f"{name} AS (SELECT coalesce(l.channel, r.channel) AS channel, count_if(l.y IS NOT NULL AND r.y IS NOT NULL) AS tp, count_if(r.y IS NULL) AS fp, count_if(l.y IS NULL) AS fn FROM {left} l FULL JOIN {right} r ON l.pair = r.pair AND l.channel = r.channel AND l.y = r.y AND l.x = r.x GROUP BY 1)"


def _edge_sql(t: str) -> str:
    return f"SELECT pair, channel, y + dy AS y, x + dx AS x FROM {t}, range(-1, 2) v(dy), range(-1, 2) h(dx) WHERE y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 47 GROUP BY ALL HAVING count(*) < 9"


def _radius_sql(r: int) -> str:
    near = lambda t: f"SELECT pair, y + dy, x + dx FROM {t}, range(-{r}, {r} + 1) v(dy), range(-{r}, {r} + 1) h(dx) WHERE channel = 'keypoint'"
    k = f"(SELECT (SELECT count_if((pair, y, x) IN ({near('b')})) FROM a WHERE channel = 'keypoint') AS ph, (SELECT count(*) FROM a WHERE channel = 'keypoint') AS p, (SELECT count_if((pair, y, x) IN ({near('a')})) FROM b WHERE channel = 'keypoint') AS th, (SELECT count(*) FROM b WHERE channel = 'keypoint') AS t)"
    q = f"(SELECT {_RATE.format(a='ph', b='p')} AS pr, {_RATE.format(a='th', b='t')} AS re FROM {k})"
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, 'keypoint' AS channel, {r} AS radius, {v} AS value FROM {q}" for m,
        v in (
            ("keypoint_precision", "pr"), ("keypoint_recall", "re"),
            ("keypoint_tolerant_f1", "CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END")
        )
    )


_EVAL = f"""WITH {_PX}, ea AS ({_edge_sql('a')}), eb AS ({_edge_sql('b')}), {_tally('a', 'b', 't1')}, {_tally('ea', 'eb', 't2')},
c1 AS (SELECT name AS channel, place, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {_PLACES}) p(name, place) LEFT JOIN t1 ON channel = name),
c2 AS (SELECT name AS channel, {_F1} AS b FROM (SELECT name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {_PLACES}) p(name, place) LEFT JOIN t2 ON channel = name)),
c AS (SELECT *, {_F1} AS dice, {_RATE.format(a='tp', b='tp + fp + fn')} AS iou, {_RATE.format(a='tp', b='tp + fp')} AS "precision", {_RATE.format(a='tp', b='tp + fn')} AS recall FROM c1 JOIN c2 USING (channel)),
r AS ({' UNION ALL '.join(f'SELECT {chr(39)}{m}{chr(39)} AS metric, channel, NULL::INT AS radius, {v} AS value FROM c' for m, v in (('dice', 'dice'), ('iou', 'iou'), ('precision', chr(34) + 'precision' + chr(34)), ('recall', 'recall'), ('boundary_f1', 'b')))}
UNION ALL {' UNION ALL '.join(f'SELECT {chr(39)}{m}{chr(39)}, NULL, NULL, avg({v}) FROM c WHERE place < 5' for m, v in (('macro_dice', 'dice'), ('macro_iou', 'iou'), ('macro_boundary_f1', 'b')))}
UNION ALL SELECT 'keypoint_f1', NULL, NULL, dice FROM c WHERE place = 5 UNION ALL {' UNION ALL '.join(_radius_sql(r) for r in (0, 1, 3, 5))})
SELECT metric, coalesce(channel, '') AS channel, coalesce(radius, -1) AS radius, round(value, 9) AS value FROM r"""


@query(_EVAL)
def evaluation(spark: SparkSession, base: str) -> DataFrame:
    """All figures of the meter over the five masks: channels, macro of five, boundaries, tolerant keypoints."""
    a, b = _two(spark, base)
    return _round(E.evaluate(a, b, ["pair"], HEIGHT, WIDTH, [0, 1, 3, 5]), "value").na.fill({"channel": "", "radius": -1})


@query(f"WITH {_PX}, u AS (SELECT pair, y, x, count(*) FILTER (channel <> 'keypoint') AS five, count_if(channel = 'keypoint') AS k FROM a GROUP BY ALL), s AS (SELECT pair, count_if(five > 0) AS n, count_if(five >= 2) AS two, sum(k) AS key FROM u GROUP BY pair), o AS (SELECT pair, count(DISTINCT channel) FILTER (channel <> 'keypoint') AS used FROM a GROUP BY pair), "
    "w AS (SELECT r.pair, s.*, used FROM range(6) r(pair) LEFT JOIN s ON s.pair = r.pair LEFT JOIN o ON o.pair = r.pair) SELECT CAST(pair AS INT) AS pair, round(coalesce(100.0::DOUBLE * two / greatest(n, 1) + 4.0::DOUBLE * used + least(key / greatest(n, 1)::DOUBLE * 200, 8.0), 0.0), 6) AS hard_score FROM w")  # fmt: skip
def hard_scores(spark: SparkSession, base: str) -> DataFrame:
    """Hard-case scores of six masks, one of which has no pixel."""
    rows = spark.range(6).select(F.col("id").cast("int").alias("pair"))
    return _round(E.hard_scores(rows, _two(spark, base)[0], ["pair"]).drop("reason"), "hard_score", places=6)


@query(f"WITH {_PX}, n AS (SELECT channel, count(*) AS n FROM a GROUP BY channel) SELECT name AS channel, coalesce(n, 0) AS positives, round(coalesce(n, 0) / (5.0::DOUBLE * 51 * 48), 9) AS ratio, round(least(greatest((5 * 51 * 48 - coalesce(n, 0)) / greatest(coalesce(n, 0), 1)::DOUBLE, 1.0), 100.0), 9) AS weight FROM (VALUES {_PLACES}) p(name, place) LEFT JOIN n ON channel = name WHERE place < 5")
def direction_weights(spark: SparkSession, base: str) -> DataFrame:
    sizes = spark.range(5).select(F.col("id").cast("int").alias("pair"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))
    return _round(E.direction_weights(sizes, _two(spark, base)[0], ["pair"]), "ratio", "weight")


LIMITS = E.thresholds({"keypoint": 0.45}, {"best_thresholds": {"vec1": 0.1, "vec2": 0.7}})


@query("SELECT vec_id, i FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) JOIN (VALUES " + ", ".join(
    f"({i}, {LIMITS[c]!r}::FLOAT)" for i, c in enumerate(S.CHANNELS)
) + ") t(c, least_p) ON c = i % 6 WHERE v >= least_p")
def threshold_pixels(spark: SparkSession, base: str) -> DataFrame:
    """Thresholds of the channels, defaults overlaid by configured and calibrated ones, compared in 32-bit floats."""
    names = F.array(*map(F.lit, S.CHANNELS))
    e = table(spark, base, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "p")
    ).withColumn("channel", F.get(names, F.col("i") % 6))
    return E.above_threshold(e, LIMITS).select("vec_id", "i")


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(v) * 1000) AS INT) % 256) AS px FROM embeddings) SELECT vec_id, k, "
    + ", ".join(
        f"round((px[3 * k + {i + 1}] / 255.0::DOUBLE - {N.MEAN[i]}::DOUBLE) / {N.DEVIATION[i]}::DOUBLE, 9) AS {c}" for i,
        c in enumerate("rgb")
    )
    + " FROM (SELECT vec_id, px, unnest(range(len(px) // 3)) AS k FROM e)"
)
def normalize_rgb(spark: SparkSession, base: str) -> DataFrame:
    """Three colour planes from bytes in row order, over 255, by mean and deviation."""
    e = table(spark, base, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v) * 1000).cast("int") % 256).alias("px"))
    planes = e.select(
        "vec_id", F.arrays_zip(*[c.alias(n) for c, n in zip(N.normalize_rgb(F.col("px")), "rgb")]).alias("z")
    ).select("vec_id", F.posexplode("z").alias("k", "c"))
    return planes.select("vec_id", F.col("k").cast("bigint").alias("k"), *[F.round(f"c.{n}", 9).alias(n) for n in "rgb"])


_SPLITS = "s AS (SELECT sample_id, max(lower(trim(split))) AS split FROM hardset_review WHERE sample_id IS NOT NULL AND trim(split) <> '' GROUP BY sample_id)"


@query(f"WITH {_SPLITS} SELECT manifest_row_id, m.sample_id, s.split FROM manifest m JOIN s ON s.sample_id = m.sample_id WHERE split IN ('val', 'test') AND lower(trim(has_all_masks)) IN ('1', 'true', 'yes', 'y') AND coalesce(errors, '') = ''")
def eligible_samples(spark: SparkSession, base: str) -> DataFrame:
    splits = table(spark, base, "hardset_review").where("sample_id IS NOT NULL AND trim(split) <> ''").select(
        "sample_id", F.lower(F.trim("split")).alias("split")
    )
    return E.eligible(table(spark, base, "manifest"), splits).select("manifest_row_id", "sample_id", "split")


def _packs(spark: SparkSession, base: str) -> DataFrame:
    """A course for each registered style."""
    s = F.col("style_id")
    fixed = {
        "manifest": F.lit("reference_manifest_template"), "cache_index": F.concat(s, F.lit("/index.json")),
        "source_dataset": F.col("reference_work_id"), "source_license": F.lit("none"), "scoring_label": F.lit("参考结构匹配度")
    }
    r = table(spark, base, "style_registry").select(
        F.concat(s, F.lit("_course")).alias("course_id"), "display_name", "style_id", "status", "enabled", "reference_work_id"
    )
    return r.withColumns(fixed).select(*K.FIELDS)


_REFS = "r AS (SELECT s.style_id || '_course' AS course_id, t.* FROM reference_manifest_template t JOIN style_registry s ON s.style_id = t.style_id WHERE lower(review_status) = 'approved')"
_ONE = "one AS (SELECT course_id, target_char AS c, count(*) AS n, min(reference_id) AS id FROM r WHERE target_char IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_REFS}, {_ONE} SELECT s.style_id || '_course' AS course_id, s.enabled, CAST(coalesce(sum(n), 0) AS BIGINT) AS supported_character_count, count(c) AS listed, coalesce(string_agg(c || ':' || coalesce(id, ''), ',' ORDER BY c), '') AS characters FROM style_registry s LEFT JOIN one ON one.course_id = s.style_id || '_course' GROUP BY s.style_id, s.enabled")
def catalog(spark: SparkSession, base: str) -> DataFrame:
    """Courses with their characters; the nested list is rendered as text."""
    c = K.catalog(_packs(spark, base), table(spark, base, "reference_manifest_template"))
    listed = F.array_join(F.transform("characters", lambda x: F.concat(x["target_char"], F.lit(":"), F.coalesce(x["reference_id"], F.lit("")))), ",")
    return c.select(
        "course_id", "enabled", "supported_character_count", F.size("characters").cast("bigint").alias("listed"),
        listed.alias("characters")
    )


@query(
    f"""WITH {_REFS}, e AS (SELECT course_id, coalesce(target_char, '') AS c, count(*) AS n, count_if(length(coalesce(target_char, '')) <> 1 OR coalesce(reference_id, '') = '') AS bad FROM r GROUP BY ALL),
k AS (SELECT s.style_id || '_course' AS course_id, sum(bad) AS bad, sum(CASE WHEN length(c) = 1 THEN n - 1 ELSE 0 END) AS more FROM style_registry s LEFT JOIN e ON e.course_id = s.style_id || '_course' GROUP BY s.style_id)
SELECT course_id, 'no approved references' AS message, CAST(0 AS BIGINT) AS rows FROM k WHERE bad IS NULL UNION ALL SELECT course_id, 'invalid manifest reference', CAST(bad AS BIGINT) FROM k WHERE bad > 0 UNION ALL SELECT course_id, 'multiple approved references', CAST(more AS BIGINT) FROM k WHERE more > 0"""
)
def course_violations(spark: SparkSession, base: str) -> DataFrame:
    return K.course_violations(_packs(spark, base), table(spark, base, "reference_manifest_template"))


@query(
    f"""WITH {_REFS}, one AS (SELECT course_id, target_char AS c, count(*) AS n, min(reference_id) AS id FROM r GROUP BY ALL), w AS (SELECT DISTINCT style_id || '_course' AS course_id, target_char FROM reference_cache WHERE style_id IS NOT NULL),
j AS (SELECT w.*, s.style_id AS known, coalesce(enabled, false) AS enabled, n, id FROM w LEFT JOIN style_registry s ON s.style_id || '_course' = w.course_id LEFT JOIN one ON one.course_id = w.course_id AND one.c = w.target_char),
k AS (SELECT *, CASE WHEN known IS NULL THEN 'unknown_course' WHEN NOT enabled THEN 'course_disabled' WHEN length(coalesce(target_char, '')) <> 1 THEN 'not_one_character' WHEN n IS NULL THEN 'unsupported_character' WHEN n > 1 THEN 'ambiguous_reference' ELSE 'found' END AS status FROM j)
SELECT course_id, target_char, status, CASE WHEN status = 'found' THEN id END AS reference_id FROM k"""
)
def course_lookup(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "reference_cache").where("style_id IS NOT NULL").select(
        F.concat("style_id", F.lit("_course")).alias("course_id"), "target_char"
    ).distinct()
    return K.find_course(wanted, _packs(spark, base), table(spark, base, "reference_manifest_template"))


@query('SELECT s.style_id, count(t.row_id) AS "references" FROM style_registry s LEFT JOIN reference_manifest_template t ON t.style_id = s.style_id GROUP BY s.style_id')
def style_counts(spark: SparkSession, base: str) -> DataFrame:
    return R.style_counts(table(spark, base, "style_registry"), table(spark, base, "reference_manifest_template"))


@query("SELECT row_id, reference_id FROM reference_manifest_template WHERE lower(review_status) = 'approved' ORDER BY row_id LIMIT 100")
def approved_prefix(spark: SparkSession, base: str) -> DataFrame:
    return R.approved_prefix(table(spark, base, "reference_manifest_template"), "row_id", 100).select("row_id", "reference_id")
