"""Queries of the corpus, metric, mask and rule operators, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators import bitmap as B
from maskframe.operators import corpus as C
from maskframe.operators import masks as M
from maskframe.operators import metrics as T
from maskframe.operators import rules as R
from maskframe.sources.tables import table

CHANNELS = ["vec1", "vec2", "vec3", "vec4", "vec5", "keypoint"]
FLAGS = ["difficulty_crossing", "difficulty_adhesion", "difficulty_endpoint", "difficulty_line_width", "difficulty_background", "difficulty_style"]
HEIGHT, WIDTH = 51, 48
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


_WS = r"[\s\x{3000}\x{A0}]+"
_TRIM = lambda c: f"nullif(regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g'), '')"
_KEYED = f"""WITH u AS (
  SELECT *, coalesce({_TRIM('writer_id')}, {_TRIM('source_id')}, {_TRIM("CAST(sample_index AS VARCHAR)")}, {_TRIM('split_group_key')}, {_TRIM('sample_id')}, '') AS group_key
  FROM manifest WHERE lower(trim(has_all_masks)) IN ('1', 'true', 'yes', 'y') AND coalesce(errors, '') = ''
), g AS (
  SELECT group_key, row_number() OVER (ORDER BY coalesce(TRY_CAST(group_key AS BIGINT), CAST('0x' || substr(sha1(group_key), 1, 8) AS BIGINT)), group_key) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT group_key FROM u)
), s AS (
  SELECT group_key, CASE WHEN rn <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM g
)
"""


def _split(spark: SparkSession, base: str) -> DataFrame:
    u = C.usable(table(spark, base, "manifest")).withColumn(
        "group_key", C.group_key("writer_id", "source_id", "sample_index", "split_group_key", "sample_id")
    )
    return C.group_split(u, "group_key")


@query(_KEYED + "SELECT manifest_row_id, sample_id, u.group_key, split FROM u JOIN s USING (group_key)")
def group_split(spark: SparkSession, base: str) -> DataFrame:
    return _split(spark, base).select("manifest_row_id", "sample_id", "group_key", "split")


@query(_KEYED + "SELECT split, count(*) AS rows, count(DISTINCT u.group_key) AS groups FROM u JOIN s USING (group_key) GROUP BY split")
def split_counts(spark: SparkSession, base: str) -> DataFrame:
    return C.split_counts(_split(spark, base), "group_key")


@query("""SELECT c_name, CASE WHEN rn <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN rn <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT c_name, row_number() OVER (ORDER BY CAST('0x' || substr(sha1(c_name), 1, 8) AS BIGINT), c_name) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT c_name FROM customer))""")
def group_split_hashed(spark: SparkSession, base: str) -> DataFrame:
    return C.group_split(table(spark, base, "customer").select("c_name"), "c_name").select("c_name", "split").distinct()


@query("""SELECT count(DISTINCT char_id) AS characters, count(*) AS samples, count_if(has_all_masks = 'true' AND coalesce(errors, '') = '') AS complete,
count_if(coalesce(errors, '') <> '') AS with_errors, count_if(coalesce(image_path, '') = '') AS without_image FROM manifest""")
def audit_report(spark: SparkSession, base: str) -> DataFrame:
    return C.audit_report(table(spark, base, "manifest"))


@query("""SELECT error, count(*) AS samples FROM (SELECT unnest(list_distinct(list_filter(string_split(errors, '|'), lambda x: x <> ''))) AS error FROM manifest WHERE errors IS NOT NULL) GROUP BY error""")
def audit_errors(spark: SparkSession, base: str) -> DataFrame:
    return C.audit_errors(table(spark, base, "manifest"))


@query(
    "SELECT manifest_row_id, array_to_string(list_filter(["
    + "CASE WHEN coalesce(image_path, '') = '' THEN 'missing_image' END, CASE WHEN coalesce(stacked_mask_path, '') = '' THEN 'stacked_mask:missing' END, "
    + ", ".join(f"CASE WHEN coalesce({c}_path, '') = '' THEN '{c}:missing' END" for c in CHANNELS)
    + f", CASE WHEN len(list_distinct(list_filter([{', '.join(c + '_shape' for c in CHANNELS)}], lambda s: coalesce(s, '') <> ''))) > 1 THEN 'mask_shape_mismatch' END], lambda e: e IS NOT NULL), '|') AS found_errors FROM manifest"
)
def audit_rows(spark: SparkSession, base: str) -> DataFrame:
    return C.mask_errors(table(spark, base, "manifest"), CHANNELS)


@query("""SELECT sample_id, manifest_row_id, char_id FROM manifest WHERE lower(trim(has_all_masks)) IN ('1', 'true', 'yes', 'y') AND coalesce(errors, '') = '' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY manifest_row_id DESC) = 1 AND sample_id IN (SELECT sample_id FROM hardset_review WHERE sample_id IS NOT NULL)""")
def usable_semijoin(spark: SparkSession, base: str) -> DataFrame:
    m = C.usable(table(spark, base, "manifest")).select("sample_id", "manifest_row_id", "char_id")
    return C.present_in_both(
        m, table(spark, base, "hardset_review").where("sample_id IS NOT NULL"), "sample_id", "manifest_row_id"
    ).select("sample_id", "manifest_row_id", "char_id")


def _long_flags(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "hardset_review").select("keep", *FLAGS)
    return r.select(
        F.coalesce(F.lower(F.trim("keep")) == "yes", F.lit(False)).alias("target"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("channel"), F.coalesce(F.trim(f) == "1", F.lit(False)).alias("pred")) for f in FLAGS])).alias("x")
    ).select("target", "x.*")


_LONG = "WITH l AS (" + " UNION ALL ".join(f"SELECT '{f}' AS channel, coalesce(trim({f}) = '1', false) AS pred, coalesce(lower(trim(keep)) = 'yes', false) AS target FROM hardset_review" for f in FLAGS) + "), c AS (SELECT channel, count_if(pred AND target) AS tp, count_if(pred AND NOT target) AS fp, count_if(NOT pred AND target) AS fn, count_if(NOT pred AND NOT target) AS tn FROM l GROUP BY channel)"
_RATIO = "round(CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / ({b})::DOUBLE END, 9)"


@query(_LONG + " SELECT * FROM c")
def confusion_by_channel(spark: SparkSession, base: str) -> DataFrame:
    return T.confusion(_long_flags(spark, base), ["channel"], F.col("pred"), F.col("target"))


@query(_LONG + f" SELECT *, {_RATIO.format(a='2 * tp', b='2 * tp + fp + fn')} AS dice, {_RATIO.format(a='tp', b='tp + fp + fn')} AS iou, {_RATIO.format(a='tp', b='tp + fp')} AS precision, {_RATIO.format(a='tp', b='tp + fn')} AS recall FROM c")
def segmentation_metrics(spark: SparkSession, base: str) -> DataFrame:
    return T.scores(confusion_by_channel(spark, base))


@query("""WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events), e AS (SELECT event_type AS target, (value - lo) / (hi - lo) AS p FROM events, m),
c AS (SELECT DISTINCT event_type AS channel FROM events), g AS (SELECT i, 0.10::DOUBLE + (i - 1) * (0.90::DOUBLE - 0.10::DOUBLE) / 16 AS t FROM range(1, 18) r(i)),
h AS (SELECT c.channel, i, t, count_if(p >= t AND target = channel) AS tp, count_if(p >= t) AS hit, count_if(target = channel) AS pos FROM c, g, e GROUP BY ALL)
SELECT channel, round(t, 6) AS threshold, round(2 * tp / greatest(hit + pos, 1)::DOUBLE, 9) AS dice FROM h QUALIFY row_number() OVER (PARTITION BY channel ORDER BY 2 * tp / greatest(hit + pos, 1)::DOUBLE DESC, i) = 1""")
def threshold_calibration(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events").select("event_type", "value")
    lo_hi = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    kinds = e.select(F.col("event_type").alias("channel")).distinct()
    # Rows are brought down to (type, bucket) before they meet the channels.
    p = e.crossJoin(F.broadcast(lo_hi)).select("event_type", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("p"))
    grid = [0.10 + i * (0.90 - 0.10) / 16 for i in range(17)]
    level = F.lit(0.0)
    for t in grid:
        level = F.when(F.col("p") >= F.lit(t), t).otherwise(level)
    small = p.groupBy("event_type", level.alias("p")).agg(F.count("*").alias("n"))
    rows = small.crossJoin(F.broadcast(kinds)).withColumn("target", F.col("event_type") == F.col("channel"))  # types x levels x types
    return T.calibrate_counts(rows, "channel", "p", "target", "n")


@query("""SELECT l_returnflag, count(*) AS positives, round(least(greatest(((SELECT count(*) FROM lineitem) - count(*)) / greatest(count(*), 1)::DOUBLE, 1.0), 50.0), 9) AS weight FROM lineitem GROUP BY l_returnflag""")
def class_balance(spark: SparkSession, base: str) -> DataFrame:
    return T.class_balance(table(spark, base, "lineitem"), "l_returnflag")


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_totalprice FROM r WHERE i IN (SELECT CASE WHEN k = 99 THEN (SELECT max(n) FROM r) - 1 ELSE CAST(floor(k * (((SELECT max(n) FROM r) - 1) / 99.0::DOUBLE)) AS BIGINT) END FROM range(100) t(k))""")
def systematic_sample(spark: SparkSession, base: str) -> DataFrame:
    return C.systematic_sample(table(spark, base, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


def _parts(spark: SparkSession, base: str, width: int = WIDTH) -> DataFrame:
    return table(spark, base, "part").select(
        F.col("p_size").alias("y"), ((F.col("p_partkey") * 7) % width).cast("int").alias("x"),
        F.when(F.substring("p_brand", -1, 1) == "0", "K").otherwise(F.substring("p_type", 1, 1)).alias("channel"),
        (F.col("p_partkey") % 2).cast("int").alias("side")
    )


def _sides(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    p = _parts(spark, base)
    return tuple(p.where(F.col("side") == s).select("channel", "y", "x").distinct() for s in (0, 1))


_PART = "p AS (SELECT DISTINCT p_size AS y, CAST((p_partkey * 7) % 48 AS INT) AS x, CASE WHEN right(p_brand, 1) = '0' THEN 'K' ELSE left(p_type, 1) END AS channel, CAST(p_partkey % 2 AS INT) AS side FROM part), a AS (SELECT DISTINCT channel, y, x FROM p WHERE side = 0), b AS (SELECT DISTINCT channel, y, x FROM p WHERE side = 1)"
_NEAR = "SELECT DISTINCT channel, y + dy AS y, x + dx AS x FROM {t}, range(-{r}, {r} + 1) v(dy), range(-{r}, {r} + 1) h(dx) WHERE y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 47"


@query("""WITH ink AS (SELECT DISTINCT p_size AS y, CAST((p_partkey * 7) % 16 AS INT) AS x FROM part),
n AS (SELECT y + dy AS y, x + dx AS x FROM ink, range(-1, 2) v(dy), range(-1, 2) h(dx))
SELECT 0 AS mask, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM n WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 15 GROUP BY y, x HAVING count(*) < 9""")
def mask_boundary(spark: SparkSession, base: str) -> DataFrame:
    ink = _parts(spark, base, 16).select(F.lit(0).alias("mask"), "y", "x").distinct()
    return M.boundary(ink, ["mask"], 64, 16)


@query(
    """WITH p AS (SELECT DISTINCT CAST(p_partkey % 2 AS INT) AS side, p_size AS y, CAST((p_partkey * 7) % 48 AS INT) AS x,
  CASE WHEN right(p_brand, 1) = '0' THEN 'K' ELSE left(p_type, 1) END AS channel FROM part)
SELECT DISTINCT side, channel, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM p, range(-1, 2) v(dy), range(-1, 2) h(dx)
WHERE y + dy BETWEEN 0 AND 50 AND x + dx BETWEEN 0 AND 47"""
)
def mask_dilate(spark: SparkSession, base: str) -> DataFrame:
    return M.dilate(_parts(spark, base), ["side", "channel"], 1, HEIGHT, WIDTH)


def _tolerant_sql(r: int) -> str:
    near = lambda t: _NEAR.format(t=t, r=r)
    return f"""SELECT {r} AS radius, channel, (SELECT count(*) FROM a WHERE a.channel = c.channel) AS pred, (SELECT count(*) FROM b WHERE b.channel = c.channel) AS target,
(SELECT count(*) FROM a WHERE a.channel = c.channel AND (channel, y, x) IN ({near('b')})) AS pred_hit, (SELECT count(*) FROM b WHERE b.channel = c.channel AND (channel, y, x) IN ({near('a')})) AS target_hit
FROM (SELECT DISTINCT channel FROM p) c"""


@query(f"""WITH {_PART}, t AS ({' UNION ALL '.join(_tolerant_sql(r) for r in (0, 1, 3))}), q AS (SELECT *, CASE WHEN pred = 0 THEN 0.0 ELSE pred_hit / pred::DOUBLE END AS pr, CASE WHEN target = 0 THEN 0.0 ELSE target_hit / target::DOUBLE END AS re FROM t)
SELECT radius, channel, pred, target, pred_hit, target_hit, round(pr, 9) AS precision, round(re, 9) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 9) AS f1 FROM q""")
def tolerant_match(spark: SparkSession, base: str) -> DataFrame:
    a, b = _sides(spark, base)
    out = None
    for r in (0, 1, 3):
        t = M.tolerant_scores(M.tolerant_counts(a, b, ["channel"], r, HEIGHT, WIDTH)).select(F.lit(r).alias("radius"), "*")
        out = t if out is None else out.unionByName(t)
    return out


@query(f"""WITH {_PART}, s AS (SELECT channel, y + 3 AS y, x - 2 AS x FROM b WHERE y + 3 <= 50 AND x - 2 >= 0),
u AS (SELECT coalesce(a.channel, s.channel) AS channel, count_if(a.y IS NOT NULL AND s.y IS NOT NULL) AS shared, count_if(s.y IS NULL) AS only_a, count_if(a.y IS NULL) AS only_b FROM a FULL JOIN s ON a.channel = s.channel AND a.y = s.y AND a.x = s.x GROUP BY 1)
SELECT channel, shared, only_a, only_b, round(2 * shared / (2 * shared + only_a + only_b)::DOUBLE, 9) AS dice, round(shared / (shared + only_a + only_b)::DOUBLE, 9) AS iou FROM u""")
def mask_translate_iou(spark: SparkSession, base: str) -> DataFrame:
    a, b = _sides(spark, base)
    o = M.pair_scores(M.overlap(a, M.translate(b, 3, -2, HEIGHT, WIDTH), ["channel"]))
    return o.withColumn("dice", F.round("dice", 9)).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {_PART}, ca AS (SELECT channel, avg(y) AS cy, avg(x) AS cx, count(*) AS ink FROM a GROUP BY channel), cb AS (SELECT channel, avg(y) AS cy, avg(x) AS cx FROM b GROUP BY channel),
k AS (SELECT ca.channel, ink, round_even(ca.cy - cb.cy, 0) + oy AS dy, round_even(ca.cx - cb.cx, 0) + ox AS dx, (oy + 1) * 3 + ox + 1 AS idx FROM ca JOIN cb USING (channel), range(-1, 2) v(oy), range(-1, 2) h(ox)),
m AS (SELECT k.*, b.y + dy AS y, b.x + dx AS x FROM b JOIN k USING (channel) WHERE b.y + dy BETWEEN 0 AND 50 AND b.x + dx BETWEEN 0 AND 47),
s AS (SELECT m.channel, m.ink, dy, dx, idx, count(a.y) AS shared, count(*) AS moved FROM m LEFT JOIN a ON a.channel = m.channel AND a.y = m.y AND a.x = m.x GROUP BY ALL)
SELECT channel, CAST(dy AS INT) AS dy, CAST(dx AS INT) AS dx, round(shared / (ink + moved - shared)::DOUBLE, 9) AS iou FROM s QUALIFY row_number() OVER (PARTITION BY channel ORDER BY shared / (ink + moved - shared)::DOUBLE DESC, idx) = 1""")
def align_translation(spark: SparkSession, base: str) -> DataFrame:
    a, b = _sides(spark, base)
    return M.align_by_centroid(a, b, ["channel"], HEIGHT, WIDTH)


_COMPONENTS = f"""WITH RECURSIVE {_PART}, v AS (SELECT DISTINCT channel, y, x, y * 48 + x AS id FROM p),
e AS (SELECT s.id AS x, s.channel, t.id AS y FROM v s JOIN v t ON s.channel = t.channel AND abs(s.y - t.y) <= 1 AND abs(s.x - t.x) <= 1),
lab(channel, x, c) USING KEY (channel, x) AS (
  SELECT channel, x, min(y) FROM e GROUP BY channel, x
  UNION
  SELECT e.channel, e.x, min(l.c) FROM e JOIN lab l ON l.channel = e.channel AND l.x = e.y JOIN recurring.lab r ON r.channel = e.channel AND r.x = e.x GROUP BY e.channel, e.x HAVING min(l.c) < min(r.c)
), k AS (SELECT v.channel, count(*) AS area, avg(v.x) AS cx, avg(v.y) AS cy, min(v.x) AS "left", min(v.y) AS top, max(v.x) + 1 AS "right", max(v.y) + 1 AS bottom, arg_min(v.x, v.id) AS first_x FROM v JOIN lab ON lab.channel = v.channel AND lab.x = v.id GROUP BY v.channel, lab.c)
"""


@query(_COMPONENTS + """SELECT channel || '_' || lpad(row_number() OVER (PARTITION BY channel ORDER BY top, "left", first_x)::VARCHAR, 3, '0') AS region_id, channel, area, round(cx, 6) AS cx, round(cy, 6) AS cy, "left", top, "right", bottom FROM k WHERE area >= 8""")
def components_regions(spark: SparkSession, base: str) -> DataFrame:
    c = B.components(_parts(spark, base), ["channel"], HEIGHT, WIDTH, 8)
    return B.number_regions(c, "channel").select(
        "region_id", "channel", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "left", "top", "right",
        "bottom"
    )


@query(_COMPONENTS + "SELECT CAST(row_number() OVER (ORDER BY cy, cx) AS INT) AS place, area, round(cx, 6) AS x, round(cy, 6) AS y, 1.0 AS confidence FROM k WHERE channel = 'K' AND area >= 3")
def components_keypoints(spark: SparkSession, base: str) -> DataFrame:
    c = B.keypoints(_parts(spark, base).where("channel = 'K'"), ["channel"], HEIGHT, WIDTH)
    return c.select("place", "area", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "confidence")


_DEFECTS = " + ".join(f"CASE WHEN trim({f}) = '1' THEN 1 ELSE 0 END" for f in FLAGS)


@query(f"""WITH r AS (SELECT review_id, char_id, lower(trim(split)) AS sp, round(100.0 * ({_DEFECTS}) / 6.0 + CASE WHEN priority = 'high' THEN 4 ELSE 0 END, 6) AS score FROM hardset_review WHERE char_id IS NOT NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY char_id ORDER BY CASE sp WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, score DESC, review_id) AS rn FROM r), h AS (SELECT char_id, score AS head FROM q WHERE rn = 1)
SELECT review_id, char_id, sp, score, rn FROM q JOIN h USING (char_id) ORDER BY rn, head DESC, char_id LIMIT 500""")
def hard_candidates(spark: SparkSession, base: str) -> DataFrame:
    defects = sum((F.when(F.trim(f) == "1", 1).otherwise(0) for f in FLAGS), F.lit(0))
    score = F.round(F.lit(100.0) * defects / F.lit(6.0) + F.when(F.col("priority") == "high", 4).otherwise(0), 6)
    r = table(spark, base, "hardset_review").where("char_id IS NOT NULL").select(
        "review_id", "char_id", F.lower(F.trim("split")).alias("sp"), score.alias("score")
    )
    return C.fair_round_robin(r, "char_id", "score", "review_id", "sp", 500)


@query(
    """WITH RECURSIVE m AS (SELECT manifest_row_id, char_id, sample_index, coalesce(char_id, '') AS g, row_number() OVER (PARTITION BY coalesce(char_id, '') ORDER BY coalesce(CAST(sample_index AS VARCHAR), ''), manifest_row_id) AS rn FROM manifest WHERE has_all_masks = 'true' AND coalesce(errors, '') = ''),
n AS (SELECT list({'g': g, 'n': n, 'k': 0::BIGINT} ORDER BY g) AS l FROM (SELECT g, count(*) AS n FROM m GROUP BY g)),
s(place, l, g, rn) AS (SELECT 0, l, NULL::VARCHAR, NULL::BIGINT FROM n UNION ALL
  SELECT place + 1, list_filter(list_transform(l, lambda x, i: CASE WHEN i = place % len(l) + 1 THEN {'g': x.g, 'n': x.n - 1, 'k': x.k + 1} ELSE x END), lambda x: x.n > 0), l[place % len(l) + 1].g, l[place % len(l) + 1].k + 1 FROM s WHERE place < 50 AND len(l) > 0)
SELECT manifest_row_id, char_id, sample_index, place FROM s JOIN m USING (g, rn)"""
)
def round_robin_template(spark: SparkSession, base: str) -> DataFrame:
    m = C.strictly_usable(table(spark, base, "manifest")).select("manifest_row_id", "char_id", "sample_index")
    return C.round_robin_template(m, "char_id", "sample_index", "manifest_row_id", 50)


_REVIEWS = f"""WITH r AS (SELECT review_id, {_TRIM('sample_id')} AS id, coalesce({_TRIM('char_id')}, '') AS c, coalesce({_TRIM('sample_index')}, '') AS i, keep, priority FROM hardset_review WHERE coalesce({', '.join(_TRIM(f) for f in [*FLAGS, 'keep', 'reviewer'])}) IS NOT NULL),
b AS (SELECT sample_id, char_id, sample_index FROM manifest WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY manifest_row_id DESC) = 1),
k AS (SELECT coalesce({_TRIM('char_id')}, '') AS c, coalesce(CAST(sample_index AS VARCHAR), '') AS i, max(sample_id) AS sample_id FROM b GROUP BY 1, 2),
lost AS (SELECT * FROM r WHERE id IS NULL OR id NOT IN (SELECT sample_id FROM b)),
m AS (SELECT b.sample_id, r.* FROM b JOIN r ON r.id = b.sample_id UNION ALL SELECT k.sample_id, l.* FROM k JOIN lost l ON l.c = k.c AND l.i = k.i),
w AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY review_id DESC) = 1)
"""


def _review_sides(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, base, "manifest").where("sample_id IS NOT NULL").select("sample_id", "char_id", "sample_index", "manifest_row_id")
    return R.last_by(m, ["sample_id"], "manifest_row_id").select("sample_id", "char_id", "sample_index"), table(spark, base, "hardset_review")


@query(_REVIEWS + "SELECT b.*, w.review_id, w.keep, w.priority FROM b LEFT JOIN w USING (sample_id)")
def review_merge(spark: SparkSession, base: str) -> DataFrame:
    """Not every reviewed sample is in the manifest: those reviews come out of ``reviews_unmatched``."""
    return C.merge_reviews(*_review_sides(spark, base), ["keep", "priority"], [*FLAGS, "keep", "reviewer"], strict=False)


@query(_REVIEWS + "SELECT review_id FROM lost WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.c = lost.c AND k.i = lost.i)")
def reviews_unmatched(spark: SparkSession, base: str) -> DataFrame:
    return C.unmatched_reviews(*_review_sides(spark, base), [*FLAGS, "keep", "reviewer"]).select("review_id")


@query(f"SELECT review_id, CASE WHEN regexp_full_match({_TRIM('sample_id')}, '[0-9]+/[0-9]+') THEN {_TRIM('sample_id')} WHEN regexp_full_match({_TRIM('char_id')}, '[0-9]+') AND regexp_full_match({_TRIM('sample_index')}, '[0-9]+') THEN {_TRIM('char_id')} || '/' || {_TRIM('sample_index')} END AS canonical_id FROM hardset_review")
def canonical_ids(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "hardset_review").select("review_id", C.canonical_sample_id().alias("canonical_id"))


@query("SELECT manifest_row_id, coalesce(nullif(writer_id, ''), nullif(source_id, ''), CAST(sample_index AS VARCHAR), nullif(sample_id, ''), '') AS group_key FROM manifest")
def audit_keys(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "manifest").select("manifest_row_id", C.audit_group_key().alias("group_key"))


_CELL = lambda c: f"coalesce({_TRIM(f'CAST({c} AS VARCHAR)')}, '')"
_E = lambda c: f"{c} = ''"
_RULES = [
    ("reference_id", "'required'", _E("reference_id")),
    ("reference_id", "'duplicate'", "row_id > first_id"),
    ("style_id", "'not in registry'", "NOT known"),
    ("schema_version", "'must be 1'", "known AND schema_version <> '1'"),
    ("target_char", "'must be one character'", "known AND length(target_char) <> 1"),
    ("image_path", "'required'", f"known AND {_E('image_path')}"),
    (
        "image_path", "'file not found'",
        f"known AND NOT {_E('image_path')} AND image_path NOT IN (SELECT image_path FROM reference_images WHERE image_path IS NOT NULL)"
    ),
    ("source_type", "'required'", f"known AND {_E('source_type')}"),
    ("is_synthetic", "'must be true or false'", "known AND lower(is_synthetic) NOT IN ('true', 'false')"),
    ("review_status", "'must be pending, approved, or rejected'", "known AND lower(review_status) NOT IN ('pending', 'approved', 'rejected')"),
    ("author_id", "'must match registry value: ' || reg_author", "known AND reg_author <> '' AND author_id <> reg_author"),
    ("script_style", "'must match registry value: ' || reg_script", "known AND reg_script <> '' AND script_style <> reg_script"),
    *[(f, "'required for approved reference'", f"known AND lower(review_status) = 'approved' AND {_E(f)}") for f in R.APPROVED_FIELDS],
    ("style_id", "'style is not enabled'", "known AND lower(review_status) = 'approved' AND NOT reg_enabled"),
    ("review_status", "'must be approved'", "known AND lower(review_status) <> 'approved'"),
]
_JUDGED = f"""WITH c AS (SELECT row_id, {', '.join(f'{_CELL(c)} AS {c}' for c in R.MANIFEST_COLUMNS)} FROM reference_manifest_template),
f AS (SELECT reference_id, min(row_id) AS first_id FROM c WHERE reference_id <> '' GROUP BY 1),
m AS (SELECT c.*, first_id, s.style_id IS NOT NULL AS known, coalesce(trim(s.author_id), '') AS reg_author, coalesce(trim(s.script_style), '') AS reg_script, coalesce(s.enabled, false) AS reg_enabled FROM c LEFT JOIN f USING (reference_id) LEFT JOIN style_registry s ON s.style_id = c.style_id),
v AS ({' UNION ALL '.join(f"SELECT row_id, '{f}' AS field, {m} AS message FROM m WHERE {c}" for f, m, c in _RULES)})
"""


def _manifest(spark: SparkSession, base: str) -> dict:
    return {
        "manifest": table(spark, base, "reference_manifest_template"), "registry": table(spark, base, "style_registry"),
        "files": table(spark, base, "reference_images"), "require_approved": True
    }


@query(_JUDGED + "SELECT * FROM v")
def manifest_violations(spark: SparkSession, base: str) -> DataFrame:
    return R.manifest_violations(**_manifest(spark, base))


@query(_JUDGED + "SELECT (SELECT count(*) FROM m) AS num_rows, (SELECT count(*) FROM m WHERE known AND lower(review_status) = 'approved') AS num_approved, '' AS missing_columns, (SELECT count(*) FROM v) AS num_errors, (SELECT count(*) FROM v) = 0 AS valid")
def manifest_report(spark: SparkSession, base: str) -> DataFrame:
    return R.manifest_report(**_manifest(spark, base)).withColumn("missing_columns", F.array_join("missing_columns", ","))


@query(f"SELECT row_id, reference_id FROM reference_manifest_template WHERE {_TRIM('reference_id')} IS NOT NULL QUALIFY row_id > min(row_id) OVER (PARTITION BY {_TRIM('reference_id')})")
def repeated_references(spark: SparkSession, base: str) -> DataFrame:
    return C.repeated(table(spark, base, "reference_manifest_template"), "reference_id", "row_id")


@query("SELECT review_id, field, 'must be 0 or 1' AS message FROM (" + " UNION ALL ".join(f"SELECT review_id, '{f}' AS field, {f} AS v FROM hardset_review WHERE {_TRIM('reviewer')} IS NOT NULL" for f in FLAGS) + f") WHERE coalesce(trim(v), '') NOT IN ('0', '1') UNION ALL SELECT review_id, 'keep', 'must be yes or no' FROM hardset_review WHERE {_TRIM('reviewer')} IS NOT NULL AND lower(coalesce(trim(keep), '')) NOT IN ('yes', 'no')")
def review_violations(spark: SparkSession, base: str) -> DataFrame:
    return R.review_violations(table(spark, base, "hardset_review"), FLAGS)


@query("""WITH r AS (SELECT DISTINCT style_id, target_char FROM reference_cache WHERE style_id IS NOT NULL AND target_char IS NOT NULL), m AS (SELECT style_id, target_char, count(*) AS n, min(reference_id) AS id FROM reference_manifest_template GROUP BY ALL)
SELECT r.style_id, r.target_char, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN id END AS reference_id FROM r LEFT JOIN m ON m.style_id = r.style_id AND m.target_char = r.target_char""")
def reference_lookup(spark: SparkSession, base: str) -> DataFrame:
    wanted = table(spark, base, "reference_cache").select("style_id", "target_char").dropna().distinct()
    return R.lookup(wanted, table(spark, base, "reference_manifest_template"), ["style_id", "target_char"])


@query(
    """WITH g AS (SELECT manifest_row_id, CASE WHEN image_width > 0 AND image_height > 0 THEN image_width END AS w, CASE WHEN image_width > 0 AND image_height > 0 THEN image_height END AS h FROM manifest),
n AS (SELECT manifest_row_id, w, greatest(CAST(round_even(w * least(512.0::DOUBLE / w, 512.0::DOUBLE / h), 0) AS INT), 1) AS nw,
  greatest(CAST(round_even(h * least(512.0::DOUBLE / w, 512.0::DOUBLE / h), 0) AS INT), 1) AS nh FROM g)
SELECT manifest_row_id, w IS NULL AS bad_size, CASE WHEN w IS NULL THEN 0 ELSE nw END AS nw, CASE WHEN w IS NULL THEN 0 ELSE nh END AS nh,
  CASE WHEN w IS NULL THEN 0 ELSE CAST(floor((512 - nw) / 2.0) AS INT) END AS "left", CASE WHEN w IS NULL THEN 0 ELSE CAST(floor((512 - nh) / 2.0) AS INT) END AS top FROM n"""
)
def letterbox_geometry(spark: SparkSession, base: str) -> DataFrame:
    """Every manifest row; those without a size are marked and have zeros."""
    good = F.coalesce((F.col("image_width") > 0) & (F.col("image_height") > 0), F.lit(False))
    nw, nh, left, top = B.letterbox_geometry(F.when(good, F.col("image_width")), F.when(good, F.col("image_height")), 512)
    cells = {"nw": nw, "nh": nh, "left": left, "top": top}
    return table(spark, base, "manifest").select(
        "manifest_row_id", (~good).alias("bad_size"), *[F.when(good, v).otherwise(0).alias(n) for n, v in cells.items()]
    )


@query("SELECT substr(sha256(text), 1, 12) AS content_name, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").where("text IS NOT NULL").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("content_name"))
    return d.groupBy("content_name").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS metric FROM events GROUP BY ALL), i AS (SELECT *, row_number() OVER w AS i, max(metric) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
u AS (SELECT *, max(CASE WHEN best IS NULL OR metric > best THEN i END) OVER (PARTITION BY event_type ORDER BY day) AS last_i FROM i), e AS (SELECT event_type, min(CASE WHEN i - last_i >= 5 THEN i END) AS stop, max(i) AS n FROM u GROUP BY event_type),
k AS (SELECT u.*, coalesce(stop, n) AS run FROM u JOIN e USING (event_type) WHERE i <= coalesce(stop, n) AND i = last_i)
SELECT event_type, CAST(max(day) AS VARCHAR) AS best_epoch, max(metric) AS best_value, any_value(run) AS epochs_run FROM k GROUP BY event_type""")
def best_epoch(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("metric"))
    return T.best_epoch(d, ["event_type"], "day", "metric", 5).withColumn("best_epoch", F.col("best_epoch").cast("string"))


@query()
def streaming_meter(spark: SparkSession, base: str) -> DataFrame:
    """The confusion meter as a stream over the events, run to its end."""
    from maskframe.plans.checkpoints import Cuts
    from maskframe.streaming.meter import windowed_confusion

    batch = table(spark, base, "events")
    folder = Cuts(spark).root
    stream = spark.readStream.schema(batch.schema).parquet(f"{base.rstrip('/')}/events.parquet*")
    hot: Column = F.col("value") > 50
    out = windowed_confusion(stream, "ts", ["event_type"], hot, F.col("user_id") % 2 == 0)

    def keep(windows: DataFrame, _: int) -> None:
        windows.write.mode("overwrite").parquet(f"{folder}/out")

    # Complete mode: windows the watermark has not passed are emitted too, and no row is too late. The last state replaces earlier ones.
    q = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
