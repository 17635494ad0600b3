
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.text import blank_to_null, strip
from maskframe.operators.scoring import match_band

#: Columns of a reference manifest that have to be there, and the fields an approved row has to fill (fixed values).
MANIFEST_COLUMNS = [
    "schema_version", "reference_id", "style_id", "target_char", "image_path", "source_type", "source_url", "source_license", "source_work_id",
    "source_version", "author_id", "script_style", "is_synthetic", "review_status", "reviewer", "review_date",
]
APPROVED_FIELDS = ["source_url", "source_license", "source_work_id", "source_version", "reviewer", "review_date"]
STATUSES = ["pending", "approved", "rejected"]


def violations(rows: DataFrame, row_id: str, rules: list[tuple[str, str | Column, Column]]) -> DataFrame:
    """One row for each violated rule (field, message, condition): ``row_id``, ``field``, ``message``. A null condition is no violation."""
    text = lambda m: m if isinstance(m, Column) else F.lit(m)
    hits = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), text(m).alias("message"))) for f, m, bad in rules]))
    return rows.select(row_id, F.explode(hits).alias("v")).select(row_id, "v.field", "v.message")


def missing_columns(manifest: DataFrame) -> list[str]:
    """[U1] Required columns a manifest lacks, in order; an empty manifest lacks all of them."""
    have = [] if manifest.isEmpty() else manifest.columns
    return sorted(set(MANIFEST_COLUMNS) - set(have))


def _judged(manifest: DataFrame, registry: DataFrame, row_id: str) -> DataFrame:
    """Manifest cells as trimmed text, empty for null and for columns that are not there, with the registry's entry beside them."""
    cell = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) if c in manifest.columns else F.lit("")
    m = manifest.select(F.col(row_id).alias("_row"), *[cell(c).alias(c) for c in MANIFEST_COLUMNS])
    own = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) if c in registry.columns else F.lit("")
    reg = registry.where("style_id IS NOT NULL").select(
        F.col("style_id").alias("style_id"), own("author_id").alias("_author"), own("script_style").alias("_script"),
        F.coalesce("enabled", F.lit(False)).alias("_enabled"), F.lit(True).alias("_known")
    )
    first = m.where("reference_id <> ''").groupBy("reference_id").agg(F.min("_row").alias("_first"))
    m = m.join(first, "reference_id", "left").join(reg.dropDuplicates(["style_id"]), "style_id", "left")
    return m.withColumn("_known", F.coalesce("_known", F.lit(False))).withColumn("_status", F.lower("review_status"))


def manifest_violations(
    manifest: DataFrame, registry: DataFrame, row_id: str = "row_id", files: DataFrame | None = None,
    require_approved: bool = False
) -> DataFrame:
    """[R1, J8, O11] Violated rules of a reference manifest: ``row_id``, ``field``, ``message`` (fixed values).

    Rows of a style that is not registered are not checked further. ``row_id`` orders the rows: second and later
    rows of a reference id are duplicates. With ``files`` (a column ``image_path``) paths must be among them.
    Nulls and missing columns count as empty; repeated rows are duplicates; an empty manifest violates no row rule.
    """
    m = _judged(manifest, registry, row_id)
    if files is not None:
        m = m.join(files.select(F.col("image_path"), F.lit(True).alias("_there")).dropDuplicates(["image_path"]), "image_path", "left")
    empty, known, approved = lambda c: F.col(c) == "", F.col("_known"), F.col("_known") & (F.col("_status") == "approved")
    rules = [
        ("reference_id", "required", empty("reference_id")),
        ("reference_id", "duplicate", F.col("_row") > F.col("_first")),
        ("style_id", "not in registry", ~known),
        ("schema_version", "must be 1", known & (F.col("schema_version") != "1")),
        ("target_char", "must be one character", known & (F.length("target_char") != 1)),
        ("image_path", "required", known & empty("image_path")),
        *([("image_path", "file not found", known & ~empty("image_path") & F.col("_there").isNull())] if files is not None else []),
        ("source_type", "required", known & empty("source_type")),
        ("is_synthetic", "must be true or false", known & ~F.lower("is_synthetic").isin("true", "false")),
        ("review_status", "must be pending, approved, or rejected", known & ~F.col("_status").isin(STATUSES)),
        (
            "author_id", F.concat(F.lit("must match registry value: "), F.col("_author")),
            known & (F.col("_author") != "") & (F.col("author_id") != F.col("_author"))
        ),
        (
            "script_style", F.concat(F.lit("must match registry value: "), F.col("_script")),
            known & (F.col("_script") != "") & (F.col("script_style") != F.col("_script"))
        ),
        *[(f, "required for approved reference", approved & empty(f)) for f in APPROVED_FIELDS],
        ("style_id", "style is not enabled", approved & ~F.col("_enabled")),
        *([("review_status", "must be approved", known & (F.col("_status") != "approved"))] if require_approved else []),
    ]
    return violations(m, "_row", rules).withColumnRenamed("_row", row_id)


def manifest_report(
    manifest: DataFrame, registry: DataFrame, row_id: str = "row_id", files: DataFrame | None = None,
    require_approved: bool = False
) -> DataFrame:
    """[A22] One row: ``num_rows``, ``num_approved`` (of registered styles), ``missing_columns``, ``num_errors`` and ``valid``.

    The errors themselves are the rows of :func:`manifest_violations`; they are counted here, not gathered.
    """
    lacking = missing_columns(manifest)
    rows = _judged(manifest, registry, row_id).agg(
        F.count("*").alias("num_rows"), F.count_if(F.col("_known") & (F.col("_status") == "approved")).alias("num_approved")
    )
    bad = manifest_violations(manifest, registry, row_id, files, require_approved).agg(F.count("*").alias("num_errors"))
    out = rows.crossJoin(bad)  # one row each
    return out.select(
        "num_rows", "num_approved", F.lit(lacking).cast("array<string>").alias("missing_columns"), "num_errors",
        (F.lit(not lacking) & (F.col("num_errors") == 0)).alias("valid")
    )


def lookup(requests: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """[J6, J7, R8] Requests with ``status``: ``missing``, ``found`` or ``ambiguous``, and the ``reference_id`` where it is one.

    ``keys`` may be the reference id itself; then the request's own one stays.
    """
    per = references.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("reference_id").alias("_id"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    status = F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous").alias("status")
    found = [] if "reference_id" in keys else [F.when(n == 1, F.col("_id")).alias("reference_id")]
    return requests.join(per, keys, "left").select(*requests.columns, status, *found)


def approved(references: DataFrame) -> DataFrame:
    """[P5] References whose review status is approved, in any case."""
    return references.where(F.lower("review_status") == "approved")


def approved_prefix(references: DataFrame, order: str, limit: int | None) -> DataFrame:
    """[P6] The first ``limit`` approved references in ``order``; all of them without a limit."""
    return approved(references) if limit is None else approved(references).orderBy(order).limit(limit)


def style_counts(registry: DataFrame, references: DataFrame) -> DataFrame:
    """[A21] References of every registered style; zero where there are none."""
    n = references.groupBy("style_id").agg(F.count("*").alias("references"))
    return registry.select("style_id").join(n, "style_id", "left").select("style_id", F.coalesce("references", F.lit(0)).alias("references"))


def review_violations(reviews: DataFrame, flags: list[str]) -> DataFrame:
    """[R4] Of rows with a reviewer: flags other than 0 or 1, keep other than yes or no."""
    r = reviews.where(blank_to_null(F.col("reviewer")).isNotNull())
    rules = [(f, "must be 0 or 1", ~F.coalesce(F.trim(f), F.lit("")).isin("0", "1")) for f in flags]
    return violations(r, "review_id", [*rules, ("keep", "must be yes or no", ~F.lower(F.coalesce(F.trim("keep"), F.lit(""))).isin("yes", "no"))])


def severity(v: Column, high: float, medium: float, low: float) -> Column:
    """[P16] Cascade of limits, null below the last."""
    return F.when(v >= high, "high").when(v >= medium, "medium").when(v >= low, "low")


#: Finding -> (limits high, medium, low; factor of the priority; title; action), and message texts. Fixed values.
LIMITS = {
    "layout_center_offset": ((0.08, 0.04, 0.02), 10.0, "整体重心偏移", "先调整字的整体占位和主部件位置，再处理局部笔画；不要通过拉伸整张字图来补偿。"),
    "layout_ink_scale": ((0.30, 0.15, 0.08), 8.0, "整体大小比例", "先按参考字的外接范围控制字的整体大小，再微调各部件之间的留白。"),
    "keypoint_relation": ((0.45, 0.25, 0.10), 8.0, "起收笔与转折关系", "重点观察起笔、收笔、转折和交叉位置，先对齐这些骨架点，再追求笔画粗细。"),
    "local_direction_structure": ((0.50, 0.25, 0.08), 7.0, "局部笔画结构", "打开叠加图，对照该区域的笔画位置、走向和收束范围；一次只调整这一处，不要同时改动整字。"),
}
CENTER_TEXT, SCALE_TEXT, KEYPOINT_TEXT = "与范字相比，整体墨迹重心偏向%s侧。", "相对范字，当前字的整体墨迹面积%s。", "关键点与范字的对应关系存在明显差异。"
LOCAL_TEXT = "%s的笔画结构与范字差异较大，当前主要表现为%s对应结构。"
SOME_FINDINGS, NO_FINDINGS = "已识别出优先练习的结构问题，请按顺序逐项调整。", "当前字与所选范字的结构接近；仍建议查看叠加图进行细节练习。"
#: Part of the vertical offset beyond which the horizontal one is named too.
SIDEWAYS = 0.45


def _messages() -> dict[str, Column]:
    x, y = F.coalesce("offset_x", F.lit(0.0)), F.coalesce("offset_y", F.lit(0.0))
    vertical = F.when(y > 0, "下").otherwise("上")
    side = F.when(F.abs(x) >= F.abs(y) * SIDEWAYS, F.concat(F.when(x > 0, "右").otherwise("左"), vertical)).otherwise(vertical)
    kind = F.when(F.col("local_kind") == "missing_reference_structure", "缺少").otherwise("多出")
    return {
        "layout_center_offset": F.format_string(CENTER_TEXT, side),
        "layout_ink_scale": F.format_string(SCALE_TEXT, F.when(F.col("area_ratio") > 1.0, "偏小").otherwise("偏大")),
        "keypoint_relation": F.lit(KEYPOINT_TEXT),
        "local_direction_structure": F.format_string(LOCAL_TEXT, F.coalesce("local_region", F.lit("局部")), kind),
    }


def findings(evidence: DataFrame, row_id: str, top: int = 3) -> DataFrame:
    """[R6, P16, O6] Ranked findings of each row of evidence: ``row_id``, ``rank``, ``finding_id``, ``severity``, ``priority``, ``title``, ``message``, ``action``.

    ``evidence`` has ``offset_x``, ``offset_y`` (parts of the diagonal), ``area_ratio``, ``keypoint_f1``, ``worst_dice``,
    ``local_region`` and ``local_kind`` of the dominant difference; null measures are no finding. Order: severity,
    priority, id. A row brings at most four findings, ranked inside the row: no shuffle.
    """
    if top < 1:
        raise ValueError("top must be positive")
    values = {
        "layout_center_offset": F.hypot("offset_x", "offset_y"),
        "layout_ink_scale": F.abs(F.ln(F.when(F.col("area_ratio") > 1e-6, F.col("area_ratio")).when(F.col("area_ratio").isNotNull(), 1e-6))),
        "keypoint_relation": 1 - F.col("keypoint_f1"), "local_direction_structure": 1 - F.col("worst_dice")
    }
    weight, texts, entries = {"high": 3, "medium": 2, "low": 1}, _messages(), []
    for name, v in values.items():
        limits, factor, title, action = LIMITS[name]
        s = severity(v, *limits)
        w = F.when(s == "high", weight["high"]).when(s == "medium", weight["medium"]).otherwise(weight["low"])
        entries.append(F.when(
            s.isNotNull(),
            F.struct(
                (-w).alias("w"), (-F.round(v * factor, 9)).alias("p"), F.lit(name).alias("finding_id"), s.alias("severity"),
                F.lit(title).alias("title"), texts[name].alias("message"), F.lit(action).alias("action")
            )
        ))
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, top)
    return evidence.select(row_id, F.posexplode(ranked).alias("pos", "f")).select(
        row_id, (F.col("pos") + 1).alias("rank"), "f.finding_id", "f.severity", (-F.col("f.p")).alias("priority"), "f.title",
        "f.message", "f.action"
    )


def feedback_documents(evidence: DataFrame, found: DataFrame, row_id: str, top: int = 3) -> DataFrame:
    """[R7] ``row_id`` and ``feedback``: the contract of every row of evidence (with ``score``, ``course_id``, ``course_name``, ``target_char``) as JSON.

    ``found`` comes from :func:`findings`; at most four entries a row. Rows without findings have an empty list.
    """
    item = F.struct("rank", "finding_id", "severity", "title", "message", "action")
    f = found.groupBy(row_id).agg(F.array_sort(F.collect_list(item)).alias("_f"))
    j = evidence.join(f, row_id, "left").withColumn("_f", F.coalesce("_f", F.array().cast(f.schema["_f"].dataType)))
    pick = lambda *names: F.transform("_f", lambda x: F.struct(*[x[n].alias(n) for n in names]))
    document = F.struct(
        F.lit(1).alias("schema_version"), F.lit("evidence_grounded_reference_practice").alias("feedback_type"), F.lit("参考结构匹配度").alias("score_label"), F.lit(False).alias("score_is_calibrated_calligraphy_grade"),
        F.struct(
            "course_id", F.col("course_name").alias("display_name")
        ).alias("course"), "target_char", F.when(F.size("_f") > 0, SOME_FINDINGS).otherwise(NO_FINDINGS).alias("summary"),
        F.struct(F.col("score").alias("prototype_structure_score"), match_band(F.col("score")).alias("band")).alias("structural_match"),
        pick(
            "finding_id", "severity", "title", "message", "action"
        ).alias("findings"), pick("severity", "title", "message", "action").alias("deterministic_feedback"),
        F.struct(
            F.lit(True).alias("may_rephrase_findings"), F.lit(True).alias("must_not_change_score"),
            F.lit(True).alias("must_not_invent_unobserved_strokes"),
            F.lit(True).alias("must_not_claim_expert_or_aesthetic_grade"), F.lit(top).alias("max_feedback_items")
        ).alias("llm_policy"),
    )
    return j.select(row_id, F.to_json(document).alias("feedback"))


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``, by an aggregate."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def rank_in(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
