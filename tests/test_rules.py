import pytest
from maskframe.operators import corpus as C
from maskframe.operators import courses as K
from maskframe.operators import rules as R
from pyspark.sql import functions as F

GOOD = {
    "schema_version": "1", "reference_id": "ref_1", "style_id": "test_style", "target_char": "永", "image_path": "reference.png", "source_type": "manual", "source_url": "https://example.test",
    "source_license": "test-license", "source_work_id": "work_1", "source_version": "v1", "author_id": "author", "script_style": "kaishu", "is_synthetic": "false", "review_status": "approved", "reviewer": "reviewer", "review_date": "2026-07-27",
}


def manifest(spark, *changes, without=()):
    rows = [{k: v for k, v in {**GOOD, "reference_id": f"ref_{i}", **c}.items() if k not in without} for i, c in enumerate(changes)]
    names = [k for k in GOOD if k not in without]
    return spark.createDataFrame([(i, *[r[k] for k in names]) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"{k} string" for k in names))


def registry(spark, enabled=True, author=None):
    return spark.createDataFrame(
        [("test_style", enabled, author, " kaishu ")], "style_id string, enabled boolean, author_id string, script_style string"
    )


def errors(df, reg, **more):
    return sorted((r.row_id, r.field, r.message) for r in R.manifest_violations(df, reg, **more).collect())


def test_enabled_style_for_approved_rows(spark):
    m = manifest(spark, {})
    assert errors(m, registry(spark, False)) == [(0, "style_id", "style is not enabled")]
    assert errors(m, registry(spark), require_approved=True) == []
    r = R.manifest_report(m, registry(spark), require_approved=True).first()
    assert (r.num_rows, r.num_approved, r.missing_columns, r.num_errors, r.valid) == (1, 1, [], 0, True)


def test_every_rule(spark):
    m = manifest(
        spark, {"reference_id": " "}, {"reference_id": "x"}, {"reference_id": "x", "schema_version": "2"}, {
            "style_id": "other", "target_char": "二字", "source_type": ""
        }, {"target_char": "二字", "image_path": None}, {"source_type": "　", "is_synthetic": "maybe"},
        {"review_status": "done"}, {"review_status": "pending", "source_url": ""}, {
            "script_style": "xingshu", "reviewer": "", "review_date": None
        }, {"author_id": "someone"},
    )
    want = [
        (0, "reference_id", "required"), (2, "reference_id", "duplicate"), (2, "schema_version", "must be 1"), (3, "style_id", "not in registry"), (4, "image_path", "required"), (
            4, "target_char", "must be one character"
        ),
        (5, "is_synthetic", "must be true or false"), (5, "source_type", "required"), (
            6, "review_status", "must be pending, approved, or rejected"
        ), (8, "review_date", "required for approved reference"),
        (8, "reviewer", "required for approved reference"), (8, "script_style", "must match registry value: kaishu"),
    ]
    assert errors(m, registry(spark)) == want
    strict = errors(m, registry(spark, author="author"), require_approved=True)
    assert set(strict) - set(want) == {
        (6, "review_status", "must be approved"), (7, "review_status", "must be approved"),
        (9, "author_id", "must match registry value: author")
    }
    assert R.manifest_report(m, registry(spark)).first().num_approved == 7


def test_files_missing_columns_and_empty(spark):
    m = manifest(spark, {}, {"image_path": "gone.png"}, without=("reviewer",))
    files = spark.createDataFrame([("reference.png",), (None,)], "image_path string")
    assert ((1, "image_path", "file not found") in errors(m, registry(spark), files=files)) and R.missing_columns(m) == ["reviewer"]
    assert (0, "reviewer", "required for approved reference") in errors(m, registry(spark))
    r = R.manifest_report(m.limit(0), registry(spark)).first()
    assert (r.num_rows, r.valid, len(r.missing_columns)) == (0, False, len(R.MANIFEST_COLUMNS))


def config(*courses, version=1):
    return {"schema_version": version, "courses": [{**dict.fromkeys(K.FIELDS, "x"), "enabled": True, **c} for c in courses]}


def test_course_configuration(spark):
    assert K.courses(spark, config({"course_id": "a"}, {"course_id": "b", "enabled": False})).count() == 2
    for bad, why in (
        (config({"course_id": "a"}, version=2), "schema_version"), ({"schema_version": 1, "courses": {}}, "must be a list"),
        ({"schema_version": 1, "courses": ["a"]}, "mapping"),
        ({"schema_version": 1, "courses": [{"course_id": "a"}]}, "missing fields"),
        (config({"course_id": "a"}, {"course_id": "a"}), "duplicate"), ({"schema_version": 1, "courses": []}, "no courses")
    ):
        with pytest.raises(K.CourseError, match=why):
            K.courses(spark, bad)


REFS = "reference_id string, style_id string, target_char string, image_path string, review_status string"


def test_course_lookup_and_catalogue(spark):
    packs = K.courses(
        spark,
        config(
            {"course_id": "a", "style_id": "s", "cache_index": "i"},
            {"course_id": "off", "style_id": "s", "enabled": False, "cache_index": "j"}, {"course_id": "none", "style_id": "z"}
        )
    )
    refs = spark.createDataFrame(
        [
            ("r1", "s", "亮", "p1", "Approved"), ("r2", "s", "永", "p2", "approved"), ("r3", "s", "永", "p3", "approved"),
            ("r4", "s", "火", "p4", "pending"), ("", "s", "两个", "p", "approved")
        ],
        REFS
    )
    asked = [("a", "亮"), ("a", "永"), ("a", "火"), ("a", "两个"), ("a", None), ("off", "亮"), ("b", "亮")]
    got = {(r.course_id, r.target_char): (r.status, r.reference_id) for r in K.find_course(
        spark.createDataFrame(asked, "course_id string, target_char string"), packs, refs
    ).collect()}
    assert got == {
        ("a", "亮"): ("found", "r1"), ("a", "永"): ("ambiguous_reference", None), ("a", "火"): ("unsupported_character", None), ("a", "两个"): ("not_one_character", None), ("a", None): ("not_one_character", None),
        ("off", "亮"): ("course_disabled", None), ("b", "亮"): ("unknown_course", None),
    }
    codes = K.find_course(
        spark.createDataFrame(asked, "course_id string, target_char string"), packs, refs
    ).select("status", K.error_code(F.col("status")).alias("c")).distinct().collect()
    assert {r.status: r.c for r in codes} == {
        "found": None, "ambiguous_reference": "40901", "unsupported_character": "40901", "not_one_character": "50001",
        "course_disabled": "40002", "unknown_course": "40002"
    }
    entries = K.catalog(packs, refs, spark.createDataFrame([("i",)], "cache_index string"))
    e = {r.course_id: r for r in entries.collect()}
    assert [(c.target_char, c.reference_id) for c in e["a"].characters] == [("两个", ""), ("亮", "r1"), ("永", "r2")] and e["a"].supported_character_count == 4
    assert e["a"].cache_available and not e["off"].cache_available and e["none"].characters == []
    assert [r.course_id for r in K.missing_caches(entries).collect()] == ["none"]
    assert sorted(map(tuple, K.course_violations(packs, refs).collect())) == [
        ("a", "invalid manifest reference", 1), ("a", "multiple approved references", 1), ("none", "no approved references", 0),
        ("off", "invalid manifest reference", 1), ("off", "multiple approved references", 1)
    ]
    with pytest.raises(K.CourseError, match="'a'"):
        K.check_courses(packs, refs)
    K.check_courses(packs.where("course_id = 'a'"), refs.where("target_char = '亮'"))


def test_reviews_that_match_nothing_raise(spark):
    base = spark.createDataFrame([("1/2", "1", "2"), ("3/4", "3", "4"), ("3/5", "3", "4")], "sample_id string, char_id string, sample_index string")
    reviews = spark.createDataFrame(
        [(1, "1/2", "1", "2", "yes", "a"), (2, "Mar-04", "3", "4", "no", "a"), (3, "9/9", "9", "9", "yes", "a"), (4, "8/8", "8", "8", "", " ")],
        "review_id long, sample_id string, char_id string, sample_index string, keep string, reviewer string"
    )
    with pytest.raises(ValueError, match="cannot match reviewed row sample_id='9/9'"):
        C.merge_reviews(base, reviews, ["keep"], ["keep", "reviewer"])
    got = {r.sample_id: r.keep for r in C.merge_reviews(base, reviews, ["keep"], ["keep", "reviewer"], strict=False).collect()}
    assert got == {"1/2": "yes", "3/4": None, "3/5": "no"}
    assert [r.review_id for r in C.unmatched_reviews(base, reviews, ["keep", "reviewer"]).collect()] == [3]
