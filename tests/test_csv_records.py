import pytest
from maskframe.functions.text import relative_path, whole_number
from maskframe.operators import csv_records as C
from pyspark.sql import functions as F

SCHEMA = "raw_id long, file_name string, line_no int, record_text string, reason string, _names string"
HEAD = "sample_id,char_id,keep,difficulty_crossing,notes"


def classify(spark, records, head="﻿" + HEAD + "\r"):
    rows = [(0, "f", 1, head, "x", "y")] + [(i + 1, "f", i + 2, r, "x", "y") for i, r in enumerate(records)]
    return C.classify(spark.createDataFrame(rows, SCHEMA))


CASES = [
    ("1/2,1,yes,1,fine", None),
    ("1/2,1,yes,1,fine\r", None),
    ('"1/2","1","NO","","a ""b"", c"', None),
    ('1/2,1,,0,"two\nlines, ""quoted"""', None),
    (" 1/2\t,1, Yes ,\t0,", None),
    ('1/2,1,yes,1,a"b', C.BAD_QUOTING),
    ('1/2,1,yes,1,"open', C.BAD_QUOTING),
    ('1/2,1,yes,1,"a"b', C.BAD_QUOTING),
    ('1/2,1,yes,1,"a" ', C.BAD_QUOTING),
    ('1/2,1,yes,1, "a"', C.BAD_QUOTING),
    ("1/2,1,yes,1", C.BAD_COUNT),
    ("1/2,1,yes,1,a,b", C.BAD_COUNT),
    ("", C.BAD_COUNT),
    (None, C.BAD_COUNT),
    ("1/2,1,yes,1,fine\r\r", None),
    ("1-2,1,yes,1,", "invalid_sample_id"),
    ("１/2,1,yes,1,", "invalid_sample_id"),
    ("1/2\n,1,yes,1,", "invalid_sample_id"),
    (",1,yes,1,", "invalid_sample_id"),
    ("1/2,1,maybe,1,", "invalid_keep"),
    ("1/2,1,yes,2,", "invalid_difficulty_crossing"),
    ("1/2,1,yes,１,", "invalid_difficulty_crossing"),
]


def test_reasons(spark):
    got = {r.raw_id: r.reason for r in classify(spark, [c for c, _ in CASES]).collect()}
    assert [(c, got[i + 1]) for i, (c, _) in enumerate(CASES)] == CASES


def test_valid_rows_are_typed_and_failing_ones_keep_their_text(spark):
    df = classify(spark, ['"1/2", 07 ,YES,1,"say ""hi"", twice"', "x"])
    v = C.valid_rows(df).collect()
    assert [(
        r.sample_id, r.char_id, r.keep, r.difficulty_crossing, r.notes, r.difficulty_style
    ) for r in v] == [("1/2", 7, True, 1, 'say "hi", twice', None)]
    assert [(r.reason, r.corrupt_text) for r in C.failing_rows(df).collect()] == [(C.BAD_COUNT, "x")]
    assert "_names" in df.columns  # a clashing column is kept


def test_very_long_and_many_quotes(spark):
    long = '1/2,1,yes,1,"' + '""' * 50_000 + "x" * 200_000 + '"'
    bad = '1/2,1,yes,1,"' + '""' * 50_000
    assert [r.reason for r in classify(spark, [long, bad]).orderBy("raw_id").collect()] == [None, C.BAD_QUOTING]


def test_files_with_other_headers_none_and_empty(spark):
    rows = [
        (1, "a", 1, "keep,sample_id"), (2, "a", 2, "no,3/4"), (3, "a", 3, "3/4,no"), (4, "b", 7, "1"), (5, "c", 1, "notes"),
        (6, "c", 2, "any"), (7, "a", 2, "no,3/4"), (8, "c", None, "n")
    ]
    got = {r.raw_id: r.reason for r in C.classify(spark.createDataFrame(
        rows, "raw_id long, file_name string, line_no int, record_text string"
    )).collect()}
    assert got == {2: None, 3: "invalid_sample_id", 4: C.NO_HEADER, 6: None, 7: None, 8: None}
    assert C.classify(spark.createDataFrame([], "raw_id long, file_name string, line_no int, record_text string")).count() == 0


@pytest.mark.parametrize(
    "raw, want",
    [(" a\\\\b/./c.png　", "a/b/c.png"), ("./a//b", "a/b"), ("././a/.", "a"), (".a/b..", ".a/b.."), ("a/./././b", "a/b"), ("/a/b/", "a/b")]
)
def test_relative_path(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "p string").select(relative_path(F.col("p"))).first()[0] == want


def test_whole_number(spark):
    rows = [(x,) for x in ["7", " 007 ", "7.0", "７", "7.5", "", None, "x", "9" * 30]]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(whole_number(F.col("v"))).collect()]
    assert got == [7, 7, 7, 7, None, None, None, None, None]


def test_more_separators_than_the_reader_takes(spark):
    many = "," * 30_000
    cases = [
        (f"1/2,1,yes,1,{many}", C.BAD_COUNT), (f'1/2,1,yes,1,"{many}', C.BAD_QUOTING), (f'1/2,1,yes,1,"{many}"', None),
        ("1/2,1,yes,1,fine", None), (f"1/2,1,yes,1,{many}\r", C.BAD_COUNT)
    ]
    df = classify(spark, [c for c, _ in cases])
    got = {r.raw_id: (r.reason, r.corrupt_text) for r in df.collect()}
    assert [got[i + 1] for i in range(len(cases))] == [(why, text if why else None) for text, why in cases]
    assert [r.notes for r in C.valid_rows(df).orderBy("raw_id").collect()] == [many, "fine"]
    rows = [(1, "a", 2, many), (2, "b", 1, "notes"), (3, "b", 2, "x")]
    other = C.classify(spark.createDataFrame(rows, "raw_id long, file_name string, line_no int, record_text string"))
    assert {r.raw_id: r.reason for r in other.collect()} == {1: C.NO_HEADER, 3: None}


def test_no_sign_in_the_text_is_special(spark):
    cases = [
        ("1/2,1,yes,1,a\x01b", None, "a\x01b"), ("1/2,1,\x02,1,fine", "invalid_keep", None), ("1/2,1,yes,1,\x02", None, "\x02"), (
            "\x001/2,1,yes,1,x", "invalid_sample_id", None
        ),
        (
            '1/2,1,yes,1,"a\x01,""b"""', None, 'a\x01,"b"'
        ), (
            '1/2,1,yes,1,"a\x01', C.BAD_QUOTING, None
        ), ("1/2,1,yes,1,a\nb", None, "a\nb"), ("1/2,1\x01,yes", C.BAD_COUNT, None), ("1/2,1,yes,1,a\\", None, "a\\"), (
            "#1/2,1,yes,1,", "invalid_sample_id", None
        ),
    ]
    df = classify(spark, [c for c, _, _ in cases])
    got = {r.raw_id: (r.reason, r.fields.notes if r.reason is None else None) for r in df.collect()}
    assert [(c, *got[i + 1]) for i, (c, _, _) in enumerate(cases)] == cases


def test_the_reader_marks_wrong_shapes(spark):
    df = classify(spark, ["1/2,1,yes,1,x", "1/2,1,yes", "1/2,1,yes,1,a,b", '1/2,1,yes,1,"open', '1/2,1,yes,1,a"b', "1/2,1\x01,yes"])
    assert [(r.marked, r.reason) for r in df.orderBy("raw_id").collect()][:3] == [(False, None), (True, C.BAD_COUNT), (True, C.BAD_COUNT)]
    assert [r.marked for r in df.orderBy("raw_id").collect()][5] is None


def test_narrow_and_wide_headers_together(spark):
    rows = [
        (1, "a", 1, "keep"), (2, "a", 2, ""), (3, "a", 3, "yes"), (4, "a", 4, "yes,no"), (5, "a", 5, '"y""s"'), (6, "b", 1, HEAD),
        (7, "b", 2, "1/2,1,yes,1,"), (8, "b", 3, "1/2,1,yes,1")
    ]
    got = {r.raw_id: r.reason for r in C.classify(spark.createDataFrame(
        rows, "raw_id long, file_name string, line_no int, record_text string"
    )).collect()}
    assert got == {2: None, 3: None, 4: C.BAD_COUNT, 5: "invalid_keep", 7: None, 8: C.BAD_COUNT}
