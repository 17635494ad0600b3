import io
import zipfile

import numpy as np
import pytest
from maskframe.operators import corpus as C
from maskframe.operators import rules as R
from maskframe.plans.ranking import global_row_number
from maskframe.sources import files as S
from pyspark.sql import functions as F


def test_split_of_21_groups(spark):
    rows = spark.createDataFrame([(f"{c}/{g}", str(g)) for c in range(40) for g in range(21)], "sample_id string, g string")
    n = {r.split: (r.rows, r.groups) for r in C.split_counts(C.group_split(rows, "g"), "g").collect()}
    assert n == {"train": (600, 15), "val": (120, 3), "test": (120, 3)}
    first = {r.g for r in C.group_split(rows, "g").where("split = 'train'").select("g").distinct().collect()}
    assert first == {str(i) for i in range(15)}


def test_mixed_keys_and_half_even(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("x",), ("",)], "g string")
    got = {r.g: r.k for r in rows.select("g", C.stable_key(F.col("g")).alias("k")).collect()}
    assert got["9"] == 9 and got["x"] == int("11f6ad8e", 16)
    assert [r[0] for r in spark.createDataFrame([(2.5,), (3.5,)], "v double").select(C.half_even(F.col("v"))).collect()] == [2, 4]


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = global_row_number(df, [F.col("v")]).collect()
    assert all(r.rn == r.v + 1 for r in got) and len(got) == 1000


def test_merge_reviews(spark):
    base = spark.createDataFrame([("1/2", "1", "2"), ("3/4", "3", "4"), ("5/6", "5", "6")], "sample_id string, char_id string, sample_index string")
    reviews = spark.createDataFrame(
        [
            (1, "1/2", "1", "2", "yes", "a"), (2, "1/2", "1", "2", "", "b"), (3, "Mar-04", "3", "4", "no", "a"),
            (4, "5/6", "5", "6", "", ""), (5, "9/9", "9", "9", "yes", "a")
        ],
        "review_id long, sample_id string, char_id string, sample_index string, keep string, reviewer string",
    )
    got = {r.sample_id: (r.review_id, r.keep) for r in C.merge_reviews(base, reviews, ["keep"], ["keep", "reviewer"], strict=False).collect()}
    assert got == {"1/2": (2, ""), "3/4": (3, "no"), "5/6": (None, None)}


def test_systematic_sample(spark):
    df = spark.range(10).withColumnRenamed("id", "v")
    assert sorted(r.v for r in C.systematic_sample(df, ["v"], 4).collect()) == [0, 3, 6, 9]
    assert C.systematic_sample(df, ["v"], 0).count() == 10 and C.systematic_sample(df, ["v"], 1).first().v == 0


def test_lookup(spark):
    refs = spark.createDataFrame([("a", "x", "r1"), ("a", "y", "r2"), ("a", "y", "r3")], "style_id string, target_char string, reference_id string")
    want = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "style_id string, target_char string")
    got = {(r.style_id, r.target_char): (r.status, r.reference_id) for r in R.lookup(want, refs, ["style_id", "target_char"]).collect()}
    assert got == {("a", "x"): ("found", "r1"), ("a", "y"): ("ambiguous", None), ("b", "x"): ("missing", None)}
    ids = R.lookup(spark.createDataFrame([("r1",), ("r9",)], "reference_id string"), refs.unionByName(refs.where("reference_id = 'r2'")), ["reference_id"])
    assert {(r.reference_id, r.status) for r in ids.collect()} == {("r1", "found"), ("r9", "missing")}


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿a,b\n1,"x\ny"\n,2\n'.encode())
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "a.csv"), ["a", "b"]).collect()] == [("1", "x\ny"), ("", "2")]
    (tmp_path / "b.csv").write_bytes("b,a\n字,1\n".encode("gb18030"))
    assert [tuple(r) for r in S.read_csv_any(spark, str(tmp_path / "b.csv"), ["a", "b"]).collect()] == [("1", "字")]
    S.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"), ["b", "a", "c"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).na.fill("").collect()] == [("", "1", "")]


def test_binary_sources(spark, tmp_path):
    d = tmp_path / "root" / "1" / "2"
    d.mkdir(parents=True)
    np.save(d / "mask_1.npy", np.zeros((4, 6)))
    (d / "image.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x00\x00\x00")
    (d / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + b"\x00\x00\x00\x08\x00\x00\x00\x09")
    (d / "bad.npy").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in S.probe(spark, str(tmp_path / "root")).collect()}
    assert got == {"mask_1.npy": (6, 4), "image.jpg": (7, 5), "x.png": (8, 9), "bad.npy": (None, None)}
    s = S.scan_samples(spark, str(tmp_path / "root")).first()
    assert (s.char_id, s["sample"], s.image_path.rsplit("/", 1)[1]) == ("1", "2", "image.jpg")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("top/cat/字.png", b"1")
        z.writestr("top/no.png", b"2")
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    assert [(r.member, bytes(r.content)) for r in S.zip_members(spark, str(tmp_path / "a.zip")).collect()] == [("top/cat/字.png", b"1")]


def test_content_addressed_rows(spark):
    new = spark.createDataFrame([("n1", "d1"), ("n2", "d2"), ("n2", "d2")], "name string, digest string")
    old = spark.createDataFrame([("n1", "d1")], "name string, digest string")
    assert [r.name for r in S.new_content(new, old, "name", "digest").collect()] == ["n2"]
    with pytest.raises(Exception, match="other content"):
        S.new_content(new, spark.createDataFrame([("n1", "zz")], "name string, digest string"), "name", "digest").collect()


def cursor(sizes, limit):
    """The same picks with plain lists."""
    names, buckets, cursor, out = [g for g, _ in sizes], {g: list(range(1, n + 1)) for g, n in sizes}, 0, []
    while len(out) < limit and names:
        g = names[cursor % len(names)]
        out.append((g, buckets[g].pop(0)))
        names = [x for x in names if buckets[x]]
        cursor += 1
    return out


def test_template_skips_like_a_cursor(spark):
    rng = np.random.default_rng(3)
    for groups, limit in ((4, 50), (30, 10), (25, 12)):
        sizes = [(f"g{i:02}", int(rng.integers(1, 4))) for i in range(groups)]
        df = spark.createDataFrame(
            [(g, str(k), f"{g}/{k}", "x") for g, n in sizes for k in range(1, n + 1)],
            "c string, i string, id string, place string"
        )
        got = C.round_robin_template(df, "c", "i", "id", limit).orderBy("place").collect()
        assert [(r.c, int(r.i)) for r in got] == cursor(sizes, limit)
    assert C.round_robin_template(df.limit(0), "c", "i", "id", 5).count() == 0


def test_uploads_and_file_stream(spark, tmp_path):
    png = lambda w, h: b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")
    rows = [("a", png(5, 5)), ("b", b""), ("c", None), ("d", b"x" * 200), ("e", b"no image"), ("f", png(9000, 5)), ("g", png(0, 5))]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    assert {r.path: (r.error_code, r.suffix) for r in S.check_uploads(df, 100).collect()} == {
        "a": (None, ".png"), "b": ("40001", None), "c": ("40001", None), "d": ("41301", None), "e": ("40001", None),
        "f": ("40001", None), "g": ("40001", None)
    }
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(png(i + 1, 2))
    (tmp_path / "in" / "note.txt").write_text("x")
    seen = []
    q = S.stream_files(spark, str(tmp_path / "in"), "*.png", 2).writeStream.foreachBatch(lambda b, _: seen.append([r.path[-5:] for r in S.check_uploads(b, 100).collect()])).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(p for b in seen for p in b) == ["0.png", "1.png", "2.png"] and len(seen) == 2
