import csv
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from maskframe import jobs as J
from maskframe.sources import audit as A
from maskframe.sources import files as S


def read(path):
    with open(path, encoding="utf-8-sig", newline="") as f:
        return list(csv.DictReader(f))


def png(w=256, h=256, kind=2):
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + b"\xff" * (w * 3) for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(
        b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    ) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for char in ("0", "1"):
        for k in range(7):
            d = root / char / str(k)
            d.mkdir(parents=True)
            (d / "image.jpg").write_bytes(png(7, 5))
            (d / "0.jpg").write_bytes(png(9, 5))
            for n in (A.STACKED, *A.MASKS.values()):
                np.save(d / n, np.zeros((3, 4)))
    (root / "1" / "3" / "mask_2.npy").unlink()
    np.save(root / "1" / "4" / "mask_2.npy", np.zeros((4, 4)))
    (root / "1" / "5" / "0.jpg").write_bytes(b"no")
    (root / "1" / "6" / "0.npy").write_bytes(b"no")
    (root / "1" / "empty").mkdir()
    return root


def test_audit_split_and_template(spark, corpus, tmp_path):
    report = J.audit(spark, str(corpus), str(tmp_path / "m.csv"), str(tmp_path / "r.json"))
    assert report == {
        "num_char_dirs": 2, "num_samples": 15, "num_samples_with_errors": 5, "num_samples_missing_any_mask": 2,
        "num_complete_samples": 10
    }
    assert json.loads((tmp_path / "r.json").read_text()) == report
    rows = {r["sample_id"]: r for r in read(tmp_path / "m.csv")}
    assert list(next(iter(rows.values()))) == A.COLUMNS and len(A.COLUMNS) == 29
    assert [rows[f"1/{k}"]["errors"] for k in (3, 4, 5, 6)] == [
        "vec2:missing", "mask_shape_mismatch", "bad_image:UnidentifiedImageError", "stacked_mask:bad_npy:ValueError"
    ]
    e = rows["1/empty"]
    assert e["errors"].split("|")[:3] == [
        "missing_image", "stacked_mask:missing", "vec1:missing"
    ] and e["sample_index"] == "" and e["split_group_key"] == "1/empty"
    assert (
        rows["0/2"]["image_width"], rows["0/2"]["vec1_shape"], rows["0/2"]["split_group_key"], rows["0/2"]["has_all_masks"]
    ) == ("9", "3x4", "2", "true")
    counts = J.split(spark, str(tmp_path / "m.csv"), str(tmp_path / "s.csv"))
    assert sum(counts.values()) == 10 and {r["split"] for r in read(tmp_path / "s.csv") if r["group_key"] == "0"} == {"train"}
    assert J.template(spark, str(tmp_path / "m.csv"), str(tmp_path / "t.csv"), 4) == 4
    assert [r["sample_id"] for r in read(tmp_path / "t.csv")] == ["0/0", "1/0", "0/1", "1/1"]


def review(path, rows, encoding="utf-8-sig"):
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.DictWriter(f, J.REVIEW_COLUMNS, restval="")
        w.writeheader()
        w.writerows(rows)


def test_merge(spark, tmp_path):
    flags = dict.fromkeys(J.FLAGS, "0")
    review(
        tmp_path / "base.csv",
        [
            {"sample_id": "1/2", "char_id": "1", "sample_index": "2", "notes": "old", "priority": "high"},
            {"sample_id": "3月4日", "char_id": "3", "sample_index": "4", "notes": "stays"}
        ]
    )
    good = {"sample_id": "Feb-01", "char_id": "1", "sample_index": "2", **flags, "reviewer": "甲", "keep": "yes"}
    review(tmp_path / "new.csv", [good, {"sample_id": "9/9", "notes": "untouched"}], "gb18030")
    assert J.merge(spark, str(tmp_path / "base.csv"), str(tmp_path / "new.csv"), str(tmp_path / "out.csv")) == 2
    got = {r["sample_id"]: r for r in read(tmp_path / "out.csv")}
    assert (got["1/2"]["reviewer"], got["1/2"]["notes"], got["1/2"]["priority"], got["3/4"]["notes"]) == ("甲", "", "", "stays")
    review(tmp_path / "bad.csv", [{**good, "keep": "maybe"}])
    with pytest.raises(ValueError, match="1/2: keep"):
        J.merge(spark, str(tmp_path / "base.csv"), str(tmp_path / "bad.csv"), str(tmp_path / "out.csv"))
    review(tmp_path / "lost.csv", [{**good, "char_id": "8"}])
    with pytest.raises(ValueError, match="cannot match"):
        J.merge(spark, str(tmp_path / "base.csv"), str(tmp_path / "lost.csv"), str(tmp_path / "out.csv"))


def test_import_validates(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for category, char in (("甲-楷", "欧"), ("乙-行", "王"), ("丙-楷", "颜")):
            z.writestr(f"Top/{category}/{char}.png", png())
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    styles = spark.createDataFrame(
        [("甲-楷", "s1", "a1", "kaishu"), ("乙-行", "s2", "a2", "xingshu")],
        "category string, style_id string, author_id string, script_style string"
    )
    source = {"source_url": "https://example.test", "source_license": "l", "source_work_id": "w"}
    rows = J.imported(S.zip_members(spark, str(tmp_path / "a.zip")), styles, "0" * 64, source, "r", "2026-01-01")
    J.write_one_csv(rows.orderBy("style_id"), str(tmp_path / "m.csv"), J.IMPORT_COLUMNS)
    got = read(tmp_path / "m.csv")
    assert [r["style_id"] for r in got] == ["s1", "s2"] and got[0]["reference_id"].startswith("s1:6b27:") and got[0]["bbox_right"] == "256"
    registry = "styles:\n" + "".join(
        f"  - style_id: s{i}\n    enabled: true\n    author_id: a{i}\n    script_style: {s}\n" for i,
        s in ((1, "kaishu"), (2, "xingshu"))
    )
    (tmp_path / "reg.yaml").write_text(registry)
    report = J.validate(spark, str(tmp_path / "m.csv"), str(tmp_path / "reg.yaml"), str(tmp_path / "v.json"), require_approved=True)
    assert report["valid"] and report["num_approved"] == 2
    bad = spark.createDataFrame([("Top/甲-楷/欧.png", bytearray(png(8, 8)))], "member string, content binary")
    with pytest.raises(Exception, match="expected a 256x256"):
        J.imported(bad, styles, "", source, "r", "d").collect()


def test_catalogue_file(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "m.csv").write_text("reference_id,style_id,target_char,image_path,review_status\nr1,s,亮,p,approved\n", "utf-8")
    (tmp_path / "refs" / "i.json").write_text("{}")
    keys = {
        "course_id": "c", "display_name": "d", "style_id": "s", "manifest": "refs/m.csv", "cache_index": "refs/i.json",
        "source_dataset": "x", "source_license": "y", "status": "z", "enabled": "true", "scoring_label": "l"
    }
    (tmp_path / "configs" / "c.yaml").write_text("schema_version: 1\ncourses:\n  - " + "\n    ".join(f"{k}: {v}" for k, v in keys.items()) + "\n")
    assert J.catalog(spark, str(tmp_path / "configs" / "c.yaml"), str(tmp_path / "out.json")) == 1
    c = json.loads((tmp_path / "out.json").read_text("utf-8"))["courses"][0]
    assert c["cache_available"] and c["characters"] == [{"target_char": "亮", "reference_id": "r1", "reference_image_path": "p"}]
