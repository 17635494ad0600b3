import random
from collections import Counter, defaultdict

from maskframe.llm import splits as S
from pyspark.sql import functions as F

SCHEMA = "review_id long, char_id string, sample_index string, split string, component string, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def key(v):
    v = (v or "").strip().translate(str.maketrans("０１２３４５６７８９", "0123456789"))
    v = v.removesuffix(".0")
    return str(int(v)) if v.isdigit() else None


def brute(rows):
    parent: dict = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for rid, c, s, _ in rows:
        a, b = ("c", key(c)) if key(c) else ("r", rid), ("s", key(s)) if key(s) else ("r", rid)
        parent[find(a)] = find(b)
    sets = defaultdict(list)
    for rid, c, s, sp in rows:
        sets[find(("c", key(c)) if key(c) else ("s", key(s)) if key(s) else ("r", rid))].append((rid, (sp or "").strip().lower()))
    return list(sets.values())


def rows_of(seed, n=300, chars=60, sheets=120):
    rng = random.Random(seed)
    spell = [str, lambda v: f" {v} ", lambda v: f"{v}.0", lambda v: f"00{v}", lambda v: str(v).translate(str.maketrans("0123456789", "０１２３４５６７８９"))]
    out = []
    for i in range(n):
        c = rng.choice(["", None]) if rng.random() < 0.1 else rng.choice(spell)(0 if rng.random() < 0.1 else rng.randrange(chars))
        s = rng.choice([" ", None]) if rng.random() < 0.3 else rng.choice(spell)(rng.randrange(sheets))
        out.append((i, c, s, rng.choice(["train", " Train", "val", "", None]) if rng.random() < 0.2 else "train"))
    return out


def test_components_and_torn_rows_against_union_find(spark):
    for seed, n in ((1, 300), (2, 90)):
        rows = rows_of(seed, n)
        want = {frozenset(r for r, _ in s) for s in brute(rows)}
        got = defaultdict(set)
        for r in S.related_sets(frame(spark, rows), "review_id", ["char_id", "sample_index"]).collect():
            got[r.component].add(r.review_id)
        assert {frozenset(s) for s in got.values()} == want
        torn = sorted(r for s in brute(rows) if len({x for _, x in s if x}) > 1 for r, _ in s)
        assert sorted(r.review_id for r in S.torn_rows(frame(spark, rows), "review_id", ["char_id", "sample_index"], "split").collect()) == torn


def test_long_path_contracts(spark):
    rows = [(i, str(i // 2 + i % 2), str(i // 2), "val" if i == 199 else "train") for i in range(200)]
    assert S.torn_rows(frame(spark, rows), "review_id", ["char_id", "sample_index"], "split").count() == 200


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, None, " ", "train"), (1, None, " ", "val"), (2, "7", None, "train"), (2, "7.0", None, "val"), (3, "x", "y", "train")]
    got = [r.review_id for r in S.torn_rows(frame(spark, rows), "review_id", ["char_id", "sample_index"], "split").collect()]
    assert sorted(got) == [2, 2]
    assert S.torn_rows(frame(spark, []), "review_id", ["char_id", "sample_index"], "split").collect() == []
    assert S.related_sets(frame(spark, []), "review_id", ["char_id", "sample_index"]).collect() == []


def test_assignment_keeps_sets_whole_and_shares_near(spark):
    rows = [(i, str(i // 3), None, "train") for i in range(3000)] + [(9000 + i, "big", str(99999), "train") for i in range(300)]
    out = S.assign_splits(
        S.related_sets(frame(spark, rows), "review_id", ["char_id", "sample_index"]), "review_id",
        {"train": 0.7, "val": 0.15, "test": 0.15}
    ).collect()
    assert len(out) == len(rows)
    per = defaultdict(set)
    for r in out:
        per[r.component].add(r.split)
    assert all(len(s) == 1 for s in per.values())
    n = Counter(r.split for r in out)
    assert abs(n["train"] / len(rows) - 0.7) < 0.01 and abs(n["val"] / len(rows) - 0.15) < 0.01


def test_number_key(spark):
    rows = [("7",), (" ７.0 ",), ("007",), ("-0",), ("1" * 40,), ("7.5",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(S.number_key(F.col("v"))).collect()]
    assert got == ["7", "7", "7", "0", "1" * 40, None, None, None]


def test_keys_of_any_spelling_and_length(spark):
    big, bigger = "9" * 30, "1" + "0" * 40
    rows = [
        (1, "7", "a", "train", None), (2, " 007.0", "x", "val", None), (3, "７", big, "train", None),
        (4, "8", "0" * 5 + big, "test", None), (5, bigger, "5", "val", None), (6, bigger, "6", "val", None),
        (7, "7.5", None, "val", None), (8, str(2**62), "61", "train", None), (9, "+" + str(2**62), "62", "test", None)
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)
    sets = {}
    for r in S.related_sets(df, "review_id", ["char_id", "sample_index"]).collect():
        sets.setdefault(r.component, set()).add(r.review_id)
    assert sorted(map(sorted, sets.values())) == [[1, 2, 3, 4], [5, 6], [7], [8, 9]]
    assert sorted(r.review_id for r in S.torn_rows(df, "review_id", ["char_id", "sample_index"], "split").collect()) == [1, 2, 3, 4, 8, 9]
