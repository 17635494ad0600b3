from collections import Counter

from maskframe.llm import varied as V

SCHEMA = "review_id long, char_id string, a string, b string, note string, pick_rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_covers_and_is_not_filled_by_the_large_group(spark):
    rows = [(i, "7", "1", "0", f"n{i}") for i in range(1000)] + [(
        2000 + i, str(i % 40 + 100), str(i % 2), "" if i % 3 else "1", f"m{i}"
    ) for i in range(200)]
    got = V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], 60, ["char_id", "a", "b", "note"]).collect()
    assert len(got) == 60 and len({r.review_id for r in got}) == 60
    assert len({r.char_id for r in got}) == 41 and {(r.a, r.b) for r in got} == {(a, b) for _, _, a, b, _ in rows}
    assert Counter(r.char_id for r in got)["7"] <= 2


def test_exact_round_robin_against_brute_force(spark):
    rows = [(i, str(i % 7), str(i % 2), "", f"n{i % 50}") for i in range(120)]
    for size in (5, 14, 33, 119, 120, 500):
        got = V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], size, ["char_id", "a", "b", "note"]).collect()
        assert len(got) == min(size, 120)
        counts = Counter((r.char_id, r.a) for r in got)
        n = Counter((c, a) for _, c, a, _, _ in rows)
        top = max(counts.values())
        assert all(counts[c] >= min(n[c], top - 1) for c in n)


def test_copies_come_last_nulls_ties_and_empty(spark):
    rows = [(i, "1", "0", "0", "same") for i in range(20)] + [(50, "1", "0", "0", "other"), (51, None, None, None, None), (52, " ", "", None, "z")]
    got = {r.review_id for r in V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], 4, ["char_id", "a", "b", "note"]).collect()}
    assert got == {0, 50, 51, 52}
    assert V.varied_subset(frame(spark, []), "review_id", "char_id", ["a", "b"], 4).collect() == []


def test_every_combination_before_further_characters(spark):
    rows = [(i, str(i), str(i % 3), str(i // 50 % 5 if i % 50 < 3 else 0), f"n{i}") for i in range(600)]
    combos = {(a, b) for _, _, a, b, _ in rows}
    assert len(combos) > 10
    got = V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], 30, ["char_id", "a", "b", "note"]).collect()
    assert {(r.a, r.b) for r in got} == combos and len({r.char_id for r in got}) == 30


def test_copies_only_after_all_distinct_records(spark):
    rows = [(i, "1", "0", "0", f"n{i // 2}") for i in range(40)] + [(100 + i, str(i + 10), "1", "0", "one") for i in range(10)]
    cols = ["char_id", "a", "b", "note"]
    got = V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], 30, cols).collect()
    assert len({(r.char_id, r.note) for r in got}) == 30
    more = V.varied_subset(frame(spark, rows), "review_id", "char_id", ["a", "b"], 33, cols).collect()
    assert len({(r.char_id, r.note) for r in more}) == 30 and len(more) == 33 and max(r.pick_rank for r in more) == 23
