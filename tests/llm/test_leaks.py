import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from maskframe.llm import leaks as K


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=60))
def test_myers_is_the_edit_distance(p, t):
    assert K.myers(p, t) == distance(p, t)


RNG = random.Random(3)
ITEM = "".join(RNG.choice(string.ascii_lowercase) for _ in range(200))
NOISE = ["".join(RNG.choice(string.ascii_uppercase + string.digits) for _ in range(60)) for _ in range(2)]
PIECES = K.Pieces([(1, ITEM), (2, "too short")])


def holds(passage):
    return PIECES.leaks(NOISE[0] + passage + NOISE[1]) == [1]


def wrong(text, *at):
    return "".join("0" if i in at else c for i, c in enumerate(text))


def test_lengths():
    for start in (0, 77, 155):
        assert holds(ITEM[start : start + 45])
        assert not holds(ITEM[start : start + 44])


def test_slips():
    p = ITEM[50:96]
    assert holds(wrong(p, 20)) and holds(wrong(p, 14, 30)) and holds(wrong(ITEM[50:100], 10, 23, 36))
    assert holds(p[:20] + p[21:]) and holds(p[:20] + "0" + p[20:])
    assert not holds(wrong(p, 20, 26)) and not holds(wrong(p, 15, 16)) and not holds(wrong(ITEM[50:96], 12, 20, 30))
    assert holds(wrong(ITEM[50:150], *range(12, 100, 13)))
    assert not holds(wrong(ITEM[50:150], *range(11, 100, 12)))


def test_every_single_slip_in_a_long_passage():
    for i in range(3, 57):
        p = ITEM[20:80]
        assert holds(wrong(p, i)) and holds(p[:i] + p[i + 1 :]) and holds(p[:i] + "9" + p[i:])


def test_markup_case_width():
    p = ITEM[30:80]
    dressed = "**" + "\n> ".join(p[i : i + 9].upper() for i in range(0, 50, 9)) + "_"
    full = "".join(chr(ord(c) + 0xFEE0) for c in p)
    assert holds(dressed) and holds(full)


def test_table(spark):
    docs = spark.createDataFrame(
        [(1, "x" * 200_000 + ITEM[:60], "c"), (1, ITEM, "c"), (2, None, "c"), (3, "", "c"), (4, ITEM[:30], "c")],
        "doc_id long, text string, d string"
    )
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, ITEM[100:])], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in K.find_leaks(docs, items).collect())
    assert got == [(1, 7), (1, 7), (1, 10)]
    assert K.find_leaks(docs.limit(0), items).collect() == [] and K.find_leaks(docs, items.limit(0)).collect() == []


def test_four_slips_in_one_passage():
    p = ITEM[50:95]
    assert K.BUDGET == 4 and holds(wrong(p, 3, 16, 29, 42))
    assert not holds(wrong(p, 3, 15, 28, 41))


def test_distance_decides(monkeypatch):
    p = wrong(ITEM[50:95], 20)
    assert holds(p)
    monkeypatch.setattr(K, "myers", lambda a, b: 0)
    assert not holds(p) and holds(ITEM[50:95])
    monkeypatch.setattr(K, "myers", lambda a, b: K.BUDGET + 1)
    assert not holds(ITEM[50:95])


def brute(item, doc):
    """Every window and every alignment of it with slips ``APART`` apart, by plain recursion."""

    def go(i, j, end, since, slips):
        if i == end:
            return since > 0
        ok = i < len(item) and j < len(doc) and item[i] == doc[j] and go(i + 1, j + 1, end, since + 1, slips)
        if ok or (slips and since < K.APART) or not since:
            return ok
        return any(i + di <= end and go(i + di, j + dj, end, 0, slips + 1) for di, dj in K.SLIPS)

    return any(go(s, j, s + K.LETTERS, 0, 0) for s in range(len(item) - K.LETTERS + 1) for j in range(len(doc)))


def test_random_damage_against_brute_force():
    rng = random.Random(11)
    item = "ab"
    while len(item) < 150:  # without double letters, so that a missing one has one place only
        item += rng.choice([c for c in string.ascii_lowercase if c != item[-1]])
    pieces, agree = K.Pieces([(1, item)]), 0
    for _ in range(150):
        at = rng.randint(0, 85)
        p, k = list(item[at : at + rng.randint(44, 60)]), 0
        while k < len(p):
            k += rng.choice([11, 12, 13, 14, 25, 40])
            if k < len(p):
                p[k : k + 1] = rng.choice(([], ["0"], [p[k], "0"]))
        text = "".join(p)
        want = brute(item, text + "X" * 3)
        agree += want
        assert (pieces.leaks(NOISE[0] + text + NOISE[1]) == [1]) == want, text
    assert 20 < agree < 140


def test_groups_of_items(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, ITEM[::-1]), (3, "y" * 100)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM[:100]), (8, ITEM[100:]), (9, ITEM[::-1])], "item_id long, text string")
    want = {(1, 7), (1, 8), (2, 9)}
    for letters in (50, 150, 10_000):
        assert {tuple(r) for r in K.find_leaks(docs, items, group_letters=letters).collect()} == want
