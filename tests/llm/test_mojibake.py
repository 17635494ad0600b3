from collections import Counter

import pytest
from maskframe.llm import mojibake as M

CORRECT = [
    "复核员青竹", "横竖交叉多，中段偏重", "第42轮：竖弯边缘发虚", "naïf07", "Jürgen_b", "größer schreiben", "획이 얇다", "штрих тонкий, проверить",
    "払いが短い。再確認", "這裏是捺還是提", "😀 写得好", "①②两处交叉 → 重拍", "offset ±5 µm", "plain", "don’t keep: base “well placed”",
    "ligne n° 4 : épaissir", "✓ □■ ★"
]
WRONG = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("gbk", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"),
    ("utf-8", "gb18030"), ("gbk", "cp949"), ("gbk", "big5")
]


@pytest.fixture(scope="module")
def logp():
    return M.Likelihood(Counter("".join(CORRECT * 50)))


@pytest.mark.parametrize("true, read", WRONG)
def test_round_trip(logp, true, read):
    done = 0
    for text in CORRECT:
        try:
            garbled = text.encode(true).decode(read)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if garbled == text or text.isascii():
            continue
        got = M.repair(garbled, logp)
        if true == "gbk" and text.isascii() is False and sum(ord(c) > 0x2FFF for c in text) < 3:
            continue  # a few symbols in GBK are chance pairs
        assert got is not None, (text, garbled)
        assert got[0] == text, (text, garbled, got)
        done += 1
    assert done


def test_twice_and_in_part(logp):
    twice = "复核员".encode().decode("latin-1").encode().decode("cp1252", "ignore")
    assert M.repair("é".encode().decode("cp1252").encode().decode("cp1252"), logp)[0] == "é"
    assert M.repair(twice, logp) is not None
    assert M.repair("第42轮：" + "竖弯边缘发虚".encode().decode("cp1252", "replace").replace("�", "�"), logp) is not None
    half = "横竖交叉多，" + "中段偏重".encode().decode("gb18030")
    assert M.repair(half, logp)[0] == "横竖交叉多，中段偏重"


def test_lost_bytes(logp):
    assert M.repair("Zo�-02", logp) == (None, "lost")
    assert M.repair("����".encode().decode("gb18030"), logp)[1].endswith("lost")  # the well-known three characters
    assert M.repair("don\x92t", logp)[0] == "don’t"


@pytest.mark.parametrize("text", [*CORRECT, "", None, "a" * 100_000, "联通", "É»", "Ü", "가로획 다시 확인", "Österreich über größe", "в…”", "鈎畫太長、頓筆過重"])
def test_correct_text_is_left_alone(logp, text):
    assert M.repair(text, logp) is None
    assert M.repair(text, M.Likelihood(Counter(text or "x"))) is None


def test_very_long(logp):
    text = "横竖交叉多，中段偏重" * 3000
    assert M.repair(text.encode().decode("gb18030"), logp)[0] == text


def test_table(spark):
    rows = [
        (1, "复核员青竹", None), (2, "复核员青竹".encode().decode("latin-1"), ""), (2, "复核员青竹".encode().decode("latin-1"), ""),
        (3, None, "naÃ¯f07"), (4, "x", "y")
    ] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows], "review_id long, notes string, reviewer string, original string")
    got = Counter((r.review_id, r.field_name, r.restored) for r in M.find_garbled(df, "review_id", ["notes", "reviewer"]).collect())
    assert got == {(2, "notes", "复核员青竹"): 6, (3, "reviewer", "naïf07"): 3}
    assert M.find_garbled(df.limit(0), "review_id", ["notes", "reviewer"]).collect() == []


NAMES = ["质检三组", "复核员青竹", "夜班乙组", "标注甲", "晨读班", "Jürgen_b", "señal3", "qa01"]


@pytest.mark.parametrize(
    "text, true, read",
    [("标注甲", "gbk", "cp949"), ("夜班乙组", "gbk", "big5"), ("Jürgen_b", "utf-8", "cp1252"), ("标注甲", "gbk", "latin-1"), ("质检三组", "utf-8", "latin-1")]
)
def test_garbled_value_on_a_third_of_the_rows(spark, text, true, read):
    garbled = text.encode(true).decode(read)
    rows = [(i, f"{CORRECT[i % len(CORRECT)]} {i % 50}", garbled if i % 3 == 0 else NAMES[i % len(NAMES)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "review_id long, notes string, reviewer string")
    got = {(r.review_id, r.field_name, r.restored) for r in M.find_garbled(df, "review_id", ["notes", "reviewer"]).collect()}
    assert got == {(i, "reviewer", text) for i in range(0, 3000, 3)}


@pytest.mark.parametrize("text, chance", [("①②两处交叉，③处断开 → 重拍", "ㄧㄨ两处交叉，ㄩ处断开 ℃ 重拍"), ("штрих тонкий, проверить", "轻芹琴清ихонкйпвет")])
def test_correct_value_copied_often_is_left_alone(text, chance):
    every = M.Likelihood(Counter(text * 700) + Counter(chance * 3000))
    assert M.repair(text, every.without(text, 699)) is not None  # alone it would pass for garbled
    assert M.judge(text, 700, every, M.Likelihood(Counter(text) + Counter(chance * 500))) is None


def test_garbled_part_and_values_that_share_characters():
    good = Counter("".join(CORRECT * 500))
    half = "横竖交叉多，" + "中段偏重".encode("gbk").decode("cp949")
    names = [t.encode().decode("cp1252") for t in ("Jürgen_b", "größer schreiben, über")]
    every = M.Likelihood(good + Counter(half * 5000) + Counter(names[0] * 5000) + Counter(names[1]))
    distinct = M.Likelihood(Counter("".join(CORRECT * 5)) + Counter(half + names[0] + names[1]))
    assert M.judge(half, 5000, every, distinct)[0] == "横竖交叉多，中段偏重"
    assert [M.judge(t, n, every, distinct)[0] for t, n in zip(names, (5000, 1))] == ["Jürgen_b", "größer schreiben, über"]


FOREIGN = ["획이 얇다", "가로획 다시 확인", "払いが短い。再確認", "失いが多い", "штрих тонкий, проверить", "кисть слишком сухая"]
READ_WRONG = [
    ("euc_kr", "latin-1"), ("euc_jp", "latin-1"), ("shift_jis", "latin-1"), ("cp1251", "latin-1"), ("utf-8", "cp866"),
    ("euc_kr", "gb18030"), ("shift_jis", "gb18030")
]


@pytest.mark.parametrize("true, read", READ_WRONG)
def test_other_encodings_are_restored_or_left_open(true, read):
    """In a Chinese column, text of other languages read wrongly comes back right or not at all, never as other text."""
    every = M.Likelihood(Counter("".join(CORRECT * 50)))
    tried = 0
    for text in FOREIGN:
        try:
            garbled = text.encode(true).decode(read)
        except UnicodeError:
            continue
        got = M.judge(garbled, 1, every, every)
        if got is not None:
            restored, how = M.settle(garbled, *got, every)
            assert restored in (None, text), (text, garbled, restored, how)
            tried += 1
    assert tried or read == "gb18030"


def test_known_rival_is_taken():
    counts = M.Likelihood(Counter("획이 얇다 가로획 다시 확인 세로획도 확인" * 50))
    garbled = "가로획 다시 확인".encode("euc_kr").decode("latin-1")
    got = M.judge(garbled, 1, counts, counts)
    assert M.settle(garbled, *got, counts)[0] == "가로획 다시 확인"
