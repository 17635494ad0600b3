import numpy as np
import pytest
from maskframe.llm import quality as Q

PROSE = "We tried to change the brush after the second review, and the shape settled at once. It was hard to say why the old one had failed."
HAN = "新来的实习生提醒大家，月底汇总时的样本不要和新样本混在一起看。他们把旧作业翻出来对比，误差降了一截。"
OTHER = {
    "list": "\n".join(f"- item {i}" for i in range(30)),
    "numbered": "\n".join(f"{i}. redraw the skeleton" for i in range(1, 30)),
    "csv": "\n".join(f"{i}/40,line width,0.{i},yes" for i in range(10, 40)),
    "pipes": "\n".join(f"| {i} | yes |  | 0.{i} |" for i in range(30)),
    "menu": "Home | About | Share | Home | More | Log in | Next",
    "hash": "cf8c60101c587f2ca70afb1033c57d8164854536241f3e566dd1a3178fc5bbb5\n" * 3,
    "again": HAN[:31] * 1 + ("\n" + HAN[:31]) * 20,
    "terms": "横画透写台交叉点卧钩底部平板笔外框横画钩尖捺脚兼毫墨迹端点误差",
}


def stats(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _t string")
    return {r.doc_id: r for r in Q.statistics(df).collect()}


def test_prose_share_tells_prose(spark):
    got = stats(spark, [PROSE, HAN, PROSE.replace(" the", "\nthe"), "> " + HAN, *OTHER.values()])
    assert all(got[i].prose_share > 0.7 for i in range(4))
    for i, k in enumerate(OTHER):
        assert got[i + 4].prose_share < 0.5, k


def test_values(spark):
    got = stats(spark, ["ab cde. 12", None, "", "   \n ", "x" * 300_000])
    assert (got[0].words, got[0].mean_word_length, got[0].digit_ratio, got[0].symbol_ratio) == (2.0, 2.5, 0.2, 0.1)
    for i in (1, 2, 3):
        assert got[i].words == 0 and got[i].prose_share == 0
    assert got[4].long_token_share == 1.0 and got[4].mean_word_length == 300_000


def test_rules_are_found_and_exported():
    rng = np.random.default_rng(1)
    x = rng.random((600, len(Q.STATS)))
    y = (x[:, 2] > 0.8) | ((x[:, 5] <= 0.3) & (x[:, 0] > 0.5))
    noisy = y ^ (rng.random(600) < 0.02)
    rules = Q.induce(x, noisy)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= Q._covers(r, x, Q.STATS)
    assert (hit == y).mean() > 0.95
    assert Q.rules_sql(rules).startswith("CASE WHEN ")
    assert len(rules) >= 2 and Q.held_out_f1(x, noisy) > 0.9
    assert Q.induce(x[:4], y[:4]) == [] and Q.held_out_f1(x[:0], y[:0]) is None


def test_held_out_accuracy_and_tables(spark):
    kinds = [(PROSE, "prose"), (HAN, "prose"), *[(t, "list") for t in OTHER.values()]]
    rows = [(i, f"{t} {'and so on ' * (i % 3)}" if k == "prose" else t, k) for i, (t, k) in enumerate(kinds * 12)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2] + [(99999, "list"), (1, None)], "doc_id long, kind string")
    got = {r.doc_id for r in Q.not_prose(docs, labels).collect()}
    assert sum((i in got) == (k != "prose") for i, _, k in rows) / len(rows) > 0.97
    report = Q.rule_report(docs, labels).collect()
    assert {r.origin for r in report} == {"learned"} and report[0].held_out_f1 > 0.9
    with pytest.warns(UserWarning, match="no rule"):
        assert Q.not_prose(docs, labels.limit(0)).count() > 0
    assert [r.origin for r in Q.rule_report(docs, labels.limit(0)).collect()] == ["default"]
    assert Q.not_prose(docs.limit(0), labels).count() == 0


OTHER_LANGUAGES = [
    "Der Pinsel wird mit der Hand geführt und nicht mit dem Arm. Es ist schwer, eine Linie zu ziehen, die sich nicht verliert.",
    "Le pinceau est tenu par la main et ne touche pas le papier. Il y a une ligne qui se perd dans les marges du texte.",
    "El pincel se lleva con la mano y no con el brazo. Es una línea que se pierde en los márgenes del papel.",
    "Кисть держат в руке, и линия не должна теряться на бумаге. Это трудно, но к этому можно привыкнуть.",
    "筆は手で持ち、腕で動かすのではない。線が紙の端で消えることもある。",
    "붓은 손으로 잡고 팔로 움직이지 않는다. 선이 종이의 끝에서 사라지는 것은 어렵다.",
]


def test_prose_of_other_languages(spark):
    got = stats(spark, OTHER_LANGUAGES)
    assert [t for i, t in enumerate(OTHER_LANGUAGES) if got[i].prose_share < 0.7] == []
