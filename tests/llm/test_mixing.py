import os

import pytest
from maskframe.llm import mixing as X

DOCS = "doc_id long, text string, lang string, source string, style_id string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"
pytestmark = pytest.mark.skipif(not os.path.exists(X.VOCABULARY), reason="no vocabulary file")


def run(spark, docs, targets):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    t = spark.createDataFrame(targets, TARGETS)
    mixed = X.mixture(d, t)
    rows = mixed.collect()
    return rows, {r.source: r for r in X.shares(mixed, t).collect()}


def texts(source, n, lang="en", first=0):
    return [(first + i, "some words about the brush and the ink " * (1 + i % 5), lang, source, None) for i in range(n)]


def test_shares_repeats_and_missing_sources(spark):
    docs = texts("Web-Crawl", 300) + texts(" web_crawl", 100, first=1000) + texts("diary", 30, "zh", 2000) + texts("unlisted", 50, first=3000) + [
        (5000, None, "en", "diary", None), (5001, "", None, "diary", None)
    ]
    targets = [("web_crawl", 0.5, 1), ("diary", 0.3, 4), ("nowhere", 0.2, 3)]
    rows, shares = run(spark, docs, targets)
    assert abs(shares["web_crawl"].actual_share - 0.625) < 0.01 and abs(shares["diary"].actual_share - 0.375) < 0.01
    assert shares["nowhere"].docs == 0
    assert all(r.repeats <= (1 if r.source == "web_crawl" else 4) for r in rows)
    assert not {r.doc_id for r in rows} & set(range(3000, 3050)) and not {5000, 5001} & {r.doc_id for r in rows}
    assert len({r.doc_id for r in rows}) == len(rows)


def test_blank_source_is_judged_by_its_features(spark):
    docs = texts("web", 200, "en") + texts("diary", 200, "zh", 1000) + texts(None, 40, "zh", 2000)
    rows, _ = run(spark, docs, [("web", 0.5, 1), ("diary", 0.5, 1)])
    assert {r.source for r in rows if r.doc_id >= 2000} == {"diary"}


def test_empty(spark):
    assert run(spark, [], [("web", 1.0, 1)])[0] == []
    assert run(spark, texts("web", 5), [])[0] == []


def test_token_counts_match_the_vocabulary(spark):
    tok = X.Tokenizer(spark, X.VOCABULARY)
    enc = tok.encoder()
    rows = [("横竖交叉多", ), ("plain words", ), ("", ), (None, ), ("x" * 50_000, )]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tok.count()("t")).collect()]
    assert got == [len(enc.encode_ordinary(t[0])) if t[0] else 0 for t in rows]


@pytest.mark.parametrize("wanted", [12, 44])
def test_dominant_source_against_one_document(spark, wanted):
    words = "some words about the brush and the ink "
    n = len(X.Tokenizer(spark, X.VOCABULARY).encoder().encode_ordinary(words))
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", f"'{words}' AS text", "'en' AS lang", "'web' AS source", "CAST(NULL AS STRING) AS style_id",
        "'clash' AS tokens"
    )
    long = spark.createDataFrame([(50_000, words * wanted, "zh", "diary", None, "clash")], DOCS)
    t = spark.createDataFrame([("web", 0.5, 1), ("diary", 0.5, 1)], TARGETS)
    shares = {r.source: r for r in X.shares(X.mixture(docs.unionByName(long), t), t).collect()}
    assert shares["diary"].docs == 1 and abs(shares["diary"].tokens_used - wanted * n) <= wanted
    assert abs(shares["web"].tokens_used - shares["diary"].tokens_used) <= n and shares["web"].most_repeats == 1


def mixed_texts(rng, kind, n, first, source):
    words = {"web": "click page site link news share online post", "diary": "brush ink stroke paper wrist slow water line"}
    pools = {k: v.split() for k, v in words.items()}
    common = "the and of a with this very today".split()
    out = []
    for i in range(n):
        own, other = (0.35, 0.15) if kind == "web" else (0.3, 0.2)
        text = " ".join(rng.choice(pools[kind] if (x := rng.random()) < own else pools["diary" if kind == "web" else "web"] if x < own + other else common) for _ in range(rng.randint(20, 60)))
        out.append((first + i, text, "en", source, None))
    return out


def test_blank_sources_need_a_real_fit(spark):
    """60 per cent of the documents have no source; memberships are soft, and several gradient steps are needed."""
    import random

    rng = random.Random(5)
    docs = mixed_texts(rng, "web", 300, 0, "web") + mixed_texts(rng, "diary", 100, 1000, "diary") + mixed_texts(rng, "web", 300, 2000, None) + mixed_texts(rng, "diary", 300, 3000, " ")
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOCS)
    t = spark.createDataFrame([("web", 0.6, 2), ("diary", 0.4, 3)], TARGETS)
    got = X.mix(d, t)
    rows = got.rows.collect()
    assert len(got.fit.steps) >= 2 and got.fit.errors[-1][got.fit.chosen] <= 1e-3
    assert got.accuracy > 0.7
    soft = [r for r in rows if r.doc_id >= 2000]
    assert sum(0.02 < r.p[0] < 0.98 for r in soft) > len(soft) / 4
    shares = {r.source: r for r in X.shares(got.rows, t).collect()}
    assert abs(shares["web"].expected_share - 0.6) < 0.005 and abs(shares["diary"].expected_share - 0.4) < 0.005
    true = sum(r.tokens * r.repeats for r in rows if r.doc_id < 1000 or 2000 <= r.doc_id < 3000) / sum(r.tokens * r.repeats for r in rows)
    assert abs(true - 0.6) < 0.04
    assert all(r.repeats <= 3 for r in rows) and len(rows) > 500


def test_start_is_moved_by_the_fit_for_named_sources_too(spark):
    docs = texts("web", 400) + texts("diary", 40, "zh", 2000)
    got = X.mix(spark.createDataFrame([(*x, "c") for x in docs], DOCS), spark.createDataFrame([("web", 0.5, 1), ("diary", 0.5, 2)], TARGETS))
    assert len(got.fit.steps) >= 1 and got.fit.errors[0].max() > 0.1 and got.fit.errors[-1][got.fit.chosen] <= X.TOLERANCE


def test_memberships_that_no_rate_can_tell_apart(spark):
    """All documents blank but two: the targets cannot be met; the closest mixture comes out."""
    docs = texts("web", 1, "en") + texts("diary", 1, "zh", 1000) + texts(None, 50, "en", 2000)
    got = X.mix(spark.createDataFrame([(*x, "c") for x in docs], DOCS), spark.createDataFrame([("web", 0.5, 1), ("diary", 0.5, 1)], TARGETS))
    assert all(r.repeats == 1 for r in got.rows.collect())
