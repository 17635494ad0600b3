import random

from maskframe.operators import orphans as O
from pyspark.sql import functions as F

REFS = "id long, k string, t long, block string, _row string"
LIVES = "k string, start long, end long, extra string"


def run(spark, refs, lives, block=8, salt_rows=3):
    r = spark.createDataFrame([(*x, "b", "r") for x in refs], REFS)
    p = spark.createDataFrame([(*x, "e") for x in lives], LIVES)
    both = []
    for heavy in (0, 1_000_000):  # every key of a filled bucket by blocks and salts; all in one pass
        found = O.orphans(r, p, ["k"], "t", F.col("id"), block, heavy, salt_rows)
        assert found.columns == r.columns  # clashing names come out unchanged
        both.append(sorted((x.id, x.k, x.t) for x in found.collect()))
    assert both[0] == both[1]
    whole = O.heavy_orphans(r, O.compress_runs(p, ["k"], block=block), ["k"], "t", F.col("id"), block, salt_rows)
    assert sorted((x.id, x.k, x.t) for x in whole.collect()) == both[0]
    return both[0]


def brute(refs, lives):
    def alive(k, t):
        t = 2**63 - 2 if t is None else t
        return any(a == k and s is not None and s <= t and (e is None or t < e) for a, s, e in lives)

    return sorted(x for x in refs if x[1] is not None and not alive(x[1], x[2]))


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    keys = ["a", "a", "a", "b", "c"]  # one hot key
    lives = [(rng.choice(keys), s := rng.randrange(-40, 60), rng.choice([None, s + rng.randrange(0, 30), s])) for _ in range(60)]
    lives = [x for x in lives if x[2] is not None or rng.random() < 0.1]
    refs = [(i, rng.choice([*keys, "d", None]), rng.randrange(-60, 100)) for i in range(400)]
    refs += refs[:5]  # repeated rows
    assert run(spark, refs, lives) == brute(refs, lives)


def test_heavy_key_beside_light_ones(spark):
    refs = [(i, "hot" if i % 2 else f"k{i % 90}", i % 50) for i in range(600)]
    lives = [("hot", 3 * i, 3 * i + 2) for i in range(20)] + [(f"k{i}", 0, i) for i in range(0, 90, 4)]
    r, p = spark.createDataFrame([(*x, "b", "r") for x in refs], REFS), spark.createDataFrame([(*x, "e") for x in lives], LIVES)
    got = O.orphans(r, p, ["k"], "t", F.col("id"), 8, 100, 30)
    assert sorted((x.id, x.k, x.t) for x in got.collect()) == brute(refs, lives)


def test_nulls_bounds_and_touching_runs(spark):
    lives = [("a", 0, 5), ("a", 5, 10), ("a", 0, 5), (None, 0, 9), ("b", None, 9), ("c", 3, 3), ("d", 100, None)]
    refs = [
        (1, "a", 0), (2, "a", 9), (3, "a", 10), (4, "a", -1), (5, None, 0), (6, "b", 1), (7, "c", 3), (8, "d", None),
        (9, "a", None), (10, "d", 10**15)
    ]
    assert [x[0] for x in run(spark, refs, lives)] == [3, 4, 6, 7, 9]
    p = spark.createDataFrame([(k, s, e) for k, s, e in lives], "k string, start long, end long")
    runs = {(r.k, r.run_start, r.run_end) for r in O.compress_runs(p, ["k"], block=1000).collect()}
    assert runs == {("a", 0, 10), ("d", 100, O.FOREVER)}


def test_empty_tables(spark):
    assert run(spark, [], [("a", 0, 1)]) == []
    assert run(spark, [(1, "a", 0)], []) == [(1, "a", 0)]


def test_integers(spark):
    parents = spark.createDataFrame([(i,) for i in [*range(0, 50), *range(60, 90), None, 70]], "id long")
    children = spark.createDataFrame([(i,) for i in [0, 49, 50, 59, 60, 89, 90, -1, None, 50]], "ref long")
    assert sorted(r.ref for r in O.orphan_integers(children, parents, "ref", "id", block=16).collect()) == [-1, 50, 50, 59, 90]


def test_report(spark):
    refs = spark.createDataFrame(
        [("t", "f", "2024-01"), ("t", "f", "2024-01"), ("t", "f", None), ("t", "g", "2024-02")],
        "table_name string, field_name string, m string"
    )
    found = refs.where("m = '2024-01'").limit(1).unionByName(refs.where("m IS NULL"))
    got = {(r.field_name, r.period): (r.refs, r.orphans, r.orphan_share) for r in O.orphan_report(refs, found, F.col("m")).collect()}
    assert got == {("f", "2024-01"): (2, 1, 0.5), ("f", None): (1, 1, 1.0), ("g", "2024-02"): (1, 0, 0.0)}
