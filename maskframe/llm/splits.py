"""Splits that keep related records together, and sets that a present split tears apart.

Records are edges between the keys they carry; the connected components of the keys are the related sets.
Components come from random-mate contraction: in each round every vertex tosses a coin, each tail with a head
among its neighbours is collapsed into the least such head, and edges are renamed and deduplicated by joins,
until no edge is left. In the first round the second key's vertices are all tails and the first key's all
heads, which removes the second kind at once. Each round's moves are kept and unwound backwards to labels.
Rounds cut their lineage with tables in the shared folder; nothing is gathered to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.text import blank_to_null, strip
from maskframe.plans.checkpoints import Cuts

MAX_ROUNDS = 200
#: Rounds unwound one by one.
EARLY_ROUNDS = 3
#: Components with at least this share of all rows are placed first, the largest first.
HEAVY_SHARE = 0.01
BUCKETS = 1024


def number_key(c: Column) -> Column:
    """A whole number of any length in one spelling; null for anything else."""
    ascii_digits = F.translate(strip(c), "０１２３４５６７８９．＋－", "0123456789.+-")
    n = F.regexp_extract(ascii_digits, r"\A\+?(-?[0-9]+)(?:\.0*)?\z", 1)
    return F.when(n != "", F.regexp_replace(F.regexp_replace(n, r"\A(-?)0+(?=[0-9])", "$1"), r"\A-0\z", "0"))


def _coded(rows: DataFrame, keys: list[str], cuts: Cuts, *more: Column) -> DataFrame:
    """``_a``, ``_b`` and ``more``, written once: the two keys as exact whole numbers, ``2 * key + side``.

    A key that is too long for that is numbered among its like above all coded ones; its text is kept by join.
    """
    least, most = -(2**60), 2**60
    longs = F.lit(None).cast("string")
    coded, texts = [], []
    for side, k in enumerate(keys):
        n = F.col(k).try_cast("bigint")  # the common spelling needs no pattern
        slow = F.when(n.isNull(), number_key(F.col(k)))
        n = F.coalesce(n, slow.try_cast("bigint"))
        fits = n.between(least, most)
        coded.append(F.when(fits, n * 2 + side).alias(("_a", "_b")[side]))
        texts.append(F.when(F.coalesce(fits, F.lit(False)), longs).otherwise(F.coalesce(slow, n.cast("string"))).alias(f"_t{side}"))
    v = cuts.cut(rows.select(*more, *coded, *texts))
    if v.where("_t0 IS NOT NULL OR _t1 IS NOT NULL").isEmpty():
        return v.drop("_t0", "_t1")
    for side, c in enumerate(("_a", "_b")):
        names = v.select(F.col(f"_t{side}").alias("_t")).where("_t IS NOT NULL").distinct()
        names = cuts.cut(names.select("_t", ((F.monotonically_increasing_id() + F.lit(2**61)) * 2 + side).alias("_n")))
        v = v.join(names.withColumnRenamed("_t", f"_t{side}"), f"_t{side}", "left").withColumn(c, F.coalesce(c, "_n")).drop("_n", f"_t{side}")
    return cuts.cut(v)


def _moves(edges: DataFrame, k: int) -> DataFrame:
    """``t``, ``p``: each tail of round ``k`` that has heads among its neighbours, and the least of them."""
    head = lambda c: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 0
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where(~head("u") & head("v")).groupBy(F.col("u").alias("t")).agg(F.min("v").alias("p"))


def _contract(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with moved end points renamed; loops and repeats are gone. ``u < v``."""
    mu, mv = moves.toDF("u", "_pu"), moves.toDF("v", "_pv")
    e = edges.join(mu, "u", "left").join(mv, "v", "left").select(F.coalesce("_pu", "u").alias("a"), F.coalesce("_pv", "v").alias("b")).where("a <> b")
    return e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """``vertex``, ``component`` for every vertex that shares an edge with another one.

    ``pairs`` holds rows with two vertices; rows where either is null make no edge. A vertex without
    edges has no row: it is its own component. The component's name is one of its vertices.
    """
    e = pairs.select(F.col(first).alias("h"), F.col(second).alias("t")).where("h IS NOT NULL AND t IS NOT NULL AND h <> t").distinct()
    cuts = Cuts(pairs.sparkSession)
    cut = cuts.cut
    e = cut(e)

    def round_(edges: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Moves and contracted edges, written by one job; and the number of those edges."""
        left = _contract(edges, m).select(F.lit(1).alias("k"), F.col("u").alias("x"), F.col("v").alias("y"))
        both, n = cuts.counted(m.select(F.lit(0).alias("k"), F.col("t").alias("x"), F.col("p").alias("y")).unionByName(left), F.col("k") == 1)
        return both.where("k = 0").select(
            F.col("x").alias("t"), F.col("y").alias("p")
        ), both.where("k = 1").select(F.col("x").alias("u"), F.col("y").alias("v")), n

    first_moves, edges, n = round_(e.toDF("u", "v"), e.groupBy("t").agg(F.min("h").alias("p")))
    moves = [first_moves]
    for k in range(1, MAX_ROUNDS):
        if not n:
            break
        done, edges, n = round_(edges, _moves(edges, k))
        moves.append(done)
    else:
        raise RuntimeError("contraction did not end")
    # Later rounds hold few vertices: their moves, each vertex moving once, are followed by pointer doubling.
    k = min(EARLY_ROUNDS, len(moves) - 1)
    early, late = moves[:k], moves[k:]
    labels = cut(reduce(DataFrame.unionByName, late).toDF("vertex", "component"))
    for _ in range((len(late) - 1).bit_length()):
        ahead = labels.toDF("component", "_next")
        labels = cut(labels.join(ahead, "component", "left").select("vertex", F.coalesce("_next", "component").alias("component")))
    for step in reversed(early):
        later = labels.toDF("p", "component")
        named = step.join(later, "p", "left").select(F.col("t").alias("vertex"), F.coalesce("component", "p").alias("component"))
        labels = cut(labels.unionByName(named))  # sizes fall geometrically with the round, so all cuts together are linear
    cuts.drop_earlier()
    roots = labels.select(F.col("component").alias("vertex"), "component").distinct()
    return labels.unionByName(roots)


def related_sets(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """``row_id``, ``component`` for each row; two keys, whole numbers however written.

    A component is named by the code of one of its keys. A row without any key is a set of its own and named by
    its id. Repeated ids come out as often as they came in; an empty table gives no rows.
    """
    cuts = Cuts(rows.sparkSession)
    v = _coded(rows, keys, cuts, F.col(row_id))
    found = components(v, "_a", "_b")
    v = v.select(row_id, F.coalesce("_a", "_b").alias("anchor"))
    name = F.coalesce(F.coalesce("component", "anchor").cast("string"), F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    return v.join(found, v.anchor == found.vertex, "left").select(row_id, name.alias("component"))


def torn_rows(rows: DataFrame, row_id: str, keys: list[str], split: str) -> DataFrame:
    """``row_id`` of every row of each related set whose split takes more than one value.

    Split names compare trimmed and without case; blank ones are no value. Splits are first brought down to
    one row for each anchor and name, so a common key never meets in one task.
    """
    cuts = Cuts(rows.sparkSession)
    v = _coded(rows, keys, cuts, F.col(row_id), F.lower(blank_to_null(F.col(split))).alias("_s")).where("_a IS NOT NULL OR _b IS NOT NULL")
    found = components(v, "_a", "_b")
    v = v.withColumn("anchor", F.coalesce("_a", "_b"))
    seen = v.groupBy("anchor", "_s").agg(F.count("*").alias("_n"))
    seen = seen.join(found, seen.anchor == found.vertex, "left").select("anchor", F.coalesce("component", "anchor").alias("component"), "_s")
    torn = seen.where("_s IS NOT NULL").groupBy("component", "_s").agg(F.count("*").alias("_n")).groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    anchors = seen.join(torn, "component", "left_semi").select("anchor").distinct()
    return v.join(anchors, "anchor", "left_semi").select(row_id)


def assign_splits(sets: DataFrame, row_id: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """``row_id``, ``component``, ``split``: whole components by cumulative weight, near ``shares`` of the rows.

    Heavy components come first by size, so that they fall into the first split; the others follow in hash
    order. Cumulative weights are summed by bucket and then within buckets, never over one sorted whole.
    """
    size = sets.groupBy("component").agg(F.count("*").alias("w"))
    total = size.agg(F.sum("w").alias("all"))
    size = Cuts(sets.sparkSession).cut(size.crossJoin(F.broadcast(total)))  # one row: the grand total
    heavy = F.col("w") >= F.col("all") * HEAVY_SHARE
    key = F.xxhash64("component", F.lit(seed))
    size = size.withColumn("b", F.when(heavy, -1).otherwise(F.pmod(key, F.lit(BUCKETS)))).withColumn("o", F.when(heavy, -F.col("w")).otherwise(key))
    before = size.groupBy("b").agg(F.sum("w").alias("bw")).withColumn(
        "base", F.sum("bw").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    )  # at most BUCKETS + 1 rows
    inside = F.sum("w").over(Window.partitionBy("b").orderBy("o", "component").rowsBetween(Window.unboundedPreceding, 0))
    mid = (F.coalesce("base", F.lit(0)) + F.col("in") - F.col("w") / 2) / F.col("all")
    placed = size.withColumn("in", inside).join(F.broadcast(before.select("b", "base")), "b").withColumn("at", mid)
    names, upto = list(shares), 0.0
    split = F.lit(names[-1])
    bounds = []
    for n in names[:-1]:
        upto += shares[n] / sum(shares.values())
        bounds.append((n, upto))
    split = reduce(lambda acc, nb: F.when(F.col("at") < nb[1], nb[0]).otherwise(acc), reversed(bounds), split)
    return sets.join(placed.select("component", split.alias("split")), "component").select(row_id, "component", "split")
