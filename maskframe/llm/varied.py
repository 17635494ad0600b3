"""A varied subset of given size: multi-attribute grid round-robin, in SQL expressions only.

Records are binned into cells by their attributes and ranked within each cell; the order is by rank, then by
cell, and the first ``size`` records are taken. Of the cells of one rank, one for each combination of the flags
comes first, then one for each value of the leading attribute that none of those brought, then the others, so
every combination has its turn before any value of the leading attribute has a second. Copies of a record are
no variety: they are ranked after all distinct records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.functions.text import blank_to_null
from maskframe.llm.splits import number_key
from maskframe.plans.checkpoints import Cuts


def last_rank(cells: DataFrame, size: int) -> int:
    """Least rank r with sum(min(n, r)) >= size over the cells' counts ``n``; from the histogram of the counts."""
    hist = cells.groupBy("n").agg(F.count("*").alias("c"))  # distinct counts: at most about sqrt(2 * rows)
    up, down = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("n", F.coalesce(F.sum(F.col("n") * F.col("c")).over(up), F.lit(0)).alias("below"), F.sum("c").over(down).alias("open"))
    need = F.ceil((F.lit(size) - F.col("below")) / F.col("open"))
    enough = F.when(F.col("below") + F.col("n") * F.col("open") >= size, F.col("n"))
    got = h.agg(F.min_by(need, enough).alias("r"), F.max("n").alias("top")).first()
    return max(1, int(got.r if got.r is not None else got.top or 1))


def _turns(cells: DataFrame, at) -> DataFrame:
    """Cells with ``_turn``: 0 for the head of a combination, else the place among the leading value's cells, heads first."""
    # A combination's head, by an aggregate: a common combination may have as many cells as there are leading values.
    heads = cells.groupBy("_combo").agg(F.min_by("_lead", F.struct(at, "_lead")).alias("_lead")).select("_lead", "_combo", F.lit(1).alias("_head"))
    c = cells.join(heads, ["_lead", "_combo"], "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_lead").orderBy(F.desc("_head"), at, "_combo"))  # at most one row for each combination
    return c.select("_lead", "_combo", F.when(F.col("_head") == 1, 0).otherwise(place).alias("_turn"))


def _ranked(rows: DataFrame, turns: DataFrame, row_id: str, size: int, upto: int, at, seed: int) -> DataFrame:
    """The first ``size`` of ``rows`` by rank within the cell, then cell."""
    within = Window.partitionBy("_lead", "_combo").orderBy(F.xxhash64(row_id, F.lit(seed)), row_id)
    # The bound on the rank reaches below the shuffle: tasks keep their best ranks of each cell only.
    r = rows.withColumn("pick_rank", F.row_number().over(within)).where(F.col("pick_rank") <= upto)
    return r.join(turns, ["_lead", "_combo"]).orderBy("pick_rank", "_turn", at, "_lead", "_combo").limit(size)


def varied_subset(
    rows: DataFrame, row_id: str, leading: str, flags: list[str], size: int, content: list[str] | None = None, seed: int = 0
) -> DataFrame:
    """``size`` rows of ``rows`` (all of them, if there are fewer) with ``pick_rank``, the rank within their cell.

    ``leading`` is read as a whole number however written, ``flags`` as trimmed text; null and blank are a
    value of their own. Rows equal in ``content``, which should include the attributes, are copies: only the one
    with the least id is ranked while distinct ones are left anywhere. Ties are broken by a hash of the id, so
    the same rows always give the same subset. Columns of ``rows`` come out unchanged, but for one already named
    ``pick_rank``. Ids must be unique. An empty table gives no rows.
    """
    content = content or [c for c in rows.columns if c != row_id]
    lead = F.coalesce(number_key(F.col(leading)), F.lit(""))
    combo = F.concat_ws("|", *[F.coalesce(blank_to_null(F.col(f)), F.lit("-")) for f in flags])
    same = F.struct(*[F.col(c).cast("string").alias(c) for c in content])
    keys = ["_lead", "_combo", "_h1", "_h2"]
    v = rows.select(row_id, lead.alias("_lead"), combo.alias("_combo"), F.xxhash64(same).alias("_h1"), F.xxhash64(F.lit(1), same).alias("_h2"))
    # One row for each distinct record, written once: cells, ranks and copies all follow from it.
    firsts = Cuts(rows.sparkSession).cut(v.groupBy(*keys).agg(F.min(row_id).alias(row_id), F.count("*").alias("_n")))
    cells = firsts.groupBy("_lead", "_combo").agg(F.count("*").alias("n"))
    distinct = firsts.count()
    at = F.xxhash64("_lead", "_combo", F.lit(seed))
    turns = _turns(cells, at)
    few = firsts.select(row_id, "_lead", "_combo")
    picked = _ranked(few, turns, row_id, size, last_rank(cells, size), at, seed).select(row_id, "pick_rank")
    if distinct < size:
        copies = v.join(
            firsts.where("_n > 1").withColumnRenamed(row_id, "_first"), keys
        ).where(F.col(row_id) != F.col("_first")).select(row_id, "_lead", "_combo")
        again = firsts.where("_n > 1").groupBy("_lead", "_combo").agg(F.sum(F.col("_n") - 1).alias("n"))
        more = _ranked(copies, turns, row_id, size - distinct, last_rank(again, size - distinct), at, seed)
        more = more.join(cells, ["_lead", "_combo"]).select(row_id, (F.col("pick_rank") + F.col("n")).cast("int").alias("pick_rank"))
        picked = picked.unionByName(more)
    return rows.drop("pick_rank").join(picked, row_id)
