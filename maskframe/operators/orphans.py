"""References to records that do not exist, at a point in time or at any time.

A parent is present on half-open integer intervals (a plain integer key ``k`` is ``[k, k + 1)``; a dated
record is its life in microseconds under its text key). Intervals are compressed to contiguous runs; each
reference is matched as of its own integer to the preceding run start and is an orphan when it lies beyond
that run's end. Parents and references of a key meet in one sorted pass: runs grow while it goes, and every
reference sees the run that started last.

A key may hold a large part of all rows. Rows are counted by hash buckets of their keys (not at all where all
rows together are few), and keys of heavy buckets go another way to the same result: they are grouped by (key,
block), a block being ``block`` consecutive integers. What reaches into a block from earlier ones is one number,
the furthest end so far. Groups with more than ``salt_rows`` references are spread over salts, with the group's
runs repeated for each, so that no task ever holds a whole heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOREVER = 2**63 - 1
#: About 25 days in microseconds.
DATED_BLOCK = 2**41
#: Hash buckets in which rows are counted, and the rows a bucket has to exceed, besides four times the mean, to be heavy.
BUCKETS, HEAVY_ROWS = 65536, 1_000_000


def compress_runs(parents: DataFrame, by: list[str], start: str = "start", end: str = "end", block: int = DATED_BLOCK) -> DataFrame:
    """Contiguous runs of half-open intervals.

    Returns ``by``, ``block``, ``run_start``, ``run_end``: the runs that start in each block. Intervals that
    overlap or touch within a block become one run; a run may reach beyond its block. Rows with a null key
    or start, and empty intervals (``end <= start``), are no parents. A null end means without end.
    Repeated rows change nothing.
    """
    p = parents.select(*by, F.col(start).cast("bigint").alias("_s"), F.coalesce(F.col(end).cast("bigint"), F.lit(FOREVER)).alias("_e"))
    p = p.where(F.col("_s") < F.col("_e")).dropna(subset=by)
    p = p.withColumn("block", F.floor(F.col("_s") / F.lit(block)).cast("bigint")).groupBy(*by, "block", "_s").agg(F.max("_e").alias("_e"))
    w = Window.partitionBy(*by, "block").orderBy("_s")
    before = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("_s") > before), 1).otherwise(0)
    p = p.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    return p.groupBy(*by, "block", "_run").agg(F.min("_s").alias("run_start"), F.max("_e").alias("run_end")).drop("_run")


def heavy_orphans(
    refs: DataFrame, runs: DataFrame, by: list[str], at: str, row: Column, block: int = DATED_BLOCK, salt_rows: int = 1_000_000
) -> DataFrame:
    """Rows of ``refs`` whose key is in no run at the integer ``at``.

    ``runs`` comes from :func:`compress_runs` with the same ``by`` and ``block``; ``row`` is any expression
    that spreads the rows of one key. References with a null key are blank and never orphans. A null ``at``
    is compared with the state after all changes. Rows come out with their columns unchanged, as often as
    they came in; with no parents every reference is an orphan.
    """
    cols = refs.columns
    r = refs.dropna(subset=by).select(
        F.struct(*cols).alias("_row"), *by, F.coalesce(F.col(at).cast("bigint"), F.lit(FOREVER - 1)).alias("_at"),
        row.alias("_spread")
    )
    r = r.withColumn("block", F.floor(F.col("_at") / F.lit(block)).cast("bigint"))
    none = F.lit(None).cast("bigint")
    groups = (
        r.groupBy(*by, "block").agg(F.count("*").alias("_refs")).select(
            *by, "block", "_refs", none.alias("_top"), F.lit(0).cast("bigint").alias("_runs")
        )
        .unionByName(runs.groupBy(*by, "block").agg(
            F.max("run_end").alias("_top"), F.count("*").alias("_runs")
        ).withColumn("_refs", F.lit(0).cast("bigint")))
        .groupBy(*by, "block").agg(F.sum("_refs").alias("_refs"), F.max("_top").alias("_top"), F.sum("_runs").alias("_runs"))
    )
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_carry", F.max("_top").over(earlier)).where("_refs > 0")
    groups = groups.select(*by, "block", "_carry", "_runs", F.ceil(F.col("_refs") / F.lit(salt_rows)).cast("int").alias("_salts"))
    # What earlier blocks cover is settled here; the skew join of adaptive execution splits a hot key's rows.
    r = r.join(groups, [*by, "block"]).where(F.col("_carry").isNull() | (F.col("_carry") <= F.col("_at")))
    settled = r.where("_runs = 0").select("_row.*")
    open_ = r.where("_runs > 0").select(
        *by, "block", F.pmod(F.xxhash64("_spread"), F.col("_salts")).cast("int").alias("_salt"), "_at", F.lit(1).alias("_kind"),
        none.alias("_end"), "_row"
    )
    spread = runs.join(groups.where("_runs > 0").select(*by, "block", "_salts"), [*by, "block"])
    spread = spread.select(
        *by, "block", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("run_start").alias("_at"),
        F.lit(0).alias("_kind"), F.col("run_end").alias("_end"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row")
    )
    order = Window.partitionBy(*by, "block", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = open_.unionByName(spread).withColumn("_end", F.last("_end", ignorenulls=True).over(order))
    late = matched.where((F.col("_kind") == 1) & (F.col("_end").isNull() | (F.col("_end") <= F.col("_at")))).select("_row.*")
    return settled.unionByName(late).select(*cols)


def _light_orphans(refs: DataFrame, lives: DataFrame, by: list[str], at: str) -> DataFrame:
    """As :func:`heavy_orphans`, in one exchange and one sort: parents and references of a key in the order of time."""
    cols, none = refs.columns, F.lit(None).cast("bigint")
    r = refs.dropna(subset=by).select(
        *by, F.coalesce(F.col(at).cast("bigint"), F.lit(FOREVER - 1)).alias("_at"), F.lit(1).alias("_kind"), none.alias("_end"),
        F.struct(*cols).alias("_row")
    )
    p = lives.select(
        *by, F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_kind"),
        F.coalesce(F.col("end").cast("bigint"), F.lit(FOREVER)).alias("_end"),
        F.lit(None).cast(r.schema["_row"].dataType).alias("_row")
    )
    p = p.where(F.col("_at") < F.col("_end")).dropna(subset=by)
    w = Window.partitionBy(*by).orderBy("_at", "_kind", F.col("_end").desc())
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    u = r.unionByName(p).withColumn("_reach", reach)
    # A parent beyond the reach of all before starts a run; the run's end is the reach of its members.
    starts = F.when((F.col("_kind") == 0) & (F.col("_reach").isNull() | (F.col("_at") > F.col("_reach"))), F.col("_at"))
    u = u.withColumn("_start", F.last(starts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.where((F.col("_kind") == 1) & (F.col("_start").isNull() | (F.col("_reach") <= F.col("_at")))).select("_row.*").select(*cols)


def orphans(
    refs: DataFrame, lives: DataFrame, by: list[str], at: str, row: Column, block: int = DATED_BLOCK,
    heavy_rows: int = HEAVY_ROWS, salt_rows: int = 1_000_000
) -> DataFrame:
    """Rows of ``refs`` whose key is not present at the integer ``at``.

    ``lives`` has ``by``, ``start`` and ``end``: half-open intervals, a null end means without end, a null start or
    key and an empty interval are no parent. ``row`` is any expression that spreads the rows of one key.
    References with a null key are blank and never orphans. A null ``at`` is compared with the state after all
    changes. Rows come out with their columns unchanged, as often as they came in; without parents every reference
    is an orphan; repeated parents change nothing.
    """
    if refs.count() + lives.count() <= heavy_rows:  # row counts of the files: no key can be heavy
        return _light_orphans(refs, lives, by, at)
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    sizes = refs.select(bucket.alias("_b")).unionByName(lives.select(bucket.alias("_b"))).groupBy("_b").agg(F.count("*").alias("n"))
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n").alias("mean"))))  # one row
    heavy = [r[0] for r in sizes.where(F.col("n") > heavy_rows + 4 * F.col("mean")).select("_b").collect()]  # at most BUCKETS, in fact as many as there are heavy keys
    if not heavy:
        return _light_orphans(refs, lives, by, at)
    is_heavy = F.coalesce(bucket.isin(heavy), F.lit(False))
    light = _light_orphans(refs.where(~is_heavy), lives.where(~is_heavy), by, at)
    return light.unionByName(heavy_orphans(
        refs.where(is_heavy), compress_runs(lives.where(is_heavy), by, block=block), by, at, row, block, salt_rows
    ))


def orphan_integers(children: DataFrame, parents: DataFrame, key: str, parent_key: str, block: int = 2**20) -> DataFrame:
    """Rows of ``children`` whose integer ``key`` is not among ``parents``; sorted keys become contiguous runs.

    Keys are grouped by blocks of consecutive integers, which no key's interval crosses, and come down to one row
    for each key first, so that a key's copies do not meet in one task. Null keys are blank, and no parents.
    """
    group = lambda c: F.floor(F.col(c).cast("bigint") / F.lit(block)).cast("bigint").alias("_g")
    p = parents.where(F.col(parent_key).isNotNull()).select(
        group(parent_key), F.col(parent_key).cast("bigint").alias("start")
    ).distinct().withColumn("end", F.col("start") + 1)
    keys = children.where(F.col(key).isNotNull()).select(group(key), F.col(key).cast("bigint").alias("_key")).distinct()
    lost = orphans(keys, p, ["_g"], "_key", F.col("_key"), block).select("_key")
    return children.join(lost, children[key].cast("bigint") == F.col("_key"), "left_semi")


def orphan_report(refs: DataFrame, found: DataFrame, period: Column) -> DataFrame:
    """Per ``table_name``, ``field_name`` and ``period``: non-blank references, orphans among them, and their share."""
    all_ = refs.groupBy("table_name", "field_name", period.alias("period")).agg(F.count("*").alias("refs"))
    bad = found.groupBy("table_name", "field_name", period.alias("period")).agg(F.count("*").alias("orphans"))
    j = all_.join(bad, (all_.table_name == bad.table_name) & (all_.field_name == bad.field_name) & all_["period"].eqNullSafe(bad["period"]), "left")
    n = F.coalesce(bad["orphans"], F.lit(0))
    return j.select(
        all_["table_name"], all_["field_name"], all_["period"], all_["refs"], n.alias("orphans"),
        F.round(n / all_["refs"], 6).alias("orphan_share")
    )
