"""A global row number without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskframe.plans.checkpoints import Cuts


def number_rows(df: DataFrame, order: list[Column], name: str, cuts: Cuts) -> tuple[DataFrame, int]:
    """``df`` with its 1-based position in ``order``, and the number of rows: range partitions are numbered each for itself and offset.

    ``order`` should be total; ties are numbered arbitrarily. The ranged rows are written once, since sampled
    range bounds may differ between two runs of a plan; ``df`` should hold the keys only.
    """
    ranged = cuts.cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offsets = sizes.select("_pid", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    numbered = ranged.join(F.broadcast(offsets), "_pid").withColumn(name, (F.col("_before") + here).cast("bigint")).drop("_pid", "_before")
    return numbered, ranged.count()


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """``df`` with its 1-based position in ``order``."""
    return number_rows(df, order, name, Cuts(df.sparkSession))[0]
