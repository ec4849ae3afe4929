"""Dense global ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.staging import stage


def dense_rank_ids(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its position from 0 in the total order of ``order`` (ties: any order, distinct positions).

    Rows are range-partitioned; counts per partition give each its first position.
    """
    ranged = stage(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # one row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    return ranged.withColumn("_local", local).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def record_id(rank: Column, prefix: str = "rec-", width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.lpad(rank.cast("string"), width, "0"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that stand in one of the two only."""
    return a.subtract(b).union(b.subtract(a))
