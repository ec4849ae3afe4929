"""Point-in-time joins, latest values, leakage guard and running rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import word_count
from millrace.plans.staging import stage


class LeakageError(ValueError):
    """A feature is younger than the row it was joined to."""


def asof_join(spine: DataFrame, features: DataFrame, entity: str, time: str, columns: list[str], view: str, tie: list[str] | None = None, f_entity: str | None = None, f_time: str | None = None) -> DataFrame:
    """Each spine row with the latest feature row of its entity at or before its time.

    Adds ``<view>__<column>`` and ``<view>__feature_ts``; unmatched rows, and
    rows with a null entity or time, get nulls; spine rows are never multiplied.
    Among features of one instant the first by ``tie`` wins.

    Both sides are united and range-partitioned by entity and time, so an entity
    of any size spreads over many partitions; each partition is read in one
    window, and the last feature of the partitions before it is carried over.
    Rows without entity or time go round all this.
    """
    f_entity, f_time = f_entity or entity, f_time or time
    if spine.schema[time].dataType != features.schema[f_time].dataType:
        raise ValueError("spine and feature times must have the same type")
    names = [f"{view}__{c}" for c in columns]
    clash = set(names) & set(spine.columns)
    if clash:
        raise ValueError(f"spine already has columns {sorted(clash)}")
    held = features.where(F.col(f_entity).isNotNull() & F.col(f_time).isNotNull())
    order = F.struct(*[F.col(c) for c in tie or columns])
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(f_time).alias(f"{view}__feature_ts"))
    f = held.groupBy(F.col(f_entity).alias("_e"), F.col(f_time).alias("_t")).agg(F.min_by(value, order).alias("_f"))
    f = f.select("_e", "_t", F.lit(0).alias("_spine"), "_f", F.lit(None).cast(spine.select(F.struct("*")).schema[0].dataType).alias("_s"))
    usable = F.col(entity).isNotNull() & F.col(time).isNotNull()
    s = spine.where(usable).select(F.col(entity).alias("_e"), F.col(time).alias("_t"), F.lit(1).alias("_spine"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), F.struct("*").alias("_s"))
    # The hash splits the rows of one instant, all of which follow its feature.
    ranged = f.union(s).repartitionByRange(F.col("_e"), F.col("_t"), F.col("_spine"), F.xxhash64("_s"))
    parted = stage(ranged.withColumn("_part", F.spark_partition_id()), "asof")
    ends = parted.groupBy("_part").agg(F.max_by(F.when(F.col("_f").isNotNull(), F.struct("_e", "_f")), F.when(F.col("_f").isNotNull(), F.struct("_e", "_t"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))  # one row per partition
    w = Window.partitionBy("_part", "_e").orderBy("_t", "_spine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = parted.withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_spine = 1").join(F.broadcast(carried), "_part", "left")
    found = found.withColumn("_f", F.coalesce("_f", F.when(F.col("_carried._e") == F.col("_e"), F.col("_carried._f"))))
    added = [*names, f"{view}__feature_ts"]
    rest = spine.where(~usable).select("*", *[F.lit(None).cast(f.schema["_f"].dataType[n].dataType).alias(n) for n in added])
    return found.select("_s.*", *[F.col(f"_f.{n}").alias(n) for n in added]).union(rest)


def latest(features: DataFrame, entity: str, time: str, tie: list[str]) -> DataFrame:
    """The youngest row of each entity; the first by ``tie`` among rows of one instant. Both steps aggregate before they shuffle."""
    rows = features.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    instants = rows.groupBy(F.col(entity).alias("_e"), F.col(time).alias("_t")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in features.columns]), F.struct(*tie)).alias("_r"))
    return instants.groupBy("_e").agg(F.max_by("_r", "_t").alias("_r")).select("_r.*")


def leakage(joined: DataFrame, time: str, view: str) -> DataFrame:
    """Rows whose feature is younger than they are."""
    return joined.where(F.col(f"{view}__feature_ts") > F.col(time))


def assert_no_leakage(joined: DataFrame, time: str, view: str) -> None:
    row = leakage(joined, time, view).limit(1).collect()
    if row:
        raise LeakageError(f"feature of {row[0][f'{view}__feature_ts']} joined to a row of {row[0][time]}")


def source_rollup(df: DataFrame, entity: str = "source", time: str = "timestamp", text: str = "text") -> DataFrame:
    """Running document count and mean words per entity; ties in time are ordered by words and stay distinct rows.

    Rows are range-partitioned by entity, time and words; a partition counts
    from the totals of the partitions before it, so no task holds an entity.
    """
    rows = df.select(F.col(entity).alias("source"), F.col(time).alias("timestamp"), word_count(F.col(text)).alias("_words"))
    keys = [F.col(c).asc_nulls_first() for c in ("source", "timestamp", "_words")]
    parted = stage(rows.repartitionByRange(*keys, F.rand(0)).withColumn("_part", F.spark_partition_id()), "rollup")
    totals = parted.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.sum("_words").alias("_w"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only entities that go on from one partition to the next have a start: at most one row per partition.
    starts = totals.select("source", "_part", F.sum("_n").over(before).alias("_n"), F.sum("_w").over(before).alias("_w")).where("_n is not null").withColumnRenamed("source", "_source")
    w = Window.partitionBy("source", "_part").orderBy("timestamp", "_words").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumn("_c", F.count("*").over(w)).withColumn("_s", F.sum("_words").over(w))
    joined = local.join(F.broadcast(starts.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    docs = F.col("_c") + F.coalesce("_n", F.lit(0))
    return joined.select("source", "timestamp", docs.alias("docs_so_far"), F.round((F.col("_s") + F.coalesce("_w", F.lit(0))) / docs, 3).alias("mean_words_so_far"))
