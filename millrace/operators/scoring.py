"""Scores of the gate and of deduplication against ground-truth labels (the only place that reads them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_defect(kind: Column) -> Column:
    return F.coalesce(kind.startswith("junk_") | (kind == "pii"), F.lit(False))


def confusion(flagged: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall (1 on an empty denominator), f1 (0), 4 decimals."""
    hit = lambda t, p: F.coalesce(F.sum((t & p).cast("long")), F.lit(0))
    one = flagged.agg(hit(truth, predicted).alias("tp"), hit(~truth, predicted).alias("fp"), hit(truth, ~predicted).alias("fn"), hit(~truth, ~predicted).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / F.greatest(tp + fp, F.lit(1)))
    r = F.when(tp + fn == 0, F.lit(1.0)).otherwise(tp / F.greatest(tp + fn, F.lit(1)))
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.greatest(p + r, F.lit(1e-12)))
    return one.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def flag(df: DataFrame, ids: DataFrame, name: str = "removed", id_column: str = "id") -> DataFrame:
    """``df`` with a boolean: does its id stand in ``ids``."""
    marked = ids.select(F.col(id_column).alias(id_column)).where(F.col(id_column).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(marked, id_column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def by_kind(flagged: DataFrame, predicted: str, kind: str = "gt_kind") -> DataFrame:
    """(kind, rows, hits, rate) of the labelled rows."""
    rows = flagged.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("rows"), F.sum(F.col(predicted).cast("long")).alias("hits"))
    return rows.withColumn("rate", F.round(F.col("hits") / F.col("rows"), 4))


def dangling_labels(df: DataFrame, truth: str = "gt_dup_of", id_column: str = "id") -> DataFrame:
    """Rows labelled as copies of a record that is not there. Null ids match nothing."""
    ids = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_there")).distinct()
    return df.where(F.col(truth).isNotNull()).join(ids, F.col(truth) == F.col("_there"), "left_anti")


def unlabeled_exact_copies(flagged: DataFrame, predicted: str, text: str = "text", truth: str = "gt_dup_of") -> DataFrame:
    """One row: false positives that are exact copies of another row all the same."""
    counts = flagged.groupBy(F.col(text).alias("_t")).agg(F.count("*").alias("_n")).where("_n > 1")
    wrong = flagged.where(F.col(predicted) & F.col(truth).isNull())
    return wrong.join(counts, F.col(text).eqNullSafe(F.col("_t")), "left_semi").agg(F.count("*").alias("fp_unlabeled_exact"))
