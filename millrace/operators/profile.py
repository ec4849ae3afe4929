"""Distribution profiles of a dataset and their drift (population stability index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import LENGTH_EDGES, length_bin, word_count

EPSILON = 1e-4


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    """(source, rows, share); a null source is the value ``None``."""
    counts = df.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("None")).alias("source")).agg(F.count("*").alias("rows"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("rows").alias("_n")))).select("source", "rows", (F.col("rows") / F.col("_n")).alias("share"))


def length_distribution(df: DataFrame, text: str = "text") -> DataFrame:
    """(bin, rows, share) for every length bin; shares are 0 for an empty dataset."""
    counts = df.groupBy(length_bin(word_count(F.col(text))).alias("bin")).agg(F.count("*").alias("rows"))
    bins = df.sparkSession.range(len(LENGTH_EDGES)).select(F.col("id").cast("int").alias("bin"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_n"))
    rows = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    share = F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(rows / F.col("_n"))
    return bins.join(F.broadcast(counts), "bin", "left").crossJoin(F.broadcast(total)).select("bin", rows.alias("rows"), share.alias("share"))


def profile(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row: n_rows, source_dist (map), length_dist (array of 9 shares)."""
    sources = source_distribution(df, source).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "share")))).alias("source_dist"))
    lengths = length_distribution(df, text).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "share"))), lambda s: s["share"]).alias("length_dist"))
    return df.agg(F.count("*").alias("n_rows")).crossJoin(sources).crossJoin(lengths)  # one row each


def profile_of(df: DataFrame, text: str = "text", source: str = "source") -> dict:
    """The profile as a dict; there is none of an empty dataset."""
    row = profile(df, text, source).first().asDict()
    if not row["n_rows"]:
        raise ValueError("no rows to profile")
    return row


def _psi_term(actual: Column, expected: Column) -> Column:
    a, e = F.greatest(actual, F.lit(EPSILON)), F.greatest(expected, F.lit(EPSILON))
    return (a - e) * F.ln(a / e)


def psi(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, psi) over the union of keys; a missing share is 0, then clamped."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = expected.select(key, F.col("share").alias("_e")).join(actual.select(key, F.col("share").alias("_a")), key, "full_outer")
    return both.select(key, zero("_e").alias("expected"), zero("_a").alias("actual"), _psi_term(zero("_a"), zero("_e")).alias("psi"))


def verdict(value: Column) -> Column:
    return F.when(value < 0.1, F.lit("stable")).when(value <= 0.25, F.lit("moderate")).otherwise(F.lit("major"))


def drift_report(reference: DataFrame, current: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row: source_psi, length_psi (4 decimals) and the verdict of the larger, unrounded."""
    by_source = psi(source_distribution(reference, source), source_distribution(current, source), "source").agg(F.coalesce(F.sum("psi"), F.lit(0.0)).alias("s"))
    by_length = psi(length_distribution(reference, text), length_distribution(current, text), "bin").agg(F.coalesce(F.sum("psi"), F.lit(0.0)).alias("l"))
    return by_source.crossJoin(by_length).select(F.round("s", 4).alias("source_psi"), F.round("l", 4).alias("length_psi"), verdict(F.greatest("s", "l")).alias("verdict"))
