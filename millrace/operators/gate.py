"""The promotion gate: passing rows to silver, failing rows with reasons to quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import GateConfig
from millrace.functions.text import word_count
from millrace.operators.rules import failed_rules


def annotate(df: DataFrame, cfg: GateConfig | None = None) -> DataFrame:
    """``df`` with ``_reasons``, the failed rules. One scan, no shuffle."""
    cfg = cfg or GateConfig()
    if cfg.text_column not in df.columns:
        raise ValueError(f"no text column {cfg.text_column!r} among {df.columns}")
    return df.withColumn("_reasons", failed_rules(F.col(cfg.text_column), cfg))


def promoted(annotated: DataFrame) -> DataFrame:
    return annotated.where(F.size("_reasons") == 0).drop("_reasons")


def quarantined(annotated: DataFrame) -> DataFrame:
    """Failing rows with ``reject_reasons``, joined by ``|`` in the order of the config."""
    return annotated.where(F.size("_reasons") > 0).withColumn("reject_reasons", F.array_join("_reasons", "|")).drop("_reasons")


def summary(annotated: DataFrame, cfg: GateConfig | None = None) -> DataFrame:
    """One row: counts, reject rate, rows with a repeated id (null ids are one value), verdict."""
    cfg = cfg or GateConfig()
    bad = F.size("_reasons") > 0
    key = F.col(cfg.id_column).cast("string")
    # Two steps, both with partial aggregation: per id, then overall.
    per_id = annotated.groupBy(key.alias("_id")).agg(F.count("*").alias("n"), F.sum(bad.cast("long")).alias("bad"))
    one = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("input_rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("quarantined_rows"),
        F.count("*").alias("_ids"),
    )
    rate = F.when(F.col("input_rows") == 0, F.lit(0.0)).otherwise(F.col("quarantined_rows") / F.col("input_rows"))
    return one.select(
        "input_rows",
        (F.col("input_rows") - F.col("quarantined_rows")).alias("promoted_rows"),
        "quarantined_rows",
        F.round(rate, 6).alias("reject_rate"),
        (F.col("input_rows") - F.col("_ids")).alias("duplicate_id_rows"),
        F.when(rate > cfg.max_reject_rate, F.lit("blocked")).otherwise(F.lit("promoted")).alias("verdict"),
    )


def reason_histogram(annotated: DataFrame) -> DataFrame:
    """Hits per rule; a row that fails two rules counts for both."""
    # The outer form: an inner explode would make the optimizer test the array, and so run the rules, twice.
    return annotated.select(F.explode_outer("_reasons").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("hits"))


def contract_violations(df: DataFrame, id_column: str = "id", text_column: str = "text", min_words: int = 5) -> DataFrame:
    """One row of violation counts of the silver contract (all 0: it holds)."""
    null = lambda c: F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(f"null_{c}")
    short = F.coalesce(F.sum((word_count(F.col(text_column)) < min_words).cast("long")), F.lit(0)).alias("short_text")
    others = [c for c in ("source", "timestamp") if c in df.columns]
    first = df.agg(null(id_column), null(text_column), short, *[null(c) for c in others])
    repeats = df.where(F.col(id_column).isNotNull()).groupBy(id_column).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated_ids"))
    return first.crossJoin(repeats)  # one row each


class ContractError(ValueError):
    """Rows break the contract of the silver layer."""


def assert_contract(df: DataFrame, id_column: str = "id", text_column: str = "text", min_words: int = 5) -> None:
    """Raises with the counts of all violations, if there are any."""
    broken = {k: v for k, v in contract_violations(df, id_column, text_column, min_words).first().asDict().items() if v}
    if broken:
        raise ContractError(f"silver contract broken: {', '.join(f'{k} {v}' for k, v in broken.items())}")


def exclude_quarantined(bronze: DataFrame, quarantine: DataFrame, id_column: str = "id") -> DataFrame:
    """Bronze rows whose id is not in quarantine."""
    return bronze.join(quarantine.select(id_column).distinct(), id_column, "left_anti")
