"""The pN queries, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import consolidate, encoding, format_dups, mixing, near_dups, packing, pii, stuffing
from millrace.llm.tokens import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.duplicate_members(_table(spark, sf_dir, "synth_records").select("id", "text"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.collapse(_table(spark, sf_dir, "synth_records").select("id", "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.NearDuplicates(_table(spark, sf_dir, "synth_records").select("id", "text"), exact=True).record_pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.NearDuplicates(_table(spark, sf_dir, "synth_records").select("id", "text"), exact=True).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pii.texts_of(_table(spark, sf_dir, "synth_records").select("id", "text"), _table(spark, sf_dir, "gate_results").select("gate_run_id", "reasons_histogram"))
    return pii.find_items(texts, _table(spark, sf_dir, "name_list"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pii.texts_of(_table(spark, sf_dir, "synth_records").select("id", "text"), _table(spark, sf_dir, "gate_results").select("gate_run_id", "reasons_histogram"))
    return pii.redact(texts, _table(spark, sf_dir, "name_list"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.components(consolidate.record_links(_table(spark, sf_dir, "match_pairs"), _table(spark, sf_dir, "duplicates")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(_table(spark, sf_dir, "synth_records").select("id", "text")).select("id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(_table(spark, sf_dir, "synth_records").select("id", "text"))


def p5_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.margins(_table(spark, sf_dir, "synth_records").select("id", "text"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, _table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packed(spark, sf_dir), _table(spark, sf_dir, "pack_specs"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.checked(p6_packed(spark, sf_dir), _table(spark, sf_dir, "pack_specs"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", keep=("source",))
    return mixing.mix(sizes, _table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mixed(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.checked(p7_mixed(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
