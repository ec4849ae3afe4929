"""Duplicates hidden by formatting differences (problem 1).

Progressive partition refinement: records are first put into classes by cheap
invariants that no reformatting changes (number of letters and digits, counts
of a few letters and digits); only classes with several different ids are read
again and refined by the costly key, a SHA-256 of the canonical content.

Defined results: a null id is ignored; a null text is the empty text; repeated
rows of one id count once (if their texts differ, each text counts for the id); texts
with fewer than ``min_chars`` letters and digits are never duplicates; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.content import content, stripped
from millrace.plans.skew import join_groups
from millrace.plans.staging import stage

#: Letters and digits counted for the cheap class key.
_COUNTED = "etaoinrs17"

#: Up to so many class keys (8 bytes each) the class list is broadcast; beyond it is joined by a salted shuffle.
BROADCAST_CLASSES = 500_000


def _classed(records: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    long_enough = rows.where(F.length("text") >= min_chars).withColumn("chars", stripped(F.col("text")))
    counts = [F.length("chars") - F.length(F.replace(F.col("chars"), F.lit(c), F.lit(""))) for c in _COUNTED]
    return long_enough.where(F.length("chars") >= min_chars).select(
        "id", "text", F.xxhash64(F.length("chars"), *counts).alias("cls")
    )


def duplicate_members(records: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(keep_id, copy_id): each member of a set of equal content but the smallest id."""
    rows = _classed(records, id_col, text_col, min_chars)
    classes = stage(
        rows.groupBy("cls")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi")
        .select("cls", "n"),
        "p1-classes",
    )
    if classes.count() <= BROADCAST_CLASSES:
        several = rows.join(F.broadcast(classes.select("cls")), "cls", "left_semi")
    else:
        several = join_groups(rows, classes, "cls", "n", F.col("id"))
    keyed = stage(
        several.select(F.unhex(F.sha2(content(F.col("text")), 256)).alias("content"), "id").distinct(),
        "p1-keys",
    )
    sets = stage(
        keyed.groupBy("content").agg(F.min("id").alias("keep_id"), F.max("id").alias("hi"), F.count("*").alias("n")).where("keep_id < hi").drop("hi"),
        "p1-sets",
    )
    found = join_groups(keyed, sets, "content", "n", F.col("id"))
    return found.where("id > keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()


def collapse(records: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(keep_id, n_copies): one row per content with the number of its records."""
    members = stage(duplicate_members(records, id_col, text_col, min_chars), "p1-members")
    counted = members.groupBy("keep_id").agg((F.count("*") + 1).alias("n_copies"))
    ids = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("keep_id")).distinct()
    kept = ids.join(members.select(F.col("copy_id").alias("keep_id")), "keep_id", "left_anti")
    return kept.join(counted, "keep_id", "left").select("keep_id", F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
