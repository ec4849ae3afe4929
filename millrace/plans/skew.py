"""Joins of many rows to one row per group, where one group may be huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot when it owns more than 1/HOT_SHARE of all rows, so there are
#: never more than HOT_SHARE hot groups: the broadcast list of their keys is
#: bounded by this number, whatever the size of the data.
HOT_SHARE = 1000
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, key: str, weight: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (one row per ``key``) without a hot task.

    ``weight`` is the number of rows of a group; rows of hot groups are dealt
    over ``SALTS`` salts by ``spread`` and the (single) group row is repeated
    once per salt.  ``groups`` is read three times and ought to be staged.
    Null keys match nothing.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = groups.where(F.col(weight) > F.lit(max(1.0, total / HOT_SHARE))).select(key, F.lit(True).alias("_hot"))
    salted = groups.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    return dealt.drop("_hot").join(salted.drop("_hot"), [key, "_salt"], how).drop("_salt")
