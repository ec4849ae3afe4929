"""Connected components of large graphs in joins (large-star and small-star rounds, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.skew import join_groups
from millrace.plans.staging import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge between different nodes; root is the least of its component.

    Each round shuffles each edge a bounded number of times; the lists of hub
    nodes are salted.  Rounds grow with the logarithm of the longest chain.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stage(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m")), "cc-least")
        large = stage(join_groups(both, least, "u", "n", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-least")
        hung = join_groups(large, least, "u", "n", F.col("v")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
