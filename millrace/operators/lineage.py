"""Lineage events, the graph of the latest run of each job, and its closure."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "seq long, job string, inputs array<string>, outputs array<string>"


def latest_jobs(events: DataFrame) -> DataFrame:
    """The last event of each job."""
    w = Window.partitionBy("job").orderBy(F.col("seq").desc())
    return events.where(F.col("job").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def edges(events: DataFrame) -> DataFrame:
    """(src, dst): inputs to job and job to outputs, of the latest events."""
    last = latest_jobs(events)
    into = last.select(F.explode("inputs").alias("src"), F.concat(F.lit("job:"), "job").alias("dst"))
    out = last.select(F.concat(F.lit("job:"), "job").alias("src"), F.explode("outputs").alias("dst"))
    return into.union(out).where("src is not null and dst is not null").distinct()


def upstream(events: DataFrame, dataset: str) -> list[str]:
    """All datasets it derives from, itself included where a job reads and writes it.

    The graph has one node per job and dataset of the catalog and is walked on the driver.
    """
    back = defaultdict(set)
    for e in edges(events).toLocalIterator():
        back[e.dst].add(e.src)
    seen: set[str] = set()
    front = {dataset}
    while front:
        front = {s for d in front for s in back[d]} - seen
        seen |= front
    return sorted(s for s in seen if not s.startswith("job:"))


def to_mermaid(events: DataFrame) -> str:
    rows = sorted((e.src, e.dst) for e in edges(events).toLocalIterator())
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for e in rows for x in e}))}
    shape = lambda n: f'{names[n]}(["{n[4:]}"])' if n.startswith("job:") else f'{names[n]}["{n}"]'
    return "\n".join(["graph LR", *(f"    {shape(a)} --> {shape(b)}" for a, b in rows)])
