"""Consolidating pairwise matches into groups (problem 4).

Union-find within edge partitions keeps a spanning forest of each partition (an
edge from every id to the root of its tree).  Forests are merged level by level
through partitions of about ``task_edges`` edges, at every size in the same way:

1. the edges of one id are brought together (an id has at most one edge per
   forest, so no id is hot) and united with the trees they touch;
2. an id that is the root of no tree anywhere is settled: it keeps its edge to
   a root and leaves the graph.  Only edges between roots go on, as the next
   level's edges, and get a spanning forest within their partitions again.

Trees are rooted at the least id by a hash that changes with the level, so a
constant share of the ids (at least a third of a chain) settles per level,
whatever the order of the ids.  What is left fits one partition in the end; its
components are the global components.  The settled ids then take their root's
root, level by level backwards, in salted joins, as a root may own any share of
all ids.

Defined results: links with a null or twice the same end are ignored, repeated
links count once, an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.skew import join_groups
from millrace.plans.staging import stage

#: Edges of one union-find task. Two ids and some integers each: about 300 MB of a Python worker.
TASK_EDGES = 1_000_000
_OUT = 50_000


class _Trees:
    """Union-find over the rows (id, root); names are numbered in the order of a level's hash, or of the names."""

    def __init__(self, ids: list[pa.Array], roots: list[pa.Array], level: int | None) -> None:
        ends = pa.chunked_array(ids + roots).cast(pa.string()).combine_chunks().dictionary_encode()
        names = ends.dictionary.to_pylist()
        if level is None:
            order = np.array(sorted(range(len(names)), key=lambda i: names[i].encode()), np.int64)
        else:
            salt = level.to_bytes(4, "big")
            order = np.argsort(np.frombuffer(b"".join(hashlib.blake2b(n.encode(), digest_size=8, salt=salt).digest() for n in names), np.uint64), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        codes = rank[ends.indices.to_numpy(zero_copy_only=False)]
        self.names = ends.dictionary.take(pa.array(order))
        self.ids, self.to = codes[: len(codes) // 2], codes[len(codes) // 2 :]
        parent = list(range(len(names)))
        for a, b in zip(self.ids.tolist(), self.to.tolist()):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        roots = np.array(parent, np.int64)
        while not np.array_equal(up := roots[roots], roots):
            roots = up
        self.roots = roots

    def rows(self, members: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(id, root, *more) of these members."""
        for at in range(0, len(members), _OUT):
            some = members[at : at + _OUT]
            extra = [pa.array(x[at : at + _OUT]) for x in more]
            yield pa.RecordBatch.from_arrays([self.names.take(pa.array(some)), self.names.take(pa.array(self.roots[some])), *extra], names=["id", "root", "active"][: 2 + len(more)])


def _chunks(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[list[pa.Array], list[pa.Array]]]:
    ids, roots, n = [], [], 0
    for b in batches:
        at = 0
        while at < len(b):
            part = b.slice(at, len(b) if most is None else most - n)
            ids.append(part.column(0))
            roots.append(part.column(1))
            n, at = n + len(part), at + len(part)
            if most is not None and n >= most:
                yield ids, roots
                ids, roots, n = [], [], 0
    if n:
        yield ids, roots


def _forest(level: int, task_edges: int):  # noqa: ANN202
    """Edges -> spanning forest of every ``task_edges`` of them: (id, root), and (root, root) for each root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, roots in _chunks(batches, task_edges):
            trees = _Trees(ids, roots, level)
            yield from trees.rows(np.arange(len(trees.roots)))

    return run


def _merge(level: int):  # noqa: ANN202
    """Forests, all rows of an id together -> (id, root, active): settled ids, and edges between roots (active)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, roots in _chunks(batches, None):
            trees = _Trees(ids, roots, level)
            active = np.ones(len(trees.roots), bool)
            active[trees.ids] = False
            active[trees.to] = True  # a root, here or elsewhere: (root, root) tells
            members = np.flatnonzero(trees.roots != np.arange(len(trees.roots)))
            yield from trees.rows(members, active[members])

    return run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of what fits one task: each id but the least of its component, with the least."""
    for ids, roots in _chunks(batches, None):
        trees = _Trees(ids, roots, None)
        yield from trees.rows(np.flatnonzero(trees.roots != np.arange(len(trees.roots))))


def components(links: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(group_id, id) for each linked id but the smallest of its group.

    ``links`` has two columns, the ends of a link; ids are compared as strings.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("root")).where("id is not null and root is not null and id <> root")
    schema, level, settled = "id string, root string", 0, []
    while True:
        forest = stage(edges.mapInArrow(_forest(level, task_edges), schema), "p4-forest")
        left = forest.count()
        if left <= task_edges:
            break
        parts = -(-left // task_edges)
        merged = stage(forest.repartition(parts, "id").mapInArrow(_merge(level), f"{schema}, active boolean"), "p4-merged")
        settled.append(merged.where("not active").select("id", "root"))
        edges, level = merged.where("active").select("id", "root"), level + 1
    found = forest.coalesce(1).mapInArrow(_last, schema)
    if not settled:
        return found.select(F.col("root").alias("group_id"), "id")
    found = stage(found, "p4-found")
    for leaves in reversed(settled):
        tops = found.select(F.col("id").alias("root"), F.col("root").alias("top"))
        owners = stage(leaves.groupBy("root").agg(F.count("*").alias("n")).join(tops, "root", "left").select("root", "n", F.coalesce("top", "root").alias("top")), "p4-owners")
        found = stage(found.union(join_groups(leaves, owners, "root", "n", F.col("id")).select("id", F.col("top").alias("root"))), "p4-found")
    heads = stage(found.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("least")).withColumn("group_id", F.least("root", "least")), "p4-heads")
    named = join_groups(found, heads, "root", "n", F.col("id")).select("group_id", "id").union(heads.select("group_id", F.col("root").alias("id")))
    return named.where("id <> group_id")


def record_links(match_pairs: DataFrame, duplicates: DataFrame, min_similarity: float = 0.5) -> DataFrame:
    """(id_a, id_b): accepted pairs, and each cluster member with its neighbour in the list.

    Pairs with null ids, equal ids or a null or low similarity are no links;
    null clusters, null members and clusters of one member give none.
    """
    pairs = match_pairs.where((F.col("similarity") >= min_similarity) & (F.col("id_a") != F.col("id_b"))).select("id_a", "id_b")
    members = F.filter(F.col("cluster"), lambda x: x.isNotNull())
    listed = duplicates.select(F.explode("clusters").alias("cluster")).select(members.alias("m")).where(F.size("m") > 1)
    chained = listed.select(F.explode(F.arrays_zip(F.expr("slice(m, 1, size(m) - 1)").alias("a"), F.expr("slice(m, 2, size(m) - 1)").alias("b"))).alias("l"))
    return pairs.union(chained.select(F.col("l.a"), F.col("l.b")))
