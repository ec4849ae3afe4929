"""Exact and near duplicates: normal forms, MinHash bands, verified pairs, components, survivors.

Rows are collapsed to one per normalized text before banding, so that copies,
however many, never pair with each other; components over representatives are
the components over rows.  Survivor of a group: the smallest id as a string.
Null ids are kept and never removed; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import DedupConfig
from millrace.functions.text import jaccard, normalize, shingles
from millrace.operators.components import connected_components
from millrace.plans.skew import join_groups
from millrace.plans.staging import stage

#: A band shared by so many representatives is dealt over so many salts.
HOT_BAND, SALTS = 500, 32


def exact_groups(df: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """(text_sha, rows, survivor): normalized texts that occur more than once."""
    cfg = cfg or DedupConfig()
    sha = F.sha2(normalize(F.col(cfg.text_column), cfg.normalize), 256)
    return df.groupBy(sha.alias("text_sha")).agg(F.count("*").alias("rows"), F.min(F.col(cfg.id_column).cast("string")).alias("survivor")).where("rows > 1")


def text_key(text, mode: str):
    """What stands for a normalized text in groups and joins: its SHA-256, 32 bytes whatever its length."""
    return F.unhex(F.sha2(normalize(text, mode), 256))


def representatives(df: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(key, rep, norm): one row per normalized text, named by its smallest id."""
    rows = df.where(F.col(cfg.id_column).isNotNull())
    norm = normalize(F.col(cfg.text_column), cfg.normalize)
    return rows.groupBy(text_key(F.col(cfg.text_column), cfg.normalize).alias("key")).agg(F.min(F.col(cfg.id_column).cast("string")).alias("rep"), F.any_value(norm).alias("norm"))


def _signatures(num_perm: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        factor = rng.integers(0, 2**63, num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        term = rng.integers(0, 2**63, num_perm, dtype=np.uint64)
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = np.diff(lists.offsets.to_numpy())
            full = np.flatnonzero(counts)
            out = np.full((len(batch), num_perm), np.iinfo(np.int64).max, np.int64)
            if len(full):
                start = (np.cumsum(counts) - counts)[full]
                for k in range(num_perm):
                    mixed = values * factor[k] + term[k]
                    out[full, k] = (np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), start) >> np.uint64(1)).astype(np.int64)
            flat = pa.array(out.reshape(-1))
            offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * num_perm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["rep", "signature"])

    return run


def signatures(shingled: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(rep, signature): MinHash minima; shingles are hashed in the JVM, minima taken in Arrow batches.

    The family is our own: multiply-shift on 64-bit hashes. An empty text has the greatest value everywhere.
    """
    hashed = shingled.select("rep", F.transform("shingles", lambda s: F.xxhash64(s)).alias("hashes"))
    return hashed.mapInArrow(_signatures(cfg.num_perm, cfg.seed), "rep string, signature array<long>")


def estimate(a, b, num_perm: int):
    """Share of agreeing signature positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / num_perm


def _band_keys(num_perm: int, bands: int):
    """Band number and hash of each band of a signature."""
    rows = num_perm // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))


def candidate_pairs(signed: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(a, b), a < b: distinct pairs of representatives that share a band.

    A band that ``HOT_BAND`` representatives share is dealt over ``SALTS``
    salts, so that no task compares all of its members.
    """
    posts = stage(signed.select("rep", F.explode(_band_keys(cfg.num_perm, cfg.bands)).alias("band")), "dedup-bands")
    # At most (representatives x bands) / HOT_BAND of them; the list is joined, and broadcast only where Spark finds it small.
    hot = posts.groupBy("band").count().where(F.col("count") >= HOT_BAND).select("band", F.lit(True).alias("hot"))
    marked = posts.join(hot, "band", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    left = marked.select(F.col("rep").alias("a"), "band", salt.alias("salt"))
    right = marked.select(F.col("rep").alias("b"), "band", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return left.join(right, ["band", "salt"]).where("a < b").select("a", "b").distinct()


def _mllib_pairs(reps: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Candidates of Spark ML's MinHash tables: one table per band, each of a single function, so many more candidates."""
    from pyspark.ml.feature import MinHashLSH
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size = 1 << 20
    places = F.array_sort(F.array_distinct(F.transform("hashes", lambda h: F.pmod(h, F.lit(size)))))

    @F.udf(VectorUDT())
    def sparse(at: list[int]) -> SparseVector:
        return SparseVector(size, at, [1.0] * len(at))

    rows = reps.where(F.size("hashes") > 0).select("rep", sparse(places).alias("v"))
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=cfg.bands, seed=cfg.seed).fit(rows)
    # Buckets of the vectors can collide, so the bound is a little wider; pairs are verified on the hashes themselves.
    found = model.approxSimilarityJoin(rows, rows, 1.0 - cfg.threshold + 0.02)
    return found.select(F.col("datasetA.rep").alias("a"), F.col("datasetB.rep").alias("b")).where("a < b").distinct()


def near_pairs(df: DataFrame, cfg: DedupConfig | None = None, report: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(reps, pairs): representatives (key, rep) and their verified pairs (a, b, similarity).

    ``report`` gets the number of candidate pairs.
    """
    cfg = cfg or DedupConfig()
    hashes = F.transform(shingles(F.col("norm"), cfg.shingle_size), lambda s: F.xxhash64(s))
    reps = stage(representatives(df, cfg).select("key", "rep", hashes.alias("hashes")), "dedup-reps")
    if cfg.backend == "mllib":
        pairs = stage(_mllib_pairs(reps, cfg), "dedup-candidates")
    else:
        signed = reps.select("rep", "hashes").mapInArrow(_signatures(cfg.num_perm, cfg.seed), "rep string, signature array<long>")
        pairs = stage(candidate_pairs(signed, cfg), "dedup-candidates")
    if report is not None:
        report["candidate_pairs"] = pairs.count()
    a = reps.select(F.col("rep").alias("a"), F.col("hashes").alias("_x"))
    b = reps.select(F.col("rep").alias("b"), F.col("hashes").alias("_y"))
    verified = pairs.join(a, "a").join(b, "b").select("a", "b", jaccard(F.col("_x"), F.col("_y")).alias("similarity"))
    return reps.select("key", "rep"), stage(verified.where(F.col("similarity") >= cfg.threshold), "dedup-pairs")


def clusters(df: DataFrame, cfg: DedupConfig | None = None, report: dict | None = None) -> DataFrame:
    """(id, survivor, kind) for each row of a group of two and more.

    kind: ``kept``, ``exact`` (same normalized text as the survivor) or ``near``.
    """
    cfg = cfg or DedupConfig()
    return grouped(df, *near_pairs(df, cfg, report), cfg)


def grouped(df: DataFrame, reps: DataFrame, pairs: DataFrame, cfg: DedupConfig) -> DataFrame:
    """The clusters of ``df`` by these pairs of representatives.

    A text or a group may own any share of all rows: both joins deal hot keys over salts.
    """
    roots = connected_components(pairs, "a", "b").select(F.col("node").alias("rep"), "root")
    rows = df.where(F.col(cfg.id_column).isNotNull()).select(F.col(cfg.id_column).cast("string").alias("id"), text_key(F.col(cfg.text_column), cfg.normalize).alias("key"))
    rows = stage(rows, "dedup-keys")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    # A text belongs to a group of two and more if it has copies or stands in a component.
    of_text = reps.join(sizes, "key").join(roots, "rep", "left").where("n > 1 or root is not null")
    # The least representative of a component is the least id of the group.
    of_text = stage(of_text.select("key", "rep", "n", F.coalesce("root", "rep").alias("survivor")), "dedup-texts")
    named = join_groups(rows, of_text, "key", "n", F.col("id"))
    kind = F.when(F.col("id") == F.col("survivor"), "kept").when(F.col("rep") == F.col("survivor"), "exact").otherwise("near")
    return named.select("id", "survivor", kind.alias("kind"))


def removed(clustered: DataFrame) -> DataFrame:
    return clustered.where("kind <> 'kept'").select("id", "survivor", "kind")


def kept(df: DataFrame, clustered: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows that stay: all whose id was not removed."""
    gone = removed(clustered).select(F.col("id").alias("_gone")).distinct()
    return df.join(gone, F.col(id_column).cast("string") == F.col("_gone"), "left_anti")


def summary(df: DataFrame, clustered: DataFrame) -> DataFrame:
    """One row: input rows, clusters, largest cluster (1 if none), rows removed as exact and near copies."""
    sizes = clustered.groupBy("survivor").agg(F.count("*").alias("n"), F.sum((F.col("kind") == "exact").cast("long")).alias("e"), F.sum((F.col("kind") == "near").cast("long")).alias("r"))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    one = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("largest_cluster"), zero("e", "removed_exact"), zero("r", "removed_near"))
    return df.agg(F.count("*").alias("input_rows")).crossJoin(one)  # one row each
