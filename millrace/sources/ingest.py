"""Idempotent landing of batches in bronze.

A batch is identified by its content in order: the rows' hashes, each hashed
again with its position.  The first batch pins the schema; later ones may reorder columns,
may not add or remove any, and must cast safely.  A crash between publishing
and logging republishes the same batch under the same name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

import millrace
from millrace.functions.text import row_json
from millrace.sources.catalog import Catalog


class IngestError(ValueError):
    """A batch does not fit the dataset's schema."""


@dataclass
class IngestResult:
    batches_written: int = 0
    batches_skipped: int = 0
    rows_written: int = 0
    rows_skipped: int = 0


def promote_nulls(df: DataFrame) -> DataFrame:
    """All-null columns of no type become strings."""
    void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void}) if void else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The batch in the pinned schema, or IngestError."""
    have, want = set(df.columns), {f.name for f in schema}
    if have != want:
        raise IngestError(f"schema drift: missing {sorted(want - have)}, unexpected {sorted(have - want)}")
    cast, lossy = [], []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if df.schema[f.name].dataType == f.dataType:
            cast.append(c)
            continue
        to = c.try_cast(f.dataType)
        back = to.try_cast(df.schema[f.name].dataType)
        lossy.append(F.coalesce(F.sum((c.isNotNull() & ~back.eqNullSafe(c)).cast("int")), F.lit(0)).alias(f.name))
        cast.append(to.alias(f.name))
    if lossy:
        bad = {k: v for k, v in df.agg(*lossy).first().asDict().items() if v}
        if bad:
            raise IngestError(f"columns not castable without loss: {bad}")
    return df.select(*cast)


def _digest(position) -> list:
    """Aggregates that identify rows in their order: row hashes are hashed again with the position.

    Sums of slices of these hashes do not depend on the order of evaluation and combine per partition first.
    """
    h = F.sha2(F.concat(F.col("_h"), F.lit("@"), position.cast("string")), 256)
    return [F.count("*").cast("string"), *[F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]]


def _hex(row) -> str:
    return hashlib.sha256("\n".join(str(x) for x in row).encode()).hexdigest()


def batch_hash(df: DataFrame, order: list[str] | None = None) -> str:
    """SHA-256 of the batch: of its rows in ``order``, or in the order in which they stand.

    The standing order is the partitions' order and the order inside each, as
    Spark keeps it for files and lists; after a shuffle it is not defined, so
    give ``order`` there.
    """
    hashed = df.withColumn("_h", F.sha2(row_json(df.columns), 256))
    if order:
        from millrace.operators.ordering import dense_rank_ids

        return _hex(dense_rank_ids(hashed, order, "_r").agg(*_digest(F.col("_r"))).first())
    # The position counts from 0 through all partitions, so it does not depend on how the rows are split.
    from millrace.plans.staging import stage

    placed = stage(hashed.select("_h", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")), "batch")
    counts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_p", "_first", before.alias("_before"))  # one row per partition
    ranked = placed.join(F.broadcast(starts), "_p").withColumn("_r", F.col("_i") - F.col("_first") + F.col("_before"))
    return _hex(ranked.agg(*_digest(F.col("_r"))).first())


class Lander:
    """Lands batches of one dataset."""

    def __init__(self, catalog: Catalog, dataset: str, source_name: str = "") -> None:
        self.catalog, self.dataset, self.source_name = catalog, dataset, source_name
        self.seen = {e["batch_hash"] for e in catalog.events(f"ingest-{dataset}")}
        self.schema = catalog.read("bronze", dataset).schema if catalog.parts("bronze", dataset) else None

    def fit(self, batch: DataFrame) -> DataFrame:
        batch = promote_nulls(batch)
        return conform(batch, self.schema) if self.schema is not None else batch

    def is_new(self, digest: str, n: int, result: IngestResult) -> bool:
        if digest in self.seen:
            result.batches_skipped += 1
            result.rows_skipped += n
            return False
        self.seen.add(digest)
        return True

    def log(self, digest: str, n: int, batch: DataFrame, result: IngestResult) -> None:
        """The ledger's entry of a batch that has been published."""
        self.catalog.append_event(
            f"ingest-{self.dataset}",
            {"batch_hash": digest, "part": f"_batch_hash={digest[:16]}", "n_rows": n, "source": self.source_name, "code_version": millrace.__version__, "ingested_at": datetime.now(UTC).isoformat()},
        )
        if self.schema is None:
            self.schema = batch.schema
        result.batches_written += 1
        result.rows_written += n

    def land(self, batch: DataFrame, result: IngestResult | None = None) -> IngestResult:
        result = result or IngestResult()
        batch = self.fit(batch)
        n = batch.count()
        if n and self.is_new(digest := batch_hash(batch), n, result):
            self.catalog.append(batch, self.dataset, digest[:16])
            self.log(digest, n, batch, result)
        return result


def land(source: DataFrame, catalog: Catalog, dataset: str, source_name: str = "", order: list[str] | None = None, batch_size: int | None = None) -> IngestResult:
    """Land a source whole, or in batches of ``batch_size`` rows in ``order``.

    All batches are hashed in one aggregation and published in one write, each into its own directory.
    """
    lander, result = Lander(catalog, dataset, source_name), IngestResult()
    if batch_size is None:
        return lander.land(source, result)
    from millrace.plans.staging import stage
    from millrace.sources.files import batch_numbers

    fitted = lander.fit(source)
    framed = batch_numbers(fitted, order or source.columns, batch_size)
    framed = stage(framed.withColumn("_h", F.sha2(row_json(fitted.columns), 256)), "landing")
    place = F.col("_position") - F.col("_batch") * batch_size
    found = framed.groupBy("_batch").agg(F.count("*").alias("_n"), F.array(*_digest(place)).alias("_d")).orderBy("_batch")
    # One row per batch comes to the driver, as does the ledger.
    fresh = [(r["_batch"], digest, r["_n"]) for r in found.toLocalIterator() if lander.is_new(digest := _hex(r["_d"]), r["_n"], result)]
    if fresh:
        names = framed.sparkSession.createDataFrame([(b, d[:16]) for b, d, _ in fresh], "_batch long, _batch_hash string")
        catalog.append_all(framed.join(F.broadcast(names), "_batch").select(*fitted.columns, "_batch_hash"), dataset)
        for _, digest, n in fresh:
            lander.log(digest, n, fitted, result)
    return result
