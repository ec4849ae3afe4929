"""Token packing into fixed-length training sequences, in a seeded order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import ShardConfig
from millrace.functions.text import EOS, filled
from millrace.plans.staging import stage


def permutation_key(id_column: str, seed: int):
    """Sort key of the seeded order."""
    return F.sha2(F.concat(F.lit(f"{seed}/shards/"), F.col(id_column).cast("string")), 256)


def ordered(df: DataFrame, cfg: ShardConfig) -> DataFrame:
    """(id, order_key, text) with one row per input row; ties of a repeated id are ordered by text."""
    return df.where(F.col(cfg.id_column).isNotNull()).select(
        F.col(cfg.id_column).cast("string").alias("id"), permutation_key(cfg.id_column, cfg.seed).alias("order_key"), filled(F.col(cfg.text_column)).alias("text")
    )


def offsets(df: DataFrame, cfg: ShardConfig | None = None) -> DataFrame:
    """(id, order_key, text, tokens, start): position of each document's first token in the global stream.

    Rows are range-partitioned by the order key; totals per partition (one
    number each) are summed up first, so no window ever spans the data.
    """
    cfg = cfg or ShardConfig()
    rows = ordered(df, cfg).withColumn("tokens", (F.octet_length("text") + 1).cast("long"))
    ranged = stage(rows.repartitionByRange(F.col("order_key"), F.col("id"), F.col("text")).withColumn("_part", F.spark_partition_id()), "shard-rows")
    totals = ranged.groupBy("_part").agg(F.sum("tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("_part", before.alias("_before"))  # one row per partition
    local = F.coalesce(F.sum("tokens").over(Window.partitionBy("_part").orderBy("order_key", "id", "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_local", local).join(F.broadcast(starts), "_part").select("id", "order_key", "text", "tokens", (F.col("_local") + F.col("_before")).alias("start"))


def _cut(width: int):
    """Documents at their offsets -> pieces of sequences (seq, at, bytes of int16)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, ats, pieces = [], [], []
            for text, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.append(np.frombuffer(text.encode(), np.uint8).astype(np.int16), np.int16(EOS))
                done = 0
                while done < len(tokens):
                    seq, at = divmod(start + done, width)
                    n = min(width - at, len(tokens) - done)
                    seqs.append(seq)
                    ats.append(at)
                    pieces.append(tokens[done : done + n])
                    done += n
            if seqs:
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(ats, pa.int32()), pa.array(pieces, pa.list_(pa.int16()))], names=["seq", "at", "piece"])

    return run


def sequences(placed: DataFrame, cfg: ShardConfig | None = None) -> DataFrame:
    """(seq, tokens): rows of seq_len + 1 tokens of the concatenated documents; the last partial row is dropped."""
    cfg = cfg or ShardConfig()
    width = cfg.seq_len + 1
    pieces = placed.select("text", "start").mapInArrow(_cut(width), "seq long, at int, piece array<smallint>")
    # A sequence holds at most seq_len + 1 pieces, so the lists are bounded.
    joined = pieces.groupBy("seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"])).alias("tokens"))
    return joined.where(F.size("tokens") == width)


def summary(placed: DataFrame, cfg: ShardConfig | None = None) -> DataFrame:
    """One row: documents, tokens, sequences, dropped tail, shards."""
    cfg = cfg or ShardConfig()
    width = cfg.seq_len + 1
    one = placed.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("n_tokens"))
    n = F.floor(F.col("n_tokens") / width)
    return one.select("n_docs", "n_tokens", n.alias("n_sequences"), (F.col("n_tokens") % width).alias("dropped_tail"), F.ceil(n / cfg.sequences_per_shard).alias("n_shards"))


def rank_split(rows: DataFrame, world: int) -> DataFrame:
    """``rank`` of each sequence when ``world`` trainers take turns."""
    return rows.withColumn("rank", F.pmod("seq", F.lit(world)).cast("int"))


def resume(rows: DataFrame, consumed: int) -> DataFrame:
    """The sequences that are left after the first ``consumed``."""
    return rows.where(F.col("seq") >= consumed)


class ShardReader:
    """Streams sequences in order through a seeded shuffle buffer; resumes exactly."""

    def __init__(self, rows: DataFrame, buffer: int = 256, seed: int = 0) -> None:
        if buffer < 1:
            raise ValueError("buffer must hold at least one sequence")
        self.rows, self.buffer, self.seed = rows, buffer, seed

    def __iter__(self) -> Iterator[list[int]]:
        return self.read()

    def read(self, consumed: int = 0, epoch: int = 0) -> Iterator[list[int]]:
        """Sequences of an epoch; the first ``consumed`` are replayed and dropped."""
        rng = np.random.default_rng([self.seed, epoch])
        held: list[list[int]] = []
        given = 0
        source = (r.tokens for r in self.rows.orderBy("seq").select("tokens").toLocalIterator(prefetchPartitions=True))
        for tokens in source:
            held.append(tokens)
            if len(held) < self.buffer:
                continue
            given += 1
            out = self._take(held, rng)
            if given > consumed:
                yield out
        while held:
            given += 1
            out = self._take(held, rng)
            if given > consumed:
                yield out

    @staticmethod
    def state(consumed: int, epoch: int = 0) -> dict[str, int]:
        """What a run has to keep to go on from here."""
        return {"consumed": consumed, "epoch": epoch}

    def resume(self, state: dict[str, int], epoch: int | None = None) -> Iterator[list[int]]:
        """The rest of the state's epoch; another epoch than the state's is an error, as its order differs."""
        if epoch is not None and epoch != state["epoch"]:
            raise ValueError(f"the state belongs to epoch {state['epoch']}, not {epoch}")
        return self.read(state["consumed"], state["epoch"])

    @staticmethod
    def _take(held: list, rng: np.random.Generator):
        slot = int(rng.integers(len(held)))
        held[slot], held[-1] = held[-1], held[slot]
        return held.pop()
