"""Mixing sources to target weights (problem 7).

The total is the largest at which every source that has documents can meet its
share within its repeats (shares of sources without documents are spread over
the others), unless a total is given; then sources at their cap fall short and
the shares really reached are reported.  A source's documents are all used
``floor(rate)`` times and some once more: which ones is drawn by the cube
method, so that tokens and documents of the extra uses are both balanced.  The
flight phase runs inside partitions, moving the probabilities of three
documents at a time along the null space of the two constraints; each source
leaves two undecided documents and a reserve of ten per partition, which fly on
together in fewer partitions until so many per source remain, and those land by
trying all outcomes: the reserve makes up for a huge document among the last.

Defined results: documents of sources without a target, or without a source,
are used 0 times; a null text has no tokens and is never used; repeated ids
count once; a target without documents gets share 0; empty tables give an empty
result or zero shares.
"""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.staging import stage

#: Undecided documents that one task takes in a later round.
TASK_UNDECIDED = 50_000
#: Documents of a source that each partition leaves for the landing, where 2 ** (RESERVE + 2) outcomes are tried.
RESERVE = 10
_EPS = 1e-9
_SCHEMA = "doc_id long, source string, tokens long, base int, p double, state int"


def _fly(tokens: list[int], p: list[float], rng: random.Random) -> list[float]:
    """Flight phase with the constraints documents and tokens; at most two values stay fractional."""
    p = list(p)
    held: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            held.append(i)
        while len(held) == 3:
            a, b, c = held
            # A vector orthogonal to both (1, 1, 1) and the tokens.
            u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
            if not any(u):
                u = (1, -1, 0)
            forth = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u) if v)
            back = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u) if v)
            step = forth if rng.random() < back / (forth + back) else -back
            for k, v in zip(held, u):
                p[k] = min(1.0, max(0.0, p[k] + step * v))
            held = [k for k in held if _EPS < p[k] < 1 - _EPS]
    return [0.0 if v <= _EPS else 1.0 if v >= 1 - _EPS else v for v in p]


def _land(tokens: list[int], p: list[float]) -> list[float]:
    """The outcome of the last undecided documents that keeps tokens, then documents, closest to their expectation."""
    want, number = sum(t * v for t, v in zip(tokens, p)), sum(p)
    outcomes = ((np.arange(1 << len(p))[:, None] >> np.arange(len(p))) & 1).astype(float)
    off = np.abs(outcomes @ np.array(tokens, float) - want) / max(1.0, float(np.median(tokens)) if tokens else 1.0)
    return list(outcomes[int(np.argmin(off + 0.05 * np.abs(outcomes.sum(1) - number)))])


def _order(seed: int, doc: int) -> bytes:
    return hashlib.blake2b(f"{seed}/{doc}".encode(), digest_size=8).digest()


def _round(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per source, the documents that are still undecided; decided ones are passed on at once.
        held: dict[str, list[tuple[int, int, int, float]]] = defaultdict(list)

        def settle(source: str, final: bool) -> list[tuple]:
            rows = sorted(held[source], key=lambda r: _order(seed, r[0]))
            if not rows:
                return []
            ids, tokens, p = [r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows]
            rng = random.Random(int.from_bytes(_order(seed, ids[0]), "big"))
            p = [*p[:RESERVE], *_fly(tokens[RESERVE:], p[RESERVE:], rng)]
            if final and last:
                open_ = [i for i, v in enumerate(p) if 0 < v < 1]
                for i, v in zip(open_, _land([tokens[i] for i in open_], [p[i] for i in open_])):
                    p[i] = float(v)
            done = [(r[0], source, r[1], r[2] + int(v), 0.0, 1) for r, v in zip(rows, p) if v in (0.0, 1.0)]
            held[source] = [(r[0], r[1], r[2], v) for r, v in zip(rows, p) if v not in (0.0, 1.0)]
            return done

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "source", "tokens", "base", "p", "state"])

        for batch in batches:
            for d, s, t, b, p in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held[s].append((d, t, b, p))
            if rows := [r for s in sorted(held) for r in settle(s, False)]:
                yield out(rows)
        rows = [r for s in sorted(held) for r in settle(s, True)]
        rows += [(d, s, t, b, p, 0) for s in sorted(held) for d, t, b, p in held[s]]
        if rows:
            yield out(rows)

    return run


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Mean uses per document of each source: the share's tokens over the source's, at most its repeats."""
    there = {s: (w, r) for s, (w, r) in targets.items() if totals.get(s, 0) > 0 and w > 0 and r > 0}
    weight = sum(w for w, _ in there.values())
    if not there:
        return {}
    most = min(r * totals[s] * weight / w for s, (w, r) in there.items())
    goal = most if total is None else total
    return {s: min(float(r), goal * w / weight / totals[s]) for s, (w, r) in there.items()}


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, tokens, n_uses) from (doc_id, source, tokens) and (source, target_share, max_repeats).

    ``targets`` is a short configuration table; it and one total per target come to the driver.
    """
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().toLocalIterator()}
    docs = stage(sizes.where("doc_id is not null").select("doc_id", "source", "tokens").dropDuplicates(["doc_id"]), "p7-sizes")
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    totals = {r.source: int(r.n) for r in docs.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).toLocalIterator()}
    rate = rates(totals, wanted, total_tokens)
    table = spark.createDataFrame([(s, int(v + _EPS), max(0.0, v - int(v + _EPS))) for s, v in rate.items()], "source string, base int, p double")
    rows = docs.join(F.broadcast(table), "source", "left").withColumn("p", F.when(F.col("tokens") > 0, F.col("p")))
    idle = rows.where("p is null").select("doc_id", "source", "tokens", F.lit(0).alias("n_uses"))
    flying = rows.where("p is not null").select("doc_id", "source", "tokens", "base", "p")
    done = None
    level = 0
    flown = stage(flying.mapInArrow(_round(seed, False), _SCHEMA), "p7-flown")
    while True:
        settled = flown.where("state = 1").select("doc_id", "source", "tokens", F.col("base").alias("n_uses"))
        done = settled if done is None else done.union(settled)
        undecided = flown.where("state = 0").select("doc_id", "source", "tokens", "base", "p")
        n = undecided.count()
        level += 1
        if n <= TASK_UNDECIDED:
            last = undecided.coalesce(1).mapInArrow(_round(seed + level, True), _SCHEMA)
            done = done.union(last.select("doc_id", "source", "tokens", F.col("base").alias("n_uses")))
            return idle.union(done)
        flown = stage(undecided.repartition(-(-n // TASK_UNDECIDED), "doc_id").mapInArrow(_round(seed + level, False), _SCHEMA), "p7-flown")


def shares(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens_used, documents_used, most_uses) for each target."""
    per = used.where("n_uses > 0").groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("tokens_used"), F.count("*").alias("documents_used"), F.max("n_uses").alias("most_uses"))
    whole = per.agg(F.sum("tokens_used").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    joined = targets.where("source is not null").select("source", "target_share").distinct().join(per, "source", "left").crossJoin(F.broadcast(whole))
    return joined.select("source", "target_share", F.round(F.coalesce(F.col("tokens_used") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), zero("tokens_used"), zero("documents_used"), zero("most_uses"))


def checked(used: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, documents, above_cap): documents of each source (null is one) and uses above its repeats, which must be 0."""
    caps = targets.where("source is not null").select("source", "max_repeats").distinct()
    over = F.greatest(F.col("n_uses") - F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    return used.join(F.broadcast(caps), "source", "left").groupBy("source").agg(F.count("*").alias("documents"), F.sum(over.cast("long")).alias("above_cap"))
