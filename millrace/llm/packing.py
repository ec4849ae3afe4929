"""Filling fixed-capacity containers with documents (problem 6).

Only the histogram of sizes reaches the driver: at most ``capacity`` numbers,
whatever the corpus.  There a plan is made on counts:

1. Sizes are put into ``BINS`` bins of the capacity.  Non-negative least squares
   finds how often to repeat each combination of bins that fills a container to
   within a window, so that together they use up the histogram.  Combinations
   hold up to ``DEPTH`` items; those of many items are too many to list, so the
   active-set method asks for the steepest one each time, found in ``log2(DEPTH)``
   max-plus products of the slopes (shallow: two halves, each of two halves ...).
2. Repeats are rounded as far as there are items; what is left is planned
   again, up to ``PASSES`` times.
3. Within a bin, items go to combinations in the order of their exact size, so
   the exact room left in every container is known, again as runs of equal
   containers.  Residual items are packed greedily into that room, the longest
   first into the least room that fits, then into new containers.

Executors look up the container of each document by its rank among the
documents of the same size, with a binary search in the plan; ranks come from
counts per partition, so a size that a third of all documents share is still
spread over all tasks.

Defined results: a document above the capacity is cut into full containers and
a remainder that is packed like a document; an empty or null text takes no
space and gets the container ``<spec>/empty``; a null or non-positive capacity
is ignored; repeated documents and specs count once; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.staging import stage

BINS = 256
#: Items of a combination; a power of two.
DEPTH = 16
#: Containers of the plan may lack so many bins, beside what rounding up to bins takes.
WINDOW = 1
#: What rounding and short supply leave of one least-squares plan is planned again, so often at most.
PASSES = 8
#: Share of the tokens, the shortest documents, kept back to fill the room that bins of several sizes leave.
RESERVE = 0.02
#: Combinations asked for in one least-squares problem.
ROUNDS = 300
#: Ranks of one size; 2**40 documents of one size can be told apart.
_RANKS = 1 << 40

#: (sizes of the items of one container, how many such containers, how many of the items are planned by least squares)
Run = tuple[tuple[int, ...], int, int]


class _Pricing:
    """The combination of bins with the greatest sum of slopes, among those that fill a container."""

    def __init__(self, bins: int, window: int, depth: int) -> None:
        self.bins, self.window, self.halvings = bins, window, max(1, depth.bit_length() - 1)
        a = np.arange(bins + 1)
        self.other = a[:, None] - a[None, :]  # the bins of the other half
        self.outside = self.other < 0

    def __call__(self, slope: np.ndarray) -> tuple[float, tuple[int, ...]]:
        """``slope[b]`` is -inf where bin ``b`` has no items."""
        best = np.concatenate([[0.0], slope[1:]])
        halves = []
        for _ in range(self.halvings):
            sums = best[None, :] + best[self.other]
            sums[self.outside] = -np.inf
            halves.append(sums.argmax(1))
            best = sums[np.arange(len(best)), halves[-1]]
        low = max(1, self.bins - self.window)
        full = low + int(np.argmax(best[low:]))
        value, parts = float(best[full]), [full]
        for half in reversed(halves):
            parts = [x for c in parts for x in (int(half[c]), c - int(half[c]))]
        return value, tuple(sorted((c for c in parts if c), reverse=True))


def nnls(target: np.ndarray, weight: np.ndarray, pricing: _Pricing, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """(combination, repeats) that use up ``target``: least squares with repeats >= 0 (active set method)."""
    square = weight * weight
    bins = len(target)
    absent = target <= 0
    chosen: list[tuple[int, ...]] = []
    x, matrix = np.zeros(0), np.zeros((bins, 0))
    floor = 1e-9 * max(1.0, float((square * target).max()))
    for _ in range(rounds):
        slope = square * (target - matrix @ x)
        slope[absent] = -np.inf
        value, combination = pricing(slope)
        if not value > floor or combination in chosen:
            break
        chosen.append(combination)
        x = np.append(x, 0.0)
        matrix = np.column_stack([matrix, np.bincount(combination, minlength=bins).astype(float)])
        while len(chosen):
            gram = matrix.T @ (square[:, None] * matrix)
            gram[np.diag_indices_from(gram)] += 1e-6
            s = np.linalg.solve(gram, matrix.T @ (square * target))
            if (s > 0).all():
                x = s
                break
            down = s <= 0
            step = float(np.min(x[down] / np.maximum(x[down] - s[down], 1e-12)))
            x = x + step * (s - x)
            stay = x > 1e-9
            chosen, x, matrix = [c for c, k in zip(chosen, stay) if k], x[stay], matrix[:, stay]
    return list(zip(chosen, x.tolist()))


def plan_bins(counts: np.ndarray, depth: int = DEPTH, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(combination of bins, repeats) that never use more items of a bin than there are.

    ``counts[b]`` is the number of items of bin ``b``; bin 0 is unused.
    """
    left, plan = counts.astype(np.int64).copy(), []
    left[0] = 0
    pricing = _Pricing(len(counts) - 1, window, depth)
    # The largest items are the hardest to place later, so their residuals weigh most.
    weight = np.linspace(0.2, 1.0, len(counts))
    for _ in range(PASSES):
        if not left.any():
            break
        before = int(left.sum())
        for combination, repeats in sorted(nnls(left.astype(float), weight, pricing), key=lambda c: -c[1]):
            need = Counter(combination)
            r = min(int(repeats + 0.7), *(int(left[b]) // k for b, k in need.items()))
            if r > 0:
                for b, k in need.items():
                    left[b] -= r * k
                plan.append((combination, r))
        if before - left.sum() < 0.01 * before:
            break
    return plan


def exact_runs(plan: list[tuple[tuple[int, ...], int]], sizes: dict[int, list[tuple[int, int]]]) -> list[Run]:
    """The plan in exact sizes; ``sizes[b]`` lists (size, count) of bin ``b`` in order and is used up."""
    at: dict[int, list[int]] = {b: [0, 0] for b in sizes}  # next entry of the bin, and how many of it are taken
    runs: list[Run] = []
    for combination, repeats in plan:
        slots = []
        for b in combination:
            taken, need = [], repeats
            while need:
                entry, used = at[b]
                size, n = sizes[b][entry]
                k = min(need, n - used)
                taken.append((size, k))
                need -= k
                at[b] = [entry + 1, 0] if used + k == n else [entry, used + k]
            slots.append(taken)
        while slots[0]:
            k = min(slot[0][1] for slot in slots)
            runs.append((tuple(slot[0][0] for slot in slots), k, len(slots)))
            for slot in slots:
                size, n = slot[0]
                if n == k:
                    slot.pop(0)
                else:
                    slot[0] = (size, n - k)
    for b, (entry, used) in at.items():
        rest = sizes[b][entry:]
        if rest and used:
            rest[0] = (rest[0][0], rest[0][1] - used)
        sizes[b] = rest
    return runs


def fitted(runs: list[Run], capacity: int) -> tuple[list[Run], Counter[int]]:
    """The runs without the least items that make them fit, and these items: bins round sizes up and down."""
    fit, dropped = [], Counter()
    for sizes, n, _ in runs:
        kept = sorted(sizes, reverse=True)
        over = sum(kept) - capacity
        while over > 0:
            size = next((s for s in reversed(kept) if s >= over), kept[0])
            kept.remove(size)
            dropped[size] += n
            over -= size
        if kept:
            fit.append((tuple(kept), n, len(kept)))
    return fit, dropped


def plan_rest(counts: dict[int, int] | Counter[int], capacity: int, runs: list[Run] = ()) -> list[Run]:
    """Greedy packing on counts: the longest size first, into the least room that fits, then into new containers.

    ``runs`` are open containers; they come back with what was added.
    """
    rooms: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        rooms[capacity - sum(run[0])].append(run)
    order = sorted(rooms)

    def open_room(room: int, run: Run) -> None:
        if not rooms[room]:
            i = bisect_left(order, room)
            if i == len(order) or order[i] != room:
                insort(order, room)
        rooms[room].append(run)

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[size]
        while left:
            i = bisect_left(order, size)
            while i < len(order) and not rooms[order[i]]:
                del order[i]
            if i == len(order):
                break
            room = order[i]
            combination, n, planned = rooms[room].pop()
            fit = min(room // size, left)
            k = min(n, left // fit)
            if k < n:
                rooms[room].append((combination, n - k, planned))
            open_room(room - fit * size, ((*combination, *[size] * fit), k, planned))
            left -= k * fit
        each = capacity // size
        for items, n in ((each, left // each), (left % each, 1)):
            if items and n:
                open_room(capacity - items * size, ((size,) * items, n, 0))
    return [run for room in sorted(rooms) for run in rooms[room]]


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """The containers for a histogram of exact sizes."""
    width = -(-capacity // BINS)
    bins = capacity // width
    binned = np.zeros(bins + 1, np.int64)
    sizes: dict[int, list[tuple[int, int]]] = defaultdict(list)
    reserve, small = RESERVE * sum(s * n for s, n in counts.items()), Counter()
    for size, n in sorted(counts.items()):
        kept = min(n, int(reserve // size)) if width > 1 else 0
        small[size], reserve = kept, reserve - kept * size
        if n > kept:
            b = min(bins, max(1, round(size / width)))
            binned[b] += n - kept
            sizes[b].append((size, n - kept))
    runs, dropped = fitted(exact_runs(plan_bins(binned), sizes), capacity)
    rest = small + dropped + Counter({size: n for entries in sizes.values() for size, n in entries})
    return plan_rest(rest, capacity, runs)


def _slots(plans: dict[str, list[Run]]) -> dict[str, tuple[np.ndarray, ...]]:
    """Per spec, in order: first rank of a size (size * _RANKS + rank), items per container, first container; and the first greedy container."""
    found = {}
    for spec, runs in plans.items():
        given: dict[int, int] = defaultdict(int)
        rows, base = [], 0
        runs = sorted(runs, key=lambda r: r[2] == 0)
        planned = sum(n for _, n, k in runs if k)
        for combination, n, _ in runs:
            for size, each in Counter(combination).items():
                rows.append((size * _RANKS + given[size], each, base))
                given[size] += n * each
            base += n
        key, each, first = (np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 3
        found[spec] = key, each, first, planned
    return found


def _ranked(items: DataFrame, key: str) -> DataFrame:
    """``rank`` from 0 among the rows of the same spec and key, without a hot task; ``items`` must be staged."""
    parted = items.withColumn("_part", F.spark_partition_id())
    counts = parted.groupBy("spec_name", key, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("spec_name", key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("spec_name", key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("spec_name", key, "_part").orderBy("doc_id")) - 1
    return parted.withColumn("_local", local).join(offsets, ["spec_name", key, "_part"]).withColumn("rank", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def _place(ranked: DataFrame, slots: dict[str, tuple[np.ndarray, ...]]) -> DataFrame:
    """(spec_name, doc_id, part, tokens, container_id) of ranked items."""
    # A plan has runs of equal containers: their number follows the capacity and the combinations, not the corpus.
    held = ranked.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, doc, part, tokens, rank = (batch.column(i) for i in range(5))
            place = tokens.to_numpy() * _RANKS + rank.to_numpy()
            number = np.zeros(len(batch), np.int64)
            planned = np.zeros(len(batch), bool)
            names_of = names.dictionary_encode()
            code = names_of.indices.to_numpy()
            for i, spec in enumerate(names_of.dictionary.to_pylist()):
                key, each, first, least = held.value[spec]
                mine = np.flatnonzero(code == i)
                at = np.searchsorted(key, place[mine], "right") - 1
                number[mine] = first[at] + (place[mine] - key[at]) // each[at]
                planned[mine] = number[mine] < least
            yield pa.RecordBatch.from_arrays([names, doc, part, tokens, pa.array(number), pa.array(planned)], names=["spec_name", "doc_id", "part", "tokens", "number", "planned"])

    rows = ranked.select("spec_name", "doc_id", "part", "tokens", "rank")
    placed = rows.mapInArrow(run, f"spec_name string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, part int, tokens long, number long, planned boolean")
    kind = F.when(F.col("planned"), F.lit("plan")).otherwise(F.lit("rest"))
    return placed.select("spec_name", "doc_id", "part", "tokens", F.concat_ws("/", "spec_name", kind, F.col("number").cast("string")).alias("container_id"))


def pack(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, doc_id, part, tokens, container_id) from (doc_id, tokens) and (spec_name, capacity_tokens).

    ``specs`` is a short configuration table and comes to the driver.
    """
    capacities = {r[0]: int(r[1]) for r in specs.where("spec_name is not null and capacity_tokens > 0").select("spec_name", "capacity_tokens").distinct().orderBy("spec_name").toLocalIterator()}
    spark = sizes.sparkSession
    if not capacities:
        return spark.createDataFrame([], "spec_name string, doc_id long, part int, tokens long, container_id string")
    known = spark.createDataFrame(list(capacities.items()), "spec_name string, capacity long")
    docs = stage(sizes.where("doc_id is not null").dropDuplicates(["doc_id"]), "p6-sizes")
    each = docs.crossJoin(F.broadcast(known))  # one row per configured spec, a handful
    full = F.floor(F.col("tokens") / F.col("capacity"))
    whole = each.where("tokens >= capacity").withColumn("part", F.explode(F.sequence(F.lit(1), full.cast("int"))))
    whole = whole.select("spec_name", "doc_id", "part", F.col("capacity").alias("tokens"), F.concat_ws("/", "spec_name", F.lit("full"), F.col("doc_id").cast("string"), F.col("part").cast("string")).alias("container_id"))
    none = each.where("tokens = 0").select("spec_name", "doc_id", F.lit(1).alias("part"), "tokens", F.concat("spec_name", F.lit("/empty")).alias("container_id"))
    rest = each.where("tokens % capacity > 0")
    items = stage(rest.select("spec_name", "doc_id", (full + 1).cast("int").alias("part"), (F.col("tokens") % F.col("capacity")).alias("tokens")), "p6-items")

    counts: dict[str, dict[int, int]] = {s: {} for s in capacities}
    for r in items.groupBy("spec_name", "tokens").count().toLocalIterator():  # at most the sum of the capacities
        counts[r.spec_name][r.tokens] = r["count"]
    slots = _slots({s: plan(c, capacities[s]) for s, c in counts.items()})
    return whole.unionByName(none).unionByName(_place(_ranked(items, "tokens"), slots))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, containers, tokens, fill_share, planned_share): how full the containers are, and the share of tokens in containers of the least-squares plan."""
    planned = F.sum(F.when(F.col("container_id").startswith(F.concat("spec_name", F.lit("/plan/"))), F.col("tokens")).otherwise(F.lit(0)))
    used = packed.where("tokens > 0").groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t"), planned.alias("p"))
    used = used.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("p").alias("planned"))
    share = lambda c: F.round(c, 6)
    return used.join(specs.distinct(), "spec_name").select("spec_name", "containers", "tokens", share(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill_share"), share(F.col("planned") / F.col("tokens")).alias("planned_share"))


def checked(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_name, documents, over_full, split): documents placed, containers above the capacity, and documents that fit whole but are split; the last two must be 0."""
    known = specs.where("spec_name is not null and capacity_tokens > 0").distinct()
    loads = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("t")).join(known, "spec_name")
    over = loads.groupBy("spec_name").agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("long")).alias("over_full"))
    parts = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).join(known, "spec_name")
    docs = parts.groupBy("spec_name").agg(F.count("*").alias("documents"), F.sum(((F.col("n") > 1) & (F.col("t") <= F.col("capacity_tokens"))).cast("long")).alias("split"))
    return docs.join(over, "spec_name").select("spec_name", "documents", "over_full", "split")
