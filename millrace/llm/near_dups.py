"""Near-duplicate records with small edits (problem 2).

Two texts are near-duplicates when both have ``MIN_WORDS`` words, their contents
differ, and their distinct word runs overlap by ``threshold`` (Jaccard).

Tiles of records are compared, not all pairs.  A tile holds the records that
agree in one band of ``ROWS`` MinHash values; inside, records are ordered by
size, so that partners lie in neighbouring size bands, and bit counts of hashed
256-bit bitmaps bound the overlap from above: only pairs that cannot be similar
are dropped, by a finer bitmap again before their run hashes are fetched.  What
is left is verified: the sorted arrays of run hashes are
intersected exactly.  Small tiles emit their pairs, which are verified in
joins; large tiles (``HOT_TILE`` records and more) are cut into blocks, carry
the arrays with them, verify in place, and emit a pair in the first band that
the two records share only, so that a huge family of copies is not emitted once
per band.

Words and runs are hashed (64 and 32 bits); a pair of 100-run texts gains a
false common run with probability 3e-6.  MinHash bands find a pair of
similarity s with probability 1 - (1 - s**ROWS)**BANDS: 0.96 at 0.5, 0.997 at
0.6, 0.99999 at 0.8.  For every tenfold growth beyond ``PLAIN_RECORDS`` records
``rows`` grows by one and ``bands`` to ln(0.04)/ln(1 - threshold**rows)
(``banding``), which keeps the tiles small at equal recall.

With ``exact``, as the registered queries run, no pair is missed.  The run
hashes of each class are put in one order, rare ones first (``COUNTERS`` hashed
counters over all classes; the order decides only the cost).  Two similar sets
share a hash among the first n - ceil(2t/(1+t) n) + 1 of the smaller and the
first n - ceil(t n) + 1 of the greater.  These prefixes are shuffled in
``PASSES`` passes, packed in binary rows with 512 parity bits a class; what is
left of both sets at the common hash, then the parity bits bound the overlap
from above, and the pairs that remain are verified as above.

Joins on classes read one row per class, which copies are aggregated to before
any shuffle; joins of records to their class or group deal hot ones over salts.

Defined results: a null id is ignored, a null text is the empty text, repeated
rows count once, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.consolidate import components
from millrace.llm.content import content
from millrace.plans.skew import join_groups
from millrace.plans.staging import stage

MIN_WORDS = 20
RUN_WORDS = 3
THRESHOLD = 0.5
ROWS = 3
BANDS = 24
#: Records up to which ROWS and BANDS hold.
PLAIN_RECORDS = 1_000_000
HOT_TILE = 256
BLOCK = 2048
#: Postings hold sizes up to this one; a pair with a greater record is not bounded by its size.
MOST_RUNS = 0xFFFF
#: The words of a record's bitmap.
MAPS = ["m1", "m2", "m3", "m4"]
#: Bits of the finer bitmap that a pair must pass before its arrays are fetched.
FINE_BITS = 512
#: The exact way: counters of run hashes, and the parts in which they are added up.
COUNTERS = 1 << 24
PARTS = 16
_COUNTER_SHIFT = np.uint32(32 - 24)
#: Postings are shuffled in so many passes, each of them in slots of about SLOT_RECORDS records, so that disk and memory stay bounded.
PASSES = 8
SLOT_RECORDS = 30_000
#: Classes that a task remembers at once.
MOST_SEEN = 500_000
#: Up to so many record hashes (8 bytes each) are broadcast to fetch texts again; beyond, they are shuffled.
BROADCAST_RECORDS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BYTES = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _GOLD
    return x ^ (x >> np.uint64(32))


class _Shingler:
    """Words and word runs of a batch of lower-cased texts, all in arrays."""

    def __init__(self, run_words: int, min_words: int) -> None:
        self.run_words, self.min_words = run_words, min_words
        rng = np.random.default_rng(20)
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.is_word = np.zeros(256, bool)
        self.is_word[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        self.step = int(rng.integers(1, 2**62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.step), ("down", pow(self.step, -1, 1 << 64))):
                line = np.full(n, base, np.uint64)
                line[0] = 1
                setattr(self, name, np.multiply.accumulate(line))

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of each text with enough words, hash of its word sequence, start of its runs, sorted run hashes."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = texts.buffers()[2]
        base, end = int(offsets[0]), int(offsets[-1])
        nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if data is None or end == base:
            return nothing
        raw, offsets = np.frombuffer(data, np.uint8, end - base, base), offsets - base
        ok = self.is_word[raw]
        first, last = ok.copy(), ok.copy()
        first[1:] &= ~ok[:-1]
        last[:-1] &= ~ok[1:]
        inner = offsets[(offsets > 0) & (offsets < len(raw))]
        first[inner] = ok[inner]
        last[inner - 1] = ok[inner - 1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(begin):
            return nothing
        self._powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.up[: len(raw)], out=total[1:])
        word = _mix((total[stop] - total[begin]) * self.down[begin] + (stop - begin).astype(np.uint64))
        text = np.searchsorted(offsets, begin, "right") - 1
        number = np.arange(len(word)) - np.searchsorted(begin, offsets[text])
        words_of = np.bincount(text, minlength=len(texts))
        sequence = np.zeros(len(texts), np.uint64)
        np.add.at(sequence, text, _mix(word + number.astype(np.uint64) * _GOLD))
        n = self.run_words
        run = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for i in range(n):
            run = _mix(run * np.uint64(5) + word[i : i + len(run)] + np.uint64(i))
        of = text[: len(run)]
        inside = (of == text[n - 1 :][: len(run)]) & (words_of[of] >= self.min_words)
        key = np.unique((of[inside].astype(np.uint64) << np.uint64(32)) | (run[inside] >> np.uint64(32)))
        of, run32 = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
        start = np.flatnonzero(np.diff(of, prepend=-1))
        return of[start], sequence[of[start]], start, run32


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded bytes of text."""
    at = 0
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) if len(batch) else np.zeros(0)
    while at < len(batch):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + _CHUNK_BYTES)))
        yield batch.slice(at, to - at)
        at = to


def _class_ids(contents: pa.Array, picked: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    held = contents.to_numpy(zero_copy_only=False).astype(np.int64)[picked].view(np.uint64)
    return _mix(sequence + _mix(held)).view(np.int64)


def banding(records: int, threshold: float) -> tuple[int, int]:
    """Rows and bands for so many records: equal recall at the threshold, tiles that do not grow."""
    more = max(0, math.ceil(math.log10(max(1, records) / PLAIN_RECORDS) - 1e-9))
    if not more:
        return ROWS, BANDS
    return ROWS + more, math.ceil(math.log(0.04) / math.log(1 - threshold ** (ROWS + more)))


def _sketches(rows: int, bands: int, run_words: int, min_words: int):
    """(id, text, content) -> (id, cls, content, runs, mins, m1 to m4, fine) of texts with enough words; ``mins`` holds MinHash values of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _Shingler(run_words, min_words)
        rng = np.random.default_rng(7)
        functions = rows * bands
        factors = rng.integers(0, 2**31, functions, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        terms = rng.integers(0, 2**32, functions, dtype=np.uint32)
        for whole in batches:
            for batch in _slices(whole, 1):
                picked, sequence, start, run32 = shingle(batch.column(1))
                if not len(picked):
                    continue
                n = np.diff(start, append=len(run32))
                mins = np.empty((len(picked), functions), np.uint16)
                for k in range(functions):
                    least = np.minimum.reduceat(run32 * factors[k] + terms[k], start)
                    mins[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
                ends = np.arange(len(picked) + 1) * functions * 2
                maps = _bitmaps(run32, start, n).view(np.int64)
                fine = _bitmaps(run32, start, n, FINE_BITS).view(np.uint8).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(picked)),
                        pa.array(_class_ids(batch.column(2), picked, sequence)),
                        batch.column(2).take(pa.array(picked)),
                        pa.array(n.astype(np.int32)),
                        _binary(mins, ends),
                        *(pa.array(maps[:, i]) for i in range(4)),
                        _binary(fine, np.arange(len(picked) + 1) * (FINE_BITS // 8)),
                    ],
                    names=["id", "cls", "content", "runs", "mins", *MAPS, "fine"],
                )

    return run


def _arrays(run_words: int, min_words: int):
    """(id, text, content) -> (cls, content, runs) with the sorted run hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _Shingler(run_words, min_words)
        for whole in batches:
            for batch in _slices(whole, 1):
                picked, sequence, start, run32 = shingle(batch.column(1))
                if len(picked):
                    ids = pa.array(_class_ids(batch.column(2), picked, sequence))
                    yield pa.RecordBatch.from_arrays([ids, batch.column(2).take(pa.array(picked)), _binary(run32, np.append(start, len(run32)) * 4)], names=["cls", "content", "arr"])

    return run


def _sets(run_words: int, min_words: int):
    """(id, text, content) -> (id, cls, content, runs, arr, fine) of texts with enough words; the arrays stand in a class's first row of a task, elsewhere they are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _Shingler(run_words, min_words)
        seen: set[int] = set()
        for whole in batches:
            for batch in _slices(whole, 1):
                picked, sequence, start, run32 = shingle(batch.column(1))
                if not len(picked):
                    continue
                n = np.diff(start, append=len(run32))
                cls = _class_ids(batch.column(2), picked, sequence)
                if len(seen) > MOST_SEEN:
                    seen.clear()
                first = np.fromiter((not (c in seen or seen.add(c)) for c in cls.tolist()), bool, len(cls))
                ends = np.concatenate([[0], np.cumsum(n * first)]) * 4
                fine = _parities(run32, start, n)[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(picked)),
                        pa.array(cls),
                        batch.column(2).take(pa.array(picked)),
                        pa.array(n.astype(np.int32)),
                        _binary(run32[np.repeat(first, n)], ends),
                        _binary(fine, np.concatenate([[0], np.cumsum(first)]) * (FINE_BITS // 8)),
                    ],
                    names=["id", "cls", "content", "runs", "arr", "fine"],
                )

    return run


def _parities(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FINE_BITS bits of each array: whether an odd number of its hashes falls to the bit. Two arrays differ in at least as many hashes as bits."""
    row = np.repeat(np.arange(len(at)), n)
    index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    bit = (data[index] * np.uint32(0x85EBCA6B)) >> np.uint32(33 - FINE_BITS.bit_length())
    odd = np.bincount(row * FINE_BITS + bit, minlength=len(at) * FINE_BITS).astype(np.uint8) & np.uint8(1)
    return np.packbits(odd).view(np.uint64).reshape(len(at), FINE_BITS // 64)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(arr) -> (part, k, n): the task's counters that are not 0, in PARTS parts."""
    table = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        if len(batch):
            k, n = np.unique(_held(batch.column(0))[0] >> _COUNTER_SHIFT, return_counts=True)
            table[k] += n.astype(np.uint32)
    size = COUNTERS // PARTS
    for part in range(PARTS):
        some = table[part * size : (part + 1) * size]
        k = np.flatnonzero(some)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k.astype(np.uint32).tobytes()], pa.binary()), pa.array([some[k].tobytes()], pa.binary())], names=["part", "k", "n"])


def _weights(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of a part on a scale of logarithms, a byte each."""
    total = np.zeros(COUNTERS // PARTS, np.int64)
    for k, n in zip(table.column("k").to_pylist(), table.column("n").to_pylist()):
        total[np.frombuffer(k, np.uint32)] += np.frombuffer(n, np.uint32)
    scale = np.minimum(255, 8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([scale.tobytes()], pa.binary())})


def _postings(weights, threshold: float, this: int, passes: int, slots: int):
    """(cls, arr, fine) -> (slot, tile, who, pos, cls, n, fine): this pass's postings of the prefixes, packed by slot.

    A posting is a run hash, the place of its record in the row and its position in
    the record's order; records are held once a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(weights.value, np.uint8)
        for whole in batches:
            for begin in range(0, len(whole), 0xFFFF):
                batch = whole.slice(begin, 0xFFFF)
                data, at, n = _held(batch.column(1))
                key = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(40), n) | (weight[data >> _COUNTER_SHIFT].astype(np.uint64) << np.uint64(32)) | data
                key.sort()
                pos = np.arange(len(key)) - np.repeat(at, n)
                kept = pos < np.repeat(n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1, n)
                key, pos = key[kept], pos[kept]
                tile = key.astype(np.uint32)
                slot = ((tile * np.uint32(0xC2B2AE35)) >> np.uint32(8)) % np.uint32(passes * slots)
                mine = np.flatnonzero(slot // np.uint32(slots) == this)
                if not len(mine):
                    continue
                mine = mine[np.argsort(slot[mine].astype(np.uint16) if passes * slots <= 0xFFFF else slot[mine], kind="stable")]
                tile, slot, rec, pos = tile[mine], slot[mine], (key[mine] >> np.uint64(40)).astype(np.int64), pos[mine]
                head = np.flatnonzero(np.diff(slot.astype(np.int64), prepend=-1))
                new = np.ones(len(rec), bool)
                new[1:] = (rec[1:] != rec[:-1]) | (slot[1:] != slot[:-1])
                number = np.cumsum(new) - 1
                who = number - np.repeat(number[head], np.diff(head, append=len(rec)))
                held, ends, places = rec[new], np.append(head, len(rec)), np.append(number[head], number[-1] + 1)
                cls = batch.column(0).to_numpy(zero_copy_only=False)
                fine = _held(batch.column(2))[0].reshape(len(n), -1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[head].astype(np.int32)),
                        _binary(tile, ends * 4),
                        _binary(who.astype(np.uint16), ends * 2),
                        _binary(np.minimum(pos, 0xFFFF).astype(np.uint16), ends * 2),
                        _binary(cls[held], places * 8),
                        _binary(n[held].astype(np.uint32), places * 4),
                        _binary(fine[held], places * (FINE_BITS // 8)),
                    ],
                    names=["slot", "tile", "who", "pos", "cls", "n", "fine"],
                )

    return run


def _slot_pairs(threshold: float):
    """The postings of one slot -> its pairs of classes that can be similar."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        cls, n, fine = column("cls", np.int64), column("n", np.uint32).astype(np.int64), column("fine", np.uint64).reshape(-1, FINE_BITS // 64)
        tile, pos = column("tile", np.uint32), column("pos", np.uint16).astype(np.int64)
        records = np.array([len(x) // 8 for x in table.column("cls").to_pylist()])
        postings = np.array([len(x) // 4 for x in table.column("tile").to_pylist()])
        who = column("who", np.uint16) + np.repeat(np.cumsum(records) - records, postings)
        # Classes in order of size, each once though several tasks hold it.
        order = np.lexsort((cls, n))
        fresh = np.ones(len(order), bool)
        fresh[1:] = cls[order[1:]] != cls[order[:-1]]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        order = order[fresh]
        cls, n, fine = cls[order], n[order], fine[order]
        packed = (tile.astype(np.uint64) << np.uint64(32)) | rank[who].astype(np.uint64)
        sort = np.argsort(packed)
        packed, pos = packed[sort], pos[sort]
        once = np.ones(len(packed), bool)
        once[1:] = packed[1:] != packed[:-1]
        packed, pos = packed[once], pos[once]
        tile, who = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = n[who]
        rest = size - pos
        # The smaller record of a pair shares a hash of its first n - ceil(2t/(1+t) n) + 1, the greater one of its whole prefix.
        alive = np.flatnonzero(pos <= size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64))
        found, held, d = [], 0, 0
        while len(alive):
            d += 1
            alive = alive[alive + d < len(tile)]
            other = alive + d
            near = (tile[alive] == tile[other]) & (size[alive] >= threshold * size[other])
            alive, other = alive[near], other[near]
            total, most = size[alive] + size[other], np.minimum(rest[alive], rest[other])
            maybe = np.flatnonzero(most >= threshold * (total - most))
            a, b, total = who[alive[maybe]], who[other[maybe]], total[maybe]
            apart = np.zeros(len(a), np.int64)
            for half in (slice(0, FINE_BITS // 128), slice(FINE_BITS // 128, None)):
                apart += np.bitwise_count(fine[a, half] ^ fine[b, half]).sum(1, dtype=np.int64)
                maybe = np.flatnonzero(_possible(total, apart, threshold))
                a, b, total, apart = a[maybe], b[maybe], total[maybe], apart[maybe]
            if len(a):
                found.append((a << 32) | b)
                held += len(a)
                if held > 4_000_000:  # the same pair comes once for each hash that it shares
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        x, y = cls[pairs >> 32], cls[pairs & 0xFFFFFFFF]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _possible(total: np.ndarray, apart: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs can reach the threshold, by the sum of their sizes and the bits in which their bitmaps differ."""
    most = (total - apart) // 2
    return most >= threshold * (total - most)


def _tiles(threshold: float, hot_tile: int, block: int):
    """Postings sorted by (tile, size) -> pairs of small tiles and rows of large tiles with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] = []
        hot, seen = None, 0

        def out(large: bool, a: np.ndarray, b: np.ndarray, blk: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), large)), pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32) if blk is None else blk.astype(np.int32))],
                names=["large", "a", "b", "blk"],
            )

        def pairs(tile: np.ndarray, size: np.ndarray, cls: np.ndarray, *maps: np.ndarray) -> Iterator[pa.RecordBatch]:
            alive = np.arange(len(tile))
            for d in range(1, hot_tile):
                alive = alive[alive + d < len(tile)]
                alive = alive[(tile[alive] == tile[alive + d]) & (size[alive] >= threshold * size[alive + d])]
                if not len(alive):
                    break
                other = alive + d
                apart = sum(np.bitwise_count(m[alive] ^ m[other]).astype(np.int64) for m in maps)
                close = (_possible(size[alive] + size[other], apart, threshold) | (size[other] >= MOST_RUNS)) & (cls[alive] != cls[other])
                if close.any():
                    x, y = cls[alive[close]], cls[other[close]]
                    yield out(False, np.minimum(x, y), np.maximum(x, y))

        def cut(rows: list[np.ndarray], final: bool) -> Iterator[pa.RecordBatch]:
            """Treats all runs but the last, or all; leaves the rest in carry. Hot runs pass through."""
            nonlocal carry, hot, seen
            tile = rows[0]
            if not len(tile):
                return
            start = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1))
            length = np.diff(start, append=len(tile))
            large = (length >= hot_tile) | (tile[start] == hot if hot is not None else False)
            closed = np.ones(len(start), bool)
            closed[-1] = final or bool(large[-1])
            position = np.arange(len(tile)) - np.repeat(start, length)
            if hot is not None and tile[0] == hot:
                position[: length[0]] += seen
            is_large = np.repeat(large, length)
            if is_large.any():
                yield out(True, tile[is_large], rows[2][is_large], position[is_large] // block)
            is_small = ~is_large & np.repeat(closed, length)
            if is_small.any():
                yield from pairs(*(x[is_small] for x in rows))
            if large[-1]:
                hot, seen = tile[-1], int(position[-1]) + 1
            else:
                hot = None
            carry = [x[np.repeat(~closed, length)] for x in rows]

        for batch in batches:
            packed, cls, *maps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = [packed >> 16, packed & MOST_RUNS, cls, *(m.view(np.uint64) for m in maps)]
            if carry and len(carry[0]):
                rows = [np.concatenate(x) for x in zip(carry, rows)]
            carry = []
            yield from cut(rows, False)
        if carry and len(carry[0]):
            yield from cut(carry, True)

    return run


def _overlaps(a_data: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b_data: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sorted arrays, by one merge over all pairs."""
    found = np.zeros(len(a_at), np.int64)
    each = np.cumsum(a_len + b_len)
    lo = 0
    while lo < len(a_at):
        hi = max(lo + 1, int(np.searchsorted(each, (each[lo - 1] if lo else 0) + 2_000_000)))
        keys = []
        for data, at, n in ((a_data, a_at[lo:hi], a_len[lo:hi]), (b_data, b_at[lo:hi], b_len[lo:hi])):
            pair = np.repeat(np.arange(hi - lo), n)
            index = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
            keys.append((pair.astype(np.uint64) << np.uint64(32)) | data[index])
        merged = np.sort(np.concatenate(keys), kind="stable")
        common = merged[1:][merged[1:] == merged[:-1]] >> np.uint64(32)
        found[lo:hi] = np.bincount(common.astype(np.int64), minlength=hi - lo)
        lo = hi
    return found


def _bitmaps(data: np.ndarray, at: np.ndarray, n: np.ndarray, bits: int = 256) -> np.ndarray:
    """A hashed bitmap of each array; ``bits`` is a power of two."""
    row = np.repeat(np.arange(len(at)), n)
    index = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
    bit = (data[index] * np.uint32(0x85EBCA6B)) >> np.uint32(33 - bits.bit_length())
    flags = np.zeros(len(at) * bits, bool)
    flags[row * bits + bit] = True
    return np.packbits(flags).view(np.uint64).reshape(len(at), bits // 64)


def _held(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start and length of binary cells that hold uint32 arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    whole = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(whole.tobytes(), np.uint32), (offsets[:-1] - offsets[0]) // 4, np.diff(offsets) // 4


def _similar(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, threshold: float, maps: tuple | None = None) -> np.ndarray:
    """Which pairs (a[x], b[y]) reach the threshold: bound by bit counts, then exact."""
    (a_data, a_at, a_n), (b_data, b_at, b_n) = a, b
    a_map, b_map = maps if maps else (_bitmaps(*a), _bitmaps(*b))
    apart = np.bitwise_count(a_map[x] ^ b_map[y]).sum(1, dtype=np.int64)
    total = a_n[x] + b_n[y]
    maybe = np.flatnonzero(_possible(total, apart, threshold))
    x, y, total = x[maybe], y[maybe], total[maybe]
    common = _overlaps(a_data, a_at[x], a_n[x], b_data, b_at[y], b_n[y])
    return maybe[common >= threshold * (total - common)]


def _bounded(threshold: float):
    """(a, b, runs_a, runs_b, fine_a, fine_b) -> (a, b) of the pairs that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            total = sum(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            x, y = (_held(batch.column(i))[0].reshape(len(batch), -1) for i in (4, 5))
            keep = pa.array(np.flatnonzero(_possible(total, np.bitwise_count(x ^ y).sum(1, dtype=np.int64), threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _verify(threshold: float):
    """(a, b, arr_a, arr_b) -> (a, b) of the similar pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            every = np.arange(len(batch))
            keep = pa.array(_similar(_held(batch.column(2)), _held(batch.column(3)), every, every, threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _large_tiles(threshold: float, rows: int):
    """One block pair of a large tile -> its similar pairs whose first common band is this one."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        band, p, q = (k.as_py() for k in key[1:])
        blk = table.column("blk").to_numpy()
        held = _held(table.column("arr"))
        maps = _bitmaps(*held)
        cls, contents = table.column("cls").to_numpy(), table.column("content").to_numpy()
        mins = np.frombuffer(b"".join(table.column("mins").to_pylist()), np.uint16).reshape(len(cls), -1, rows)
        left, right = np.flatnonzero(blk == p), np.flatnonzero(blk == q)
        found_a, found_b = [], []
        for i in left:
            other = right[right > i] if p == q else right
            n = held[2]
            near = np.minimum(n[i], n[other]) >= threshold * np.maximum(n[i], n[other])
            near &= (cls[other] != cls[i]) & (contents[other] != contents[i])
            other = other[near]
            if len(other) and band:
                other = other[~(mins[other, :band] == mins[i, :band]).all(2).any(1)]
            if len(other):
                other = other[_similar(held, held, np.full(len(other), i), other, threshold, (maps, maps))]
                found_a.append(np.minimum(cls[i], cls[other]))
                found_b.append(np.maximum(cls[i], cls[other]))
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *found_a]), "b": np.concatenate([empty, *found_b])})

    return run


class NearDuplicates:
    """The staged parts of one run: ``members`` (id, cls) and ``pairs`` (a, b) of classes.

    A class is all records with the same content and the same words in order;
    pairs link classes of different content.  ``rows`` and ``bands`` follow the
    number of records unless given.  ``min_agree`` has no effect any more: it
    belonged to a signature that lost pairs.
    """

    def __init__(
        self, records: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = THRESHOLD, run_words: int = RUN_WORDS,
        min_words: int = MIN_WORDS, rows: int | None = None, bands: int | None = None, min_agree: int = 0, hot_tile: int = HOT_TILE, block: int = BLOCK, exact: bool = False,
    ) -> None:
        texts = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        texts = texts.where(F.length("text") >= 2 * min_words - 1)
        if exact:
            self._compare(texts, threshold, run_words, min_words)
            return
        if rows is None or bands is None:
            derived = banding(records.count(), threshold)
            rows, bands = rows or derived[0], bands or derived[1]
        held = F.xxhash64(content(F.col("text"))).alias("content")
        self.sketches = stage(
            texts.select("id", F.lower("text").alias("text"), held).mapInArrow(
                _sketches(rows, bands, run_words, min_words), "id string, cls long, content long, runs int, mins binary, m1 long, m2 long, m3 long, m4 long, fine binary"
            ),
            "p2-sketches",
        )
        one_each = self.sketches.select("cls", "runs", "mins", *MAPS).dropDuplicates(["cls"])
        tiles = F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(i), F.expr(f"substring(mins, {2 * i * rows + 1}, {2 * rows})")), 17) for i in range(bands)])
        size = F.least(F.col("runs"), F.lit(MOST_RUNS)).cast("long")
        postings = one_each.select("cls", *MAPS, size.alias("size"), F.explode(tiles).alias("tile"))
        postings = postings.select(F.shiftleft("tile", 16).bitwiseOR(F.col("size")).alias("packed"), "cls", *MAPS)
        candidates = stage(
            postings.repartition(F.shiftright("packed", 16)).sortWithinPartitions("packed").mapInArrow(_tiles(threshold, hot_tile, block), "large boolean, a long, b long, blk int"),
            "p2-candidates",
        )
        coarse = stage(candidates.where("not large").select("a", "b").distinct(), "p2-coarse")
        paired = coarse.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        fine = stage(self.sketches.select("cls", "runs", "content", "fine").dropDuplicates(["cls"]).join(paired, "cls", "left_semi"), "p2-fine")
        side = lambda c: fine.select(F.col("cls").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("runs", "content", "fine")))
        bounded = coarse.join(side("a"), "a").join(side("b"), "b").where("content_a <> content_b").select("a", "b", "runs_a", "runs_b", "fine_a", "fine_b")
        small = stage(bounded.mapInArrow(_bounded(threshold), "a long, b long"), "p2-pairs")
        large = candidates.where("large").select(F.col("a").alias("tile"), F.col("b").alias("cls"), "blk")
        wanted = stage(small.select(F.explode(F.array("a", "b")).alias("cls")).union(large.select("cls")).distinct(), "p2-wanted")
        ids = stage(
            self.sketches.groupBy("cls").agg(F.min(F.xxhash64("id")).alias("h")).join(wanted, "cls", "left_semi").select("h"), "p2-ids"
        )
        fetched = texts.withColumn("h", F.xxhash64("id"))
        fetched = fetched.join(F.broadcast(ids) if ids.count() <= BROADCAST_RECORDS else ids, "h", "left_semi")
        arrays = stage(
            fetched.select("id", F.lower("text").alias("text"), held).mapInArrow(_arrays(run_words, min_words), "cls long, content long, arr binary"), "p2-arrays"
        )
        first = small.join(arrays.select(F.col("cls").alias("a"), F.col("content").alias("content_a"), F.col("arr").alias("arr_a")), "a")
        both = first.join(arrays.select(F.col("cls").alias("b"), F.col("content").alias("content_b"), F.col("arr").alias("arr_b")), "b").where("content_a <> content_b")
        verified = both.select("a", "b", "arr_a", "arr_b").mapInArrow(_verify(threshold), "a long, b long")
        tiled = stage(large.select("cls").distinct(), "p2-tiled")
        count = tiled.count()
        if count:
            verified = verified.union(self._in_place(large, F.broadcast(tiled) if count <= BROADCAST_RECORDS else tiled, arrays, tiles, threshold, rows))
        self.pairs = stage(verified.distinct(), "p2-similar")

    def _compare(self, texts: DataFrame, threshold: float, run_words: int, min_words: int) -> None:
        """The exact way: classes that share a hash of their prefixes, bounded by positions and parity bits, then verified."""
        spark = texts.sparkSession
        held = F.xxhash64(content(F.col("text"))).alias("content")
        self.sketches = stage(
            texts.select("id", F.lower("text").alias("text"), held).mapInArrow(_sets(run_words, min_words), "id string, cls long, content long, runs int, arr binary, fine binary"),
            "p2-sketches",
        )
        sets = self.sketches.where(F.octet_length("arr") > 0)
        counted = sets.select("arr").mapInArrow(_count_runs, "part int, k binary, n binary").groupBy("part").applyInArrow(_weights, "part int, w binary")
        table = np.zeros((PARTS, COUNTERS // PARTS), np.uint8)
        for row in stage(counted, "p2-weights").toLocalIterator():
            table[row.part] = np.frombuffer(row.w, np.uint8)
        weights = spark.sparkContext.broadcast(table.tobytes())
        slots = max(12, -(-self.sketches.count() // SLOT_RECORDS))
        found = []
        for this in range(PASSES):
            posted = sets.select("cls", "arr", "fine").mapInArrow(_postings(weights, threshold, this, PASSES, slots), "slot int, tile binary, who binary, pos binary, cls binary, n binary, fine binary")
            found.append(stage(posted.groupBy("slot").applyInArrow(_slot_pairs(threshold), "a long, b long").distinct(), "p2-candidates"))
        small = stage(reduce(DataFrame.union, found).distinct(), "p2-pairs")
        wanted = stage(small.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "p2-wanted")
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_RECORDS else wanted
        arrays = stage(sets.select("cls", "content", "arr").join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "p2-arrays")
        side = lambda c: arrays.select(F.col("cls").alias(c), F.col("content").alias(f"content_{c}"), F.col("arr").alias(f"arr_{c}"))
        both = small.join(side("a"), "a").join(side("b"), "b").where("content_a <> content_b")
        self.pairs = stage(both.select("a", "b", "arr_a", "arr_b").mapInArrow(_verify(threshold), "a long, b long"), "p2-similar")

    def _in_place(self, large: DataFrame, tiled: DataFrame, arrays: DataFrame, tiles: Column, threshold: float, rows: int) -> DataFrame:
        """Similar pairs of the large tiles, block by block."""
        sketched = self.sketches.select("cls", "mins").dropDuplicates(["cls"]).join(tiled, "cls", "left_semi")
        payload = sketched.join(arrays.join(tiled, "cls", "left_semi").dropDuplicates(["cls"]), "cls")
        blocks = large.groupBy("tile").agg(F.max("blk").alias("last"))
        carried = large.join(blocks, "tile").join(payload, "cls").withColumn("band", F.array_position(tiles, F.col("tile")).cast("int") - 1)
        carried = carried.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last"))))
        carried = carried.withColumn("p", F.least("blk", "o")).withColumn("q", F.greatest("blk", "o"))
        return (
            carried.select("tile", "band", "p", "q", "blk", "cls", "content", "mins", "arr")
            .groupBy("tile", "band", "p", "q")
            .applyInArrow(_large_tiles(threshold, rows), "a long, b long")
        )

    def _of_classes(self, classes: DataFrame) -> DataFrame:
        """The distinct records of these classes (one row per ``cls``) with the classes' columns; a hot class is dealt over salts."""
        members = self.sketches.select("id", "cls")
        sizes = members.groupBy("cls").agg(F.count("*").alias("_size"))
        return join_groups(members, stage(sizes.join(classes, "cls"), "p2-classes"), "cls", "_size", F.col("id")).drop("_size").distinct()

    @property
    def members(self) -> DataFrame:
        return self.sketches.select("id", "cls").distinct()

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b): every similar pair of records of different content, id_a < id_b."""
        linked = self.pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        members = stage(self._of_classes(linked).select("id", "cls"), "p2-members")
        a = members.select(F.col("cls").alias("a"), F.col("id").alias("x"))
        b = members.select(F.col("cls").alias("b"), F.col("id").alias("y"))
        pairs = self.pairs.join(a, "a").join(b, "b").where("x <> y")
        return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): each record that is linked, its group, and its number of linked classes."""
        both = self.pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(self.pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
        links = both.groupBy("cls").agg(F.count("*").alias("n_links"))
        least = stage(self._of_classes(links).select("cls", "id", "n_links"), "p2-linked")
        chain = stage(components(self.pairs), "p2-groups").select(F.col("id").cast("long").alias("cls"), F.col("group_id").cast("long").alias("g"))
        grouped = least.groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(chain, "cls", "left").withColumn("g", F.coalesce("g", "cls"))
        grouped = stage(grouped, "p2-grouped")
        heads = stage(grouped.groupBy("g").agg(F.min("id").alias("group_id"), F.count("*").alias("classes")), "p2-heads")
        named = stage(join_groups(grouped, heads, "g", "classes", F.col("cls")).select("cls", "group_id", "n"), "p2-named")
        return join_groups(least, named, "cls", "n", F.col("id")).select("id", "group_id", "n_links")
