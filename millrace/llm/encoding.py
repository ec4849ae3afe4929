"""Garbled text from wrong character encoding (problem 5).

Character trigram counts are taken over all records without visible damage (no
replacement or C1 control character, no passage that decodes as UTF-8 through
another code page); only trigrams that hold a non-ASCII character matter.  All
of them count: they share ``BUCKETS`` hashed counters, which bounds the model
whatever the corpus.  Passages (lines and sentences) with non-ASCII characters
are then scored under the smoothed model as they stand and after every candidate
chain of encoding with the wrong code page and decoding with the right one, up
to three times in a row.  The likeliest reading is taken where it beats the text
as it stands by a margin.

Chains that end in UTF-8 are nearly proven by decoding at all, so their margin
is low; chains between single-byte code pages always decode, so they are tried
only on passages that the model finds unlikely and need a high margin, the
higher the fewer letters speak for it.  Both margins are validated on every run:
all clean passages are scored as they are, and a margin that any of them exceeds
is raised.  ``margins`` also garbles all of them deliberately.

Defined results: a null id is ignored; a null, empty or pure ASCII text is
never a case; repeated rows of an id count once; U+FFFD marks a case that
cannot be restored; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.staging import stage

#: Code pages by which text is wrongly decoded, and rightly.
WRONG = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp1253", "iso8859-7", "cp1254", "cp437", "cp850", "cp852", "mac-roman", "koi8-r", "cp866", "iso8859-15")
SINGLE_WRONG = ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1253", "iso8859-7", "mac-roman", "mac-cyrillic", "cp437", "cp850")
SINGLE_RIGHT = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1252", "cp1250", "iso8859-2", "cp1253", "iso8859-7", "mac-roman", "cp437", "cp850")

#: Hashed counters of trigrams: 8 MB on the driver, 4 MB for each task. Counters of single characters follow them.
BUCKETS = 1 << 20
#: Clean passages that a task remembers, so that repeated ones are scored once.
MOST_SEEN = 200_000
#: Least gain in mean log probability per trigram.
MARGIN_UTF8 = 0.2
MARGIN_SINGLE = 2.0
#: Single-byte chains are tried on passages below this mean log probability; with fewer non-ASCII letters the margin grows in proportion.
UNLIKELY = -9.0
MIN_LETTERS = 5
ALPHA = 0.01

_PASSAGE = re.compile(r"[^\n]+?(?:[.!?;…]+(?=[ \n]|$)|\n|$)")
_ODD = re.compile("[�\x80-\x84\x86-\x9f]")


def _code_page(name: str) -> tuple[str, object]:
    """Decoding table with unassigned bytes as control characters, and its inverse."""
    table = "".join(bytes([i]).decode(name, "replace") if bytes([i]).decode(name, "ignore") else chr(i) for i in range(256))
    return table, codecs.charmap_build(table)


class Chains:
    """Candidate encode-decode chains."""

    def __init__(self) -> None:
        pages = {name: _code_page(name) for name in {*WRONG, *SINGLE_WRONG, *SINGLE_RIGHT}}
        self.utf8 = [(name, pages[name][1]) for name in WRONG]
        self.single = [(w, r, pages[w][1], pages[r][0]) for w in SINGLE_WRONG for r in SINGLE_RIGHT if w != r]
        self.swapped: dict[str, np.ndarray] = {}

    def to_utf8(self, text: str) -> list[str]:
        """All readings of the text as UTF-8 bytes decoded by a wrong code page."""
        found = []
        for _, inverse in self.utf8:
            try:
                read = codecs.charmap_encode(text, "strict", inverse)[0].decode()
            except UnicodeError:
                continue
            if read != text and read not in found:
                found.append(read)
        return found

    def deep(self, text: str, depth: int = 3) -> list[str]:
        found, last = [], [text]
        for _ in range(depth):
            last = [r for t in last for r in self.to_utf8(t) if r not in found]
            if not last:
                break
            found += last
        return found

    def to_single(self, text: str) -> list[str]:
        found = set()
        for _, _, inverse, table in self.single:
            try:
                found.add(codecs.charmap_decode(codecs.charmap_encode(text, "strict", inverse)[0], "strict", table)[0])
            except UnicodeError:
                continue
        found.discard(text)
        return list(found)

    def swaps(self, signs: str) -> np.ndarray:
        """What the non-ASCII signs turn into by each single-byte chain, a row for each reading; ASCII stays as it is."""
        if signs not in self.swapped:
            if len(self.swapped) > 20_000:
                self.swapped.clear()
            read = sorted(self.to_single(signs))
            self.swapped[signs] = np.array([[ord(c) for c in r] for r in read], np.uint64).reshape(len(read), len(signs))
        return self.swapped[signs]


def _trigrams(text: str) -> Iterator[str]:
    padded = f" {text} "
    for i in range(len(padded) - 2):
        t = padded[i : i + 3]
        if not t.isascii():
            yield t


def _shape(text: str) -> str:
    """Digits and ASCII names matter little beside the foreign characters."""
    return re.sub(r"[A-Za-z0-9]{9,}", "x", text)


def _bucket(t: str) -> int:
    a, b, c = map(ord, t)
    x = (a * 0x9E3779B1 + b) * 0x85EBCA6B + c
    x = (x ^ (x >> 29)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
    return (x >> 32) & (BUCKETS - 1)


def _buckets(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``_bucket`` of arrays of signs; the product has up to 85 bits."""
    low, k = np.uint64(0xFFFFFFFF), np.uint64(0x85EBCA6B)
    y = a * np.uint64(0x9E3779B1) + b
    least = (y & low) * k + c
    mid = (least >> np.uint64(32)) + (y >> np.uint64(32)) * k
    x = (mid << np.uint64(32)) | (least & low)
    x ^= (x >> np.uint64(29)) | ((mid >> np.uint64(32)) << np.uint64(35))
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) & np.uint64(BUCKETS - 1)


class Model:
    """Add-alpha smoothed trigram probabilities, backed by the share of the characters.

    ``counts`` holds the trigrams' buckets, then one count per character.  A
    bucket seen once counts as unseen: its one passage may be the one scored.
    """

    def __init__(self, counts: np.ndarray) -> None:
        trigrams, singles = counts[:BUCKETS], counts[BUCKETS:]
        total, chars = trigrams.sum() + 1.0, singles.sum() + 1.0
        self.logs = np.where(trigrams > 1, np.log((trigrams + ALPHA) / total), 1.0).astype(np.float32)
        self.unseen = math.log(ALPHA / total)
        self.chars = np.log(np.where(singles > 0, singles, 0.1) / chars).astype(np.float32)
        self.cache: dict[str, float] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> Model:
        """The model of counted trigrams."""
        table = np.zeros(BUCKETS + 0x110000, np.int64)
        for t, n in counts.items():
            table[_bucket(t)] += n
            for c in t:
                table[BUCKETS + ord(c)] += n
        return cls(table)

    def log(self, t: str) -> float:
        value = self.cache.get(t)
        if value is None:
            value = float(self.logs[_bucket(t)])
            if value > 0:
                value = max(self.unseen - 1.0, float(sum(self.chars[ord(c)] for c in t)) - 2.0)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[t] = value
        return value

    def score(self, text: str) -> float:
        """Mean log probability of the trigrams that hold a non-ASCII character; 0 if there are none."""
        values = [self.log(t) for t in _trigrams(text)]
        return sum(values) / len(values) if values else 0.0


def _single_gain(model: Model, chains: Chains, text: str, base: float) -> float:
    """What the best reading between single-byte code pages gains over ``base``; 0 at least."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    foreign = codes > 127
    signs, which = np.unique(codes[foreign], return_inverse=True)
    maps = chains.swaps("".join(map(chr, signs.tolist())))
    if not len(maps):
        return 0.0
    rows = np.repeat(codes[None], len(maps), 0)
    rows[:, foreign] = maps[:, which]
    start = np.flatnonzero(foreign[:-2] | foreign[1:-1] | foreign[2:])
    a, b, c = rows[:, start], rows[:, start + 1], rows[:, start + 2]
    value = model.logs[_buckets(a, b, c)]
    missing = value > 0
    if missing.any():
        value[missing] = np.maximum(model.unseen - 1.0, model.chars[a[missing]] + model.chars[b[missing]] + model.chars[c[missing]] - 2.0)
    return max(0.0, float(value.mean(1, dtype=np.float64).max()) - base)


def passages(text: str) -> list[tuple[int, int]]:
    """Spans of the text's lines and sentences that hold a non-ASCII character."""
    return [m.span() for m in _PASSAGE.finditer(text) if not m.group().isascii()]


def _foreign_signs(text: str) -> int:
    """Signs beyond ASCII that are letters, or that damaged letters turn into."""
    return sum(1 for c in text if ord(c) > 127 and (c.isalpha() or ord(c) < 0xC0 or 0x2500 <= ord(c) < 0x25A0))


class Repairer:
    """Finds and restores garbled passages."""

    def __init__(self, model: Model, margin_utf8: float = MARGIN_UTF8, margin_single: float = MARGIN_SINGLE) -> None:
        self.model, self.chains = model, Chains()
        self.margin_utf8, self.margin_single = margin_utf8, margin_single
        #: The most that a clean passage gained by a single-byte chain so far.
        self.clean_gain = 0.0
        self.decodes = False
        self.seen: set[str] = set()

    def _best(self, text: str, readings: list[str], margin: float) -> str | None:
        if not readings:
            return None
        base = self.model.score(text)
        value, best = max((self.model.score(r) if not r.isascii() else -4.0, r) for r in readings)
        return best if value > base + margin else None

    def _utf8(self, text: str) -> str | None:
        readings = self.chains.deep(text)
        self.decodes |= bool(readings)
        if not readings and "Ã " in text + " ":
            readings = self.chains.deep((text + " ").replace("Ã ", "Ã ").rstrip(" "))
        return self._best(text, readings, self.margin_utf8)

    def passage(self, text: str) -> tuple[bool, str, bool]:
        """Is the passage garbled, its best reading, and is anything lost."""
        if "�" in text:
            return True, text, True
        self.decodes = False
        read = self._utf8(text)
        if read is not None:
            return True, read, False
        words = re.split("([ \t]+)", text)
        hit = False
        for i, w in enumerate(words):
            if w and not w.isascii():
                read = self._utf8(w)
                if read is not None:
                    words[i], hit = read, True
        if hit:
            return True, "".join(words), False
        letters = _foreign_signs(text)
        score = self.model.score(text)
        if letters and score < UNLIKELY:
            read = self._best(text, self.chains.to_single(text), self.margin_single * max(1.0, MIN_LETTERS / letters))
            if read is not None:
                return True, read, False
            swapped = text.swapcase()
            if len(swapped) == len(text) and self._utf8(swapped) is not None:
                return True, text, True
        if _ODD.search(text):
            return True, text, True
        if not self.decodes and letters >= MIN_LETTERS and score >= UNLIKELY and text not in self.seen:
            if len(self.seen) > MOST_SEEN:
                self.seen.clear()
            self.seen.add(text)
            self.clean_gain = max(self.clean_gain, _single_gain(self.model, self.chains, text, score))
        return False, text, False

    def text(self, text: str) -> tuple[bool, str, bool]:
        out, at, garbled, lost = [], 0, False, False
        for s, e in passages(text):
            bad, read, gone = self.passage(text[s:e])
            garbled |= bad
            lost |= gone
            out += [text[at:s], read]
            at = e
        return garbled, "".join([*out, text[at:]]), lost


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    chains = Chains()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if _ODD.search(text):
                continue
            for s, e in passages(text):
                part = text[s:e]
                if any(chains.to_utf8(w) for w in {part, *part.split(" ")} if not w.isascii()):
                    continue
                counts.update(_trigrams(part))
    table: Counter[int] = Counter()
    for t, n in counts.items():
        table[_bucket(t)] += n
        for c in t:
            table[BUCKETS + ord(c)] += n
    keys = list(table)
    for i in range(0, len(keys), 50_000):
        some = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([table[k] for k in some], pa.int64())], names=["k", "n"])


def _undamaged(text: str, chains: Chains) -> Iterator[str]:
    """The passages without visible damage."""
    for s, e in passages(text):
        part = text[s:e]
        if not _ODD.search(part) and not any(chains.to_utf8(w) for w in {part, *part.split(" ")} if not w.isascii()):
            yield part


def _gain(model: Model, text: str, readings: list[str]) -> tuple[float, str]:
    """What the best reading gains, and the reading."""
    value, best = max((model.score(r) if not r.isascii() else -4.0, r) for r in readings)
    return value - model.score(text), best


def _gains(model: Model, chains: Chains, text: str) -> tuple[float, float]:
    """What a clean passage gains by its best chain to UTF-8 and between single-byte code pages; 0 at least."""
    held = chains.deep(text)
    utf8 = max(0.0, _gain(model, text, held)[0]) if held else 0.0
    return utf8, _single_gain(model, chains, text, model.score(text)) if _foreign_signs(text) >= MIN_LETTERS else 0.0


def _raised(utf8: float, single: float) -> tuple[float, float]:
    """The margins that no such gain exceeds."""
    return max(MARGIN_UTF8, utf8 + 0.05), max(MARGIN_SINGLE, single + 0.05)


def _restored(model: Model, chains: Chains, pages: dict, text: str, i: int, margins: tuple[float, float]) -> tuple[bool | None, bool | None]:
    """Is the passage restored after it was garbled by the i-th chain of each sort; None where that chain doesn't apply."""
    damaged: list[str | None] = ["".join(pages[WRONG[i % len(WRONG)]][0][b] for b in text.encode()), None]
    right, wrong = pages[SINGLE_RIGHT[i % len(SINGLE_RIGHT)]][1], pages[SINGLE_WRONG[i % len(SINGLE_WRONG)]][0]
    try:
        garbled = codecs.charmap_decode(codecs.charmap_encode(text, "strict", right)[0], "strict", wrong)[0]
        if garbled != text and _foreign_signs(garbled) >= MIN_LETTERS:
            damaged[1] = garbled
    except UnicodeError:
        pass
    found: list[bool | None] = [None, None]
    for k, readings in enumerate((chains.deep, chains.to_single)):
        if (garbled := damaged[k]) is not None:
            held = readings(garbled)
            best = _gain(model, garbled, held) if held else (0.0, "")
            found[k] = best[0] > margins[k] and best[1] == text
    return found[0], found[1]


def _pages() -> dict:
    return {name: _code_page(name) for name in {*WRONG, *SINGLE_WRONG, *SINGLE_RIGHT}}


def validate(model: Model, clean: list[str]) -> dict[str, float]:
    """Margins that no clean passage exceeds, and how many garbled ones they still find, on undamaged passages.

    Each passage is garbled by one chain of each sort, in turn.  Without passages the margins are those set above.
    Passages below ``UNLIKELY`` are left out: single-byte damage among them shows in nothing but the score.
    """
    chains, pages = Chains(), _pages()
    clean = [text for text in clean if model.score(text) >= UNLIKELY]
    gains = [_gains(model, chains, text) for text in clean]
    margins = _raised(*(max([0.0, *(g[k] for g in gains)]) for k in range(2)))
    found = [_restored(model, chains, pages, text, i, margins) for i, text in enumerate(clean)]
    return _report(len(clean), margins, *((sum(f[k] is not None for f in found), sum(f[k] is True for f in found)) for k in range(2)))


def _report(n: int, margins: tuple[float, float], utf8: tuple[int, int], single: tuple[int, int]) -> dict[str, float]:
    share = lambda of, found: found / of if of else 1.0
    return {
        "passages": float(n), "margin_utf8": margins[0], "margin_single": margins[1],
        "restored_utf8": share(*utf8), "restored_single": share(*single),
    }


def _foreign(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.where(F.octet_length("text") > F.length("text"))


def train(records: DataFrame, id_col: str = "id", text_col: str = "text") -> np.ndarray:
    """Counts of all undamaged passages: of trigrams by bucket, then of their characters; at most BUCKETS + 0x110000 rows come to the driver."""
    counted = _foreign(records, id_col, text_col).select("text").mapInArrow(_count, "k int, n long")
    rows = counted.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS + 0x110000, np.int64)
    table[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return table


def _hold(records: DataFrame, counts: np.ndarray):
    some = np.flatnonzero(counts)
    return records.sparkSession.sparkContext.broadcast((some, counts[some]))


def _held_model(held) -> Model:
    table = np.zeros(BUCKETS + 0x110000, np.int64)
    table[held.value[0]] = held.value[1]
    return Model(table)


def _validated(held, margins: tuple[float, float] | None):
    """(text) -> (n, utf8, single, of_utf8, of_single): clean passages and their greatest gains; with margins how many of those garbled are restored, and of how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chains, pages = _held_model(held), Chains(), _pages()
        n, sums, seen = 0, [0.0, 0.0, 0, 0], {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _undamaged(text, chains):
                    got = seen.get(part)
                    if got is None:
                        if len(seen) > MOST_SEEN:
                            seen.clear()
                        got = ()
                        if model.score(part) >= UNLIKELY:
                            got = _restored(model, chains, pages, part, zlib.crc32(part.encode()), margins) if margins else _gains(model, chains, part)
                        seen[part] = got
                    if not got:
                        continue
                    n += 1
                    for k in range(2):
                        if not margins:
                            sums[k] = max(sums[k], got[k])
                        elif got[k] is not None:
                            sums[k] += got[k]
                            sums[2 + k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((n, *sums), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))], names=["n", "utf8", "single", "of_utf8", "of_single"])

    return run


def margins(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(measure, value): the margins of this run and the shares of garbled passages that they restore."""
    held = _hold(records, train(records, id_col, text_col))
    texts, columns = _foreign(records, id_col, text_col).select("text"), "n long, utf8 double, single double, of_utf8 long, of_single long"
    most = texts.mapInArrow(_validated(held, None), columns).agg(F.max("utf8"), F.max("single")).first()
    limit = _raised(most[0] or 0.0, most[1] or 0.0)
    scored = texts.mapInArrow(_validated(held, limit), columns)
    n, utf8, single, of_utf8, of_single = (x or 0 for x in scored.agg(*(F.sum(c) for c in scored.columns)).first())
    report = _report(n, limit, (of_utf8, utf8), (of_single, single))
    return records.sparkSession.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


def find_garbled(records: DataFrame, id_col: str = "id", text_col: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """(id, restored, lost): garbled records; ``restored`` is null where characters were lost."""
    counts = train(records, id_col, text_col) if counts is None else counts
    held = _hold(records, counts)
    rows = _foreign(records, id_col, text_col)
    found = _scored(rows, held, MARGIN_UTF8, MARGIN_SINGLE)
    # A passage that decodes as UTF-8 isn't clean, so that margin is never exceeded; where the other one is, all texts are scored again.
    most = found.where("id is null").agg(F.max("gain")).first()[0] or 0.0
    limit = _raised(0.0, most)
    if limit != (MARGIN_UTF8, MARGIN_SINGLE):
        found = _scored(rows, held, *limit)
    return found.where("id is not null").groupBy("id").agg(F.min("restored").alias("restored"), F.max("lost").alias("lost"))


def _scored(rows: DataFrame, held, margin_utf8: float, margin_single: float) -> DataFrame:
    """(id, restored, lost, gain): garbled texts, and a row without id for each task with the most that a clean passage gained."""
    names = ["id", "restored", "lost", "gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(_held_model(held), margin_utf8, margin_single)
        for batch in batches:
            ids, restored, losses = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                garbled, read, lost = repairer.text(text)
                if garbled:
                    ids.append(key)
                    restored.append(None if lost else read)
                    losses.append(lost)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(restored, pa.string()), pa.array(losses, pa.bool_()), pa.nulls(len(ids), pa.float64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.bool_()), pa.array([repairer.clean_gain])], names=names)

    return stage(rows.mapInArrow(run, "id string, restored string, lost boolean, gain double"), "p5-found")
