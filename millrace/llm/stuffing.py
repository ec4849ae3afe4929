"""Keyword-stuffed and link-list pages (problem 8).

A page is cut into lines, and long lines into sentences and runs of words.  A
hidden Markov model with the states prose, code, figures (timetables,
ingredients, changelogs), link list, tag list and menu labels the lines; a page
is flagged when more than half of its words lie in link lists, tag lists and
menus.

Three passes over all pages, each in Arrow batches without a row per word:

1. glue words: words on a share ``GLUE`` of all pages, counted on whole sentences;
2. lexicon: how much oftener a word stands in lists than in other lines, counted
   on every line that a strict rule labels beyond doubt.  Words share ``BUCKETS``
   hashed counters, which bounds the table whatever the vocabulary;
3. labels: Viterbi paths of all pages, and the share of words in lists.

Only emissions and transitions are fitted to a bounded sample
(``TRAINING_PAGES``): from the lines beyond doubt at first, then by Viterbi
training on all sampled lines.  Every state but prose starts from ``RULED`` lines
that obey its rule, so that no state is missing where the sample has no such
line.

Defined results: a null id is ignored, a null or empty text is not flagged,
repeated rows count once, an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.staging import stage

TRAINING_PAGES = 2_500
ROUNDS = 2
LONG = 220
#: Words of one piece of a long line without sentence ends.
PIECE_WORDS = 30
GLUE = 0.12
BUCKETS = 1 << 20
STATES = ("prose", "code", "figures", "link", "tag", "menu")
PROSE, CODE, FIGURES, LINK, TAG, MENU = range(6)
#: Pseudo-counts of the emissions of all lines in each state, and of lines that obey the rule of a state.
PRIOR = 0.1
RULED = 5.0
#: A state with fewer sure lines in the sample keeps the emissions of its rule: relabelled lines would draw it elsewhere.
LEAST_SURE = 20
#: Lexicon entries rest on so many lines at least.
LEAST_LINES = 4
_CHUNK = 1_000_000

#: Words of site navigation, for the first labels of the menu state.
MENU_WORDS = "home about contact login logout register menu search sitemap privacy terms cookies cookie subscribe newsletter rights reserved imprint help faq shop cart account back next top share".split()
#: Words that begin a line of code.
CODE_WORDS = "import from def class return try except for while if else with assert raise yield".split()

#: Signs that stand for links once their text has been taken out.
OPEN, CLOSE, BARE = "\ue000", "\ue001", "\ue002"
_URL = re.compile(r"(?:https?:)?//[^\s)\]>\"']+|www\.[^\s)\]>\"']+|(?<![\w@.])[a-z0-9-]{3,}(?:\.[a-z0-9-]+)*\.(?:com|net|org|info|biz|example|test|invalid|[a-z]{2})(?:/[^\s)\]>\"']*)?(?![\w(])", re.I)
_MARKDOWN = re.compile(r"\[([^\]\n]{0,120})\]\(([^)\s]*)\)")
_ANCHOR = re.compile(r"<a\s[^>]*>(.*?)</a>", re.I | re.S)
_DOTTED = re.compile(r"\.\w")

_ALNUM, _DIGIT, _SPACE, _UPPER, _JOIN, _DELIMITER, _CODE, _STOP, _CLOSER, _OPENER, _END, _LEAD = (1 << i for i in range(12))
_SIGNS = {
    _JOIN: "'’-", _DELIMITER: ",|/•·;#~*–—»›", _CODE: "(){}=[]<>_", _STOP: ".!?…:;", _CLOSER: "\"”»’)", _OPENER: "\"“«‘'(>¿¡", _END: ".!?…", _LEAD: "-*•–·+",
}
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _marked(text: str) -> str:
    """The text with a sign in place of each address; captions stand between two signs."""
    for sign in (OPEN, CLOSE, BARE):
        if sign in text:
            text = text.replace(sign, " ")
    if "](" in text:
        text = _MARKDOWN.sub(rf"{OPEN}\1{CLOSE}", text)
    if "<a" in text or "<A" in text:
        text = _ANCHOR.sub(rf"{OPEN}\1{CLOSE}", text)
    if "//" in text or _DOTTED.search(text):
        text = "\n".join(_URL.sub(BARE, line) if "//" in line or _DOTTED.search(line) else line for line in text.split("\n"))
    return text


@dataclass
class Lines:
    """The lines of some pages (``page``), and their words outside links (``line``, ``hash``)."""

    pages: int
    page: np.ndarray
    size: np.ndarray
    words: np.ndarray
    links: np.ndarray
    ends: np.ndarray
    digits: np.ndarray
    hashtags: np.ndarray
    seps: np.ndarray
    code: np.ndarray
    lead: np.ndarray
    sku: np.ndarray
    meta: np.ndarray
    menu: np.ndarray
    line: np.ndarray
    hash: np.ndarray
    letters: np.ndarray
    numeric: np.ndarray
    frequent: np.ndarray  # words of three letters or more that fill much of their page

    def sums(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.line, of_words, len(self.page))

    def share(self, of_words: np.ndarray) -> np.ndarray:
        return self.sums(of_words) / np.maximum(1, self.words)


class Reader:
    """Cuts texts into lines with their features, all in arrays; ``frequent`` only with ``repeats``."""

    def __init__(self, repeats: bool = True) -> None:
        self.repeats = repeats
        signs = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x10000)]
        self.flags = np.zeros(0x10000, np.uint16)
        for flag, test in ((_ALNUM, str.isalnum), (_DIGIT, str.isdigit), (_SPACE, str.isspace), (_UPPER, str.isupper)):
            self.flags[np.fromiter(map(test, signs), bool, 0x10000)] |= flag
        for flag, chosen in _SIGNS.items():
            self.flags[[ord(s) for s in chosen]] |= flag
        self.lower = _mix(np.array([ord(s.lower()) if len(s.lower()) == 1 else ord(s) for s in signs], np.uint64) * _GOLD)
        self.step = int(np.random.default_rng(20).integers(1, 2**62)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)
        self.menu_words, self.code_words = self.hashes(MENU_WORDS), self.hashes(CODE_WORDS)
        self.label_words, self.keyword, self.meta_word, self.sku_word = self.hashes(["tag", "label", "keyword"]), self.hashes(["keyword"]), self.hashes(["meta"]), self.hashes(["sku"])

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.unique(self._words(np.array([ord(c) for c in " ".join(words) + "\n"], np.uint32))[2])

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.step), ("down", pow(self.step, -1, 1 << 64))):
                line = np.full(n, base, np.uint64)
                line[0] = 1
                setattr(self, name, np.multiply.accumulate(line))

    def _words(self, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """Begin and end of each word, its hash (no case, hyphens or plural s), letters, and the flags of all signs."""
        low = c if len(c) == 0 or c.max() <= 0xFFFF else np.minimum(c, 0xFFFF)
        flags = self.flags[low]
        alnum = (flags & _ALNUM).view(bool)[::2]  # the lowest bit of the lower byte
        ok = alnum.copy()
        inner = np.flatnonzero(flags[1:-1] & _JOIN) + 1
        inner = inner[alnum[inner - 1] & alnum[inner + 1]]
        ok[inner] = True
        change = np.flatnonzero(ok[1:] != ok[:-1]) + 1
        edges = np.concatenate([[0] if len(ok) and ok[0] else [], change, [len(ok)] if len(ok) and ok[-1] else []]).astype(np.int64)
        begin, stop = edges[::2], edges[1::2]
        letters = self.lower[low[alnum]]
        self._powers(len(letters) + 1)
        total = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * self.up[: len(letters)], out=total[1:])
        # Letters of a word: its signs without joiners.
        joined = np.bincount(np.searchsorted(begin, inner, "right") - 1, minlength=len(begin)).astype(np.int64)
        b = np.cumsum(stop - begin - joined)
        a = b - (stop - begin - joined)
        plural = (b - a > 3) & (letters[b - 1] == self.lower[ord("s")]) if len(b) else np.zeros(0, bool)
        b = b - plural
        return begin, stop, _mix((total[b] - total[a]) * self.down[a] + (b - a).astype(np.uint64)), b - a, flags

    def __call__(self, texts: list[str]) -> Lines:
        marked = [_marked(t) for t in texts or [""]]
        c = np.frombuffer("\n".join([*marked, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        page_start = np.cumsum([0, *(len(t) + 1 for t in marked)])[:-1]
        begin, stop, word, letters, flags = self._words(c)
        top = len(c) - 1
        is_space = lambda at: (flags[at] & _SPACE) > 0
        has = lambda at, flag: (flags[at] & flag) > 0
        # Every sign that is not blank is a letter, a digit or one of these.
        signs = np.flatnonzero((flags & (_ALNUM | _SPACE)) == 0)
        sign, sign_flags = c[signs], flags[signs]
        at_signs = lambda chosen: signs[np.isin(sign, [ord(x) for x in chosen])]
        flagged = lambda flag: signs[(sign_flags & flag) > 0]

        start = np.concatenate([[0], np.flatnonzero(c == 10) + 1])[:-1]
        stretch = np.diff(start, append=len(c))
        # Long lines are cut after sentences.
        cut = flagged(_END | _CLOSER) + 1
        cut = cut[is_space(np.minimum(cut, top))]
        cut = cut[stretch[np.searchsorted(start, cut, "right") - 1] > LONG]
        before = cut - 1
        for _ in range(4):
            before = np.where(has(before, _CLOSER), np.maximum(before - 1, 0), before)
        start = np.union1d(start, cut[has(before, _END)])
        # What is long still is cut into runs of words.
        first_word = np.searchsorted(begin, start)
        each = np.diff(first_word, append=len(begin))
        long = np.flatnonzero((np.diff(start, append=len(c)) > LONG) & (each > PIECE_WORDS))
        if len(long):
            pieces = (each[long] - 1) // PIECE_WORDS
            number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
            start = np.union1d(start, begin[np.repeat(first_word[long], pieces) + number * PIECE_WORDS])
        end = np.append(start[1:], len(c))
        n = len(start)
        each = np.diff(np.searchsorted(begin, start), append=len(begin))
        line = np.repeat(np.arange(n), each)

        def count(at: np.ndarray) -> np.ndarray:
            return np.bincount(np.searchsorted(start, at, "right") - 1, minlength=n)

        def next_of(words_at: np.ndarray, others: np.ndarray) -> np.ndarray:
            """The first word or sign at or after each start."""
            return np.minimum(np.append(words_at, top)[np.searchsorted(words_at, start)], np.append(others, top)[np.searchsorted(others, start)])

        first, head = next_of(begin, signs), next_of(begin, signs[(sign_flags & _OPENER) == 0])
        ending = signs[(sign_flags & _CLOSER) == 0]
        last = np.maximum(np.append(stop - 1, -1)[np.searchsorted(stop - 1, end) - 1], np.append(ending, -1)[np.searchsorted(ending, end) - 1])
        closed = (last >= start) & has(last, _STOP)
        capital = (head < end) & has(head, _UPPER | _DIGIT)

        opened, closed_at, bare = (signs[sign == ord(s)] for s in (OPEN, CLOSE, BARE))
        urls, linked = count(np.concatenate([closed_at, bare])), np.zeros(n, np.int64)
        if len(opened):
            in_link = np.searchsorted(opened, begin, "right") > np.searchsorted(closed_at, begin, "right")
            linked = np.bincount(line[in_link], minlength=n)
            out = ~in_link
            begin, stop, word, letters, line = begin[out], stop[out], word[out], letters[out], line[out]
        words = np.bincount(line, minlength=n)
        size = words + linked + urls
        many = np.maximum(1, words)

        digit_total = np.zeros(len(c) + 1, np.int32)
        np.cumsum((flags & _DIGIT) > 0, out=digit_total[1:])
        figures = digit_total[stop] - digit_total[begin]
        numeric = figures == stop - begin
        follows = lambda at, chosen: np.isin(c[np.minimum(at, top)], [ord(x) for x in chosen])
        after = lambda at: np.minimum(at + is_space(np.minimum(at, top)), top)
        opens = np.flatnonzero(begin == first[line])

        hash_sign = signs[sign == ord("#")]
        tags = hash_sign[((hash_sign == 0) | is_space(hash_sign - 1)) & ((flags[np.minimum(hash_sign + 1, top)] & (_ALNUM | _DIGIT)) == _ALNUM)]
        hashtags = count(tags) / many
        links = np.where((urls > 0) & (linked == 0) & (words <= 6 * urls) & ~closed, 1.0, (linked + urls) / np.maximum(1, size))

        colon = signs[sign == ord(":")]
        colon = colon[c[np.minimum(colon + 1, top)] == ord(":")]
        dash = at_signs("->")
        dash = dash[(dash > 0) & (dash < top)]
        dash = dash[(c[dash - 1] == 32) & (c[dash + 1] == 32)]
        seps = count(np.concatenate([flagged(_DELIMITER), colon, dash])) / many

        coded = count(flagged(_CODE)) > 0
        coded |= follows(first, "@#") & (first < end)
        coded[line[opens[np.isin(word[opens], self.code_words) & ~has(begin[opens], _UPPER)]]] = True
        lead = has(first, _LEAD) & is_space(np.minimum(first + 1, top)) & (first < end)
        dotted = opens[numeric[opens]]
        lead[line[dotted[follows(stop[dotted], ".)") & is_space(np.minimum(stop[dotted] + 1, top))]]] = True

        sku = np.zeros(n, bool)
        money = at_signs("$€£")
        sku |= count(money[has(after(money + 1), _DIGIT)]) > 0
        percent = at_signs("%")
        ended = np.searchsorted(stop, percent).clip(max=max(0, len(stop) - 1))
        if len(stop):
            ended = ended[(stop[ended] == percent) & numeric[ended] & (stop[ended] - begin[ended] <= 2) & (begin[ended] > 0)]
            sku[line[ended[c[begin[ended] - 1] == ord("-")]]] = True
        article = np.flatnonzero((figures >= 4) & ~numeric)
        capitals = np.zeros(len(article), np.int64)
        for i in range(5):
            capitals += (begin[article] + i < stop[article]) & has(np.minimum(begin[article] + i, top), _UPPER)
        fits = (capitals >= 2) & (capitals <= 4) & (stop[article] - begin[article] - capitals - figures[article] <= 1) & has(begin[article], _UPPER) & has(stop[article] - 1, _DIGIT)
        sku[line[article[fits]]] = True
        named = np.flatnonzero(word == self.sku_word)
        sku[line[named[has(begin[named], _UPPER)]]] = True
        sku &= digit_total[end] > digit_total[start]

        keyword = np.flatnonzero(word == self.keyword)
        meta = np.zeros(n, bool)
        meta[line[keyword[follows(after(stop[keyword]), ":=")]]] = True
        label = opens[np.isin(word[opens], self.label_words)]
        meta[line[label[follows(after(stop[label]), ":")]]] = True
        named = np.flatnonzero(word == self.meta_word)
        meta[line[named[(begin[named] > 0) & (c[begin[named] - 1] == ord("<"))]]] = True
        brief = np.flatnonzero((size <= 12)[line])
        menu = np.bincount(line[brief[np.isin(word[brief], self.menu_words)]], minlength=n) / many

        page = np.searchsorted(page_start, start, "right") - 1
        of = page[line]
        frequent = np.zeros(len(word), bool)
        if self.repeats:
            need = np.maximum(3, 0.07 * np.bincount(of, minlength=len(marked)))
            telling = np.flatnonzero((letters > 2) & ~numeric)
            key = word[telling] + of[telling].astype(np.uint64) * _GOLD
            order = np.argsort(key)
            key, telling = key[order], telling[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            counts = np.diff(head, append=len(key))
            frequent[telling] = np.repeat(counts >= need[of[telling[head]]], counts)

        keep = size > 0
        place = np.cumsum(keep) - 1
        k = lambda x: x[keep]
        return Lines(
            len(marked), k(page), k(size), k(words), k(links), k(2 * closed + capital), k(np.bincount(line[numeric], minlength=n) / many), k(hashtags), k(seps),
            k(coded & (hashtags == 0)), k(lead), k(sku), k(meta), k(menu), place[line], word, letters, numeric, frequent,
        )


_LINKS, _SIZES, _REPEATED, _HELD = (0.01, 0.3, 0.7), (3, 5, 9), (0.15, 0.4, 0.7), (0.05, 0.15, 0.3)
_SEPS, _DIGITS, _VALUES = (0.1, 0.25, 0.5), (0.1, 0.3), (-0.8, -0.3, 0.2, 0.8, 1.6)
#: Number of values of each feature, and its weight: the lexicon speaks for many words at once; the repetition features overlap.
WIDTHS = (4, 8, 4, 4, 4, 4, 4, 6, 4, 6)
WEIGHTS = (1.0, 1.0, 0.7, 0.7, 0.7, 1.0, 1.0, 1.0, 1.0, 2.0)


def _among(word: np.ndarray, glue: np.ndarray) -> np.ndarray:
    """Which words stand in the sorted array ``glue``."""
    if not len(glue):
        return np.zeros(len(word), bool)
    return glue[np.searchsorted(glue, word).clip(max=len(glue) - 1)] == word


def _repeated(lines: Lines, held: np.ndarray) -> np.ndarray:
    """Share of the telling words of each line that are frequent on their page."""
    free = (lines.letters > 2) & ~lines.numeric & ~held
    return lines.sums(free & lines.frequent) / np.maximum(1, lines.sums(free))


def features(lines: Lines, glue: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """(lines, features) small integers below ``WIDTHS``."""
    held = _among(lines.hash, glue)
    value = lines.share(lexicon[(lines.hash & np.uint64(BUCKETS - 1)).astype(np.int64)])
    step = lambda edges, x: np.searchsorted(edges, x, "right")
    columns = [
        step(_LINKS, lines.links),
        lines.ends * 2 + (lines.size >= 5),
        step(_SIZES, lines.size),
        step(_REPEATED, _repeated(lines, held)),
        step(_HELD, lines.share(held)),
        step(_SEPS, lines.seps),
        2 * ((lines.hashtags >= 0.4) | lines.meta) + lines.sku,
        step(_DIGITS, lines.digits) * 2 + lines.lead,
        lines.code + 2 * (lines.menu >= 0.5),
        step(_VALUES, value),
    ]
    return np.column_stack(columns).astype(np.int64)


def surely(lines: Lines, glue: np.ndarray, lexicon: np.ndarray | None = None) -> np.ndarray:
    """The state of each line that leaves no doubt, else -1."""
    among = _among(lines.hash, glue)
    held, repeated, size = lines.share(among), _repeated(lines, among), lines.size
    telling = (lines.letters > 3) & ~among
    again = np.zeros(len(size), bool)
    key = lines.hash[telling] + lines.line[telling].astype(np.uint64) * _GOLD
    order = np.argsort(key)
    key = key[order]
    again[lines.line[telling][order[1:][key[1:] == key[:-1]]]] = True
    listed = np.zeros(len(size), bool)
    if lexicon is not None:
        listed = (repeated >= 0.4) & (lines.share(lexicon[(lines.hash & np.uint64(BUCKETS - 1)).astype(np.int64)]) >= 0.8)
    some = lines.links > 0
    return np.select(
        [
            (lines.menu >= 0.6) & (size <= 8) & ~some,
            lines.links >= 0.7,
            (lines.hashtags >= 0.5) | lines.meta & (lines.seps >= 0.2) | listed,
            some & (lines.ends == 3) & (lines.links < 0.2) & (held >= 0.2),
            some,
            lines.sku & (lines.ends < 2) & (held < 0.1) & (size >= 4),
            lines.sku,
            lines.lead & (lines.digits > 0) | (lines.digits >= 0.4),
            lines.code & ((repeated < 0.9) | (lines.sums((lines.letters > 2) & ~lines.numeric & ~among) < 3)),
            (lines.ends == 3) & (size >= 5) & (lines.seps < 0.25) & ~again,
            (held < 0.1) & (repeated >= 0.5) & (lines.ends < 2) & ((lines.seps >= 0.2) | (size <= 5)),
        ],
        [MENU, LINK, TAG, PROSE, -1, TAG, -1, FIGURES, CODE, PROSE, TAG],
        -1,
    )


class Model:
    """Hidden Markov model over lines with independent discrete emissions."""

    def __init__(self, glue: np.ndarray, lexicon: np.ndarray, tables: list[np.ndarray], start: np.ndarray, move: np.ndarray) -> None:
        self.glue, self.lexicon, self.tables, self.start, self.move = glue, lexicon, tables, start, move

    def paths(self, seen: np.ndarray, page: np.ndarray) -> np.ndarray:
        """The most likely state of each line; ``page`` is the page of each line, in order."""
        path = np.zeros(len(page), np.int64)
        if not len(page):
            return path
        emit = sum(w * np.log(t)[f] for w, t, f in zip(WEIGHTS, self.tables, seen.T))
        first = np.flatnonzero(np.diff(page, prepend=-1))
        length = np.diff(first, append=len(page))
        first = first[np.argsort(-length, kind="stable")]
        length = -np.sort(-length)
        moves = np.log(self.move).T[None]
        best = np.log(self.start) + emit[first]
        back = []
        for t in range(1, int(length[0])):
            going = int(np.searchsorted(-length, -t))  # pages with a line t
            reach = best[:going, None, :] + moves
            came = reach.argmax(2)
            best[:going] = np.take_along_axis(reach, came[:, :, None], 2)[:, :, 0] + emit[first[:going] + t]
            back.append(came)
        state = best.argmax(1)
        path[first + length - 1] = state
        for t in range(int(length[0]) - 1, 0, -1):
            came = back[t - 1]
            going = len(came)
            state[:going] = came[np.arange(going), state[:going]]
            path[first[:going] + t - 1] = state[:going]
        return path

    def label(self, lines: Lines) -> np.ndarray:
        return self.paths(features(lines, self.glue, self.lexicon), lines.page)

    def shares(self, lines: Lines) -> np.ndarray:
        """Share of each page's words in link lists, tag lists and menus."""
        listed = np.bincount(lines.page, lines.size * (self.label(lines) >= LINK), lines.pages)
        return listed / np.maximum(1, np.bincount(lines.page, lines.size, lines.pages))


def _ruled(whole: list[np.ndarray]) -> list[np.ndarray]:
    """Emission counts of ``RULED`` lines for each state but prose that obey its strict rule and are like all lines else."""
    tables = [np.zeros((w, len(STATES))) for w in WIDTHS]
    for state, rule in ((CODE, {8: (1, 3)}), (FIGURES, {7: (2, 3, 4, 5), 8: (0,)}), (LINK, {0: (3,)}), (TAG, {6: (2, 3), 9: (4, 5), 4: (0,)}), (MENU, {8: (2, 3), 2: (0, 1)})):
        for k, c in enumerate(whole):
            obeys = np.isin(np.arange(len(c)), rule.get(k, range(len(c))))
            tables[k][:, state] = RULED * c * obeys / (c * obeys).sum()
    return tables


def train(lines: Lines, glue: np.ndarray, lexicon: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Emissions and transitions from the lines of sampled pages; usable even without any."""
    sure, seen = surely(lines, glue, lexicon), features(lines, glue, lexicon)
    whole = [np.bincount(f, minlength=w) + 1.0 for f, w in zip(seen.T.reshape(len(WIDTHS), -1), WIDTHS)]
    ruled = _ruled(whole)
    follows = np.flatnonzero(np.diff(lines.page) == 0)
    begins = np.flatnonzero(np.diff(lines.page, prepend=-1))
    labels = sure
    trusted = np.bincount(sure[sure >= 0], minlength=len(STATES)) >= LEAST_SURE
    trusted[PROSE] = True
    for _ in range(rounds + 1):
        tables = []
        for f, w, c, rule in zip(seen.T.reshape(len(WIDTHS), -1), WIDTHS, whole, ruled):
            known = labels >= 0
            table = np.bincount(f[known] * len(STATES) + labels[known], minlength=w * len(STATES)).reshape(w, len(STATES))
            tables.append(table + rule + (PRIOR * (c / c.sum() + 1 / len(c)))[:, None])
        start = 1.0 + np.bincount(labels[begins][labels[begins] >= 0], minlength=len(STATES))
        a, b = labels[follows], labels[follows + 1]
        both = (a >= 0) & (b >= 0)
        move = 0.5 + np.bincount(a[both] * len(STATES) + b[both], minlength=len(STATES) ** 2).reshape(len(STATES), -1)
        model = Model(glue, lexicon, [t / t.sum(0) for t in tables], start / start.sum(), move / move.sum(1, keepdims=True))
        # Lines that were beyond doubt keep their label while the others are relabelled.
        labels = np.where(sure >= 0, sure, model.paths(seen, lines.page))
        labels = np.where((sure >= 0) | trusted[labels], labels, -1)
    return model


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of the list with a bounded number of signs (or one text)."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (h, n): on how many pages each word stands in a sentence; h 0 counts the pages."""
    read, held, pages = Reader(repeats=False), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held))
        h, inverse = np.unique(h, return_inverse=True)
        return h, np.bincount(inverse, n).astype(np.int64)

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for part in _chunks(texts):
            lines = read(texts[part])
            pages += lines.pages
            whole = ((lines.ends == 3) & (lines.size >= 5) & (lines.links == 0))[lines.line] & ~lines.numeric
            once = np.unique(lines.hash[whole] + lines.page[lines.line[whole]].astype(np.uint64) * _GOLD, return_index=True)[1]
            h, n = np.unique(lines.hash[whole][once], return_counts=True)
            held.append((h, n))
            if sum(len(x[0]) for x in held) > 2_000_000:
                held = [merged()]
    if held:
        h, n = merged()
        h, n = np.append(h.view(np.int64), 0), np.append(n, pages)
        for at in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["h", "n"])


def _count_states(glue_of):  # noqa: ANN001
    """(text) -> (bucket, listed, plain): lines beyond doubt that hold a word of the bucket, in lists and elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, glue = Reader(), glue_of.value
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _chunks(texts):
                lines = read(texts[part])
                sure = surely(lines, glue)
                bucket = (lines.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
                once = np.unique(lines.line.astype(np.int64) * BUCKETS + bucket)
                state, bucket = sure[once // BUCKETS], once % BUCKETS
                for kind, some in enumerate(((state == TAG) | (state == LINK), (state == PROSE) | (state == CODE) | (state == FIGURES))):
                    found, n = np.unique(bucket[some], return_counts=True)
                    total[kind][found] += n
        some = np.flatnonzero(total.any(0))
        for at in range(0, len(some), 100_000):
            b = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[0][b]), pa.array(total[1][b])], names=["bucket", "listed", "plain"])

    return run


def lexicon_of(bucket: np.ndarray, listed: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Log ratio of a word's share of listed and other lines, by bucket; 0 where nothing is known."""
    a, b = listed.sum() + 1.0, plain.sum() + 1.0
    # Pseudo-counts in proportion to the totals, so that a rare word says little either way.
    x, y = a / (a + b), b / (a + b)
    known = listed + plain >= LEAST_LINES
    lexicon = np.zeros(BUCKETS, np.float32)
    lexicon[bucket[known]] = np.clip(np.log((listed[known] + x) / a) - np.log((plain[known] + y) / b), -3.0, 3.0)
    return lexicon


def _glue(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Sorted hashes of the words on a share ``GLUE`` of all pages, and the number of pages.

    There are at most (words of a page) / ``GLUE`` of them, whatever the corpus.
    """
    counts = stage(texts.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "p8-words")
    pages = sum(r.n for r in counts.where("h = 0").select("n").collect())  # one row
    h = counts.where(f"h <> 0 and n >= {max(3, GLUE * pages)}").select("h").toArrow().column(0).to_numpy()
    return np.sort(h.view(np.uint64)), pages


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_pages: int = TRAINING_PAGES) -> Model:
    """Glue words and lexicon of all pages, emissions and transitions of about ``training_pages``, chosen by a hash of their id."""
    texts = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    spark = documents.sparkSession
    glue, pages = _glue(texts)
    counted = texts.mapInArrow(_count_states(spark.sparkContext.broadcast(glue)), "bucket int, listed long, plain long")
    buckets = counted.groupBy("bucket").agg(F.sum("listed").alias("listed"), F.sum("plain").alias("plain")).toArrow()  # at most BUCKETS rows
    lexicon = lexicon_of(*(buckets.column(c).to_numpy() for c in ("bucket", "listed", "plain")))
    drawn = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < min(1_000_000, math.ceil(1_000_000 * training_pages / max(1, pages)))
    sample = documents.where(drawn & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col).limit(2 * training_pages).toArrow().column(0).to_pylist()
    return train(Reader()(sample), glue, lexicon)


def list_shares(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(doc_id, list_share): share of each page's words in link lists, tag lists and menus."""
    trained = fit(documents, id_col, text_col, training_pages)
    # Plain data is broadcast (4 MB of lexicon at most); the model is rebuilt from it, so executors need no package of ours.
    held = documents.sparkSession.sparkContext.broadcast((trained.glue, trained.lexicon, trained.tables, trained.start, trained.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, read = Model(*held.value), Reader()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            shares = np.concatenate([np.zeros(0), *(model.shares(read(texts[part])) for part in _chunks(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shares, pa.float64())], names=[id_col, "list_share"])

    rows = documents.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, list_share double")


def stuffed_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(doc_id) of the pages with more than ``threshold`` of their words in lists."""
    return list_shares(documents, id_col, text_col, training_pages).where(F.col("list_share") > threshold).select(id_col).distinct()
