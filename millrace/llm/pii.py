"""Personal information inside free text (problem 3).

Anchor expansion: one Aho-Corasick scan finds at-signs (also spelled out), the
digits where a number may begin, identifier and phone cues, street types,
titles, listed names and the commonest endings of listed names.  Every item
grows from such a position: a local parser for its kind reads to the left and
right of the anchor and validates what it has read.  Nothing is searched for in
the text as a whole.  Items never overlap: e-mail addresses are settled first,
then addresses, identity numbers, phone numbers and names.

Name endings are learned from the name list (``learn_endings``), so that names
missing from the list are found beside a given name or an initial; after a title
any capitalized name is taken.

The listed names are part of the automaton while there are at most
``MAX_NAMES``; a longer list is joined to the words of the texts, so that each
text brings the listed names that it holds (``_listed``).

Defined results: a null text is the empty text, null keys are ignored, repeated
rows of a record count once, an empty table gives an empty result; texts of any
length are processed whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.staging import stage

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

#: Up to so many listed names are held by every task, in the automaton (about 100 bytes each).
MAX_NAMES = 200_000

#: Words and signs at which items are looked for.
AT_SIGNS = ("@", "＠", *(f"{o}{b}at{b}{c}" for o, c in ("()", "[]", "{}", "<>") for b in ("", " ")), " at ")
PHONE_ANCHORS = ("tel", "phone", "fax", "call", "ring", "text", "whatsapp", "number", "mobile", "cell", "sms", "dial", "hotline", "contact", "reach")
ID_ANCHORS = ("ssn", "social security", "national id", "id", "identity", "insurance", "passport", "nino", "taxpayer")
STREET_TYPES = (
    "street st road rd avenue ave lane ln drive dr court ct boulevard blvd way terrace ter close place pl square sq crescent cres row walk hill parkway pkwy highway hwy "
    "grove mews gardens circle cir alley path"
).split()
#: Street types that are no ordinary words, trusted without a capital or a cue.
PLAIN_TYPES = set("street road rd avenue ave ln boulevard blvd terrace ct".split())
STREET_PREFIXES = "rue calle via viale rua avenida ulica".split()
STREET_SUFFIXES = ("straße", "strasse", "weg", "gasse", "allee", "platz")
TITLES = "mr mrs ms miss mx dr prof professor sir madam mme herr frau rev".split()
#: Words that stand before a name without being part of it.
NOT_GIVEN = set(
    "by to is are was thank thanks cc contact author maintainer with regards name named from and or the a an dear hello hi signed reported according best for of on at in as please "
    "ask asked wrote writes said says sincerely yours saw id no street road lane port upper lower new old north south east west".split()
)
#: Offices that follow a title in place of a name.
NOT_FAMILY = set("president chair chairman chairwoman speaker minister secretary mayor judge ambassador governor justice prime vice chancellor director emeritus".split())
#: Words that stand between number and street type without being part of a street's name.
NOT_STREET = set("of and the to in for a or on from with more hours days minutes other".split())

_WORD = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
_LOCAL = re.compile(r"[\w.+%'-]*[\w+%-]$")
_DOMAIN_DOTS = re.compile(r"[a-z0-9](?:[\w-]*[a-z0-9])?(?:\.[a-z0-9](?:[\w-]*[a-z0-9])?)*\.[a-z]{2,24}(?![\w@])", re.I)
_DOMAIN_WORDS = re.compile(r"[a-z0-9][\w-]*(?:(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+|\.)[a-z0-9][\w-]*)*(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+|\.)[a-z]{2,24}(?![\w@])", re.I)
_SPELLED_DOT = re.compile(r"\sdot\s|[\[({<]\s?dot")
_DOTS = re.compile(r"\.|\W*dot\W*")
_PHONE = re.compile(
    r"(?<![\w#/.,-])(?<!\d )(?:"
    r"(?P<plus>\+(?:1[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}|44[\s.-]?\(?0?\)?\d{4}[\s.-]?\d{3}[\s.-]?\d{3}|(?!1\d|1[\s.-]|44)\d{1,3}(?:[\s.-]?\(?\d{2,4}\)?){2,5}))"
    r"|(?P<one>1[-.\s]\d{3}[-.\s]\d{3}[-.\s]\d{4})"
    r"|(?P<paren>\(\d{3}\)\s?\d{3}[-.\s]?\d{4})"
    r"|(?P<full>\d{3}(?P<sep>[-.\s]|\s/\s|/)\d{3}(?P=sep)\d{4})"
    r"|(?P<zero>0\d{4}[\s-]?\d{3}[\s-]?\d{3}|0\d{3}[\s-]\d{3}[\s-]\d{4}|0\d{2}[\s-]\d{4}[\s-]\d{4})"
    r"|(?P<ten>\d{10})"
    r"|(?P<seven>\d{3}[-.\s]\d{4})"
    r")(?![\d_]|[-./]\d|[-.][A-Za-z])"
)
#: What may stand between a cue and the number.
_PHONE_CUE = re.compile(r"(?:ephone|line|\s\w+\s(?:at|on))?(?:\sis)?\W{0,4}(?:me\s|us\s|at\s|on\s|is\s|no\W{0,2}|number\W{0,2})?\W{0,3}")
_ID = re.compile(
    r"(?<![\w#/.-])(?:(?P<ssn>\d{3}(?P<s>[- ])\d{2}(?P=s)\d{4})|(?P<bare>\d{9})|(?P<nino>[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z])|(?P<dni>\d{8}[- ]?[A-Z]))(?![\w]|-\w)",
    re.I,
)
_ID_CUE = re.compile(r"(?:\s*(?:no|number|card|code|is|nr))*\W{0,4}(?:is\s)?")
_ID_DECOY = re.compile(r"(?:lot|part|ticket|build|order|batch|ref|serial|no\.|#)\s*(?:no\.?)?\s*$")
_EN_STREET = re.compile(
    rf"(?<![\w.,/#-])(?P<n>\d{{1,5}}[^\S\n]?[a-z]?),?[^\S\n]+(?P<name>(?:(?:[nsew]|[ns][ew]|north|south|east|west|upper|lower|old|new|great|little|saint|st)\.?\s+){{0,2}}{_WORD}(?:\s{_WORD}){{0,2}}?)\s+(?P<t>{'|'.join(STREET_TYPES)})\b",
    re.I,
)
_FR_STREET = re.compile(rf"(?<![\w.,/#-])\d{{1,5}}\s?(?:[a-d]|bis|ter)?,?\s+(?:{'|'.join(STREET_PREFIXES)})\s+(?:(?:de|du|des|de la|la|del|della)\s)?{_WORD}", re.I)
_NUMBER_AFTER = re.compile(r"\s+\d{1,5}[a-d]?(?!\w|[.,]\d)", re.I)
_STREET_CUE = re.compile(r"(?:ship_?\s?to|deliver(?:ed|y)?\s+to|lives?\s+at|visit\s+us|go(?:es)?\s+to|moved\s+to|collected\s+from|address|located\s+at|at|send\s+to|mail\s+to)\W{0,4}$", re.I)
_AFTER_TITLE = re.compile(rf"\.?[ \t]+(?P<lead>(?:[^\W\d_]\.[ \t]?){{0,3}})(?P<one>{_WORD}(?:-{_WORD})*)(?:[ \t]+(?P<two>{_WORD}(?:-{_WORD})*))?")
_TITLE_BEFORE = re.compile(rf"\b(?:{'|'.join(TITLES)})\.?[ \t]+$")
_INITIALS = re.compile(r"(?<!\w)((?:[^\W\d_]\.[ \t]?){1,3})$")
_WORD_BEFORE = re.compile(rf"(?<![\w@.])({_WORD}(?:-{_WORD})?)[ \t]+$")
_HYPHEN_BEFORE, _HYPHEN_AFTER, _COMMA_AFTER = re.compile(rf"({_WORD})-$"), re.compile(rf"-({_WORD})"), re.compile(rf",[ \t]+({_WORD})")
_INITIAL_DOT = re.compile(r"(?:^|[^\w])[a-z]\.$")
_WORDS = re.compile(r"[^\W\d_]+")
_KEEP = re.compile(r"[\W_]+")


def learn_endings(names: list[str], least: int = 8) -> tuple[str, ...]:
    """The longest endings that ``least`` and 4 % of the names share."""
    counts: Counter[str] = Counter()
    for name in {n.lower() for n in names}:
        counts.update({name[-k:] for k in range(3, 7) if len(name) > k})
    need = max(least, 0.04 * len(names))
    return _longest({e: n for e, n in counts.items() if n >= need})


def _longest(good: dict[str, int]) -> tuple[str, ...]:
    return tuple(sorted(e for e, n in good.items() if not any(x != e and x.endswith(e) and m >= 0.9 * n for x, m in good.items())))


def _flat(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Finds typed items in a text; ``given`` and ``family`` are listed names.

    With ``endings`` (of family and given names) the lists are not part of the
    automaton: they hold the listed names of one text, set by ``know``.
    """

    def __init__(self, given: list[str], family: list[str], endings: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> None:
        self.family_ends, self.given_ends = endings or (learn_endings(family), learn_endings(given))
        self.per_text = endings is not None
        self.know(given, family)
        self.automaton = ahocorasick.Automaton()
        streets = [*(f" {t}" for t in STREET_TYPES + STREET_PREFIXES)]
        names = () if self.per_text else sorted(self.family)
        groups = (("at", AT_SIGNS), ("digit", "0123456789"), ("phone", PHONE_ANCHORS), ("id", ID_ANCHORS), ("street", streets), ("suffix", STREET_SUFFIXES), ("title", TITLES), ("name", names), ("name", self.family_ends))
        for kind, words in groups:
            for w in words:
                held = self.automaton.get(w, ())
                self.automaton.add_word(w, held if (kind, len(w)) in held else (*held, (kind, len(w))))
        self.automaton.make_automaton()

    def know(self, given: list[str], family: list[str]) -> None:
        self.given, self.family = {n.lower() for n in given}, {n.lower() for n in family}

    def anchors(self, low: str) -> dict[str, list[tuple[int, int]]]:
        """Start and end of every anchor, by kind, in order of the ends; of digits only those that no digit precedes."""
        found: dict[str, list[tuple[int, int]]] = {}
        last = -2
        for end, kinds in self.automaton.iter(low):
            for kind, size in kinds:
                if kind == "digit":
                    if last == end - 1:
                        last = end
                        continue
                    last = end
                found.setdefault(kind, []).append((end + 1 - size, end + 1))
        if self.per_text and self.family:
            known = [m.span() for m in _WORDS.finditer(low) if m.group() in self.family]
            found["name"] = sorted({*found.get("name", ()), *known}, key=lambda x: x[1])
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of all items, in order."""
        low = _flat(text)
        anchors = self.anchors(low)
        starts: list[int] = []
        taken: list[tuple[int, int, str]] = []

        def add(s: int, e: int, kind: str) -> bool:
            at = bisect_left(starts, e)  # items that start before the end
            if e <= s or at and taken[at - 1][1] > s:
                return False
            at = bisect_left(starts, s)
            starts.insert(at, s)
            taken.insert(at, (s, e, kind))
            return True

        def grow(kind: str, found: Iterator[tuple[int, int]]) -> None:
            for s, e in found:
                add(s, e, kind)

        digits = [s for s, _ in anchors.get("digit", ())]
        if "at" in anchors:
            grow("email", self._emails(text, low, anchors["at"]))
        if digits and ("street" in anchors or "suffix" in anchors):
            grow("street_address", self._streets(text, low, digits, anchors))
        if digits:
            grow("id_number", self._ids(text, low, digits, anchors.get("id", [])))
            grow("phone", self._phones(text, low, digits, anchors.get("phone", [])))
        if "name" in anchors:
            grow("person_name", self._names(text, low, [e for _, e in anchors["name"]]))
        if "title" in anchors:
            # "Dr" at the end of an address is no title.
            outside = [(s, e) for s, e in anchors["title"] if not (at := bisect_left(starts, e)) or taken[at - 1][1] <= s]
            grow("person_name", self._titled(text, low, outside))
        return taken

    def _emails(self, text: str, low: str, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        done = 0
        for start, end in anchors:
            if start < done:
                continue
            sign = low[start:end].strip()
            spelled = sign not in "@＠"
            begin = start - 1 if start and low[start - 1].isspace() else start
            after = end + 1 if end < len(low) and low[end].isspace() else end
            tight = begin == start and after == end
            if sign == "at":
                after = end
                while after < len(low) and low[after].isspace():
                    after += 1
            local = _LOCAL.search(low, max(0, begin - 80), begin)
            if not local or not any(map(str.isalnum, local.group())):
                continue
            s = local.start()
            while s < begin and low[s] in ".-'+%":
                s += 1
            worded = _DOMAIN_WORDS.match(low, after)
            if sign == "at":
                domain = worded if worded and _SPELLED_DOT.search(worded.group()) else None
            else:
                plain = _DOMAIN_DOTS.match(low, after)
                domain = worded if worded and (not plain or worded.end() > plain.end()) and "dot" in worded.group() else plain
            if not domain or not tight and not spelled and not any(map(str.isalpha, domain.group())):
                continue
            if not _DOTS.split(domain.group())[-1].isalpha() or text[s:begin].isdigit() and not spelled:
                continue
            yield s, domain.end()
            done = domain.end()

    def _streets(self, text: str, low: str, digits: list[int], anchors: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
        types = [s for s, _ in anchors.get("street", ())]
        for _, end in anchors.get("suffix", ()):
            s = end
            while s and low[s - 1].isalpha():
                s -= 1
            m = _NUMBER_AFTER.match(text, end) if end - s >= 6 and not (s and (low[s - 1].isalnum() or low[s - 1] == "_")) else None
            if m:
                yield s, m.end()
        for at in digits:
            near = bisect_left(types, at)  # a type of street to the right, with room for its number and name
            if near == len(types) or types[near] > at + 120:
                continue
            m = _FR_STREET.match(text, at)
            if m:
                yield m.span()
                continue
            m = _EN_STREET.match(text, at)
            if not m:
                continue
            words, kind = m["name"].split(), m["t"].lower()
            if any(w.lower() in NOT_STREET for w in words) or len({w[0].isupper() for w in words}) > 1:
                continue
            capital = words[-1][:1].isupper() and m["t"][:1].isupper()
            if capital or kind in PLAIN_TYPES or _STREET_CUE.search(text, max(0, at - 24), at):
                yield m.span()

    @staticmethod
    def _cued(low: str, at: int, cues: list[tuple[int, int]], between: re.Pattern, reach: int) -> bool:
        """Does one of the cues stand before the place, with nothing but ``between`` in the way."""
        i = bisect_right(cues, at, key=lambda x: x[1])
        while i and cues[i - 1][1] >= at - reach:
            i -= 1
            if between.fullmatch(low, cues[i][1], at):
                return True
        return False

    def _ids(self, text: str, low: str, digits: list[int], cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        for at in digits:
            m = _ID.match(text, at)
            if not m and at > 1:  # two letters may stand before the digits
                m = _ID.match(text, at - 3 if low[at - 1].isspace() and at > 2 else at - 2)
            if not m:
                continue
            cue = self._cued(low, m.start(), cues, _ID_CUE, 40)
            if not cue and _ID_DECOY.search(low, max(0, m.start() - 12), m.start()):
                continue
            if cue or m["nino"] and m["nino"][:2].isupper() or m["ssn"] and m["s"] == "-" or m["dni"] and "-" in m["dni"]:
                yield m.span()

    def _phones(self, text: str, low: str, digits: list[int], cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        done = 0
        for at in digits:
            if at < done:
                continue
            begin = at
            while begin and at - begin < 2 and low[begin - 1] in "+(":
                begin -= 1
            m = next((m for s in range(begin, at + 1) if (m := _PHONE.match(text, s))), None)
            if not m:
                continue
            done = m.end()
            kind = next(k for k in ("plus", "one", "paren", "full", "zero", "ten", "seven") if m[k])
            number = "".join(filter(str.isdigit, m.group()))
            cue = self._cued(low, m.start(), cues, _PHONE_CUE, 30)
            local = number[1:] if kind == "one" or kind == "plus" and number[0] == "1" else number
            # Area codes and exchanges begin with 2 to 9.
            if kind in ("one", "paren", "full", "ten") and not cue and (local[0] in "01" or local[3] in "01"):
                continue
            if kind == "plus" and not 8 <= len(number) <= 15:
                continue
            if kind in ("ten", "zero", "seven") and not cue:
                continue
            if kind == "full" and m["sep"].isspace() and not cue:
                continue
            yield m.span()

    def _titled(self, text: str, low: str, anchors: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Names after a title: one or two capitalized words, with initials before them."""
        for start, end in anchors:
            if start and (low[start - 1].isalnum() or low[start - 1] in "_@.-'’"):
                continue
            m = _AFTER_TITLE.match(text, end)
            if not m or not m["one"][0].isupper() or m["one"].lower() in NOT_GIVEN or m["one"].lower() in NOT_FAMILY or len(m["one"]) < 2:
                continue
            if m["one"].isupper() and len(m["one"]) > 1 and not text[start:end].isupper():
                continue
            s = m.start("lead") if m["lead"] and m["lead"][0].isupper() else m.start("one")
            two = m["two"]
            more = two and two[0].isupper() and len(two) > 1 and two.isupper() == m["one"].isupper() and two.lower() not in NOT_GIVEN and not self._like_family(m["one"].lower())
            yield s, m.end("two") if more else m.end("one")

    def _like_family(self, word: str) -> bool:
        return word in self.family or len(word) > 4 and word.endswith(self.family_ends) and word not in self.family_ends

    def _like_given(self, word: str) -> bool:
        return word in self.given or len(word) > 3 and word.endswith(self.given_ends)

    def _names(self, text: str, low: str, ends: list[int]) -> Iterator[tuple[int, int]]:
        done = -1
        size = len(low)
        for end in ends:
            if end <= done or end < size and (low[end].isalpha() or low[end] in "@_"):
                continue
            s = end
            while s and low[s - 1].isalpha():
                s -= 1
            if s and low[s - 1] in "@._/" and not (low[s - 1] == "." and _INITIAL_DOT.search(low[max(0, s - 3) : s])):
                continue
            if not self._like_family(low[s:end]):
                continue
            e = end
            while m := _HYPHEN_AFTER.match(low, e):
                if not self._like_family(m[1]):
                    break
                e = m.end()
            while m := _HYPHEN_BEFORE.search(low[max(0, s - 40) : s]):
                if not self._like_family(m[1]) and not self._like_given(m[1]):
                    break
                s -= len(m.group())
            capital = text[s].isupper()
            before = low[max(0, s - 60) : s]
            origin = max(0, s - 60)
            title = _TITLE_BEFORE.search(before)
            initials = _INITIALS.search(before)
            if title:
                done = e
                yield s, e
                continue
            start = None
            if initials:
                start = origin + initials.start(1)
                head = low[max(0, start - 40) : start]
                m = _WORD_BEFORE.search(head)
                if m:
                    g = max(0, start - 40) + m.start(1)
                    if self._like_given(m[1]) or text[g].isupper() and m[1] not in NOT_GIVEN and m[1] not in TITLES and not text[g : g + len(m[1])].isupper():
                        start = g
                if not text[origin + initials.start(1)].isupper() and start == origin + initials.start(1):
                    start = None
            else:
                m = _WORD_BEFORE.search(before)
                if m:
                    g = origin + m.start(1)
                    shout = text[g : g + len(m[1])].isupper() and len(m[1]) > 1
                    known = self._like_given(m[1])
                    if known and (m[1] in self.given or capital or len(low[s:e]) > 5):
                        start = g
                    elif capital and text[g].isupper() and m[1] not in NOT_GIVEN and m[1] not in TITLES and not (shout and not text[s:e].isupper()) and len(m[1]) > 1:
                        if not (shout and text[s:e].isupper()) or low[s:e] in self.family:
                            start = g
            if start is None:
                m = _COMMA_AFTER.match(low, e)
                if m and (self._like_given(m[1]) or capital and text[m.start(1)].isupper() and text[s:e].isupper() and not text[m.start(1) : m.end(1)].isupper()):
                    done = m.end()
                    yield s, m.end()
                continue
            done = e
            yield start, e

    def items(self, text: str) -> list[tuple[str, str]]:
        """(kind, item) with the item reduced to its letters and digits, lower-cased."""
        return sorted({(kind, _KEEP.sub("", text[s:e]).lower()) for s, e, kind in self.spans(text)})

    def redact(self, text: str) -> str:
        """The text with a typed placeholder in place of each item."""
        out, at = [], 0
        for s, e, kind in self.spans(text):
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*out, text[at:]])


def _ending_counts(names: DataFrame) -> tuple[str, ...]:
    """``learn_endings`` on a list of any length: only endings that 4 % of the names share come to the driver."""
    low = names.select(F.lower("name").alias("name")).distinct()
    n = low.count()
    ends = low.select(F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, range(3, 7))), lambda k: F.when(F.length("name") > k, F.expr("name").substr(-k, k))))).alias("e"))
    counts = ends.where("e is not null").groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= max(8, 0.04 * n))
    return _longest({r.e: r.n for r in counts.toLocalIterator()})


def _prepared(texts: DataFrame, name_list: DataFrame, max_names: int) -> tuple[DataFrame, list[str], list[str], tuple | None]:
    """The texts (origin, rec_key, text, given, family), and listed names and endings for the ``Finder``."""
    names = name_list.select("name", "kind").where("name is not null and kind in ('given', 'family')").distinct()
    none = F.lit(None).cast("array<string>")
    if names.count() <= max_names:
        rows = [(r.name, r.kind) for r in names.toLocalIterator()]
        held = tuple([n for n, k in rows if k == kind] for kind in ("given", "family"))
        return texts.select("origin", "rec_key", "text", none.alias("given"), none.alias("family")), *held, None
    endings = tuple(_ending_counts(names.where(F.col("kind") == kind)) for kind in ("family", "given"))
    return _listed(texts, names), [], [], endings


def _listed(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Each text with the listed given and family names among its words: a join on the words, not a broadcast."""
    keyed = stage(texts.withColumn("_k", F.sha2(F.concat_ws("\x00", "origin", "rec_key", "text"), 256)).dropDuplicates(["_k"]), "p3-texts")
    words = keyed.select("_k", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    low = names.select(F.lower("name").alias("word"), "kind").distinct()
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("word"))).alias(kind)
    found = words.join(low, "word").groupBy("_k").agg(of("given"), of("family"))  # at most the words of one text
    return keyed.join(found, "_k", "left").select("origin", "rec_key", "text", "given", "family")


def texts_of(synth_records: DataFrame, gate_results: DataFrame) -> DataFrame:
    """(origin, rec_key, text) of records and of the free texts among the reasons of gate runs; a null text is empty."""
    a = synth_records.where("id is not null").select(F.lit("synth_records").alias("origin"), F.col("id").cast("string").alias("rec_key"), F.coalesce("text", F.lit("")).alias("text"))
    reasons = gate_results.where("gate_run_id is not null").select(F.col("gate_run_id").cast("string").alias("rec_key"), F.explode(F.map_keys("reasons_histogram")).alias("text"))
    return a.union(reasons.select(F.lit("gate_results").alias("origin"), "rec_key", "text"))


def find_items(texts: DataFrame, name_list: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """(origin, rec_key, kind, item): each distinct item of each record."""
    prepared, given, family, endings = _prepared(texts, name_list, max_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, family, endings)
        for batch in batches:
            origin, key, texts, *known = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, text in enumerate(texts):
                if endings is not None:
                    finder.know(known[0][i] or [], known[1][i] or [])
                rows += [(origin[i], key[i], kind, item) for kind, item in finder.items(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["origin", "rec_key", "kind", "item"])

    return prepared.mapInArrow(run, "origin string, rec_key string, kind string, item string").distinct()


def redact(texts: DataFrame, name_list: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """(origin, rec_key, redacted): each distinct text of a record with typed placeholders."""
    prepared, given, family, endings = _prepared(texts.distinct(), name_list, max_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, family, endings)
        for batch in batches:
            texts, *known = (batch.column(i).to_pylist() for i in (2, 3, 4))
            clean = []
            for i, text in enumerate(texts):
                if endings is not None:
                    finder.know(known[0][i] or [], known[1][i] or [])
                clean.append(finder.redact(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.string())], names=["origin", "rec_key", "redacted"])

    return prepared.mapInArrow(run, "origin string, rec_key string, redacted string")
