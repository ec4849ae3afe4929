"""Quality rules: each a predicate over the text as a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, filled, strip

#: Phrases of page chrome that the boilerplate rule counts.
BOILERPLATE_MARKERS = (
    "click here",
    "accept cookies",
    "privacy policy",
    "terms of service",
    "sign up for our newsletter",
    "unsubscribe",
    "enable javascript",
    "loading...",
    "all rights reserved",
    "subscribe",
)
#: Signatures of a wrong decoder, and what counts as personal data.
MOJIBAKE = r"\x{FFFD}|\x{C3}[\x{A2}\x{201A}\x{C2}\x{A9}\x{E2}]|\x{E2}\x{201A}\x{AC}|\x{C3}\x{A2}\x{E2}"
CONTROLS = r"[\p{Cc}\p{Cn}&&[^\n]]"
EMAIL = r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PHONE = r"(?U)\(\d{3}\)\s*\d{2,4}|\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
SENTENCE_END = r"(?U)[.!?]+\s+|\n+"


def marker_hits(text: Column) -> Column:
    """Number of distinct markers the text contains."""
    low = F.lower(filled(text))
    return reduce(add, (F.contains(low, F.lit(m)).cast("int") for m in BOILERPLATE_MARKERS)).cast("long")


def sentences(text: Column) -> Column:
    """Trimmed, lower-cased, non-blank sentences."""
    parts = F.transform(F.split(filled(text), SENTENCE_END), lambda s: F.lower(strip(s)))
    return F.filter(parts, lambda s: s != "")


def _non_empty(text: Column, cfg) -> Column:
    return filled(text).rlike(NOT_SPACE)


def _min_words(text: Column, cfg) -> Column:
    # As many words as asked for, and no count of the rest of the text.
    more = rf"(?:{NOT_SPACE}++{SPACE}++){{{cfg.min_words - 1}}}" if cfg.min_words > 1 else ""
    return filled(text).rlike(more + NOT_SPACE) if cfg.min_words > 0 else F.lit(True)


def _no_mojibake(text: Column, cfg) -> Column:
    t = filled(text)
    # All signatures hold a sign beyond ASCII, so most texts need no search for them.
    return ~(((F.octet_length(t) > F.length(t)) & t.rlike(MOJIBAKE)) | t.rlike(CONTROLS))


def _no_boilerplate_markers(text: Column, cfg) -> Column:
    return marker_hits(text) < cfg.boilerplate_marker_threshold


def _no_repeated_sentences(text: Column, cfg) -> Column:
    parts = sentences(text)
    n = F.size(parts)
    repeated = (n - F.size(F.array_distinct(parts))) / F.greatest(n, F.lit(1))
    return F.when(n < 3, F.lit(True)).otherwise(repeated <= cfg.max_duplicate_sentence_ratio)


def _no_pii(text: Column, cfg) -> Column:
    t = filled(text)
    # Plain searches for the sign and for three digits spare most texts the costly patterns.
    return ~((F.contains(t, F.lit("@")) & t.rlike(EMAIL)) | (t.rlike(r"\p{Nd}{3}") & (t.rlike(PHONE) | t.rlike(SSN))))


#: The registry is the extension point: name -> predicate (true: the text passes).
RULES: dict[str, Callable[[Column, object], Column]] = {
    "non_empty": _non_empty,
    "min_words": _min_words,
    "no_mojibake": _no_mojibake,
    "no_boilerplate_markers": _no_boilerplate_markers,
    "no_repeated_sentences": _no_repeated_sentences,
    "no_pii": _no_pii,
}


def failed_rules(text: Column, cfg) -> Column:
    """Names of the failed rules, in the order of the config."""
    return F.filter(F.array(*[F.when(~RULES[name](text, cfg), F.lit(name)) for name in cfg.rules]), lambda x: x.isNotNull())
