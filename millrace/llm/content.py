"""The content of a text: its letters and digits, and what counts as fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_CONTENT = r"[^\p{L}\p{Nd}]+"
_HAS_CONTENT = r"[\p{L}\p{Nd}]"
_BLANK = r"[\s\x1c-\x1f\x85\p{Z}\p{Cf}]"
_LABEL = rf"^[^\p{{L}}\p{{N}}]*\p{{L}}+(?:{_BLANK}+\p{{L}}+){{0,2}}{_BLANK}*[:=]"


def stripped(text: Column) -> Column:
    """Letters and digits in order, lower-cased; both lower-case sigmas count as one."""
    return F.translate(F.lower(F.regexp_replace(text, _NOT_CONTENT, "")), "ς", "σ")


def _occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def is_fielded(text: Column) -> Column:
    """True if the text, cut at line feeds, ``;`` and ``|``, is three or more labelled pieces."""
    cuts = _occurrences(text, "\n") + _occurrences(text, ";") + _occurrences(text, "|")
    labels = _occurrences(text, ":") + _occurrences(text, "=")
    pieces = _pieces(text)
    labelled = (F.size(pieces) >= 3) & F.forall(pieces, lambda p: p.rlike(_LABEL))
    return F.when((cuts >= 2) & (labels >= 3), labelled).otherwise(F.lit(False))


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, r"[\n;|]"), lambda p: p.rlike(_HAS_CONTENT))


def content(text: Column) -> Column:
    """Canonical content: equal exactly for texts that differ in formatting only."""
    fields = F.array_join(F.array_sort(F.transform(_pieces(text), stripped)), "|")
    return F.when(is_fielded(text), F.concat(F.lit("|"), fields)).otherwise(stripped(text))
