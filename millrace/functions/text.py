"""Text functions as Catalyst expressions: words, normal forms, shingles, tokens, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as one character class (Java's \s alone is ASCII).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
PAD, BOS, EOS = 256, 257, 258
VOCABULARY = 259
LENGTH_EDGES = (0, 5, 10, 20, 40, 80, 160, 320, 640)


def filled(text: Column) -> Column:
    """Null text is the empty text."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Words between Unicode white space; none for blank or null text."""
    return F.filter(F.split(filled(text), f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def normalize(text: Column, mode: str = "whitespace") -> Column:
    """``none``; ``whitespace``: runs of blanks become one; ``aggressive``: lower-cased as well."""
    if mode == "none":
        return filled(text)
    if mode not in ("whitespace", "aggressive"):
        raise ValueError(f"unknown normalization {mode!r}")
    flat = F.trim(F.regexp_replace(filled(text), f"{SPACE}+", " "))
    return F.lower(flat) if mode == "aggressive" else flat


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, a blank text has none."""

    def grams(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        short = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(w, " ")))
        return F.when(F.size(w) >= size, F.array_distinct(runs)).otherwise(short)

    # Bound as a lambda variable, the words are split once per text, not once per shingle.
    return F.element_at(F.transform(F.array(words(text)), grams), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; 1 for two empty ones, 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes as an array of small integers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(filled(text), "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("smallint"))


def decode_tokens(tokens: Column) -> Column:
    """Text of byte tokens; special tokens are dropped, invalid UTF-8 is replaced."""
    pairs = F.transform(F.filter(tokens, lambda t: t < 256), lambda t: F.lpad(F.hex(t.cast("long")), 2, "0"))
    return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-8")


def length_bin(count: Column) -> Column:
    """Index of the last edge that the word count reaches."""
    index = F.lit(0)
    for i, edge in enumerate(LENGTH_EDGES):
        index = F.when(count >= edge, F.lit(i)).otherwise(index) if i else index
    return index


def framed_sha256(parts: Column) -> Column:
    """SHA-256 over an array of texts, each followed by a line feed."""
    return F.sha2(F.concat(F.array_join(parts, "\n"), F.when(F.size(parts) > 0, F.lit("\n")).otherwise(F.lit(""))), 256)


def row_json(columns: list[str]) -> Column:
    """The row as JSON with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
