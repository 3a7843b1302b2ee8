"""Character n-grams, hash and prefix functions."""

from __future__ import annotations

import unicodedata

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


SHORT = 64  # characters


def ngrams(column: Column, n: int = 3, padding: str = "") -> Column:
    """Distinct lower-cased character n-grams, without those of white space or of punctuation and symbols only."""
    if n < 2:
        raise ValueError("n-grams have two characters at least")
    text = F.lower(column)
    if padding:
        text = F.concat(F.lit(padding * (n - 1)), text, F.lit(padding * (n - 1)))
    # one pass cuts the text into characters, which are then reached by their place: linear in the length
    characters = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    long = F.transform(characters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)])))[0]
    short = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))  # cheaper there, but quadratic
    grams = F.when(F.length(text) <= SHORT, short).otherwise(long)
    kept = F.filter(F.array_distinct(grams), lambda g: ~g.rlike(r"(?U)^(\s+|[\p{P}\p{S}]+)$"))
    empty = F.array().cast("array<string>")
    return F.when(F.length(text) >= n, kept).otherwise(F.when(column.isNotNull(), empty))


def python_ngrams(text: str, n: int = 3, padding: str = "") -> list[str]:
    """The same of a literal."""
    text = padding * (n - 1) + text.lower() + padding * (n - 1) if padding else text.lower()
    out = dict.fromkeys(text[k : k + n] for k in range(len(text) - n + 1))
    return [g for g in out if not g.isspace() and not all(unicodedata.category(c)[0] in "PS" for c in g)]


def hash_pair(text: str) -> tuple[int, int]:
    """What :func:`hash_columns` gives for a literal."""
    return tuple(_signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in (text, "~" + text))


def hash_columns(column: Column) -> tuple[Column, Column]:
    return F.xxhash64(column), F.xxhash64(F.concat(F.lit("~"), column))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def common_prefix(a: Column, b: Column) -> Column:
    """Length in characters of the common beginning of two strings."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    return F.when(a.isNull() | b.isNull() | (n == 0), 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))
