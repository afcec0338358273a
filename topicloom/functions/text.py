"""Column expressions over text: tokens, n-grams, labels. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let


def tokens(text: Column | str, stopwords: Iterable[str] = (), lowercase_first: bool = True) -> Column:
    """Runs of a-z and 0-9 of two characters or more that are no stop-words.

    lowercase_first=False strips capitals before lower-casing, as some term extractors do.
    """
    col = F.col(text) if isinstance(text, str) else text
    cleaned = F.regexp_replace(F.lower(col), "[^a-z0-9 ]+", " ") if lowercase_first else F.lower(F.regexp_replace(col, "[^a-z0-9 ]+", " "))
    stop = list(stopwords)
    keep = (lambda t: (F.length(t) >= 2) & ~t.isin(stop)) if stop else (lambda t: F.length(t) >= 2)
    return F.filter(F.split(cleaned, r"\s+"), keep)


def ngrams(toks: Column, low: int = 1, high: int = 1, sep: str = " ") -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by ``sep``; runs of n are made of those of n - 1. ``toks`` should be a column, not an expression."""
    if not 1 <= low <= high:
        raise ValueError("ngram range must be 1 <= low <= high")

    def longer(runs: Column, n: int) -> Column:
        """Runs of n tokens from those of n - 1."""
        return F.zip_with(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(toks, n, F.size(toks)), lambda a, b: F.concat(a, F.lit(sep), b))

    def every(runs: Column, n: int) -> Column:
        more = None if n == high else let(longer(runs, n + 1), lambda r: every(r, n + 1))
        return more if n < low else runs if more is None else F.concat(runs, more)

    return every(toks, 1)


def topic_label(topic: Column, terms: Column) -> Column:
    """``{topic}_{first four terms}``; -1 is named outliers."""
    return F.when(topic == -1, F.lit("-1_outliers")).otherwise(F.concat_ws("_", topic.cast("string"), F.array_join(F.slice(terms, 1, 4), "_")))


def display_label(label: Column | str, max_chars: int = 30) -> Column:
    """A label for figures: no leading id, spaces for underscores, at most ``max_chars``."""
    col = F.col(label) if isinstance(label, str) else label
    plain = F.trim(F.replace(F.regexp_replace(col, "^-?[0-9]+_", ""), F.lit("_"), F.lit(" ")))
    return F.when(F.length(plain) > max_chars, F.concat(F.substring(plain, 1, max_chars - 1), F.lit("..."))).otherwise(plain)
