"""Trigram similarity and LIKE patterns, in built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the words of a text: lower case, two blanks before each word and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: padded.substr(k, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigrams_of(text: str) -> list[str]:
    """The same of a query string, worked out once before the plan is built."""
    padded = [f"  {w} " for w in re.split(r"[\W_]+", text.lower()) if w]
    return list(dict.fromkeys(p[k : k + 3] for p in padded for k in range(len(p) - 2)))


def similarity(left: Column, right: Column) -> Column:
    """Shared share of two trigram arrays, in single precision: 3/10 is above a threshold of 0.3."""
    both = F.size(F.array_intersect(left, right)).cast("double")
    every = F.size(left) + F.size(right) - both
    return F.when(every > 0, both / every).otherwise(0.0).cast("float")


def similarity_to(left: Column, query: str) -> Column:
    return similarity(left, F.array(*[F.lit(t) for t in trigrams_of(query)]).cast("array<string>"))


def like_pattern(term: str) -> str:
    """%term% with the user's wildcards; a backslash stays only where it escapes something."""
    return re.sub(r"\\(?![%_\\])|(\\[%_\\])", lambda m: m[1] or "", f"%{term}%")
