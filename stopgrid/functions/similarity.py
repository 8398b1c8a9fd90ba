"""Trigram word similarity: how well a query matches the best continuous extent of a longer text.

Words of letters and digits are padded with two spaces before and one after; a text's trigrams are those of its words in order. The
similarity is the largest, over all continuous extents of the text's trigrams, of (common distinct trigrams) / (distinct trigrams of the
query and the extent together), an extent beginning and ending at trigrams that the query has.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def trigrams(text: str) -> list[str]:
    out = []
    for w in WORD.findall(text.lower()):
        padded = f"  {w} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def word_similarity(query: str | None, text: str | None) -> float | None:
    if query is None or text is None:
        return None
    want, have = set(trigrams(query)), trigrams(text)
    hits = [i for i, g in enumerate(have) if g in want]
    if not want or not hits:
        return 0.0
    best = 0.0
    for k, i in enumerate(hits):
        seen: set[str] = set()
        common = other = 0
        j = i
        for end in hits[k:]:
            while j <= end:
                g = have[j]
                if g not in seen:
                    seen.add(g)
                    if g in want:
                        common += 1
                    else:
                        other += 1
                j += 1
            best = max(best, common / (len(want) + other))
        if common == 0:
            break
    return best


def word_similarity_to(query: str, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: word_similarity(query, t)).astype("float64")

    return run(text)


def gram_column(text: Column) -> Column:
    """array<string> of a text's distinct trigrams, in built-in functions (for the inverted index)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def candidates(names: DataFrame, column: str, query: str, least: float = 0.6) -> DataFrame:
    """names that can reach the similarity: a match shares at least ``least`` of the query's distinct trigrams, so counting them suffices."""
    want = sorted(set(trigrams(query)))
    held = F.size(F.array_intersect(gram_column(F.col(column)), F.array(*map(F.lit, want))))
    return names.where(held >= least * len(want) - 1e-9)
