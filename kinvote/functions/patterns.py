"""Frequent-word patterns: rare words become ``*``, windows over the masked stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PATTERN_MAX_N, PATTERN_MIN_HFW, PATTERN_MIN_N
from .literals import is_word, map_tokens

_MASK = "*"


def mask_rare_words(tokens: Column, frequent: Sequence[str]) -> Column:
    """Keep the frequent words; every other token becomes ``*``."""
    return map_tokens(tokens, f"if({is_word(frequent)}, t, '{_MASK}')")


def _windows(masked: Column, hits: Column, n: int, min_frequent: int) -> Column:
    last = F.size(masked) - (n - 1)

    def frequent_count(start):
        return reduce(lambda total, d: total + F.get(hits, start + d), range(1, n), F.get(hits, start))

    starts = F.filter(
        F.sequence(F.lit(0), last - 1), lambda i: frequent_count(i) >= min_frequent
    )
    joined = F.transform(starts, lambda i: F.concat_ws("_", *[F.get(masked, i + d) for d in range(n)]))
    return F.when(last >= 1, joined).otherwise(F.expr("cast(array() as array<string>)"))


def with_patterns(
    df: DataFrame,
    tokens_col: str,
    output_col: str,
    frequent: Sequence[str],
    min_n: int = PATTERN_MIN_N,
    max_n: int = PATTERN_MAX_N,
    min_frequent: int = PATTERN_MIN_HFW,
    cap: int | None = None,
) -> DataFrame:
    """Add the distinct patterns of each row in (length, position) order.

    ``cap`` keeps the first so many of a row only, which drops the rest of a long text: meant
    for short messages, and off unless asked for. Then there is one stage per window length, so a
    row that has reached its cap skips the longer windows; else one pass finds the distinct ones.
    """
    masked, hits, found = (f"__{output_col}_{part}" for part in ("masked", "hits", "found"))
    none = F.expr("cast(array() as array<string>)")
    df = df.withColumn(masked, mask_rare_words(F.col(tokens_col), frequent)).withColumn(
        hits, F.transform(masked, lambda t: (t != _MASK).cast("int"))
    )
    lengths = range(min_n, max_n + 1)
    if not cap:
        lists = [_windows(F.col(masked), F.col(hits), n, min_frequent) for n in lengths]
        return df.withColumn(output_col, F.array_distinct(F.concat(none, *lists))).drop(masked, hits)
    df = df.withColumn(found, none)
    for n in lengths:
        more = F.array_union(F.col(found), _windows(F.col(masked), F.col(hits), n, min_frequent))
        df = df.withColumn(found, F.when(F.size(found) >= cap, F.col(found)).otherwise(more))
    return df.withColumn(output_col, F.slice(found, 1, cap)).drop(masked, hits, found)
