"""Exact Jaccard join of test with training rows for small distances, by a prefix index.

Sets with similarity of at least s share at least ``ceil(s * n)`` tokens of a set of n. So in any
order of the tokens that all rows keep, two such sets have a common token among the first
``n - ceil(s * n) + 1`` of each (their prefixes). Frequent tokens come last in the order, so that
prefixes hold rare ones: the ``COMMON`` most frequent by rising count, all others before them
by hash. The order decides what the join costs, never what it finds.

Index: rows are dealt to blocks (``similarity_join.meet``). In a training block of about ``PIECE`` rows, a
row enters the list of each token of its prefix, with its place there. A test row looks its prefix tokens
up in each block's lists, and an id once is kept. Each common token of two prefixes bounds the overlap:
those before it, itself, and the smaller of what is left in the two sets behind it; so does their number,
with what a set has behind its prefix. Pairs whose bounds, or sizes, rule the similarity out go. What is
left is scored exactly in the same place, so neither lists nor candidates are shuffled or written.

For distances near 1 prefixes are whole sets and nearly all pairs share a token: take
``similarity_join``, which compares blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import list_sizes
from .similarity_join import Found, Postings, _Side, block_counts, meet, near_candidates
from .vocabulary import top_terms

COMMON = 4096
"""Tokens that are ordered by their number of rows: that many reach the tasks with the function."""
PIECE = 4096
"""Training rows that are indexed together."""


def common_tokens(rows: DataFrame, most: int = COMMON) -> list[int]:
    """Hashes of the most frequent tokens, the most frequent last."""
    top = top_terms(rows, F.col("features"), most).select(F.xxhash64("term").alias("h"), "n_uses", "term")
    return [r["h"] for r in sorted(top.collect(), key=lambda r: (r["n_uses"], r["term"]))]


def least_overlap(similarity: float, size: np.ndarray) -> np.ndarray:
    """The least overlap that a set of ``size`` needs (rounding may only make it smaller)."""
    return np.maximum(np.ceil(similarity * size - 1e-9), 1).astype(np.int64)


def prefix_udf(similarity: float, common: list[int]):
    """A set's prefix in order: its token hashes."""
    listed = np.array(common, dtype=np.int64)
    by_hash = np.argsort(listed)
    known, place = listed[by_hash], by_hash + 1

    @F.arrow_udf("array<bigint>")
    def prefix(tokens: pa.Array) -> pa.Array:
        sizes = list_sizes(tokens)
        values = np.asarray(tokens.flatten(), dtype=np.int64)
        late = np.zeros(len(values), np.int64)
        if len(known) and len(values):
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            late = np.where(known[at] == values, place[at], 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((values, late, owner))
        inside = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = np.where(sizes > 0, sizes - least_overlap(similarity, sizes) + 1, 0)
        kept = inside < length[owner]
        ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order][kept]))

    return prefix


def _candidates(tests: _Side, trains: _Side, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` of the pairs that prefixes, sizes and places allow, in order of ``i``."""

    def bounds(side: _Side) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(side.size - least_overlap(similarity, side.size) + 1)])

    starts, ends = bounds(trains), bounds(tests)
    length = np.diff(starts)
    owner = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(owner)) - np.repeat(starts[:-1], length)
    index, parts = Postings(trains.extra["prefix"]), []
    for i in range(len(tests.id)):
        entries, before = index.of(tests.extra["prefix"][ends[i] : ends[i + 1]])
        j, own = owner[entries], tests.size[i]
        larger = np.maximum(own, trains.size[j])
        fits = np.flatnonzero(np.minimum(own, trains.size[j]) >= least_overlap(similarity, larger))
        fits = fits[np.lexsort((before[fits], j[fits]))]
        j, before, behind, larger = j[fits], before[fits], place[entries[fits]], larger[fits]
        if not len(j):
            continue
        other = trains.size[j]
        opens = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
        shared = np.diff(np.append(opens, len(j)))
        nth = np.arange(len(j)) - np.repeat(opens, shared)
        most = nth + 1 + np.minimum(own - before - 1, other - behind - 1)
        # of the prefix that ends first in the order, all common tokens are counted; behind it a set
        # has one token less than ``least_overlap``
        most = np.minimum(most, np.repeat(shared, shared) + least_overlap(similarity, larger) - 1)
        needed = least_overlap(similarity / (1 + similarity), own + other)
        good = opens[np.minimum.reduceat(most - needed, opens) >= 0]
        parts.append((np.full(len(good), i), j[good]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _met(rows: DataFrame, threshold: float, below: float) -> DataFrame:
    """The pairs that may be below ``threshold``, each once, scored; those below ``below`` are kept."""
    similarity = 1 - threshold
    prefix = prefix_udf(similarity, common_tokens(rows))(F.transform("features", lambda t: F.xxhash64(t)))

    def match(tests: _Side, trains: _Side, bound: np.ndarray) -> list[Found]:
        i, j = _candidates(tests, trains, similarity)
        return [near_candidates(tests, trains, i, j, np.zeros(len(i), np.int32), below, bound)]

    return meet(rows.withColumn("prefix", prefix), block_counts(rows, train_rows=PIECE), match, extra=["prefix"]).drop("first")


def prefix_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """All (test, train) pairs with Jaccard distance strictly below ``threshold``, with scores.

    ``rows`` is a written table ``id, label, features, is_test`` with distinct features.
    """
    return _met(rows, threshold, threshold)


def candidate_count(rows: DataFrame, threshold: float) -> int:
    """How many pairs ``prefix_pairs`` scores (each has a common token of two prefixes)."""
    return _met(rows, threshold, np.inf).count()
