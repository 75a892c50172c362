"""Quality rules: base rules on words and lines, and suffix-array repetition inside a text.

The suffix array of a text's words is built by refining groups: suffixes that share their
first h words are sorted by the group of what follows h words later, for h = 1, 2, 4, ...;
only suffixes that are not yet alone in their group are sorted again. The ranks of each round
give the longest common prefix of neighbours in the array. Runs of neighbours whose common
prefix is at least ``min_words`` are the intervals of repeated substrings; the longest match
of a position with any other is the larger of its two neighbours', a match that does not
begin one word earlier is maximal, and the union of the maximal matches' spans is what
repetition covers. A text is rejected if repetition of ``min_words`` or more covers more than
``max_covered`` of its words, or if its longest repeat has more than ``max_repeat`` words.

Many texts are handled at once, with each text's words numbered apart, so no repeat crosses
texts. Memory is bounded by a slice of 2 MB of text, or by one longer text.

Edge cases: null and empty texts have no words, fail the base rules and are rejected; null
ids and repeated rows get a row each; ties in the array (equal rests of a text) cannot occur
inside a text, as the text's end sorts first; an empty table gives an empty result; further
columns, whatever their names, are left alone or (``quality_filter``) passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import BLANK_WORDS, Words, as_strings, covered, slices, words_of


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; the first two are the base rules, the others those of the suffix array."""

    min_words: int = 50
    max_repeat_percent: int = 50
    window: int = 3
    repeat_words: int = 10
    max_covered: float = 0.3
    max_repeat: int = 100


def suffix_matches(words: Words) -> np.ndarray:
    """For each word position, the longest match (in words) with another position of its text."""
    n, texts = len(words.codes), len(words.starts) - 1
    if not n:
        return np.zeros(0, np.int64)
    owner = words.owner()
    ends = words.starts[1:][owner]
    # ranks of single words: a group is numbered by the place of its first suffix in the order
    key = owner.astype(np.int64) * (int(words.codes.max()) + 1) + words.codes
    order = np.argsort(key, kind="stable")
    rank = _group_starts(key[order])
    ranks = [np.empty(n, np.int64)]
    ranks[0][order] = rank
    # places of the order whose group has several suffixes, in order
    active = _several(rank)
    h, current = 1, ranks[0].copy()
    while len(active):
        at = order[active]
        follower = at + h
        # the end of the text sorts before any rank
        inside = follower < ends[at]
        second = np.where(inside, current[np.where(inside, follower, 0)] + 1, 0)
        first = current[at]
        again = np.lexsort((second, first))
        order[active] = at[again]
        pairs = first[again] * (n + 1) + second[again]
        begins = np.ones(len(active), bool)
        begins[1:] = pairs[1:] != pairs[:-1]
        fresh = active[np.maximum.accumulate(np.where(begins, np.arange(len(active)), 0))]
        current[order[active]] = fresh
        ranks.append(current.copy())
        active = active[_several_mask(fresh)]
        h *= 2
    # common prefixes of neighbours in the array, from the longest step down
    left, right = order[:-1], order[1:]
    same_text = owner[left] == owner[right]
    match = np.zeros(n - 1, np.int64)
    pairs = np.flatnonzero(same_text & (ranks[0][left] == ranks[0][right]))
    a, b = left[pairs], right[pairs]
    length, end = np.zeros(len(pairs), np.int64), ends[a]
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        x, y = a + length, b + length
        ok = np.maximum(x, y) + step <= end
        equal = np.zeros(len(pairs), bool)
        equal[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
        length += step * equal
    match[pairs] = length
    best = np.zeros(n, np.int64)
    best[left] = match
    np.maximum.at(best, right, match)
    return best


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    begins = np.ones(len(ordered), bool)
    begins[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(begins, np.arange(len(ordered)), 0))


def _several_mask(groups: np.ndarray) -> np.ndarray:
    same = np.zeros(len(groups), bool)
    same[1:] = groups[1:] == groups[:-1]
    same[:-1] |= groups[:-1] == groups[1:]
    return same


def _several(groups: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_several_mask(groups))


def maximal_spans(words: Words, best: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the maximal repeated substrings' occurrences of ``least`` words or more."""
    before = np.zeros(len(best), np.int64)
    before[1:] = best[:-1]
    filled = words.starts[:-1][np.diff(words.starts) > 0]
    before[filled] = 0  # the word before belongs to another text
    start = np.flatnonzero((best >= least) & (before != best + 1))
    return start, best[start]


def spans_covered(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True for each word inside a span."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + length, -1)
    return covered(marks)


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])[starts[1:]] - np.concatenate([[0], np.cumsum(values)])[starts[:-1]]


_SYMBOLS = bytes(1 if chr(b) in "#*$%&|<>" else 0 for b in range(256))


def _duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array, rules: QualityRules) -> pa.RecordBatch:
    """The counts, repetition measures and verdicts of whole texts."""
    texts = as_strings(texts)
    words = words_of(texts, BLANK_WORDS)
    counts = np.diff(words.starts)
    letters = np.asarray(pc.utf8_length(words.vocabulary), dtype=np.int64) if len(words.vocabulary) else None
    chars = _per_text(letters[words.codes], words.starts) if letters is not None else np.zeros(len(counts), np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = data.to_pybytes()[at[0] : at[-1]] if data is not None else b""
    symbols = _per_text(np.frombuffer(raw.translate(_SYMBOLS), np.uint8).astype(np.int64), at - at[0])
    lines = [_duplicate_lines(t) for t in texts.to_pylist()]
    best = suffix_matches(words)
    short = spans_covered(len(best), *maximal_spans(words, best, rules.window))
    repeated = _per_text(short.astype(np.int64), words.starts)
    start, length = maximal_spans(words, best, rules.repeat_words)
    spread = _per_text(spans_covered(len(best), start, length).astype(np.int64), words.starts)
    longest = np.zeros(len(counts), np.int64)
    filled = counts > 0
    if filled.any():
        longest[filled] = np.maximum.reduceat(best, words.starts[:-1][filled])
    share = spread / np.maximum(counts, 1)
    failed = (counts < rules.min_words) | (100 * repeated > rules.max_repeat_percent * counts)
    kept = ~failed & (share <= rules.max_covered) & (longest <= rules.max_repeat)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(counts, pa.int64()),
            pa.array(chars, pa.int64()),
            pa.array(symbols, pa.int64()),
            pa.array(lines, pa.int64()),
            pa.array(repeated, pa.int64()),
            pa.array(spread, pa.int64()),
            pa.array(longest, pa.int64()),
            pa.array(failed),
            pa.array(kept),
        ],
        MEASURES,
    )


MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_covered_words",
    "longest_repeat",
    "base_failed",
    "kept",
]
_TYPES = ", ".join(f"{m} {'boolean' if m in ('base_failed', 'kept') else 'bigint'}" for m in MEASURES)


def quality_measures(df: DataFrame, key: str, text: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row: the key, the counts, the repetition measures and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = measures(batch.column("_text"), rules)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *found.columns], ["_key", *MEASURES])

    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"_key {kind}, {_TYPES}").withColumnRenamed("_key", key)


def quality_filter(df: DataFrame, text: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that the rules keep, all columns as they are; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(measures(batch.column(text), rules).column("kept"))

    return df.mapInArrow(run, df.schema)


def repeated_spans(df: DataFrame, key: str, text: str, least: int = 10) -> DataFrame:
    """(key, first_word, n_words, words): each occurrence of a maximal repeated substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"), BLANK_WORDS)
            start, length = maximal_spans(words, suffix_matches(words), least)
            owner = words.owner()[start] if len(start) else start
            said = [
                " ".join(words.vocabulary.take(pa.array(words.codes[a : a + n])).to_pylist())
                for a, n in zip(start, length)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array(owner, pa.int64())),
                    pa.array(start - words.starts[:-1][owner] if len(start) else start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(said, pa.string()),
                ],
                ["_key", "first_word", "n_words", "words"],
            )

    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    found = slim.mapInArrow(run, f"_key {kind}, first_word bigint, n_words bigint, words string")
    return found.withColumnRenamed("_key", key)
