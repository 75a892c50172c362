"""Token-list expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EXTENDED_STOP_WORDS, GAP_PATTERN, MATCH_PATTERN
from .cleaning import clean_ascii, clean_social
from .literals import filter_tokens, is_word

_NO_TOKENS = "cast(array() as array<string>)"


def tokenize_ws(col: Column) -> Column:
    """Lower-case and split at each whitespace character, as Spark ML's ``Tokenizer``.

    Empty text gives one empty token; trailing empty tokens are dropped.
    """
    text = F.lower(col)
    return F.when(text.rlike(r"^\s+$"), F.expr(_NO_TOKENS)).otherwise(
        F.split(F.regexp_replace(text, r"\s+$", ""), r"\s")
    )


def tokenize_gaps(col: Column) -> Column:
    """Lower-case, split at runs outside ``\\w # @ '``, drop empty tokens."""
    return F.filter(F.split(F.lower(col), GAP_PATTERN), lambda t: t != "")


def remove_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Case-insensitive removal; order and repeats stay."""
    return filter_tokens(tokens, f"not {is_word([w.lower() for w in stop_words], 'lower(t)')}")


def dedupe_tokens(tokens: Column) -> Column:
    """First occurrence of each non-empty token, in order."""
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def match_tokens(col: Column, stop_words: Sequence[str]) -> Column:
    """All token matches in the ASCII-cleaned text, before de-duplication.

    Outer apostrophes are stripped; empty, stop-word and all-digit tokens go.
    """
    found = F.regexp_extract_all(clean_ascii(col), F.lit(MATCH_PATTERN), F.lit(0))
    bare = F.transform(found, lambda t: F.btrim(t, F.lit("'")))
    return filter_tokens(bare, f"t <> '' and not {is_word(stop_words)} and not t rlike '^[0-9]+$'")


def tokenize_match(col: Column, stop_words: Sequence[str]) -> Column:
    """:func:`match_tokens`, first occurrences only."""
    return F.array_distinct(match_tokens(col, stop_words))


def social_tokens(col: Column, stop_words: Sequence[str] = tuple(EXTENDED_STOP_WORDS)) -> Column:
    """The main engine's token list: social cleaner, gap tokenizer, extended stop words."""
    return remove_stop_words(tokenize_gaps(clean_social(col)), stop_words)


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """Runs of ``n`` neighbouring tokens joined by ``sep``; too few tokens give none."""
    if n <= 1:
        return tokens
    last = F.size(tokens) - (n - 1)
    # several times faster than joining a slice for each place
    grams = F.transform(
        F.slice(tokens, F.lit(1), last),
        lambda first, i: F.concat_ws(sep, first, *[F.get(tokens, i + d) for d in range(1, n)]),
    )
    return F.when(last >= 1, grams).otherwise(F.expr(_NO_TOKENS))


def sequence_grams(tokens: Column, n: int) -> Column:
    """Underscore-joined n-grams; a length of one or less gives none."""
    return ngrams(tokens, n, "_") if n > 1 else F.expr(_NO_TOKENS)


def keep_vocabulary(grams: Column, vocabulary: Sequence[str]) -> Column:
    """Grams of the vocabulary, in order. An empty vocabulary keeps everything."""
    return filter_tokens(grams, is_word(vocabulary)) if vocabulary else grams


def scenario_features(
    tokens: Column,
    scenario: str,
    gram_length: int = 2,
    sequence_length: int = 3,
    vocabulary: Sequence[str] = (),
) -> Column:
    """Feature set by scenario: ``unigram``, ``bigram``, ``patterns`` or ``all`` of them."""
    parts = {
        "unigram": lambda: tokens,
        "bigram": lambda: sequence_grams(tokens, max(2, gram_length)),
        "patterns": lambda: keep_vocabulary(
            sequence_grams(tokens, max(2, sequence_length)), vocabulary
        ),
    }
    wanted = list(parts) if scenario == "all" else [scenario]
    return dedupe_tokens(F.concat(*[parts[name]() for name in wanted]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united distinct tokens; 0 where both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
