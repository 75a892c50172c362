"""Feature tables ``id, label, features, is_test`` by scenario, fitted on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.patterns import with_patterns
from ..functions.tokens import dedupe_tokens, ngrams, scenario_features, sequence_grams
from ..operators.labels import keep_nonempty
from ..operators.vocabulary import (
    frequent_words,
    run_vocabularies,
    sequence_vocabulary,
    term_list,
    with_presence,
)
from ..session import materialize


def with_frequent_patterns(
    rows: DataFrame, fit_on: DataFrame | None = None, top_n: int = C.HFW_TOP_N
) -> DataFrame:
    """Add ``patterns``; the frequent words come from ``fit_on`` (default: all rows)."""
    words = frequent_words(rows if fit_on is None else fit_on, "tokens", top_n)
    return with_patterns(rows, "tokens", "patterns", words)


def _tagged(items: Column, tag: str) -> Column:
    return F.transform(items, lambda t: F.concat(F.lit(tag), t.cast("string")))


def engine_features(rows: DataFrame, scenario: int) -> DataFrame:
    """Main engine's feature sets of ``id, label, is_test, tokens`` (a written table).

    1 unigrams, 2 bigrams, 3 frequent-word patterns within the vocabulary learnt from the
    training rows, 4 all three as separate blocks. Rows without features go. These are the
    features of the ML pipeline before hashing, hence without bucket collisions.
    """
    keys = ["id", "label", "is_test"]
    blocks = {
        1: F.array_distinct("tokens"),
        2: F.array_distinct(ngrams(F.col("tokens"), 2)),
    }
    if scenario in blocks:
        # enough tokens for one feature; cheaper than testing the features themselves
        filled = rows.where(F.size("tokens") >= scenario)
        return filled.select(*keys, blocks[scenario].alias("features"))

    rows = materialize(with_frequent_patterns(rows, rows.where("not is_test")), "patterns")
    vocabulary = term_list(rows.where("not is_test"), "patterns", C.PATTERN_COLUMN_VOCAB)
    rows = with_presence(rows, "patterns", vocabulary)
    if scenario == 3:
        features = _tagged(F.col("indices"), "")
    else:
        features = F.concat(
            _tagged(blocks[1], "u:"), _tagged(blocks[2], "b:"), _tagged(F.col("indices"), "p:")
        )
    out = rows.select(*keys, features.alias("features"))
    return keep_nonempty(materialize(out, "features"), "features")


def harness_features(
    rows: DataFrame, scenario: str, fit_on: DataFrame | None = None
) -> DataFrame:
    """Second feature path: underscore n-grams over de-duplicated match tokens.

    The sequence vocabulary (600 most frequent of length 3) comes from ``fit_on``.
    """
    vocabulary = []
    if scenario in ("patterns", "all"):
        vocabulary = sequence_vocabulary(rows if fit_on is None else fit_on, "tokens")
    features = scenario_features(F.col("tokens"), scenario, vocabulary=vocabulary)
    return rows.withColumn("features", features)


def harness_features_by_run(rows: DataFrame, run: str, scenarios: list[str]) -> DataFrame:
    """``harness_features`` of every scenario, each run with the vocabulary of its training rows.

    One aggregate learns the vocabularies of all runs; they come back to the rows as one list
    a run. Adds ``scenario`` and ``features``; a row stands once for each scenario.
    """
    tokens = F.col("tokens")
    sequences = sequence_grams(tokens, C.SEQUENCE_LENGTH)
    learnt = run_vocabularies(rows.where("not is_test"), [run], sequences, C.SEQUENCE_VOCAB)
    known = F.coalesce("vocabulary", F.expr("cast(array() as array<string>)"))
    # an empty vocabulary keeps everything; array_intersect keeps the order of its first list
    kept = F.when(F.size(known) == 0, sequences).otherwise(F.array_intersect(sequences, known))
    parts = {"unigram": tokens, "bigram": sequence_grams(tokens, 2), "patterns": kept}
    lists = {**{name: [col] for name, col in parts.items()}, "all": list(parts.values())}
    made = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), dedupe_tokens(F.concat(*lists[s])).alias("features"))
            for s in scenarios
        ]
    )
    return rows.join(learnt, run, "left").select(*rows.columns, F.inline(made))
