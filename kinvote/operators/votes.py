"""Neighbour votes, predictions and metrics. ``runs`` are configuration key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT_UNIT = 10**12  # similarities are summed as integers: the sum has no rounding order
ZERO_SIMILARITY_WEIGHT = 10**6  # fixed value: 1e-6 of a vote


def plain_votes(neighbors: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours per (test row, candidate class)."""
    return neighbors.groupBy(*runs, "test_id", "test_label", "train_label").agg(
        F.count("*").alias("votes")
    )


def similarity_weight() -> Column:
    scaled = F.expr(f"(overlap * {WEIGHT_UNIT}L) div union_size")
    return F.when(F.col("overlap") > 0, scaled).otherwise(F.lit(ZERO_SIMILARITY_WEIGHT))


def weighted_votes(neighbors: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """Summed Jaccard similarity per (test row, candidate class), in units of 1e-12.

    A neighbour without any shared token counts 1e-6.
    """
    return neighbors.groupBy(*runs, "test_id", "test_label", "train_label").agg(
        F.sum(similarity_weight().cast("bigint")).alias("votes")
    )


def vote_winner(votes: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """The class with most votes per test row; the smaller class wins a tie.

    A minimum, so votes combine before the shuffle and nothing is sorted.
    """
    best = F.min(F.struct((-F.col("votes")).alias("fewest"), F.col("train_label").alias("winner")))
    return votes.groupBy(*runs, "test_id").agg(best.alias("best")).select(
        *runs, "test_id", F.col("best.winner").alias("prediction")
    )


def predict_with_fallback(
    tests: DataFrame, winners: DataFrame, fallback: Column, runs: tuple[str, ...] = ()
) -> DataFrame:
    """Every test row with its prediction; ``fallback`` where it has no neighbour."""
    joined = tests.join(winners, [*runs, "test_id"], "left")
    return joined.withColumn("is_fallback", F.col("prediction").isNull()).withColumn(
        "prediction", F.coalesce("prediction", fallback)
    )


def accuracy(predictions: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """``n_correct, test_size, n_fallback, accuracy`` (0 where there are no test rows)."""
    hit = F.coalesce(F.col("prediction") == F.col("test_label"), F.lit(False))
    out = predictions.groupBy(*runs).agg(
        F.count(F.when(hit, F.lit(1))).alias("n_correct"),
        F.count("*").alias("test_size"),
        F.count(F.when(F.col("is_fallback"), F.lit(1))).alias("n_fallback"),
    )
    share = F.when(F.col("test_size") > 0, F.col("n_correct") / F.col("test_size"))
    return out.withColumn("accuracy", F.coalesce(share, F.lit(0.0)))


def at_each_k(neighbors: DataFrame, k_values: list[int]) -> DataFrame:
    """One ranked neighbour table serves every k: a row counts for each k >= its rank."""
    ks = ", ".join(str(k) for k in sorted(set(k_values)))
    return neighbors.withColumn("k", F.expr(f"explode(filter(array({ks}), k -> rank <= k))"))


def for_each_k(tests: DataFrame, k_values: list[int]) -> DataFrame:
    ks = ", ".join(str(k) for k in sorted(set(k_values)))
    return tests.withColumn("k", F.expr(f"explode(array({ks}))"))


def evaluate(
    neighbors: DataFrame,
    tests: DataFrame,
    runs: tuple[str, ...],
    weighted: bool = False,
) -> DataFrame:
    """One metrics row per configuration.

    ``tests`` has the configuration columns, ``test_id, test_label``, and the ``fallback``
    class and ``train_size`` of the configuration.
    """
    votes = (weighted_votes if weighted else plain_votes)(neighbors, runs)
    predictions = predict_with_fallback(
        tests, vote_winner(votes, runs), F.col("fallback"), runs
    )
    pairs = neighbors.groupBy(*runs).agg(F.count("*").alias("neighbor_pairs"))
    sizes = tests.groupBy(*runs).agg(F.max("train_size").alias("train_size"))
    return (
        accuracy(predictions, runs)
        .join(sizes, list(runs))
        .join(pairs, list(runs), "left")
        .fillna(0, subset=["neighbor_pairs"])
        .withColumn("avg_candidates", F.col("neighbor_pairs") / F.col("test_size"))
        .select(
            *runs,
            "accuracy",
            "avg_candidates",
            "neighbor_pairs",
            "n_fallback",
            "test_size",
            "train_size",
        )
    )
