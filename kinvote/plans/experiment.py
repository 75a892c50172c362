"""Experiments: single evaluation, grid, fraction sweep and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.forest import forest_topk, with_signature
from ..operators.labels import count_per_class, keep_nonempty
from ..operators.sampling import clamp_fractions, split_stratified, with_position
from ..operators.similarity_join import block_pairs, rank_neighbors, topk_pairs
from ..operators.votes import at_each_k, evaluate, for_each_k
from ..session import materialize
from .features import engine_features, harness_features_by_run

RESULT_KEYS = ["use_neutral", "scenario", "num_hash_tables", "k"]


def fallback_and_size(rows: DataFrame) -> tuple[int | None, int]:
    """Majority class of the training rows (the smaller wins a tie) and their number.

    One pass; a row per class reaches the driver.
    """
    counts = [(r["n_rows"], r["label"]) for r in count_per_class(rows.where("not is_test")).collect()]
    if not counts:
        return None, 0
    return min(counts, key=lambda c: (-c[0], c[1]))[1], sum(n for n, _ in counts)


def _tests(rows: DataFrame) -> DataFrame:
    fallback, train_size = fallback_and_size(rows)
    return rows.where("is_test").select(
        F.col("id").alias("test_id"),
        F.col("label").alias("test_label"),
        F.lit(fallback).cast("int").alias("fallback"),
        F.lit(train_size).cast("bigint").alias("train_size"),
    )


def knn_evaluate(rows: DataFrame, k: int, threshold: float = C.DISTANCE_THRESHOLD) -> DataFrame:
    """Exact join, top-k, plain vote, fallback: one metrics row."""
    near = materialize(topk_pairs(rows, k, threshold), "ranked")  # read twice: the pairs are found once
    neighbors = near.withColumn("k", F.lit(k))
    return evaluate(neighbors, for_each_k(_tests(rows), [k]), ("k",))


def lsh_topk(
    rows: DataFrame, k: int, table_counts: list[int], threshold: float, seed: int = C.SEED
) -> DataFrame:
    """Ranked neighbours ``num_hash_tables, test_id, ..., rank`` of the LSH join per table count.

    The join has one hash a table: a pair takes part if any table agrees and its distance is
    below the threshold. One signature of the largest table count serves all, as its first n
    values are the signature with n tables; one pass over the blocks finds, for each table
    count, what can be among the k nearest.
    """
    near = block_pairs(with_signature(rows, max(table_counts), seed), threshold, k, table_counts)
    counts = ", ".join(str(n) for n in sorted(set(table_counts)))
    per_count = near.withColumn(
        "num_hash_tables", F.expr(f"explode(filter(array({counts}), n -> first_table <= n))")
    )
    return rank_neighbors(per_count, k, ("num_hash_tables", "test_id"))


def knn_grid(
    rows: DataFrame,
    scenarios: list[int] = (1, 2, 3, 4),
    table_counts: list[int] = tuple(C.NUM_HASH_TABLES),
    k_values: list[int] = tuple(C.K_VALUES),
    threshold: float = C.DISTANCE_THRESHOLD,
    use_neutral: bool = False,
    seed: int = C.SEED,
) -> DataFrame:
    """Scenario x hash tables x k: one metrics row per cell.

    ``rows`` is a written table ``id, label, is_test, tokens``. Per scenario one neighbour
    table at the largest k and table count serves every cell.
    """
    counts = ", ".join(str(n) for n in sorted(set(table_counts)))

    def one(scenario: int) -> DataFrame:
        features = engine_features(rows, scenario)
        ranked = materialize(
            lsh_topk(features, max(k_values), list(table_counts), threshold, seed), "ranked"
        )
        tests = for_each_k(_tests(features), list(k_values)).withColumn(
            "num_hash_tables", F.expr(f"explode(array({counts}))")
        )
        cells = evaluate(at_each_k(ranked, list(k_values)), tests, ("num_hash_tables", "k"))
        return cells.withColumn("scenario", F.lit(scenario))

    out = reduce(DataFrame.unionByName, [one(s) for s in scenarios])
    return out.withColumn("use_neutral", F.lit(int(use_neutral)))


def nested_samples(
    rows: DataFrame, fractions: list[float], base: int, seed: int = C.SEED
) -> DataFrame:
    """``rows`` once per fraction it is in, with ``fraction``; smaller samples are nested.

    One position in the stable random order decides all fractions.
    """
    sizes = F.array(
        *[
            F.struct(F.lit(f).alias("fraction"), F.lit(max(1, int(round(base * f)))).alias("size"))
            for f in clamp_fractions(fractions)
        ]
    )
    placed = with_position(rows, "id", seed)
    taken = F.explode(F.filter(sizes, lambda s: F.col("position") <= s["size"]))
    return placed.withColumn("sample", taken).select(
        *rows.columns, F.col("sample.fraction").alias("fraction")
    )


def fraction_sweep(
    rows: DataFrame,
    scenarios: list[str] = tuple(C.SCENARIOS),
    fractions: list[float] = tuple(C.FRACTIONS),
    base: int = C.BASE_SAMPLE,
    table_counts: list[int] = tuple(C.NUM_HASH_TABLES),
    k_values: list[int] = tuple(C.K_VALUES),
    test_fraction: float = C.TEST_FRACTION,
    seed: int = C.SEED,
) -> DataFrame:
    """Scenario x fraction x hash tables x k with the forest and the weighted vote.

    ``rows`` is a written table ``id, label, tokens``. All (scenario, fraction) runs and table
    counts share one plan: the run is a key of every join, so the grid is one set of shuffles and
    not one job per cell; a smaller table count is the first trees of the largest. Vocabularies are fitted on the training rows of
    each sample, all of them in one aggregate, hence the split comes before the features.
    """
    runs = ("scenario", "fraction")
    samples = materialize(nested_samples(rows, list(fractions), base, seed), "samples")
    split = materialize(
        split_stratified(samples, "id", test_fraction, seed, ("fraction", "label")), "split"
    )
    featured = harness_features_by_run(split, "fraction", list(scenarios))
    featured = featured.select(*runs, "id", "label", "is_test", "features")
    featured = keep_nonempty(materialize(featured, "sweep"), "features")

    order = Window.partitionBy(*runs).orderBy(F.desc("n"), "label")
    classes = featured.where("not is_test").groupBy(*runs, "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*runs))
    majority = (
        classes.withColumn("train_size", total)
        .withColumn("r", F.row_number().over(order))
        .where("r = 1")
        .select(*runs, F.col("label").alias("fallback"), "train_size")
    )
    tests = (
        featured.where("is_test")
        .select(*runs, F.col("id").alias("test_id"), F.col("label").alias("test_label"))
        .join(F.broadcast(majority), list(runs), "left")  # one row per run
    )
    near = forest_topk(featured, max(k_values), list(table_counts), seed, runs)
    near = materialize(near, "sweep-ranked")
    counts = ", ".join(str(n) for n in sorted(set(table_counts)))
    cells = for_each_k(tests, list(k_values)).withColumn("num_hash_tables", F.expr(f"explode(array({counts}))"))
    return evaluate(at_each_k(near, list(k_values)), cells, (*runs, "num_hash_tables", "k"), weighted=True)


def best_config(results: DataFrame, keys: list[str]) -> DataFrame:
    """The most accurate configuration; ties by the configuration keys."""
    return results.orderBy(F.desc("accuracy"), *keys).limit(1)


def results_sorted(results: DataFrame, keys: list[str] = RESULT_KEYS) -> DataFrame:
    return results.orderBy(*keys)


def best_per_run(
    results: DataFrame,
    runs: tuple[str, ...],
    keys: list[str],
    costs: tuple[str, str] = ("training_time_sec", "evaluation_time_sec"),
    total: str = "total_time_sec",
) -> DataFrame:
    """Best row per run: accuracy, then the smaller sum of ``costs``, then configuration keys.

    The second cost may be missing, as a column or in rows; it then counts 0. ``total`` names
    the sum.
    """
    zero = F.lit(0.0)
    second = F.coalesce(F.col(costs[1]), zero) if costs[1] in results.columns else zero
    summed = results.withColumn(costs[1], second).withColumn(total, F.col(costs[0]) + F.col(costs[1]))
    order = Window.partitionBy(*runs).orderBy(F.desc("accuracy"), total, *keys)
    return summed.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def sweep_summary(
    results: DataFrame,
    base: int,
    costs: tuple[str, str] = ("training_time_sec", "evaluation_time_sec"),
    total: str = "total_time_sec",
) -> DataFrame:
    """Best row per (scenario, fraction) with the sample sizes of the run."""
    size = F.greatest(F.lit(1), F.rint(F.col("fraction") * base).cast("bigint"))
    best = best_per_run(results, ("scenario", "fraction"), ["num_hash_tables", "k"], costs, total)
    label = F.coalesce(
        *[F.when(F.col("scenario") == s, F.lit(name)) for s, name in C.SCENARIOS.items()]
    )
    return best.select(
        label.alias("scenario_label"),
        "scenario",
        F.col("fraction").alias("fraction_requested"),
        (size / F.lit(base)).alias("fraction_actual"),
        size.alias("sample_size"),
        "num_hash_tables",
        "k",
        "accuracy",
        *costs,
        total,
    )


def sweep_pivot(summary: DataFrame, values: list[str]) -> DataFrame:
    """Per value a block ``measure``: fractions down, scenarios across; 0 where a run is absent."""
    names = list(C.SCENARIOS)
    measures = F.array(
        *[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values]
    )
    return (
        summary.select(F.col("fraction_actual").alias("fraction"), "scenario", F.inline(measures))
        .groupBy("measure", "fraction")
        .pivot("scenario", names)
        .agg(F.first("value"))
        .fillna(0.0, subset=names)
        .orderBy("measure", "fraction")
    )
