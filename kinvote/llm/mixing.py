"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is what its target share of the mixture needs:
``epochs * total * share / size``. Each document draws a Poisson count with that mean by
inverting the distribution function at a number hashed from (seed, key): the same documents
are taken, the same number of times, in every run and on every cluster. A document is
repeated count times (none at 0) and the copies are put in a hashed global order.

Edge cases: a null source is a source of its own; a null key hashes like the word null; a
document weighs its bytes plus 1, so empty and null texts weigh 1; a source without a given
weight has ``default_weight``; weights of sources that have no documents are ignored; rows
that repeat draw the same count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinvote.llm.common import free_names, key_text, unit_hash
from kinvote.session import materialize

DRAW_MEAN = 64.0
"""Larger means are drawn as a sum of draws of this mean or less, as exp(-mean) must not vanish."""

TAIL = 40
"""Terms beyond mean + 12 standard deviations; the rest of the sum is below 2**-53, the step of u."""


def poisson_count(rate: Column, key: Column, seed: str) -> Column:
    """The smallest k whose distribution function is above the hashed number, per draw, summed."""
    draws = F.greatest(F.lit(1), F.ceil(rate / DRAW_MEAN)).cast("int")
    mean = rate / draws

    def one(draw: Column) -> Column:
        start = F.struct(
            unit_hash(F.lit(seed), draw.cast("string"), key).alias("drawn"),
            F.lit(0).alias("count"),
            F.exp(-mean).alias("term"),
            F.exp(-mean).alias("below"),
        )

        def step(state: Column, k: Column) -> Column:
            term = state["term"] * mean / k
            return F.when(state["drawn"] < state["below"], state).otherwise(
                F.struct(
                    state["drawn"].alias("drawn"),
                    (state["count"] + 1).alias("count"),
                    term.alias("term"),
                    (state["below"] + term).alias("below"),
                )
            )

        last = F.ceil(mean + 12 * F.sqrt(mean)).cast("int") + TAIL
        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["count"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), draws), one), F.lit(0), lambda x, y: x + y)


def source_rates(
    df: DataFrame,
    text: str,
    source: str,
    weights: Mapping[str, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
) -> DataFrame:
    """Per source: its size, its weight and the mean repetition rate of its documents."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1
    sizes = df.select(F.col(source).alias("_source"), size.alias("_size")).groupBy("_source").agg(
        F.sum("_size").alias("_size")
    )
    weight = F.lit(float(default_weight))
    for name, value in (weights or {}).items():
        weight = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(weight)
    every = Window.partitionBy()  # a row a source
    summed = sizes.withColumn("_weight", weight).withColumns(
        {"_total": F.sum("_size").over(every), "_weights": F.sum("_weight").over(every)}
    )
    rate = F.lit(float(epochs)) * F.col("_total") * F.col("_weight") / (F.col("_weights") * F.col("_size"))
    return summed.select("_source", "_size", "_weight", rate.alias("_rate"))


def replicate(
    df: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Mapping[str, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: str = "mix",
    order: str = "_order",
    copy: str = "_copy",
) -> DataFrame:
    """All columns of the documents, once for each drawn copy, with the copy's number and hash.

    ``df`` may have columns of any other names than ``order`` and ``copy``, else it raises.
    Sorting by (order, key, copy) is the global order; nothing is sorted here. The rates (a row
    a source) are written first, so Spark knows their size when it plans the join: it then
    broadcasts them and no text moves, or, with very many sources, splits the hot ones.
    """
    if [order, copy] != free_names(df, order, copy):
        raise ValueError(f"the table has a column {order} or {copy}: give other names for order and copy")
    of, rate, drawn = free_names(df, "_source", "_rate", "_count")
    rates = source_rates(df, text, source, weights, default_weight, epochs)
    rates = materialize(rates.select(F.col("_source").alias(of), F.col("_rate").alias(rate)), "source-rates")
    joined = df.join(rates, F.col(source).eqNullSafe(F.col(of)))
    count = poisson_count(F.col(rate), key_text(F.col(key)), seed)
    kept = joined.withColumn(drawn, count).filter(F.col(drawn) > 0)
    out = kept.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(drawn) - 1)))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(copy).cast("string"), key_text(F.col(key))))
    return out.withColumn(order, place).select(*df.columns, copy, order)


def shuffled(df: DataFrame, key: str, order: str = "_order", copy: str = "_copy") -> DataFrame:
    """The copies in their global order: ranges of the hash, sorted inside each partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(partitions, order, copy).sortWithinPartitions(order, copy, key)


def mixture(df: DataFrame, key: str, text: str, source: str, **options) -> DataFrame:
    """The mixture without texts: key, source, copy and position in the global order (from 0)."""
    copies = replicate(df.select(key, text, source), key, text, source, **options).drop(text)
    placed = numbered_globally(copies, key)
    return placed.select(F.col(key), F.col(source), F.col("_copy").alias("copy"), "position")


def numbered_globally(copies: DataFrame, key: str) -> DataFrame:
    """``position`` from 0 without gaps in the order of the hash.

    The first three hexadecimal digits make 4,096 ranges of about equal size whatever the
    sources are; each is numbered on its own and starts where the one before it ends.
    """
    ranged = copies.withColumn("_range", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_range").alias("_start_range"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_range").orderBy("_order", "_copy", key)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, F.col("_range") == F.col("_start_range")).withColumn(
        "position", (F.col("_start") + F.col("_rank")).cast("long")
    )
