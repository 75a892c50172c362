"""Stable samples, splits, keys and de-duplication.

Every random choice is an order by ``md5(seed:key)``: the same rows are chosen on any
partitioning and after any recomputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, TEST_FRACTION
from ..functions.hashing import hash32, seeded_hash

_BUCKET_DIGITS = 4  # 16^4 buckets of the hash order


def row_key(df: DataFrame, text_col: str = "text", name: str = "row_id") -> DataFrame:
    """A key that is a function of the text, so recomputation cannot change it.

    The first 60 bits of the text's MD5; the same on every engine.
    """
    digits = F.substring(F.md5(F.col(text_col)), 1, 15)
    return df.withColumn(name, F.conv(digits, 16, 10).cast("bigint"))


def with_position(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add ``position`` (from 1) in the stable random order of the whole table.

    Rows are ranked inside the 65,536 buckets of the hash order; a bucket begins where the
    counts of those before it end. So one pass serves every prefix of the order.
    """
    ordered = df.withColumn("__order", seeded_hash(F.col(key), seed)).withColumn(
        "__bucket", F.substring("__order", 1, _BUCKET_DIGITS)
    )
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("__bucket").agg(F.count("*").alias("__rows")).select(
        "__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__order", key))
    ranked = ordered.withColumn("__rank", inside).join(starts, "__bucket")
    return ranked.withColumn("position", F.col("__before") + F.col("__rank")).select(
        *df.columns, "position"
    )


def with_rank_cut(
    df: DataFrame, size: Column, key: str, by: list[str], seed: int = SEED
) -> DataFrame:
    """Flag (``chosen``) the first ``size`` rows of each group in the stable random order.

    ``size`` may use ``__total``, the rows of the group. Groups are classes (of a run), a
    handful, and each may be most of the table, so no group is ranked or sorted whole:

    1. counts per (group, hash bucket), at most 65,536 a group, give the bucket in which
       the cut falls;
    2. the rows of that bucket alone, 1/65,536 of the group, are ranked to find the last
       chosen one;
    3. every row is compared with that one as it is read, without a shuffle.

    The broadcast tables have one row per group.
    """
    order, bucket = F.col("__order"), F.col("__bucket")
    ordered = df.withColumn("__order", seeded_hash(F.col(key), seed)).withColumn(
        "__bucket", F.substring(order, 1, _BUCKET_DIGITS)
    )
    whole = Window.partitionBy(*by)
    running = whole.orderBy("__bucket")
    cuts = (
        ordered.groupBy(*by, "__bucket")
        .agg(F.count("*").alias("__rows"))
        .withColumn("__total", F.sum("__rows").over(whole))
        .withColumn("__upto", F.sum("__rows").over(running))
        .withColumn("__room", size - F.col("__upto") + F.col("__rows"))
        .where((F.col("__room") > 0) & (F.col("__room") <= F.col("__rows")))
        .select(*by, bucket.alias("__cut"), "__room")
    )
    rank = F.row_number().over(whole.orderBy(order, key))
    last = (
        ordered.join(F.broadcast(cuts), by)
        .where(bucket == F.col("__cut"))
        .withColumn("__rank", rank)
        .where(F.col("__rank") == F.col("__room"))
        .select(*by, F.struct(order, F.col(key).alias("k")).alias("__last"))
    )
    chosen = F.struct(order, F.col(key).alias("k")) <= F.col("__last")
    return (
        ordered.join(F.broadcast(last), by, "left")
        .withColumn("chosen", F.coalesce(chosen, F.lit(False)))
        .select(*df.columns, "chosen")
    )


def sample_balanced(
    df: DataFrame, per_class: int, key: str = "id", label: str = "label", seed: int = SEED
) -> DataFrame:
    """``per_class`` rows of every class (all, where it has fewer); 0 or less keeps all."""
    if per_class <= 0:
        return df
    size = F.least(F.lit(per_class).cast("bigint"), F.col("__total"))
    return with_rank_cut(df, size, key, [label], seed).where("chosen").drop("chosen")


def sample_fractions(df: DataFrame, per_class: int, label: str = "label") -> DataFrame:
    """Sampling fraction per class: ``min(1, per_class / class rows)``."""
    return df.groupBy(label).agg(F.count("*").alias("n_rows")).withColumn(
        "fraction", F.least(F.lit(1.0), F.lit(per_class) / F.col("n_rows"))
    )


def sample_uniform(df: DataFrame, n: int, key: str = "id", seed: int = SEED) -> DataFrame:
    """``n`` rows of the table; 0 or a size not below the table's keeps all."""
    if n <= 0:
        return df
    one = df.withColumn("__one", F.lit(1))
    size = F.least(F.lit(n).cast("bigint"), F.col("__total"))
    chosen = with_rank_cut(one, size, key, ["__one"], seed).where("chosen")
    return chosen.drop("chosen", "__one")


def split_random(
    df: DataFrame, key: str = "id", fraction: float = TEST_FRACTION, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: about ``fraction`` of the rows, decided row by row (no shuffle)."""
    salted = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    cut = int(round(fraction * 10000))
    return df.withColumn("is_test", hash32(salted) % 10000 < cut)


def split_stratified(
    df: DataFrame,
    key: str = "id",
    fraction: float = TEST_FRACTION,
    seed: int = SEED,
    by: tuple[str, ...] = ("label",),
) -> DataFrame:
    """Add ``is_test``: ``round(fraction * rows)`` rows of every class."""
    size = F.floor(F.col("__total") * F.lit(fraction) + F.lit(0.5)).cast("bigint")
    return with_rank_cut(df, size, key, list(by), seed).withColumnRenamed("chosen", "is_test")


def dedupe(df: DataFrame, text_col: str, key: str = "id") -> DataFrame:
    """One row per distinct text: the one with the smallest key.

    An aggregate, so a text that a third of the rows share reaches the shuffle once per
    map task, and no group is sorted or held.
    """
    row = {c: F.min_by(c, key).alias(c) for c in df.columns if c not in (text_col, key)}
    kept = df.groupBy(text_col).agg(F.min(key).alias(key), *row.values())
    return kept.select(*df.columns)


def first_per_class(df: DataFrame, n: int, key: str = "id", label: str = "label") -> DataFrame:
    """The first ``max(1, n)`` rows of every class in key order (cut before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return df.withColumn("rank", rank).where(F.col("rank") <= max(1, n))


def row_cap(df: DataFrame, max_rows: int, key: str = "id") -> DataFrame:
    """The first ``max_rows`` rows in key order; 0 or less keeps all."""
    return df.orderBy(key).limit(max_rows) if max_rows > 0 else df


def sample_sizes(df: DataFrame, fractions: list[float], base: int) -> DataFrame:
    """Sample size per fraction: clamped to [0.05, 1], unique, ``max(1, round(base * f))``."""
    kept = clamp_fractions(fractions)
    rows = [(f, max(1, int(round(base * f))), max(1, int(round(base * f))) / base) for f in kept]
    return df.sparkSession.createDataFrame(
        rows, "fraction_requested double, sample_size bigint, fraction_actual double"
    )


def clamp_fractions(fractions: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.05, f)) for f in fractions})
