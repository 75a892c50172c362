"""Projection, label recoding and data checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def project_label_text(df: DataFrame, label_col: str, text_col: str, *keep: str) -> DataFrame:
    """``label`` and string ``text`` (plus ``keep`` columns); rows with a null in either go."""
    return df.select(
        *keep, F.col(label_col).alias("label"), F.col(text_col).cast("string").alias("text")
    ).dropna(subset=["label", "text"])


def recode(label: Column, mapping: Mapping) -> Column:
    """Dense class of a raw label; null where the vocabulary has no entry.

    Word vocabularies are matched without regard to case.
    """
    if all(isinstance(raw, str) for raw in mapping):
        label = F.lower(label)
    out = F.lit(None).cast("int")
    for raw, dense in mapping.items():
        out = F.when(label == raw, F.lit(dense)).otherwise(out)
    return out


def recode_labels(df: DataFrame, mapping: Mapping, col: str = "label") -> DataFrame:
    """Recode ``col`` and drop the rows whose label is not in the vocabulary."""
    return df.withColumn(col, recode(F.col(col), mapping)).dropna(subset=[col])


def recode_keep(label: Column, mapping: Mapping) -> Column:
    """Recode the labels of ``mapping``; every other label stays as it is."""
    return F.coalesce(recode(label, mapping), label).cast("int")


def keep_nonempty(df: DataFrame, array_col: str) -> DataFrame:
    return df.where(F.size(array_col) > 0)


def class_check(df: DataFrame, col: str = "label") -> DataFrame:
    """One row: distinct classes (nulls ignored) and whether there are at least two."""
    return df.agg(F.count_distinct(col).alias("n_classes")).withColumn(
        "has_two_classes", F.col("n_classes") >= 2
    )


def require_two_classes(df: DataFrame, col: str = "label") -> DataFrame:
    """Return ``df``; raise where it holds a single class."""
    if not class_check(df, col).first()["has_two_classes"]:
        raise ValueError(f"column {col!r} holds fewer than two classes; load more rows")
    return df


def require_columns(
    found: DataFrame | list[str], expected: StructType | list[str], dataset: str
) -> DataFrame | list[str]:
    """Return ``found`` (a table, or a file's column names); raise where a column is missing."""
    names = expected.names if isinstance(expected, StructType) else expected
    present = found.columns if isinstance(found, DataFrame) else found
    missing = [name for name in names if name not in present]
    if missing:
        raise ValueError(f"{dataset}: missing column(s) {missing}; present: {present}")
    return found


def count_per_class(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n_rows"))


def majority_label(df: DataFrame, col: str = "label") -> DataFrame:
    """The most frequent class; the smaller class wins a tie."""
    return (
        count_per_class(df, col)
        .orderBy(F.desc("n_rows"), F.asc(col))
        .limit(1)
        .select(F.col(col).alias("majority_label"), "n_rows")
    )


def append_by_name(df: DataFrame, extra: DataFrame | None) -> DataFrame:
    """Append a second file by column name, without de-duplication."""
    return df if extra is None else df.unionByName(extra)


def retained(df: DataFrame, kept: Mapping[str, Column]) -> DataFrame:
    """Per name: rows, rows for which its condition holds, and their share in percent.

    One aggregate over one pass for all conditions; the share of no rows is 0.
    """
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count(F.when(test, F.lit(1))).alias(f"n_{name}") for name, test in kept.items()],
    )
    parts = F.array(
        *[F.struct(F.lit(name).alias("scenario"), F.col(f"n_{name}").alias("n_kept")) for name in kept]
    )
    listed = counts.select("n_rows", F.explode(parts).alias("part")).select("n_rows", "part.*")
    share = F.when(F.col("n_rows") > 0, F.col("n_kept") * 100 / F.col("n_rows"))
    return listed.withColumn("retained_pct", F.coalesce(share, F.lit(0.0)))
