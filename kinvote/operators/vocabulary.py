"""Term counts and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HFW_TOP_N, PATTERN_COLUMN_VOCAB, SEQUENCE_LENGTH, SEQUENCE_VOCAB
from ..functions.tokens import sequence_grams
from ..session import materialize

MOST_TERMS = 1 << 20
"""Terms that may reach the driver as a list; larger vocabularies take ``full_index``."""


def _bounded(n: int) -> int:
    if n > MOST_TERMS:
        raise ValueError(f"{n} terms are too many for the driver; use full_index")
    return n


def term_counts(df: DataFrame, terms: Column) -> DataFrame:
    """Uses per term; counts combine before the shuffle.

    To explode a column as it is adds a filter on its size, which would work the column out twice.
    """
    listed = F.coalesce(terms, F.array())
    return df.select(F.explode(listed).alias("term")).groupBy("term").agg(F.count("*").alias("n_uses"))


def top_terms(df: DataFrame, terms: Column, n: int) -> DataFrame:
    """The ``n`` most frequent terms; ties by term."""
    return term_counts(df, terms).orderBy(F.desc("n_uses"), F.asc("term")).limit(n)


SUMMARY_TERMS = 1 << 16
"""Terms that a task's summary keeps; a task with no more different terms counts exactly."""


def summaries(df: DataFrame, terms: Column, capacity: int = SUMMARY_TERMS) -> DataFrame:
    """``term, n, missed``: the Misra-Gries summary of each task, at most ``capacity`` terms.

    A term occurs at least ``n`` and at most ``n + missed`` times in its task, one that the summary
    lacks at most ``missed`` times. The row without a term has the task's ``missed``: when a summary
    is too long, what its next term would have is taken from all, and those left without go.
    """

    def merged(parts: list[pa.Table], missed: int) -> tuple[pa.Table, int]:
        held = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
        held = pa.table({"term": held["term"], "n": held["n_sum"]})
        if len(held) > capacity:
            counts = np.asarray(held["n"])
            cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            left = counts > cut
            held = pa.table({"term": held["term"].filter(pa.array(left)), "n": pa.array(counts[left] - cut)})
            missed += cut
        return held, missed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = missed = 0
        for batch in batches:
            counted = pc.value_counts(batch.column("term"))
            parts.append(pa.table({"term": counted.field("values"), "n": counted.field("counts")}))
            rows += len(counted)
            if rows > 4 * capacity:  # a merge looks at the whole summary: not at each batch
                held, missed = merged(parts, missed)
                parts, rows = [held], len(held)
        held, missed = merged(parts, missed) if parts else (None, 0)
        ends = pa.table({"term": pa.nulls(1, pa.string()), "n": pa.array([0], pa.int64())})
        out = ends if held is None else pa.concat_tables([held.cast(ends.schema), ends])
        yield from out.append_column("missed", pa.array(np.full(len(out), missed), pa.int64())).to_batches()

    return df.select(F.explode(terms).alias("term")).where("term IS NOT NULL").mapInArrow(run, "term string, n bigint, missed bigint")


def heavy_terms(df: DataFrame, terms: Column, n: int, capacity: int = SUMMARY_TERMS) -> DataFrame:
    """``top_terms`` in two passes, without a shuffle of all different terms.

    The tasks' summaries give each term a least and a most count; only terms that can be among
    the first ``n`` are then counted exactly. A term in no summary occurs at most ``missed`` times
    in all. If that is not below the n-th least count, the summaries are made longer; where terms are
    so alike in number that they would pass ``MOST_TERMS``, all different terms are counted. ``df``
    should be a written table, since it is read twice or more.
    """
    exact = df.select(F.filter(terms, lambda t: t.isNotNull()).alias("_terms"))
    while True:
        found = materialize(summaries(df, terms, capacity), "term-summaries")
        missed = found.where("term IS NULL").agg(F.sum("missed")).first()[0] or 0
        least = found.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("least"))
        top = least.orderBy(F.desc("least")).limit(n).agg(F.min("least").alias("bar"), F.count(F.lit(1)).alias("rows")).first()
        if missed == 0 or (top["rows"] == n and top["bar"] > missed):
            break
        capacity *= max(4, 2 * missed // max(top["bar"] or 0, 1))
        if capacity > MOST_TERMS:
            return top_terms(exact, F.col("_terms"), n)
    bar = (top["bar"] or 0) if top["rows"] == n else 0
    likely = least.where(F.col("least") + missed >= bar).select("term")
    if missed == 0:  # every task has counted exactly
        return least.withColumnRenamed("least", "n_uses").orderBy(F.desc("n_uses"), F.asc("term")).limit(n)
    likely = materialize(likely, "likely-terms")
    if likely.count() <= MOST_TERMS:  # uses are told apart where they are read, and counts combine there
        used = df.select(F.explode(terms).alias("term")).join(F.broadcast(likely), "term", "left_semi")
        counted = used.groupBy("term").agg(F.count("*").alias("n_uses"))
    else:
        counted = term_counts(exact, F.col("_terms")).join(likely, "term", "left_semi")
    return counted.orderBy(F.desc("n_uses"), F.asc("term")).limit(n)


def frequent_words(df: DataFrame, tokens_col: str, n: int = HFW_TOP_N) -> list[str]:
    """The ``n`` most frequent words, most frequent first. ``n`` bounds what reaches the driver."""
    rows = top_terms(df, F.col(tokens_col), _bounded(n)).collect()
    return [r["term"] for r in sorted(rows, key=lambda r: (-r["n_uses"], r["term"].encode()))]


def sequence_vocabulary(
    df: DataFrame, tokens_col: str, length: int = SEQUENCE_LENGTH, n: int = SEQUENCE_VOCAB
) -> list[str]:
    """The ``n`` most frequent token sequences of one length (bounded by ``n``).

    ``df`` should be a written table, since it is read twice or more.
    """
    grams = sequence_grams(F.col(tokens_col), max(2, length))
    return [r["term"] for r in heavy_terms(df, grams, _bounded(max(1, n))).collect()]


def run_vocabularies(
    df: DataFrame, runs: Sequence[str], terms: Column, n: int, name: str = "vocabulary"
) -> DataFrame:
    """The ``n`` most frequent terms of each run as one list: ``runs..., vocabulary``."""
    counts = df.select(*runs, F.explode(terms).alias("term")).groupBy(*runs, "term").agg(
        F.count("*").alias("n_uses")
    )
    order = Window.partitionBy(*runs).orderBy(F.desc("n_uses"), F.asc("term"))
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return top.groupBy(*runs).agg(F.collect_list("term").alias(name))


def with_presence(
    df: DataFrame, terms_col: str, vocabulary: Sequence[str], name: str = "indices"
) -> DataFrame:
    """Add the sorted distinct positions of a row's terms in ``vocabulary``.

    Spark's ``CountVectorizerModel`` looks the terms up row by row: no shuffle and no join.
    """
    if not vocabulary:
        return df.withColumn(name, F.expr("cast(array() as array<int>)"))
    vector = f"__{name}_vector"
    model = CountVectorizerModel.from_vocabulary(
        list(vocabulary), inputCol=terms_col, outputCol=vector, binary=True
    )
    return model.transform(df).withColumn(name, F.unwrap_udt(vector)["indices"]).drop(vector)


def term_list(df: DataFrame, terms_col: str, size: int = PATTERN_COLUMN_VOCAB) -> list[str]:
    """Vocabulary of the ``size`` terms with most uses, in order (ties by term)."""
    return frequent_words(df, terms_col, size)


def full_index(df: DataFrame, terms: Column) -> DataFrame:
    """``term, index`` of every term, ordered by uses (ties by term), however many there are.

    Terms are dealt to ranges of the order and sorted and numbered inside a range as they are
    written; a range begins where the counts of those before it end (a row a range). The ranges
    are a written table, since a second run of the range sampling could cut elsewhere.
    """
    order = [F.desc("n_uses"), F.asc("term")]
    ranged = term_counts(df, terms).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition, and the row's number in it
    ranged = materialize(ranged.select("term", place.alias("place")), "term_ranges")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    return ranged.withColumn("part", part).join(F.broadcast(starts), "part").select(
        "term", (F.col("start") + inside).cast("bigint").alias("index")
    )


def full_presence(
    df: DataFrame, key: str, terms: Column, index: DataFrame, name: str = "indices"
) -> DataFrame:
    """``key`` and the sorted distinct indices of its terms, for a vocabulary of any size.

    Joined on the term, so neither side needs to fit anywhere.
    """
    exploded = df.select(key, F.explode(F.array_distinct(terms)).alias("term"))
    # a list costs less than a set; only rows that share a key can have an index twice
    listed = F.sort_array(F.array_distinct(F.collect_list("index")))
    return exploded.join(index, "term").groupBy(key).agg(listed.alias(name))


def assemble(blocks: list[tuple[Column, int]]) -> Column:
    """Concatenate index arrays; each block's indices move up by the widths before it."""

    def moved(indices: Column, offset: int) -> Column:
        return F.transform(indices, lambda i: i + F.lit(offset))

    widths = [width for _, width in blocks]
    return F.concat(*[moved(ix, sum(widths[:n])) for n, (ix, _) in enumerate(blocks)])
