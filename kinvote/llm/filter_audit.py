"""Filter interaction audit: what each of five filters removes, in every order, by packed counters.

Each document fails some of the filters A to E whatever the order, so it is known by its mask of
failures and by whether it is labelled good or toxic: 128 classes. In an order, a document is
removed by the first filter of the order that it fails. A class is mapped to one big integer: a
field of 64 bits for each counter of each of the 600 (order, step) outcomes and for each filter's
unique failures, with 1 where a document of the class counts. The sum of the documents' integers
is then every counter at once. Tasks multiply by the number of equal documents and add up, a part's
integers are added to one, and that is unpacked. A field would overflow into the next from 2^64
documents on; the number of rows is a signed 64-bit integer, so none does. ``shapley`` is added up
when unpacking, in 64-bit integers: 120 times the documents of the part must be below 2^63.

Whether another document has the same text is found without joining documents: rows are counted
by (id, SHA-256 of the text, part, mask) and then, with the labels, by (digest, part, mask, labels),
with the smallest id and its count; all but those of the smallest id of a digest fail E. Both
counts combine before their shuffle, so a text that a third of the rows have is a few rows.

Edge cases: a null text is empty and counts as a text, so of several only those of the smallest id
pass E; an empty text has no words (fails A only, and E as a copy); rows with a null id never
fail E and have no label; of rows with one id and text none is a copy of another; an id with
several labels is good, or toxic, if one of them says so; a null part is the empty one; parts
without documents have no rows and an empty table none at all; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTERS = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]
STEPS = len(ORDERS) * len(FILTERS)
FIELDS = STEPS * len(COUNTERS) + len(FILTERS)
FIELD_BYTES = 8
CLASSES = 1 << (len(FILTERS) + 2)
"""Masks, each with and without the labels good and toxic."""
GOOD, TOXIC = 1 << len(FILTERS), 1 << (len(FILTERS) + 1)


def packed(kind: int) -> int:
    """The big integer of one document of a class."""
    fields = np.zeros(FIELDS, "<u8")
    cube = fields[: STEPS * len(COUNTERS)].reshape(len(ORDERS), len(FILTERS), len(COUNTERS))
    fails = [bool(kind >> i & 1) for i in range(len(FILTERS))]
    good, toxic = bool(kind & GOOD), bool(kind & TOXIC)
    for o, order in enumerate(ORDERS):
        gone = False
        for step, name in enumerate(order):
            failed = fails[FILTERS.index(name)]
            removed = failed and not gone
            redundant = failed and gone
            gone = gone or failed
            cube[o, step] = (not gone, removed, redundant, removed and good, removed and toxic)
    if sum(fails) == 1:
        fields[STEPS * len(COUNTERS) + fails.index(True)] = 1
    return int.from_bytes(fields.tobytes(), "little")


def unpack(total: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, step, counter) and the unique failures of each filter."""
    fields = np.frombuffer(total.to_bytes(FIELDS * FIELD_BYTES, "little"), "<u8").astype(np.int64)
    cube = fields[: STEPS * len(COUNTERS)].reshape(len(ORDERS), len(FILTERS), len(COUNTERS))
    return cube, fields[STEPS * len(COUNTERS) :]


def failures(text: str) -> list[Column]:
    """The words of a text column without nulls, and the conditions of A to D on ``_words`` and it."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words")
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        words,
        n < 50,
        100 * F.size(F.array_distinct("_words")) < 65 * n,
        100 * upper > 5 * F.length(text),
        F.col(text).rlike(r"[#$%&*|]"),
    ]


def _bits(flags: list) -> Column:
    total = F.lit(0)
    for i, flag in enumerate(flags):
        total = total + F.when(flag, 1 << i).otherwise(0)
    return total


def class_counts(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(part, kind, n): documents of each class in each part."""
    slim = docs.select(
        F.col(key).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    words, *conditions = failures("_text")
    judged = slim.withColumn("_words", words).select(
        "_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"), _bits(conditions).alias("_mask")
    )
    rows = judged.groupBy("_id", "_digest", "part", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("_good"), F.max(F.col("toxic").eqNullSafe(1)).alias("_toxic")
    )
    flag = lambda name: F.coalesce(name, F.lit(False))
    marked = rows.join(marks, "_id", "left").withColumn(
        "_kind",
        F.col("_mask") + F.when(flag("_good"), GOOD).otherwise(0) + F.when(flag("_toxic"), TOXIC).otherwise(0),
    )
    # one row an id and class: the least struct has the smallest id's rows, nulls apart
    known = F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))
    texts = marked.groupBy("_digest", "part", "_kind").agg(
        F.min(known).alias("_least"),
        F.sum("_n").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("_nameless"),
    )
    texts = materialize(texts, "audit-texts")
    # classes of a text with copies of other ids or classes; the rest need no second look
    least = texts.filter("_least IS NOT NULL").groupBy("_digest").agg(
        F.min("_least._id").alias("_first"), F.count(F.lit(1)).alias("_classes")
    ).filter("_classes > 1").drop("_classes")
    joined = texts.join(least, "_digest", "left")
    first = F.coalesce("_first", F.col("_least._id"))
    passing = F.when(F.col("_least._id") == first, F.col("_least._n")).otherwise(0) + F.col("_nameless")
    split = joined.select("part", "_kind", "_all", passing.cast("bigint").alias("_passing"))
    both = F.array(
        F.struct(F.col("_kind").alias("kind"), F.col("_passing").alias("n")),
        F.struct((F.col("_kind") + (1 << FILTERS.index("E"))).alias("kind"), (F.col("_all") - F.col("_passing")).alias("n")),
    )
    counted = split.select("part", F.inline(both)).filter("n > 0")
    return counted.groupBy("part", "kind").agg(F.sum("n").alias("n"))


def packed_totals(counts: DataFrame) -> DataFrame:
    """(part, total): the sum of the documents' big integers of each part."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, int] = {}
        for batch in batches:
            sums: dict[str, int] = {}
            for part, kind, n in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "n"))):
                if kind not in table:
                    table[kind] = packed(kind)
                sums[part] = sums.get(part, 0) + n * table[kind]
                if len(sums) > 256:  # many parts: give what there is
                    yield _listed(sums)
                    sums = {}
            yield _listed(sums)

    def add(rows: pa.Table) -> pa.Table:
        total = sum(int.from_bytes(blob, "little") for blob in rows["total"].to_pylist())
        return pa.table({"part": rows["part"].slice(0, 1), "total": [total.to_bytes(FIELDS * FIELD_BYTES, "little")]})

    partial = counts.select("part", "kind", "n").mapInArrow(weigh, "part string, total binary")
    # a part's partial sums: a class is in one task, so there are CLASSES of them at most
    return partial.groupBy("part").applyInArrow(add, "part string, total binary")


def _listed(sums: dict[str, int]) -> pa.RecordBatch:
    blobs = [t.to_bytes(FIELDS * FIELD_BYTES, "little") for t in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(blobs, pa.binary())], ["part", "total"])


def unpacked(totals: DataFrame) -> DataFrame:
    """600 rows of each part: part, filter_order, step and the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = np.array([[FILTERS.index(c) for c in order] for order in ORDERS])
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("total").to_pylist()):
                cube, unique = unpack(int.from_bytes(blob, "little"))
                removed = cube[:, :, COUNTERS.index("removed")]
                shapley = np.array([removed[which == f].sum() for f in range(len(FILTERS))])
                columns = {
                    "part": pa.array([part] * STEPS, pa.string()),
                    "filter_order": pa.array([o for o in ORDERS for _ in FILTERS], pa.string()),
                    "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32()),
                    **{name: pa.array(cube[:, :, i].ravel(), pa.int64()) for i, name in enumerate(COUNTERS)},
                    "unique_fails": pa.array(unique[which].ravel(), pa.int64()),
                    "shapley": pa.array(shapley[which].ravel(), pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    numbers = ", ".join(f"{name} bigint" for name in [*COUNTERS, "unique_fails", "shapley"])
    return totals.mapInArrow(run, f"part string, filter_order string, step int, {numbers}")


def filter_audit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, good_lost, toxic_lost, unique_fails, shapley."""
    return unpacked(packed_totals(class_counts(docs, labels, key, text, part)))
