"""Approximate nearest neighbours: a forest of sorted MinHash signatures, ranked by exact distance.

A signature is cut into trees of ``DEPTH`` values. In a tree all rows lie in the order of their
values, so rows that share a longer prefix lie closer together, and a test row's candidates are the
``AROUND`` training rows around its place: half before it, half behind. The candidates of all
trees are compared by their token sets, and the ``k`` nearest stay. Two rows of Jaccard similarity s
share the first value of a tree with chance s, so of some tree with ``1 - (1 - s)^trees``.

Comparisons are linear in the rows: a row is one entry a tree, a test row has ``AROUND`` candidates a
tree, and a group of equal or similar rows, however large, offers no more. Places are counted over
range partitions of the order, so no tree is sorted by one task. A row's places, one a tree, then go
with it into its block (``similarity_join.meet``): a pair of blocks finds its candidates by place and
scores them on the spot, so candidates are neither shuffled nor written. Each test block reads each
training block, which is quadratic in the blocks (4,096 times 8,192 rows), not in disk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED
from ..functions.hashing import minhash_signature
from ..session import materialize
from .similarity_join import Found, Index, _Side, block_counts, meet, near_candidates, rank_neighbors, ranges

DEPTH = 4
"""Signature values of a tree: two longs, which sort like them."""
AROUND = 50
"""Training rows that a tree offers to a test row (an even number)."""
SLICE_ROWS = 1024
"""Test rows whose candidates a task holds at once."""


def with_signature(rows: DataFrame, num_hashes: int, seed: int = SEED) -> DataFrame:
    return rows.withColumn("signature", minhash_signature(F.col("features"), num_hashes, seed))


def tree_entries(rows: DataFrame, num_hashes: int, seed: int = SEED, runs: tuple[str, ...] = ()) -> DataFrame:
    """``runs, id, is_test, tree, high, low``: the values of each tree as two sortable numbers.

    Signatures are written first, as dealing entries to ranges reads them twice.
    """
    signed = with_signature(rows.where(F.size("features") > 0), num_hashes, seed)
    signed = materialize(signed.select(*runs, "id", "is_test", "signature"), "forest-signatures")
    value = lambda t, i: F.element_at("signature", t * DEPTH + i + 1).cast("bigint")
    two = lambda t, i: F.shiftleft(value(t, i), 32).bitwiseOR(value(t, i + 1))
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(num_hashes // DEPTH - 1)),
        lambda t: F.struct(two(t, 0).alias("high"), two(t, 2).alias("low")),
    )
    exploded = signed.select(*runs, "id", "is_test", F.posexplode(trees).alias("tree", "at"))
    return exploded.select(*runs, "id", "is_test", "tree", "at.high", "at.low")


def placed(entries: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """``runs, tree, id, is_test, at``: how many training rows come before each entry.

    Entries are dealt to ranges of (run, tree, values, id). Each range counts on its own as it is
    written, and begins where those before it end (a row a range), so ``at`` runs on over runs and
    trees; it is meant for comparing places within one.
    """
    order = [*runs, "tree", "high", "low", "id"]
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = ranged.select(*runs, "tree", "id", "is_test", F.spark_partition_id().alias("part"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            train = ~np.asarray(batch.column("is_test").to_numpy(zero_copy_only=False), dtype=bool)
            ends = before + np.cumsum(train)
            yield batch.append_column("place", pa.array(ends - train, pa.int64()))
            before = int(ends[-1]) if len(ends) else before

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    counted = materialize(slim.mapInArrow(count, f"{kinds}, place bigint"), "forest-places")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy("part").agg(F.sum((~F.col("is_test")).cast("bigint")).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    at = (F.col("place") + F.col("start")).alias("at")
    return counted.join(F.broadcast(starts), "part").select(*runs, "tree", "id", "is_test", at)


def with_places(rows: DataFrame, places: DataFrame, trees: int, runs: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their place in each tree, as the array ``places``; rows without features go.

    Rows that share an id (of a run) share its first place of a tree.
    """
    listed = places.groupBy(*runs, "id").agg(F.array_sort(F.collect_list(F.struct("tree", "at"))).alias("listed"))
    once = F.filter("listed", lambda x, i: (i == 0) | (F.get("listed", i - 1)["tree"] != x["tree"]))
    kept = F.when(F.size("listed") == trees, F.col("listed")).otherwise(once)
    listed = listed.select(*runs, "id", F.transform(kept, lambda x: x["at"]).alias("places"))
    return rows.join(listed.hint("merge"), [*runs, "id"])  # arrays: file sizes say too little


def _matcher(around: int):
    half = around // 2

    def match(tests: _Side, trains: _Side, bound: np.ndarray) -> Iterator[Found]:
        """Pairs that lie close in some tree, with the first of these, and have a common token."""
        own, other = tests.wide("places") - half, trains.wide("places")
        orders, index = [np.argsort(other[:, tree]) for tree in range(own.shape[1])], Index(trains)
        for start in range(0, len(own), SLICE_ROWS):
            some = own[start : start + SLICE_ROWS]
            i, j, first = [], [], []
            for tree, order in enumerate(orders):
                at = other[order, tree]
                low, high = np.searchsorted(at, some[:, tree]), np.searchsorted(at, some[:, tree] + around)
                i.append(np.repeat(np.arange(start, start + len(some)), high - low))
                j.append(order[ranges(low, high - low)])
                first.append(np.full(len(j[-1]), tree, np.int32))
            i, j, first = np.concatenate(i), np.concatenate(j), np.concatenate(first)
            _, once = np.unique(i * len(other) + j, return_index=True)  # trees rise: the first of each pair
            yield near_candidates(tests, trains, i[once], j[once], first[once], np.inf, bound, index)

    return match


def forest_topk(
    rows: DataFrame,
    k: int,
    table_counts: Sequence[int],
    seed: int = SEED,
    runs: tuple[str, ...] = (),
    around: int = AROUND,
) -> DataFrame:
    """The ``k`` nearest candidates of each test row, for each number of hashes.

    Gives ``num_hash_tables, runs..., test_id, test_label, train_id, train_label, distance, overlap,
    union_size, rank``. ``rows`` is a written table ``id, label, features, is_test``; ``runs`` are
    extra key columns, and rows meet only within a run. One signature of the largest count serves
    all: n hashes are its first ``n // DEPTH`` trees. Pairs without a common token are left out.
    """
    counts = sorted(set(table_counts))
    trees = counts[-1] // DEPTH
    places = placed(tree_entries(rows, counts[-1], seed, runs), runs)
    limits = [n // DEPTH for n in counts]
    known = with_places(rows, places, trees, runs)
    near = meet(known, block_counts(rows, runs), _matcher(around), k, [t - 1 for t in limits], ["places"], runs)
    near = near.withColumnRenamed("first", "first_tree")
    listed = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("t")) for n, t in zip(counts, limits)])
    fits = F.filter(listed, lambda c: F.col("first_tree") < c["t"])
    each = near.withColumn("_count", F.explode(fits)).withColumn("num_hash_tables", F.col("_count.n"))
    ranked = rank_neighbors(each, k, ("num_hash_tables", *runs, "test_id"))
    pair = ["test_id", "test_label", "train_id", "train_label", "distance", "overlap", "union_size", "rank"]
    return ranked.select("num_hash_tables", *runs, *pair)
