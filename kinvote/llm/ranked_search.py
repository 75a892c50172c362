"""Ranked lexical search: best-first document intervals over range-maximum tables.

Score of a document for an item: the sum, over the item's distinct terms, of
``w * ((10^9 * tf) div (1000 * tf + 20 * m))`` with the term's weight w and the document's length
norm m (``ranked`` has both). The part without w is the posting's impact.

Index: documents lie in segments of some MB of text and at most ``SEGMENT_DOCS`` documents, in the
order of their ids. A term's posting list in a segment is its documents' places and frequencies.
Only numbers of whole tables (documents with terms, terms, documents of a term) cross segments.

Search in a segment: every posting list has a sparse table, which for each start and power of two
holds the place of the largest impact, so two look-ups give the largest one of any stretch of
documents (RMQ). The sum of an item's w times those is a bound for every document of the stretch.
The item's open intervals are kept by their bounds. The best ones are taken; the document with the
largest single impact of each is scored, and splits it in two. An interval is dropped when its
bound is below the item's k-th best score, or equal to it and its ids are larger. The k best go from
segment to segment of a task, so later segments begin with a high bar. At most k rows an item
leave a task.

Items are dealt to blocks of about ``BLOCK_ITEMS``; (block, segment) is the unit of work, so
the benchmark may be of any size, and no task holds more than a segment's lists and k rows an
item of a block.

Edge cases: null and empty texts have no terms: such documents are in no result and such items
have no rows; rows of one item id are one item with the terms of all, a null id included; rows of
documents that repeat are ranked each, null ids last among equal scores; terms with weight 0 count
nothing; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvote.llm.common import ALNUM_WORDS, slices, words_of
from kinvote.session import materialize

SEGMENT_BYTES = 8 << 20
SEGMENT_DOCS = 8192
BLOCK_ITEMS = 256
AT_ONCE = 128
"""Intervals that are split in one round."""
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written: (segment, term, df, total, docs, tfs, ids).

    A row with a term is its posting list in the segment: ``df`` documents by place, ``total`` uses.
    The row without a term lists the segment's documents: their ids, their numbers of terms as
    ``tfs``, how many have any as ``df``, and all their terms as ``total``.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.spark_partition_id().alias("_part"))
    kind = slim.schema["_key"].dataType.simpleString()
    names = ["segment", "term", "df", "total", "docs", "tfs", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(gathered(batches), "_text", SEGMENT_BYTES, SEGMENT_DOCS)):
            batch = batch.take(pc.sort_indices(batch.column("_key"), null_placement="at_end"))
            words = words_of(batch.column("_text"), ALNUM_WORDS)
            sizes, rows = np.diff(words.starts), batch.num_rows
            segment = batch.column("_part")[0].as_py() * (1 << 32) + number
            found, tfs = np.unique(words.codes.astype(np.int64) * rows + words.owner(), return_counts=True)
            bounds = np.searchsorted(found, np.arange(len(words.vocabulary) + 1) * rows)
            lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            ids = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), batch.column("_key"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment], pa.int64()),
                    pa.array([None], pa.string()),
                    pa.array([(sizes > 0).sum()], pa.int64()),
                    pa.array([sizes.sum()], pa.int64()),
                    pa.array([None], pa.list_(pa.int32())),
                    lists(sizes, [0, rows]),
                    ids,
                ],
                names,
            )
            if len(found):
                n = len(words.vocabulary)
                sums = np.concatenate([[0], np.cumsum(tfs)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, segment), pa.int64()),
                        words.vocabulary.cast(pa.string()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(np.diff(sums[bounds]), pa.int64()),
                        lists(found % rows, bounds),
                        lists(tfs, bounds),
                        pa.nulls(n, ids.type),
                    ],
                    names,
                )

    made = slim.mapInArrow(
        run, f"segment bigint, term string, df bigint, total bigint, docs array<int>, tfs array<int>, ids array<{kind}>"
    )
    return materialize(made, "search-index")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined until they hold a segment's text."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= SEGMENT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term)."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), F.explode(words).alias("term")).distinct()


class Segment:
    """The posting lists of a segment that a block of items needs, one after another."""

    def __init__(self, sizes: np.ndarray, ids: list, docs: np.ndarray, tfs: np.ndarray, bounds: np.ndarray, totals):
        n_docs, n_terms = totals
        norm = 100 - 50 + (50 * sizes.astype(np.int64) * n_docs) // n_terms
        self.ids, self.named = ids, len(ids) - ids.count(None)
        self.docs, self.bounds, self.n = docs, bounds, len(sizes)
        tf = tfs.astype(np.int64)
        self.impact = (10**9 * tf) // (1000 * tf + 20 * norm[docs])
        # best[j][i]: place of the largest impact of the 2^j postings from i
        best = [np.arange(len(docs), dtype=np.int32)]
        longest = int(np.diff(bounds).max()) if len(bounds) > 1 else 0
        while 2 << (len(best) - 1) <= longest:
            step, last = 1 << (len(best) - 1), best[-1]
            left, right = last[:-step], last[step:]
            row = last.copy()  # stretches that would run over the end are never asked for
            row[: len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)
            best.append(row)
        self.best = np.stack(best)
        self.log = np.zeros(max(longest, 1) + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1

    def ids_below(self, key) -> int:
        """How many documents of the segment come before an id (null ids are last)."""
        return self.named if key is None else bisect_left(self.ids, key, 0, self.named)


class Item:
    """An item's lists in a segment."""

    def __init__(self, segment: Segment, lists: np.ndarray, weights: np.ndarray):
        self.segment, self.weights = segment, weights[:, None]
        # how many postings of each list come before each document, as places in all lists
        at = np.zeros((len(lists), segment.n + 1), np.int32)
        for row, i in zip(at, lists):
            row[segment.docs[segment.bounds[i] : segment.bounds[i + 1]] + 1] = 1
        np.cumsum(at, axis=1, out=at)
        self.at = at + segment.bounds[lists][:, None].astype(np.int32)

    def bound(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, document with the largest single impact) of the documents from low to high."""
        s = self.segment
        first, end = self.at[:, low], self.at[:, high]
        level = s.log[end - first]
        some = end > first
        left = s.best[level, np.where(some, first, 0)]
        right = s.best[level, np.where(some, end - (1 << level), 0)]
        where = np.where(s.impact[left] >= s.impact[right], left, right)
        most = np.where(some, self.weights * s.impact[where], 0)
        top = most.argmax(axis=0)
        return most.sum(axis=0), s.docs[where[top, np.arange(len(low))]]

    def score(self, docs: np.ndarray) -> np.ndarray:
        place = self.at[:, docs]
        held = self.at[:, docs + 1] > place
        return np.where(held, self.weights * self.segment.impact[np.where(held, place, 0)], 0).sum(axis=0)


def search(item: Item, best: list[tuple], k: int) -> list[tuple]:
    """The k first (-score, id is null, id) of ``best`` and the segment's documents."""
    segment = item.segment
    low, high = np.zeros(1, np.int64), np.full(1, segment.n)
    bound, split = item.bound(low, high)
    while True:
        bar, before = 0, 0  # at the bar only documents before this one count
        if len(best) == k:
            bar, before = -best[-1][0], segment.ids_below(best[-1][2])
        open_ = (bound > bar) | ((bound == bar) & (low < before))
        low, high, bound, split = low[open_], high[open_], bound[open_], split[open_]
        if not len(low):
            return best
        if len(low) > AT_ONCE:
            order = np.argpartition(-bound, AT_ONCE)
            low, high, bound, split = low[order], high[order], bound[order], split[order]
        a, b, docs = low[:AT_ONCE], high[:AT_ONCE], split[:AT_ONCE].astype(np.int64)
        scores = item.score(docs)
        good = np.flatnonzero((scores > bar) | ((scores == bar) & (docs < before)))
        if len(good):
            new = [(-int(scores[i]), segment.ids[docs[i]] is None, segment.ids[docs[i]]) for i in good]
            best = sorted(best + new, key=lambda x: x[:2] if x[1] else x)[:k]
        starts, stops = np.concatenate([a, docs + 1]), np.concatenate([docs, b])
        some = stops > starts
        starts, stops = starts[some], stops[some]
        more, at = item.bound(starts, stops)
        low, high = np.concatenate([low[AT_ONCE:], starts]), np.concatenate([high[AT_ONCE:], stops])
        bound, split = np.concatenate([bound[AT_ONCE:], more]), np.concatenate([split[AT_ONCE:], at])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (block, segment) of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        pair = [np.asarray(batch.column(c)) for c in ("block", "segment")]
        cuts = np.flatnonzero((np.diff(pair[0]) != 0) | (np.diff(pair[1]) != 0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and any(held[-1].column(c)[-1] != batch.column(c)[start] for c in ("block", "segment")):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _found(block: int, best: dict[int, list[tuple]], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    rows = [(n, x[2], -x[0]) for n, found in best.items() for x in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * len(rows), pa.int32()),
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[1] for r in rows], kind),
            pa.array([r[2] for r in rows], pa.int64()),
        ],
        names,
    )


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """item_key, rank, key, score: each item's k best documents, equal scores by ascending id.

    With N documents that have terms and L terms in all: w = floor(1000 ln((2N + 2) / (2 df + 1)))
    and m = 50 + (50 n N) div L for a document of n terms. ``index``: one built before of ``docs``.
    """
    index = build_index(docs, key, text) if index is None else index
    kind = index.schema["ids"].dataType.elementType.simpleString()
    listing = index.filter("term IS NULL")
    whole = listing.agg(F.sum("df").alias("docs"), F.sum("total").alias("terms")).first()
    totals = (whole["docs"] or 0, max(whole["terms"] or 0, 1))

    wanted = materialize(item_terms(items, item_key, item_text), "search-terms")
    asked = wanted.select("term").distinct()
    counted = index.filter("term IS NOT NULL").select("term", "df").join(asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * totals[0] + 2) / (2 * F.col("df") + 1)))
    weights = counted.select("term", weight.alias("w")).filter("w > 0")

    blocks = max(1, -(-wanted.select("item").distinct().count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    place = F.row_number().over(Window.partitionBy("block").orderBy("item"))
    named = wanted.select("item").distinct().withColumn("block", block).withColumn("number", place)
    named = materialize(named, "search-items")
    dealt = wanted.join(named.withColumnRenamed("item", "_item"), F.expr("item <=> _item")).select("block", "number", "term")
    lists = dealt.groupBy("block", "term").agg(F.collect_list("number").alias("numbers")).join(weights, "term")
    lists = materialize(lists, "search-lists")

    columns = ["block", "segment", "w", "numbers", "docs", "tfs", "ids"]
    postings = index.filter("term IS NOT NULL").drop("ids").join(lists, "term").withColumn(
        "ids", F.lit(None).cast(index.schema["ids"].dataType)
    )
    every = listing.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn(
        "w", F.lit(None).cast("bigint")
    ).withColumn("numbers", F.lit(None).cast("array<int>"))
    work = postings.select(*columns).unionByName(every.select(*columns))
    work = work.repartition("block", "segment").sortWithinPartitions("block", "segment")
    names = ["block", "number", key, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, id_type = None, {}, pa.null()
        for group in _groups(batches):
            current = group["block"][0].as_py()
            if now is not None and current != now:
                yield _found(now, best, names, id_type)
                best = {}
            now, id_type = current, group.schema.field("ids").type.value_type
            held = group.filter(pc.is_valid(group["w"])).combine_chunks()
            if not held.num_rows:
                continue
            listed = group.filter(pc.is_null(group["w"])).combine_chunks()
            flat = lambda table, c: np.asarray(table[c].combine_chunks().flatten())
            bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(held["docs"])))])
            ids = listed["ids"].combine_chunks().flatten().to_pylist()
            segment = Segment(flat(listed, "tfs"), ids, flat(held, "docs"), flat(held, "tfs"), bounds, totals)
            numbers = flat(held, "numbers")
            owner = np.repeat(np.arange(held.num_rows), np.asarray(pc.list_value_length(held["numbers"])))
            order = np.argsort(numbers, kind="stable")
            w = np.asarray(held["w"])
            for some in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
                number, its = int(numbers[some[0]]), owner[some]
                best[number] = search(Item(segment, its, w[its]), best.get(number, []), k)
        if now is not None:
            yield _found(now, best, names, id_type)

    found = work.mapInArrow(run, f"block int, number int, {key} {kind}, score bigint")
    order = Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc_nulls_last(key))
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(named, ["block", "number"]).select(F.col("item").alias(item_key), "rank", key, "score")
