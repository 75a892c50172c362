"""Benchmark decontamination with a positional inverted index of the training texts.

``build_index`` writes the postings of all training tokens: a row for each (segment, term) with
the term's positions in that segment. A segment is some documents that one task read together
(a few MB of text, or one longer text); a row without a term lists them. Postings of a term
that every document has are thus spread over all segments, none larger than a segment.

``phrase_matches`` and ``proximity_matches`` answer queries from the index. Only the rows of
terms that queries hold are read on (a semi join). A query goes to the segments that hold its
globally rarest term (a join of the query with that term's rows), and meets the postings there
in a co-group of one segment. The positions of its rarest term of the segment, minus the
term's offset in the query, are the candidate starts; each next rarer term's positions, minus
its offset, are intersected with them. Nothing depends on the queries being few: they are
never broadcast by hand.

Words: A-Z lower-cased, then runs of letters, digits and non-ASCII characters. A window is
``n`` consecutive words of a benchmark item; an item of fewer words is one window.

Edge cases: null and empty texts have no words (documents: no hits; items: no windows); a null
item id stands as the word null; ids that repeat are one item with all their texts; documents
get a row each, equal or not, and null ids stay null; windows that several items share count
for each of them; without items no document is hit; an empty table gives an empty result;
further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import ALNUM_WORDS, covered, slices, window_starts, words_of
from kinvote.session import materialize

SEGMENT_BYTES = 4 << 20
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def pack(positions: np.ndarray) -> bytes:
    """Rising positions as steps of 1, 2 or 4 bytes, whichever holds the largest."""
    steps = np.diff(positions, prepend=0)
    width = 1 if steps.max() < 1 << 8 else 2 if steps.max() < 1 << 16 else 4
    return steps.astype(_WIDTHS[width]).tobytes()


def unpack(blob: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, _WIDTHS[len(blob) // count]), dtype=np.int64)


def _packed(positions: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """``pack`` for many runs of positions at once."""
    steps = positions.copy()
    steps[1:] -= positions[:-1]
    steps[bounds[:-1]] = positions[bounds[:-1]]
    largest = np.maximum.reduceat(steps, bounds[:-1])
    width = np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))
    counts = np.diff(bounds)
    ends = np.concatenate([[0], np.cumsum(width * counts)])
    data = np.zeros(ends[-1], np.uint8)
    place = np.arange(len(steps)) - np.repeat(bounds[:-1], counts)
    wide = np.repeat(width, counts)
    to = np.repeat(ends[:-1], counts) + place * wide
    for byte in range(4):  # little-endian
        some = wide > byte
        data[to[some] + byte] = (steps[some] >> (8 * byte)) & 255
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]
    )


def build_index(docs: DataFrame, key: str, text: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index, written: (segment, term, n, postings, ids, sizes).

    Rows with a term have its count and packed positions; positions count the words of the
    segment's documents one after another. The row without a term has the documents' ids and
    numbers of words. A segment's number is a hash of its documents and place in the input,
    so that a task that runs again gives the same.
    """
    slim = docs.select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.spark_partition_id().alias("_part")
    )
    kind = slim.schema["_key"].dataType.simpleString()
    ids_type = f"array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches, "_text", segment_bytes)):
            words = words_of(batch.column("_text"), ALNUM_WORDS)
            part = batch.column("_part")[0].as_py()
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("_key"))
            sizes = pa.array([np.diff(words.starts)], pa.list_(pa.int64()))
            segment = part * (1 << 32) + number
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([segment], pa.int64()),
                    pa.array([None], pa.string()),
                    pa.array([None], pa.int64()),
                    pa.array([None], pa.binary()),
                    ids,
                    sizes,
                ],
                ["segment", "term", "n", "postings", "ids", "sizes"],
            )
            if not len(words.codes):
                continue
            order = np.argsort(words.codes, kind="stable")
            bounds = np.searchsorted(words.codes[order], np.arange(len(words.vocabulary) + 1))
            n = len(words.vocabulary)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, segment), pa.int64()),
                    words.vocabulary.cast(pa.string()),
                    pa.array(np.diff(bounds), pa.int64()),
                    _packed(order.astype(np.int64), bounds),
                    pa.nulls(n, ids.type),
                    pa.nulls(n, pa.list_(pa.int64())),
                ],
                ["segment", "term", "n", "postings", "ids", "sizes"],
            )

    made = slim.mapInArrow(
        run, f"segment bigint, term string, n bigint, postings binary, ids {ids_type}, sizes array<bigint>"
    )
    return materialize(made, "token-index")


def item_windows(items: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Distinct windows of the items: (terms, items), the items as sorted texts of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"), ALNUM_WORDS)
            counts = np.diff(words.starts)
            at, owner = window_starts(words.starts, n)
            rows = [(int(o), words.codes[a : a + n]) for a, o in zip(at, owner)]
            rows += [
                (int(i), words.codes[words.starts[i] : words.starts[i + 1]])
                for i in np.flatnonzero((counts > 0) & (counts < n))
            ]
            terms = [words.vocabulary.take(pa.array(codes)).to_pylist() for _, codes in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").take(pa.array([o for o, _ in rows], pa.int64())),
                    pa.array(terms, pa.list_(pa.string())),
                ],
                ["item", "terms"],
            )

    slim = items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"), F.col(text).alias("_text"))
    made = slim.mapInArrow(run, "item string, terms array<string>")
    return made.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _routed(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index rows that queries need, and the queries of each segment.

    A query is sent to the segments that have its rarest term; one with a term that the index
    lacks is sent nowhere.
    """
    asked = queries.select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
    rows = index.filter("term IS NOT NULL").join(asked, "term", "left_semi")
    totals = rows.groupBy("term").agg(F.sum("n").alias("total"))
    terms = queries.withColumn("term", F.explode(F.array_distinct("terms"))).join(totals, "term", "left")
    rarest = terms.groupBy("query").agg(
        F.min(F.struct(F.col("total"), F.col("term")))["term"].alias("term"),
        F.max(F.col("total").isNull()).alias("absent"),
    )
    sent = queries.join(rarest.filter("NOT absent"), "query").join(rows.select("segment", "term"), "term")
    lists = index.filter("term IS NULL")
    return rows.unionByName(lists), sent.drop("term", "absent")


def _postings(rows: pa.Table) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray]:
    """The postings of a segment's rows, its documents' ids and where each document starts."""
    rows = rows.combine_chunks()
    listing = rows.filter(pc.is_null(rows["term"]))
    held = rows.filter(pc.is_valid(rows["term"]))
    postings = {
        term: unpack(blob, n)
        for term, blob, n in zip(held["term"].to_pylist(), held["postings"].to_pylist(), held["n"].to_pylist())
    }
    sizes = np.asarray(listing["sizes"].combine_chunks().flatten(), dtype=np.int64)
    ids = listing["ids"].combine_chunks().flatten()
    return postings, ids, np.concatenate([[0], np.cumsum(sizes)])


def intersect(postings: dict[str, np.ndarray], terms, starts: np.ndarray) -> np.ndarray:
    """Starts of the exact phrase: offset-adjusted postings, from the rarest term on."""
    if any(t not in postings for t in terms):
        return np.zeros(0, np.int64)
    order = sorted(range(len(terms)), key=lambda i: len(postings[terms[i]]))
    found = postings[terms[order[0]]] - order[0]
    for i in order[1:]:
        if not len(found):
            return found
        place = postings[terms[i]]
        at = np.searchsorted(place, found + i)
        found = found[(at < len(place)) & (place[np.minimum(at, len(place) - 1)] == found + i)]
    found = found[found >= 0]
    first = np.searchsorted(starts, found, "right") - 1
    return found[found + len(terms) <= starts[first + 1]]


def within(postings: dict[str, np.ndarray], terms, starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """(first, last) of the narrowest stretch of each document with all terms, of ``span`` words at most.

    Around each position of the rarest term the other terms' nearest positions decide, rarer
    terms first; the narrowest stretch that begins at a found position is then exact.
    """
    wanted = sorted(set(terms), key=lambda t: len(postings.get(t, ())))
    if not wanted or any(t not in postings for t in wanted):
        return []
    anchor = postings[wanted[0]]
    for t in wanted[1:]:
        place = postings[t]
        near = np.searchsorted(place, anchor - span + 1)
        anchor = anchor[(near < len(place)) & (place[np.minimum(near, len(place) - 1)] < anchor + span)]
    best: dict[int, tuple[int, int]] = {}
    for a in anchor:
        doc = int(np.searchsorted(starts, a, "right") - 1)
        low, high = max(int(starts[doc]), a - span + 1), min(int(starts[doc + 1]), a + span)
        spots = [postings[t][np.searchsorted(postings[t], low) : np.searchsorted(postings[t], high)] for t in wanted]
        if not all(len(s) for s in spots):
            continue
        for first in np.concatenate(spots):
            after = [np.searchsorted(s, first) for s in spots]
            if any(k == len(s) for k, s in zip(after, spots)):
                continue
            last = max(int(s[k]) for k, s in zip(after, spots))
            if last - first < span and (doc not in best or (last - first, first) < (best[doc][1] - best[doc][0], best[doc][0])):
                best[doc] = (int(first), last)
    return sorted(best.values())


def _matches(index: DataFrame, queries: DataFrame, find, key: str) -> DataFrame:
    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows, sent = _routed(index, queries)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, out = [], []
        postings, ids, starts = _postings(left)
        for query, terms in zip(right["query"].to_pylist(), right["terms"].to_pylist()):
            for first, last in find(postings, terms, starts):
                doc = int(np.searchsorted(starts, first, "right") - 1)
                docs.append(doc)
                out.append((query, first - int(starts[doc]), last - first + 1))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
        return pa.Table.from_arrays(
            [ids.take(pa.array(docs, pa.int64())), *columns], [key, "query", "first_word", "n_words"]
        )

    grouped = rows.groupBy("segment").cogroup(sent.groupBy("segment"))
    return grouped.applyInArrow(run, f"{key} {kind}, query bigint, first_word bigint, n_words bigint")


def phrase_matches(index: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Occurrences of phrases; ``queries`` is (query bigint, terms array<string>)."""

    def find(postings, terms, starts):
        return [(int(a), int(a) + len(terms) - 1) for a in intersect(postings, terms, starts)]

    return _matches(index, queries, find, key)


def proximity_matches(index: DataFrame, queries: DataFrame, span: int, key: str = "doc_id") -> DataFrame:
    """The narrowest stretch of each document that holds all terms of a query within ``span`` words."""
    return _matches(index, queries, lambda p, t, s: within(p, t, s, span), key)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    index: DataFrame | None = None,
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A word is hit if any occurrence of a window covers it. ``index``: one built before of the
    same documents.
    """
    index = build_index(docs, key, text) if index is None else index
    windows = item_windows(items, item_key, item_text, n).withColumn("query", F.xxhash64("terms"))
    windows = materialize(windows, "item-windows")
    rows, sent = _routed(index, windows)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        postings, ids, starts = _postings(left)
        named: dict[int, set] = {}
        marks = np.zeros(starts[-1] + 1, np.int64)
        for terms, names in zip(right["terms"].to_pylist(), right["items"].to_pylist()):
            found = intersect(postings, terms, starts)
            np.add.at(marks, found, 1)
            np.add.at(marks, found + len(terms), -1)
            for doc in np.unique(np.searchsorted(starts, found, "right") - 1):
                named.setdefault(int(doc), set()).update(names)
        sums = np.concatenate([[0], np.cumsum(covered(marks))])
        hits = sums[starts[1:]] - sums[starts[:-1]]
        lists = [sorted(named.get(i, ())) for i in range(len(ids))]
        digests = [hashlib.sha256(",".join(names).encode()).hexdigest() for names in lists]
        return pa.Table.from_arrays(
            [
                ids,
                pa.array(np.diff(starts), pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array([len(names) for names in lists], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(hits > 0),
                pa.array(lists, pa.list_(pa.string())),
            ],
            [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
        )

    schema = (
        f"{key} {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
        "contaminated boolean, items array<string>"
    )
    return rows.groupBy("segment").cogroup(sent.groupBy("segment")).applyInArrow(run, schema)
