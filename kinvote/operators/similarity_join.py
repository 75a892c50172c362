"""Jaccard joins of test rows with training rows over token sets, in blocks.

Input is one table ``id, label, features, is_test`` with distinct ``features``; it should be a
written table, since it is read several times. Rows without features are in no pair.

Test rows are the queries and training rows the data. Both are dealt to blocks by a hash of
their id, some thousand rows or ``BLOCK_TOKENS`` tokens each, and a block is packed into one row of a
written table: ids, labels, tokens. The two block tables then meet in a Cartesian product (``meet``),
whose tasks read some blocks of either side. So every row is shuffled and written once,
however many blocks there are; a pair of blocks costs reading, not disk. Inside a pair of
blocks each test row's overlaps with all training rows are counted in one go (``Overlaps``): frequent
tokens by bits of the training rows that have them, others from an inverted index. Only pairs below the threshold, or each test row's
first ``k`` of the training blocks that a task reads, leave the task, once each.
So a token that all rows have costs a task no more than its block has rows, copies need no
special care, and nothing is emitted that the result does not need.

With n test and m training rows the work of the exact join is n * m set comparisons at worst. That
is what exact neighbours of arbitrary sets cost; for whole corpora use ``forest``, which compares
candidates only, on the same blocks.

Tokens are compared by a 64-bit hash.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import list_sizes
from ..session import materialize

TEST_ROWS = 4096  # rows of a block; as many share the index of a training block
TRAIN_ROWS = 8192
LEAST_ROWS = 64  # blocks of small tables are cut to give every core one, not below this
EVEN_TASKS, EVEN_ROWS = 3, 512  # and to give every core so many tasks, not below so many rows
BLOCK_TOKENS = 1 << 21  # tokens of a block, where rows are long
TASK_BLOCKS = 16
"""Training blocks of a file; a task holds those of a file, or of a part of it where Spark splits the file."""
TASK_FILES = 4
"""Least number of files of training blocks, so that there are tasks enough: a test row's first ``k`` come from each part."""

BLOCK_BY_BLOCK = {"parquet.block.row.count.limit": "1"}
"""A row group a block: a task reads one block at a time, and Spark splits files that are large for a task between blocks."""

PAIRS = {
    "test_id": "bigint",
    "test_label": "int",
    "train_id": "bigint",
    "train_label": "int",
    "distance": "double",
    "overlap": "bigint",
    "union_size": "bigint",
    "first": "int",
}
NEVER = np.iinfo(np.int32).max

OFTEN = 64
"""A token that one of so many training rows of a block has, or more, is counted by bits."""
MOST_AT_ONCE = 255
"""Frequent tokens of a test row that are counted in one pass: their number fits a byte."""
ROOM, MOST_ROWS = 1 << 17, 16
"""64-bit words, and test rows, that are counted in one pass."""
CHUNK_PAIRS = 1 << 18
"""Pairs of a block that are scored at once, as long as a test row has fewer."""


def _blocks(rows: int, tokens: int, most: int, wanted: int, even: int = 1) -> int:
    cut = max(min(wanted, rows // LEAST_ROWS), min(even, rows // EVEN_ROWS))
    return max(1, -(-rows // most), -(-tokens // BLOCK_TOKENS), cut)


def _train_files(blocks: int) -> int:
    return min(blocks, max(TASK_FILES, -(-blocks // TASK_BLOCKS)))


def block_counts(rows: DataFrame, runs: Sequence[str] = (), train_rows: int | None = None) -> tuple[int, int]:
    """Numbers of test and training blocks, from the numbers of rows and tokens (of the largest run)."""
    size = F.greatest(F.size("features"), F.lit(0)).cast("bigint")
    sides = {"test": F.col("is_test"), "train": ~F.col("is_test")}
    counts = rows.groupBy(*runs).agg(
        *[F.count(F.when(side, 1)).alias(name) for name, side in sides.items()],
        *[F.sum(F.when(side, size)).alias(f"{name}_tokens") for name, side in sides.items()],
    )
    names = ["test", "train", "test_tokens", "train_tokens"]
    found = counts.agg(*[F.max(name).alias(name) for name in names], F.count(F.lit(1)).alias("runs")).first()
    tests, trains, test_tokens, train_tokens = (found[name] or 0 for name in names)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    train = _blocks(trains, train_tokens, train_rows or TRAIN_ROWS, 1)
    runs = max(found["runs"], 1)
    even = -(-EVEN_TASKS * cores // (_train_files(train) * runs))
    return _blocks(tests, test_tokens, TEST_ROWS, -(-cores // (train * runs)), even), train


_block_counts = block_counts


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _dealt(rows: DataFrame, blocks: tuple[int, int], *extra: str) -> DataFrame:
    """Every row once, in the block of its side: ``tb, rb, id, label, is_test, t, ...``, ``tb`` or ``rb`` null."""
    tests, trains = blocks
    return rows.where(F.size("features") > 0).select(
        F.when(F.col("is_test"), block_of("id", tests)).alias("tb"),
        F.when(~F.col("is_test"), block_of("id", trains)).alias("rb"),
        "id",
        F.col("label").cast("int").alias("label"),
        "is_test",
        F.transform("features", lambda t: F.xxhash64(t)).alias("t"),
        *extra,
    )


def _packed(rows: DataFrame, key: str, files: int, extra: Sequence[str], runs: Sequence[str]) -> DataFrame:
    """One row a block: ``runs..., block``, and the block's columns as arrays.

    ``token`` has the rows' tokens one row after another, ``by_token`` their places in the order of
    tokens. Extra array columns are put together likewise.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in (*runs, *extra)}
    fields = [f"{n} {kinds[n]}" for n in runs] + ["block int, id array<bigint>, label array<int>, size array<int>"]
    fields += ["token array<bigint>, by_token array<int>"] + [f"{n} {kinds[n]}" for n in extra]

    def pack(keys: tuple, group: pa.Table) -> pa.Table:
        lists = group["t"].combine_chunks()
        token = np.asarray(lists.flatten(), dtype=np.int64)
        flat = {
            "id": group["id"].combine_chunks(),
            "label": group["label"].combine_chunks(),
            "size": pa.array(list_sizes(lists), pa.int32()),
            "token": pa.array(token),
            "by_token": pa.array(np.argsort(token, kind="stable"), pa.int32()),
            **{n: group[n].combine_chunks().flatten() for n in extra},
        }
        one = {n: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for n, v in flat.items()}
        return pa.table({**{n: pa.array([v.as_py()], v.type) for n, v in zip([*runs, "block"], keys)}, **one})

    side = rows.repartition(files, *runs, key)
    packed = side.groupBy(*runs, key).applyInArrow(pack, ", ".join(fields))
    return materialize(packed, "blocks", BLOCK_BY_BLOCK)


class _Side:
    """Ids, labels and token sets of a block, and its extra columns."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, extra: Sequence[str]):
        column = lambda name: batch.column(f"{side}_{name}")[row].values
        self.id, self.label = column("id").to_numpy(zero_copy_only=False), column("label")
        self.size = np.asarray(column("size"), dtype=np.int64)
        self.tokens, self.by_token = np.asarray(column("token")), np.asarray(column("by_token"))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.extra = {name: np.asarray(column(name)) for name in extra}

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.at[i] : self.at[i + 1]]

    def wide(self, name: str) -> np.ndarray:
        """An extra column that has equally many values in each row."""
        return self.extra[name].reshape(len(self.id), -1)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start, start + 1, ...`` of the given sizes, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Postings:
    """Values, each with the places that have it."""

    def __init__(self, values: np.ndarray, order: np.ndarray | None = None):
        self.places = np.argsort(values, kind="stable") if order is None else order
        ordered = values[self.places]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        self.values, self.first = ordered[first], np.append(first, len(ordered))

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, which): the places of the values, and which value each is a place of."""
        at = np.searchsorted(self.values, values)
        which = np.flatnonzero(self.values[np.minimum(at, len(self.values) - 1)] == values) if len(self.values) else np.zeros(0, np.int64)
        at = at[which]
        sizes = self.first[at + 1] - self.first[at]
        return self.places[ranges(self.first[at], sizes)], np.repeat(which, sizes)


class Index:
    """The tokens of the training rows of a block."""

    def __init__(self, side: _Side):
        self.side = side
        self.postings = Postings(side.tokens, side.by_token)
        owner = np.repeat(np.arange(len(side.size)), side.size)
        self.postings.places = owner[side.by_token]  # rows

    @functools.cached_property
    def codes(self) -> np.ndarray:
        """The training rows' tokens as numbers of ``postings.values``."""
        out = np.empty(len(self.side.tokens), np.int64)
        out[self.side.by_token] = np.repeat(np.arange(len(self.postings.values)), np.diff(self.postings.first))
        return out


_FIELDS = [np.uint64(v) for v in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]
"""Every other field of 1, 2 and 4 bits."""
_SHIFTS = [np.uint64(v) for v in (1, 2, 4)]


class _Bits:
    """For each of some tokens a bit a training row; counts rows' tokens in fields of 2, 4 and 8 bits.

    Byte ``q`` has the rows ``q, q + width, q + 2 * width, ...``, so that the counts of a bit of all
    bytes are those of rows that follow one another.
    """

    def __init__(self, rows: int, tokens: int, token: np.ndarray, row: np.ndarray):
        self.rows, self.words = rows, -(-rows // 64)
        width = 8 * self.words
        self.bits = np.zeros((tokens + 1, self.words), np.uint64)  # the last stands for no token
        octets = self.bits.view(np.uint8).reshape(-1)
        bit, at = np.divmod(row, width)
        at += token * width
        for b in range(8):  # a token has a byte's bit once
            octets[at[bit == b]] |= np.uint8(1 << b)
        self.room = [np.empty(max(ROOM, MOST_AT_ONCE * self.words) * n // 15, np.uint64) for n in (15, 15, 20, 4, 8)]

    def fitting(self, tokens: int) -> int:
        """How many test rows of so many tokens can be counted at once."""
        return int(max(1, min(MOST_ROWS, ROOM // (15 * -(-max(min(tokens, MOST_AT_ONCE), 1) // 15) * self.words))))

    def add(self, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Add to ``counts``, by test row and training row, how many of its column of ``tokens`` the training row has."""
        one, two, four = _FIELDS
        own = tokens.shape[1] * self.words
        for low in range(0, len(tokens), MOST_AT_ONCE):
            some = tokens[low : low + MOST_AT_ONCE]
            fives = len(some) // 15
            n = fives * own
            odd, even, quarters, sums, eighths = (room[: k * n] for room, k in zip(self.room, (15, 15, 20, 4, 8)))
            np.take(self.bits, some, axis=0, out=odd.reshape(*some.shape, self.words), mode="clip")
            np.bitwise_and(odd, one, out=even)
            odd >>= _SHIFTS[0]
            odd &= one
            quarters = quarters.reshape(4, 5 * n)
            for i, half in enumerate((even, odd)):  # the sums of three bits in two
                third = half[: 5 * n]
                third += half[5 * n : 10 * n]
                third += half[10 * n :]
                np.bitwise_and(third, two, out=quarters[i])
                third >>= _SHIFTS[1]
                np.bitwise_and(third, two, out=quarters[i + 2])
            np.add.reduce(quarters.reshape(4, 5, n), axis=1, out=sums.reshape(4, n))  # of fifteen in four
            np.bitwise_and(sums, four, out=eighths[: 4 * n])
            sums >>= _SHIFTS[2]
            np.bitwise_and(sums, four, out=eighths[4 * n :])
            total = np.add.reduce(eighths.reshape(8, fives, own), axis=1).view(np.uint8)
            total = total.reshape(8, tokens.shape[1], -1).swapaxes(0, 1).reshape(tokens.shape[1], -1)
            counts += total[:, : self.rows]


class Overlaps:
    """How many tokens the rows of a test block have in common with those of a training block.

    A token that many training rows have (``OFTEN``) is counted for 64 rows at once, by its bits;
    of any other the rows are listed.
    """

    def __init__(self, tests: _Side, trains: _Side):
        self.rows = rows = len(trains.size)
        ordered = trains.tokens[trains.by_token]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        # behind the known tokens there is one that no row has
        known, ends = ordered[first], np.concatenate([first, [len(ordered)] * 2])
        self.places = np.repeat(np.arange(rows, dtype=np.int32), trains.size)[trains.by_token]
        asked = Postings(tests.tokens, tests.by_token)
        at = np.searchsorted(known, asked.values)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == asked.values[at < len(known)], at[at < len(known)], len(known))
        starts, sizes = ends[at], ends[at + 1] - ends[at]
        often = sizes * OFTEN >= max(rows, 1)
        some = np.flatnonzero(often)
        listed = self.places[ranges(starts[some], sizes[some])].astype(np.int64)
        self.bits = _Bits(rows, len(some), np.repeat(np.arange(len(some)), sizes[some]), listed)
        # tokens of the test rows, one row after another, as numbers of the asked ones
        code = np.empty(len(tests.tokens), np.int64)
        code[tests.by_token] = np.repeat(np.arange(len(at)), np.diff(asked.first))
        counted = often[code]
        looked = (sizes[code] > 0) & ~counted
        self.counted = (np.cumsum(often) - 1)[code[counted]]
        self.starts, self.sizes = starts[code[looked]], sizes[code[looked]]
        self.counted_at, self.looked_at, self.found_at = (
            np.concatenate([[0], np.cumsum(x)])[tests.at] for x in (counted, looked, np.where(looked, sizes[code], 0))
        )

    def groups(self) -> Iterator[np.ndarray]:
        """The test rows, in groups to be counted together: of about equally many frequent tokens."""
        tokens = np.diff(self.counted_at)
        order, low = np.argsort(-tokens, kind="stable"), 0
        while low < len(order):
            high = low + self.bits.fitting(tokens[order[low]])
            yield order[low:high]
            low = high

    def of(self, group: np.ndarray) -> np.ndarray:
        """The overlaps of each test row of the group with each training row."""
        at = self.looked_at[group]
        some = ranges(at, self.looked_at[group + 1] - at)
        found = self.places[ranges(self.starts[some], self.sizes[some])]
        if len(group) > 1:
            found += np.repeat(np.arange(len(group), dtype=np.int32) * self.rows, self.found_at[group + 1] - self.found_at[group])
        counts = np.bincount(found, minlength=len(group) * self.rows).reshape(len(group), self.rows)
        at = self.counted_at[group]
        sizes = self.counted_at[group + 1] - at
        tokens = np.full((15 * -(-sizes.max() // 15), len(group)), len(self.bits.bits) - 1)
        tokens[ranges(np.zeros(len(group), np.int64), sizes), np.repeat(np.arange(len(group)), sizes)] = self.counted[ranges(at, sizes)]
        self.bits.add(tokens, counts)
        return counts


def near_pairs(tests: _Side, trains: _Side, threshold: float, bound: np.ndarray) -> Iterator[Found]:
    """All pairs with a common token, a distance below ``threshold`` and not above the row's ``bound``, in chunks."""
    overlaps, parts, held = Overlaps(tests, trains), [], 0
    # a distance d needs an overlap of (1 - d) / (2 - d) of both sizes; a little less goes on to the exact test
    most = np.minimum(bound, min(threshold, 1.0))
    share = (1 - most) / (2 - most)
    least, sizes = share * tests.size - 0.01, trains.size.astype(float)

    def scored() -> Found:
        i, j, overlap = (np.concatenate(c) for c in zip(*parts))
        found = _scored(tests, trains, i, j, overlap, np.zeros(len(j), np.int32))
        near = (overlap > 0) & (found["distance"] < threshold) & (found["distance"] <= bound[i])
        return {n: v[near] for n, v in found.items()}

    for group in overlaps.groups():
        counts = overlaps.of(group)
        beyond = np.multiply.outer(share[group], sizes)
        np.subtract(counts, beyond, out=beyond)
        beyond -= least[group][:, None]
        at = np.flatnonzero(beyond > 0)
        row, j = np.divmod(at, len(sizes))
        parts.append((group[row], j, counts.reshape(-1)[at]))
        held += len(at)
        if held >= CHUNK_PAIRS:
            yield scored()
            parts, held = [], 0
    if parts:
        yield scored()


def agreeing(found: Found, tests: _Side, trains: _Side, name: str, most: int) -> Found:
    """The pairs whose rows agree at one of the first ``most`` places of a wide column; ``first`` is its number, from 1."""
    mine, other = tests.wide(name)[:, :most], trains.wide(name)[:, :most]
    first = np.zeros(len(found["i"]), np.int32)
    step = max(1, (1 << 19) // max(most, 1))
    for low in range(0, len(first), step):
        same = mine[found["i"][low : low + step]] == other[found["j"][low : low + step]]
        first[low : low + step] = np.where(same.any(axis=1), same.argmax(axis=1) + 1, 0)
    kept = first > 0
    return {n: v[kept] for n, v in {**found, "first": first}.items()}


def score_candidates(tests: _Side, trains: _Side, i: np.ndarray, j: np.ndarray, index: Index | None = None) -> np.ndarray:
    """Overlaps of given pairs of places, in order of ``i``; the pairs' own tokens are looked at, no others."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    index = index or Index(trains)
    codes, known = index.codes, index.postings.values
    has = np.zeros(len(known), np.uint8)
    opens = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for low, high in zip(opens, np.append(opens[1:], len(i))):
        tokens = tests.of(i[low])
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        at = at[known[at] == tokens]
        rows = j[low:high]
        sizes = trains.size[rows]
        has[at] = 1
        held = has[codes[ranges(trains.at[rows], sizes)]]
        out[low:high] = np.add.reduceat(held, np.cumsum(sizes) - sizes, dtype=np.int64)
        has[at] = 0
    return out


Found = dict[str, np.ndarray]
"""Pairs of two blocks: places ``i`` and ``j``, ``distance``, ``overlap``, ``union`` and ``first``."""


class _Nearest:
    """The ``k`` nearest pairs so far of each row of a test block, for each limit of ``first``."""

    def __init__(self, tests: _Side, k: int | None, limits: Sequence[int], columns: Sequence[str]):
        self.tests, self.k, self.limits, self.columns, self.held = tests, k, limits, columns, None
        self.bound = np.full(len(tests.id), np.inf)
        """Distance above which a pair of the row is not needed any more."""

    def add(self, found: Found, trains: _Side) -> None:
        if self.k is not None:
            kept = self._near(found)
            found = {n: v[kept] for n, v in found.items()}
        new = {n: v for n, v in found.items() if n != "j"}
        new["id"] = trains.id[found["j"]]
        label = trains.label.take(pa.array(found["j"]))
        new["label"], new["known"] = np.asarray(label.fill_null(0)), np.asarray(label.is_valid())
        if self.held:
            new = {n: np.concatenate([self.held[n], v]) for n, v in new.items()}
        self.held = new

    def _near(self, found: Found) -> np.ndarray:
        """Places of the pairs that are not beyond the ``k`` nearest of their row for a limit; the rows' pairs lie together."""
        i, first, distance = (found[n] for n in ("i", "first", "distance"))
        opens = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        keep, ends = np.ones(len(i), bool), np.append(opens[1:], len(i))
        many = ends - opens > self.k
        for low, high in zip(opens[many].tolist(), ends[many].tolist()):
            part, kept = distance[low:high], keep[low:high]
            kept[:] = False
            for limit in self.limits:
                some = first[low:high] <= limit
                own = part[some]
                kept |= some & (part <= np.partition(own, self.k - 1)[self.k - 1]) if len(own) > self.k else some
        return np.flatnonzero(keep)

    def settle(self) -> None:
        """Keep what can be among a row's ``k`` nearest, and know its bound."""
        if self.k is not None and self.held:
            kept, self.bound = self._kept(self.held, self.held["id"])
            self.held = {n: v[kept] for n, v in self.held.items()}

    def _kept(self, pairs: Found, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs among the ``k`` first by (distance, id) of their row for a limit, and the rows' bounds."""
        order = np.lexsort((ids, pairs["distance"], pairs["i"]))
        first, rows, distance = (pairs[n][order] for n in ("first", "i", "distance"))
        keep, bound = np.zeros(len(order), bool), np.zeros(len(self.bound))
        for limit in self.limits:
            some = np.flatnonzero(first <= limit)
            i = rows[some]
            opens = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
            rank = np.arange(len(i)) - np.repeat(opens, np.diff(np.append(opens, len(i))))
            keep[some[rank < self.k]] = True
            last = some[rank == self.k - 1]
            of_limit = np.full(len(bound), np.inf)
            of_limit[rows[last]] = distance[last]
            bound = np.maximum(bound, of_limit)
        return order[keep], bound

    def pairs(self, runs: dict[str, pa.Scalar]) -> Iterator[pa.RecordBatch]:
        if not self.held or not len(self.held["i"]):
            return
        i, held = pa.array(self.held["i"]), self.held
        made = {
            "test_id": lambda: pa.array(self.tests.id[held["i"]], pa.int64()),
            "test_label": lambda: self.tests.label.take(i),
            "train_id": lambda: pa.array(held["id"], pa.int64()),
            "train_label": lambda: pa.array(held["label"], pa.int32(), mask=~held["known"]),
            "distance": lambda: pa.array(held["distance"], pa.float64()),
            "overlap": lambda: pa.array(held["overlap"], pa.int64()),
            "union_size": lambda: pa.array(held["union"], pa.int64()),
            "first": lambda: pa.array(held["first"], pa.int32()),
        }
        columns = {
            **{n: pa.array([v.as_py()], v.type).take(pa.array(np.zeros(len(i), np.int64))) for n, v in runs.items()},
            **{n: made[n]() for n in self.columns},
        }
        yield from pa.table(columns).to_batches(max_chunksize=1 << 16)
        self.held = None


def meet(
    rows: DataFrame,
    blocks: tuple[int, int],
    match: Callable[[_Side, _Side, np.ndarray], Iterable[Found]],
    k: int | None = None,
    limits: Sequence[int] = (NEVER,),
    extra: Sequence[str] = (),
    runs: Sequence[str] = (),
    columns: Sequence[str] = tuple(PAIRS),
) -> DataFrame:
    """What ``match`` finds in each test block with each training block (of its run), as ``columns`` of ``PAIRS``.

    ``match`` gets the two blocks and, for each test row, the distance above which it needs no pair, and gives
    the pairs in chunks. With
    ``k``, a test row's ``k`` nearest of ``first`` up to each limit leave a task. ``extra`` are array
    columns of ``rows`` that ``match`` reads.
    """
    dealt = _dealt(rows, blocks, *extra, *runs)
    test_files = min(blocks[0], 4 * rows.sparkSession.sparkContext.defaultParallelism)
    train_files = _train_files(blocks[1])
    if runs:
        test_files, train_files = 4 * test_files, 4 * train_files
    tests = _packed(dealt.where("is_test"), "tb", test_files, extra, runs)
    trains = _packed(dealt.where("not is_test"), "rb", train_files, extra, runs)
    tests = tests.select(*[F.col(c).alias(f"test_{c}") for c in tests.columns])
    trains = trains.select(*[F.col(c).alias(f"train_{c}") for c in trains.columns])
    # left blocks pass one by one, each with all right ones of the task; neither side is shuffled or broadcast
    both = tests.hint("shuffle_replicate_nl")
    same = [F.col(f"test_{r}").eqNullSafe(F.col(f"train_{r}")) for r in runs]
    both = both.join(trains, same, "inner") if runs else both.crossJoin(trains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, near, of_runs = None, None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                keys = {n: batch.column(f"test_{n}")[row] for n in [*runs, "block"]}
                if near is None or now != [v.as_py() for v in keys.values()]:
                    if near is not None:
                        yield from near.pairs(of_runs)
                    now, of_runs = [v.as_py() for v in keys.values()], {n: keys[n] for n in runs}
                    near = _Nearest(_Side(batch, row, "test", extra), k, limits, columns)
                trains = _Side(batch, row, "train", extra)
                for found in match(near.tests, trains, near.bound):
                    near.add(found, trains)
                    if k is None:
                        yield from near.pairs(of_runs)
                near.settle()
        if near is not None:
            yield from near.pairs(of_runs)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in runs}
    fields = {**{n: kinds[n] for n in runs}, **{n: PAIRS[n] for n in columns}}
    return both.mapInArrow(run, ", ".join(f"{n} {kind}" for n, kind in fields.items()))


def _scored(tests: _Side, trains: _Side, i: np.ndarray, j: np.ndarray, overlap: np.ndarray, first: np.ndarray) -> Found:
    union = tests.size[i] + trains.size[j] - overlap
    distance = (union - overlap) / union
    return {"i": i, "j": j, "distance": distance, "overlap": overlap, "union": union, "first": first}


def near_candidates(
    tests: _Side,
    trains: _Side,
    i: np.ndarray,
    j: np.ndarray,
    first: np.ndarray,
    threshold: float,
    bound: np.ndarray,
    index: Index | None = None,
) -> Found:
    """Exact scores of candidates (in order of ``i``) that have a common token and a distance below ``threshold``."""
    found = _scored(tests, trains, i, j, score_candidates(tests, trains, i, j, index), first)
    near = (found["overlap"] > 0) & (found["distance"] < threshold) & (found["distance"] <= bound[i])
    return {n: v[near] for n, v in found.items()}


def block_pairs(
    rows: DataFrame,
    threshold: float,
    k: int | None = None,
    table_counts: Sequence[int] = (),
    columns: Sequence[str] = tuple(PAIRS),
) -> DataFrame:
    """Pairs with a shared token and a distance strictly below ``threshold``.

    ``k``: only what can be among a test row's ``k`` nearest (its first ``k`` of a task).
    ``table_counts``: ``rows`` have a ``signature``, pairs also need an agreeing hash table, and
    get its number (from 1) as ``first_table``; the first ``k`` are kept for each table count.
    ``columns``: only these leave the join.
    """
    limits = sorted(set(table_counts))

    def match(tests: _Side, trains: _Side, bound: np.ndarray) -> Iterator[Found]:
        for found in near_pairs(tests, trains, threshold, bound):
            yield agreeing(found, tests, trains, "signature", limits[-1]) if limits else found

    found = meet(rows, block_counts(rows), match, k, limits or (NEVER,), ["signature"] if limits else [], columns=columns)
    return found.withColumnRenamed("first", "first_table") if limits else found.drop("first")


def threshold_pairs(rows: DataFrame, threshold: float, columns: Sequence[str] = tuple(PAIRS)) -> DataFrame:
    """All (test, train) pairs with Jaccard distance strictly below ``threshold``.

    A threshold of 1 keeps every pair that shares a token.
    """
    return block_pairs(rows, threshold, columns=columns)


def topk_pairs(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """The ``k`` nearest training rows of each test row below ``threshold``, with ``rank``.

    Order is (distance, train_id). A row among a test row's first k of all is among its first
    k of the blocks that a task reads, so a task offers k rows at most.
    """
    return rank_neighbors(block_pairs(rows, threshold, k), k)


def rank_neighbors(pairs: DataFrame, k: int, keys: tuple[str, ...] = ("test_id",)) -> DataFrame:
    """Add ``rank`` by (distance, train_id) and keep the first ``k`` (cut before the shuffle)."""
    order = Window.partitionBy(*keys).orderBy("distance", "train_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
