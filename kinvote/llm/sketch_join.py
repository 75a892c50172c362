"""N-gram Jaccard join by parity sketches.

A text's set is its distinct ``n``-word shingles. Two sets link when
``100 * intersection >= percent * union``; then their symmetric difference is at most
``(a + b) * (100 - percent) / (100 + percent)`` for sizes a and b, and the smaller is at least
``percent`` % of the larger.

Size bands: bands are cut so that two sizes that can link lie in one band or in neighbours. A
set is *native* to its band's group and a *guest* of the next band's, so that every pair that
can link meets in the group of its larger band.

Parity sketches: in a group whose largest symmetric difference is d, a set's shingles are
dealt by their hash to ``d + 1 + spare`` pieces, and a piece is the XOR of its shingles'
hashes. Equal shingles cancel, so the XOR of two sets' sketches is the sketch of their
symmetric difference, and the number of pieces that differ never exceeds that difference's
size. Pigeonhole: of two sets that link at least ``1 + spare`` pieces are equal, and joining
on (group, piece number, piece) finds them. Empty pieces say nothing and are left out; a set
with more than ``spare`` empty pieces is dealt anew with another seed as well, and in the last
of ``SEEDS`` rounds its empty pieces are keys, so no pair is lost (``_keys`` has the argument).

Candidates: in each key's group the smallest native, the hub, is compared with other members. First
every member with the smallest of its hubs, one pair each, which ties most groups of near copies
together; then, in keys whose members are still in different components, members with their key's
hub (as many pairs as members). As long as the members of different components make many more pairs
than there are members, rounds follow in which a key is led by a native of its largest component that
a hash chooses, and a member of another component meets ``LEADERS`` leaders of its keys at most: in a
large group of copies that link with one another more or less, a round ties a share of what is still
apart. In keys that this leaves open,
members of different components meet pair by pair, so the rounds decide what the join costs, never
what it finds. Members of one component need no more comparisons, as only components are asked for.
A second parity sketch, of single bits and about as many as the set has shingles,
judges every candidate before a text moves: its Hamming distance is also
a lower bound of the symmetric difference, and sets with little in common differ in nearly half of
their bits. What is left is verified on the whole shingle sets. Hashes have 64 bits (sets are
compared by 128).

Edge cases: null and empty texts have size 0 and link with nothing; a text of fewer than ``n``
words has one shingle; rows that share an id are one node, linked to what any of their texts links
to (a row without shingles stays with its own id); the component is the smallest id reached, and
null ids are reached by no one: a row with a null id takes part in no link and its component is
null; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import LOWER_BLANK_WORDS, marked, mix, shingle_sets, slices, words_of
from kinvote.llm.components import components
from kinvote.session import materialize

SEEDS = 4
LARGEST = 1 << 40
"""Set sizes are below this; it only ends the table of bands."""
ROUNDS = 4
"""Most rounds with leaders, as long as they help, before members of different components meet pair by pair."""
LEADERS = 16
"""Leaders that a member meets in a round."""
PAIRS_A_MEMBER = 4
"""Pairs of different components for each member of an open key, above which another round is cheaper."""
LEAST_WORDS = 4
"""64-bit words of the smallest second sketches; others have a power of two, a bit a shingle at least."""


def bands(percent: int) -> np.ndarray:
    """Lower ends of the size bands: a size links at most into the next band."""
    ends = [1, 2]
    while ends[-1] < LARGEST:
        ends.append(max(ends[-1] + 1, 100 * (ends[-1] - 1) // percent + 1))
    return np.array(ends, dtype=np.int64)


def group_difference(ends: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of a pair that links, for each group."""
    largest = np.append(ends[1:] - 1, LARGEST)
    return 2 * largest * (100 - percent) // (100 + percent)


def pieces_of(ends: np.ndarray, difference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, spare) of each group: ``spare`` is a little above the empty pieces to expect.

    The smallest guests have the fewest shingles a piece, so the most empty pieces.
    """
    least = np.concatenate([ends[:1], ends[:-1]])
    needed = difference + 1
    empty = needed * np.exp(-least / needed)
    spare = 1 + np.ceil(1.25 * empty + 2 * np.sqrt(empty)).astype(np.int64)
    return needed + spare, spare


def _xor_pieces(values: np.ndarray, bounds: np.ndarray, count: np.ndarray):
    """XOR of each set's values by piece: (set, piece, xor) of the pieces that are not empty.

    The sets' values are sorted and a piece is a range of values, so pieces are runs.
    """
    owner = np.repeat(np.arange(len(count)), np.diff(bounds))
    piece = ((values >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)
    begins = np.ones(len(values), bool)
    begins[1:] = (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(begins)
    return owner[at], piece[at].astype(np.int64), np.bitwise_xor.reduceat(mix(values + np.uint64(1)), at)


def _chosen(values: np.ndarray, bounds: np.ndarray, some: np.ndarray):
    counts = np.diff(bounds)[some]
    at = np.repeat(bounds[:-1][some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return values[at], np.concatenate([[0], np.cumsum(counts)])


def _keys(values: np.ndarray, bounds: np.ndarray, percent: int):
    """(set, key, native) of all sets.

    Why no pair is lost: if two sets link, more than ``spare`` pieces of a round are equal. If
    one of those is not empty, both sets have it as a key. Else both have more than ``spare``
    empty pieces, so both go on to the next round, whose deal is another; in the last round
    empty pieces are keys too.
    """
    ends = bands(percent)
    difference = group_difference(ends, percent)
    group_pieces, group_spare = pieces_of(ends, difference)
    sizes = np.diff(bounds)
    band = np.searchsorted(ends, sizes, "right") - 1
    out = []
    for native in (True, False):
        group = band + (not native)
        some = np.flatnonzero((sizes > 0) & (difference[np.maximum(group, 0)] > 0))
        for seed in range(SEEDS):
            if not len(some):
                break
            held, limits = _chosen(values, bounds, some)
            if seed:
                held = mix(held ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
                for a, b in zip(limits[:-1], limits[1:]):
                    held[a:b].sort()
            pieces, spare = group_pieces[group[some]], group_spare[group[some]]
            which, piece, xor = _xor_pieces(held, limits, pieces)
            filled = np.bincount(which, minlength=len(some))
            again = pieces - filled > spare
            if seed == SEEDS - 1 and again.any():
                extra = [
                    (i, p)
                    for i in np.flatnonzero(again)
                    for p in np.setdiff1d(np.arange(pieces[i]), piece[which == i])
                ]
                empty = np.array(extra, dtype=np.int64)
                which, piece = np.concatenate([which, empty[:, 0]]), np.concatenate([piece, empty[:, 1]])
                xor = np.concatenate([xor, np.zeros(len(empty), np.uint64)])
            place = (group[some][which].astype(np.uint64) << np.uint64(40)) + piece.astype(np.uint64)
            key = mix(mix(place * np.uint64(SEEDS) + np.uint64(seed)) ^ xor)
            out.append((some[which], key, np.full(len(key), native)))
            some = some[again]
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]


def _bits(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The second sketches, one after another, and their bounds: each shingle flips a bit.

    A sketch is a power of two of words, so that the wider of two folds to the narrower.
    """
    sizes = np.diff(bounds)
    words = LEAST_WORDS << np.ceil(np.log2(np.maximum(sizes / (64 * LEAST_WORDS), 1))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spot = mix(values ^ np.uint64(0x5851F42D4C957F2D)).astype(np.int64) & (64 * words[owner] - 1)
    flat = (np.bincount(64 * ends[owner] + spot, minlength=64 * ends[-1]) & 1).astype(np.uint8)
    return np.packbits(flat.reshape(-1, 64), axis=1, bitorder="little").view(np.int64).ravel(), ends


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sets with ``n_`` and ``bits_`` of these names can link, by sizes and Hamming distance.

    Sets whose sketches differ by more than one fold are left to the verification.
    """
    n, m = F.col(f"n_{a}"), F.col(f"n_{b}")
    x, y = F.col(f"bits_{a}"), F.col(f"bits_{b}")
    narrow = F.least(F.size(x), F.size(y))
    folded = lambda z: F.when(F.size(z) == narrow, z).otherwise(
        F.zip_with(F.slice(z, 1, narrow), F.slice(z, narrow + 1, narrow), lambda p, q: p.bitwiseXOR(q))
    )
    differ = F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    flipped = F.aggregate(differ, F.lit(0), lambda total, k: total + k)
    near = (flipped * (100 + percent) <= (n + m) * (100 - percent)) | (F.greatest(F.size(x), F.size(y)) > 2 * narrow)
    return F.when(100 * F.least(n, m) < percent * F.greatest(n, m), False).otherwise(near)


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))


def set_table(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(_key, size, high, low, bits) of each row: its set's size, 128-bit sum and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", rows=1 << 14):
            values, bounds = shingle_sets(words_of(batch.column("_text"), LOWER_BLANK_WORDS), n)
            high, low = (_sums(mix(values ^ np.uint64(c)), bounds) for c in (0x1234567, 0x89ABCDEF))
            bits, ends = _bits(values, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bits)),
                ],
                ["_key", "size", "high", "low", "bits"],
            )

    slim = _slim(docs, key, text)
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"_key {kind}, size bigint, high bigint, low bigint, bits array<bigint>")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def piece_keys(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(key, id, native): the join keys of all sets that have an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = words_of(batch.column("_text"), LOWER_BLANK_WORDS)
            which, keys, native = _keys(*shingle_sets(words, n), percent)
            if not len(keys):
                continue
            ids = batch.column("_key").take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), ids, pa.array(native)], ["key", "id", "native"]
            )

    slim = _slim(docs, key, text).filter("_key IS NOT NULL")
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key bigint, id {kind}, native boolean")


def shared_keys(entries: DataFrame) -> DataFrame:
    """(key, id, native, hub) of the keys that several ids have and a native among them.

    One shuffle by key, sorted; the rows of a key then pass by one at a time, so no group is
    held however large it is. The hub is the key's smallest native, its first row.
    """
    kind = entries.schema["id"].dataType.simpleString()
    ordered = entries.repartition("key").sortWithinPartitions("key", F.desc("native"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = None  # of the last row; hub also of its group
        hub_native = told = False  # whether the hub's own row has been given
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, native = np.asarray(batch.column("key")), np.asarray(batch.column("native").to_numpy(zero_copy_only=False))
            ids = np.asarray(batch.column("id"))
            begins = np.ones(len(keys), bool)
            begins[1:] = keys[1:] != keys[:-1]
            begins[0] = key is None or keys[0] != key
            first = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
            hubs = np.where(first >= 0, ids[np.maximum(first, 0)], ids[0] if hub is None else hub)
            led = np.where(first >= 0, native[np.maximum(first, 0)], hub_native)
            member = led & ~begins & (ids != hubs)
            at = np.flatnonzero(member)
            # the hub's row goes before the first other member of its group
            group = np.cumsum(begins)
            opens = np.ones(len(at), bool)
            opens[1:] = group[at[1:]] != group[at[:-1]]
            if len(at) and group[at[0]] == 0 and told:
                opens[0] = False
            heads = at[opens]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys[at], keys[heads]])),
                    pa.array(np.concatenate([ids[at], hubs[heads]])),
                    pa.array(np.concatenate([native[at], np.ones(len(heads), bool)])),
                    pa.array(np.concatenate([hubs[at], hubs[heads]])),
                ],
                ["key", "id", "native", "hub"],
            )
            last_told = bool(len(at)) and group[at[-1]] == group[-1]
            told = last_told or (told and group[-1] == 0)
            key, hub, hub_native = keys[-1], hubs[-1], bool(led[-1])

    return ordered.mapInArrow(run, f"key bigint, id {kind}, native boolean, hub {kind}")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets link. Only texts of rows in pairs are shuffled."""
    involved = pairs.select(F.col("a").alias("_id")).union(pairs.select("b"))
    slim = _slim(docs, key, text).filter("_text IS NOT NULL")  # an id's other rows may have a text
    texts = marked(slim, F.col("_key"), involved, "_id").filter("_hit").select("_key", "_text")
    left = texts.select(F.col("_key").alias("a"), F.col("_text").alias("_left"))
    right = texts.select(F.col("_key").alias("b"), F.col("_text").alias("_right"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "_left", "_right")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "_right", 4 << 20):
                sides = []
                for side in ("_left", "_right"):
                    coded = batch.column(side).dictionary_encode()
                    sides.append((np.asarray(coded.indices), *_sets(coded.dictionary, n)))
                ok = []
                for i in range(batch.num_rows):
                    (x, values, at), (y, other, to) = sides
                    first, second = values[at[x[i]] : at[x[i] + 1]], other[to[y[i]] : to[y[i] + 1]]
                    ok.append(_links(first, second, percent))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(
                    pa.array(ok, pa.bool_())
                )

    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _sets(texts: pa.Array, n: int):
    return shingle_sets(words_of(texts, LOWER_BLANK_WORDS), n)


def _links(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    if not len(first) or not len(second) or 100 * min(len(first), len(second)) < percent * max(len(first), len(second)):
        return False
    at = np.minimum(np.searchsorted(second, first), len(second) - 1)
    both = int((second[at] == first).sum())
    return 100 * both >= percent * (len(first) + len(second) - both)


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row: key, n_shingles, component_id, representative.

    ``representative`` is the smallest id with the same set (null without shingles).
    """
    sets = materialize(set_table(docs, key, text, n), "sketch-sets")
    same = sets.filter("size > 0 AND _key IS NOT NULL").groupBy("size", "high", "low").agg(
        F.min("_key").alias("rep"), F.first("bits").alias("bits")
    )
    same = materialize(same, "sketch-classes")
    rows = sets.select("_key", "size", "high", "low").join(same.drop("bits"), ["size", "high", "low"], "left")
    rows = materialize(rows.select("_key", "size", "rep"), "sketch-rows")
    # ids that several sets have tie those sets' classes
    several = rows.filter("rep IS NOT NULL AND _key IS NOT NULL").groupBy("_key").agg(
        F.min("rep").alias("a"), F.max("rep").alias("most")
    ).filter("a <> most").select("_key", "a")
    shared_ids = materialize(
        rows.join(several, "_key").select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), "sketch-shared-ids"
    )
    classes = same.select(F.col("rep").alias("id"), "size", "bits")
    entries = piece_keys(docs, key, text, n, percent)
    members = shared_keys(entries).join(classes.select("id"), "id", "left_semi")
    members = materialize(members.select("key", "id", "native", "hub"), "sketch-members")
    sketches = lambda name: classes.select(
        F.col("id").alias(name), F.col("size").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}")
    )
    ordered = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]

    def judged(pairs: DataFrame) -> DataFrame:
        """The pairs that size and sketch allow, written."""
        both = pairs.join(sketches("a"), "a").join(sketches("b"), "b").filter(may_link("a", "b", percent))
        return materialize(both.select("a", "b"), "sketch-pairs")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(verified(pairs, docs, key, text, n, percent), "sketch-links")

    def open_members(before: DataFrame, links: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
        """Members, with their components, of those keys whose members are in several; and those components as links.

        With the key's leader of the round, a native of the component that has most members in the key.
        """
        tied = components(links)
        stars = tied.filter("node <> component").toDF("a", "b")
        placed = before.select("key", "id", "native", "hub").join(tied.withColumnRenamed("node", "id"), "id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "id"))
        placed = materialize(placed.select("key", "id", "native", "hub", "component"), "sketch-placed")
        order = F.struct(F.xxhash64("key", "id", F.lit(seed)), F.col("id").alias("leader"))
        parts = placed.groupBy("key", "component").agg(
            F.count(F.lit(1)).alias("c"), F.min(F.when(F.col("native"), order)).alias("of")
        )
        apart = parts.groupBy("key").agg(
            F.min("component").alias("x"),
            F.max("component").alias("y"),
            F.max(F.when(F.col("of").isNotNull(), F.struct("c", "of.leader", F.col("component").alias("led")))).alias("first"),
        )
        apart = apart.filter("x <> y").select("key", "first.leader", "first.led")
        return materialize(placed.join(apart, "key"), "sketch-open"), stars

    def apart_pairs(members: DataFrame) -> tuple[float, float]:
        """Number of pairs of different components in the keys, and of members."""
        parts = members.groupBy("key", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
        keys = parts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
        total = keys.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        return total[0] or 0, total[1] or 0

    def met(members: DataFrame, seed: int) -> DataFrame:
        """Pairs of a member and leaders of its keys that are in other components, a few each."""
        order = F.struct(F.xxhash64("leader", F.lit(seed)), "leader")
        some = members.filter("component <> led").groupBy("id").agg(F.sort_array(F.collect_set(order)).alias("leaders"))
        pairs = some.select("id", F.explode(F.slice("leaders.leader", 1, LEADERS)).alias("hub"))
        return pairs.select(*ordered).distinct()

    # one pair a member, with the smallest of its hubs, ties most groups of near copies together
    near = judged(members.filter("id <> hub").groupBy("id").agg(F.min("hub").alias("hub")).select(*ordered))
    links = shared_ids.unionByName(linked(near))
    # a key's hub and its members of other components; sizes and sketches judge in the join
    still, links = open_members(members, links, 0)
    left = still.join(classes.withColumnRenamed("size", "n"), "id")
    hubs = left.filter("id = hub").select(
        "key", F.col("component").alias("led"), F.col("n").alias("n_hub"), F.col("bits").alias("bits_hub")
    )
    left = left.select("key", "id", "hub", "component", F.col("n").alias("n_own"), F.col("bits").alias("bits_own"))
    fits = (F.col("component") != F.col("led")) & may_link("own", "hub", percent)
    star = left.join(hubs, "key").filter(fits).select(*ordered).distinct()
    star = materialize(star.join(near, ["a", "b"], "left_anti"), "sketch-stars")
    more, seen = linked(star), near.unionByName(star)
    if more.count():  # else components, and open keys, are what they were
        still, links = open_members(still, links.unionByName(more), 1)
    before = np.inf
    for seed in range(1, ROUNDS + 1):
        apart, rows_open = apart_pairs(still)
        if apart <= PAIRS_A_MEMBER * rows_open or apart > 0.9 * before:  # few, or what is apart does not link
            break
        before = apart
        some = judged(met(still, seed).join(seen, ["a", "b"], "left_anti"))
        more, seen = linked(some), seen.unionByName(some)
        if not more.count():  # what leaders meet does not link
            break
        still, links = open_members(still, links.unionByName(more), seed + 1)
    left = still.join(classes.withColumnRenamed("size", "n"), "id")
    names = ["id", "native", "component", "n", "bits"]
    first = left.select("key", *[F.col(c).alias(f"{c}_a") for c in names])
    second = left.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    may = (
        (F.col("id_a") < F.col("id_b"))
        & (F.col("native_a") | F.col("native_b"))
        & (F.col("component_a") != F.col("component_b"))
        & may_link("a", "b", percent)
    )
    rest = first.join(second, "key").filter(may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    rest = rest.join(seen, ["a", "b"], "left_anti")
    more = linked(materialize(rest, "sketch-rest"))
    tied = components(links.unionByName(more))
    found = rows.join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("_key").isNotNull(), F.coalesce("component", "rep", "_key"))
    return found.select(
        F.col("_key").alias(key),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        F.when(F.col("_key").isNotNull(), F.col("rep")).alias("representative"),
    )
