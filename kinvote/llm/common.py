"""Tokens, hashes and table helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
"""Text that a task tokenises at once; a longer text is a slice of its own."""

BATCH_BYTES = 4 << 20
"""Bytes of the Arrow batches in which rows travel to Python."""

_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = bytes((9, 10, 11, 12, 13, 32))
LOWER_BLANK_WORDS = _ASCII_LOWER
"""Lower-cases A-Z; words are then runs without ASCII white space."""
BLANK_WORDS = bytes(range(256))
"""Changes nothing; words are runs without ASCII white space."""
ALNUM_WORDS = bytes(
    _ASCII_LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
"""Lower-cases A-Z and blanks every ASCII character that is no letter or digit."""


@dataclass
class Words:
    """Words of several texts: text i has ``codes[starts[i]:starts[i + 1]]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: pa.Array

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def small_batches(spark: SparkSession) -> SparkSession:
    """Let the session cut Arrow batches at ``BATCH_BYTES``, if it does not cut them lower.

    Ten thousand rows of whole texts, Spark's own cut, are held several times over, in the
    JVM's buffers and in every Python worker; so their memory would follow the texts' length.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, "64m").lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")
    return spark


def as_strings(column) -> pa.StringArray:
    """A text column of a batch; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def words_of(texts: pa.StringArray, table: bytes) -> Words:
    """Whole texts translated byte by byte with ``table`` and split at ASCII white space."""
    texts = as_strings(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return Words(np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.string()))
    raw = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(table)
    moved = pa.py_buffer(np.ascontiguousarray(ends - ends[0]))
    plain = pa.StringArray.from_buffers(len(texts), moved, pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(plain)
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values
    filled = np.asarray(pc.binary_length(values)) > 0  # blanks at either end give empty words
    before = np.concatenate([[0], np.cumsum(filled)])
    coded = values.filter(pa.array(filled)).dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int32), before[bounds], coded.dictionary)


def slices(batches, text: str, limit: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts reach ``limit`` bytes or ``rows`` rows."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            stop = min(stop, start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word of ``words``, equal for equal words everywhere."""
    if not len(words.vocabulary):
        return np.zeros(0, np.uint64)
    values = words.vocabulary.to_numpy(zero_copy_only=False).astype(object)
    return pd.util.hash_array(values, categorize=False)[words.codes]


def fold(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each position of ``at``."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[at + i])
    return out


def window_starts(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of ``n`` words inside one text, and the text of each."""
    counts = np.maximum(np.diff(starts) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[owner] + starts[:-1][owner], owner


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text, and their bounds.

    A text of fewer words has one shingle, its whole sequence; one without words has none.
    """
    hashes, counts = word_hashes(words), np.diff(words.starts)
    at, owner = window_starts(words.starts, n)
    found, owners = [fold(hashes, at, n)], [owner]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        found.append(fold(hashes, words.starts[short], m))
        owners.append(short)
    values, owner = np.concatenate(found), np.concatenate(owners)
    if any(len(x) for x in owners[1:]):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.concatenate([[0], np.cumsum(first)])[bounds]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def covered(marks: np.ndarray) -> np.ndarray:
    """True where the running sum of span starts (+1) and ends (-1) is above zero."""
    return np.cumsum(marks[:-1]) > 0


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def key_text(column: Column) -> Column:
    """A record key as text; a null key is the word null."""
    return F.coalesce(column.cast("string"), F.lit("null"))


def numbered(
    df: DataFrame, within: list[str], order: list[str], out: str, count: Column | None = None
) -> DataFrame:
    """Number rows from 0 without gaps in each group of ``within``.

    Rows are dealt to 4,096 hash buckets by an MD5 of ``order`` and numbered inside each, in
    its order (nulls first); the buckets' counts, summed up (a table of 4,096 rows a group),
    give where each bucket begins. So no task sorts a whole group. ``count``: a row takes so
    many numbers and gets the first.
    """
    taken = F.lit(1) if count is None else count
    digest = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in order]))
    dealt = df.withColumn("_bucket", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    sums = dealt.groupBy(*within, "_bucket").agg(F.sum(taken).alias("_in_bucket"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_o_{c}") for c in within],
        F.col("_bucket").alias("_o_bucket"),
        F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("_rank", F.coalesce(F.sum(taken).over(inside), F.lit(0)))
    same = [F.col("_bucket") == F.col("_o_bucket")] + [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in within]
    joined = ranked.join(offsets, reduce(lambda x, y: x & y, same))
    return joined.select(*df.columns, (F.col("_offset") + F.col("_rank")).cast("long").alias(out))


# ---- rows of a few ids, taken out of a large table without shuffling all of it ---------

MARK_BITS = 1 << 24
"""Bits of the marks below; they make 512 rows of 4 kB, whatever the data."""


def _mark(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(MARK_BITS)) + 1


def marks(ids: DataFrame, key: str) -> DataFrame:
    """A bit for each id's hash: at most 512 rows of 4 kB, so they can always be broadcast."""
    at = _mark(F.col(key))
    return ids.groupBy(F.bitmap_bucket_number(at).alias("_m_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_m_bits")
    )


def marked(df: DataFrame, key: Column, ids: DataFrame, id_key: str) -> DataFrame:
    """``df`` with ``_hit``: false where ``key`` is surely not among the ids."""
    at, position = _mark(key), F.bitmap_bit_position(_mark(key))
    joined = df.withColumn("_m_at", at).withColumn("_m_pos", position).join(
        F.broadcast(marks(ids, id_key)), F.bitmap_bucket_number(F.col("_m_at")) == F.col("_m_row"), "left"
    )
    byte = F.conv(F.hex(F.substring(F.col("_m_bits"), (F.col("_m_pos") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.pmod(F.col("_m_pos"), F.lit(8)).cast("int")
    hit = F.coalesce(F.getbit(byte.cast("int"), bit) == 1, F.lit(False))
    return joined.withColumn("_hit", hit).drop("_m_at", "_m_pos", "_m_row", "_m_bits")
